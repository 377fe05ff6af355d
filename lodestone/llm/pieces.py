"""SentencePiece models without the library: the model file, an Aho-Corasick automaton over its pieces,
and one pass of dynamic programming that follows the output links at each position.

Two kinds of model exist and each has its own relaxation rule, both exact:

* unigram: the Viterbi rule. At each end position the matches come longest first; a match replaces
  the best path only if its score is strictly greater, which is the library's tie rule. Counting carries the best
  score and its number of pieces from position to position and keeps no path.
* BPE: sums of scores cannot reproduce merges, whose scores are ranks. Here the same pass keeps, for
  each position, the one piece that ends the merge result of the prefix: the longest match that stays
  beside the last piece of what precedes it (van Antwerpen and Neubeck). Whether two pieces stay side
  by side is decided by merging their characters, and remembered.

The public vocabulary at hand is a BPE model. By default its pieces are read as a unigram model: the piece of rank r
has the log probability -log(r + 2) up to a constant, in steps of 1 / STEP, so that the library's sums in
single precision are exact for texts of up to about 100,000 pieces, and ties are common. Nothing is trained. A path to a
model file takes that file as it is, with its own rule.

A text is cut where no piece can cross: before a space that follows another character, and around
characters that no piece holds. Each part is segmented once and remembered in a bounded cache.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What the format takes off the least score for an unknown character.
UNKNOWN_PENALTY = 10.0
#: Scores of the unigram reading are multiples of 1 / STEP.
STEP = 16
CACHE = 250_000
#: Longer parts are segmented anew each time, so that the cache stays small.
CACHED_CHARS = 64


def _fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire kind, value) of each field of a message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = b[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, number()
        else:
            n = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, kind, b[at : at + n]
            at += n


def _message(fields: list[tuple[int, int, int | bytes]]) -> bytes:
    """What ``_fields`` reads."""

    def number(v: int) -> bytes:
        out = bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v])

    return b"".join(number(f << 3 | kind) + (number(v) if kind == 0 else (number(len(v)) if kind == 2 else b"") + v) for f, kind, v in fields)


def unigram(data: bytes) -> bytes:
    """A model file with the same pieces, in which the order of their scores gives log probabilities (see above)."""
    pieces = [{f: v for f, _, v in _fields(x)} for n, _, x in _fields(data) if n == 1]
    score = [struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0] for d in pieces]
    normal = [i for i, d in enumerate(pieces) if d.get(3, NORMAL) == NORMAL]
    for r, i in enumerate(sorted(normal, key=lambda i: (-score[i], i))):
        score[i] = -round(math.log(r + 2) * STEP) / STEP
    out, at = [], 0
    for n, kind, x in _fields(data):
        if n == 1:
            x = _message([(f, k, v) for f, k, v in _fields(x) if f != 2] + [(2, 5, struct.pack("<f", score[at]))])
            at += 1
        elif n == 2:
            x = _message([(f, k, v) for f, k, v in _fields(x) if f != 3] + [(3, 0, UNIGRAM)])
        out.append((n, kind, x))
    return _message(out)


class Model:
    """The parts of a model file that encoding needs. Only the identity normalisation is supported."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.prefix, rules, self.squeeze = UNIGRAM, False, True, "identity", True
        for f, _, v in _fields(data):
            if f in (1, 2, 3):
                d = {g: x for g, _, x in _fields(v)}
            if f == 1:
                self.pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
            elif f == 2:
                self.kind, self.byte_fallback = d.get(3, UNIGRAM), bool(d.get(35, 0))
            elif f == 3:
                rules, self.prefix, self.squeeze = d.get(1, b"").decode(), bool(d.get(3, 1)), bool(d.get(4, 1))
        if rules != "identity" or self.squeeze or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only models with identity normalisation that keep white space are supported")
        if any(t == USER_DEFINED for _, _, t in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")


class Segmenter:
    """Encodes, counts and decodes with one model."""

    def __init__(self, model: Model):
        self.model = model
        self.score: list[float] = [s for _, s, _ in model.pieces]
        self.text: list[str] = [p for p, _, _ in model.pieces]
        self.id = {p: i for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL}
        self.unknown = next((i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN), 0)
        self.control = {i for i, x in enumerate(model.pieces) if x[2] == CONTROL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if model.byte_fallback and len(self.bytes) < 256:
            raise ValueError("a model with byte fallback needs all 256 byte pieces")
        self.unknown_score = min((s for _, s, t in model.pieces if t == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.length = [len(p) for p in self.text]
        self.spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else p.encode() for i, p in enumerate(self.text)]
        self._beside: dict[int, bool] = {}
        self.rank = {p: -self.score[i] for p, i in self.id.items()}
        self.made_of: dict[str, tuple[str, str]] = {}
        whole = self.id
        if model.kind == BPE:  # a piece that its own merges don't build can't be a result
            whole = {p: i for p, i in self.id.items() if self._merge(p, self.made_of) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in whole.items():
            self.automaton.add_word(p, (i, len(p)))
        if whole:
            self.automaton.make_automaton()
        self.whole = bool(whole)
        self.single = {p for p in self.id if len(p) == 1}
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        self._parts = None if crossing else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._ids: dict[str, bytes] = {}  # ids as 32-bit numbers: small, and nothing for the collector to follow
        self._counts: dict[str, tuple[int, float]] = {}
        self._old_ids: dict[str, bytes] = {}
        self._old_counts: dict[str, tuple[int, float]] = {}

    # -- one part -------------------------------------------------------------------------------

    def _merge(self, s: str, made_of: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Merge neighbours by best score, leftmost first, with a heap: the definition of BPE."""
        part, left, right = list(s), list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.id.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, part[a] + part[b]))

        for a in range(len(s) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not part[a] or not part[b] or right[a] != b or part[a] + part[b] != joined:
                continue
            if made_of is not None:
                made_of[joined] = part[a], part[b]
            part[a], part[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def _stay(self, a: str, b: str) -> bool:
        """Whether merging leaves the boundary between two finished pieces alone.

        The merges of both are undone, last first. Had the two pieces then at the boundary merged
        before the merge that is being undone, the boundary would be gone. Of equal merges the left
        one comes first.
        """
        rank, made_of = self.rank, self.made_of
        limit = 1e18
        while True:
            r = rank.get(a + b)
            if r is not None and r < limit:
                return False
            ra = rank[a] if len(a) > 1 else -1
            rb = rank[b] if len(b) > 1 else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, made_of[a][1]
            else:
                limit, b = rb + 0.5, made_of[b][0]

    def _paths(self, s: str) -> tuple[list[int], list[int]]:
        """For each end position the last piece (-1: an unknown character, -2: none) and its length."""
        n = len(s)
        last, size = [-2] * (n + 1), [0] * (n + 1)
        single = self.single
        if self.model.kind == BPE:
            text, beside = self.text, self._beside
            if not single.issuperset(s):  # no piece holds an unknown character, so its place is known beforehand
                for at, c in enumerate(s, 1):
                    if c not in single:
                        last[at], size[at] = -1, 1
            for end, (i, k) in self.automaton.iter(s) if self.whole else ():
                end += 1
                if last[end] != -2:
                    continue
                if k < end:
                    before = last[end - k]
                    if before == -2:
                        continue
                    if before >= 0:
                        ok = beside.get(before << 32 | i)
                        if ok is None:
                            if len(beside) >= CACHE:
                                beside.clear()
                            ok = beside[before << 32 | i] = self._stay(text[before], text[i])
                        if not ok:
                            continue
                last[end], size[end] = i, k
            return last, size
        best, score, cost, done = [0.0] * (n + 1), self.score, self.unknown_score, 0

        def unknowns(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if s[done - 1] not in single and (last[done] == -2 or best[done - 1] + cost > best[done]):
                    last[done], size[done], best[done] = -1, 1, best[done - 1] + cost

        for end, (i, k) in self.automaton.iter(s) if self.whole else ():
            end += 1
            if done < end - 1:
                unknowns(end - 1)
            if k < end and last[end - k] == -2:
                continue
            x = best[end - k] + score[i]
            if last[end] == -2 or x > best[end]:
                last[end], size[end], best[end] = i, k, x
        unknowns(n)
        return last, size

    def _tied(self, s: str) -> bool:
        """Runs of spaces: their pieces share one score, for which merging itself is the rule."""
        return self.model.kind == BPE and SPACE * 2 in s

    def _char(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.model.byte_fallback else [self.unknown]

    def _segment(self, s: str) -> list[int]:
        if self._tied(s):
            return [x for p in self._merge(s) for x in ([self.id[p]] if p in self.id else self._char(p))]
        last, size = self._paths(s)
        out, at = [], len(s)
        while at:
            i = last[at]
            if i >= 0:
                out.append(i)
            else:
                out += reversed(self._char(s[at - 1]))
            at -= size[at]
        out.reverse()
        return out

    def _count(self, s: str) -> tuple[int, float]:
        """Number of pieces and score of the best path: both are carried forward, and no path is kept."""
        if self._tied(s):
            got = self._merge(s)
            n = sum(1 if p in self.id else len(self._char(p)) for p in got)
            return n, float(sum(self.score[self.id[p]] if p in self.id else self.unknown_score for p in got))
        if self.model.kind == BPE:
            return self._count_merges(s)
        n = len(s)
        best, pieces, score, cost, single, done = [0.0] + [None] * n, [0] * (n + 1), self.score, self.unknown_score, self.single, 0
        strange = not single.issuperset(s)

        def unknowns(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if s[done - 1] not in single and (best[done] is None or best[done - 1] + cost > best[done]):
                    best[done], pieces[done] = best[done - 1] + cost, pieces[done - 1] + len(self._char(s[done - 1]))

        for end, (i, k) in self.automaton.iter(s) if self.whole else ():
            if strange and done < end:
                unknowns(end)
            end += 1
            x = best[end - k]
            if x is None:
                continue
            x += score[i]
            if best[end] is None or x > best[end]:
                best[end], pieces[end] = x, pieces[end - k] + 1
        if strange:
            unknowns(n)
        return pieces[n], best[n]

    def _count_merges(self, s: str) -> tuple[int, float]:
        """The same by the rule of BPE, which keeps the last piece of each prefix."""
        n = len(s)
        last, pieces, sums = [-2] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        text, beside, score, strange = self.text, self._beside, self.score, not self.single.issuperset(s)

        def unknowns(a: int, b: int) -> None:
            for at in range(a, b):
                if last[at + 1] == -2 and s[at] not in self.single:
                    last[at + 1], pieces[at + 1], sums[at + 1] = -1, pieces[at] + len(self._char(s[at])), sums[at] + self.unknown_score

        done = 0
        for end, (i, k) in self.automaton.iter(s) if self.whole else ():
            if strange and done < end:
                unknowns(done, end)
                done = end
            end += 1
            if last[end] != -2:
                continue
            if k < end:
                before = last[end - k]
                if before == -2:
                    continue
                if before >= 0:
                    ok = beside.get(before << 32 | i)
                    if ok is None:
                        if len(beside) >= CACHE:
                            beside.clear()
                        ok = beside[before << 32 | i] = self._stay(text[before], text[i])
                    if not ok:
                        continue
            last[end], pieces[end], sums[end] = i, pieces[end - k] + 1, sums[end - k] + score[i]
        if strange:
            unknowns(done, n)
        return pieces[n], sums[n]

    # -- whole texts ----------------------------------------------------------------------------

    def parts(self, text: str) -> list[str]:
        """The text with spaces escaped, cut where no piece can cross."""
        if not text:
            return []
        if self._parts is None:
            return [(SPACE if self.model.prefix else "") + text.replace(" ", SPACE)]
        out: list[str] = []
        if "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text and self.model.prefix:
            out = [SPACE + w for w in text.split(" ")]
        else:
            out = self._parts.findall((SPACE if self.model.prefix else "") + text.replace(" ", SPACE))
        if "\n" in text and "\n" not in self.single:
            out = [p for w in out for p in (w.replace("\n", "\0\n\0").split("\0") if "\n" in w and "\0" not in w else (w,)) if p]
        return out

    def encode(self, text: str) -> list[int]:
        """Piece ids of a whole text; the empty text has none."""
        return array("i", self.encoded(text)).tolist()

    def encoded(self, text: str) -> bytes:
        """The same ids as 32-bit numbers in the machine's order."""
        parts = self.parts(text)
        got = list(map(self._ids.get, parts))
        if None in got:
            got = [self._part(w) if x is None else x for w, x in zip(parts, got, strict=True)]
        if self.model.byte_fallback:
            return b"".join(got)
        return array("i", self._merged(array("i", b"".join(got)).tolist())).tobytes()

    def _part(self, w: str) -> bytes:
        ids = self._ids.get(w) or self._old_ids.get(w)
        if ids is None:
            ids = array("i", self._segment(w)).tobytes()
        if len(w) <= CACHED_CHARS:
            if len(self._ids) >= CACHE:  # the previous generation is still looked up
                self._ids, self._old_ids = {}, self._ids
            self._ids[w] = ids
        return ids

    def _merged(self, ids: list[int]) -> list[int]:
        """Without byte fallback a run of unknown characters is one piece."""
        if self.model.byte_fallback or self.unknown not in ids:
            return ids
        return [i for k, i in enumerate(ids) if i != self.unknown or k == 0 or ids[k - 1] != self.unknown]

    def count(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of the best path, which is not kept (only a model without byte fallback needs
        the ids, since it joins neighbouring unknown characters across parts)."""
        if not self.model.byte_fallback:
            ids = self.encode(text)
            return len(ids), float(sum(self._count(w)[1] for w in self.parts(text)))
        cache, old, n, score = self._counts, self._old_counts, 0, 0.0
        for w in self.parts(text):
            got = cache.get(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    got = self._count(w)
                if len(w) <= CACHED_CHARS:
                    if len(cache) >= CACHE:  # the previous generation is still looked up
                        old = self._old_counts = dict(cache)
                        cache.clear()
                    cache[w] = got
            n += got[0]
            score += got[1]
        return n, score

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: control pieces vanish, bytes that aren't UTF-8 become U+FFFD, the prefix space goes."""
        if not self.control.isdisjoint(ids):  # bytes on both sides of a control piece belong to different characters
            runs: list[list[int]] = [[]]
            for i in ids:
                runs.append([]) if i in self.control else runs[-1].append(i)
        else:
            runs = [ids]
        # a piece's text is whole characters, so bytes of incomplete ones never join with it
        s = "".join([b"".join(map(self.spelled.__getitem__, run)).decode("utf-8", "replace") for run in runs]).replace(SPACE, " ")
        return s[1:] if self.model.prefix and s.startswith(" ") else s


_made: dict[int, tuple[bytes, Segmenter]] = {}


def segmenter(data: bytes) -> Segmenter:
    """One segmenter for each model and worker process."""
    key = hash(data)
    if key not in _made or _made[key][0] != data:
        _made[key] = data, Segmenter(Model(data))
    return _made[key][1]


def model_bytes(path: str | None = None) -> bytes:
    """A model file as it is, or by default the public vocabulary read as a unigram model."""
    with open(path or DEFAULT_MODEL, "rb") as f:
        data = f.read()
    return data if path else unigram(data)
