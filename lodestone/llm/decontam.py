"""Benchmark decontamination by templates.

Every text is read as two streams of canonical tokens. In both a number (with its points and commas) becomes NUMBER
and a unit behind a number UNIT. In the plain stream every other word is itself, without case. In the template
stream a run of capitalised words becomes one NAME, unless it is the single word that opens a sentence; other words
are themselves. So a copy in other case, after a quote or with the same names is found by the plain stream, and one
with other names by the template stream. Windows of WINDOW tokens of documents and benchmark items are joined on
their hash, stream by stream. Items of LEAST to WINDOW - 1 tokens are one window of their own length; shorter ones
carry too little evidence and match nothing. The first window of an item is taken a second time with its opening
word as a NAME, as that word is where a copy follows a quote or bracket.

Slots: each placeholder in a matched window pairs the item's value with the document's. Windows of one item on one
diagonal (position in document minus position in item) are evidence only if each value of the item has one value in
the document there; second windows that contradict are left out alone. Diagonals are taken together only if
this holds over all of them, the longest first. Values that differ make a re-parameterised question. A window of
slots only counts with the item's own values; of an item that is a single window LEAST - 1 words must be no slots.
A document is contaminated by an item if one of these holds in one of the streams:
- consistent windows, wherever they are, are COVER of the item's windows;
- one diagonal holds a run of consistent windows of PASSAGE tokens, whatever share of the item that is;
- consistent windows on two neighbouring diagonals (one word put in or left out) hold COVER of the item's tokens, and
  WINDOW tokens at least. Items of more than WINDOW and under EDITED tokens have windows of LEAST tokens for this rule
  alone, at most half of them slots: one changed word may leave no window of WINDOW tokens whole. An item of EDITED
  tokens with one changed word still holds PASSAGE tokens in a row.

Scale: windows of documents pass a bit table of the benchmark's window hashes (fixed size, 2^TABLE_BITS bits)
in the scan itself, so what is joined is near what matches. The exact join on the hash follows; the
benchmark's windows are broadcast only up to a checked number of rows, else the join shuffles and adaptive
execution may split a window that very many documents hold. The evidence of one text and one item meets in one
task, streamed over sorted rows; it is bounded by that text.

Null and empty texts match nothing, an empty benchmark nothing at all; repeated items report each item_id. Rows that
share a doc_id are texts of their own: none takes from another's evidence, and equal ones count once. A text
of any length is read whole, in pieces. Extra columns of the inputs are not read; ``drop_contaminated`` returns them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import named, ready, sized, written
from lodestone.llm.words import mix, tokens, windows, word_hash

WINDOW, LEAST, COVER = 8, 4, 0.6
PASSAGE = 13
EDITED = 2 * PASSAGE + 1
TABLE_BITS = 24
#: Units of measurement that become placeholders behind a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh"
).split()
_NUMBER, _NAME, _UNIT = (np.uint64(word_hash(w)) for w in ("numberslot", "nameslot", "unitslot"))
_units = np.sort(np.array([word_hash(u) for u in UNITS], np.uint64))


PLAIN, TEMPLATE = 0, 1


def _streams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, stream, offsets, canonical hashes, values, whether a slot, rows whose first word opens with a capital)."""
    for t in tokens(col, context=True, numbers=True):
        n = len(t.hashes)
        h, first = t.hashes.copy(), np.zeros(n, bool)
        h[t.digit] = _NUMBER
        starts = t.offsets[:-1][t.offsets[:-1] < t.offsets[1:]]
        first[starts] = True
        behind = np.zeros(n, bool)
        behind[1:] = t.digit[:-1]
        unit = behind & ~first & (_units[np.minimum(np.searchsorted(_units, t.hashes), len(_units) - 1)] == t.hashes)
        h[unit] = _UNIT
        slot = t.digit | unit
        none = np.zeros(0, np.int64)
        yield t.first, PLAIN, t.offsets, h, t.hashes, slot, none
        name = t.capital & ~t.opens & ~unit
        goes_on = np.zeros(n, bool)  # a name whose run goes on with the next word
        goes_on[:-1] = name[1:]
        name |= t.capital & t.opens & goes_on
        inner = np.zeros(n, bool)
        inner[1:] = name[1:] & name[:-1] & ~t.opens[1:]
        kept = np.flatnonzero(~inner)
        if len(kept):
            place = np.arange(n) - np.repeat(kept, np.diff(np.append(kept, n)))
            value = np.add.reduceat(mix(t.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kept)
        else:
            value = np.zeros(0, np.uint64)
        offsets = np.searchsorted(kept, t.offsets)
        leads = np.flatnonzero((first & t.capital & ~name)[kept])
        yield t.first, TEMPLATE, offsets, np.where(name, _NAME, h)[kept], value, (slot | name)[kept], leads


def _windows(col: pa.Array, lengths: list[list[int]], whole: bool, table: np.ndarray | None) -> Iterator[tuple]:
    """(row, window hash, position, length, slot lists, tokens of the row, stream, whether a second window);
    ``lengths`` by stream; ``whole``: only the windows that items have."""
    for first, stream, offsets, canon, value, slot, leads in _streams(col):
        kinds = [(canon, slot, None)]
        if whole and len(leads):  # windows that begin with such a word, as a NAME
            canon, slot, lead = canon.copy(), slot.copy(), np.zeros(len(canon), bool)
            canon[leads], slot[leads], lead[leads] = _NAME, True, True
            kinds.append((canon, slot, lead))
        for k in lengths[stream]:
            for hashes, filled, lead in kinds:
                h, row, at = windows(hashes, offsets, k)
                h = mix(h ^ np.uint64(k | stream << 8))
                own = np.diff(offsets)[row]
                ok = np.ones(len(h), bool)
                if whole:
                    before = np.concatenate(([0], np.cumsum(filled)))
                    slots = before[at + k] - before[at]
                    ok = own == k if k < WINDOW else own >= k
                    if k == LEAST:
                        ok |= (own > WINDOW) & (own < EDITED) & (slots <= k // 2)
                if lead is not None:
                    ok &= lead[at]
                if table is not None:
                    ok &= (table[(h >> np.uint64(67 - TABLE_BITS)).astype(np.int64)] >> (h >> np.uint64(64 - TABLE_BITS) & np.uint64(7)).astype(np.uint8)) & 1 == 1
                h, row, at, own = h[ok], row[ok], at[ok], own[ok]
                inside = at[:, None] + np.arange(k)
                held = filled[inside]
                ends = np.concatenate(([0], np.cumsum(held.sum(axis=1)))).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[inside[held]].view(np.int64)))
                yield first + row, h.view(np.int64), at - offsets[row], k, slots, own, stream, lead is not None


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, hash, at (position), k (tokens of the window), slots, n (tokens of the item), stream, second, for every item of LEAST tokens or more."""
    ready(benchmark.sparkSession)
    every = [[*range(LEAST, WINDOW + 1)]] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, at, k, slots, own, stream, second in _windows(batch.column(1), every, True, None):
                same = [np.full(len(h), x, np.int64) for x in (k, stream)]
                cols = [batch.column(0).take(pa.array(row)), pa.array(h), pa.array(at), pa.array(same[0]), slots, pa.array(own), pa.array(same[1]), pa.array(np.full(len(h), second))]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "hash", "at", "k", "slots", "n", "stream", "second"])

    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").dropDuplicates()
    return items.mapInArrow(run, "item_id bigint, hash bigint, at bigint, k bigint, slots array<bigint>, n bigint, stream bigint, second boolean")


def _bits(items: DataFrame) -> np.ndarray:
    """The bit table of the hashes, made where the hashes are and merged word by word."""
    got = items.selectExpr(
        f"cast(shiftrightunsigned(hash, {67 - TABLE_BITS}) as int) as at", f"shiftleft(1, cast(shiftrightunsigned(hash, {64 - TABLE_BITS}) & 7 as int)) as b"
    )
    got = got.groupBy("at").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2^(TABLE_BITS - 3) rows, whatever the benchmark
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    table[got["at"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return table


def _agree(pairs: set[tuple[int, int]]) -> bool:
    """Whether each value of the item has one value in the document."""
    return len({a for a, _ in pairs}) == len(pairs)


class _Line:
    """The windows of an item on one diagonal, as far as their slots agree."""

    def __init__(self, hits: list[tuple]):
        self.at: set[int] = set()  # positions of the windows that items are measured by
        self.tokens: set[int] = set()
        self.solid: set[int] = set()
        self.pairs: set[tuple[int, int]] = set()  # of the windows
        self.all_pairs: set[tuple[int, int]] = set()  # of the tokens
        groups: dict[int, list[tuple]] = defaultdict(list)
        for hit in hits:
            n, k, _, _, second, slots, values = hit
            if slots != values and (len(slots) == k or k == n and len(slots) > n - (LEAST - 1)):
                continue
            groups[2 if LEAST <= k < min(WINDOW, n) else int(second)].append(hit)
        for rank, own in sorted(groups.items()):
            pairs = {p for *_, slots, values in own for p in zip(slots, values, strict=True)}
            if not _agree(self.all_pairs | pairs):
                if rank == 0:
                    return
                continue
            self.all_pairs |= pairs
            for _, k, at, _, _, slots, values in own:
                self.tokens.update(range(at, at + k))
                if rank < 2:
                    self.at.add(at)
                    if k == WINDOW:
                        self.solid.add(at)
            if rank < 2:
                self.pairs = set(self.all_pairs)

    def passage(self) -> bool:
        run, last = 0, None
        for at in sorted(self.solid):
            run = run + 1 if last is not None and at == last + 1 else 1
            if run + WINDOW - 1 >= PASSAGE:
                return True
            last = at
        return False


def evidence(hits: list[tuple]) -> tuple[float, bool] | None:
    """(covered, whether values differ) of one text and one item in one stream, or None; ``hits`` are
    (tokens of the item, window's tokens, position in the item, in the text, second, item's values, text's values)."""
    n = hits[0][0]
    by: dict[int, list[tuple]] = defaultdict(list)
    for hit in hits:
        by[hit[3] - hit[2]].append(hit)
    lines = {d: line for d, own in by.items() if (line := _Line(own)).tokens}
    at, pairs, passage, found = set(), set(), False, []
    for _, line in sorted(lines.items(), key=lambda x: (-len(x[1].at), x[0])):
        if line.at - at and _agree(pairs | line.pairs):
            at, pairs = at | line.at, pairs | line.pairs
        passage = passage or line.passage()
    found.append((len(at) / max(n - WINDOW + 1, 1), any(a != b for a, b in pairs)))
    for d, line in lines.items():
        tokens, used = line.tokens, line.all_pairs
        if (near := lines.get(d + 1)) and _agree(used | near.all_pairs):
            tokens, used = tokens | near.tokens, used | near.all_pairs
        if len(tokens) >= min(n, WINDOW) or passage:
            found.append((len(tokens) / n, any(a != b for a, b in used)))
    covered, differs = max(found, key=lambda x: (x[0], not x[1]))
    return (covered, differs) if passage or covered >= COVER else None


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered double (share of the item's windows or tokens), reparameterised boolean; one row for each contaminated pair."""
    spark = ready(docs.sparkSession)
    items = written(item_windows(benchmark), "items")
    lengths: list[list[int]] = [[], []]
    for r in items.select("stream", "k").distinct().orderBy("k").collect():  # LEAST to WINDOW at most
        lengths[r.stream].append(r.k)
    table = spark.sparkContext.broadcast(_bits(items))  # 2^TABLE_BITS bits

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, at, _, slots, _, _, _ in _windows(batch.column(2), lengths, False, table.value):
                if len(row):
                    cols = [*(batch.column(k).take(pa.array(row)) for k in (0, 1)), pa.array(h), pa.array(at), slots]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "h", "pos", "values"])

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = texts.mapInArrow(find, "doc_id bigint, t bigint, h bigint, pos bigint, values array<bigint>")
    # of windows of slots only, which tables of numbers are full of, just those with the item's values are joined
    hits = found.join(sized(items), (F.col("h") == F.col("hash")) & ((F.size("slots") < F.col("k")) | (F.col("slots") == F.col("values"))))
    key = ["doc_id", "t", "item_id", "stream"]
    hits = hits.select(*key, "n", "k", "at", "pos", "second", "slots", "values").dropDuplicates([*key, "k", "at", "pos", "second"])
    hits = hits.repartition(*key).sortWithinPartitions(*key)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now: tuple | None = None
        out: list[tuple] = []

        def done() -> None:
            if held and (got := evidence(held)):
                out.append((now[0], now[2], *got))

        def batch_of() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["doc_id", "item_id", "covered", "reparameterised"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != now:
                    done()
                    now, held = row[:4], []
                held.append(row[4:])
            yield batch_of()
            out = []
        done()
        yield batch_of()

    each = hits.mapInArrow(judge, "doc_id bigint, item_id bigint, covered double, reparameterised boolean")
    best = each.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", (~F.col("reparameterised")).alias("same"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.covered").alias("covered"), (~F.col("best.same")).alias("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates; rows without doc_id stay, rows that share one go together."""
    gone = written(contamination(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(sized(gone), "doc_id", "left_anti").select(*map(named, docs.columns))
