"""Chat formatting at the level of tokens.

Each turn becomes: TURN, the role's tokens, SEP, the text's tokens, END. These three are reserved ids above the vocabulary; role and text are encoded by themselves and the ids
spliced in between, so no content can ever produce one. Content that spells a control string, of this
template or of common others, is escaped: a backslash behind the first character of the string, backslashes
themselves doubled. Unescaping takes each backslash off the character that follows; it is exact.

The loss mask covers the tokens of assistant texts. It is a prefix sum: +1 where such a text begins, -1
behind its end.

Scale: rows are dealt by range over (conversation, turn, role, text), so a conversation of any size spreads
over tasks. Each task encodes its rows and joins whole turns to parts of at most PART_TOKENS tokens; a turn that is
longer is a part of its own. Reading back decodes and checks part by part, again wherever a part lies, and leaves its
counts and the plain bytes that the digests take. A digest over a conversation is sequential by its definition: one
task takes the bytes of a conversation's parts in order, a few parts at a time, with a few bytes of state.

Null texts and roles are empty; turns with equal numbers follow role and text, null turns come first;
repeated rows are turns of their own; an empty table gives no rows. A null conv_id is a conversation. Extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ready, written

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
#: Fixed value: how the vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESERVED = ("<|turn|>", "<|sep|>", "<|end|>")
#: Control strings of common templates.
FOREIGN = (
    "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
)
PART_TOKENS = 1 << 14
#: Decoded bytes that a task holds before it hands them on.
OUT_BYTES = 1 << 21
_BEGINS = re.compile("(?=" + "|".join(map(re.escape, sorted(RESERVED + FOREIGN, key=len, reverse=True))) + ").", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _BEGINS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """A byte-level vocabulary with reserved ids above it."""

    def __init__(self, ranks: bytes):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.base = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.turn, self.sep, self.end = range(max(merges.values()) + 1, max(merges.values()) + 4)

    def encode(self, text: str) -> list[int]:
        return self.base.encode_ordinary(escape(text))

    def decode(self, ids: list[int]) -> str:
        return self.base.decode_bytes(ids).decode()


_codecs: dict[int, Codec] = {}


def codec(ranks: bytes) -> Codec:
    key = hash(ranks)
    if key not in _codecs:
        _codecs[key] = Codec(ranks)
    return _codecs[key]


def _ranks(path: str | None) -> bytes:
    with open(path or DEFAULT_RANKS, "rb") as f:
        return f.read()


def turn_tokens(role: str, text: str, c: Codec) -> tuple[list[int], int, int]:
    """Tokens of one turn, and where those begin and end that are learned from; equal places if none are."""
    ids = [c.turn, *c.encode(role), c.sep]
    begin = len(ids)
    ids += c.encode(text)
    end = len(ids)
    ids.append(c.end)
    return ids, begin if role == "assistant" else end, end


def assemble(turns: list[tuple[list[int], int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of consecutive turns and their loss mask (0 and 1), the prefix sum of its edges."""
    sizes = np.array([len(ids) for ids, _, _ in turns])
    starts = np.cumsum(sizes) - sizes
    step = np.zeros(sizes.sum() + 1, np.int8)
    np.add.at(step, starts + np.array([b for _, b, _ in turns]), 1)
    np.add.at(step, starts + np.array([e for _, _, e in turns]), -1)
    return np.concatenate([np.array(ids, np.int32) for ids, _, _ in turns]), np.cumsum(step[:-1], dtype=np.int8)


def format_chats(conversations: DataFrame, ranks: str | None = None) -> DataFrame:
    """conv_id, part long (in order), tokens array<int>, mask array<tinyint>: the parts of all conversations.

    A part holds whole turns.
    """
    spark = ready(conversations.sparkSession)
    data = spark.sparkContext.broadcast(_ranks(ranks))  # a vocabulary file, its size fixed
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, number = codec(data.value), TaskContext.get().partitionId() << 32
        held: list[tuple[list[int], int, int]] = []
        size, conv = 0, None

        def out(conv, held):
            nonlocal number
            ids, mask = assemble(held)
            number += 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (ids, mask)]
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([number], pa.int64()), *lists], ["conv_id", "part", "tokens", "mask"])

        for batch in batches:
            for i, role, text in zip(*(batch.column(k) for k in (0, 2, 3)), strict=True):
                i, one = i.as_py(), turn_tokens(role.as_py(), text.as_py(), c)
                if held and (i != conv or size + len(one[0]) > PART_TOKENS):
                    yield out(conv, held)
                    held, size = [], 0
                conv = i
                held.append(one)
                size += len(one[0])
        if held:
            yield out(conv, held)

    return rows.mapInArrow(run, "conv_id bigint, part bigint, tokens array<int>, mask array<tinyint>")


def _plain(ids: np.ndarray, mask: np.ndarray, c: Codec, strings: dict[int, int]) -> tuple[int, bytes, int, bytes, int, int]:
    """Of a part: turns, the bytes of all turns, learned characters and bytes, characters of the formatted text, tokens."""
    seps, ends = np.flatnonzero(ids == c.sep), np.flatnonzero(ids == c.end)
    begins = np.flatnonzero(ids == c.turn)
    if not len(begins) == len(seps) == len(ends):
        raise ValueError("a part is not made of whole turns")
    turns, learned, chars, total = [], [], 0, 0
    for begin, sep, end in zip(begins.tolist(), seps.tolist(), ends.tolist(), strict=True):
        role, text = c.decode(ids[begin + 1 : sep].tolist()), c.decode(ids[sep + 1 : end].tolist())
        turns.append(f"{unescape(role)}\n{unescape(text)}\n".encode())
        under = ids[sep + 1 : end][mask[sep + 1 : end] != 0]
        if len(under):
            one = unescape(c.decode(under.tolist()))
            chars += len(one)
            learned.append(one.encode())
        total += len(role) + len(text) + sum(strings.values())
    return len(begins), b"".join(turns), chars, b"".join(learned), total, len(ids)


def read_back(parts: DataFrame, ranks: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, from tokens and masks alone."""
    spark = ready(parts.sparkSession)
    data = spark.sparkContext.broadcast(_ranks(ranks))
    types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    fields = ["n_turns", "turns", "loss_chars", "loss", "formatted_chars", "n_tokens"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value)
        strings = dict(zip((c.turn, c.sep, c.end), map(len, RESERVED), strict=True))
        for batch in batches:
            at = size = 0
            held: list[tuple] = []
            for k in range(batch.num_rows):
                held.append(_plain(*(batch.column(x)[k].values.to_numpy() for x in (2, 3)), c, strings))
                size += len(held[-1][1]) + len(held[-1][3])
                if size > OUT_BYTES or k + 1 == batch.num_rows:
                    own = [batch.column(x).slice(at, len(held)) for x in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True))], ["conv_id", "part", *fields])
                    at, size, held = k + 1, 0, []

    plain = parts.select("conv_id", "part", "tokens", "mask").mapInArrow(decoded, "conv_id bigint, part bigint, n_turns bigint, turns binary, loss_chars bigint, loss binary, formatted_chars bigint, n_tokens bigint")
    plain = plain.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def finish() -> None:
            conv, turns, n, learned, *rest = state
            done.append((conv, n, turns.hexdigest(), rest[0], learned.hexdigest(), *rest[1:]))

        def table() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], types[k]) for k in range(7)], NAMES)

        for batch in batches:
            convs, counts = batch.column(0).to_pylist(), [batch.column(k).to_pylist() for k in (2, 4, 6, 7)]
            for k, conv in enumerate(convs):
                if state is None or conv != state[0]:
                    if state is not None:
                        finish()
                    state = [conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                state[1].update(batch.column(3)[k].as_buffer())
                state[3].update(batch.column(5)[k].as_buffer())
                for at, values in zip((2, 4, 5, 6), counts, strict=True):
                    state[at] += values[k]
            if len(done) > 1000:
                yield table()
                done = []
        if state is not None:
            finish()
        yield table()

    return plain.mapInArrow(folded, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint")


def formatted(conversations: DataFrame, ranks: str | None = None) -> DataFrame:
    return read_back(written(format_chats(conversations, ranks), "chats"), ranks)
