"""SentencePiece encoding and decoding of whole texts (see pieces.py for the automaton and its pass).

Each row is encoded by itself, so there is no shuffle and no group; a lost executor costs its rows only.
Null and empty texts have no pieces. Texts of any length are taken whole, part by part; a part has no spaces within.
Repeated rows give repeated results, an empty table none. Ties are decided as in the library. The character U+2581
is the format's own space mark and decodes to a space, as in the library. An input column that has the name of a
result is replaced by it; other names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import by_rows, named, others
from lodestone.llm.pieces import SPACE, model_bytes, segmenter

ROWS = 256
NEW = "ids array<int>, n_pieces bigint, n_bytes bigint, roundtrip boolean"


def encode(docs: DataFrame, keep: list[str] | None = None, text: str = "text", model: str | None = None) -> DataFrame:
    """Columns ``keep``, then ids array<int>, n_pieces long, n_bytes long (byte pieces among them),
    roundtrip boolean: decoding the ids gives the text back. ``model`` is the path of a model file."""
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # a vocabulary file, its size fixed

    def make():
        seg = segmenter(data.value)
        is_byte = np.zeros(len(seg.text), bool)
        is_byte[list(seg.byte_of)] = True

        def run(col: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in col.to_pylist()]
            ids = [np.frombuffer(seg.encoded(t), np.intc) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = np.concatenate(ids)
            n_bytes = np.concatenate([[0], np.cumsum(is_byte[flat])])[offsets]
            back = [seg.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            return [lists, pa.array(np.diff(offsets)), pa.array(np.diff(n_bytes)), pa.array(back)]

        return run

    return by_rows(docs, others(docs, NEW) if keep is None else keep, [named(text)], NEW, make, ROWS)


def decode(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """All columns of ``encoded`` but one named text, and text string, decoded from ids; null ids give the empty text."""
    data = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))

    def make():
        seg = segmenter(data.value)
        return lambda col: [pa.array([seg.decode(x or []) for x in col.to_pylist()], pa.string())]

    return by_rows(encoded, others(encoded, "text string"), [named(ids)], "text string", make, ROWS)
