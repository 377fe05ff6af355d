"""Token counts without token ids: the pass of pieces.py that carries only the best score and its number of pieces.

Row by row, no shuffle. Null and empty texts count 0 with score 0. Texts are taken whole, part by part; an empty
table gives no rows, repeated rows repeated ones. Ties are decided as in the library, of which the counts are. An
input column that has the name of a result is replaced by it; other names cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import by_rows, named, others
from lodestone.llm.pieces import model_bytes, segmenter

ROWS = 256
NEW = "n_tokens bigint, score double"


def count_tokens(docs: DataFrame, keep: list[str] | None = None, text: str = "text", model: str | None = None) -> DataFrame:
    """Columns ``keep``, then n_tokens long and score double, the sum of the piece scores on the best path.

    ``model`` is the path of a model file; by the default, see pieces.py, scores are log probabilities but for a constant.
    """
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # a vocabulary file, its size fixed

    def make():
        seg = segmenter(data.value)

        def run(col: pa.Array) -> list[pa.Array]:
            got = [seg.count(t or "") for t in col.to_pylist()]
            return [pa.array([n for n, _ in got], pa.int64()), pa.array([float(x) for _, x in got], pa.float64())]

        return run

    return by_rows(docs, others(docs, NEW) if keep is None else keep, [named(text)], NEW, make, ROWS)
