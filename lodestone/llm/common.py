"""What the operators share: reading tables, shipping code, rows through Python, joins with hot keys."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.scratch import discard, fresh, scratch, written

__all__ = ["by_rows", "discard", "fresh", "join_counted", "named", "others", "ready", "scratch", "sized", "table", "written"]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Broadcast joins are used up to this many rows of a narrow table; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows of a batch that goes to Python, where the session has the default: texts and multisets are wide rows.
BATCH_ROWS = 500
#: A key with so many rows is a hot one; with more rows in all than HOT * HOT_KEYS it takes more, so that hot keys stay few.
HOT, HOT_KEYS = 100, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors (once for each context), and keep batches small.

    Where PYTHONPATH already has it (a cluster image, a test run) nothing is sent. The batch size is a setting of the
    session, since a plan reads it when it runs; a session that sets its own keeps it.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not getattr(sc, "_lodestone_sent", False):
        if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            import tempfile

            at = os.path.join(os.path.realpath(tempfile.mkdtemp()), "lodestone_code.zip")
            with zipfile.ZipFile(at, "w") as z:
                for d, _, names in os.walk(os.path.join(_ROOT, "lodestone")):
                    for n in names:
                        if n.endswith(".py"):
                            z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), _ROOT))
            sc.addPyFile(at)
            sc.environment["PYTHONPATH"] = _ROOT  # for executors that see the same folder, at once
        sc._lodestone_sent = True
    return spark


def named(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, new: str) -> list[str]:
    """The columns of ``df`` but those that have the name of one of the columns that the DDL text ``new`` tells."""
    taken = {f.name.lower() for f in StructType.fromDDL(new)}
    return [c for c in df.columns if c.lower() not in taken]


def by_rows(df: DataFrame, keep: list[str], inputs: list[Column], new: str, make: Callable[[], Callable[..., list[pa.Array]]], rows: int | None = None) -> DataFrame:
    """Columns ``keep``, then the columns ``new`` (DDL), which Python computes from ``inputs``, row by row.

    Columns travel by position, so that none of their names can clash with another. ``make`` is called once in a
    task and gives a function from the inputs' Arrow arrays, ``rows`` rows at a time, to the new columns.
    """
    ready(df.sparkSession)
    fields, kept = StructType.fromDDL(new).fields, [df.schema[c] for c in keep]
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate([*kept, *fields])])
    base = df.select(*(named(c).alias(f"k{i}") for i, c in enumerate(keep)), *(x.alias(f"i{i}") for i, x in enumerate(inputs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows or max(1, whole.num_rows)):
                batch = whole.slice(at, rows)
                columns = [*batch.columns[: len(kept)], *one(*batch.columns[len(kept) :])]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return base.mapInArrow(run, schema).toDF(*keep, *(f.name for f in fields))


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS narrow rows, else unhinted."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Inner join of many rows with one narrow row for each key, whose column ``count`` says how many rows have that key.

    A side of BROADCAST_ROWS at most is broadcast. Of a larger one the hot keys, HOT_KEYS at most, are; the others
    shuffle and none of them has many rows. ``count`` is left out.
    """
    size = side.agg(F.count("*").alias("keys"), F.sum(count).alias("rows")).first()
    if size["keys"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side.drop(count)), keys)
    hot = max(HOT, -(-size["rows"] // HOT_KEYS))
    few, many = side.where(F.col(count) >= hot).drop(count), side.where(F.col(count) < hot).drop(count)
    a = rows.join(F.broadcast(few), keys)
    b = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys)
    return a.unionByName(b)
