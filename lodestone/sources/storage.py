"""Tables as immutable Parquet parts, and for each database one pointer that names the parts of all its tables.

``<path>/<database>/tables/<table>/<part>/`` is written whole under a new name; ``<path>/<database>/CURRENT`` is
replaced by a rename, so a commit of several tables is seen whole or not at all. The parts of the version before
stay, since a DataFrame may still read them; older ones are deleted at a commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.operators.select import SEQ
from lodestone.schema import Schema
from lodestone.scratch import fresh

Parts = tuple[str, ...]


class Storage:
    def __init__(self, spark: SparkSession, path: str | None = None):
        """Without a path the parts lie in the shared scratch folder until the driver ends, and no pointer is kept."""
        self.spark, self.durable = spark, path is not None
        self.path = (path or fresh(spark, "engine")).rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self.durable:
            self._fs.mkdirs(self._at(self.path))
            self._fs.deleteOnExit(self._at(self.path))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _folder(self, database: str, table: str) -> str:
        return f"{self.path}/{database}/tables/{table}"

    # -- parts ----------------------------------------------------------------------------------

    def write(self, database: str, table: str, df: DataFrame) -> str:
        part = uuid.uuid4().hex
        df.write.parquet(f"{self._folder(database, table)}/{part}")
        return part

    def open(self, database: str, table: str, parts: Parts, schema: Schema) -> DataFrame:
        struct = StructType([*schema.struct.fields, StructField(SEQ, LongType())])
        if not parts:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(*(f"{self._folder(database, table)}/{p}" for p in parts))

    def bytes(self, database: str, table: str, part: str) -> int:
        return self._fs.getContentSummary(self._at(f"{self._folder(database, table)}/{part}")).getLength()

    def forget(self, database: str, table: str, part: str) -> None:
        self._fs.delete(self._at(f"{self._folder(database, table)}/{part}"), True)

    def drop(self, database: str, table: str | None = None) -> None:
        self._fs.delete(self._at(self._folder(database, table) if table else f"{self.path}/{database}"), True)

    # -- the pointer ----------------------------------------------------------------------------

    def tables(self, database: str) -> dict[str, Parts]:
        """What the pointer names; nothing if there is none."""
        at = self._at(f"{self.path}/{database}/CURRENT")
        if not self.durable or not self._fs.exists(at):
            return {}
        stream = self._fs.open(at)
        try:
            return {t: tuple(p) for t, p in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).items()}
        finally:
            stream.close()

    def point(self, database: str, tables: dict[str, Parts]) -> None:
        """Replace the pointer, then delete the parts that neither it nor the one before names."""
        if not self.durable or (before := self.tables(database)) == tables:
            return
        draft = self._at(f"{self.path}/{database}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, self._at(f"{self.path}/{database}/CURRENT"), over)
        for t in tables:
            named, folder = {*tables[t], *before.get(t, ())}, self._at(self._folder(database, t))
            for x in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                if x.getPath().getName() not in named:
                    self._fs.delete(x.getPath(), True)


def parquet_table(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files or folders as rows for ``Engine.create_table`` (an extension: the engine's own tables are parts)."""
    return spark.read.parquet(*paths)
