"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder of immutable Parquet shards and a chain of manifests. An append writes its rows as they
arrive, in small shards; compaction merges runs of similar size, a tier, into files of about the target size;
each of them ends with one atomic commit of the next manifest version. A version is a file that says which shards
come and which go; every WHOLE versions, and when older ones are deleted, a list of all shards is written beside it,
so that a commit costs what it changes and a reader follows few files. A commit creates a file that must not exist
yet and renames it into place, so of two writers one fails and starts again from the newer version. That rename is
atomic on a file system such as HDFS; an object store needs a file system layer that offers it. Readers see a
version whole or not at all; a task or executor lost midway leaves files that no manifest names, and the write is
done again.

Scale: merging needs no shuffle and one job a tier, however many shards it has. The scan packs the tier's files,
in order of size, into partitions of the target size, and each partition is written as one file by its own task. Rows
are never cut by key, so a hot key is no hot partition. The driver holds names and sizes of shards only. Every byte is
rewritten once for each tier it climbs; runs that together reach the target are merged in one step.

Rows come back as they are: nulls, empty and long texts, repeated rows, any columns under any names. Shards of equal
size are taken in order of their names. An empty append commits a version without rows, and an empty store reads as none.
"""

from __future__ import annotations

import json
import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 64 << 20
#: A tier spans sizes up to this factor, and is merged when it has so many runs.
FANOUT = 4
SMALLEST = 64 << 10
#: Versions between lists of all shards.
WHOLE = 16


class Conflict(Exception):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.schema, self.target, self.fanout = spark, path.rstrip("/"), schema, target_bytes, fanout
        self._jvm = spark._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- files and manifests --------------------------------------------------------------------

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _shards(self, folder: str = "") -> list[dict]:
        """The shards in a folder of the store, with their sizes; the executors list them."""
        at = f"{self.path}/data/{folder}".rstrip("/")
        if not self._fs.exists(self._at(at)):
            return []
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(at)
        top = self._at(f"{self.path}/data").toUri().getPath() + "/"  # with or without scheme and host, as the file system has it
        name = F.regexp_replace("path", "^.*?" + _quoted(top), "")
        found = files.select(name.alias("file"), "length").collect()
        return sorted(({"file": r.file, "bytes": r.length} for r in found), key=lambda x: x["file"])

    def _json(self, name: str):
        stream = self._fs.open(self._at(f"{self.path}/manifest/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, content: object) -> None:
        """A new file, by a rename that fails if it exists."""
        final, draft = (self._at(f"{self.path}/manifest/{x}") for x in (name, f".{uuid.uuid4().hex}.tmp"))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri())
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(draft, final, never)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"{name} exists") from e
            raise

    def _numbers(self, kind: str) -> list[int]:
        folder = self._at(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n[1:9]) for n in names if n.startswith(kind) and n.endswith(".json"))

    def versions(self) -> list[int]:
        return self._numbers("v")

    def manifest(self, version: int | None = None) -> dict:
        """The version and all its shards, by default of the last one; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        start = max((n for n in self._numbers("w") if n <= version), default=0)
        shards = {x["file"]: x for x in self._json(f"w{start:08d}.json")} if start else {}
        for n in range(start + 1, version + 1):
            change = self._json(f"v{n:08d}.json")
            for f in change["remove"]:
                del shards[f]
            shards |= {x["file"]: x for x in change["add"]}
        return {"version": version, "shards": list(shards.values())}

    def commit(self, base: dict, add: list[dict], remove: list[dict]) -> dict:
        """The next version: ``base`` without ``remove`` and with ``add``. Raises Conflict if that version exists."""
        gone, n = [x["file"] for x in remove], base["version"] + 1
        left = set(gone)
        new = {"version": n, "shards": [x for x in base["shards"] if x["file"] not in left] + add}
        self._put(f"v{n:08d}.json", {"add": add, "remove": gone})
        if n % WHOLE == 0:
            self._whole(new)
        return new

    def _whole(self, manifest: dict) -> None:
        """The list of a version's shards; whoever writes it writes the same."""
        try:
            self._put(f"w{manifest['version']:08d}.json", manifest["shards"])
        except Conflict:
            return

    # -- operations -----------------------------------------------------------------------------

    def append(self, rows: DataFrame, arrival: Column | None = None) -> list[dict]:
        """Write rows as small shards and commit them; with ``arrival``, one commit for each of its values, in order."""
        folder, names = uuid.uuid4().hex, [f.name for f in self.schema]
        columns = [F.col("`" + n.replace("`", "``") + "`") for n in names]
        if arrival is None:
            rows.select(*columns).write.parquet(f"{self.path}/data/{folder}")
            parts = {"": self._shards(folder)}
        else:
            by = "arrival"
            while by in (n.lower() for n in names):
                by += "_"
            rows.select(*columns, arrival.alias(by)).write.partitionBy(by).parquet(f"{self.path}/data/{folder}")
            parts = {}
            for x in self._shards(folder):
                parts.setdefault(os.path.dirname(x["file"]), []).append(x)
        return [self._retry(lambda base, x=x: self.commit(base, x, [])) for _, x in sorted(parts.items())]

    def _retry(self, change):
        for _ in range(100):
            try:
                return change(self.manifest())
            except Conflict:
                continue
        raise Conflict("other writers were faster a hundred times")

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """The tiers that have enough runs to be merged, smallest first."""
        tiers: dict[int, list[dict]] = {}
        for x in shards:
            if x["bytes"] * 2 <= self.target:  # larger ones are done
                tiers.setdefault(int(math.log(max(x["bytes"], SMALLEST) / SMALLEST, self.fanout)), []).append(x)
        return [sorted(runs, key=lambda x: (x["bytes"], x["file"])) for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout]

    def compact(self) -> dict:
        """Merge until no tier has enough runs; one job and one commit a tier. Merged shards stay until ``vacuum``.

        Each job writes fewer files than it reads, so this ends.
        """
        base = self.manifest()
        while tiers := self.plan(base["shards"]):
            remove, folder = tiers[0], uuid.uuid4().hex
            self._merge(remove, f"{self.path}/data/{folder}")
            add = self._shards(folder)

            def swap(now: dict, add=add, remove=remove) -> dict:
                if not {x["file"] for x in remove} <= {x["file"] for x in now["shards"]}:
                    raise RuntimeError("a merged shard is gone: another compaction ran")
                return self.commit(now, add, remove)

            base = self._retry(swap)
        return base

    def _merge(self, shards: list[dict], to: str) -> None:
        """One job: the scan packs whole files into partitions of the target size, and each becomes one file.

        Where a session does not let its packing be set, smaller partitions are joined to files of two thirds of that size.
        """
        most = min(len(shards) - 1, math.ceil(1.5 * sum(x["bytes"] for x in shards) / self.target))
        packing = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in packing}
        for k, v in packing.items():
            self.spark.conf.set(k, v)
        try:
            self._open([x["file"] for x in shards]).coalesce(max(1, most)).write.parquet(to)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that none of the last ``keep`` versions names, and older manifests; how many shards went.

        Run it when no writer is busy: shards not yet committed look like those no longer named.
        """
        versions = self.versions()[-keep:]
        if not versions:
            return 0
        kept = [self.manifest(v) for v in versions]
        named = {x["file"] for m in kept for x in m["shards"]}
        self._whole(kept[0])
        used, folders = {os.path.dirname(f) for f in named}, {}
        for x in self._shards():
            folders.setdefault(os.path.dirname(x["file"]), []).append(x["file"])
        gone = 0
        for folder, files in folders.items():
            files = [f for f in files if f not in named]
            for f in files if folder in used else [folder]:  # a folder without named shards goes at once
                self._fs.delete(self._at(f"{self.path}/data/{f}"), True)
            gone += len(files)
        for kind in "vw":
            for n in self._numbers(kind):
                if n < versions[0]:
                    self._fs.delete(self._at(f"{self.path}/manifest/{kind}{n:08d}.json"), False)
        return gone

    def _open(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.manifest(version)["shards"]
        return self._open([x["file"] for x in shards]) if shards else self.spark.createDataFrame([], self.schema)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
