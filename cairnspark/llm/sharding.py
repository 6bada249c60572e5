"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Compaction sorts the shards by size into tiers, each a factor
``FAN`` wider than the one below, and merges the shards of a tier, in runs of neighbouring sizes, into one file each
that reaches at most about the target size; shards of the target size are left alone. Every append and every
compaction commits a new version of the manifest, which lists the live shards; readers see a version as a whole.

A version's manifest names lists of shards, those of small and those of full ones. A commit adds lists or replaces those
of small shards; lists of full shards are never read again but to read the rows, so the cost of a commit and what compaction
holds on the driver grow with the small shards alone. A reader passes the paths of its version to Spark, whose own index
of files is on the driver as well.

A manifest is written under a name of its own and then renamed to its version, which fails if that version exists: of
two writers one loses and tries again on the other's version. The file system must rename in one step, as HDFS and local
ones do; on an object store that copies instead, two writers at once could both believe they made a version. Data files are
written before the commit and never changed, so that a lost executor or writer leaves at most files that no manifest
lists. Shards of old versions stay until ``vacuum``.

Merging reads each run into one task without a shuffle; rows never pass the driver, only the list of files does.
Rows come through as they are: nulls (ids too), repeated rows, very long texts and all columns, whatever their names. An
empty table gives an empty version.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import setting, shared_folder

#: Bytes of a full shard and of the lowest tier, ratio of tiers, least shards that are merged, rows of an arrival's
#: shard, runs that one job merges.
TARGET, LOWEST, FAN, LEAST, ARRIVAL_ROWS, JOB_RUNS = 64 << 20, 1 << 20, 4, 2, 4000, 64
#: Part of the target from which on a shard is full: it would merge with much smaller ones only.
FULL = 0.75


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int

    @property
    def tier(self) -> int:
        t, limit = 0, LOWEST
        while self.bytes >= limit:
            t, limit = t + 1, limit * FAN
        return t


class Store:
    """A folder with shards and manifests, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list:
        path = self._path(folder)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        return max((int(m[1]) for s in self._listed(f"{self.root}/_manifests") if (m := re.fullmatch(r"v(\d+)\.json", s.getPath().getName()))), default=0)

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        """The schema of a version and the names of its lists of small and of full shards."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "small": [], "full": []}
        return json.loads(self._text(f"{self.root}/_manifests/v{version}.json"))

    def _list(self, shards: list[Shard]) -> list[str]:
        """The name of a new list of shards; none if it is empty."""
        if not shards:
            return []
        name = uuid.uuid4().hex
        self._put(f"{self.root}/_manifests/lists/{name}.json", json.dumps([asdict(s) for s in shards]))
        return [name]

    def _listed_shards(self, names: list[str]) -> list[Shard]:
        return [Shard(**s) for name in names for s in json.loads(self._text(f"{self.root}/_manifests/lists/{name}.json"))]

    def shards(self, version: int | None = None) -> list[Shard]:
        now = self.manifest(version)
        return self._listed_shards(now["small"] + now["full"])

    def commit(self, base: int, schema: str, small: list[str], full: list[str]) -> bool:
        """Makes version ``base + 1`` of these lists; false if another writer has made it."""
        kept, new = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/_manifests/v{base + 1}.json")
        self._put(kept.toString(), json.dumps({"version": base + 1, "schema": schema, "small": small, "full": full}))
        try:
            if self._fs.exists(new):
                return False
            jvm = self.spark.sparkContext._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(kept, new, none)
            return True
        finally:
            self._fs.delete(kept, False)

    def _sorted(self, shards: list[Shard]) -> tuple[list[str], list[str]]:
        """New lists of the small and of the full ones."""
        full = self.target * FULL
        return self._list([s for s in shards if s.bytes < full]), self._list([s for s in shards if s.bytes >= full])

    def _written(self, df: DataFrame, rows: int = 0) -> list[Shard]:
        """Shards of ``df`` in a folder of their own."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(folder)
        files = [(s.getPath().getName(), s.getLen()) for s in self._listed(folder)]
        return [Shard(f"{folder.removeprefix(self.root)}/{name}", size) for name, size in sorted(files) if name.endswith(".parquet")]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Adds the rows as small shards; gives the version."""
        small, full = self._sorted(self._written(df, rows))
        while True:
            now = self.manifest()
            if self.commit(now["version"], df.schema.json(), now["small"] + small, now["full"] + full):
                return now["version"] + 1

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """What to merge: shards of one tier in order of size, as many as fit the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
            if s.bytes < self.target * FULL:
                tiers.setdefault(s.tier, []).append(s)
        out = []
        for tier in tiers.values():
            run: list[Shard] = []
            for s in tier:
                if run and sum(x.bytes for x in run) + s.bytes > self.target:
                    out.append(run)
                    run = []
                run.append(s)
            out.append(run)
        return [r for r in out if len(r) >= LEAST]

    def compact(self) -> int:
        """Merges until no tier has shards to merge; every round is a version. Gives the latest one."""
        while True:
            now = self.manifest()
            runs = self.runs(self._listed_shards(now["small"]))
            if not runs:
                return now["version"]
            schema = self._schema(now)
            made: list[Shard] = []
            for at in range(0, len(runs), JOB_RUNS):
                merged = [self.spark.read.schema(schema).parquet(*[f"{self.root}{s.path}" for s in run]).coalesce(1) for run in runs[at : at + JOB_RUNS]]
                with setting(self.spark, "spark.sql.unionOutputPartitioning", "false"):  # else the runs' tasks become one
                    made += self._written(reduce(DataFrame.union, merged))
            gone = {s.path for run in runs for s in run}
            new_small, new_full = self._sorted(made)
            while True:  # another writer's append leaves the merged shards alone; a compaction does not
                now = self.manifest()
                live = self._listed_shards(now["small"])
                if not gone <= {s.path for s in live}:
                    break
                rest = self._list([s for s in live if s.path not in gone])
                if self.commit(now["version"], now["schema"], rest + new_small, now["full"] + new_full):
                    break

    @staticmethod
    def _schema(manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("no version has been committed")
        schema, paths = self._schema(now), [f"{self.root}{s.path}" for s in self._listed_shards(now["small"] + now["full"])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self) -> None:
        """Deletes the data files that the latest version does not list; earlier versions can no longer be read."""
        live = {s.path for s in self.shards()}
        for folder in self._listed(f"{self.root}/data"):
            name = folder.getPath().getName()
            for f in self._listed(f"{self.root}/data/{name}"):
                if f"/data/{name}/{f.getPath().getName()}" not in live:
                    self._fs.delete(f.getPath(), False)


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", root: str | None = None, target: int = TARGET) -> DataFrame:
    """(key, n_bytes, shard, version) for each row: appends the table to a new store, compacts it, and tells from the
    committed files where each row lies. Shards of the arrival are deleted once they are merged."""
    spark = df.sparkSession
    store = Store(spark, root or shared_folder(spark), target)
    store.append(df)
    version = store.compact()
    store.vacuum()
    # shards are numbered in the lists' order; there is an entry for each file, not for each row
    order = spark.createDataFrame([(s.path[1:], i) for i, s in enumerate(store.shards())], "path string, shard int")
    path = F.regexp_extract(F.input_file_name(), r"(data/[^/]+/[^/]+)$", 1)
    rows = store.read().select(F.col(key).alias("key"), F.octet_length(F.col(text).cast("string")).cast("long").alias("n_bytes"), path.alias("path"))
    return rows.join(order, "path").select(F.col("key").alias(key), "n_bytes", "shard", F.lit(version).cast("long").alias("version"))
