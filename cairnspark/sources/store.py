"""Stores as Parquet tables in a folder: chunks, tree nodes, blob metadata and manifest history.

Appends are anti-joined with what is there, so that putting twice is the same as once; deletes write the rest to a new
folder of the table and then move the pointer that readers follow, by a rename that replaces it in one step; stores whose
rename is a copy (some object stores) do not give that.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import CACHE_BYTES, DISK_BYTES
from ..functions.ids import sha256_id


@dataclass(frozen=True)
class Layout:
    """Folders of the stores, and the sizes of caches."""

    root: str
    memory_bytes: int = CACHE_BYTES
    disk_bytes: int = DISK_BYTES

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    @property
    def chunks(self) -> str:
        return self.path("chunks")

    @property
    def nodes(self) -> str:
        return self.path("nodes")

    @property
    def metadata(self) -> str:
        return self.path("metadata")

    @property
    def manifests(self) -> str:
        return self.path("manifests")


class KeyedTable:
    """Rows by key columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        """The folder that the pointer names."""
        pointer = self._jvm.Path(f"{self.path}/_current")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _point(self, folder: str) -> None:
        """Moves the pointer in one step."""
        new = self._jvm.Path(f"{self.path}/_{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray(folder.encode()))
        out.close()
        context = self._jvm.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 1)
        how[0] = self._jvm.Options.Rename.valueOf("OVERWRITE")
        context.rename(new, self._jvm.Path(f"{self.path}/_current"), how)

    def read(self) -> DataFrame:
        folder = self._current()
        if folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")

    def put(self, rows: DataFrame) -> None:
        """Adds the rows whose key is not there yet."""
        new = rows.select(self.schema.fieldNames()).dropDuplicates(self.keys)
        folder = self._current() or uuid.uuid4().hex
        new.join(self.read().select(self.keys), self.keys, "left_anti").write.mode("append").parquet(f"{self.path}/{folder}")
        if self._current() is None:
            self._point(folder)

    def replace(self, rows: DataFrame) -> None:
        """Makes ``rows`` the whole table: they are written to a folder of their own, then the pointer moves. The folder
        before stays for those who read it, until the next time."""
        old, new = self._current(), uuid.uuid4().hex
        rows.select(self.schema.fieldNames()).write.parquet(f"{self.path}/{new}")
        self._point(new)
        for entry in self._fs.listStatus(self._jvm.Path(self.path)):
            if entry.isDirectory() and entry.getPath().getName() not in (old, new):
                self._fs.delete(entry.getPath(), True)

    def delete(self, gone: DataFrame) -> None:
        """Removes the rows of the given keys; keys that are not there do no harm."""
        self.replace(self.read().join(gone.select(self.keys), self.keys, "left_anti"))

    def contains(self, asked: DataFrame) -> DataFrame:
        """The asked keys with ``found``."""
        return asked.select(self.keys).join(self.read().select(*self.keys, F.lit(True).alias("found")), self.keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def get(self, **key: object) -> DataFrame:
        """A point look-up; the predicates reach the Parquet scan."""
        out = self.read()
        for name, value in key.items():
            out = out.where(F.col(name) == F.lit(value))
        return out

    def keys_in_order(self) -> DataFrame:
        return self.read().select(self.keys).orderBy(self.keys)


CHUNKS = "ciphertext_hash binary, stored binary"
NODES = "ref binary, kind int, node binary"
METADATA = "blob_id binary, root binary, size bigint, chunk_count int"
MANIFESTS = "object binary, revision bigint, content_root binary, created_at bigint, modified_at bigint, origin binary, signature binary"


class ChunkStore(KeyedTable):
    def __init__(self, spark: SparkSession, layout: Layout):
        super().__init__(spark, layout.chunks, CHUNKS, ["ciphertext_hash"])

    def put_bytes(self, rows: DataFrame, stored: str = "stored") -> None:
        self.put(rows.select(sha256_id(F.col(stored)).alias("ciphertext_hash"), F.col(stored).alias("stored")))

    def checked(self) -> DataFrame:
        """All chunks; one whose bytes do not hash to its key is an error."""
        fault = sha256_id(F.col("stored")) != F.col("ciphertext_hash")
        return self.read().withColumn("stored", F.when(fault, F.raise_error(F.lit("stored bytes differ")).cast("binary")).otherwise(F.col("stored")))

    def stats(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("stored")), F.lit(0)).alias("bytes"))


def node_table(spark: SparkSession, layout: Layout) -> KeyedTable:
    return KeyedTable(spark, layout.nodes, NODES, ["ref"])


def metadata_table(spark: SparkSession, layout: Layout) -> KeyedTable:
    return KeyedTable(spark, layout.metadata, METADATA, ["blob_id"])


def manifest_table(spark: SparkSession, layout: Layout) -> KeyedTable:
    return KeyedTable(spark, layout.manifests, MANIFESTS, ["object", "revision"])


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, data) of files, for ingest."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))
