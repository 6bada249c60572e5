"""A repository of blobs and versioned objects in a folder: the commands a user gives, on tables.

Every method takes and gives DataFrames, so one call puts or gets any number of blobs; nothing of their content passes
through the driver. Tables are those of ``sources.store``; ``refs`` keeps which chunks make up a blob.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import URI_SCHEME
from .functions.uri import blob_uri
from .operators import blob, cdc, manifest
from .sources.store import ChunkStore, KeyedTable, Layout, manifest_table, metadata_table, node_table

REFS = "blob_id binary, ord int, offset bigint, size int, chunk_id binary, ciphertext_hash binary"


def new_object_uri() -> str:
    """The identifier of a new object, with a random id and capability secret."""
    part = lambda: secrets.token_urlsafe(32)
    return f"{URI_SCHEME}:obj:{part()}:{part()}"


class Repository:
    """``profile`` says how chunks are hashed and sealed, see ``operators.blob``."""

    def __init__(self, spark: SparkSession, root: str, profile: str = "builtin"):
        layout = Layout(root)
        self.spark, self.profile = spark, profile
        self.chunks, self.nodes, self.metadata, self.manifests = ChunkStore(spark, layout), node_table(spark, layout), metadata_table(spark, layout), manifest_table(spark, layout)
        self.refs = KeyedTable(spark, layout.path("refs"), REFS, ["blob_id", "ord"])

    def put(self, blobs: DataFrame, key: str, data: Column, sizes: cdc.Parameters = cdc.Parameters()) -> DataFrame:
        """Stores whole contents; (key, blob_id, size, uri) of each. Equal content is stored once, whoever brings it. Metadata
        is written last, so that a blob is there only when all of it is."""
        refs, ids = blob.ingest(cdc.chunks(blobs, key, data, sizes), blobs, key, data, self.profile)
        made = blob.dag(refs, ids, key, self.profile)
        self.chunks.put(blob.stored_chunks(refs))
        inner = made.where("chunk_count > 1").select(F.col("root").alias("ref"), F.lit(1).alias("kind"), "node")
        self.nodes.put(blob.node_rows(refs, self.profile).unionByName(inner))
        self.refs.put(refs.withColumn("size", F.col("size").cast("int")).withColumn("ord", F.col("ord").cast("int")))
        self.metadata.put(made.select("blob_id", "root", "size", "chunk_count"))
        return ids.select(key, "blob_id", F.col("blob_size").alias("size"), blob_uri(F.col("blob_id")).alias("uri"))

    def get(self, asked: DataFrame) -> DataFrame:
        """(blob_id, data) of asked blobs (blob_id) that are stored."""
        there = self.metadata.read().join(asked.select("blob_id").distinct(), "blob_id", "left_semi").select("blob_id")
        keyed = there.withColumn("_key", F.col("blob_id"))
        refs = self.refs.read().join(keyed, "blob_id")
        out = blob.read(refs, self.chunks.read(), "_key", self.profile, keyed)
        return out.select(F.col("_key").alias("blob_id"), "data")

    def info(self, asked: DataFrame) -> DataFrame:
        """(blob_id, root, size, chunk_count), nulls for what is not stored."""
        return asked.select("blob_id").distinct().join(self.metadata.read(), "blob_id", "left")

    def publish(self, rows: DataFrame) -> None:
        """Adds revisions of objects; one that is there already stays."""
        self.manifests.put(rows)

    def revisions(self, objects: DataFrame, most: int | None = None) -> DataFrame:
        """Revisions of the asked objects (object), newest first."""
        return manifest.listed(self.manifests.read().join(objects.select("object").distinct(), "object", "left_semi"), most)

    def read_objects(self, objects: DataFrame) -> DataFrame:
        """(object, data): the latest content of asked objects, through their trees."""
        roots = manifest.latest(self.manifests.read().join(objects.select("object").distinct(), "object", "left_semi"))
        p = blob.PROFILES[self.profile]
        owners = self.metadata.read().select(F.col("root").alias("content_root"), "blob_id")
        roots = roots.join(owners.dropDuplicates(["content_root"]), "content_root", "left")
        blob_id = F.when(F.col("blob_id").isNull(), F.raise_error(F.lit("an object's content is not stored")).cast("binary")).otherwise(F.col("blob_id"))
        names = roots.select("object", blob_id.alias("blob_id"), "content_root")
        got = blob.read_objects(names.select(F.col("blob_id").alias("object"), F.col("content_root").alias("root")).distinct(), self.nodes.read(), self.chunks.read(), p.open, p.hash)
        return names.join(got.withColumnRenamed("object", "blob_id"), "blob_id").select("object", "data")

    def status(self) -> DataFrame:
        """(name, rows, bytes) for chunks, blobs and objects; ``bytes`` as stored for chunks and as given for blobs."""
        row = lambda df, name, size: df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
        out = row(self.chunks.read(), "chunks", F.octet_length("stored"))
        return out.unionByName(row(self.metadata.read(), "blobs", F.col("size"))).unionByName(row(manifest.objects(self.manifests.read()), "objects", F.lit(0)))
