"""The test tables as relations of the engine. Each adapter comes with the same relation in SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY_MS
from ..functions.ids import words
from ..functions.timing import millis

#: The moment at which everything is judged.
AS_OF = int(datetime(1997, 6, 1, tzinfo=timezone.utc).timestamp() * 1000)
EVENTS_AS_OF = int(datetime(2024, 1, 16, tzinfo=timezone.utc).timestamp() * 1000)
NETWORK_KEY = b"\x42" * 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, holder, issued_at, expires_at): an order's lines are leases of suppliers, a month for each piece."""
    issued = millis(F.col("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("holder"), issued.alias("issued_at"), (issued + F.col("l_quantity").cast("long") * 30 * DAY_MS).alias("expires_at"))


LEASES = f"(SELECT l_orderkey AS chunk, l_suppkey AS holder, (epoch_us(l_shipdate) // 1000) AS issued_at, (epoch_us(l_shipdate) // 1000) + CAST(l_quantity AS BIGINT) * {30 * DAY_MS} AS expires_at FROM lineitem)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"))


CATALOGUE = "(SELECT DISTINCT o_orderkey AS chunk FROM orders)"


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders are held more often, those of low priority less."""
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    return table(spark, sf_dir, "orders").where(urgent | low).select(F.col("o_orderkey").alias("chunk"), F.when(urgent, 5).otherwise(2).alias("min_replicas"), F.when(urgent, 4).otherwise(1).alias("repair_threshold")).distinct()


POLICY = "(SELECT DISTINCT o_orderkey AS chunk, CASE WHEN o_orderpriority = '1-URGENT' THEN 5 ELSE 2 END AS min_replicas, CASE WHEN o_orderpriority = '1-URGENT' THEN 4 ELSE 1 END AS repair_threshold FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))"


def node_id(key: Column) -> Column:
    """32 bytes from a key."""
    return F.unhex(F.sha2(key.cast("string").cast("binary"), 256))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, id): suppliers, with their id as words."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), words(node_id(F.col("s_suppkey"))).alias("id"))


def id_words(key: str) -> str:
    """The same in SQL: eight numbers of 32 bits."""
    return "[" + ", ".join(f"CAST('0x' || substr(sha256(CAST({key} AS VARCHAR)), {8 * i + 1}, 8) AS BIGINT)" for i in range(8)) + "]"


def xor_words(a: str, b: str) -> str:
    return "[" + ", ".join(f"xor({a}[{i + 1}], {b}[{i + 1}])" for i in range(8)) + "]"


NODES = f"(SELECT s_suppkey AS node, {id_words('s_suppkey')} AS id FROM supplier)"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object, revision, content_root, created_at, modified_at, origin, seq): a customer's orders are revisions."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    at = millis(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("object"), (F.row_number().over(w) - 1).cast("long").alias("revision"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("content_root"),
        F.min(at).over(Window.partitionBy("o_custkey")).alias("created_at"), at.alias("modified_at"), F.col("o_custkey").alias("origin"), F.col("o_orderkey").alias("seq"),
    )


MANIFESTS = "(SELECT o_custkey AS object, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS revision, sha256(CAST(o_orderkey AS VARCHAR)) AS content_root, min((epoch_us(o_orderdate) // 1000)) OVER (PARTITION BY o_custkey) AS created_at, (epoch_us(o_orderdate) // 1000) AS modified_at, o_custkey AS origin, o_orderkey AS seq FROM orders)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, key, kind, ts, stored_at, body): events as records; they are stored up to ten minutes after or before their
    own time stamp."""
    e = table(spark, sf_dir, "events")
    ts = millis(F.col("ts"))
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    return e.select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), ts.alias("ts"), (ts + (F.col("event_id") % 21 - 10) * 60_000).alias("stored_at"), body.alias("body"), F.col("value"))


RECORDS = "(SELECT event_id, user_id AS key, event_type AS kind, (epoch_us(ts) // 1000) AS ts, (epoch_us(ts) // 1000) + (event_id % 21 - 10) * 60000 AS stored_at, concat_ws('|', CAST(event_id AS VARCHAR), event_type, props) AS body, value FROM events)"


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inode, parent, name, kind, size, pos): the world as a tree of regions, nations and customers."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    root = spark.range(1).select(F.lit(1).cast("long").alias("inode"), F.lit(1).cast("long").alias("parent"), F.lit("").alias("name"), F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("pos"))
    row = lambda df, i, p, name, kind, size, pos: df.select(i.cast("long").alias("inode"), p.cast("long").alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), size.cast("long").alias("size"), pos.cast("long").alias("pos"))
    zero = F.lit(0)
    regions = row(r, F.col("r_regionkey") + 100, F.lit(1), F.col("r_name"), "directory", zero, F.col("r_regionkey"))
    nations = row(n, F.col("n_nationkey") + 200, F.col("n_regionkey") + 100, F.col("n_name"), "directory", zero, F.col("n_nationkey"))
    files = row(c, F.col("c_custkey") + 1000, F.col("c_nationkey") + 200, F.col("c_name"), "file", F.abs(F.floor("c_acctbal")), F.col("c_custkey"))
    return root.unionByName(regions).unionByName(nations).unionByName(files)


INODES = """(SELECT CAST(1 AS BIGINT) AS inode, CAST(1 AS BIGINT) AS parent, '' AS name, 'directory' AS kind, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS pos
UNION ALL SELECT r_regionkey + 100, 1, r_name, 'directory', 0, r_regionkey FROM region
UNION ALL SELECT n_nationkey + 200, n_regionkey + 100, n_name, 'directory', 0, n_nationkey FROM nation
UNION ALL SELECT c_custkey + 1000, c_nationkey + 200, c_name, 'file', CAST(abs(floor(c_acctbal)) AS BIGINT), c_custkey FROM customer)"""


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cache, seq, item, bytes): each user has a cache of what they touch."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cache"), F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 13).alias("item"), (100 + F.col("event_id") * 7919 % 13 * 10).alias("bytes"))


ACCESSES = "(SELECT user_id AS cache, event_id AS seq, event_id * 7919 % 13 AS item, 100 + event_id * 7919 % 13 * 10 AS bytes FROM events)"


def connection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("event_id") % 11 == 0, "Connected").when(F.col("event_id") % 11 == 1, "Disconnected").when(F.col("event_id") % 2 == 0, "sent").otherwise("received")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("connection"), millis(F.col("ts")).alias("ts"), event.alias("event"), F.octet_length("props").cast("long").alias("bytes"))


CONNECTION_LOG = "(SELECT user_id AS connection, (epoch_us(ts) // 1000) AS ts, CASE WHEN event_id % 11 = 0 THEN 'Connected' WHEN event_id % 11 = 1 THEN 'Disconnected' WHEN event_id % 2 = 0 THEN 'sent' ELSE 'received' END AS event, CAST(strlen(props) AS BIGINT) AS bytes FROM events)"
