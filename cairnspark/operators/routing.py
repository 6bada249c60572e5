"""Routing by XOR distance: nearest nodes, buckets, iterative lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALPHA, STALE_SECONDS, K
from ..functions.ids import bucket_index, distance
from ..functions.timing import stale

#: Bits of an id that are told apart as a prefix, at most.
PREFIX = 62


def _prefix(id_: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an id given as words, as a number."""
    top = F.shiftleft(F.get(id_, F.lit(0)), 30) + F.shiftright(F.get(id_, F.lit(1)), 2)
    return F.call_function("shiftright", top, (F.lit(PREFIX) - bits).cast("int"))


def nearest(targets: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(target, node, rank, distance): the ``k`` nodes nearest to each target; both bring ``id`` as words. Nodes that share
    a longer prefix with a target are nearer than all others, so the k nearest are among those of the longest prefix of
    the target's id that k nodes have: counts of nodes by prefix tell its length, and one equi-join fetches its nodes,
    which are about 2 k where ids are hashes."""
    count = nodes.count()
    longest = min(PREFIX, max(count, 2).bit_length())
    at = F.explode(F.sequence(F.lit(0), F.lit(longest))).alias("bits")
    by_prefix = nodes.select("id", at).select("bits", _prefix(F.col("id"), F.col("bits")).alias("prefix"))
    enough = by_prefix.groupBy("bits", "prefix").agg(F.count("*").alias("n")).where((F.col("n") >= k) | (F.col("bits") == 0))
    asked = targets.select("target", F.col("id").alias("tid"), at).withColumn("prefix", _prefix(F.col("tid"), F.col("bits")))
    deep = asked.join(enough.select("bits", "prefix"), ["bits", "prefix"]).groupBy("target", "tid").agg(F.max("bits").alias("bits"))
    deep = deep.withColumn("prefix", _prefix(F.col("tid"), F.col("bits")))
    held = nodes.select("node", F.col("id").alias("nid"), at).withColumn("prefix", _prefix(F.col("nid"), F.col("bits")))
    pairs = deep.join(held, ["bits", "prefix"]).select("target", "node", distance(F.col("tid"), F.col("nid")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("distance", "node"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("target", "node", "rank", "distance")


def buckets(nodes: DataFrame, local: Column) -> DataFrame:
    """Nodes with the ``bucket`` they fall into for a local id; the local node itself has none."""
    return nodes.withColumn("bucket", bucket_index(F.col("id"), local)).where("bucket IS NOT NULL")


def histogram(nodes: DataFrame, local: Column) -> DataFrame:
    return buckets(nodes, local).groupBy("bucket").agg(F.count("*").alias("nodes"))


def resident(sightings: DataFrame, size: int = K) -> DataFrame:
    """(bucket, node, first_seen, last_seen, resident): without evictions the first ``size`` distinct nodes of a bucket stay,
    later ones wait in the replacement list."""
    seen = sightings.groupBy("bucket", "node").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("first_seen", "node"))
    return seen.withColumn("resident", rank <= size)


def without_stale(entries: DataFrame, as_of: Column, timeout: int = STALE_SECONDS) -> DataFrame:
    return entries.where(~stale(F.col("last_seen"), as_of, timeout))


def replay(sightings: DataFrame, size: int = K) -> DataFrame:
    """(bucket, node, place, kind): exact state of each bucket after its sightings in order. A known node moves to the end, a
    new one enters if there is room, else it goes to the end of the replacement list, whose first one is dropped when
    full. A bucket's state is at most ``2 * size`` nodes; sightings are sorted by the shuffle and read as a stream."""
    import pyarrow as pa

    def run(batches):
        bucket, nodes, spare = None, {}, {}

        def state():
            rows = [(bucket, n, i, kind) for kind, held in (("node", nodes), ("replacement", spare)) for i, n in enumerate(held)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["bucket", "node", "place", "kind"])

        for batch in batches:
            for b, n in zip(batch.column("bucket").to_pylist(), batch.column("node").to_pylist(), strict=True):
                if b != bucket:
                    yield from state()
                    bucket, nodes, spare = b, {}, {}
                if n in nodes or len(nodes) < size:
                    nodes.pop(n, None)
                    nodes[n] = True
                else:
                    spare.pop(n, None)
                    if len(spare) >= size:
                        del spare[next(iter(spare))]
                    spare[n] = True
        yield from state()

    rows = sightings.select(F.col("bucket").cast("long"), F.col("node").cast("long"), "seen_at").repartition("bucket").sortWithinPartitions("bucket", "seen_at", "node")
    return rows.mapInArrow(run, "bucket long, node long, place long, kind string")


# Maintenance of bucket tables (bucket, node, place, kind, last_seen, failures), ``kind`` being "node" or "replacement" and
# ``place`` the order within a kind, least recently seen first.


def _placed(entries: DataFrame, *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("bucket", "kind").orderBy(*order)) - 1
    return entries.withColumn("place", place.cast("int")).select("bucket", "node", "place", "kind", "last_seen", "failures")


def get(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """The entries of asked nodes (bucket, node); those that only wait as replacements are not found."""
    return asked.select("bucket", "node").distinct().join(entries.where("kind = 'node'"), ["bucket", "node"])


def touch(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes that answered (bucket, node, seen_at): the time is the latest, failures are forgotten, the place stays."""
    last = seen.groupBy("bucket", "node").agg(F.max("seen_at").alias("_at"))
    hit = F.col("_at").isNotNull() & (F.col("kind") == "node")
    out = entries.join(last, ["bucket", "node"], "left")
    out = out.withColumn("last_seen", F.when(hit, F.greatest("last_seen", "_at")).otherwise(F.col("last_seen"))).withColumn("failures", F.when(hit, 0).otherwise(F.col("failures")))
    return out.select("bucket", "node", "place", "kind", "last_seen", "failures")


def record_failures(entries: DataFrame, failed: DataFrame) -> DataFrame:
    """Adds one to ``failures`` of a node for each row of ``failed`` (bucket, node)."""
    more = failed.groupBy("bucket", "node").agg(F.count("*").alias("_n"))
    n = F.when(F.col("kind") == "node", F.coalesce("_n", F.lit(0))).otherwise(0)
    return entries.join(more, ["bucket", "node"], "left").withColumn("failures", F.col("failures") + n).select("bucket", "node", "place", "kind", "last_seen", "failures")


def remove(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the nodes of ``gone`` (bucket, node), looked up among the nodes as they stood; for each one that goes, the
    first replacement moves in, behind the nodes that are there."""
    marked = entries.join(gone.select("bucket", "node", F.lit(True).alias("_gone")).distinct(), ["bucket", "node"], "left")
    goes = F.col("_gone").isNotNull() & (F.col("kind") == "node")
    marked = marked.withColumn("_left", F.count_if(goes).over(Window.partitionBy("bucket"))).where(~goes)
    return _promoted(marked, (F.col("kind") == "replacement") & (F.col("place") < F.col("_left")))


def evict_stale(entries: DataFrame, as_of: Column, size: int = K, timeout: int = STALE_SECONDS) -> DataFrame:
    """Without stale nodes; replacements are taken in order until the bucket is full: fresh ones move in, stale ones that
    are met on the way go, those behind stay as they are."""
    w = Window.partitionBy("bucket")
    old, waits = stale(F.col("last_seen"), as_of, timeout), F.col("kind") == "replacement"
    kept = entries.withColumn("_old", old).where(waits | ~F.col("_old"))
    kept = kept.withColumn("_room", size - F.count_if(~waits).over(w))
    before = F.count_if(waits & ~F.col("_old")).over(w.orderBy("kind", "place").rowsBetween(Window.unboundedPreceding, -1))
    taken = waits & (before < F.col("_room"))
    return _promoted(kept.withColumn("_taken", taken).where(~(F.col("_taken") & F.col("_old"))), F.col("_taken"))


def _promoted(entries: DataFrame, which: Column) -> DataFrame:
    """With chosen replacements as nodes, behind the others."""
    moved = entries.withColumn("_was", F.col("kind")).withColumn("kind", F.when(which, "node").otherwise(F.col("kind")))
    return _placed(moved, "_was", "place")


def bucket_stats(entries: DataFrame, size: int = K) -> DataFrame:
    """(bucket, nodes, replacements, is_full, stalest): ``stalest`` is the first to be asked whether it still answers."""
    live = F.col("kind") == "node"
    out = entries.groupBy("bucket").agg(F.count_if(live).alias("nodes"), F.count_if(~live).alias("replacements"), F.min_by("node", F.when(live, F.col("place"))).alias("stalest"))
    return out.select("bucket", "nodes", "replacements", (F.col("nodes") >= size).alias("is_full"), "stalest")


def lookup(target: DataFrame, known: DataFrame, neighbours: DataFrame, k: int = K, alpha: int = ALPHA) -> DataFrame:
    """(node, rank): iterative lookup of one target. Starting from ``known`` (node, id), each round asks the ``alpha`` nearest
    that have not been asked for their ``neighbours`` (node, neighbour, neighbour_id) and keeps the k nearest of all; it
    ends when all of those have been asked. Only the frontier of at most k nodes is on the driver."""
    spark = target.sparkSession
    goal = F.lit(target.first()["id"])

    def frontier(df: DataFrame) -> list:
        return df.dropDuplicates(["node"]).withColumn("d", distance(F.col("id"), goal)).orderBy("d", "node").limit(k).select("node", "id").collect()

    front, asked = frontier(known), set()
    while batch := [r["node"] for r in front if r["node"] not in asked][:alpha]:
        asked.update(batch)
        found = neighbours.where(F.col("node").isin(batch)).select(F.col("neighbour").alias("node"), F.col("neighbour_id").alias("id"))
        front = frontier(spark.createDataFrame(front, known.select("node", "id").schema).unionByName(found))
    return spark.createDataFrame([(r["node"], i + 1) for i, r in enumerate(front)], f"node {known.schema['node'].dataType.simpleString()}, rank int")
