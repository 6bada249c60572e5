"""Cache analysis: exact replay of a least-recently-used cache, totals, and access patterns."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CACHE_BYTES


def replay(accesses: DataFrame, capacity: int = CACHE_BYTES) -> DataFrame:
    """(cache, hits, misses, evictions, bytes_cached, held_entries, held_bytes) of accesses (cache, seq, item, bytes): a miss
    puts the item, evicting the least recently used until it fits; an item beyond the capacity goes in all the same.
    Caches are independent; each is replayed as a sorted stream whose state is what the cache holds."""
    names = ["cache", "hits", "misses", "evictions", "bytes_cached", "held_entries", "held_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, used, n = None, OrderedDict(), 0, [0, 0, 0, 0]

        def done() -> Iterator[pa.RecordBatch]:
            if cache is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (cache, *n, len(held), used)], names)

        for batch in batches:
            for c, item, size in zip(*[batch.column(x).to_pylist() for x in ("cache", "item", "bytes")], strict=True):
                if c != cache:
                    yield from done()
                    cache, held, used, n = c, OrderedDict(), 0, [0, 0, 0, 0]
                if item in held:
                    held.move_to_end(item)
                    n[0] += 1
                    continue
                n[1] += 1
                while held and used + size > capacity:
                    used -= held.popitem(last=False)[1]
                    n[2] += 1
                held[item] = size
                used += size
                n[3] += size
        yield from done()

    rows = accesses.select(F.col("cache").cast("long"), "seq", F.col("item").cast("long"), F.col("bytes").cast("long")).repartition("cache").sortWithinPartitions("cache", "seq")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def totals(replayed: DataFrame) -> DataFrame:
    return replayed.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "misses", "evictions", "bytes_cached")])


def sequential(accesses: DataFrame, depth: int = 8, least: int = 2) -> DataFrame:
    """Accesses with ``history``, how many of the last ``depth`` are known, and ``is_sequential``, once there are ``least``."""
    w = Window.partitionBy("cache").orderBy("seq").rowsBetween(-(depth - 1), 0)
    return accesses.withColumn("history", F.count("*").over(w)).withColumn("is_sequential", F.col("history") >= least)


def history(accesses: DataFrame, depth: int = 8) -> DataFrame:
    """Accesses with ``recent``, the items of the last ``depth``, oldest first, this one included."""
    w = Window.partitionBy("cache").orderBy("seq").rowsBetween(-(depth - 1), 0)
    return accesses.withColumn("recent", F.collect_list("item").over(w))


def recency(accesses: DataFrame) -> DataFrame:
    """(cache, item, last_seq, rank): least recently used first."""
    last = accesses.groupBy("cache", "item").agg(F.max("seq").alias("last_seq"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("cache").orderBy("last_seq", "item")))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses))
