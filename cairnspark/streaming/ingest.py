"""Structured Streaming forms of record ingest.

The gate against late and early records compares with the time of ingest, both ways, so it is a filter and no
watermark. Superseding is a keyed maximum over the whole quality tuple, whose state is one row for each key; the same record
twice changes nothing. Holder sets keep the best of each (chunk, holder), and bounds are applied when they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..constants import MAX_HOLDERS, RECORD_TTL_MS
from ..functions.timing import within_skew
from ..operators.records import superseded


def source(spark: SparkSession, path: str, schema: StructType, files: int = 1000) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timely(records: DataFrame, ts: str = "ts", ingest: str = "ingest_ts") -> DataFrame:
    return records.where(within_skew(F.col(ts), F.col(ingest)))


def latest(records: DataFrame, keys: list[str], quality: list[str]) -> DataFrame:
    """For each key its best record so far; for the update or complete mode."""
    return superseded(records, keys, quality)


def holder_leases(leases: DataFrame) -> DataFrame:
    """The best lease of each (chunk, holder) so far; ``records.merge_holders`` bounds what is read from it."""
    return superseded(leases, ["chunk", "holder"], ["expires_at"])


def bounded_holders(leases: DataFrame, bound: int = MAX_HOLDERS) -> DataFrame:
    """(chunk, holder, expires_at) as a changelog: the state of a chunk is at most ``bound`` holders, and every batch that
    touches a chunk emits its set."""

    def merge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
        for part in parts:
            for holder, expires in zip(part["holder"].tolist(), part["expires_at"].tolist(), strict=True):
                held[holder] = max(held.get(holder, expires), expires)
            held = dict(sorted(held.items(), key=lambda x: (x[1], x[0]), reverse=True)[:bound])
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"chunk": [key[0]] * len(held), "holder": list(held), "expires_at": list(held.values())})

    rows = leases.select(F.col("chunk").cast("long"), F.col("holder").cast("long"), F.col("expires_at").cast("long"))
    return rows.groupBy("chunk").applyInPandasWithState(merge, "chunk long, holder long, expires_at long", "holders array<long>, expiries array<long>", "append", GroupStateTimeout.NoTimeout)


def expiring(records: DataFrame, ttl_ms: int = RECORD_TTL_MS) -> DataFrame:
    """(key, event, at): a record is stored when it comes, refreshed by later ones, and expires when none came for the time to
    live; timers run on event time, for which ``records`` (key, at timestamp) bring a watermark."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "event": ["expired"], "at": [at + ttl_ms]})
            return
        newest = max(int(p["ms"].max()) for p in parts)
        known = state.exists
        if known:
            newest = max(newest, state.get[0])
        state.update((newest,))
        if newest + ttl_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(newest + ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "event": ["refreshed" if known else "stored"], "at": [newest]})

    rows = records.select(F.col("key").cast("long").alias("key"), "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, event string, at long", "at long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over all that is there and gives the table it has written below ``folder``: in complete mode the last
    batch, in append mode all of them. A batch that is run again replaces its own files."""
    complete, schema = mode == "complete", df.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch-{0 if complete else epoch}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")


def upsert_into(table_path: str, keys: list[str], quality: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges each batch into a Parquet table by quality. A version is a folder; the last one counts, so
    that a batch that is run again gives the same version again."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        best = superseded(batch, keys, quality)
        if epoch:
            best = superseded(best.unionByName(spark.read.schema(batch.schema).parquet(f"{table_path}/v{epoch - 1}")), keys, quality)
        best.write.mode("overwrite").parquet(f"{table_path}/v{epoch}")

    return run


def start(df: DataFrame, into: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """The maintenance rhythm: a batch each ``every``."""
    return df.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
