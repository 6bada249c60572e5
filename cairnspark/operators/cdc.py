"""Content-defined chunking.

A cut depends on the last bits of a rolling hash, so only on the last few bytes: with a mask of w bits the hash at a
byte is a sum over w bytes. All sums of a text are computed at once in numpy (w shifted additions), and the cuts are
found by searching the positions where a mask is met. Near the start of a search the hash has seen fewer than w bytes;
what the sum has too much there is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import gear_table
from ..functions.ids import sha256_id


@dataclass(frozen=True)
class Parameters:
    """Least, target and greatest size of a chunk, and the bits of the mask before and from the target on."""

    least: int = 64 << 10
    target: int = 256 << 10
    most: int = 1 << 20
    strict: int = 19
    loose: int = 17


#: For short texts.
SMALL = Parameters(256, 1024, 4096, 11, 9)


def _sums(data: np.ndarray, bits: int) -> np.ndarray:
    """The hash over the last ``bits`` bytes (fewer at the front), low ``bits`` bits."""
    mask = np.uint64((1 << bits) - 1)
    gear = gear_table() & mask
    values = gear[data]
    out = values.copy()
    for k in range(1, min(bits, len(data))):
        out[k:] += values[:-k] << np.uint64(k)
    return out & mask


def _first(start: int, stop: int, origin: int, sums: np.ndarray, zero: np.ndarray, bits: int) -> int:
    """First position in [start, stop) at which the hash begun at ``origin`` is 0 under the mask; -1 if none."""
    warm = min(stop, origin + bits - 1)
    before = int(sums[origin - 1]) if origin else 0
    mask = (1 << bits) - 1
    for i in range(start, warm):
        if (int(sums[i]) - (before << (i - origin + 1))) & mask == 0:
            return i
    at = np.searchsorted(zero, max(start, warm))
    return int(zero[at]) if at < len(zero) and zero[at] < stop else -1


def boundaries(data: bytes, p: Parameters = Parameters()) -> list[int]:
    """End-exclusive cut positions after a leading 0."""
    n = len(data)
    if not n:
        return [0]
    flat = np.frombuffer(data, np.uint8)
    strict, loose = _sums(flat, p.strict), _sums(flat, p.loose)
    zero_s, zero_l = np.flatnonzero(strict == 0), np.flatnonzero(loose == 0)
    cuts, at = [0], 0
    while at < n:
        if n - at <= p.least:
            cuts.append(n)
            break
        origin, end = at + p.least, min(at + p.most, n)
        turn = min(max(at + p.target, origin), end)
        hit = _first(origin, turn, origin, strict, zero_s, p.strict)
        if hit < 0:
            hit = _first(turn, end, origin, loose, zero_l, p.loose)
        at = end if hit < 0 else hit + 1
        cuts.append(at)
    return cuts


def cut(data: Column, p: Parameters = Parameters()) -> Column:
    """array<bigint> of boundaries of a binary column; null for null."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else boundaries(v, p) for v in column.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(data)


def spans(cuts: Column) -> Column:
    """array<struct<start, end>> of boundaries."""
    return F.transform(F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("start"), F.get(cuts, i + 1).alias("end")))


def chunks(df: DataFrame, key: str, data: Column, p: Parameters = Parameters()) -> DataFrame:
    """(key, ord, start, end, size, bytes), one row for each chunk. Bytes are cut in the task that found the cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in zip(batch.column("key"), batch.column("data"), strict=True):
                if v.as_py():
                    whole = v.as_py()
                    cuts = boundaries(whole, p)
                    n = len(cuts) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * n, k.type), pa.array(range(n), pa.int32()), pa.array(cuts[:-1], pa.int64()), pa.array(cuts[1:], pa.int64()), pa.array([whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                        ["key", "ord", "start", "end", "bytes"],
                    )

    rows = df.select(F.col(key).alias("key"), data.cast("binary").alias("data"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ord int, start long, end long, bytes binary")
    return out.select(F.col("key").alias(key), "ord", "start", "end", (F.col("end") - F.col("start")).alias("size"), "bytes")


def fixed_chunks(df: DataFrame, key: str, data: Column, size: int) -> DataFrame:
    """The same rows with cuts every ``size`` bytes; no UDF."""
    rows = df.select(F.col(key), data.cast("binary").alias("data")).where("octet_length(data) > 0")
    at = F.sequence(F.lit(0), F.ceil(F.octet_length("data") / size).cast("int") - 1)
    rows = rows.select(key, "data", F.explode(at).alias("ord"))
    start = (F.col("ord") * size).cast("long")
    rows = rows.select(key, "ord", start.alias("start"), F.substring(F.col("data"), F.col("ord") * size + 1, F.lit(size)).alias("bytes"))
    return rows.select(key, "ord", "start", (F.col("start") + F.octet_length("bytes")).alias("end"), F.octet_length("bytes").cast("long").alias("size"), "bytes")


def offsets(sized: DataFrame, key: str) -> DataFrame:
    """Running ``offset`` of chunks that come with an order and a size."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.withColumn("offset", F.sum("size").over(w) - F.col("size"))


def identified(pieces: DataFrame) -> DataFrame:
    """Chunks with their ``chunk_id`` under the built-in profile."""
    return pieces.withColumn("chunk_id", sha256_id(F.col("bytes")))


def dedup_ratio(pieces: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """One row: chunks, distinct chunks, bytes, distinct bytes."""
    by = pieces.groupBy(id_column).agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("distinct_chunks"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("distinct_bytes"))
