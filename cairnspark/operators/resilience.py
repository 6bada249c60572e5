"""Replica health, repair plans and lease renewal.

Leases are (chunk, holder, issued_at, expires_at, ...); a catalogue names all chunks, also those without a lease.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHECK_INTERVAL_MS, POLICIES
from ..functions.timing import live

DEFAULT_REPLICAS, DEFAULT_TTL_MS, DEFAULT_THRESHOLD = POLICIES["default"]


def status(holders: Column, threshold: Column) -> Column:
    """A threshold of 0 makes every chunk healthy."""
    return F.when(holders >= threshold, "healthy").when(holders > 0, "at_risk").otherwise("lost")


def live_holders(leases: DataFrame, as_of: Column) -> DataFrame:
    """(chunk, live_holders, holders): distinct holders with a lease that runs at ``as_of``. Two levels, so that a
    chunk with very many leases is counted in parts."""
    runs = leases.where((F.col("issued_at") <= as_of) & live(F.col("expires_at"), as_of)).select("chunk", "holder").distinct()
    return runs.groupBy("chunk").agg(F.count("*").alias("live_holders"))


def health(catalogue: DataFrame, leases: DataFrame, as_of: Column, policy: DataFrame | None = None) -> DataFrame:
    """(chunk, live_holders, repair_threshold, min_replicas, status, missing). ``policy``: (chunk, min_replicas,
    repair_threshold) for chunks that differ from the default."""
    out = catalogue.select("chunk").distinct().join(live_holders(leases, as_of), "chunk", "left")
    own = {"min_replicas": DEFAULT_REPLICAS, "repair_threshold": DEFAULT_THRESHOLD}
    if policy is not None:
        out = out.join(policy.select("chunk", *own), "chunk", "left")
    n = F.coalesce("live_holders", F.lit(0)).cast("long")
    replicas, threshold = (F.coalesce(F.col(c), F.lit(v)) if policy is not None else F.lit(v) for c, v in own.items())
    out = out.select("chunk", n.alias("live_holders"), threshold.cast("int").alias("repair_threshold"), replicas.cast("int").alias("min_replicas"))
    out = out.withColumn("status", status(F.col("live_holders"), F.col("repair_threshold")))
    return out.withColumn("missing", F.when(F.col("status") == "at_risk", F.greatest(F.col("min_replicas") - F.col("live_holders"), F.lit(0).cast("long"))))


def rollup(report: DataFrame) -> DataFrame:
    """One row: healthy, at_risk, lost, total, needs_repair, all_healthy."""
    count = lambda s: F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(s)
    out = report.agg(count("healthy"), count("at_risk"), count("lost"), F.count("*").alias("total"))
    return out.withColumn("needs_repair", F.col("at_risk") + F.col("lost")).withColumn("all_healthy", F.col("needs_repair") == 0)


def repair_tasks(report: DataFrame, leases: DataFrame, as_of: Column) -> DataFrame:
    """(chunk, current, target, existing_holders): a task for each chunk at risk; lost chunks have no source to copy."""
    risk = report.where("status = 'at_risk'").select("chunk", F.col("live_holders").alias("current"), F.col("min_replicas").alias("target"))
    runs = leases.where((F.col("issued_at") <= as_of) & live(F.col("expires_at"), as_of))
    # fewer holders than the threshold: the lists are bounded
    have = runs.join(risk.select("chunk"), "chunk", "left_semi").groupBy("chunk").agg(F.array_sort(F.collect_set("holder")).alias("existing_holders"))
    return risk.join(have, "chunk")


def repair_candidates(tasks: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(chunk, holder, rank): for each task the ``k`` nodes nearest to the chunk that do not hold it. ``tasks`` and
    ``nodes`` bring an ``id`` of eight words; nodes are as many as the network has, tasks are not broadcast."""
    from .routing import nearest

    pairs = tasks.select("chunk", F.explode("existing_holders").alias("holder"))
    most = k + (tasks.agg(F.max(F.size("existing_holders"))).first()[0] or 0)  # the nearest k others are among the nearest k + holders
    near = nearest(tasks.select(F.col("chunk").alias("target"), "id"), nodes.select(F.col("holder").alias("node"), "id"), most)
    left = near.select(F.col("target").alias("chunk"), F.col("node").alias("holder"), "rank").join(pairs, ["chunk", "holder"], "left_anti")
    order = Window.partitionBy("chunk").orderBy("rank")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def check_due(last_check: Column, as_of: Column, interval: int = CHECK_INTERVAL_MS) -> Column:
    """A health check is due if none was made or the last one is an interval ago."""
    return last_check.isNull() | (as_of - last_check >= interval)
