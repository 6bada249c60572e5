"""Messages: kinds, error codes, dispatch of requests to answers, framing, connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ERRORS, MESSAGES, K
from ..functions.encoding import fixed, read_le, u32, u64
from .routing import nearest

_TAG = {name: tag for tag, name in MESSAGES.items()}


def kind(tag: Column) -> Column:
    """The name of a message's kind; null for an unknown tag, which is an error."""
    return F.element_at(F.create_map(*[F.lit(x) for t, n in MESSAGES.items() for x in (t, n)]), tag.cast("int"))


def error_name(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, n in ERRORS.items() for x in (c, n)]), code.cast("int")), F.lit(ERRORS[0]))


def is_request(tag: Column) -> Column:
    """Requests have even tags; an error has none of either."""
    return (tag % 2 == 0) & tag.isin(*_TAG.values())


def envelope(request_id: Column, sender: Column, tag: Column, payload: Column) -> Column:
    return F.concat(u64(request_id), fixed(sender, 32), u32(tag), payload)


def opened(message: Column) -> Column:
    """struct(request_id, sender, tag, payload) of an envelope; null if it is too short."""
    n = F.octet_length(message)
    return F.when(n >= 44, F.struct(read_le(message, 0, 8).alias("request_id"), F.substring(message, 9, 32).alias("sender"), read_le(message, 40, 4).cast("int").alias("tag"), F.substring(message, F.lit(45), n - 44).alias("payload")))


def framed(payload: Column) -> Column:
    return F.concat(u32(F.octet_length(payload)), payload)


def answers(requests: DataFrame, nodes: DataFrame, manifests: DataFrame, holders: DataFrame) -> DataFrame:
    """(request_id, answer, source): what each request (request_id, tag, key) is answered with. A value is looked up among the
    nodes, then manifests, then holders; without one the nearest nodes answer. ``nodes``, ``manifests`` and ``holders`` bring
    (key)."""
    found = requests
    for name, side in (("node", nodes), ("manifest", manifests), ("holders", holders)):
        found = found.join(side.select("key", F.lit(True).alias(f"has_{name}")).distinct(), "key", "left")
    tag, get = F.col("tag"), F.coalesce(F.col("has_manifest"), F.lit(False))
    value = F.when(F.col("has_node"), "node").when(F.col("has_manifest"), "manifest").when(F.col("has_holders"), "holders").otherwise("closest")
    is_ = lambda n: tag == _TAG[n]
    answer = (
        F.when(is_("Ping"), "Pong")
        .when(is_("FindNode"), "FindNodeResponse")
        .when(is_("StoreRecord"), "StoreRecordResponse")
        .when(is_("FindValue"), "FindValueResponse")
        .when(is_("GetManifest"), "GetManifestResponse")
        .when(is_("PublishManifest"), "PublishManifestResponse")
        .when(is_("GetChunk") | is_("StoreChunk"), "Error")
    )
    source = F.when(is_("FindNode"), "closest").when(is_("FindValue"), value).when(is_("GetManifest"), F.when(get, "manifest").otherwise("none"))
    return found.select("request_id", answer.alias("answer"), source.alias("source"))


def closest_answers(requests: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """(request_id, node, rank) for requests (request_id, id) that are answered with the nearest nodes."""
    return nearest(requests.select(F.col("request_id").alias("target"), "id"), nodes, k).select(F.col("target").alias("request_id"), "node", "rank")


def connections(log: DataFrame, as_of: Column) -> DataFrame:
    """(connection, state, sent, received, bytes_sent, bytes_received, duration_ms, idle_ms) of a log (connection, ts, event,
    bytes): sums, the last state, the time since the first and the last entry."""
    states = ("Connecting", "Connected", "Disconnected", "Failed")
    of = lambda e, v: F.coalesce(F.sum(F.when(F.col("event") == e, v)), F.lit(0))
    state = F.max(F.when(F.col("event").isin(*states), F.struct("ts", "event")))["event"]
    return log.groupBy("connection").agg(
        F.coalesce(state, F.lit("Connecting")).alias("state"),
        of("sent", F.lit(1)).alias("sent"), of("received", F.lit(1)).alias("received"), of("sent", F.col("bytes")).alias("bytes_sent"), of("received", F.col("bytes")).alias("bytes_received"),
        (as_of - F.min("ts")).alias("duration_ms"), (as_of - F.max("ts")).alias("idle_ms"),
    )


def active(conns: DataFrame) -> DataFrame:
    return conns.where("state = 'Connected'")
