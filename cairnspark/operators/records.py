"""Records: gates before storage, supersede by quality, bounded holder sets, expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_HOLDERS, MAX_RECORD_BYTES, MAX_SKEW_MS, RECORD_TTL_MS
from ..functions import encoding
from ..functions.crypto import record_mac, signature_valid, signed
from ..functions.ids import sha256_id
from ..functions.timing import kept, live, within_skew


def reject_reason(mac_ok: Column, size: Column, ts: Column, as_of: Column, signature_ok: Column | None = None, consistent: Column | None = None) -> Column:
    """The first gate that a record fails, in the order of the gates; null if it passes. A record without a time stamp of
    its own (holder sets) passes the time gate."""
    signature_ok, consistent = (F.lit(True) if c is None else c for c in (signature_ok, consistent))
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(fails(mac_ok), "mac").when(fails(size <= MAX_RECORD_BYTES), "size").when(ts.isNotNull() & fails(within_skew(ts, as_of, MAX_SKEW_MS)), "time").when(fails(signature_ok), "signature").when(fails(consistent), "consistency")


def gated(records: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with ``reason``)."""
    marked = records.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def authenticated(records: DataFrame, network_key: bytes, body: str = "body") -> DataFrame:
    return records.withColumn("mac", record_mac(network_key, F.col(body)))


def mac_ok(network_key: bytes, body: Column, mac: Column) -> Column:
    return record_mac(network_key, body) == mac


def superseded(records: DataFrame, keys: list[str], quality: list[str]) -> DataFrame:
    """For each key the row of the highest quality; the tuple is extended by the other columns, so that ties have one
    outcome in any order of arrival. Partial aggregation makes it fit for hot keys and for streams."""
    rest = [c for c in records.columns if c not in keys and c not in quality]
    best = records.groupBy(*keys).agg(F.max(F.struct(*quality, *rest)).alias("_best"))
    return best.select(*[F.col(k) if k in keys else F.col("_best")[k].alias(k) for k in records.columns])


def merge_holders(leases: DataFrame, chunk: str = "chunk", holder: str = "holder", bound: int = MAX_HOLDERS) -> DataFrame:
    """For each chunk its best ``bound`` holders, each with its best lease; quality is expiry, holder, signatures. Taking
    the best per holder first and the best holders of any parts before the whole gives the same set."""
    quality = [c for c in ("expires_at", holder, "issuer_signature", "holder_signature") if c in leases.columns]
    one = superseded(leases, [chunk, holder], [c for c in quality if c != holder])
    order = [F.desc(c) for c in quality]
    # chunks with very many holders are first thinned out in parts
    parts = one.withColumn("_part", F.pmod(F.xxhash64(holder), F.lit(16)))
    some = parts.withColumn("_rank", F.row_number().over(Window.partitionBy(chunk, "_part").orderBy(*order))).where(F.col("_rank") <= bound).drop("_part", "_rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(chunk).orderBy(*order))).where(F.col("rank") <= bound)


def merge_sets(a: DataFrame, b: DataFrame, bound: int = MAX_HOLDERS) -> DataFrame:
    """The join of two holder tables; commutative, associative and idempotent."""
    return merge_holders(a.drop("rank").unionByName(b.drop("rank")), bound=bound)


def without_expired(leases: DataFrame, as_of: Column) -> DataFrame:
    return leases.where(live(F.col("expires_at"), as_of))


def unexpired(records: DataFrame, as_of: Column, ttl: int = RECORD_TTL_MS) -> DataFrame:
    """Records that were stored less than the time to live ago."""
    return records.where(kept(F.col("stored_at"), as_of, ttl))


def stats(records: DataFrame, kind: str = "kind") -> DataFrame:
    return records.groupBy(kind).agg(F.count("*").alias("records"))


def record_key(node_id: Column, object_id: Column, ciphertext_hash: Column) -> Column:
    return F.coalesce(node_id, object_id, ciphertext_hash)


# --- what signers vouch for


def node_announcement(seed: Column, body: Column) -> Column:
    """A node's announcement from struct(node_id, timestamp, addresses, services, public_key), signed with its key."""
    return F.struct(*[body[c].alias(c) for c in ("node_id", "timestamp", "addresses", "services", "public_key")], signed(seed, encoding.node_body(body)).alias("signature"))


def node_reason(a: Column, hashed: Callable[[Column], Column] = sha256_id) -> Column:
    """Why an announcement does not hold; null if it does: the id is the hash of the key, and the key signed the rest."""
    return F.when(~(a["node_id"] == hashed(a["public_key"])), "identity").when(~signature_valid(a["public_key"], encoding.node_body(a), a["signature"]), "signature")


def signed_lease(body: Column, issuer_seed: Column, holder_seed: Column) -> Column:
    encoded = encoding.lease_body(body)
    return F.struct(body.alias("body"), signed(issuer_seed, encoded).alias("issuer_signature"), signed(holder_seed, encoded).alias("holder_signature"))


def lease_reason(x: Column, issuer_key: Column, holder_key: Column) -> Column:
    """Why a lease does not hold; null if both sides have signed it."""
    body = encoding.lease_body(x["body"])
    return F.when(~signature_valid(issuer_key, body, x["issuer_signature"]), "issuer").when(~signature_valid(holder_key, body, x["holder_signature"]), "holder")


def improved(stored: DataFrame, offered: DataFrame, keys: list[str], quality: list[str], valid: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stored``, one row a key, after ``offered`` rows: only those that would win are judged by ``valid``, which costs a
    signature each; the best valid one takes the place."""
    now = stored.select(*keys, F.struct(*quality).alias("_now"))
    could = offered.join(now, keys, "left").where(F.col("_now").isNull() | (F.struct(*quality) > F.col("_now"))).drop("_now")
    return superseded(stored.unionByName(valid(could).select(stored.columns)), keys, quality)


def get(asked: DataFrame, nodes: DataFrame, manifests: DataFrame, holders: DataFrame, network_key: bytes) -> DataFrame:
    """(request, kind, key, body, mac): typed gets of ``asked`` (request, kind, key), kind being node, manifest or holders.
    Nodes and manifests (key, body, mac) come as stored; holder sets (key, body) are authenticated anew, as merging has
    changed them. ``body`` is the encoded record body, null where nothing is stored."""
    anew = holders.select("key", "body").withColumn("mac", record_mac(network_key, F.col("body")))
    every = None
    for kind, side in (("node", nodes), ("manifest", manifests), ("holders", anew)):
        part = side.select(F.lit(kind).alias("kind"), "key", "body", "mac")
        every = part if every is None else every.unionByName(part)
    return asked.select("request", "kind", "key").join(every, ["kind", "key"], "left").select("request", "kind", "key", "body", "mac")
