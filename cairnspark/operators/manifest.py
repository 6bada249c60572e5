"""Versioned objects: one history table of (object, revision, ...), of which everything else is a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHUNK_KEY, CHUNK_KEY_BASE, CHUNK_NONCE, MANIFEST_KEY, MANIFEST_NONCE
from ..functions import crypto
from ..functions.crypto import signature_valid
from ..functions.encoding import manifest_body, parse_manifest_body
from ..functions.ids import next_revision, sha256_id


def put(history: DataFrame, new: DataFrame) -> DataFrame:
    """Of one revision the last write counts: rows of ``new`` replace those of the same object and revision."""
    return history.join(new.select("object", "revision"), ["object", "revision"], "left_anti").unionByName(new)


def latest(history: DataFrame) -> DataFrame:
    """The highest revision of each object, whatever was put last."""
    rest = [c for c in history.columns if c not in ("object", "revision")]
    best = history.groupBy("object").agg(F.max(F.struct("revision", *rest)).alias("m"))
    return best.select("object", "m.*").select(*history.columns)


def at_revision(history: DataFrame, revision: Column) -> DataFrame:
    return history.where(F.col("revision") == revision)


def revisions(history: DataFrame) -> DataFrame:
    """(object, revisions): counts and limits; the list itself is the history in order."""
    return history.groupBy("object").agg(F.count("*").alias("revisions"), F.min("revision").alias("first_revision"), F.max("revision").alias("last_revision"))


def listed(history: DataFrame, most: int | None = None) -> DataFrame:
    """Revisions of each object, newest first; at most ``most``."""
    rank = F.row_number().over(Window.partitionBy("object").orderBy(F.desc("revision")))
    out = history.withColumn("rank", rank)
    return out if most is None else out.where(F.col("rank") <= most)


def objects(history: DataFrame) -> DataFrame:
    return history.select("object").distinct()


def delete(history: DataFrame, gone: DataFrame) -> DataFrame:
    return history.join(gone.select("object"), "object", "left_anti")


def retain(history: DataFrame, most: int) -> DataFrame:
    """Keeps the newest ``most`` revisions of each object."""
    return listed(history, most).drop("rank")


def as_of(history: DataFrame, moments: DataFrame) -> DataFrame:
    """(object, moment, revision, ...): for each asked moment the newest revision that was modified by then."""
    rest = [c for c in history.columns if c not in ("object", "modified_at", "revision")]
    hit = moments.join(history, "object").where(F.col("modified_at") <= F.col("moment"))
    return hit.groupBy("object", "moment").agg(F.max(F.struct("modified_at", "revision", *rest)).alias("m")).select("object", "moment", "m.*")


def successor_reason(previous: Column, now: Column, signature_ok: Column | None = None) -> Column:
    """Why ``now`` may not follow ``previous`` (structs with object, revision, origin); null if it may. Revisions may leave
    gaps but must grow."""
    signature_ok = F.lit(True) if signature_ok is None else signature_ok
    return F.when(~signature_ok, "signature").when(previous["object"] != now["object"], "object").when(now["revision"] <= previous["revision"], "revision").when(previous["origin"] != now["origin"], "origin")


def audit(history: DataFrame, order: list[str]) -> DataFrame:
    """The history in order of arrival with ``reason``: what is wrong with each row after the one before it."""
    w = Window.partitionBy("object").orderBy(*order)
    here = F.struct("object", "revision", "origin")
    before = F.lag(here).over(w)
    return history.withColumn("reason", F.when(before.isNotNull(), successor_reason(before, here)))


def new_revision(m: DataFrame, content_root: Column, moment: Column) -> DataFrame:
    """The next bodies: creation and origin stay."""
    return m.withColumn("revision", next_revision(F.col("revision"))).withColumn("content_root", content_root).withColumn("modified_at", moment)


def identity(public_key: Column) -> Column:
    """struct(public_key, node_id) under the built-in profile."""
    return F.struct(public_key.alias("public_key"), sha256_id(public_key).alias("node_id"))


def identity_ok(origin: Column) -> Column:
    return origin["node_id"] == sha256_id(origin["public_key"])


def signature_ok(body: Column, signature: Column) -> Column:
    return signature_valid(body["origin"]["public_key"], manifest_body(body), signature)


def changed_chunks(chunks: DataFrame) -> DataFrame:
    """(object, revision, chunk, change) between each revision and the one before it; ``chunks``: (object, revision,
    chunk). Presence is counted per (object, chunk) in order of revision, with no join of whole revisions."""
    now = chunks.select("object", "revision", "chunk").distinct()
    steps = now.select("object", "revision").distinct().withColumn("next", F.lead("revision").over(Window.partitionBy("object").orderBy("revision")))
    before = now.join(steps.where("next IS NOT NULL"), ["object", "revision"]).select("object", F.col("next").alias("revision"), "chunk", F.lit(True).alias("was"))
    both = now.withColumn("is", F.lit(True)).join(before, ["object", "revision", "chunk"], "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").otherwise("retained")
    return both.select("object", "revision", "chunk", change.alias("change"))


def encrypted(secret: Column, object_id: Column, revision: Column, body: Column, signature: Column) -> Column:
    """struct(nonce, ciphertext) of an encoded manifest under an object's capability secret."""
    key = crypto.derived(secret, object_id, MANIFEST_KEY, 32)
    nonce = crypto.derived(secret, crypto.revision_salt(object_id, revision), MANIFEST_NONCE, 24)
    return F.struct(nonce.alias("nonce"), crypto.encrypted(key, nonce, F.concat(manifest_body(body), signature), crypto.manifest_aad(object_id)).alias("ciphertext"))


def decrypted(secret: Column, object_id: Column, stored: Column) -> Column:
    """struct(body, signature) of a manifest; null if it does not open."""
    plain = crypto.decrypted(crypto.derived(secret, object_id, MANIFEST_KEY, 32), stored["nonce"], stored["ciphertext"], crypto.manifest_aad(object_id))
    return F.when(plain.isNotNull(), F.struct(parse_manifest_body(F.substring(plain, 1, 156)).alias("body"), F.substring(plain, 157, 64).alias("signature")))


def object_chunk(secret: Column, object_id: Column, chunk_id: Column, plaintext: Column) -> Column:
    """The stored form of a mutable object's chunk: nonce, ciphertext and tag under the object's own keys."""
    base = crypto.derived(secret, object_id, CHUNK_KEY_BASE, 32)
    nonce = crypto.derived(base, chunk_id, CHUNK_NONCE, 24)
    return F.concat(nonce, crypto.encrypted(crypto.derived(base, chunk_id, CHUNK_KEY, 32), nonce, plaintext, crypto.chunk_aad(object_id, chunk_id)))
