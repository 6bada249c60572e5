"""Named plans of the protocol's state: buckets, signed records, encodings, stores, handles, objects."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import crypto, encoding, ids, timing, uri
from ..functions.hashing import blake3
from ..operators import blob, cache, cdc, manifest, messages, namespace, records, resilience, routing
from ..sources import store
from ..streaming import ingest
from . import adapters as A
from .catalogue import _FIXED, _data, _drained, _ingested, _le_hex, _mac_sql, _merged, _stream, plan, shared_folder

_hex = ids.to_hex

# --- buckets

_SIZE, _AT, _TIMEOUT = 10, A.AS_OF + 1450 * C.DAY_MS, 210 * 86_400


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as nodes that were seen when they ordered."""
    seen = A.table(spark, sf, "orders").select((F.col("o_custkey") % 8).alias("bucket"), F.col("o_custkey").alias("node"), timing.millis(F.col("o_orderdate")).alias("seen_at"))
    r = routing.resident(seen, _SIZE).withColumn("kind", F.when(F.col("resident"), "node").otherwise("replacement"))
    return routing._placed(r.withColumn("failures", F.lit(0).cast("long")), "first_seen", "node")


_ENTRIES = f"""(SELECT bucket, node, row_number() OVER (PARTITION BY bucket, kind ORDER BY first_seen, node) - 1 AS place, kind, last_seen, CAST(0 AS BIGINT) AS failures FROM (
SELECT *, CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY first_seen, node) <= {_SIZE} THEN 'node' ELSE 'replacement' END AS kind FROM (
SELECT o_custkey % 8 AS bucket, o_custkey AS node, min(epoch_us(o_orderdate) // 1000) AS first_seen, max(epoch_us(o_orderdate) // 1000) AS last_seen FROM orders GROUP BY ALL)))"""
_AGAIN = "SELECT bucket, node, CAST(row_number() OVER (PARTITION BY bucket, kind ORDER BY was, place) - 1 AS INTEGER) AS place, kind, last_seen, failures FROM"
_STALE = f"({_AT} - last_seen) // 1000 > {_TIMEOUT}"


@plan(f"""WITH e AS (SELECT *, {_STALE} AS old FROM {_ENTRIES}), k AS (SELECT * FROM e WHERE kind = 'replacement' OR NOT old),
w AS (SELECT *, {_SIZE} - count(*) FILTER (kind = 'node') OVER (PARTITION BY bucket) AS room, count(*) FILTER (kind = 'replacement' AND NOT old) OVER (PARTITION BY bucket ORDER BY kind, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh FROM k)
{_AGAIN} (SELECT bucket, node, place, kind AS was, CASE WHEN fresh < room THEN 'node' ELSE kind END AS kind, last_seen, failures FROM w WHERE NOT (kind = 'replacement' AND old AND fresh < room))""")
def bucket_evict_stale(spark, sf):
    return routing.evict_stale(_entries(spark, sf), F.lit(_AT), _SIZE, _TIMEOUT)


@plan(f"""WITH e AS (SELECT *, count(*) FILTER (kind = 'node' AND node % 3 = 0) OVER (PARTITION BY bucket) AS n FROM {_ENTRIES})
{_AGAIN} (SELECT bucket, node, place, kind AS was, CASE WHEN place < n THEN 'node' ELSE kind END AS kind, last_seen, failures FROM e WHERE NOT (kind = 'node' AND node % 3 = 0))""")
def bucket_remove(spark, sf):
    e = _entries(spark, sf)
    return routing.remove(e, e.where("node % 3 = 0").select("bucket", "node"))


@plan(f"""SELECT bucket, node, CAST(place AS INTEGER) AS place, kind, CASE WHEN kind = 'node' AND node % 2 = 0 THEN greatest(last_seen, {_AT}) ELSE last_seen END AS last_seen,
CASE WHEN kind = 'node' AND node % 2 = 1 THEN n ELSE 0 END AS failures FROM {_ENTRIES} JOIN (SELECT o_custkey AS node, count(*) AS n FROM orders GROUP BY 1) USING (node)""")
def bucket_touch_and_failures(spark, sf):
    e = _entries(spark, sf)
    calls = A.table(spark, sf, "orders").select((F.col("o_custkey") % 8).alias("bucket"), F.col("o_custkey").alias("node"))
    return routing.touch(routing.record_failures(e, calls), e.where("node % 2 = 0").select("bucket", "node", F.lit(_AT).alias("seen_at")))


@plan(f"SELECT bucket, count(*) FILTER (kind = 'node') AS nodes, count(*) FILTER (kind <> 'node') AS replacements, count(*) FILTER (kind = 'node') >= {_SIZE} AS is_full, arg_min(node, place) FILTER (kind = 'node') AS stalest FROM {_ENTRIES} GROUP BY bucket")
def bucket_stats(spark, sf):
    return routing.bucket_stats(_entries(spark, sf), _SIZE)


@plan(f"SELECT bucket, node, CAST(place AS INTEGER) AS place, kind, last_seen, failures FROM {_ENTRIES} WHERE kind = 'node' AND node IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def bucket_get(spark, sf):
    asked = A.table(spark, sf, "customer").where("c_nationkey < 10").select((F.col("c_custkey") % 8).alias("bucket"), F.col("c_custkey").alias("node"))
    return routing.get(_entries(spark, sf), asked)


# --- signed records


def _seed(c: str, label: str):
    return A.node_id(F.concat(F.lit(label), F.col(c).cast("string")))


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with two signing keys and the public ones, made where the keys are."""
    n = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    key = F.arrow_udf(_public_keys, "binary")
    return n.select("*", _seed("nation", "a").alias("a"), _seed("nation", "b").alias("b")).select("*", key(F.col("a")).alias("a_key"), key(F.col("b")).alias("b_key"))


def _public_keys(seeds):
    import pyarrow as pa

    return pa.array([crypto.public_key(s) for s in seeds.to_pylist()], pa.binary())


@plan("SELECT n_nationkey AS nation, CASE n_nationkey % 3 WHEN 1 THEN 'signature' WHEN 2 THEN 'identity' END AS reason FROM nation")
def announcement_verify(spark, sf):
    body = F.struct(ids.sha256_id(F.col("a_key")).alias("node_id"), F.lit(A.AS_OF).alias("timestamp"), F.array("name").alias("addresses"), F.col("region").cast("long").alias("services"), F.col("a_key").alias("public_key"))
    a = _keys(spark, sf).withColumn("a", records.node_announcement(F.col("a"), body))
    third = F.col("nation") % 3
    a = a.withColumn("a", F.when(third == 1, F.col("a").withField("services", F.col("a.services") + 1)).when(third == 2, F.col("a").withField("node_id", A.node_id(F.col("nation")))).otherwise(F.col("a")))
    return a.select("nation", records.node_reason(F.col("a")).alias("reason"))


@plan("SELECT n_nationkey AS nation, CASE n_nationkey % 3 WHEN 1 THEN 'issuer' WHEN 2 THEN 'holder' END AS reason FROM nation")
def lease_verify(spark, sf):
    k = _keys(spark, sf)
    body = _lease_body(A.node_id(F.col("nation")), A.node_id(F.col("region")), F.lit(A.AS_OF), F.lit(A.AS_OF + C.LEASE_TTL_MS))
    lease = records.signed_lease(body, F.col("a"), F.col("b"))
    third = F.col("nation") % 3
    k = k.withColumn("lease", lease)
    return k.select("nation", records.lease_reason(F.col("lease"), F.when(third == 1, F.col("b_key")).otherwise(F.col("a_key")), F.when(third == 2, F.col("a_key")).otherwise(F.col("b_key"))).alias("reason"))


@plan(f"""SELECT object, max(revision) AS revision FROM {A.MANIFESTS} WHERE seq % 2 = 0 OR seq % 3 <> 0 GROUP BY object""")
def manifest_improved(spark, sf):
    m = A.manifests(spark, sf).select("object", "revision", "seq")
    stored = records.superseded(m.where("seq % 2 = 0"), ["object"], ["revision"])
    return records.improved(stored, m.where("seq % 2 = 1"), ["object"], ["revision"], lambda r: r.where("seq % 3 <> 0")).select("object", "revision")


_GET = {"node": ("supplier", "s_suppkey", "s_name"), "manifest": ("customer", "c_custkey", "c_name"), "holders": ("orders", "o_orderkey", "o_orderpriority")}


@plan(f"""WITH s AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, {c} AS key, {v} AS body FROM {t}" for k, (t, c, v) in _GET.items())}),
r AS (SELECT event_id AS request, ['node', 'manifest', 'holders'][event_id % 3 + 1] AS kind, event_id % 400 AS key FROM events)
SELECT request, kind, key, body, {_mac_sql('body')} AS mac FROM r LEFT JOIN s USING (kind, key)""")
def record_get(spark, sf):
    part = {k: A.table(spark, sf, t).select(F.col(c).alias("key"), F.encode(F.col(v), "UTF-8").alias("body")) for k, (t, c, v) in _GET.items()}
    auth = {k: records.authenticated(part[k], A.NETWORK_KEY) for k in ("node", "manifest")}
    kinds = F.array(*[F.lit(k) for k in _GET])
    asked = A.table(spark, sf, "events").select(F.col("event_id").alias("request"), F.get(kinds, (F.col("event_id") % 3).cast("int")).alias("kind"), (F.col("event_id") % 400).alias("key"))
    got = records.get(asked, auth["node"], auth["manifest"], part["holders"], A.NETWORK_KEY)
    return got.select("request", "kind", "key", F.decode("body", "UTF-8").alias("body"), _hex(F.col("mac")).alias("mac"))


# --- encodings: what is encoded, and what comes back from it


def _text_hex(x: str) -> str:
    return f"{_le_hex(f'strlen({x})', 4)} || lower(hex(encode({x})))"


_INFO = f"(sha256(CAST(s_suppkey AS VARCHAR)) || CASE WHEN s_suppkey % 3 = 0 THEN '00000000' ELSE '02000000' || {_text_hex('s_name')} || {_text_hex('s_nation')} END || sha256('key' || s_suppkey))"
_SUPPLIERS = "(SELECT *, CAST(s_nationkey AS VARCHAR) AS s_nation FROM supplier)"


def _infos(spark: SparkSession, sf: str) -> DataFrame:
    addresses = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("s_name", F.col("s_nationkey").cast("string")))
    info = F.struct(A.node_id(F.col("s_suppkey")).alias("node_id"), addresses.alias("addresses"), A.node_id(F.concat(F.lit("key"), F.col("s_suppkey").cast("string"))).alias("public_key"))
    return A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), "s_acctbal", info.alias("info"))


@plan(f"SELECT s_suppkey AS node, {_INFO} AS encoded, sha256(CAST(s_suppkey AS VARCHAR)) AS node_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name || '|' || s_nation END AS addresses, sha256('key' || s_suppkey) AS public_key, TRUE AS cut_is_null FROM {_SUPPLIERS}")
def node_info_codec(spark, sf):
    raw = _infos(spark, sf).select("node", encoding.node_info(F.col("info")).alias("raw"))
    cut = F.substring(F.col("raw"), F.lit(1), F.octet_length("raw") - 1)
    r = raw.select("node", "raw", encoding.parse_node_info(F.col("raw")).alias("r"), encoding.parse_node_info(cut).isNull().alias("cut_is_null"))
    return r.select("node", _hex(F.col("raw")).alias("encoded"), _hex(F.col("r.node_id")).alias("node_id"), F.array_join("r.addresses", "|").alias("addresses"), _hex(F.col("r.public_key")).alias("public_key"), "cut_is_null")


@plan(f"""SELECT s_suppkey AS node, CASE WHEN s_suppkey % 4 = 0 THEN '00' || lower(hex(encode(s_name))) ELSE '01' || {_le_hex('s_suppkey % 4 - 1', 4)} || repeat({_INFO}, CAST(s_suppkey % 4 - 1 AS INTEGER)) END AS encoded,
CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS record, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 4 - 1 AS INTEGER) END AS nodes, CASE WHEN s_suppkey % 4 > 1 AND s_suppkey % 3 <> 0 THEN s_name END AS address FROM {_SUPPLIERS}""")
def find_value_codec(spark, sf):
    n = F.col("node") % 4
    name = F.format_string("%s", F.col("s_name"))
    rows = _infos(spark, sf).join(A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), "s_name"), "node")
    raw = rows.select("node", encoding.find_value_result(F.when(n == 0, F.encode(name, "UTF-8")), F.array_repeat("info", F.greatest(n - 1, F.lit(0)).cast("int"))).alias("raw"))
    r = raw.select("node", "raw", encoding.parse_find_value(F.col("raw")).alias("r"))
    first = F.get(F.get("r.nodes", F.lit(0))["addresses"], F.lit(0))
    return r.select("node", _hex(F.col("raw")).alias("encoded"), F.decode("r.record", "UTF-8").alias("record"), F.when(F.col("r.nodes").isNotNull(), F.size("r.nodes")).alias("nodes"), first.alias("address"))


def _lease_body(chunk, holder, issued, expires):
    c = F.struct(chunk.alias("merkle_root"), F.lit(1000).alias("size"), F.lit(1000).alias("block_size"), F.lit(1).alias("block_count"))
    return F.struct(chunk.alias("chunk_id"), chunk.alias("ciphertext_hash"), c.alias("commitment"), holder.alias("holder"), holder.alias("issuer"), issued.alias("issued_at"), expires.alias("expires_at"))


_BEST = f"(SELECT chunk, holder, max(issued_at) AS issued_at, max(expires_at) AS expires_at, sha256(CAST(chunk AS VARCHAR)) AS c, sha256(CAST(holder AS VARCHAR)) AS h FROM {A.LEASES} GROUP BY chunk, holder)"
_LEASE_HEX = f"c || c || c || {_le_hex('1000', 8)} || {_le_hex('1000', 4)} || '01000000' || h || h || {_le_hex('issued_at', 8)} || {_le_hex('expires_at', 8)} || h || c || c || h"


@plan(f"""SELECT chunk, sha256(unhex({_le_hex('count(*)', 4)} || string_agg(h || {_LEASE_HEX}, '' ORDER BY h))) AS encoded, CAST(count(*) AS INTEGER) AS holders, min(h) AS first_holder, max(expires_at) AS last_expiry, count(*) > 1 AS turned_is_null FROM {_BEST} GROUP BY chunk""")
def holders_codec(spark, sf):
    one = A.leases(spark, sf).groupBy("chunk", "holder").agg(F.max("issued_at").alias("issued_at"), F.max("expires_at").alias("expires_at"))
    # keys and times are gathered, and leases made of them afterwards, so that these are not shuffled
    held = one.groupBy("chunk").agg(F.collect_list(F.struct("holder", "issued_at", "expires_at")).alias("l")).withColumn("c", A.node_id(F.col("chunk")))
    c = F.col("c")
    named = F.transform("l", lambda x: F.struct(A.node_id(x["holder"]).alias("h"), x["issued_at"].alias("issued_at"), x["expires_at"].alias("expires_at")))
    lease = lambda x: F.struct(_lease_body(c, x["h"], x["issued_at"], x["expires_at"]).alias("body"), F.concat(x["h"], c).alias("issuer_signature"), F.concat(c, x["h"]).alias("holder_signature"))
    raw = held.select("chunk", encoding.holders(F.transform(named, lease)).alias("raw"))
    # the last entry put first breaks the order
    n = F.octet_length("raw")
    turned = F.concat(F.substring(F.col("raw"), 1, 4), F.substring(F.col("raw"), n - 351, F.lit(352)), F.substring(F.col("raw"), F.lit(5), n - 356))
    r = raw.select("chunk", "raw", encoding.parse_holders(F.col("raw")).alias("r"), encoding.parse_holders(turned).isNull().alias("turned_is_null"))
    last = F.array_max(F.transform("r", lambda x: x["lease"]["body"]["expires_at"]))
    return r.select("chunk", F.sha2("raw", 256).alias("encoded"), F.size("r").alias("holders"), _hex(F.get("r", F.lit(0))["holder"]).alias("first_holder"), last.alias("last_expiry"), "turned_is_null")


@plan(f"""SELECT inode, '02000000' || {_text_hex('name')} || {_le_hex("CASE kind WHEN 'file' THEN 33188 ELSE 16877 END", 4)} || {_le_hex('size', 8)} || sha256(CAST(inode AS VARCHAR)) AS encoded, name, CASE kind WHEN 'file' THEN 33188 ELSE 16877 END::BIGINT AS mode, size AS mtime, sha256(CAST(inode AS VARCHAR)) AS content FROM {A.INODES}""")
def entry_node_codec(spark, sf):
    i = A.inodes(spark, sf)
    made = namespace.new_inode(F.col("inode"), F.col("parent"), F.col("name"), F.col("kind"), F.lit(0).cast("long"))
    raw = i.select("inode", encoding.entry_node(F.col("name"), made["mode"], F.col("size"), A.node_id(F.col("inode"))).alias("raw"))
    r = raw.select("inode", "raw", encoding.parse_entry_node(F.col("raw")).alias("r"))
    return r.select("inode", _hex(F.col("raw")).alias("encoded"), "r.name", "r.mode", "r.mtime", _hex(F.col("r.content")).alias("content"))


_BODY_HEX = f"'01000000' || sha256(CAST(object AS VARCHAR)) || {_le_hex('revision', 8)} || content_root || {_le_hex('created_at', 8)} || {_le_hex('modified_at', 8)} || sha256('key' || object) || sha256(CAST(origin AS VARCHAR))"


@plan(f"""SELECT seq, sha256(unhex(sha256(CAST(object AS VARCHAR)) || {_BODY_HEX} || repeat(content_root, 2))) AS announcement, sha256(unhex('01000000' || {_BODY_HEX})) AS record, {_mac_sql("x").replace("encode(x)", f"unhex('01000000' || {_BODY_HEX})")} AS mac, 1 AS kind, revision, modified_at, content_root FROM {A.MANIFESTS}""")
def manifest_record_codec(spark, sf):
    m = A.manifests(spark, sf)
    origin = F.struct(A.node_id(F.concat(F.lit("key"), F.col("object").cast("string"))).alias("public_key"), A.node_id(F.col("origin")).alias("node_id"))
    body = F.struct(F.lit(1).alias("crypto_version"), A.node_id(F.col("object")).alias("object_id"), "revision", F.unhex("content_root").alias("content_root"), "created_at", "modified_at", origin.alias("origin"))
    signed = F.struct(body.alias("body"), F.unhex(F.repeat("content_root", F.lit(2))).alias("signature"))
    raw = m.select("seq", encoding.manifest_announcement(A.node_id(F.col("object")), signed).alias("a"), encoding.record_body(F.lit(1), encoding.manifest_body(body)).alias("b"))
    raw = raw.select("seq", "a", encoding.record(F.col("b"), crypto.record_mac(A.NETWORK_KEY, F.col("b"))).alias("raw"))
    r = raw.select("seq", "a", encoding.parse_record(F.col("raw")).alias("r")).select("seq", "a", "r", encoding.parse_manifest_body(F.col("r.body")).alias("m"))
    return r.select("seq", F.sha2("a", 256).alias("announcement"), F.sha2("r.encoded", 256).alias("record"), _hex(F.col("r.mac")).alias("mac"), "r.kind", "m.revision", "m.modified_at", _hex(F.col("m.content_root")).alias("content_root"))


@plan(f"""SELECT c_custkey, {_le_hex('n', 4)} || coalesce(m, '') AS encoded_map, {_le_hex('n', 4)} || coalesce(s, '') AS encoded_list, CAST(n AS INTEGER) AS read_back FROM (
SELECT c_custkey, count(o_orderkey) AS n, string_agg({_le_hex('o_orderkey', 4)} || {_text_hex('o_orderpriority')}, '' ORDER BY {_le_hex('o_orderkey', 4)}) AS m, string_agg({_le_hex('o_orderkey', 8)}, '' ORDER BY o_orderkey) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def map_and_list_codec(spark, sf):
    o = A.table(spark, sf, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("m"), F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    c = A.table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    m, keys = F.coalesce("m", F.create_map().cast("map<bigint,string>")), F.coalesce("l", F.array().cast("array<bigint>"))
    r = c.select("c_custkey", encoding.sorted_map(m, encoding.u32, encoding.text).alias("m"), encoding.sequence(keys, encoding.u64).alias("l"))
    return r.select("c_custkey", _hex(F.col("m")).alias("encoded_map"), _hex(F.col("l")).alias("encoded_list"), F.size(encoding.parse_sequence(F.col("l"), 8)).alias("read_back"))


@plan("""SELECT doc_id, CASE WHEN n >= 40 THEN n - 40 END AS read_size, greatest(n - 40, 0) AS plain_size, CASE WHEN n >= 40 THEN lower(right(h, 32)) END AS tag, CASE WHEN n >= 40 THEN lower(substr(h, 1, 48)) END AS nonce FROM (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents)""")
def stored_chunk_parts(spark, sf):
    raw = F.coalesce(_data(), F.lit(b""))
    d = A.table(spark, sf, "documents").select("doc_id", raw.alias("raw"), encoding.parse_stored_chunk(raw).alias("r"))
    rest = F.substring(F.col("raw"), F.lit(25), F.octet_length("raw"))
    return d.select("doc_id", F.col("r.plaintext_size").alias("read_size"), encoding.plaintext_size(rest).alias("plain_size"), _hex(F.col("r.tag")).alias("tag"), _hex(F.col("r.nonce")).alias("nonce"))


# --- known answers of the ciphers and hashes; published test vectors, fixed values

_VECTORS = {
    "blake3_empty": "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    "blake3_byte": "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    "hkdf_rfc5869": "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865",
    "hmac_rfc4231": "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843",
    "xchacha_head": "bd6d179d3e83d43b9576579493c0e939",
    "xchacha_tag": "c0875924c1c7987947deafd8780acf49",
    "ed25519_rfc8032": "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b",
    "sha256_abc": hashlib.sha256(b"abc").hexdigest(),
}


@plan("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _VECTORS.items()) + ") t(name, value)")
def crypto_vectors(spark, sf):
    lit = lambda h: F.lit(bytes.fromhex(h))
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = crypto.encrypted(F.lit(bytes(range(0x80, 0xA0))), F.lit(bytes(range(0x40, 0x58))), F.lit(text), lit("50515253c0c1c2c3c4c5c6c7"))
    made = {
        "blake3_empty": blake3(F.lit(b"")),
        "blake3_byte": blake3(F.lit(b"\0")),
        "hkdf_rfc5869": crypto.derived(F.lit(b"\x0b" * 22), lit("000102030405060708090a0b0c"), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), 42),
        "hmac_rfc4231": crypto.hmac_sha256(b"Jefe", F.lit(b"what do ya want for nothing?")),
        "xchacha_head": F.substring(sealed, 1, 16),
        "xchacha_tag": F.substring(sealed, len(text) + 1, 16),
        "ed25519_rfc8032": crypto.signed(lit("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"), F.lit(b"")),
        "sha256_abc": ids.sha256_id(F.lit(b"abc")),
    }
    row = spark.range(1).select(*[_hex(v).alias(k) for k, v in made.items()])
    return row.unpivot([], list(made), "name", "value")


# --- stores


@plan(f"""WITH c AS (SELECT h, min(doc_id) AS d, bool_or(doc_id % 5 = 0) AS gone, length(any_value(h)) // 2 AS size FROM {_FIXED} GROUP BY h)
SELECT sha256(unhex(h)) AS chunk, NOT gone AS found, CASE WHEN NOT gone THEN CAST(size AS INTEGER) END AS size FROM c""")
def store_put_delete(spark, sf):
    rows = cdc.fixed_chunks(A.table(spark, sf, "documents"), "doc_id", _data(), 512).select("doc_id", F.col("bytes").alias("stored"))
    chunks = store.ChunkStore(spark, store.Layout(shared_folder(spark)))
    chunks.put_bytes(rows.where("doc_id % 2 = 0"))
    chunks.put_bytes(rows)  # what is there stays once
    keyed = rows.withColumn("ciphertext_hash", ids.sha256_id(F.col("stored")))
    chunks.delete(keyed.where("doc_id % 5 = 0").select("ciphertext_hash").distinct())
    out = chunks.contains(keyed.select("ciphertext_hash").distinct()).join(chunks.checked(), "ciphertext_hash", "left")
    return out.select(_hex(F.col("ciphertext_hash")).alias("chunk"), "found", F.octet_length("stored").alias("size"))


@plan(f"""SELECT object, revision, content_root FROM {A.MANIFESTS} WHERE object % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY object ORDER BY revision DESC) <= 3""")
def store_manifests(spark, sf):
    m = A.manifests(spark, sf)
    rows = m.select(A.node_id(F.col("object")).alias("object"), F.col("object").alias("o"), "revision", F.unhex("content_root").alias("content_root"), "created_at", "modified_at", A.node_id(F.col("origin")).alias("origin"), F.lit(b"").alias("signature"))
    table = store.manifest_table(spark, store.Layout(shared_folder(spark)))
    table.put(rows)
    gone = rows.where("o % 7 = 0").select("object").distinct()
    table.replace(manifest.retain(manifest.delete(table.read(), gone), 3))
    named = rows.select("object", "o").distinct()
    return table.read().join(named, "object").select(F.col("o").alias("object"), "revision", _hex(F.col("content_root")).alias("content_root"))


@plan("SELECT doc_id // 2 AS object, arg_max(coalesce(text, ''), doc_id) AS text FROM documents GROUP BY 1")
def object_read(spark, sf):
    refs, blobs = _ingested(spark, sf, "plain")
    # contents and trees are stored first, as they are read where they lie; otherwise each level would make them anew
    at = store.Layout(shared_folder(spark))
    blob.leaves(refs, "plain").select("doc_id", "blob_id", "ord", "ciphertext_hash", "stored", "node", "ref").write.parquet(at.path("leaves"))
    made = spark.read.parquet(at.path("leaves"))
    blob.rooted(made.select("doc_id", "ord", "ref"), blobs, "doc_id", "plain").write.parquet(at.metadata)
    tops = spark.read.parquet(at.metadata)
    history = tops.select(F.floor(F.col("doc_id") / 2).alias("object"), (F.col("doc_id") % 2).alias("revision"), "root")
    inner = tops.where("chunk_count > 1").select(F.col("root").alias("ref"), F.lit(1).alias("kind"), "node").dropDuplicates(["ref"])
    nodes = made.select("ref", F.lit(0).alias("kind"), "node").dropDuplicates(["ref"]).unionByName(inner)
    got = blob.read_objects(manifest.latest(history), nodes, blob.stored_chunks(made), lambda s, o, c: s)
    return got.select("object", F.decode("data", "UTF-8").alias("text"))


# --- namespaces, handles, histories

_LOG = "(SELECT user_id AS mount, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'release' END AS op, event_id % 97 AS inode, event_id % 50 + 1 AS handle, event_id % 3 <> 0 AS r, event_id % 3 = 0 AS w FROM events)"


@plan(f"""WITH l AS {_LOG}, o AS (SELECT mount, row_number() OVER (PARTITION BY mount ORDER BY seq) AS handle, inode, r, w, seq FROM l WHERE op = 'open')
SELECT o.mount, o.handle, o.inode, o.r AS read, o.w AS write, o.seq AS opened, min(e.seq) AS released FROM o LEFT JOIN l e ON e.op = 'release' AND e.mount = o.mount AND e.handle = o.handle AND e.seq > o.seq GROUP BY ALL""")
def handle_table(spark, sf):
    n = F.col("event_id")
    log = A.table(spark, sf, "events").select(F.col("user_id").alias("mount"), n.alias("seq"), F.when(n % 2 == 0, "open").otherwise("release").alias("op"), (n % 97).alias("inode"), (n % 50 + 1).alias("handle"), (n % 3 != 0).alias("read"), (n % 3 == 0).alias("write"))
    return namespace.handles(log)


@plan(f"""SELECT inode, kind, CASE WHEN kind = 'file' THEN greatest(size, stop) ELSE size END AS size FROM {A.INODES} LEFT JOIN (SELECT o_custkey + 1000 AS inode, max(o_orderkey % 5000 + 4096) AS stop FROM orders GROUP BY 1) USING (inode)""")
def namespace_write(spark, sf):
    writes = A.table(spark, sf, "orders").select((F.col("o_custkey") + 1000).alias("inode"), (F.col("o_orderkey") % 5000).alias("offset"), F.lit(4096).cast("long").alias("bytes"))
    return namespace.written(A.inodes(spark, sf), writes).select("inode", "kind", "size")


@plan(f"""WITH i AS {A.INODES}, n AS (SELECT s_suppkey + 10000000 AS inode, CASE WHEN s_suppkey % 4 = 0 THEN 999999 ELSE CAST(s_nationkey + 200 AS BIGINT) END AS parent, CASE WHEN s_suppkey % 3 = 0 THEN 'shared' ELSE s_name END AS name FROM supplier),
j AS (SELECT n.*, row_number() OVER (PARTITION BY parent, name ORDER BY inode) AS nth FROM n)
SELECT inode, parent, name, CASE WHEN NOT EXISTS (SELECT 1 FROM i WHERE i.inode = j.parent AND kind = 'directory') THEN 'no directory' WHEN nth > 1 THEN 'exists' ELSE 'created' END AS outcome FROM j""")
def namespace_create(spark, sf):
    s = A.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    new = s.select((k + 10_000_000).alias("inode"), F.when(k % 4 == 0, 999_999).otherwise(F.col("s_nationkey") + 200).cast("long").alias("parent"), F.when(k % 3 == 0, "shared").otherwise(F.col("s_name")).alias("name"), F.lit("file").alias("kind"), F.lit(0).cast("long").alias("size"), k.alias("pos"))
    after, refused = namespace.create(A.inodes(spark, sf), new)
    made = after.where("inode > 10000000").select("inode", "parent", "name", F.lit("created").alias("outcome"))
    return made.unionByName(refused.select("inode", "parent", "name", F.col("reason").alias("outcome")))


@plan(f"""WITH i AS {A.INODES}, a AS (SELECT CAST(c_nationkey + 200 AS BIGINT) AS parent, c_name AS name FROM customer),
r AS (SELECT * FROM i WHERE NOT (kind = 'file' AND inode % 2 = 0))
SELECT parent, name, r.inode FROM a LEFT JOIN r USING (parent, name)""")
def namespace_unlink_lookup(spark, sf):
    i = A.inodes(spark, sf)
    left = namespace.remove(i, i.where("inode % 2 = 0").select("inode"), "file")
    asked = A.table(spark, sf, "customer").select((F.col("c_nationkey") + 200).cast("long").alias("parent"), F.col("c_name").alias("name"))
    return namespace.lookup(left, asked)


@plan("SELECT o_orderkey, m & 61440 = 16384 AS directory, m & 61440 = 32768 AS file, m & 61440 = 40960 AS link, m & 40960 <> 0 AS loose_link, m & 511 AS permissions FROM (SELECT o_orderkey, CAST(o_orderkey * 4099 % 65536 AS BIGINT) AS m FROM orders)")
def inode_modes(spark, sf):
    m = (F.col("o_orderkey") * 4099 % 65536).cast("long")
    return A.table(spark, sf, "orders").select("o_orderkey", namespace.is_directory(m).alias("directory"), namespace.is_file(m).alias("file"), namespace.is_symlink(m).alias("link"), namespace.is_symlink(m, True).alias("loose_link"), namespace.permissions(m).alias("permissions"))


@plan(f"SELECT cache, seq, string_agg(CAST(item AS VARCHAR), ',') OVER (PARTITION BY cache ORDER BY seq ROWS 4 PRECEDING) AS recent FROM {A.ACCESSES}")
def access_history(spark, sf):
    return cache.history(A.accesses(spark, sf), 5).select("cache", "seq", F.array_join(F.col("recent").cast("array<string>"), ",").alias("recent"))


@plan("SELECT count(*)::BIGINT AS accesses FROM events")
def lru_replay_totals(spark, sf):
    return cache.totals(cache.replay(A.accesses(spark, sf), 600)).select((F.col("hits") + F.col("misses")).alias("accesses"))


# --- rules, identifiers, times


@plan(f"SELECT event_id, t - u AS since, t < u AS before, t > u AS after, CASE WHEN t >= u THEN t - u END AS elapsed, t // 1000 AS seconds, {A.EVENTS_AS_OF} - t >= {C.CHECK_INTERVAL_MS} AS due, ({A.EVENTS_AS_OF} - t) // 1000 > {C.STALE_SECONDS} AND {A.EVENTS_AS_OF} > t AS stale, 9223372036854775807 AS top, -9223372036854775808 AS bottom FROM (SELECT event_id, epoch_us(ts) // 1000 AS t, {A.EVENTS_AS_OF} + event_id % 1000 AS u FROM events)")
def time_rules(spark, sf):
    t, u, now = F.col("t"), F.col("u"), F.lit(A.EVENTS_AS_OF)
    e = A.table(spark, sf, "events").select("event_id", timing.millis(F.col("ts")).alias("t"), (now + F.col("event_id") % 1000).alias("u"))
    return e.select("event_id", timing.minus(t, u).alias("since"), timing.before(t, u).alias("before"), timing.after(t, u).alias("after"), timing.since(t, u).alias("elapsed"), timing.seconds(t).alias("seconds"), resilience.check_due(t, now).alias("due"), timing.stale(t, now).alias("stale"), timing.plus(t, F.lit(2**63 - 1)).alias("top"), timing.minus(-t, F.lit(2**63 - 1)).alias("bottom"))


@plan("SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS id, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS short, CASE WHEN o_orderkey % 2 = 0 THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS read_back, CASE WHEN o_orderkey % 5 = 0 THEN 9223372036854775807 ELSE o_orderkey + 1 END AS next_revision, o_orderkey % 3 = 0 AS empty FROM orders")
def identifiers(spark, sf):
    k = F.col("o_orderkey")
    id_ = A.node_id(k)
    given = F.when(k % 2 == 0, F.upper(_hex(id_))).otherwise(F.substring(_hex(id_), 1, 62))
    root = F.when(k % 3 == 0, F.lit(C.EMPTY_DAG_REF)).otherwise(id_)
    return A.table(spark, sf, "orders").select("o_orderkey", _hex(id_).alias("id"), ids.short(id_).alias("short"), _hex(ids.from_hex(given)).alias("read_back"), ids.next_revision(F.when(k % 5 == 0, F.lit(2**63 - 1)).otherwise(k)).alias("next_revision"), blob.is_empty(root).alias("empty"))


_URI = f"'{uri.URI_SCHEME}:obj:' || replace(replace(rtrim(base64(unhex(sha256(CAST(o_custkey AS VARCHAR)))), '='), '+', '-'), '/', '_') || ':' || replace(replace(rtrim(base64(unhex(sha256(CAST(o_orderkey AS VARCHAR)))), '='), '+', '-'), '/', '_')"


@plan(f"SELECT o_orderkey, {_URI} AS bare, {_URI} || ':' || (o_orderkey + 1) AS moved, o_orderkey + 1 AS revision FROM orders")
def uri_revisions(spark, sf):
    k = F.col("o_orderkey")
    o = A.table(spark, sf, "orders").select("o_orderkey", uri.object_uri(A.node_id(F.col("o_custkey")), A.node_id(k), k).alias("u"))
    moved = uri.at_revision(F.col("u"), k + 1)
    return o.select("o_orderkey", uri.without_revision(F.col("u")).alias("bare"), moved.alias("moved"), uri.parse(moved)["revision"].alias("revision"))


@plan(f"SELECT event_id, {_le_hex('strlen(props)', 4)} || lower(hex(encode(props))) AS framed, event_id % 24 IN (0, 2, 4, 6, 10, 12, 20, 22) AS request FROM events")
def message_frames(spark, sf):
    return A.table(spark, sf, "events").select("event_id", _hex(messages.framed(F.encode("props", "UTF-8"))).alias("framed"), messages.is_request(F.col("event_id") % 24).alias("request"))


# --- streams with state of their own

_EVENT_LEASES = "(SELECT user_id % 5 AS holder, user_id AS chunk, (epoch_us(ts) // 1000) AS expires_at FROM events)"


@plan(f"SELECT chunk, holder, expires_at FROM ({_merged('holder', 'chunk', 10).replace(A.LEASES, _EVENT_LEASES)})")
def stream_bounded_holders(spark, sf):
    r = _stream(spark, sf, "events").select((F.col("user_id") % 5).alias("chunk"), F.col("user_id").alias("holder"), timing.millis(F.col("ts")).alias("expires_at"))
    return _drained(spark, ingest.bounded_holders(r, 10), "append")


@plan("""WITH k AS (SELECT user_id AS key, max(epoch_us(ts) // 1000) AS moment FROM events GROUP BY 1)
SELECT key, 'stored' AS event, moment FROM k UNION ALL SELECT key, 'expired', moment + 7200000 FROM k WHERE moment + 7200000 < (SELECT max(moment) FROM k)""")
def stream_expiry(spark, sf):
    r = _stream(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", "0 seconds")
    return _drained(spark, ingest.expiring(r, 7_200_000), "append").withColumnRenamed("at", "moment")


@plan("SELECT user_id AS key, max(epoch_us(ts) // 1000) AS ts, arg_max(event_id, (epoch_us(ts) // 1000, event_id)) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, sf):
    folder = shared_folder(spark)
    r = _stream(spark, sf, "events").select(F.col("user_id").alias("key"), timing.millis(F.col("ts")).alias("ts"), "event_id")
    run = ingest.upsert_into(f"{folder}/table", ["key"], ["ts"])
    query = r.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/table/v{query.lastProgress['batchId']}")
