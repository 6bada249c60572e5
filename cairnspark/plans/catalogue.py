"""Named plans over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY_MS, LEASE_TTL_MS, MAX_RECORD_BYTES, MAX_SKEW_MS
from ..functions import crypto, encoding, ids, timing, uri
from ..functions.hashing import gear_table
from ..operators import blob, cache, cdc, manifest, messages, namespace, records, resilience, routing
from ..streaming import ingest
from . import adapters as A

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = F.lit


def plan(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its name."""

    def add(f: Plan) -> Plan:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see. Only where they are one process may none be configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        base = f"file://{tempfile.gettempdir()}/cairnspark-plans"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# --- replica health

_RUNS = f"(SELECT DISTINCT chunk, holder FROM {A.LEASES} WHERE issued_at <= {A.AS_OF} AND expires_at > {A.AS_OF})"


def _health(policy: bool) -> str:
    p = (f"LEFT JOIN {A.POLICY} p USING (chunk)", "coalesce(p.min_replicas, 3)", "coalesce(p.repair_threshold, 3)") if policy else ("", "3", "3")
    return f"""
SELECT *, CASE WHEN status = 'at_risk' THEN greatest(min_replicas - live_holders, 0) END AS missing FROM (
  SELECT *, CASE WHEN live_holders >= repair_threshold THEN 'healthy' WHEN live_holders > 0 THEN 'at_risk' ELSE 'lost' END AS status FROM (
    SELECT chunk, coalesce(n, 0) AS live_holders, CAST({p[2]} AS INTEGER) AS repair_threshold, CAST({p[1]} AS INTEGER) AS min_replicas
    FROM {A.CATALOGUE} LEFT JOIN (SELECT chunk, count(*) AS n FROM {_RUNS} GROUP BY chunk) USING (chunk) {p[0]}))"""


def _report(spark: SparkSession, sf: str, policy: bool = False) -> DataFrame:
    return resilience.health(A.catalogue(spark, sf), A.leases(spark, sf), NOW(A.AS_OF), A.policy(spark, sf) if policy else None)


@plan(_health(False))
def replica_health(spark, sf):
    return _report(spark, sf)


@plan(_health(True))
def health_with_policy(spark, sf):
    return _report(spark, sf, True)


@plan(f"""SELECT *, healthy + at_risk + lost AS total, at_risk + lost AS needs_repair, at_risk + lost = 0 AS all_healthy FROM (
SELECT count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'at_risk') AS at_risk, count(*) FILTER (status = 'lost') AS lost FROM ({_health(False)}))""")
def health_rollup(spark, sf):
    return resilience.rollup(_report(spark, sf))


@plan(f"""SELECT chunk, live_holders AS current, min_replicas AS target, existing_holders FROM ({_health(True)}) JOIN
(SELECT chunk, string_agg(CAST(holder AS VARCHAR), ',' ORDER BY holder) AS existing_holders FROM {_RUNS} GROUP BY chunk) USING (chunk) WHERE status = 'at_risk'""")
def repair_plan(spark, sf):
    tasks = resilience.repair_tasks(_report(spark, sf, True), A.leases(spark, sf), NOW(A.AS_OF))
    return tasks.withColumn("existing_holders", F.array_join(F.col("existing_holders").cast("array<string>"), ","))


@plan(f"""WITH t AS (SELECT chunk, {A.id_words('chunk')} AS tid FROM ({_health(False)}) WHERE status = 'at_risk'),
d AS (SELECT t.chunk, n.node AS holder, {A.xor_words('t.tid', 'n.id')} AS distance FROM t, {A.NODES} n)
SELECT chunk, holder, CAST(rank AS INTEGER) AS rank FROM (SELECT chunk, holder, row_number() OVER (PARTITION BY chunk ORDER BY distance, holder) AS rank FROM d ANTI JOIN {_RUNS} h USING (chunk, holder)) WHERE rank <= 2""")
def repair_candidates_topk(spark, sf):
    tasks = resilience.repair_tasks(_report(spark, sf), A.leases(spark, sf), NOW(A.AS_OF)).withColumn("id", ids.words(A.node_id(F.col("chunk"))))
    return resilience.repair_candidates(tasks, A.nodes(spark, sf).withColumnRenamed("node", "holder"), 2).select("chunk", "holder", "rank")


@plan(f"SELECT chunk, holder, expires_at FROM {A.LEASES} WHERE expires_at - {A.AS_OF} < {LEASE_TTL_MS // 4} AND issued_at <= {A.AS_OF}")
def lease_renewal_due(spark, sf):
    return A.leases(spark, sf).where(timing.needs_renewal(F.col("expires_at"), NOW(A.AS_OF)) & (F.col("issued_at") <= A.AS_OF)).select("chunk", "holder", "expires_at")


@plan(f"SELECT chunk, holder, issued_at, issued_at + {LEASE_TTL_MS - LEASE_TTL_MS // 4} AS renew_at, CASE WHEN expires_at >= {A.AS_OF} THEN expires_at - {A.AS_OF} END AS remaining FROM {A.LEASES}")
def renewal_schedule(spark, sf):
    return A.leases(spark, sf).select("chunk", "holder", "issued_at", timing.renewal_time(F.col("issued_at")).alias("renew_at"), timing.remaining(F.col("expires_at"), NOW(A.AS_OF)).alias("remaining"))


@plan(f"SELECT holder, count(*) FILTER (expires_at > {A.AS_OF}) AS live, count(*) FILTER ({A.AS_OF} > expires_at) AS expired, count(*) AS leases FROM {A.LEASES} GROUP BY holder")
def live_vs_expired_leases(spark, sf):
    e = F.col("expires_at")
    return A.leases(spark, sf).groupBy("holder").agg(F.count_if(timing.live(e, NOW(A.AS_OF))).alias("live"), F.count_if(timing.expired(e, NOW(A.AS_OF))).alias("expired"), F.count("*").alias("leases"))


# --- records


def _merged(chunk: str, holder: str, bound: int) -> str:
    return f"SELECT * FROM (SELECT chunk, holder, expires_at, CAST(row_number() OVER (PARTITION BY chunk ORDER BY expires_at DESC, holder DESC) AS INTEGER) AS rank FROM (SELECT {chunk} AS chunk, {holder} AS holder, max(expires_at) AS expires_at FROM {A.LEASES} GROUP BY ALL)) WHERE rank <= {bound}"


@plan(_merged("holder", "chunk", 64))
def holders_merge_bounded(spark, sf):
    swapped = A.leases(spark, sf).select(F.col("holder").alias("chunk"), F.col("chunk").alias("holder"), "expires_at")
    return records.merge_holders(swapped).select("chunk", "holder", "expires_at", "rank")


@plan(_merged("chunk", "holder", 3))
def holders_merge_small_bound(spark, sf):
    half = A.leases(spark, sf).select("chunk", "holder", "expires_at")
    parts = [records.merge_holders(half.where(F.col("expires_at") % 2 == i), bound=3) for i in (0, 1)]
    return records.merge_sets(*parts, bound=3).select("chunk", "holder", "expires_at", "rank")


@plan(f"SELECT key, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM {A.RECORDS} GROUP BY key")
def node_supersede(spark, sf):
    return records.superseded(A.records(spark, sf).select("key", "ts", "event_id"), ["key"], ["ts"])


@plan(f"SELECT object, revision, modified_at, content_root FROM {A.MANIFESTS} QUALIFY row_number() OVER (PARTITION BY object ORDER BY revision DESC, modified_at DESC, content_root DESC) = 1")
def manifest_supersede(spark, sf):
    return records.superseded(A.manifests(spark, sf).select("object", "revision", "modified_at", "content_root"), ["object"], ["revision", "modified_at"])


@plan(f"SELECT event_id, stored_at FROM {A.RECORDS} WHERE {A.EVENTS_AS_OF} - stored_at < {DAY_MS}")
def record_ttl_expire(spark, sf):
    return records.unexpired(A.records(spark, sf), NOW(A.EVENTS_AS_OF)).select("event_id", "stored_at")


@plan(f"SELECT event_id, abs(ts - stored_at) AS skew, abs(ts - stored_at) <= {MAX_SKEW_MS} AS ok FROM {A.RECORDS}")
def clock_skew_gate(spark, sf):
    return A.records(spark, sf).select("event_id", timing.skew(F.col("ts"), F.col("stored_at")).alias("s")).select("event_id", "s.skew", "s.ok")


@plan(f"SELECT doc_id, CAST(strlen(text) AS BIGINT) + 4 AS size, strlen(text) + 4 <= {MAX_RECORD_BYTES} AS ok FROM documents")
def size_gate(spark, sf):
    size = F.octet_length(encoding.text(F.col("text"))).cast("long")
    return A.table(spark, sf, "documents").select("doc_id", size.alias("size"), (size <= MAX_RECORD_BYTES).alias("ok"))


def _mac_sql(message: str) -> str:
    key = crypto.network_mac_key(A.NETWORK_KEY).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@plan(f"SELECT event_id, {_mac_sql('body')} AS mac, event_id % 5 <> 0 AS valid FROM {A.RECORDS}")
def record_mac_verify(spark, sf):
    body = F.encode("body", "UTF-8")
    r = A.records(spark, sf).withColumn("mac", crypto.record_mac(A.NETWORK_KEY, body))
    received = F.when(F.col("event_id") % 5 == 0, F.unhex(F.sha2(F.col("mac"), 256))).otherwise(F.col("mac"))
    return r.select("event_id", F.lower(F.hex("mac")).alias("mac"), records.mac_ok(A.NETWORK_KEY, body, received).alias("valid"))


@plan(f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS records FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'mac' WHEN strlen(body) * 1000 > {MAX_RECORD_BYTES} THEN 'size' WHEN abs(ts - stored_at) > {MAX_SKEW_MS} THEN 'time' WHEN event_id % 7 = 0 THEN 'signature' WHEN value > 50 THEN 'consistency' END AS reason FROM {A.RECORDS}) GROUP BY 1")
def record_gates(spark, sf):
    r = A.records(spark, sf)
    reason = records.reject_reason(F.col("event_id") % 5 != 0, F.octet_length("body") * 1000, F.col("ts"), F.col("stored_at"), F.col("event_id") % 7 != 0, ~(F.col("value") > 50))
    return r.select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


@plan(f"SELECT kind, count(*) AS records FROM {A.RECORDS} GROUP BY kind")
def record_stats(spark, sf):
    return records.stats(A.records(spark, sf))


# --- versioned objects


@plan(f"SELECT object, revision, content_root, modified_at FROM {A.MANIFESTS} QUALIFY row_number() OVER (PARTITION BY object ORDER BY revision DESC) = 1")
def manifest_latest(spark, sf):
    return manifest.latest(A.manifests(spark, sf)).select("object", "revision", "content_root", "modified_at")


@plan(f"SELECT object, content_root FROM {A.MANIFESTS} WHERE revision = 3")
def manifest_at_revision(spark, sf):
    return manifest.at_revision(A.manifests(spark, sf), F.lit(3)).select("object", "content_root")


@plan(f"SELECT object, count(*) AS revisions, min(revision) AS first_revision, max(revision) AS last_revision FROM {A.MANIFESTS} GROUP BY object")
def manifest_revisions(spark, sf):
    return manifest.revisions(A.manifests(spark, sf))


@plan(f"SELECT object, revision FROM {A.MANIFESTS} QUALIFY row_number() OVER (PARTITION BY object ORDER BY revision DESC) <= 2")
def manifest_retention(spark, sf):
    return manifest.retain(A.manifests(spark, sf), 2).select("object", "revision")


@plan(f"SELECT object, moment, max(revision) AS revision FROM {A.MANIFESTS}, (SELECT unnest([{A.AS_OF - 365 * DAY_MS}, {A.AS_OF}]) AS moment) WHERE modified_at <= moment GROUP BY object, moment")
def manifest_as_of(spark, sf):
    m = A.manifests(spark, sf)
    moments = m.select("object").distinct().withColumn("moment", F.explode(F.array(F.lit(A.AS_OF - 365 * DAY_MS), F.lit(A.AS_OF))))
    return manifest.as_of(m, moments).select("object", "moment", "revision")


@plan("SELECT object, seq, CASE WHEN p IS NOT NULL AND revision <= p THEN 'revision' END AS reason FROM (SELECT object, seq, revision, lag(revision) OVER (PARTITION BY object ORDER BY seq) AS p FROM " + A.MANIFESTS + ")")
def revision_monotonic_audit(spark, sf):
    return manifest.audit(A.manifests(spark, sf), ["seq"]).select("object", "seq", "reason")


@plan(f"""WITH c AS (SELECT DISTINCT object, revision, l_partkey AS chunk FROM {A.MANIFESTS} JOIN lineitem ON l_orderkey = seq),
s AS (SELECT object, revision, lead(revision) OVER (PARTITION BY object ORDER BY revision) AS next FROM (SELECT DISTINCT object, revision FROM c)),
b AS (SELECT c.object, s.next AS revision, chunk FROM c JOIN s USING (object, revision) WHERE next IS NOT NULL)
SELECT object, revision, chunk, CASE WHEN b.chunk IS NULL THEN 'new' WHEN c.chunk IS NULL THEN 'removed' ELSE 'retained' END AS change FROM c FULL JOIN b USING (object, revision, chunk)""")
def revision_chunk_diff(spark, sf):
    lines = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("chunk"))
    return manifest.changed_chunks(A.manifests(spark, sf).join(lines, "seq").select("object", "revision", "chunk"))


# --- content


def _data(c: str = "text"):
    return F.encode(F.col(c), "UTF-8")


@plan("SELECT doc_id, sha256(text) AS blob_id, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def blob_identity(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", ids.to_hex(ids.sha256_id(_data())).alias("blob_id"), F.octet_length("text").cast("long").alias("size"))


@plan("SELECT sha256(text) AS blob_id, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dedup(spark, sf):
    by = A.table(spark, sf, "documents").groupBy(ids.to_hex(ids.sha256_id(_data())).alias("blob_id")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return by.where("copies > 1")


_FIXED = "(SELECT doc_id, CAST(i AS INTEGER) AS ord, substr(hex(encode(text)), CAST(i AS BIGINT) * 1024 + 1, 1024) AS h FROM documents, generate_series(0, 100000) g(i) WHERE i * 512 < strlen(text))"


@plan(f"SELECT sum(n)::BIGINT AS chunks, count(*) AS distinct_chunks, sum(n * size)::BIGINT AS bytes, sum(size)::BIGINT AS distinct_bytes FROM (SELECT h, count(*) AS n, length(h) // 2 AS size FROM {_FIXED} GROUP BY h)")
def dedup_ratio(spark, sf):
    return cdc.dedup_ratio(cdc.identified(cdc.fixed_chunks(A.table(spark, sf, "documents"), "doc_id", _data(), 512)))


@plan(f"SELECT doc_id, ord, length(h) // 2 AS size, CAST(ord AS BIGINT) * 512 AS \"offset\" FROM {_FIXED}")
def chunk_offsets(spark, sf):
    return cdc.offsets(cdc.fixed_chunks(A.table(spark, sf, "documents"), "doc_id", _data(), 512).select("doc_id", "ord", "size"), "doc_id")


@plan("SELECT doc_id, lower(substr(hex(encode(text)), 2 * (doc_id % 700) + 1, 2000)) AS part FROM documents WHERE strlen(text) > doc_id % 700")
def range_read(spark, sf):
    docs = A.table(spark, sf, "documents")
    refs = cdc.fixed_chunks(docs, "doc_id", _data(), 512).select("doc_id", F.col("start").alias("offset"), "size", "bytes")
    ranges = docs.select("doc_id", (F.col("doc_id") % 700).alias("start"), (F.col("doc_id") % 700 + 1000).alias("stop"))
    return blob.read_range(refs, ranges, "doc_id").select("doc_id", ids.to_hex(F.col("data")).alias("part"))


@plan("SELECT sha256(text) AS ciphertext_hash, bool_or(text IN (SELECT text FROM benchmark)) AS found FROM (SELECT text FROM documents UNION SELECT text FROM benchmark) GROUP BY 1")
def chunk_store_contains(spark, sf):
    docs, bench = (A.table(spark, sf, t).select(ids.sha256_id(_data()).alias("ciphertext_hash")).distinct() for t in ("documents", "benchmark"))
    asked = docs.unionByName(bench).distinct().join(bench.withColumn("found", F.lit(True)), "ciphertext_hash", "left")
    return asked.select(ids.to_hex(F.col("ciphertext_hash")).alias("ciphertext_hash"), F.coalesce("found", F.lit(False)).alias("found"))


@plan("SELECT count(*) AS puts, count(DISTINCT text) AS chunks, (SELECT sum(strlen(text))::BIGINT FROM (SELECT DISTINCT text FROM documents)) AS bytes FROM documents")
def chunk_store_totals(spark, sf):
    by = A.table(spark, sf, "documents").groupBy(ids.sha256_id(_data()).alias("h")).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size"))
    return by.agg(F.sum("n").alias("puts"), F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"))


def _cuts_sql() -> str:
    """The closed form: every candidate sum at once, then one recursion step for each cut. Sums are of the last ``w`` bytes,
    and the surplus of bytes before the start of a search is taken off."""
    p = cdc.SMALL
    low = (1 << p.strict) - 1
    gear = "[" + ",".join(str(int(g) & low) for g in gear_table()) + "]"
    s = " + ".join(f"(CAST(coalesce(lag(g, {k}) OVER w, 0) AS BIGINT) << {k})" if k else "g" for k in range(p.strict))
    h = "(b.s - (CAST(coalesce(o.s, 0) AS BIGINT) << least(b.i - (c.cut + {least}) + 1, {bits})) + 1099511627776) & {mask}"
    strict, loose = (h.format(least=p.least, bits=bits, mask=(1 << bits) - 1) for bits in (p.strict, p.loose))
    return f"""
WITH RECURSIVE raw AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
bytes AS (SELECT doc_id, i, ({gear})[CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) + 1] AS g FROM raw, LATERAL (SELECT unnest(range(n)) AS i)),
sums AS (SELECT doc_id, i, ({s}) & {low} AS s FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cuts AS (
  SELECT doc_id, n, CAST(0 AS BIGINT) AS cut, 0 AS ord FROM raw
  UNION ALL
  SELECT c.doc_id, c.n, CASE WHEN c.n - c.cut <= {p.least} THEN c.n ELSE coalesce(min(b.i) FILTER (CASE WHEN b.i - c.cut < {p.target} THEN ({strict}) = 0 ELSE ({loose}) = 0 END) + 1, least(c.cut + {p.most}, c.n)) END, c.ord + 1
  FROM cuts c LEFT JOIN sums o ON o.doc_id = c.doc_id AND o.i = c.cut + {p.least} - 1
  LEFT JOIN sums b ON b.doc_id = c.doc_id AND b.i >= c.cut + {p.least} AND b.i < least(c.cut + {p.most}, c.n)
  WHERE c.cut < c.n GROUP BY c.doc_id, c.n, c.cut, c.ord),
chunks AS (SELECT doc_id, ord - 1 AS ord, lag(cut) OVER (PARTITION BY doc_id ORDER BY ord) AS start, cut AS stop FROM cuts QUALIFY ord > 0)
"""


_CUTS = _cuts_sql()


@plan(f"{_CUTS} SELECT doc_id, CAST(ord AS INTEGER) AS ord, start, stop AS \"end\", stop - start AS size FROM chunks")
def cdc_boundaries(spark, sf):
    cuts = A.table(spark, sf, "documents").select("doc_id", cdc.cut(_data(), cdc.SMALL).alias("cuts"))
    return cuts.select("doc_id", F.posexplode(cdc.spans(F.col("cuts"))).alias("ord", "s")).select("doc_id", "ord", "s.start", "s.end", (F.col("s.end") - F.col("s.start")).alias("size"))


@plan(f"{_CUTS} SELECT count(*) AS chunks, min(stop - start) AS smallest, max(stop - start) AS largest, sum(stop - start)::BIGINT AS bytes FROM chunks")
def cdc_size_stats(spark, sf):
    sizes = cdc.chunks(A.table(spark, sf, "documents"), "doc_id", _data(), cdc.SMALL)
    return sizes.agg(F.count("*").alias("chunks"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.sum("size").alias("bytes"))


@plan(f"{_CUTS} SELECT sum(n)::BIGINT AS chunks, count(*) AS distinct_chunks, sum(n * size)::BIGINT AS bytes, sum(size)::BIGINT AS distinct_bytes FROM (SELECT substr(h, 2 * start + 1, 2 * (stop - start)) AS x, count(*) AS n, any_value(stop - start) AS size FROM chunks JOIN raw USING (doc_id) GROUP BY 1)")
def cdc_dedup(spark, sf):
    return cdc.dedup_ratio(cdc.identified(cdc.chunks(A.table(spark, sf, "documents"), "doc_id", _data(), cdc.SMALL)))


def _ingested(spark: SparkSession, sf: str, profile: str) -> tuple[DataFrame, DataFrame]:
    docs = A.table(spark, sf, "documents")
    return blob.ingest(cdc.fixed_chunks(docs, "doc_id", _data(), 512), docs, "doc_id", _data(), profile)


def _round_trip(spark: SparkSession, sf: str, profile: str) -> DataFrame:
    refs, blobs = _ingested(spark, sf, profile)
    return blob.read(refs, blob.stored_chunks(refs), "doc_id", profile, blobs).select("doc_id", F.decode("data", "UTF-8").alias("text"))


_TEXTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@plan(_TEXTS)
def blob_reassembly(spark, sf):
    return _round_trip(spark, sf, "plain")


@plan(_TEXTS)
def convergent_roundtrip_aes(spark, sf):
    return _round_trip(spark, sf, "builtin")


@plan(_TEXTS)
def conformant_roundtrip(spark, sf):
    docs = A.table(spark, sf, "documents")
    refs, blobs = blob.ingest(cdc.chunks(docs, "doc_id", _data()), docs, "doc_id", _data(), "conformant")
    return blob.read(refs, blob.stored_chunks(refs), "doc_id", "conformant", blobs).select("doc_id", F.decode("data", "UTF-8").alias("text"))


def _le_hex(x: str, width: int) -> str:
    return " || ".join(f"substr(printf('%016x', {x}), {15 - 2 * i}, 2)" for i in range(width))


_LEAF = f"""(SELECT doc_id, ord, sha256(unhex('00000000' || c || c || c || {_le_hex('size', 8)} || {_le_hex('size', 4)} || '01000000' || {_le_hex('CAST(ord AS BIGINT) * 512', 8)} || {_le_hex('size', 4)})) AS ref
FROM (SELECT doc_id, ord, sha256(unhex(h)) AS c, length(h) // 2 AS size FROM {_FIXED}))"""
_DAG = f"""(SELECT doc_id, count(*) AS n, string_agg(ref, '' ORDER BY ord) AS refs FROM {_LEAF} GROUP BY doc_id)"""
_ROOT = f"CASE WHEN n IS NULL THEN '98406f28ac2f17f4fa1b6f756a51a6b91b1d953f466a5e7730f9ee6acc7c3e59' WHEN n = 1 THEN refs ELSE sha256(unhex('01000000' || {_le_hex('n', 4)} || refs)) END"


@plan(f"SELECT doc_id, sha256(text) AS blob_id, {_ROOT} AS root, CAST(strlen(text) AS BIGINT) AS size, CAST(coalesce(n, 0) AS INTEGER) AS chunk_count FROM documents LEFT JOIN {_DAG} USING (doc_id)")
def dag_build(spark, sf):
    refs, blobs = _ingested(spark, sf, "plain")
    return blob.dag(refs, blobs, "doc_id", "plain").select("doc_id", ids.to_hex(F.col("blob_id")).alias("blob_id"), ids.to_hex(F.col("root")).alias("root"), "size", "chunk_count")


@plan(f"""WITH d AS (SELECT DISTINCT ON (root) n, refs, root FROM (SELECT n, refs, {_ROOT} AS root FROM {_DAG}))
SELECT root, '' AS path, root AS ref, CASE WHEN n = 1 THEN 0 ELSE 1 END AS kind FROM d
UNION ALL SELECT root, CAST(i AS VARCHAR), substr(refs, CAST(64 * i + 1 AS BIGINT), 64), 0 FROM d, generate_series(0, 100000) g(i) WHERE n > 1 AND i < n""")
def dag_walk(spark, sf):
    refs, blobs = _ingested(spark, sf, "plain")
    made = blob.leaves(refs, "plain")
    tops = made.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "ref"))).alias("l")).select(F.transform("l", lambda x: x["ref"]).alias("children"))
    inner = tops.where(F.size("children") > 1).select(ids.sha256_id(encoding.internal_node(F.col("children"))).alias("ref"), F.lit(1).alias("kind"), "children")
    nodes = made.select("ref", F.lit(0).alias("kind"), F.array().cast("array<binary>").alias("children")).unionByName(inner).dropDuplicates(["ref"])
    roots = blob.dag(refs, blobs, "doc_id", "plain").where("chunk_count > 0").select("root").distinct()
    out = blob.walk(nodes, roots)
    return out.select(ids.to_hex(F.col("root")).alias("root"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), ids.to_hex(F.col("ref")).alias("ref"), "kind")


# --- encoding, identifiers


@plan(f"SELECT event_id, {_le_hex('(epoch_us(ts) // 1000)', 8)} AS encoded FROM events")
def canonical_encode_timestamp(spark, sf):
    return A.table(spark, sf, "events").select("event_id", ids.to_hex(encoding.u64(timing.millis(F.col("ts")))).alias("encoded"))


@plan(f"SELECT doc_id, {_le_hex('strlen(text)', 4)} || lower(hex(encode(text))) AS encoded FROM documents")
def canonical_encode_string(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", ids.to_hex(encoding.text(F.col("text"))).alias("encoded"))


@plan(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '00' ELSE '01' || {_le_hex('user_id', 4)} END AS encoded FROM events")
def canonical_encode_option(spark, sf):
    some = F.when(F.col("event_id") % 3 != 0, F.col("user_id"))
    return A.table(spark, sf, "events").select("event_id", ids.to_hex(encoding.option(some, encoding.u32)).alias("encoded"))


@plan(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_le_hex('o_orderkey', 8)}) AS place FROM orders")
def canonical_sort(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(encoding.u64(F.col("o_orderkey")))
    return A.table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@plan(f"""SELECT target, node, CAST(rank AS INTEGER) AS rank FROM (SELECT target, node, row_number() OVER (PARTITION BY target ORDER BY {A.xor_words('tid', 'id')}, node) AS rank
FROM (SELECT c_custkey AS target, {A.id_words('c_custkey')} AS tid FROM customer), {A.NODES}) WHERE rank <= 3""")
def xor_knn(spark, sf):
    targets = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("target"), ids.words(A.node_id(F.col("c_custkey"))).alias("id"))
    return routing.nearest(targets, A.nodes(spark, sf), 3).select("target", "node", "rank")


_DISTANCE = f"(SELECT node, {A.xor_words('id', A.id_words('1'))} AS d FROM {A.NODES})"
_ZEROS = "coalesce(" + ", ".join(f"CASE WHEN d[{i + 1}] <> 0 THEN {32 * i + 32} - length(ltrim(bin(d[{i + 1}]), '0')) END" for i in range(8)) + ", 256)"


def _local():
    return ids.words(A.node_id(F.lit(1)))


@plan(f"SELECT node, CAST({_ZEROS} AS INTEGER) AS zeros FROM {_DISTANCE}")
def leading_zeros(spark, sf):
    return A.nodes(spark, sf).select("node", ids.leading_zeros(ids.distance(F.col("id"), _local())).alias("zeros"))


@plan(f"SELECT CAST(255 - z AS INTEGER) AS bucket, count(*) AS nodes FROM (SELECT {_ZEROS} AS z FROM {_DISTANCE}) WHERE z < 256 GROUP BY 1")
def bucket_histogram(spark, sf):
    return routing.histogram(A.nodes(spark, sf), _local())


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    return A.records(spark, sf).select((F.col("key") % 8).alias("bucket"), F.col("key").alias("node"), F.col("event_id").alias("seen_at"))


@plan(f"SELECT bucket, node, first_seen, last_seen, row_number() OVER (PARTITION BY bucket ORDER BY first_seen, node) <= 10 AS resident FROM (SELECT key % 8 AS bucket, key AS node, min(event_id) AS first_seen, max(event_id) AS last_seen FROM {A.RECORDS} GROUP BY ALL)")
def bucket_residency(spark, sf):
    return routing.resident(_sightings(spark, sf), 10)


@plan()
def bucket_replay(spark, sf):
    return routing.replay(_sightings(spark, sf), 10)


@plan()
def iterative_lookup(spark, sf):
    nodes = A.nodes(spark, sf)
    near = routing.nearest(nodes.select(F.col("node").alias("target"), "id"), nodes, 8)
    known = near.join(nodes.select("node", "id"), "node").select(F.col("target").alias("node"), F.col("node").alias("neighbour"), F.col("id").alias("neighbour_id"))
    start = nodes.orderBy("node").limit(3)
    return routing.lookup(nodes.orderBy(F.desc("node")).limit(1), start, known, k=5)


_B64 = "replace(replace(rtrim(base64(unhex({0})), '='), '+', '-'), '/', '_')"
_OBJ = f"'{uri.URI_SCHEME}:obj:' || {_B64.format('sha256(CAST(o_custkey AS VARCHAR))')} || ':' || {_B64.format('sha256(CAST(o_orderkey AS VARCHAR))')} || CASE WHEN o_orderkey % 2 = 0 THEN ':' || CAST(o_orderkey AS VARCHAR) ELSE '' END"


def _uris(spark: SparkSession, sf: str) -> DataFrame:
    o, k = F.col("o_custkey"), F.col("o_orderkey")
    return A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", uri.object_uri(A.node_id(o), A.node_id(k), F.when(k % 2 == 0, k)).alias("uri"))


@plan(f"SELECT o_orderkey, {_OBJ} AS uri FROM orders")
def uri_build(spark, sf):
    return _uris(spark, sf).select("o_orderkey", "uri")


@plan("""SELECT o_orderkey, CASE WHEN bad THEN NULL ELSE 'object' END AS kind, CASE WHEN bad THEN NULL ELSE sha256(CAST(o_custkey AS VARCHAR)) END AS id, CASE WHEN NOT bad AND o_orderkey % 2 = 0 THEN o_orderkey END AS revision, CASE WHEN bad THEN 'type' END AS error
FROM (SELECT *, o_orderkey % 10 = 0 AS bad FROM orders)""")
def uri_parse(spark, sf):
    broken = F.when(F.col("o_orderkey") % 10 == 0, F.regexp_replace("uri", ":obj:", ":tree:")).otherwise(F.col("uri"))
    return _uris(spark, sf).select("o_orderkey", uri.parse(broken).alias("u")).select("o_orderkey", "u.kind", ids.to_hex(F.col("u.id")).alias("id"), "u.revision", "u.error")


# --- namespace


@plan(f"""WITH i AS {A.INODES}, d AS (SELECT * FROM i WHERE kind = 'directory')
SELECT inode AS parent, 0 AS place, '.' AS name, inode FROM d UNION ALL SELECT inode, 1, '..', parent FROM d
UNION ALL SELECT parent, CAST(1 + row_number() OVER (PARTITION BY parent ORDER BY pos, inode) AS INTEGER), name, inode FROM i WHERE parent <> inode""")
def namespace_list(spark, sf):
    return namespace.listing(A.inodes(spark, sf))


@plan(f"""WITH i AS {A.INODES}, c AS (SELECT parent AS inode, count(*) AS n FROM i WHERE parent <> inode GROUP BY 1)
SELECT inode, kind, size, CAST(ceil(size / 512) AS BIGINT) AS blocks, CASE WHEN kind = 'directory' THEN 2 + coalesce(n, 0) ELSE 1 END AS nlink, 4096 AS block_size FROM i LEFT JOIN c USING (inode)""")
def namespace_stat(spark, sf):
    return namespace.stat(A.inodes(spark, sf))


@plan(f"""WITH RECURSIVE i AS {A.INODES}, p AS (SELECT inode, '' AS path, 0 AS level FROM i WHERE inode = parent
UNION ALL SELECT i.inode, p.path || '/' || i.name, p.level + 1 FROM p JOIN i ON i.parent = p.inode AND i.inode <> i.parent) SELECT * FROM p""")
def namespace_paths(spark, sf):
    return namespace.paths(A.inodes(spark, sf))


@plan("""WITH u AS (SELECT list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p, CAST(strlen(html) AS BIGINT) AS size FROM pages),
e AS (SELECT p, size, unnest(range(1, len(p) + 1)) AS n FROM u WHERE len(p) > 0)
SELECT '/' || array_to_string(p[1:n - 1], '/') AS dir, p[n] AS name, min(CASE WHEN n = len(p) THEN 'file' ELSE 'directory' END) AS kind, max(CASE WHEN n = len(p) THEN size ELSE 0 END) AS size FROM e GROUP BY 1, 2""")
def namespace_from_urls(spark, sf):
    return namespace.from_paths(A.table(spark, sf, "pages"), F.regexp_replace("url", "^[a-z]+://", ""), F.octet_length("html"))


# --- messages, caches, connections

_TAGS = [0, 2, 4, 6, 10, 12, 20, 22, 1, 99]


@plan(f"""WITH r AS (SELECT event_id AS request_id, [{','.join(map(str, _TAGS))}][event_id % 10 + 1] AS tag, event_id % 400 AS key FROM events),
f AS (SELECT r.*, key IN (SELECT s_suppkey FROM supplier) AS n, key IN (SELECT o_custkey FROM orders) AS m, key IN (SELECT l_orderkey FROM lineitem) AS h FROM r)
SELECT request_id, CASE tag WHEN 0 THEN 'Pong' WHEN 2 THEN 'FindNodeResponse' WHEN 4 THEN 'StoreRecordResponse' WHEN 6 THEN 'FindValueResponse' WHEN 20 THEN 'GetManifestResponse' WHEN 22 THEN 'PublishManifestResponse' WHEN 10 THEN 'Error' WHEN 12 THEN 'Error' END AS answer,
CASE tag WHEN 2 THEN 'closest' WHEN 6 THEN CASE WHEN n THEN 'node' WHEN m THEN 'manifest' WHEN h THEN 'holders' ELSE 'closest' END WHEN 20 THEN CASE WHEN m THEN 'manifest' ELSE 'none' END END AS source FROM f""")
def message_dispatch(spark, sf):
    tags = F.array(*[F.lit(t) for t in _TAGS])
    r = A.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.get(tags, (F.col("event_id") % 10).cast("int")).alias("tag"), (F.col("event_id") % 400).alias("key"))
    side = lambda t, c: A.table(spark, sf, t).select(F.col(c).alias("key"))
    return messages.answers(r, side("supplier", "s_suppkey"), side("orders", "o_custkey"), side("lineitem", "l_orderkey"))


@plan("SELECT event_id, CASE event_id % 300 WHEN 0 THEN 'Ping' WHEN 1 THEN 'Pong' WHEN 2 THEN 'FindNode' WHEN 3 THEN 'FindNodeResponse' WHEN 4 THEN 'StoreRecord' WHEN 5 THEN 'StoreRecordResponse' WHEN 6 THEN 'FindValue' WHEN 7 THEN 'FindValueResponse' WHEN 10 THEN 'GetChunk' WHEN 11 THEN 'GetChunkResponse' WHEN 12 THEN 'StoreChunk' WHEN 13 THEN 'StoreChunkResponse' WHEN 20 THEN 'GetManifest' WHEN 21 THEN 'GetManifestResponse' WHEN 22 THEN 'PublishManifest' WHEN 23 THEN 'PublishManifestResponse' WHEN 255 THEN 'Error' END AS kind, CASE event_id % 9 WHEN 1 THEN 'NotFound' WHEN 2 THEN 'InvalidRequest' WHEN 3 THEN 'AuthFailed' WHEN 4 THEN 'Timeout' WHEN 5 THEN 'StorageFull' WHEN 6 THEN 'RateLimited' ELSE 'Unknown' END AS error FROM events")
def message_kinds(spark, sf):
    return A.table(spark, sf, "events").select("event_id", messages.kind(F.col("event_id") % 300).alias("kind"), messages.error_name(F.col("event_id") % 9).alias("error"))


@plan("SELECT event_id, event_id AS request_id, CAST(event_id % 23 AS INTEGER) AS tag, sha256(CAST(user_id AS VARCHAR)) AS sender, props AS payload FROM events")
def message_envelopes(spark, sf):
    e = A.table(spark, sf, "events")
    sent = messages.envelope(F.col("event_id"), A.node_id(F.col("user_id")), F.col("event_id") % 23, F.encode("props", "UTF-8"))
    raw = e.select("event_id", sent.alias("raw"))  # made once, not wherever it is read
    return raw.select("event_id", messages.opened(F.col("raw")).alias("m")).select("event_id", "m.request_id", "m.tag", ids.to_hex(F.col("m.sender")).alias("sender"), F.decode("m.payload", "UTF-8").alias("payload"))


@plan(f"SELECT connection, coalesce(arg_max(event, (ts, event)) FILTER (event IN ('Connected', 'Disconnected')), 'Connecting') AS state, count(*) FILTER (event = 'sent') AS sent, count(*) FILTER (event = 'received') AS received, coalesce(sum(bytes) FILTER (event = 'sent'), 0)::BIGINT AS bytes_sent, coalesce(sum(bytes) FILTER (event = 'received'), 0)::BIGINT AS bytes_received, {A.EVENTS_AS_OF} - min(ts) AS duration_ms, {A.EVENTS_AS_OF} - max(ts) AS idle_ms FROM {A.CONNECTION_LOG} GROUP BY connection")
def connection_counters(spark, sf):
    return messages.connections(A.connection_log(spark, sf), NOW(A.EVENTS_AS_OF))


@plan()
def lru_replay_stats(spark, sf):
    return cache.replay(A.accesses(spark, sf), 600)


@plan(f"SELECT cache, item, last_seq, CAST(row_number() OVER (PARTITION BY cache ORDER BY last_seq, item) AS INTEGER) AS rank FROM (SELECT cache, item, max(seq) AS last_seq FROM {A.ACCESSES} GROUP BY ALL)")
def lru_recency(spark, sf):
    return cache.recency(A.accesses(spark, sf))


@plan(f"SELECT cache, seq, item, least(row_number() OVER (PARTITION BY cache ORDER BY seq), 8) AS history, row_number() OVER (PARTITION BY cache ORDER BY seq) >= 2 AS is_sequential FROM {A.ACCESSES}")
def sequential_access(spark, sf):
    return cache.sequential(A.accesses(spark, sf)).select("cache", "seq", "item", "history", "is_sequential")


# --- streams


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all files; its checkpoint and rows lie in the shared folder."""
    return ingest.drained(df, mode, shared_folder(spark))


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(A.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


@plan("SELECT user_id AS key, max((epoch_us(ts) // 1000)) AS ts, arg_max(event_id, ((epoch_us(ts) // 1000), event_id)) AS event_id FROM events GROUP BY 1")
def stream_supersede(spark, sf):
    r = _stream(spark, sf, "events").select(F.col("user_id").alias("key"), timing.millis(F.col("ts")).alias("ts"), "event_id")
    return _drained(spark, ingest.latest(r, ["key"], ["ts"]), "complete")


@plan(_merged("holder", "chunk", 64).replace(A.LEASES, "(SELECT user_id % 5 AS holder, user_id AS chunk, (epoch_us(ts) // 1000) AS expires_at FROM events)"))
def stream_holders(spark, sf):
    r = _stream(spark, sf, "events").select((F.col("user_id") % 5).alias("chunk"), F.col("user_id").alias("holder"), timing.millis(F.col("ts")).alias("expires_at"))
    best = _drained(spark, ingest.holder_leases(r), "complete")
    return records.merge_holders(best).select("chunk", "holder", "expires_at", "rank")


@plan(f"SELECT event_id, ts, stored_at FROM {A.RECORDS} WHERE abs(ts - stored_at) <= {MAX_SKEW_MS}")
def stream_skew_gate(spark, sf):
    ts = timing.millis(F.col("ts"))
    r = _stream(spark, sf, "events").select("event_id", ts.alias("ts"), (ts + (F.col("event_id") % 21 - 10) * 60_000).alias("stored_at"))
    return _drained(spark, ingest.timely(r, "ts", "stored_at"), "append")
