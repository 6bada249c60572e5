import random

import pytest
from pyspark.sql import functions as F

from cairnspark import constants as C
from cairnspark.functions import encoding, ids, uri
from cairnspark.functions.hashing import blake3, gear_table
from cairnspark.operators import blob, cache, cdc, manifest, namespace, records, resilience, routing
from cairnspark.repository import Repository, new_object_uri
from cairnspark.sources import store
from cairnspark.streaming import ingest


def literal(data, p):
    """Chunking byte by byte."""
    gear, cuts, pos = [int(g) for g in gear_table()], [0], 0
    while pos < len(data):
        if len(data) - pos <= p.least:
            cuts.append(len(data))
            break
        h, end = 0, min(pos + p.most, len(data))
        for i in range(pos + p.least, end):
            h = (2 * h + gear[data[i]]) % 2**64
            if h % (1 << (p.strict if i - pos < p.target else p.loose)) == 0:
                end = i + 1
                break
        cuts.append(end)
        pos = end
    return cuts


def test_boundaries_equal_literal_algorithm():
    r = random.Random(1)
    for p in (cdc.SMALL, cdc.Parameters(4, 16, 64, 4, 3), cdc.Parameters(1, 2, 9, 5, 2), cdc.Parameters(30, 20, 40, 3, 2)):
        for n in [0, 1, 2, 5, 30, 255, 256, 257, 300, 1000, 5000, 20_000]:
            for data in (r.randbytes(n), bytes(n), bytes(i % 256 for i in range(n))):
                assert cdc.boundaries(data, p) == literal(data, p)


def test_default_parameters():
    assert cdc.boundaries(b"") == [0] and cdc.boundaries(bytes(1000)) == [0, 1000] and cdc.boundaries(bytes(65_536)) == [0, 65_536]
    data = random.Random(2).randbytes(3 << 20)
    cuts = cdc.boundaries(data)
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    assert sum(sizes) == len(data) and all(s > 65_536 for s in sizes[:-1]) and max(sizes) <= 1 << 20
    shifted = cdc.boundaries(b"x" * 100 + data)
    assert len({c - 100 for c in shifted} & set(cuts)) > len(cuts) // 2  # cuts find back to the content


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"")), (2, None), (3, bytearray(random.Random(3).randbytes(9000)))], "doc_id long, b binary")
    got = cdc.chunks(df, "doc_id", F.col("b"), cdc.SMALL).orderBy("ord").collect()
    assert {r.doc_id for r in got} == {3} and b"".join(bytes(r.bytes) for r in got) == bytes(df.collect()[2].b)
    fixed = cdc.fixed_chunks(df, "doc_id", F.col("b"), 4000).orderBy("ord").collect()
    assert [(r.start, r.end, r.size) for r in fixed] == [(0, 4000, 4000), (4000, 8000, 4000), (8000, 9000, 1000)]


@pytest.mark.parametrize("profile", ["plain", "builtin", "conformant"])
def test_blob_round_trip_and_tampering(spark, profile):
    df = spark.createDataFrame([(1, bytearray(b"abc" * 500)), (2, bytearray(b"")), (3, bytearray(b"abc" * 500)), (4, bytearray(b"x"))], "doc_id long, b binary")
    refs, whole = blob.ingest(cdc.fixed_chunks(df, "doc_id", F.col("b"), 600), df, "doc_id", F.col("b"), profile)
    refs = refs.cache()
    kept = blob.stored_chunks(refs).cache()
    assert kept.count() == (3 if profile == "plain" else kept.count())  # equal blobs converge and equal chunks of one blob are one
    assert kept.count() == refs.select("blob_id", "chunk_id").distinct().count()
    assert {r.doc_id: bytes(r.data) for r in blob.read(refs, kept, "doc_id", profile).collect()} == {1: b"abc" * 500, 3: b"abc" * 500, 4: b"x"}
    meta = {r.doc_id: r for r in blob.dag(refs, whole, "doc_id", profile).collect()}
    assert bytes(meta[2].root) == C.EMPTY_DAG_REF and meta[1].root == meta[3].root and meta[1].chunk_count == 3 and len(meta[1].node) == 8 + 3 * 32 and meta[4].node is None
    for broken, fault in ((kept.limit(0), "missing chunk"), (kept.withColumn("stored", F.concat("stored", F.lit(b"!"))), "stored bytes differ")):
        with pytest.raises(Exception, match=fault):
            blob.read(refs, broken, "doc_id", profile).collect()


def test_conformant_empty_blob(spark):
    row = spark.createDataFrame([(bytearray(b""),)], "b binary").select(blake3(F.col("b")).alias("h")).first()
    assert bytes(row.h) == C.EMPTY_BLOB_ID


def test_encoded_sizes(spark):
    h = F.lit(bytes(32))
    body = F.struct(F.lit(1).alias("crypto_version"), h.alias("object_id"), F.lit(1).alias("revision"), h.alias("content_root"), F.lit(1).alias("created_at"), F.lit(1).alias("modified_at"), F.struct(h.alias("public_key"), h.alias("node_id")).alias("origin"))
    com = F.struct(h.alias("merkle_root"), F.lit(1).alias("size"), F.lit(1).alias("block_size"), F.lit(1).alias("block_count"))
    ref = F.struct(h.alias("chunk_id"), h.alias("ciphertext_hash"), com.alias("commitment"), F.lit(0).alias("offset"), F.lit(1).alias("size"))
    lease = F.struct(h.alias("chunk_id"), h.alias("ciphertext_hash"), com.alias("commitment"), h.alias("holder"), h.alias("issuer"), F.lit(1).alias("issued_at"), F.lit(1).alias("expires_at"))
    size = lambda c: F.octet_length(c)
    r = spark.range(1).select(size(encoding.manifest_body(body)), size(encoding.leaf_node(ref)), size(encoding.lease_body(lease)), size(encoding.internal_node(F.array(h, h))), size(encoding.entry_node(F.lit("ab"), F.lit(1), F.lit(1), h)), size(encoding.blob_metadata(h, F.lit(1), F.lit(1)))).first()
    assert tuple(r) == (156, 128, 192, 72, 54, 44)


def test_write_and_read_range(spark):
    r = spark.range(1).select(blob.write_range(F.lit(b"abcdef"), F.lit(2), F.lit(b"XY")).alias("a"), blob.write_range(F.lit(b"ab"), F.lit(4), F.lit(b"Z")).alias("b")).first()
    assert (bytes(r.a), bytes(r.b)) == (b"abXYef", b"ab\0\0Z")


def test_store(spark, tmp_path):
    s = store.ChunkStore(spark, store.Layout(f"file://{tmp_path}/s"))
    assert s.read().count() == 0
    df = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),)], "stored binary")
    s.put_bytes(df)
    s.put_bytes(df)
    assert tuple(s.stats().first()) == (2, 2) and s.checked().count() == 2
    key = s.get(ciphertext_hash=bytes(s.read().where("stored = X'61'").first().ciphertext_hash))
    assert bytes(key.first().stored) == b"a"
    asked = df.select(ids.sha256_id(F.col("stored")).alias("ciphertext_hash")).distinct().unionByName(spark.range(1).select(F.lit(bytes(32)).alias("ciphertext_hash")))
    assert sorted(r.found for r in s.contains(asked).collect()) == [False, True, True]
    gone = spark.createDataFrame(key.collect(), key.schema)
    s.delete(gone)
    s.delete(gone)
    assert s.read().count() == 1 and [len(r.ciphertext_hash) for r in s.keys_in_order().collect()] == [32]


LEASE = "chunk long, holder long, expires_at long"


def test_holder_merge_laws(spark):
    r = random.Random(4)
    sets = [spark.createDataFrame([(r.randrange(2), r.randrange(120), r.randrange(50)) for _ in range(150)], LEASE) for _ in range(3)]
    rows = lambda df: sorted(map(tuple, df.select("chunk", "holder", "expires_at", "rank").collect()))
    a, b, c = (records.merge_holders(s) for s in sets)
    m = records.merge_sets
    assert rows(m(a, b)) == rows(m(b, a)) and rows(m(m(a, b), c)) == rows(m(a, m(b, c))) and rows(m(a, a)) == rows(a)
    assert a.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 64


def test_gates_in_order(spark):
    t = F.lit(10**9)
    ok = dict(mac_ok=F.lit(True), size=F.lit(1), ts=t, as_of=t)
    cases = [ok, ok | {"mac_ok": F.lit(False), "size": F.lit(10**6)}, ok | {"size": F.lit(65_537)}, ok | {"ts": t + 300_001}, ok | {"ts": F.lit(None)}, ok | {"signature_ok": F.lit(False)}, ok | {"consistent": F.lit(False)}, ok | {"mac_ok": F.lit(None)}]
    assert list(spark.range(1).select(*[records.reject_reason(**c).alias(f"c{i}") for i, c in enumerate(cases)]).first()) == [None, "mac", "size", "time", None, "signature", "consistency", "mac"]


def test_health(spark):
    leases = spark.createDataFrame([(1, h, 0, 100) for h in range(3)] + [(2, 7, 0, 100), (2, 7, 0, 90), (3, 1, 0, 50), (3, 2, 60, 100), (3, 4, 0, 40)], "chunk long, holder long, issued_at long, expires_at long")
    report = resilience.health(spark.range(1, 5).toDF("chunk"), leases, F.lit(50))
    assert {r.chunk: (r.live_holders, r.status, r.missing) for r in report.collect()} == {1: (3, "healthy", None), 2: (1, "at_risk", 2), 3: (0, "lost", None), 4: (0, "lost", None)}
    assert tuple(resilience.rollup(report).first()) == (1, 1, 2, 4, 3, False)
    assert [(r.chunk, r.current, r.target, list(r.existing_holders)) for r in resilience.repair_tasks(report, leases, F.lit(50)).collect()] == [(2, 1, 3, [7])]


def test_successors(spark):
    make = lambda o, r, g: F.struct(F.lit(o).alias("object"), F.lit(r).alias("revision"), F.lit(g).alias("origin"))
    a = make(1, 5, 9)
    got = spark.range(1).select(*[manifest.successor_reason(a, b).alias(f"c{i}") for i, b in enumerate([make(1, 9, 9), make(2, 6, 9), make(1, 5, 9), make(1, 6, 8)])]).first()
    assert list(got) == [None, "object", "revision", "origin"]


def test_bucket_replay(spark):
    seen = spark.createDataFrame([(0, n, i) for i, n in enumerate([1, 2, 1, 3, 4, 3, 5])], "bucket long, node long, seen_at long")
    got = {(r.kind, r.place): r.node for r in routing.replay(seen, 2).collect()}
    assert got == {("node", 0): 2, ("node", 1): 1, ("replacement", 0): 3, ("replacement", 1): 5}


def test_cache_replay(spark):
    acc = spark.createDataFrame([(1, i, x, 100) for i, x in enumerate([1, 2, 1, 3, 2, 1])] + [(2, 0, 9, 999)], "cache long, seq long, item long, bytes long")
    got = {r.cache: tuple(r)[1:] for r in cache.replay(acc, 200).collect()}
    assert got == {1: (1, 5, 3, 500, 2, 200), 2: (0, 1, 0, 999, 1, 999)}


def test_namespace(spark):
    t = spark.createDataFrame([(1, 1, "", "directory", 0, 0), (2, 1, "a", "directory", 0, 1), (3, 2, "f", "file", 513, 2)], "inode long, parent long, name string, kind string, size long, pos long")
    new = spark.createDataFrame([(4, 2, "g", "file", 1, 3), (5, 2, "f", "file", 1, 4), (6, 3, "h", "file", 1, 5), (7, 2, "g", "file", 1, 6)], t.schema)
    out, refused = namespace.create(t, new)
    assert {r.inode for r in out.collect()} == {1, 2, 3, 4} and {r.inode: r.reason for r in refused.collect()} == {5: "exists", 6: "no directory", 7: "exists"}
    assert {r.inode for r in namespace.remove(t, spark.createDataFrame([(1,), (2,), (3,)], "inode long"), "directory").collect()} == {1, 2, 3}
    assert {r.inode for r in namespace.remove(t, spark.createDataFrame([(2,), (3,)], "inode long"), "file").collect()} == {1, 2}
    assert [(r.place, r.name) for r in namespace.listing(t, 1, 2).where("parent = 1").orderBy("place").collect()] == [(1, ".."), (2, "a")]
    mode = F.lit(0o100644)
    assert tuple(spark.range(1).select(namespace.is_file(mode), namespace.is_symlink(mode), namespace.is_symlink(mode, True), namespace.permissions(mode)).first()) == (True, False, True, 0o644)


def test_streams(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = [(1, h, 100 + h) for h in range(6)] + [(1, 0, 500), (2, 9, 1)]
    spark.createDataFrame(rows, LEASE).repartition(3).write.parquet(src)
    stream = ingest.source(spark, src, spark.read.parquet(src).schema, files=1)
    log = ingest.drained(ingest.bounded_holders(stream, 3), "append", f"file://{tmp_path}/c1")
    last = records.merge_holders(log, bound=3)
    want = records.merge_holders(spark.createDataFrame(rows, LEASE), bound=3)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    table = f"file://{tmp_path}/t"
    run = ingest.upsert_into(table, ["chunk", "holder"], ["expires_at"])
    for i, part in enumerate([rows[:5], rows[5:], rows[:2]]):
        run(spark.createDataFrame(part, LEASE), i)
        run(spark.createDataFrame(part, LEASE), i)
    got = spark.read.parquet(f"{table}/v2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, records.superseded(spark.createDataFrame(rows, LEASE), ["chunk", "holder"], ["expires_at"]).collect()))


def test_stream_expiry(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    for rows in [[(1, 0)], [(1, 50)], [(3, 400)], [(3, 401)]]:
        spark.createDataFrame(rows, "key long, s long").select("key", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(src)
    stream = ingest.source(spark, src, spark.read.parquet(src).schema, files=1).withWatermark("at", "1 second")
    got = {(r.key, r.event) for r in ingest.drained(ingest.expiring(stream, 100_000), "append", f"file://{tmp_path}/c").collect()}
    assert {(1, "expired"), (1, "stored"), (3, "stored")} <= got and (3, "expired") not in got


def test_lookup_ends_when_all_of_the_nearest_were_asked(spark):
    words = lambda n: [0] * 7 + [n]
    target = spark.createDataFrame([(0, words(0))], "node long, id array<bigint>")
    start = spark.createDataFrame([(25, words(25))], "node long, id array<bigint>")
    chain = spark.createDataFrame([(n, n - 1, words(n - 1)) for n in range(1, 26)], "node long, neighbour long, neighbour_id array<bigint>")
    assert [tuple(r) for r in routing.lookup(target, start, chain, k=2, alpha=1).orderBy("rank").collect()] == [(0, 1), (1, 2)]


def test_paths_of_a_deep_tree_and_of_a_cycle(spark):
    rows = [(1, 1, "")] + [(i, i - 1, f"n{i}") for i in range(2, 37)] + [(90, 91, "a"), (91, 90, "b")]
    got = {r.inode: (r.path, r.level) for r in namespace.paths(spark.createDataFrame(rows, "inode long, parent long, name string")).collect()}
    assert len(got) == 36 and got[36] == ("".join(f"/n{i}" for i in range(2, 37)), 35)


def test_nearest_equals_brute_force(spark):
    r = random.Random(6)
    whole = lambda: [r.randrange(2**32) for _ in range(8)]
    for nodes in ([whole() for _ in range(300)], [[0, 0, 5, *[0] * 4, r.randrange(9)] for _ in range(40)] + [whole() for _ in range(5)], [whole()]):
        targets = [whole() for _ in range(20)] + [[0, 0, 5, *[0] * 5]]
        as_df = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, id array<bigint>")
        got = {}
        for x in routing.nearest(as_df(targets, "target"), as_df(nodes, "node"), 4).collect():
            got.setdefault(x.target, {})[x.rank] = x.node
        for t, words in enumerate(targets):
            want = sorted(range(len(nodes)), key=lambda n: ([a ^ b for a, b in zip(words, nodes[n])], n))[:4]
            assert [got[t][i + 1] for i in range(len(want))] == want


def test_candidates_under_a_policy_with_many_holders(spark):
    """A chunk at risk that has four holders, the four nearest nodes."""
    words = lambda n: [0] * 7 + [n]
    tasks = spark.createDataFrame([(1, words(0), [1, 2, 3, 4]), (2, words(8), [8])], "chunk long, id array<bigint>, existing_holders array<bigint>")
    nodes = spark.createDataFrame([(n, words(n)) for n in range(1, 12)], "holder long, id array<bigint>")
    got = sorted((r.chunk, r.rank, r.holder) for r in resilience.repair_candidates(tasks, nodes, 2).collect())
    assert got == [(1, 1, 5), (1, 2, 6), (2, 1, 9), (2, 2, 10)]


def test_empty_blobs_are_read(spark):
    docs = spark.createDataFrame([(1, b"abc"), (2, b""), (3, b"x" * 1500)], "doc_id long, data binary")
    refs, blobs = blob.ingest(cdc.fixed_chunks(docs, "doc_id", F.col("data"), 512), docs, "doc_id", F.col("data"))
    got = {r.doc_id: bytes(r.data) for r in blob.read(refs, blob.stored_chunks(refs), "doc_id", "builtin", blobs).collect()}
    assert got == {1: b"abc", 2: b"", 3: b"x" * 1500}


def test_bucket_maintenance_equals_a_plain_list(spark):
    r = random.Random(3)
    rows, gone = [], set()
    for b in range(12):
        nodes, spare = r.randrange(6), r.randrange(6)
        for kind, n in (("node", nodes), ("replacement", spare)):
            for i in range(n):
                node = 100 * b + (50 if kind == "replacement" else 0) + i
                rows.append((b, node, i, kind, r.choice([0, 90_000]), i))
                if r.random() < 0.4:
                    gone.add((b, node))
    entries = spark.createDataFrame(rows, "bucket long, node long, place int, kind string, last_seen long, failures long")

    def lists(df):
        out = {}
        for x in sorted(df.collect(), key=lambda x: (x.bucket, x.kind, x.place)):
            held = out.setdefault(x.bucket, ([], []))[x.kind == "replacement"]
            assert x.place == len(held)
            held.append(x.node)
        return out

    start, age = lists(entries), {x[1]: x[4] for x in rows}
    want = {}
    for b, (nodes, spare) in start.items():
        left = [n for n in nodes if (b, n) not in gone]
        k = len(nodes) - len(left)
        want[b] = (left + spare[:k], spare[k:])
    got = lists(routing.remove(entries, spark.createDataFrame(sorted(gone), "bucket long, node long")))
    assert got == {b: w for b, w in want.items() if w != ([], [])}
    want = {}
    for b, (nodes, spare) in start.items():
        left, spare = [n for n in nodes if age[n]], list(spare)
        while spare and len(left) < 5:
            n = spare.pop(0)
            if age[n]:
                left.append(n)
        want[b] = (left, spare)
    got = lists(routing.evict_stale(entries, F.lit(100_000), 5, 60))
    assert got == {b: w for b, w in want.items() if w != ([], [])}
    touched = routing.touch(entries, entries.select("bucket", "node", F.lit(100_000).cast("long").alias("seen_at")))
    assert {x.last_seen for x in touched.where("kind = 'node'").collect()} == {100_000}
    assert touched.where("kind = 'node' AND failures > 0").count() == 0


def test_broken_encodings_are_null(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    huge = F.lit(b"\xff" * 200)
    for parse in (encoding.parse_node_info, encoding.parse_node_infos, encoding.parse_holders, encoding.parse_node_announcement, encoding.parse_entry_node, encoding.parse_record, encoding.parse_find_value, lambda v: encoding.parse_sequence(v, 32)):
        assert one(parse(huge)) is None and one(parse(F.lit(b""))) is None and one(parse(F.lit(None).cast("binary"))) is None
    body = F.struct(F.lit(b"n" * 32).alias("node_id"), F.lit(5).alias("timestamp"), F.array(F.lit("é"), F.lit("")).alias("addresses"), F.lit(7).alias("services"), F.lit(b"k" * 32).alias("public_key"), F.lit(b"s" * 64).alias("signature"))
    back = one(encoding.parse_node_announcement(encoding.node_announcement(body)))
    assert (bytes(back.node_id), back.timestamp, back.addresses, back.services, bytes(back.public_key), bytes(back.signature)) == (b"n" * 32, 5, ["é", ""], 7, b"k" * 32, b"s" * 64)


def test_objects_with_missing_or_changed_chunks_are_errors(spark):
    docs = spark.createDataFrame([(1, "a" * 1000), (2, "")], "doc_id long, text string")
    data = F.encode("text", "UTF-8")
    refs, blobs = blob.ingest(cdc.fixed_chunks(docs, "doc_id", data, 400), docs, "doc_id", data, "plain")
    made = blob.dag(refs, blobs, "doc_id", "plain")
    nodes = blob.node_rows(refs, "plain").unionByName(made.where("chunk_count > 1").select(F.col("root").alias("ref"), F.lit(1).alias("kind"), "node"))
    roots, store, plain = made.select(F.col("doc_id").alias("object"), "root"), blob.stored_chunks(refs), lambda s, o, c: s
    assert {x.object: bytes(x.data) for x in blob.read_objects(roots, nodes, store, plain).collect()} == {1: b"a" * 1000, 2: b""}
    for broken in (store.limit(0), store.withColumn("stored", F.lit(b"x"))):
        with pytest.raises(Exception, match="missing chunk|stored bytes differ"):
            blob.read_objects(roots, nodes, broken, plain).collect()


@pytest.mark.parametrize("profile", ["builtin", "conformant"])
def test_repository(spark, tmp_path, profile):
    repo = Repository(spark, f"file://{tmp_path}/repo", profile)
    docs = spark.createDataFrame([(1, "ab" * 3000), (2, ""), (3, "ab" * 3000), (4, "short")], "k long, text string")
    data = F.encode("text", "UTF-8")
    for _ in range(2 if profile == "builtin" else 1):  # again changes nothing
        put = {x.k: x for x in repo.put(docs, "k", data, cdc.SMALL).collect()}
    assert put[1].blob_id == put[3].blob_id and put[1].size == 6000 and put[2].size == 0
    asked = spark.createDataFrame([(put[k].blob_id,) for k in (1, 2, 4)] + [(bytearray(32),)], "blob_id binary")
    want = {bytes(put[k].blob_id): t.encode() for k, t in ((1, "ab" * 3000), (2, ""), (4, "short"))}
    assert {bytes(x.blob_id): bytes(x.data) for x in repo.get(asked).collect()} == want
    info = {bytes(x.blob_id): x for x in repo.info(asked).collect()}
    assert info[bytes(32)].size is None and info[bytes(put[4].blob_id)].chunk_count == 1 and info[bytes(put[2].blob_id)].chunk_count == 0
    roots = {k: info[bytes(put[k].blob_id)].root for k in (1, 2, 4)}
    rows = [(b"o" * 32, 0, roots[4]), (b"o" * 32, 1, roots[1]), (b"p" * 32, 0, roots[2])]
    new = spark.createDataFrame([(bytearray(o), r, c) for o, r, c in rows], "object binary, revision long, content_root binary")
    repo.publish(new.select("*", F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("modified_at"), F.lit(b"n").alias("origin"), F.lit(b"s").alias("signature")))
    objects = new.select("object")
    assert [x.revision for x in repo.revisions(objects.where("object = X'" + "6f" * 32 + "'")).orderBy("rank").collect()] == [1, 0]
    assert {bytes(x.object): bytes(x.data) for x in repo.read_objects(objects).collect()} == {b"o" * 32: b"ab" * 3000, b"p" * 32: b""}
    assert {x.name: x.rows for x in repo.status().collect()}["objects"] == 2
    made = spark.range(1).select(uri.parse(F.lit(new_object_uri())).alias("u")).first().u
    assert made.error is None and made.kind == "object" and len(made.id) == len(made.secret) == 32


def test_an_envelope_is_made_once_and_then_read(spark):
    """Each field that was read made the whole message again, its sender's hash with it."""
    from cairnspark.plans import QUERIES

    plan = QUERIES["message_envelopes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 3  # the length check of the sender names it three times, nothing else does


def test_sealing_and_opening_take_one_worker_each(spark):
    """Key derivation, cipher and hashes were UDFs that waited for one another, each with a worker that held a batch."""
    df = spark.createDataFrame([(1, b"abc" * 500), (2, b"x")], "doc_id long, b binary")
    refs, whole = blob.ingest(cdc.fixed_chunks(df, "doc_id", F.col("b"), 600), df, "doc_id", F.col("b"), "conformant")
    udfs = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert udfs(refs) == 2  # of the whole contents, and of the chunks
    assert udfs(blob.read(refs, refs.select("ciphertext_hash", "stored").limit(0), "doc_id", "conformant")) <= 5


def test_parts_of_a_batch_are_whole_and_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(blob, "_AT_ONCE", 10)
    rows = [(b"x" * n if n is not None else None, i) for i, n in enumerate([3, 3, 3, 3, 30, None, 0, 9, 2])]
    got = list(blob._parts(pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])))
    assert [r for p in got for r in p] == rows and [len(p) for p in got] == [3, 1, 1, 3, 1]
    assert list(blob._parts(pa.array([], pa.binary()))) == []


def test_trees_are_walked_without_their_leaves(spark):
    """Each level joined all nodes, leaves too, and did so again to see whether it was the last."""
    rows = [(b"r", 1, [b"a", b"l1"]), (b"a", 1, [b"l1", b"l2"]), (b"e", 1, []), (b"l1", 0, []), (b"l2", 0, []), (b"s", 0, [])]
    nodes = spark.createDataFrame([(bytearray(r), k, [bytearray(c) for c in cs], r.decode()) for r, k, cs in rows], "ref binary, kind int, children array<binary>, name string")
    roots = spark.createDataFrame([(bytearray(r),) for r in (b"r", b"s", b"e")], "root binary")
    out = blob.walk(nodes, roots)
    got = sorted((bytes(x.root).decode(), x.path, x.kind, x.name) for x in out.collect())
    assert got == [("e", [], 1, "e"), ("r", [], 1, "r"), ("r", [0], 1, "a"), ("r", [0, 0], 0, "l1"), ("r", [0, 1], 0, "l2"), ("r", [1], 0, "l1"), ("s", [], 0, "s")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 1
    with pytest.raises(Exception, match="missing node"):
        blob.walk(nodes.where("name != 'l2'"), roots).collect()
    with pytest.raises(ValueError, match="deeper"):
        blob.walk(nodes, roots, 2)
