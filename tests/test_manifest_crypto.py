import pytest
from pyspark.sql import functions as F

from cairnspark import config
from cairnspark.functions import crypto, encoding
from cairnspark.operators import manifest


def body(revision=3):
    key = crypto.public_key(b"s" * 32)
    i = lambda b: F.lit(b * 32)
    origin = F.struct(F.lit(key).alias("public_key"), i(b"n").alias("node_id"))
    return F.struct(F.lit(1).alias("crypto_version"), i(b"o").alias("object_id"), F.lit(revision).cast("bigint").alias("revision"), i(b"r").alias("content_root"), F.lit(-5).cast("bigint").alias("created_at"), F.lit(9).cast("bigint").alias("modified_at"), origin.alias("origin"))


def test_manifest_round_trip(spark):
    secret, obj = F.lit(b"c" * 32), F.lit(b"o" * 32)
    df = spark.range(1).select(body().alias("b"))
    df = df.withColumn("sig", crypto.signed(F.lit(b"s" * 32), encoding.manifest_body(F.col("b")))).withColumn("e", manifest.encrypted(secret, obj, F.col("b")["revision"], F.col("b"), F.col("sig")))
    df = df.withColumn("d", manifest.decrypted(secret, obj, F.col("e"))).withColumn("bad", manifest.decrypted(F.lit(b"x" * 32), obj, F.col("e")))
    r = df.withColumn("ok", manifest.signature_ok(F.col("d.body"), F.col("d.signature"))).first()
    assert r.d.body == r.b and r.ok and r.bad is None and len(r.e.ciphertext) == 236


def test_parsers(spark):
    h = F.lit(b"h" * 32)
    com = F.struct(h.alias("merkle_root"), F.lit(7).alias("size"), F.lit(7).alias("block_size"), F.lit(1).alias("block_count"))
    ref = F.struct(h.alias("chunk_id"), h.alias("ciphertext_hash"), com.alias("commitment"), F.lit(4).alias("offset"), F.lit(5).alias("size"))
    leaf, inner = encoding.leaf_node(ref), encoding.internal_node(F.array(h, h))
    lease = F.struct(h.alias("chunk_id"), h.alias("ciphertext_hash"), com.alias("commitment"), h.alias("holder"), h.alias("issuer"), F.lit(1).alias("issued_at"), F.lit(2).alias("expires_at"))
    cols = [encoding.parse_node(leaf), encoding.parse_node(inner), encoding.parse_node(F.lit(b"\x09\0\0\0")), encoding.parse_chunk_ref(F.concat(leaf, F.lit(b"!")), 4), encoding.parse_lease_body(encoding.lease_body(lease)), encoding.parse_blob_metadata(encoding.blob_metadata(h, F.lit(8), F.lit(2)))]
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    assert (r.c0.chunk.offset, r.c0.chunk.size, r.c0.chunk.commitment.size) == (4, 5, 7) and len(r.c1.children) == 2 and r.c2 is None and r.c3 is None
    assert (r.c4.issued_at, r.c4.expires_at, r.c5.size, r.c5.chunk_count) == (1, 2, 8, 2)


def test_config_and_identity(tmp_path):
    assert config.load().bucket_size == 20
    p = tmp_path / "c.toml"
    p.write_text('bucket_size = 7\ndata_dir = "~/x"\n')
    c = config.load(str(p))
    assert c.bucket_size == 7 and not c.data_dir.startswith("~")
    p.write_text("nonsense = 1\n")
    with pytest.raises(ValueError):
        config.load(str(p))
    key = config.new_identity(str(tmp_path / "id"))
    assert crypto.public_key(config.read_identity(str(tmp_path / "id"))) == key
    (tmp_path / "bad").write_text("public: 00\n")
    with pytest.raises(ValueError):
        config.read_identity(str(tmp_path / "bad"))
