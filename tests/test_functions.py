import hashlib
import hmac
import os
import random

import pytest
from pyspark.sql import functions as F

from cairnspark import constants as C
from cairnspark.functions import crypto, encoding, hashing, ids, timing, uri

H = bytes.fromhex


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_blake3_vectors(spark):
    want = {b"": C.EMPTY_BLOB_ID, b"\x00": H("2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"), b"\x01": H("48fc721fbbc172e0925fa27af1671de225ba927134802998b10a1568a188652b"), b"\xff": H("99d44d377bc5936d8cb7f5df90713d84c7587739b4724d3d2f9af1ee0e4c8efd"), C.EMPTY_DAG_LABEL: C.EMPTY_DAG_REF}
    assert hashing.blake3_many(list(want)) == list(want.values())
    g = hashing.gear_table()
    assert (int(g[0]), int(g[1]), int(g[255])) == (0xF1611BF1DFDE3A2D, 0xE072C1BB1F72FC48, 0x6D93C57B374DD499)
    jvm = spark.sparkContext._jvm.org.apache.commons.codec.digest.Blake3
    r = random.Random(1)
    data = [r.randbytes(n) for n in (63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 4097, 7000, 20_000)]
    assert hashing.blake3_many(data) == [bytes(jvm.hash(bytearray(d))) for d in data]
    df = spark.createDataFrame([(bytearray(b"\x01"),), (None,)], "v binary").select(hashing.blake3(F.col("v")).alias("h"))
    assert [r.h and bytes(r.h) for r in df.collect()] == [want[b"\x01"], None]


def test_key_schedule():
    assert crypto.hkdf(b"\x0b" * 22, H("000102030405060708090a0b0c"), H("f0f1f2f3f4f5f6f7f8f9"), 42).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    assert crypto.network_mac_key(b"\x42" * 32).hex() == "23c6878c5619c870f4f1942e7e99897cd08ac69dd3276c575e6a7eac37a2cbdf"
    base = crypto.chunk_key_base(b"\xaa" * 32, b"\xbb" * 32)
    assert base.hex() == "532909a10b9188e1835d34a39a4f4ec6929b761934fd5d06418d45d5c60299e5"
    key, nonce = crypto.chunk_keys(base, b"\xcc" * 32)
    assert key.hex() == "05410a674aa6224ead714901fad1b1860916d4f4ca0eb14224ca9600ff8ee93e" and nonce.hex() == "a2e10e6c62894bd744395bdd258b73367ac18e4442537545"
    for n in (0, 8161):
        with pytest.raises(ValueError):
            crypto.hkdf(b"k", b"", b"", n)


def test_hmac_expression(spark):
    for key in (b"k" * 32, b"long" * 30):
        assert bytes(one(spark, crypto.hmac_sha256(key, F.lit(b"message")).alias("m")).m) == hmac.digest(key, b"message", "sha256")


def test_xchacha():
    # draft-irtf-cfrg-xchacha, A.3.1
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    key, nonce, aad = bytes(range(0x80, 0xA0)), bytes(range(0x40, 0x58)), H("50515253c0c1c2c3c4c5c6c7")
    out = crypto.xchacha_encrypt(key, nonce, text, aad)
    assert out[:16].hex() == "bd6d179d3e83d43b9576579493c0e939" and out[-16:].hex() == "c0875924c1c7987947deafd8780acf49"
    assert crypto.xchacha_decrypt(key, nonce, out, aad) == text
    assert crypto.xchacha_decrypt(key, nonce, out[:-1] + b"\0", aad) is None and crypto.xchacha_decrypt(key, nonce, out, b"") is None
    assert crypto.xchacha_decrypt(key, nonce, b"short", aad) is None
    assert crypto.xchacha_decrypt(key, nonce, crypto.xchacha_encrypt(key, nonce, b"", b""), b"") == b""


def test_ed25519():
    # RFC 8032, 7.1, tests 1 and 2
    for seed, key, message, sig in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        assert crypto.public_key(H(seed)).hex() == key and crypto.sign(H(seed), H(message)).hex() == sig
        assert crypto.verify(H(key), H(message), H(sig)) and not crypto.verify(H(key), b"x", H(sig)) and not crypto.verify(H(key), H(message), b"")


def test_aead_columns(spark):
    key, aad = F.lit(b"k" * 32), F.lit(b"aad")
    stored = crypto.aes_encrypted(key, F.lit(b"hello"), aad)
    r = one(spark, stored.alias("s"), crypto.aes_decrypted(key, stored, aad).alias("p"), crypto.aes_decrypted(key, stored, F.lit(b"no")).alias("q"))
    assert (len(r.s), bytes(r.p), r.q) == (33, b"hello", None)
    c = crypto.encrypted(key, F.lit(b"n" * 24), F.lit(b"hello"), aad)
    r = one(spark, crypto.decrypted(key, F.lit(b"n" * 24), c, aad).alias("p"), crypto.signature_valid(F.lit(crypto.public_key(b"s" * 32)), F.lit(b"m"), crypto.signed(F.lit(b"s" * 32), F.lit(b"m"))).alias("v"))
    assert bytes(r.p) == b"hello" and r.v


def test_encoding_vectors(spark):
    r = one(
        spark,
        encoding.u64(F.lit(1700000000000)).alias("t"), encoding.u32(F.lit(1)).alias("v"), encoding.blob(F.lit(b"\xaa\xbb\xcc")).alias("b"), encoding.option(F.lit(None).cast("int"), encoding.u32).alias("n"),
        encoding.option(F.lit(0x12345678), encoding.u32).alias("s"), encoding.text(F.lit("é")).alias("x"), encoding.u64(F.lit(-1)).alias("m"),
        encoding.sorted_map(F.create_map(F.lit(300), F.lit(1), F.lit(100), F.lit(2), F.lit(200), F.lit(3)), encoding.u32, encoding.u8).alias("map"),
        encoding.sequence(F.array(F.lit(1), F.lit(258)), encoding.u16).alias("seq"), encoding.read_le(F.lit(H("0068e5cf8b010000")), 0, 8).alias("back"), encoding.read_le(encoding.u64(F.lit(-5)), 0, 8).alias("neg"), encoding.read_le(F.lit(b"\1"), 0, 4).alias("short"),
    )
    assert (r.t.hex(), r.v.hex(), r.b.hex(), r.n.hex(), r.s.hex(), r.x.hex(), r.m.hex()) == ("0068e5cf8b010000", "01000000", "03000000aabbcc", "00", "0178563412", "02000000c3a9", "ff" * 8)
    assert r.map.hex() == "03000000" + "2c01000001" + "6400000002" + "c800000003" and r.seq.hex() == "0200000001000201"
    assert (r.back, r.neg, r.short) == (1700000000000, -5, None)


def test_ids(spark):
    zero = bytes(32)
    cases = {b"\xff" + bytes(31): (0, 255), b"\x00\x80" + bytes(30): (8, 247), bytes(31) + b"\x01": (255, 0), zero: (256, None), b"\x01" + bytes(31): (7, 248)}
    for v, (z, b) in cases.items():
        a, o = ids.words(F.lit(v)), ids.words(F.lit(zero))
        r = one(spark, ids.leading_zeros(ids.distance(a, o)).alias("z"), ids.bucket_index(a, o).alias("b"), ids.from_hex(ids.to_hex(F.lit(v))).alias("h"), ids.from_hex(F.lit("12")).alias("n"))
        assert (r.z, r.b, bytes(r.h), r.n) == (z, b, v, None)


def test_timing(spark):
    t = F.lit(1_000_000)
    r = one(
        spark, timing.within_skew(t, t + 300_000).alias("a"), timing.within_skew(t, t - 300_001).alias("b"), timing.expired(t, t).alias("c"), timing.live(t, t).alias("d"), timing.plus(F.lit(2**63 - 5), F.lit(10)).alias("e"),
        timing.minus(F.lit(-(2**63) + 5), F.lit(10)).alias("f"), timing.since(t, t + 1).alias("g"), timing.needs_renewal(t + C.DAY_MS, t).alias("h"), timing.needs_renewal(t + 6 * C.DAY_MS, t).alias("i"), timing.seconds(F.lit(-1)).alias("j"),
        timing.stale(F.lit(0), F.lit(3_600_999)).alias("k"), timing.stale(F.lit(0), F.lit(3_601_000)).alias("l"), timing.renewal_time(F.lit(0)).alias("m"),
    )
    assert tuple(r) == (True, False, False, False, 2**63 - 1, -(2**63), None, True, False, 0, False, True, C.LEASE_TTL_MS * 3 // 4)


def test_uris(spark):
    i, s = F.lit(b"\x42" * 32), F.lit(b"\x22" * 32)
    blob, obj, rev = uri.blob_uri(i), uri.object_uri(i, s), uri.object_uri(i, s, F.lit(42))
    cols = [uri.parse(x).alias(f"c{n}") for n, x in enumerate([blob, obj, rev, F.lit("http:x"), *[F.lit(f"{C.URI_SCHEME}:{x}") for x in ("zip:x", "blob:!!", "blob:AAAA", "obj:AAAA")], F.concat(obj, F.lit(":")), F.concat(rev, F.lit(":x")), uri.at_revision(rev, F.lit(7)), uri.without_revision(rev)])]
    r = one(spark, *cols)
    assert [x.error for x in r] == [None, None, None, "scheme", "type", "base64", "length", "component", "revision", None, None, None]
    assert bytes(r[0].id) == b"\x42" * 32 and (r[2].kind, bytes(r[2].secret), r[2].revision) == ("object", b"\x22" * 32, 42)
    assert (r[9].revision, r[10].revision, r[11].revision) == (42, 7, None)


def test_sha256_identity(spark):
    v = os.urandom(100)
    assert bytes(one(spark, ids.sha256_id(F.lit(v)).alias("h")).h) == hashlib.sha256(v).digest()


def test_arrays_are_encoded_in_linear_time_and_integers_in_few_steps(spark):
    """A long holder set was copied for each of its leases, and a parser named its input again in every step."""
    n = 20_000
    part = lambda x: F.sha2(x.cast("string").cast("binary"), 256)
    ids = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.unhex(part(i)))
    got = spark.range(1).select(F.sha2(encoding.sequence(ids, lambda x: F.concat(x, x, x, x, x, x, x, x, x, x)), 256).alias("h")).first()["h"]
    want = n.to_bytes(4, "little") + b"".join(hashlib.sha256(str(i).encode()).digest() * 10 for i in range(1, n + 1))
    assert got == hashlib.sha256(want).hexdigest()
    assert str(encoding.read_le(F.col("v"), 0, 8)._jc).count("substring") == 1
    assert str(encoding.parse_holders(F.concat("v", "w"))._jc).count("concat") == 1


def test_integers_at_the_ends_of_their_ranges(spark):
    values = [0, 1, 5, 0x50, 255, 256, 2**31, 2**32 - 1, 2**63 - 1, -1, -(2**63), 0x0123456789ABCDEF]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    for width in (1, 2, 4, 8):
        raw = df.select("v", encoding.le(F.col("v"), width).alias("e"))
        for r in raw.select("v", "e", encoding.read_le(F.concat(F.lit(b"\xff"), F.col("e")), 1, width).alias("back"), encoding.read_le(F.col("e"), 1, width).alias("short")).collect():
            cut = None if r.v is None else (r.v % 2**64 % 2 ** (8 * width)).to_bytes(width, "little")
            assert (None if r.e is None else bytes(r.e)) == cut and r.short is None
            assert r.back == (None if r.v is None else int.from_bytes(cut, "little", signed=width == 8))
    none = spark.range(1).select(encoding.sequence(F.array(F.lit(b"a"), F.lit(None).cast("binary")), lambda x: x).alias("x"), encoding.sequence(F.array().cast("array<binary>"), lambda x: x).alias("e")).first()
    assert none.x is None and bytes(none.e) == bytes(4)
