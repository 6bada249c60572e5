"""Blobs: chunks are encrypted convergently, stored by the hash of what is stored, and linked in a Merkle tree.

Profiles: ``builtin`` (SHA-256, AES-GCM, expressions only), ``plain`` (SHA-256, not encrypted) and ``conformant`` (BLAKE3,
XChaCha20-Poly1305, in Arrow UDFs). All have the same tables: refs (blob_id, ord, offset, size, chunk_id,
ciphertext_hash), stored chunks (ciphertext_hash, stored), nodes (ref, node, kind) and metadata (blob_id, root, size,
chunk_count).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BLOB_KEY, CHUNK_KEY, CHUNK_NONCE, EMPTY_DAG_REF, HASH, TAG
from ..functions import crypto
from ..functions.encoding import internal_node, leaf_node, parse_node
from ..functions.hashing import blake3, blake3_many
from ..functions.ids import sha256_id


@dataclass(frozen=True)
class Profile:
    hash: Callable[[Column], Column]
    #: (plaintext, blob id, chunk id) to the stored form, and back (null if it does not open)
    seal: Callable[[Column, Column, Column], Column]
    open: Callable[[Column, Column, Column], Column]
    #: Both with all their hashes in one step, where these are UDFs: each UDF that waits for another has a worker of its own.
    #: (plaintext, blob id) to struct(chunk_id, stored, ciphertext_hash)
    sealing: Callable[[Column, Column], Column] | None = None
    #: (stored form, blob id, chunk id, ciphertext hash) to struct(plain, fault)
    opening: Callable[[Column, Column, Column, Column], Column] | None = None


#: Bytes of the rows of a batch that are worked on at once.
_AT_ONCE = 4 << 20


def _parts(*columns: pa.Array) -> Iterator[list[tuple]]:
    """The rows of a batch, in parts of bounded size by their first column."""
    lo, total = 0, 0
    for i, n in enumerate(pa.compute.binary_length(columns[0]).fill_null(0).to_pylist()):
        if total and total + n > _AT_ONCE:
            yield list(zip(*[c.slice(lo, i - lo).to_pylist() for c in columns], strict=True))
            lo, total = i, 0
        total += n
    if lo < len(columns[0]):
        yield list(zip(*[c.slice(lo).to_pylist() for c in columns], strict=True))


def _keyed(rows: list[tuple]) -> list[tuple | None]:
    """Key, nonce and aad of rows (blob id, chunk id); null if one is."""
    base = {b: crypto.blob_key(b) for b, _ in rows if b is not None}
    return [None if b is None or c is None else (*crypto.chunk_keys(base[b], c), b + c) for b, c in rows]


def _hashed(values: list[bytes | None]) -> list[bytes | None]:
    some = iter(blake3_many([v for v in values if v is not None]))
    return [None if v is None else next(some) for v in values]


def _seal_rows(data: list[bytes | None], blobs: list[bytes | None], chunks: list[bytes | None]) -> list[bytes | None]:
    keys = _keyed(list(zip(blobs, chunks, strict=True)))
    made = crypto._whole_batch([None if k is None or d is None else (k[0], k[1], d, k[2]) for k, d in zip(keys, data, strict=True)], False)
    return [None if m is None else k[1] + m for k, m in zip(keys, made, strict=True)]


def _open_rows(stored: list[bytes | None], blobs: list[bytes | None], chunks: list[bytes | None]) -> list[bytes | None]:
    keys = _keyed(list(zip(blobs, chunks, strict=True)))
    whole = [k is not None and s is not None and len(s) >= 24 for k, s in zip(keys, stored, strict=True)]
    return crypto._whole_batch([(k[0], s[:24], s[24:], k[2]) if w else None for w, k, s in zip(whole, keys, stored, strict=True)], True)


def _sealed(p: Column, blob: Column, chunk: Column) -> Column:
    def run(p: pa.Array, blob: pa.Array, chunk: pa.Array) -> pa.Array:
        return pa.array([x for part in _parts(p, blob, chunk) for x in _seal_rows(*map(list, zip(*part, strict=True)))], pa.binary())

    return F.arrow_udf(lambda p, blob, chunk: run(p, blob, chunk), "binary")(p, blob, chunk)


def _opened(s: Column, blob: Column, chunk: Column) -> Column:
    def run(s: pa.Array, blob: pa.Array, chunk: pa.Array) -> pa.Array:
        return pa.array([x for part in _parts(s, blob, chunk) for x in _open_rows(*map(list, zip(*part, strict=True)))], pa.binary())

    return F.arrow_udf(lambda s, blob, chunk: run(s, blob, chunk), "binary")(s, blob, chunk)


def _sealing(p: Column, blob: Column) -> Column:
    types = pa.struct([("chunk_id", pa.binary()), ("stored", pa.binary()), ("ciphertext_hash", pa.binary())])

    def run(p: pa.Array, blob: pa.Array) -> pa.Array:
        out = []
        for part in _parts(p, blob):
            data, blobs = map(list, zip(*part, strict=True))
            chunks = _hashed(data)
            stored = _seal_rows(data, blobs, chunks)
            out.append(pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in (chunks, stored, _hashed(stored))], fields=list(types)))
        return pa.concat_arrays(out) if out else pa.array([], types)

    return F.arrow_udf(lambda p, blob: run(p, blob), "chunk_id binary, stored binary, ciphertext_hash binary")(p, blob)


def _opening(s: Column, blob: Column, chunk: Column, hashed: Column) -> Column:
    types = pa.struct([("plain", pa.binary()), ("fault", pa.string())])

    def fault(s: bytes | None, same: bool, plain: bytes | None, fits: bool) -> str | None:
        return "missing chunk" if s is None else "stored bytes differ" if not same else "cannot be opened" if plain is None else None if fits else "content differs"

    def run(s: pa.Array, blob: pa.Array, chunk: pa.Array, hashed: pa.Array) -> pa.Array:
        out = []
        for part in _parts(s, blob, chunk, hashed):
            stored, blobs, chunks, hashes = map(list, zip(*part, strict=True))
            plain = _open_rows(stored, blobs, chunks)
            faults = [fault(s, h == g, p, c == d) for s, h, g, p, c, d in zip(stored, hashes, _hashed(stored), plain, chunks, _hashed(plain), strict=True)]
            out.append(pa.StructArray.from_arrays([pa.array(plain, pa.binary()), pa.array(faults, pa.string())], fields=list(types)))
        return pa.concat_arrays(out) if out else pa.array([], types)

    return F.arrow_udf(lambda s, blob, chunk, hashed: run(s, blob, chunk, hashed), "plain binary, fault string")(s, blob, chunk, hashed)


def _key(blob: Column, chunk: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(CHUNK_KEY), blob, chunk), 256))


PROFILES = {
    "plain": Profile(sha256_id, lambda p, b, c: p, lambda s, b, c: s),
    "builtin": Profile(sha256_id, lambda p, b, c: crypto.aes_encrypted(_key(b, c), p, crypto.chunk_aad(b, c)), lambda s, b, c: crypto.aes_decrypted(_key(b, c), s, crypto.chunk_aad(b, c))),
    "conformant": Profile(blake3, _sealed, _opened, _sealing, _opening),
}


def ingest(chunks: DataFrame, blobs: DataFrame, key: str, data: Column, profile: str = "builtin") -> tuple[DataFrame, DataFrame]:
    """(refs with ``stored``, blob ids): ``chunks`` as the chunking operators give them, ``blobs`` the whole contents."""
    p = PROFILES[profile]
    ids = blobs.select(F.col(key), p.hash(data.cast("binary")).alias("blob_id"), F.octet_length(data).cast("long").alias("blob_size"))
    rows = chunks.join(ids, key)
    if p.sealing:
        rows = rows.withColumn("s", p.sealing(F.col("bytes"), F.col("blob_id")))
        return rows.select(key, "blob_id", "ord", F.col("start").alias("offset"), "size", "s.chunk_id", "s.ciphertext_hash", "s.stored"), ids
    rows = rows.withColumn("chunk_id", p.hash(F.col("bytes")))
    rows = rows.withColumn("stored", p.seal(F.col("bytes"), F.col("blob_id"), F.col("chunk_id"))).withColumn("ciphertext_hash", p.hash(F.col("stored")))
    return rows.select(key, "blob_id", "ord", F.col("start").alias("offset"), "size", "chunk_id", "ciphertext_hash", "stored"), ids


def stored_chunks(refs: DataFrame) -> DataFrame:
    """(ciphertext_hash, stored), each hash once."""
    return refs.select("ciphertext_hash", "stored").dropDuplicates(["ciphertext_hash"])


def commitment(ciphertext_hash: Column, size: Column) -> Column:
    """One block, whose root is the hash."""
    return F.struct(ciphertext_hash.alias("merkle_root"), size.alias("size"), size.alias("block_size"), F.lit(1).alias("block_count"))


def leaves(refs: DataFrame, profile: str = "builtin") -> DataFrame:
    """Refs with the encoded leaf ``node`` and its ``ref``. A chunk's committed size is that of its stored form."""
    whole = F.octet_length("stored") if "stored" in refs.columns else F.col("size") + TAG
    r = F.struct("chunk_id", "ciphertext_hash", commitment(F.col("ciphertext_hash"), whole).alias("commitment"), "offset", "size")
    return refs.withColumn("node", leaf_node(r)).withColumn("ref", PROFILES[profile].hash(F.col("node")))


def dag(refs: DataFrame, ids: DataFrame, key: str, profile: str = "builtin") -> DataFrame:
    """Metadata (key, blob_id, root, size, chunk_count, node): the root of no chunk is the EMPTY constant, of one its leaf,
    of more one internal node over all leaves in order (whose encoding is ``node``)."""
    return rooted(leaves(refs, profile), ids, key, profile)


def rooted(made: DataFrame, ids: DataFrame, key: str, profile: str = "builtin") -> DataFrame:
    """The same from leaves (key, ord, ref) that are made already."""
    made = made.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "ref"))).alias("l"))
    made = made.withColumn("children", F.transform("l", lambda x: x["ref"]))
    made = made.withColumn("node", F.when(F.size("children") > 1, internal_node(F.col("children"))))
    out = ids.join(made, key, "left")
    root = F.when(F.col("children").isNull(), F.lit(EMPTY_DAG_REF)).when(F.size("children") == 1, F.get("children", F.lit(0))).otherwise(PROFILES[profile].hash(F.col("node")))
    return out.select(key, "blob_id", root.alias("root"), F.col("blob_size").alias("size"), F.coalesce(F.size("children"), F.lit(0)).cast("int").alias("chunk_count"), "node")


def read(refs: DataFrame, store: DataFrame, key: str, profile: str = "builtin", blobs: DataFrame | None = None) -> DataFrame:
    """(key, data): chunks are fetched by hash, checked against their key, opened, checked against their id, and put
    together by offset. A chunk that is missing or does not fit is an error. ``blobs``, rows by key, names the blobs to
    read: one without chunks is empty. Without it, blobs are those of ``refs``."""
    p = PROFILES[profile]
    got = refs.select(key, "blob_id", "ord", "offset", "chunk_id", "ciphertext_hash").join(store, "ciphertext_hash", "left")
    if p.opening:
        got = got.withColumn("o", p.opening(F.col("stored"), F.col("blob_id"), F.col("chunk_id"), F.col("ciphertext_hash"))).select(key, "offset", "o.plain", "o.fault")
    else:
        got = got.withColumn("plain", p.open(F.col("stored"), F.col("blob_id"), F.col("chunk_id")))
        fault = F.when(F.col("stored").isNull(), "missing chunk").when(p.hash(F.col("stored")) != F.col("ciphertext_hash"), "stored bytes differ").when(F.col("plain").isNull(), "cannot be opened").when(p.hash(F.col("plain")) != F.col("chunk_id"), "content differs")
        got = got.withColumn("fault", fault)
    got = got.withColumn("plain", F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault")).cast("binary")).otherwise(F.col("plain")))
    whole = got.groupBy(key).agg(F.expr("listagg(plain) WITHIN GROUP (ORDER BY offset)").alias("data"))
    if blobs is None:
        return whole
    return blobs.select(key).distinct().join(whole, key, "left").select(key, F.coalesce("data", F.lit(b"")).alias("data"))


def node_rows(refs: DataFrame, profile: str = "builtin") -> DataFrame:
    """(ref, kind, node) of the leaves of refs, each once."""
    return leaves(refs, profile).select("ref", F.lit(0).alias("kind"), "node").dropDuplicates(["ref"])


def read_objects(roots: DataFrame, nodes: DataFrame, store: DataFrame, opened: Callable[[Column, Column, Column], Column], hashed: Callable[[Column], Column] = sha256_id) -> DataFrame:
    """(object, data): the content of objects (object, root) of manifests. Trees (ref, node) are walked level by level, their
    leaves join the stored chunks by hash, and ``opened`` (stored form, object, chunk id) gives the plain bytes. An object
    without content is empty; a missing node or chunk, or one that does not fit its id, is an error."""
    known = nodes.select("ref", parse_node(F.col("node")).alias("n")).select("ref", F.col("n.kind").alias("kind"), "n.children", "n.chunk")
    chunks = walk(known, roots.select("root").distinct()).where("kind = 0").select("root", "path", "chunk.*")
    got = roots.select("object", "root").join(chunks, "root").join(store, "ciphertext_hash", "left")
    got = got.withColumn("plain", opened(F.col("stored"), F.col("object"), F.col("chunk_id")))
    fault = F.when(F.col("stored").isNull(), "missing chunk").when(hashed(F.col("stored")) != F.col("ciphertext_hash"), "stored bytes differ").when(F.col("plain").isNull(), "cannot be opened").when(hashed(F.col("plain")) != F.col("chunk_id"), "content differs")
    got = got.withColumn("fault", fault).withColumn("plain", F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault")).cast("binary")).otherwise(F.col("plain")))
    whole = got.groupBy("object").agg(F.expr("listagg(plain) WITHIN GROUP (ORDER BY offset)").alias("data"))
    return roots.select("object").distinct().join(whole, "object", "left").select("object", F.coalesce("data", F.lit(b"")).alias("data"))


def is_empty(root: Column) -> Column:
    """The tree has no content."""
    return root == F.lit(EMPTY_DAG_REF)


def read_range(refs: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, data) of byte ranges (key, start, stop), from plain chunks (key, offset, size, bytes). The join has
    the blob's key; only chunks that the range touches are taken."""
    hit = ranges.join(refs, key).where((F.col("offset") < F.col("stop")) & (F.col("offset") + F.col("size") > F.col("start")))
    first = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    last = F.least(F.col("stop") - F.col("offset"), F.col("size"))
    hit = hit.select(key, "start", "stop", "offset", F.substring(F.col("bytes"), (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    return hit.groupBy(key, "start", "stop").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY offset)").alias("data"))


def write_range(data: Column, offset: Column, new: Column) -> Column:
    """``data`` with ``new`` written at ``offset``; a gap is filled with zero bytes."""
    pad = F.unhex(F.repeat(F.lit("00"), F.greatest(offset - F.octet_length(data), F.lit(0)).cast("int")))
    whole = F.concat(data, pad)
    after = offset + F.octet_length(new)
    return F.concat(F.substring(whole, F.lit(1), offset.cast("int")), new, F.substring(whole, (after + 1).cast("int"), F.octet_length(whole)))


def walk(nodes: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """(root, path, ref, kind): pre-order walk of trees of any shape. ``nodes``: (ref, kind, children), other columns are kept.
    Levels are followed through the nodes that have children, one equi-join each, until none is left; leaves, of which there
    are far more, are joined once, with all that was met. A child without a node is an error."""
    inner = nodes.where(F.size("children") > 0).select("ref", "children")
    level = roots.select(F.col("root"), F.col("root").alias("ref"), F.array().cast("array<int>").alias("path"))
    met = level
    for _ in range(depth):
        if level.select("ref").join(inner.select("ref"), "ref", "left_semi").isEmpty():
            here = met.join(nodes.drop("children"), "ref", "left")
            kind = F.when(F.col("kind").isNull() & (F.col("ref") != F.lit(EMPTY_DAG_REF)), F.raise_error(F.lit("missing node"))).otherwise(F.col("kind"))
            return here.withColumn("kind", kind).where("kind IS NOT NULL").select("root", "path", "ref", "kind", *[c for c in nodes.columns if c not in ("ref", "kind", "children")])
        level = level.join(inner, "ref").select("root", "path", F.posexplode("children").alias("n", "child")).select("root", F.col("child").alias("ref"), F.concat("path", F.array("n")).alias("path"))
        met = met.unionByName(level)
    raise ValueError("the tree is deeper than the limit")


def hash_size_ok(h: Column) -> Column:
    return F.octet_length(h) == HASH
