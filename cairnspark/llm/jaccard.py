"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word shingles. Where two sets A and B reach the threshold,
their symmetric difference has at most ``d`` elements, a bound that follows from their sizes. Sizes fall into bands;
a document takes part in its own band and, if a smaller partner could lie there, in the band below. Each band has
``m = d + 1`` blocks over the hash space, and the elements of a block are XOR-ed into one signature. By the
pigeonhole principle some block has no differing element, so its signatures are equal: documents are joined by
(band, block, signature).

Blocks that are empty on both sides say nothing and give no key. If all undisturbed blocks of a pair are empty, e of
them, every other block differs, and at most e - 1 of those with two or more elements differ by more than one element.
So a document with E empty blocks also gives, for its first E blocks of two or more elements, each signature less one
element: one of these equals the partner's signature. A document with fewer such blocks gives the elements of its
prefix (the least hashes, of which two similar sets share one). No link is lost.

Candidates are filtered by parity sketches: bit strings whose Hamming distance never exceeds the symmetric difference,
as each differing element flips one bit. What passes is verified on the sets, made again from the whole texts.

Groups of equal sets count as one. The rows of a key, two numbers each, are sorted and read in order by one task, but for
hot keys, which are set apart from the start. Within a key, documents are first compared with the least and the greatest
one only; components of those links are found, and then just documents of different components, in tiles of bounded
size, and each pair about once however many keys it shares. So large groups of near copies are joined without making all
their pairs; what grows faster than such a group is only the comparison of the sketches of documents in it that no link
has joined.

Null and empty texts have no shingle and link with nothing. Empty tables give empty results; other columns are ignored
by ``components_of`` and kept by ``representatives``, whatever their names. Rows that share an id count as one
document; a row without an id is in no group. Equal 64-bit hashes of different shingles are taken for the same one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, remove, shared_folder, small_batches, written
from .components import components

SHINGLE, PERCENT = 4, 85
#: Ratio of a band's size limits; documents of a tile and their shingles, about; numbers that are compared at once; one
#: document in so many tells the hot keys.
RATIO, TILE, TILE_SIZE, CELLS, SPARSE = 1.5, 1024, 1 << 22, 1 << 20, 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class _Memo(Memo):
    """Hashes by word."""

    LIMIT = 24 << 20

    def __init__(self) -> None:
        super().__init__(xxhash.xxh3_64_intdigest)


def shingles(text: str | None, memo: _Memo, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Splitting and lower-casing of bytes know ASCII only."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * _ODD[i % 8]
        h ^= h >> np.uint64(32)
    return np.unique(_mixed(h))


def limit(a, b, percent: int = PERCENT):
    """The most elements in which similar sets of sizes ``a`` and ``b`` differ: |A and B| >= p/100 |A or B| means
    |A xor B| <= (100 - p) / (100 + p) * (a + b)."""
    return (100 - percent) * (a + b) // (100 + percent)


@cache
def bands(percent: int) -> tuple[list[int], list[int]]:
    """Least size of each band, and its count of blocks: one more than the limit of its largest pair."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
    blocks = [limit(high - 1, (high - 1) * 100 // percent, percent) + 1 for high in low[1:]]
    return low, blocks


def keys(h: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Join keys of a set."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    low, blocks = bands(percent)
    own = int(np.searchsorted(low, n, "right")) - 1
    out = []
    scattered = _mixed(h ^ _ODD[2])
    for band in (own, own - 1):
        # a partner of the band below has size a < low[own] with n <= a * 100 / percent
        if band < 0 or (band < own and n * percent > (low[own] - 1) * 100):
            continue
        m = blocks[band]
        block = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        at, x = block[order], scattered[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        used, sign = at[starts], np.bitwise_xor.reduceat(x, starts)
        count = np.diff(np.append(starts, n))
        salt = lambda b, band=band: _mixed(b * _ODD[3] + np.uint64(band + 1))
        out.append(_mixed(sign ^ salt(used)))
        if empty := m - len(used):
            many = np.flatnonzero(count > 1)
            for i in many[:empty]:
                s = starts[i]
                out.append(_mixed((sign[i] ^ x[s : s + count[i]]) ^ salt(used[i : i + 1])))
            if len(many) < empty:
                out.append(_mixed(h[: n - -(-percent * n // 100) + 1] ^ _ODD[4]))
    return np.unique(np.concatenate(out))


def sketch(h: np.ndarray) -> bytes:
    """Parity of the elements that fall on each bit; the count of bits is a power of two and at least the set's size."""
    bits = 1 << max(8, int(len(h)).bit_length())
    flips = np.bincount((_mixed(h ^ _ODD[5]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def _words(data: bytes, bits: int) -> np.ndarray:
    """A sketch folded to fewer bits, as 64-bit words."""
    x = np.frombuffer(data, np.uint64)
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def near(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs the sizes and sketches leave open."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    ok = (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (na > 0) & (nb > 0)
    for i in np.flatnonzero(ok):
        bits = 8 * min(len(a[i]), len(b[i]))
        ok[i] = np.bitwise_count(_words(a[i], bits) ^ _words(b[i], bits)).sum() <= limit(na[i], nb[i], percent)
    return ok


def _table(rows: dict[str, tuple[pa.DataType, object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for t, x in rows.values()], list(rows))


def summarise(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(id, n, digest, sketch, keys) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            sets = [shingles(t.as_py(), memo, size) for t in batch.column("text")]
            yield _table(
                {
                    "id": (None, batch.column("id")),
                    "n": (pa.int64(), [len(h) for h in sets]),
                    "digest": (pa.binary(), [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]),
                    "sketch": (pa.binary(), [sketch(h) for h in sets]),
                    "keys": (pa.list_(pa.int64()), [keys(h, percent).view(np.int64) for h in sets]),
                }
            )

    return docs.mapInArrow(run, "id long, n long, digest binary, sketch binary, keys array<long>")


def filtered(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = near(x.column("sa").to_pylist(), x.column("sb").to_pylist(), x.column("na").to_numpy(), x.column("nb").to_numpy(), percent)
            yield x.select(["a", "b"]).filter(pa.array(ok))

    one = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold. Only documents of some pair are split into shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for x in batches:
            yield _table({"id": (None, x.column("id")), "h": (pa.binary(), [shingles(t.as_py(), memo, size).tobytes() for t in x.column("text")])})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for a, b in zip(x.column("ha"), x.column("hb"), strict=True):
                p, q = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both) > 0)
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    have = docs.join(needed, "id", "left_semi").select("id", "text").mapInArrow(sets, "id long, h binary")
    one = lambda c: have.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "ha", "hb").mapInArrow(check, "a long, b long")


def apart(n: np.ndarray, comp: np.ndarray, tile: np.ndarray, crossing: bool, sketches: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of the pairs of different components that sizes and sketches leave open, each pair once; of
    different tiles only, if ``crossing``. Pairs of one component are never compared."""
    bits = np.array([8 * len(s) for s in sketches])
    for width in np.unique(bits):
        few, all_ = np.flatnonzero(bits == width), np.flatnonzero(bits >= width)
        w = np.stack([_words(sketches[j], width) for j in all_])
        step = max(1, CELLS // (len(all_) * w.shape[1]))
        for lo in range(0, len(few), step):
            i = few[lo : lo + step, None]
            ok = (comp[i] != comp[all_]) & ((bits[all_] > width) | (all_ > i))
            ok &= np.minimum(n[i], n[all_]) * 100 >= np.maximum(n[i], n[all_]) * percent
            if crossing:
                ok &= tile[i] != tile[all_]
            p, q = np.nonzero(ok)
            if len(p):
                x, y = i[p, 0], all_[q]
                away = np.bitwise_count(w[np.searchsorted(all_, x)] ^ w[q]).sum(axis=1, dtype=np.int64)
                near_ = away <= limit(n[x], n[y], percent)
                yield x[near_], y[near_]


def across(placed: DataFrame, sizes: DataFrame, percent: int, folder: str) -> DataFrame:
    """Pairs (a, b) that share a key, lie in different components and pass the filter. ``placed``: (key, id, component),
    without the least and the greatest id of each key, whose pairs are settled.

    Keys that share documents form a block. Where that means fewer comparisons, the documents of a block are compared as
    one unit, each pair once, else those of each of its keys. Units are dealt into tiles of bounded size; each pair of
    tiles is one piece of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        by = ("whole", "unit", "ti", "tj")

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, comp, n, tile = (t.column(c).to_numpy() for c in ("id", "component", "n", "tile"))
            crossing = t.column("ti")[0].as_py() != t.column("tj")[0].as_py()
            for i, j in apart(n, comp, tile, crossing, t.column("sketch").to_pylist(), percent):
                if len(i):
                    yield _table({"a": (pa.int64(), np.minimum(ids[i], ids[j])), "b": (pa.int64(), np.maximum(ids[i], ids[j]))})

        for batch in batches:
            if not batch.num_rows:
                continue
            g = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in g], axis=0)) + 1
            cuts = [0, *edges.tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and any(held[0].column(c)[0].as_py() != part.column(c)[0].as_py() for c in by):
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from work(pa.Table.from_batches(held))

    placed = written(placed.join(sizes.groupBy("id").agg(F.max("n").alias("n")), "id").select("key", "id", "component", "n"), f"{folder}/placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("c"), F.sum("n").alias("of_n"), F.min("id").alias("low"))
    mixed = written(mixed.where("c0 <> c1").select("key", "c", "of_n", "low"), f"{folder}/mixed")
    open_ = written(placed.join(mixed, "key").select("key", "c", "of_n", "low", "id", "component", "n"), f"{folder}/apart")
    linked = components(open_.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")), f"{folder}/blocks").withColumnRenamed("component", "block")
    docs = open_.groupBy("id").agg(F.min("component").alias("component"), F.max("n").alias("n"), F.sum("c").alias("s"))
    docs = docs.join(linked.withColumnRenamed("node", "id"), "id")
    blocks = written(docs.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("of_n"), F.sum("s").alias("s")), f"{folder}/sized")
    whole = docs.select("id", "component", "block").join(blocks.where("c * c <= s"), "block").select(F.lit(True).alias("whole"), F.col("block").alias("unit"), "id", "component", "c", "of_n")
    some = linked.join(blocks.where("c * c > s"), "block").select(F.col("node").alias("id"))
    by_key = open_.join(some, "id", "left_semi").select(F.lit(False).alias("whole"), F.col("key").alias("unit"), "id", "component", "c", "of_n")
    tiles = F.ceil(F.greatest(F.col("c") / TILE, F.col("of_n") / TILE_SIZE)).cast("int")
    rows = whole.unionByName(by_key).withColumn("tiles", tiles).join(sizes, "id").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other"))
    rows = rows.select("whole", "unit", "ti", "tj", "tile", "id", "component", "n", "sketch").repartition("whole", "unit", "ti", "tj").sortWithinPartitions("whole", "unit", "ti", "tj")
    return rows.mapInArrow(run, "a long, b long").distinct()


def heavy(stored: DataFrame, folder: str) -> DataFrame:
    """Keys that hold more than an eighth of a partition's even share of all rows, as far as one document in ``SPARSE``
    tells: at most eight for each partition. The result does not depend on which are found, only how they are read."""
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = stored.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SPARSE)) == 0)).select("id", F.explode("keys").alias("key"))
    some = written(some, f"{folder}/sparse")
    often = some.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.max("id").alias("high"))
    return written(often.where((F.col("low") != F.col("high")) & (F.col("c") * 8 * parts > some.count())).select("key"), f"{folder}/heavy")


def _tidy(df: DataFrame) -> None:
    """Lets go of shuffle files whose results are stored: they go when the JVM collects what refers to them."""
    df.sparkSession.sparkContext._jvm.System.gc()


def groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(id, n, component) of (id, text)."""
    with small_batches(docs.sparkSession):
        return _groups(docs, percent, size, shared_folder(docs.sparkSession))


def _groups(docs: DataFrame, percent: int, size: int, folder: str) -> DataFrame:
    spark = docs.sparkSession
    stored = written(summarise(docs, percent, size), f"{folder}/all")
    # what a hot digest or key is joined with is stored, so that AQE can split the other side of the join
    classes = stored.where("id IS NOT NULL AND n > 0").groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    copied = stored.select("id", "n", "digest").join(written(classes, f"{folder}/classes"), ["digest", "n"], "left")
    belongs = written(copied.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("first", "id")).alias("first")), f"{folder}/belongs")
    copies = belongs.where("first <> id").select("id").distinct()

    # Keys of two documents or more, told by a row's neighbours in order: one shuffle, nothing of a group is held. Stored
    # before copies are taken out, else the optimiser would shuffle whole arrays of keys for that.
    rows = stored.where("id IS NOT NULL").select("id", F.explode("keys").alias("key"))
    hot = heavy(stored, folder)
    some_hot = not hot.isEmpty()
    by_key = Window.partitionBy("key").orderBy("id")
    cold = rows.join(F.broadcast(hot), "key", "left_anti") if some_hot else rows
    beside = cold.withColumn("low", F.lag("id").over(by_key)).withColumn("high", F.lead("id").over(by_key))
    shared = beside.where((F.col("low") != F.col("id")) | (F.col("high") != F.col("id"))).select("key", "id")
    if some_hot:
        shared = shared.unionByName(rows.join(F.broadcast(hot), "key", "left_semi").select("key", "id"))
    members = written(written(shared, f"{folder}/shared").join(copies, "id", "left_anti").select("key", "id"), f"{folder}/members")
    sizes = written(stored.where("id IS NOT NULL").select("id", "n", "sketch").join(members.select("id").distinct(), "id", "left_semi"), f"{folder}/sizes")
    for gone in ("all", "shared", "sparse", "heavy", "classes"):
        remove(spark, f"{folder}/{gone}")
    _tidy(docs)

    ends = written(members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high"), f"{folder}/ends")
    both = written(members.join(ends, "key").select("key", "id", "low", "high"), f"{folder}/both")
    for gone in ("members", "ends"):
        remove(spark, f"{folder}/{gone}")
    to_ends = F.array(F.struct(F.col("low").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("high").alias("b")))
    star = both.select(F.inline(to_ends)).where("a <> b").distinct()
    edges = written(verified(written(filtered(star, sizes, percent), f"{folder}/open0"), docs, percent, size), f"{folder}/edges0")
    joined = components(edges, f"{folder}/c0")
    _tidy(docs)

    inner = both.where((F.col("id") != F.col("low")) & (F.col("id") != F.col("high"))).select("key", "id")
    placed = inner.join(joined, inner["id"] == joined["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    rest = across(placed, sizes, percent, folder)
    more = written(verified(written(rest, f"{folder}/open1"), docs, percent, size), f"{folder}/edges1")
    last = components(edges.unionByName(more), f"{folder}/c1")
    for gone in ("both", "placed", "sizes", "open0", "edges0", "c0", "mixed", "apart", "blocks", "sized", "open1", "edges1"):
        remove(spark, f"{folder}/{gone}")
    return belongs.join(last, belongs["first"] == last["node"], "left").select("id", "n", F.coalesce("component", "first").alias("component"))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def components_of(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id) for each row; component_id is the least key reachable by links."""
    return groups(_keyed(df, key, text), percent, size).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows whose key is the least of their component, as they are; rows without a key stay."""
    others = groups(_keyed(df, key, text), percent, size).where("component <> id").select(F.col("id").alias("_other")).distinct()
    return df.join(others, df[key].cast("long") == others["_other"], "left_anti")
