"""Maximum inner product search by score-aware anisotropic quantisation.

Vectors are split into subspaces of equal width and each part is coded by one of sixteen centres, four bits. Centres
are fitted, and codes chosen, under a loss that weighs the part of the residual that is parallel to the vector more
than the part across it: only the parallel error changes the scores of the queries a vector ranks high for. The
codebook is fitted on a bounded sample (``SAMPLE`` rows); every row is coded and scanned.

The stated queries meet all rows in blocks. Queries are dealt into blocks of bounded size, each task of a block scans
the codes of its share of rows, which are made once for all blocks, and reranks the best ``KEEP`` of each
query with exact inner products in double precision. Every other row whose code leaves room for a score as high as the
k-th exact one so far is then reranked too, however many they are, so the result is exact. The tasks' best are merged.

Rows whose vector is null, zero, of another width than most of the sample, or has a null or non-finite component take
no part; rows without an id neither. Of equal vectors only the least ids can be among the nearest, so a task keeps
``k + 1`` of each, which makes no difference to the result. Ties go to the smaller id. Rows that share an id count each.
Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CENTRES = 16
#: Rows that the codebook is fitted on, at most.
SAMPLE = 4096
#: Width of a subspace, weight of the parallel error, rounds of fitting.
WIDTH, PARALLEL, ROUNDS = 2, 4.0, 8
#: Queries of a block, rows of a task's share (at least three shares), rows of a scanned block, candidates of a query
#: that are reranked first in each.
QUERIES, SHARE, ROWS, KEEP = 1024, 4096, 2048, 192
#: Queries whose other candidates are found at once, pairs that are reranked at once, rounding of a scan (in products of
#: lengths; the sums are of single precision).
STEP, PAIRS, ROUNDING = 128, 1 << 16, 1e-5


@dataclass(frozen=True)
class Codebook:
    """``centres``: (subspaces, 16, width); vectors are padded with zeros to a whole number of subspaces."""

    dimension: int
    centres: np.ndarray
    parallel: float = PARALLEL

    def parts(self, x: np.ndarray) -> np.ndarray:
        subspaces, _, width = self.centres.shape
        padded = np.zeros((len(x), subspaces * width), np.float32)
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), subspaces, width)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, subspaces) that minimise the anisotropic loss: from the nearest centres, each subspace in turn
        takes the centre that is best given the others, for the parallel error sums over subspaces."""
        p = self.parts(x)
        unit = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = np.stack([((p[:, s, None, :] - c) ** 2).sum(-1).argmin(1) for s, c in enumerate(self.centres)], axis=1)
        along = np.stack([((p[:, s] - c[codes[:, s]]) * unit[:, s]).sum(-1) for s, c in enumerate(self.centres)], axis=1)
        for _ in range(2):
            total = along.sum(1)
            for s, c in enumerate(self.centres):
                residual = p[:, s, None, :] - c
                mine = (residual * unit[:, s, None, :]).sum(-1)
                loss = (residual**2).sum(-1) + (self.parallel - 1) * (mine + (total - along[:, s])[:, None]) ** 2
                codes[:, s] = loss.argmin(1)
                now = np.take_along_axis(mine, codes[:, s, None], 1)[:, 0]
                total, along[:, s] = total - along[:, s] + now, now
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(codes), -1)[:, : self.dimension].astype(np.float64)


def fit(x: np.ndarray, width: int = WIDTH, parallel: float = PARALLEL, seed: int = 7) -> Codebook:
    """Alternates coding with the least-squares centres of the anisotropic loss, one subspace after another."""
    n, d = x.shape
    subspaces = -(-d // width)
    r = np.random.default_rng(seed)
    start = x[r.integers(0, n, CENTRES)]
    book = Codebook(d, np.zeros((subspaces, CENTRES, width), np.float32), parallel)
    book.centres[:] = book.parts(start).transpose(1, 0, 2) + r.normal(0, 1e-4, book.centres.shape)
    p = book.parts(x).astype(np.float64)
    unit = p / np.linalg.norm(x, axis=1)[:, None, None]
    for _ in range(ROUNDS):
        codes = book.encode(x)
        along = np.stack([((p[:, s] - book.centres[s, codes[:, s]]) * unit[:, s]).sum(-1) for s in range(subspaces)], axis=1)
        for s in range(subspaces):
            other = along.sum(1) - along[:, s]
            for c in range(CENTRES):
                at = np.flatnonzero(codes[:, s] == c)
                if not len(at):  # an idle centre starts anew on a random row
                    book.centres[s, c] = p[r.integers(0, n), s]
                    continue
                u, y = unit[at, s], p[at, s]
                left = len(at) * np.eye(width) + (parallel - 1) * u.T @ u
                right = y.sum(0) + (parallel - 1) * (u * ((y * u).sum(1) + other[at])[:, None]).sum(0)
                book.centres[s, c] = np.linalg.solve(left, right)
            along[:, s] = ((p[:, s] - book.centres[s, codes[:, s]]) * unit[:, s]).sum(-1)
    return book


def scan(book: Codebook, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows): products of the queries with what the codes stand for. One product of matrices
    takes a tenth of the time of sums from look-up tables, which are the same but for the order of their terms."""
    subspaces = np.arange(len(book.centres))
    back = book.centres[subspaces, codes].reshape(len(codes), -1)
    return book.parts(queries).reshape(len(queries), -1) @ back.T


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _merge(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query of both, by falling score and rising id."""
    score, ids = np.concatenate([best[0], score], axis=1), np.concatenate([best[1], ids], axis=1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _candidates(approx: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` highest of each row; which of equals does not matter, as the rest is looked at too."""
    n = approx.shape[1]
    if n <= keep:
        return np.broadcast_to(np.arange(n), approx.shape)
    return np.argpartition(-approx, keep - 1, axis=1)[:, :keep]


class Reach:
    """Which rows can reach a score, given their approximate ones.

    Let t be a query's component along a row x, so that its score is t |x|. The residual of the code has a component p
    along x and a length b across it; hence the approximate score is at least t (|x| - p) - b sqrt(|q|^2 - t^2), which
    is convex in t. A row whose approximate score is below the least of that over all t from the asked score on cannot
    have it."""

    def __init__(self, book: Codebook, x: np.ndarray, codes: np.ndarray):
        back = book.decode(codes)
        self.size = np.linalg.norm(x, axis=1)
        unit = x / self.size[:, None]
        residual = x - back
        p = (residual * unit).sum(1)
        self.along, self.across = self.size - p, np.linalg.norm(residual - p[:, None] * unit, axis=1)
        self.turn = self.along / np.hypot(self.along, self.across)
        self.rounding = ROUNDING * (self.size + np.linalg.norm(back, axis=1))

    def __call__(self, q: np.ndarray, approx: np.ndarray, least: np.ndarray) -> np.ndarray:
        """(queries, rows); true also where a number is not finite."""
        length = np.linalg.norm(q, axis=1)[:, None]
        t = np.minimum(np.maximum(-length * self.turn, least[:, None] / self.size), length)
        bound = t * self.along - self.across * np.sqrt(np.maximum(length**2 - t**2, 0))
        return ~(approx < bound - length * self.rounding)


def near(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(queries, rows) whose score in double precision is at least ``least``, or too close below it, by the rounding of a
    product of matrices, to tell; true also where a number is not finite. The bound of the codes may leave most pairs of a
    block, and to rerank them one by one took most of the time."""
    slack = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1) * (1e-15 * (x.shape[1] + 8)) + 1e-300
    return ~(q @ x.T < least[:, None] - slack)


def _best_of_pairs(at: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each of ``n`` queries from (query, score, id); what is missing scores minus infinity."""
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    top = nth < k
    out = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
    out[0][at[top], nth[top]], out[1][at[top], nth[top]] = score[top], ids[top]
    return out


def _first_of_equals(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows by rising id, at most ``k`` of equal vectors."""
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(x[order] + 0.0).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    group = same[by]
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return order[np.sort(by[nth < k])]


def usable(vector: Column) -> Column:
    """Not null, some component not zero, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", book: Codebook | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row that ``queries`` picks."""
    spark = df.sparkSession
    ids = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), queries.alias("q")).where(F.col("id").isNotNull() & usable(F.col("x")))
    schema = "query_id long, rank int, vec_id long, score double"
    if book is None:
        some = ids.orderBy(F.xxhash64("id")).limit(SAMPLE).select("x").toArrow()["x"].to_pylist()
        if not some:
            return spark.createDataFrame([], schema)
        widths = [len(v) for v in some]
        d = max(set(widths), key=lambda w: (widths.count(w), w))
        book = fit(np.array([v for v in some if len(v) == d], dtype=np.float32))
    d = book.dimension
    ids = ids.where(F.size("x") == d)
    asked = ids.where("q").select("id", "x")
    counts = ids.agg(F.count_if("q").alias("asked"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-counts["asked"] // QUERIES))
    held = spark.sparkContext.broadcast(book)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = [held.value.encode(_matrix(batch.column("x").slice(at, ROWS), d).astype(np.float32)) for at in range(0, len(batch), ROWS)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array([c.tobytes() for part in codes for c in part], pa.binary())], ["id", "x", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has whole blocks of queries, each before its rows."""
        book = held.value
        block, parts, q_ids, q, best, rows = None, [], None, None, None, []

        def flush() -> None:
            nonlocal best, rows, q, q_ids, parts
            if parts:
                q_ids, q, parts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), []
                best = (np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64))
            if not rows or q is None:
                rows = []
                return
            ids, x, coded = (np.concatenate([r[j] for r in rows]) for j in range(3))
            rows = []
            first = _first_of_equals(x, ids, k + 1)
            ids, x = ids[first], x[first]
            coded = coded[first]
            approx = scan(book, q.astype(np.float32), coded)
            approx[q_ids[:, None] == ids[None, :]] = -np.inf
            at = _candidates(approx, KEEP)
            exact = np.stack([(x[a] * v).sum(1) for a, v in zip(at, q, strict=True)])  # row by row: equal vectors, equal bits
            exact[ids[at] == q_ids[:, None]] = -np.inf
            best = _merge(best, exact, ids[at], k)
            if len(ids) > KEEP:
                rest(x, ids, coded, approx, at)

        def rest(x: np.ndarray, ids: np.ndarray, coded: np.ndarray, approx: np.ndarray, at: np.ndarray) -> None:
            """Merges the rows beyond ``at`` that may be among the best."""
            nonlocal best
            with np.errstate(all="ignore"):
                reach = Reach(book, x, coded)
                for lo in range(0, len(q), STEP):
                    some = slice(lo, lo + STEP)
                    least = best[0][some, k - 1].copy()
                    may = reach(q[some], approx[some], least)
                    np.put_along_axis(may, at[some], False, axis=1)
                    may &= q_ids[some, None] != ids[None, :]
                    may &= near(q[some], x, least)
                    who, row = np.nonzero(may)
                    for i in range(0, len(who), PAIRS):
                        a, r = who[i : i + PAIRS], row[i : i + PAIRS]
                        exact = (x[r] * q[lo + a]).sum(1)
                        good = exact >= least[a]
                        new = _best_of_pairs(a[good], exact[good], ids[r[good]], len(least), k)
                        best[0][some], best[1][some] = _merge((best[0][some], best[1][some]), *new, k)

        def done() -> Iterator[pa.RecordBatch]:
            flush()
            if q is not None and best is not None:
                out = pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, k)), pa.array(best[1].ravel()), pa.array(best[0].ravel())], ["query_id", "vec_id", "score"])
                yield out.filter(pa.array(np.isfinite(best[0].ravel())))

        for batch in batches:
            b, kind, i = (batch.column(c).to_numpy() for c in ("unit", "kind", "id"))
            x = _matrix(batch.column("x"), d)
            cuts = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if b[lo] != block:
                    yield from done()
                    block, parts, q, q_ids, best, rows = b[lo], [], None, None, None, []
                if kind[lo] == 0:
                    parts.append((i[lo:hi], x[lo:hi]))
                    continue
                codes = np.frombuffer(b"".join(batch.column("codes").slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1)
                for s in range(lo, hi, ROWS):
                    end = min(hi, s + ROWS)
                    rows.append((i[s:end], x[s:end], codes[s - lo : end - lo]))
                    if sum(len(r[0]) for r in rows) >= ROWS:
                        flush()
        yield from done()

    # A unit is a block of queries and a share of the rows: queries go to all shares, rows to all blocks.
    shares = max(3, -(-counts["rows"] // SHARE))
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)), F.pmod(F.xxhash64("id"), F.lit(shares))
    left = asked.select(block.alias("block"), to_all(shares).alias("share"), F.lit(0).alias("kind"), "id", "x", F.lit(None).cast("binary").alias("codes"))
    coded = ids.select("id", "x").mapInArrow(code, "id long, x array<double>, codes binary")
    right = coded.select(to_all(blocks).alias("block"), share.alias("share"), F.lit(1).alias("kind"), "id", "x", "codes")
    units = left.unionByName(right).withColumn("unit", F.col("block") * shares + F.col("share")).select("unit", "kind", "id", "x", "codes")
    units = units.repartition(blocks * shares, "unit").sortWithinPartitions("unit", "kind", "id")
    found = units.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
