import numpy as np
from pyspark.sql import functions as F

from cairnspark.llm import ann

from .conftest import sf


def brute(ids, x, asked, k):
    out = {}
    for i, v in zip(ids, x):
        if i in asked:
            score = (x * v).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute(ids, x, {i for i in ids if i % 20 == 0}, 20)
    got = found(ann.search(df.withColumn("x", F.lit(1)), F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hit >= 0.97 * 20 * len(want)
    exact = {i: v for i, v in zip(ids, x)}
    assert all(np.isclose(s, exact[q] @ exact[v], rtol=1e-12) for q in got for v, s in got[q])


def test_blocks_and_ties(spark, monkeypatch):
    for n in ("QUERIES", "ROWS", "KEEP"):
        monkeypatch.setattr(ann, n, {"QUERIES": 3, "ROWS": 50, "KEEP": 30}[n])
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5)).astype(np.float32)
    x[60:160] = 3 * x[60]  # many equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute(np.arange(200), x.astype(np.float64), set(range(0, 200, 20)), 20)
    got = found(ann.search(df, F.col("vec_id") % 20 == 0))
    same = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and same >= 0.95 * 200
    top = next(q for q in want if len({s for _, s in want[q]}) == 1)
    assert got[top] == want[top]


def near_copies(noise):
    """Three full blocks of rows, a third of them near copies of one."""
    r = np.random.default_rng(6)
    x = r.normal(size=(3 * ann.ROWS, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.arange(len(x)) % 3 == 1
    x[near] = x[1] * (1 + noise * r.normal(size=(near.sum(), 64)))
    return x


def test_near_copies_are_all_reranked(spark):
    for noise in (0.005, 0.001):
        x = near_copies(noise)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        want = brute(np.arange(len(x)), x, set(range(0, len(x), 40)), 20)
        got = found(ann.search(df, F.col("vec_id") % 40 == 0))
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_reach_never_excludes_a_row_that_has_the_score():
    x = near_copies(0.005)[:1500] * np.random.default_rng(8).uniform(0.1, 9, (1500, 1))
    book = ann.fit(x[:500].astype(np.float32))
    codes, q = book.encode(x.astype(np.float32)), np.concatenate([x[::50], -x[::60]])
    reach, approx, exact = ann.Reach(book, x, codes), ann.scan(book, q.astype(np.float32), codes), q @ x.T
    for least in np.quantile(exact, (0, 0.1, 0.5, 0.9, 0.99, 1), axis=1):
        may = reach(q, approx, least)
        assert may[exact >= least[:, None]].all()
    assert may.mean() < 0.5


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [2.0, 1.0]), (20, [-1.0, 0.5]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(6, 4.0), (20, 0.0)], 20: [(0, 0.0), (6, -1.5)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_parallel_error_is_lower_than_plain():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 16)).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(weight):
        book = ann.fit(x, parallel=weight)
        codes = book.encode(x)
        back = np.concatenate([book.centres[s, codes[:, s]] for s in range(8)], axis=1)
        return (((x - back) * unit).sum(1) ** 2).mean()

    assert parallel(4.0) < 0.7 * parallel(1.0)


def test_rows_are_coded_once_for_all_blocks_of_queries(spark, monkeypatch):
    """Each block of queries coded all rows again, so coding grew with the square of the rows."""
    monkeypatch.setattr(ann, "QUERIES", 40)
    x = np.random.default_rng(4).normal(size=(2500, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found_ = ann.search(df, F.col("vec_id") % 20 == 0)
    plan = found_._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("MapInArrow run") < plan.index("MapInArrow code")
    want = brute(np.arange(len(x)), x, set(range(0, len(x), 20)), 20)
    assert {q: [i for i, _ in v] for q, v in found(found_).items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_a_scan_is_the_sum_of_the_tables():
    x = np.random.default_rng(5).normal(size=(300, 9)).astype(np.float32)
    book = ann.fit(x)
    codes = book.encode(x)
    table = np.einsum("qsw,scw->qsc", book.parts(x[:20]), book.centres)
    sums = sum(table[:, s][:, codes[:, s]] for s in range(codes.shape[1]))
    assert np.allclose(ann.scan(book, x[:20], codes), sums, atol=1e-4)


def test_few_pairs_are_reranked_one_by_one():
    r = np.random.default_rng(9)
    x, q = r.normal(size=(2000, 64)), r.normal(size=(50, 64))
    exact = np.stack([(x * v).sum(1) for v in q])
    least = np.sort(exact, axis=1)[:, -20]
    assert (ann.near(q, x, least) >= (exact >= least[:, None])).all() and ann.near(q, x, least).sum() <= 21 * len(q)
    assert ann.near(q, np.full((1, 64), np.nan), least).all() and ann.near(q, x, np.full(50, -np.inf)).all()
