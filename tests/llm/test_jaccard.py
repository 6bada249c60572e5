import random
import re

import numpy as np
import pytest

from cairnspark.llm import components, jaccard

from .conftest import sf


def brute_sets(rows, size):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(rows, size=4, percent=85):
    sets = brute_sets(rows, size)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(r, words, share):
    w = list(words)
    for _ in range(max(1, int(len(w) * share))):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice(([], [f"x{r.random()}"], [w[k], f"y{r.random()}"]))
    return " ".join(w)


def hard_rows(seed=1):
    """Families of edited copies whose similarity lies around the threshold, of many sizes."""
    r, rows = random.Random(seed), []
    for n in [1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 30, 50, 80, 200, 700]:
        for _ in range(3):
            base = [r.choice("abcdefghij") * r.randint(1, 3) if r.random() < 0.3 else f"w{r.randrange(9999)}" for _ in range(n)]
            rows += [edited(r, base, s) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05)]
    rows += [None, "", " \t", "A b c d", "a B C D", "a b c d e", "é É"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_keys_meet_for_every_similar_pair():
    r, memo = np.random.default_rng(2), jaccard._Memo()
    for percent in (80, 85, 95):
        for n in [1, 2, 3, 5, 6, 7, 9, 12, 20, 33, 60, 150, 600]:
            for _ in range(120):
                union = r.integers(0, 2**64, n, dtype=np.uint64)
                if r.random() < 0.3:  # all hashes in few blocks, so that most are empty
                    union = (union >> np.uint64(3)) | (r.integers(0, 2, dtype=np.uint64) << np.uint64(63))
                gone = int((100 - percent) * n // 100)
                split = r.integers(0, gone + 1)
                a, b = np.unique(union[: n - split]), np.unique(np.concatenate([union[: n - gone], union[n - split :]]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(jaccard.keys(a, percent), jaccard.keys(b, percent))), (n, percent)
                    assert jaccard.near([jaccard.sketch(a)], [jaccard.sketch(b)], np.array([len(a)]), np.array([len(b)]), percent)[0]
    assert len(jaccard.shingles(None, memo)) == 0


def test_sketch_bounds_difference():
    r = np.random.default_rng(3)
    for _ in range(200):
        u = np.unique(r.integers(0, 2**64, 300, dtype=np.uint64))
        a, b = u[: r.integers(1, 300)], u[r.integers(0, 299) :]
        bits = 8 * min(len(jaccard.sketch(a)), len(jaccard.sketch(b)))
        away = np.bitwise_count(jaccard._words(jaccard.sketch(a), bits) ^ jaccard._words(jaccard.sketch(b), bits)).sum()
        assert away <= len(np.setxor1d(a, b))


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 3)
    rows = hard_rows()
    df = spark.createDataFrame([(i, t, 0, "q") for i, t in rows], "doc_id long, text string, id int, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(df).collect()}
    assert got == brute(rows)


def near_group(r, n, words=60):
    """Copies of one text with a few words changed each: most pairs lie around the threshold."""
    base = [f"w{r.randrange(9999)}" for _ in range(words)]
    return [" ".join(f"x{r.random()}" if r.random() < 0.012 else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("parts, hot", [(4, False), (64, True)])
def test_large_group_of_near_copies(spark, monkeypatch, parts, hot):
    """Each pair is given out once at most, and the keys that many documents share are read apart without loss."""
    monkeypatch.setattr(jaccard, "TILE", 40)
    monkeypatch.setattr(jaccard, "SPARSE", 1 if hot else 1 << 20)
    given, found = [], []
    across, heavy = jaccard.across, jaccard.heavy
    monkeypatch.setattr(jaccard, "across", lambda *a: given.append(across(*a)) or given[-1])
    monkeypatch.setattr(jaccard, "heavy", lambda *a: found.append(heavy(*a)) or found[-1])
    monkeypatch.setattr(jaccard, "remove", lambda *a: None)
    rows = list(enumerate(near_group(random.Random(4), 240) + [None, "a b", "a b"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(df).collect()}
        pairs = [tuple(r) for r in given[0].collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows) and (found[0].count() > 0) == hot
    assert len(pairs) == len(set(pairs)) and all(got[a][1] is not None and a < b for a, b in pairs)


def test_rows_without_id_are_in_no_group(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (None, "a b c d e"), (2, "A b c d e"), (1, "a b c d e")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.components_of(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("None", None)]
    assert jaccard.representatives(df).count() == 3


def test_documents_and_representatives(spark):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()], 5, 80)
    kept = jaccard.representatives(docs.withColumn("id", docs.text), percent=80, size=5)
    assert kept.columns == [*docs.columns, "id"]
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert jaccard.components_of(df.limit(0)).count() == 0
    assert [tuple(r) for r in jaccard.components_of(df).collect()] == [(1, 1, 1)]


def test_stars_find_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low.get(a, a), low.get(b, b))
    assert got == {k: v for k, v in low.items() if any(a != b and k in (a, b) for a, b in edges)}
