import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
from pyspark.sql import functions as F

from cairnspark.llm import quality

from .conftest import sf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def rows(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()}


def test_base_equals_brute_force(spark):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = [None, "", " \t\n", "a", "a b c a b c", "x\n\nx\n \ny\nx", "é\x1ch\xa0i \x0bz", "a a a a", "# $|", "w " * 30_000, "\r\n\r\na\r\na", "a b c d a b c", " lead", "trail "]
    df = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = rows(quality.judge(df.selectExpr("*", "1 AS key", "text AS votes")))
    for d in df.collect():
        assert got[d.doc_id] == brute(d.text), (d.doc_id, (d.text or "")[:80])


def test_verdict_follows_labels(spark):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs).where("not base_failed").join(labels.withColumnRenamed("quality", "label"), "doc_id").select("kept", "label").collect()
    clean, junk = [r for r in out if r.label == 1], [r for r in out if r.label == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)
    kept = quality.accepted(docs.withColumn("votes", docs.text).withColumn("key", docs.lang))
    assert kept.columns == [*docs.columns, "votes", "key"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}


FAMILIES = [r.family for r in quality.RULES]


def sampled(n, shares, votes, seed=1):
    """Patterns of ``n`` documents of known classes."""
    r = np.random.default_rng(seed)
    out = Counter()
    for k in r.choice(len(shares), n, p=shares):
        out[tuple(int(r.choice(3, p=p)) for p in votes[k])] += 1
    return out


def plain_em(patterns, families, rounds=200):
    """The same model by matrices, without any order between the classes; gives P(clean) of each pattern."""
    x = np.array([[[v == k for k in range(3)] for v in p] for p in patterns], float)  # pattern, rule, vote
    n = np.array(list(patterns.values()), float)
    first = np.array([[quality.CLEAN] * len(families)] + [[quality.FOUND if f == kind else quality.OTHER for f in families] for kind in sorted(set(families))])
    shares0 = np.array([quality.FIRST_CLEAN] + [(1 - quality.FIRST_CLEAN) / (len(first) - 1)] * (len(first) - 1))
    votes, shares = first, shares0
    for i in range(rounds + 1):
        joint = shares * np.exp(np.einsum("prv,crv->pc", x, np.log(votes)))
        post = joint / joint.sum(1, keepdims=True)
        if i < rounds:
            votes = quality.FIRST_WEIGHT * first + np.einsum("p,pc,prv->crv", n, post, x)
            votes /= votes.sum(2, keepdims=True)
            shares = quality.FIRST_WEIGHT * shares0 + n @ post
            shares /= shares.sum()
    return dict(zip(patterns, post[:, 0]))


SHARES = [0.75, 0.15, 0.1]
KNOWN = [[(0.05, 0.05, 0.9), (0.01, 0.09, 0.9), (0.02, 0.08, 0.9)] * 2, [(0.9, 0.05, 0.05)] * 3 + [(0.2, 0.1, 0.7)] * 3, [(0.2, 0.1, 0.7)] * 3 + [(0.7, 0.2, 0.1)] * 3]
SIX = ["a"] * 3 + ["b"] * 3


def test_estimates_recover_classes_and_equal_a_plain_version():
    patterns = sampled(40_000, SHARES, KNOWN)
    e = quality.expectation_maximisation(patterns, SIX)
    assert np.allclose(e.shares, SHARES, atol=0.02) and np.allclose(e.votes, KNOWN, atol=0.08)
    want = plain_em(patterns, SIX)
    assert max(abs(e.likelihoods(p)[0][0] - x) for p, x in want.items()) < 0.02
    assert all(a > 0.9 and b > 0.4 for a, b in e.accuracies())


def test_posterior_decides_not_one_accusation():
    """A noisy rule that its family contradicts rejects nothing; abstentions of a whole family do."""
    shy = [KNOWN[0], [(0.45, 0.5, 0.05)] * 3 + [(0.2, 0.1, 0.7)] * 3, KNOWN[2]]
    e = quality.expectation_maximisation(sampled(40_000, SHARES, shy), SIX)
    clean = lambda p: e.likelihoods(p)[0][0]
    assert clean((0, 2, 2, 2, 2, 2)) > 0.9 and clean((2, 2, 2, 0, 2, 2)) > 0.9
    assert clean((1, 1, 1, 2, 2, 2)) < 0.5 and clean((0, 0, 0, 2, 2, 2)) < 0.01


def test_verdicts_differ_from_all_must_pass(spark):
    """Over texts: words that are rather long on the whole, though some are short, are accused by one rule only and stay; a text
    between the limits of several rules is accused by none and goes."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    plain = lambda: [word(r.choice((2, 3, 4, 5, 6, 7, 8))) for _ in range(200)]
    texts = [" ".join(plain()) for _ in range(400)]
    texts += [" ".join(w + "%%" * (i % 3 == 0) for i, w in enumerate(plain())) for _ in range(60)]  # junk, accused twice
    texts += [" ".join(w + "%" * (i % 6 == 0) for i, w in enumerate(plain())) for _ in range(25)]  # as it, but between the limits
    texts += [" ".join(w + "%%" * (i % 6 == 0) for i, w in enumerate(plain())) for _ in range(40)]  # accused once, the other rule abstains
    texts += [" ".join(word(r.choice((3, 9, 10, 11))) for _ in range(200)) for _ in range(12)]  # mean length above the limit
    out = quality.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id"), F.col("text"))
    posterior = quality.estimate(out).posterior(F.col("votes"))
    votes = {x.key: (list(x.votes), x.q) for x in out.select("key", "votes", posterior.alias("q")).collect()}
    name = [x.name for x in quality.RULES]
    assert all(votes[i][1] > 0.5 for i in range(400)) and all(votes[i][1] < 0.5 for i in range(400, 460))
    between = [votes[i] for i in range(460, 485)]
    assert all(v[name.index("symbols")] == v[name.index("symbol_words")] == quality.ABSTAINS and 0 not in v and q < 0.5 for v, q in between)
    long = [votes[i] for i in range(525, 537)]
    assert all(v.count(quality.AGAINST) == 1 and v[name.index("word_length")] == quality.AGAINST and q > 0.5 for v, q in long)


def test_column_gives_the_same_posterior(spark):
    e = quality.expectation_maximisation({(2,) * 9: 900, (0, 0) + (2,) * 7: 50, (2, 1, 0, 2, 0, 2, 1, 1, 2): 3}, FAMILIES)
    r = random.Random(3)
    patterns = [tuple(r.randrange(3) for _ in FAMILIES) for _ in range(50)]
    df = spark.createDataFrame([(list(p),) for p in patterns], "votes array<tinyint>")
    for p, row in zip(patterns, df.select(e.posterior(F.col("votes")).alias("q")).collect()):
        assert abs(row.q - e.likelihoods(p)[0][0]) < 1e-9


def test_another_vote_against_never_raises_the_probability():
    """However many documents there are: 2 % accused by each rule alone, few by two."""
    rules = len(quality.RULES)
    for n, pair in product((10**3, 10**5, 10**7), (1e-5, 1e-6)):
        counts = {(): n} | {(i,): 0.02 * n for i in range(rules)} | {c: pair * n for c in combinations(range(rules), 2)}
        patterns = {tuple(quality.AGAINST if i in c else quality.FOR for i in range(rules)): round(x) for c, x in counts.items() if x >= 1}
        e = quality.expectation_maximisation(patterns, FAMILIES)
        clean = {v: e.likelihoods(v)[0][0] for v in product(range(3), repeat=rules)}
        for v, p in clean.items():
            assert all(clean[(*v[:i], x - 1, *v[i + 1 :])] <= p * (1 + 1e-9) for i, x in enumerate(v) if x), (n, v)
        assert clean[(quality.FOR,) * rules] > 0.98


def test_empty_and_tiny(spark):
    df = spark.createDataFrame([(1, "word " * 10), (1, "word " * 10), (2, None)], "doc_id long, text string")
    assert quality.judge(df.limit(0)).count() == 0 and quality.accepted(df.limit(0)).count() == 0
    assert [r.kept for r in quality.judge(df).collect()] == [False] * 3
    clean = " ".join(f"word{i}" for i in range(80))
    assert quality.judge(df.selectExpr("doc_id", f"'{clean}' AS text")).where("kept").count() == 3
