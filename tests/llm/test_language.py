import math
import zlib

import numpy as np
import pytest

from cairnspark.llm import language

from .conftest import sf


def brute(model, text):
    """Posterior by a plain loop over n-grams."""
    x = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32]
    total = model.prior.copy()
    for i in range(len(x) - 2):
        h = 0
        for size in language.SIZES:
            h = (h + x[i + size - 1] + 1) * 0x9E3779B97F4A7C15 % 2**64
            total = total + model.weight[(h >> 40) % len(model.weight)].astype(float)
    return total


def test_scores_equal_brute_force(monkeypatch):
    r = np.random.default_rng(1)
    model = language.Model(["aa", "bb", "cc"], np.log([0.5, 0.3, 0.2]), np.log(r.random((512, 3))).astype(np.float32))
    texts = ["abc déf", None, "", "123", "x", "zürich " * 9, "ab", "Éa"]
    for block in (1 << 19, 16, 7):
        monkeypatch.setattr(language, "BLOCK", block)
        names, scores = model.predict(texts)
        for t, n, s in zip(texts, names, scores):
            if not t or not any(c.isalpha() for c in t):
                assert (n, s) == ("und", 0.0)
            else:
                want = brute(model, t)
                assert n == model.languages[int(want.argmax())]
                assert math.isclose(s, 1 / np.exp(want - want.max()).sum(), rel_tol=1e-3)


def test_training_equals_a_plain_loop(spark):
    rows = [("aa", "Ab c1"), ("bb", "zürich é"), ("aa", None), ("bb", "12"), ("aa", "b" * 40), (None, "abc"), ("cc", "7")]
    model = language.train(spark.createDataFrame(rows, "lang string, text string").repartition(3), buckets=512)
    counts, docs = {x: np.zeros(512) for x in ("aa", "bb")}, {"aa": 0, "bb": 0}
    for label, text in rows:
        if label in counts and language.has_letter(text):
            docs[label] += 1
            x = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32]
            for i in range(len(x) - 2):
                h = 0
                for size in language.SIZES:
                    h = (h + x[i + size - 1] + 1) * 0x9E3779B97F4A7C15 % 2**64
                    counts[label][(h >> 40) % 512] += 1
    assert model.languages == ["aa", "bb"]
    for i, label in enumerate(model.languages):
        want = np.log((counts[label] + 0.5) / (counts[label] + 0.5).sum())
        assert np.allclose(model.weight[:, i], want, atol=1e-5)
        assert math.isclose(model.prior[i], math.log((docs[label] + 1) / (sum(docs.values()) + 2)))


def test_certain_keeps_rows_as_they_are(spark):
    model = language.train(spark.createDataFrame([("en", "the of and"), ("de", "der die das")], "lang string, text string"))
    cols = "score string, lang_pred int, key int, _text string, text string, held_out int"
    df = spark.createDataFrame([("s", 1, 2, "t", "the and", 3), (None, None, None, None, None, None), ("s", 1, 2, "t", "7", 3)], cols)
    kept = language.certain(df, model, 0.5)
    assert kept.dtypes == df.dtypes and [tuple(r) for r in kept.collect()] == [("s", 1, 2, "t", "the and", 3)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_edges(spark):
    a, b, c = [i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    df = spark.createDataFrame([(a, None, "en", 0.5), (a, "the", None, 0.1), (b, "", "en", 0.2), (b, "the", "en", 0.2), (c, "7 8", "fr", 0.0)], "doc_id long, text string, lang string, score double")
    got = sorted((r.doc_id, r.lang_pred) for r in language.identify(df).collect())
    assert got == sorted([(a, "und"), (a, "en"), (b, "und"), (b, "en"), (c, "und")])
    assert language.identify(df.limit(0)).count() == 0
    none = language.identify(df.withColumn("lang", df.lang.cast("string").substr(9, 1)).where("lang is null")).collect()
    assert {r.lang_pred for r in none} <= {"und"}


@pytest.mark.parametrize("text", ["²", "½", "_", "5", "́"])
def test_no_letter(text):
    assert not language.has_letter(text)
