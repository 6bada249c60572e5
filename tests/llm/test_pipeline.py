"""Each stage against a plain version of what it decides, on its own input; then the whole."""

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from cairnspark.llm import bpe, language, quality, secrets

from .conftest import sf
from .test_jaccard import brute
from .test_packing import whole


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output rows of each stage."""
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        f(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_stage(stages):
    before, after = stages[0]
    assert ids(after) == ids(quality.judge(before).where("kept")) and 0 < after.count() < before.count()


def test_language_stage(stages):
    before, after = stages[1]
    rows = before.collect()
    model = language.train(before.where(~language.held_out()))
    names, scores = model.predict([r.text for r in rows])
    assert ids(after) == {r.doc_id for r, n, s in zip(rows, names, scores) if n != "und" and s >= 0.5}


def test_near_copy_stage(stages):
    before, after = stages[2]
    want = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert ids(after) == {i for i, (_, c) in want.items() if c == i}


def test_secret_stage(stages):
    before, after = stages[3]
    old, s = {r.doc_id: r for r in before.collect()}, secrets.Scanner()
    for r in after.collect():
        assert not s.spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == old[r.doc_id].text) == (not s.spans(old[r.doc_id].text))
    assert ids(after) == set(old)


def test_packing_stage_and_run(spark, stages):
    before, after = stages[4]
    lib = Tokenizer.from_file(P.path(bpe.VOCABULARY))
    tokens = {r.doc_id: lib.encode(r.text, add_special_tokens=False).ids + [2] for r in before.collect()}
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for df in (after, pipeline.run(spark, sf)):
        assert whole([tuple(r) for r in df.select(cols).collect()], tokens, 4096) < 0.03


def test_stages_take_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, None, "en", "s", 0), (-1, "", None, None, None), (None, "word " * 60, "en", "s", 1)], docs.schema)
    for start in (docs.limit(40).unionByName(odd), docs.limit(0)):
        df = start
        for _, f in pipeline.STAGES:
            df = f(spark, df, sf)
        assert df.count() >= 0


def test_stages_take_columns_of_any_name(spark):
    names = ["score", "lang_pred", "_text", "key", "votes", "quality", "component", "id", "first", "row", "_other", "base_failed"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.limit(60).select("*", *[language.F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, f in pipeline.STAGES[:-1]:
        after = f(spark, more, sf)
        assert after.dtypes == more.dtypes and after.count() > 0, name
        more = after
    assert pipeline.STAGES[-1][1](spark, more, sf).count() > 0


def test_language_stage_without_a_language(spark):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spark.createDataFrame([(1, "clean words", None, "s", 11), (2, "12 _ 3!", None, "s", 7), (3, None, None, "s", 0), (4, "é", None, None, 1), (None, "x", None, "s", 1)], docs.schema)
    after = pipeline.language_id(spark, rows, sf)
    assert after.dtypes == rows.dtypes and sorted(map(str, after.collect())) == sorted(str(r) for r in rows.collect() if r.doc_id in (1, 4, None))
    held = docs.where(language.held_out() & (language.F.length("text") > 0)).limit(20)
    assert pipeline.language_id(spark, held, sf).count() == sum(language.has_letter(r.text) for r in held.collect()) > 0
