from collections import Counter

import pytest

from cairnspark.llm import sharding

from .conftest import sf


@pytest.fixture
def store(spark, tmp_path):
    return sharding.Store(spark, f"file://{tmp_path}/store", target=60_000)


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_append_compact_vacuum(spark, store, monkeypatch):
    monkeypatch.setattr(sharding, "LOWEST", 8000)
    monkeypatch.setattr(sharding, "JOB_RUNS", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert store.append(docs.where("doc_id % 2 = 0"), 10) == 1
    assert store.append(docs.where("doc_id % 2 = 1"), 10) == 2
    before = store.shards()
    assert rows(store.read(1)) == rows(docs.where("doc_id % 2 = 0"))
    version = store.compact()
    after = store.shards()
    assert version == store.version() > 2 and len(after) < len(before) / 2
    assert not store.runs(after) and all(s.bytes < 1.5 * store.target for s in after) and len(after) > 2
    assert rows(store.read()) == rows(docs)
    assert rows(store.read(2)) == rows(docs)  # the old version still stands
    store.vacuum()
    assert rows(store.read()) == rows(docs)


def test_runs_merge_similar_sizes_up_to_the_target(store):
    s = [sharding.Shard(f"/data/x/{i}", b) for i, b in enumerate([10_000] * 7 + [70_000, 59_000])]
    runs = store.runs(s)
    assert [len(r) for r in runs] in ([6, 2], [6]) and all(sum(x.bytes for x in r) <= 60_000 for r in runs)


def test_only_one_writer_commits_a_version(spark, store):
    store.append(spark.range(3).toDF("doc_id"))
    schema = store.manifest()["schema"]
    assert store.commit(1, schema, [], []) and not store.commit(1, schema, store.manifest(1)["small"], [])
    assert store.version() == 2 and store.shards() == []


def test_rows_come_through(spark):
    df = spark.createDataFrame([(1, None, "a", 1, 2), (1, None, "a", 1, 2), (2, "", "b", 1, 2), (None, "é" * 9000, "c", 1, 2)], "doc_id long, text string, shard string, _shard int, path int")
    got = sharding.shard(df)
    assert Counter((r.doc_id, r.n_bytes) for r in got.collect()) == Counter([(1, None), (1, None), (2, 0), (None, 18_000)])
    assert got.columns == ["doc_id", "n_bytes", "shard", "version"]
    assert sharding.shard(df.limit(0)).count() == 0


def test_lists_of_full_shards_are_left_alone(spark, store, monkeypatch):
    monkeypatch.setattr(sharding, "LOWEST", 8000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    store.append(docs, 10)
    store.compact()
    full = store.manifest()["full"]
    store.append(docs.where("doc_id % 3 = 0"), 10)
    store.compact()
    assert full and store.manifest()["full"][: len(full)] == full
    assert rows(store.read()) == rows(docs) + rows(docs.where("doc_id % 3 = 0"))
