import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from cairnspark.llm import packing

from .conftest import sf

WORD = P.path("word_bpe_49k.json")


def test_differencing_splits_evenly():
    r = random.Random(1)
    for _ in range(200):
        sizes, k = [r.randint(1, 900) for _ in range(r.randint(1, 60))], r.randint(1, 9)
        parts = packing.differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) <= k
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) <= sum(sizes) / k + max(sizes)
    assert packing.differencing([], 3) == []


def test_window_count_rises_on_overflow():
    assert len(packing.windows([3, 3, 3], 5)) == 3
    assert len(packing.windows([2, 2], 4)) == 1


def whole(rows, ids, capacity):
    """Every id lies in one piece, sequences are gapless and within the capacity; gives the padded share."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r[0]].append(r)
        seqs[r[5]].append(r)
    for k, pieces in docs.items():
        at = 0
        for _, start, length, crc, n, *_ in sorted(pieces, key=lambda p: p[1]):
            assert start == at and length > 0 and n == len(ids[k]) and crc == zlib.crc32(np.array(ids[k][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[k])
    assert set(docs) == set(ids)
    padded = total = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= capacity
        total += at
        padded += at if at & (at - 1) == 0 else capacity
    return padded / max(total, 1) - 1


def test_packer():
    r = random.Random(2)
    for capacity in (8, 64, 4096):
        ids = {i: [r.randint(0, 49000) for _ in range(int(r.paretovariate(0.7)) % (capacity * 5) + 1)] for i in range(600)}
        p, rows = packing.Packer(5, capacity), []
        for k, x in ids.items():
            rows += p.add(k, np.array(x, "<i4").tobytes())
        rows += p.close(last=True)
        assert whole(rows, ids, capacity) < (0.25 if capacity == 8 else 0.03)


def test_rows(spark):
    lib = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the " * 9000)], "doc_id long, text string"))
    ids = {d.doc_id: lib.encode(d.text or "", add_special_tokens=False).ids + [2] for d in docs.collect()}
    rows = [tuple(r) for r in packing.pack(docs.withColumn("key", docs.text).withColumn("length", docs.doc_id), WORD).collect()]
    assert whole(rows, ids, 4096) < 0.03
    assert packing.pack(docs.limit(0), WORD).count() == 0
