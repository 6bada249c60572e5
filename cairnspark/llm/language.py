"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language where the rows are read, sums them by (language, bucket) and makes one matrix of
log-probabilities, whose size is languages x buckets whatever the input; it is broadcast. Scoring joins the texts of
a batch into blocks of code points, gathers the matrix rows of all n-grams of a block and sums them by text.

Texts are lower-cased, and what is no letter counts as a space. A text without a letter (null included) is ``und``
with score 0; so is every text if there is nothing to learn from. Equal posteriors go to the language first in
alphabetical order. Empty tables give empty results; other columns are ignored, whatever their names; each row gives
one row, repeated or not. Long texts are taken in blocks, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
#: Code points taken at once.
BLOCK = 1 << 19
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@cache
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x30000) if chr(i).isalpha()]] = True
    return table


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def _hashed(points: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the n-grams that start at each code point but the last two; a row for each size."""
    x = np.where(_letters()[points], points, 32).astype(np.uint64)
    n = len(x) - 2
    out, h = np.empty((len(SIZES), n), dtype=np.int64), np.zeros(n, dtype=np.uint64)
    for i, size in enumerate(SIZES):
        h = (h + x[size - 1 : n + size - 1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out[i] = (h >> np.uint64(40)).astype(np.int64) % buckets
    return out


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of texts, where each starts, code points with two spaces after each text); a text longer than a block
    comes in several, which overlap by two code points."""
    numbers: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def made() -> tuple[list[int], np.ndarray, np.ndarray]:
        return list(numbers), np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts)

    for i, t in enumerate(texts):
        if not has_letter(t):
            continue
        points = np.frombuffer((t.lower() + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for at in range(0, len(points) - 2, BLOCK):
            part = points[at : at + BLOCK + 2]
            if parts and held + len(part) > BLOCK:
                yield made()
                numbers, parts, held = [], [], 0
            numbers.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield made()


def _sums(values: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Sums over each text's n-grams of ``values`` (one for each code point but the block's last two), without the two
    that start on the spaces between texts."""
    ends = np.append(starts[1:], total) - 2
    edges = np.column_stack([starts, ends]).ravel()
    return np.add.reduceat(np.concatenate([values, np.zeros((2, values.shape[1]), values.dtype)]), edges, axis=0)[::2]


class Model:
    """Priors and log-probabilities of the languages, in alphabetical order."""

    def __init__(self, languages: list[str], prior: np.ndarray, weight: np.ndarray):
        self.languages, self.prior, self.weight = languages, prior, weight

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        total = np.zeros((len(texts), len(self.languages)))
        seen = np.zeros(len(texts), dtype=bool)
        for numbers, starts, points in _blocks(texts):
            value = sum(self.weight[b] for b in _hashed(points, len(self.weight)))
            np.add.at(total, numbers, _sums(value.astype(np.float64), starts, len(points)))
            seen[numbers] = True
        total += self.prior
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i in np.flatnonzero(seen):
            names[i], scores[i] = self.languages[best[i]], float(posterior[i])
        return names, scores


def train(df: DataFrame, label: str = "lang", text: str = "text", buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """Learns from the rows whose label is not null. What reaches the driver: a count for each language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, texts = batch.column("label").to_pylist(), batch.column("text").to_pylist()
            for name in set(labels):
                some = [t for t, x in zip(texts, labels, strict=True) if x == name and has_letter(t)]
                held = counts.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))
                held[buckets] += len(some)
                for _, starts, points in _blocks(some):
                    inside = np.ones(len(points), dtype=bool)
                    ends = np.append(starts[1:], len(points))
                    inside[ends - 1] = inside[ends - 2] = False
                    for b in _hashed(points, buckets):
                        held[:buckets] += np.bincount(b[inside[:-2]], minlength=buckets)
        for name, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at])], ["label", "bucket", "n"])

    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["label"].to_pylist()))
    table = np.zeros((buckets + 1, max(1, len(names))))
    where = {x: i for i, x in enumerate(names)}
    table[found["bucket"].to_numpy(), [where[x] for x in found["label"].to_pylist()]] = found["n"].to_numpy()
    docs = table[buckets]
    grams = table[:buckets] + smoothing
    prior = np.log((docs + 1) / (docs + 1).sum())
    return Model(names, prior, np.log(grams / grams.sum(axis=0)).astype(np.float32))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = held.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def lettered(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    at = df.columns.index(text)
    return df.mapInArrow(run, df.schema)


def certain(df: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows whose language the model gives with a score of ``least`` or more, as they are."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = held.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    at = df.columns.index(text)
    return df.mapInArrow(run, df.schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, key: str = "doc_id", label: str = "lang", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score): learns from the labelled documents that are not held out."""
    model = train(df.where(~held_out(key)), label, text)
    return predict(df, model, key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
