"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a linked list; a heap holds its adjacent pairs by merge rank and position. The
lowest pair is popped and merged, its neighbours' new pairs are pushed, until no pair is left that merges. The count
is the number of initial symbols less the merges made; no ids are produced.

Special strings of the vocabulary count as one token each, as in the library's default; the text between them is
counted by itself. Null text counts as empty: no bytes, no tokens. Empty tables give empty results; other columns
are ignored, whatever their names; each input row gives one row, repeated or not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _LATIN, _NUMBER, _SPACE, _library, byte_symbols
from .common import Memo

VOCABULARY = "byte_bpe_50k.json"
#: Text whose pre-tokens the pattern below gives as the library does.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-ɏ]")
_WORDS = re.compile(r"(?<=\S)(?= \S)")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LATIN}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Counter:
    """Counts tokens as a byte-level vocabulary file defines them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        back = byte_symbols()
        vocab = whole["model"]["vocab"]
        self.path = path
        self.first = [0] * 256
        for c, b in back.items():
            self.first[b] = vocab[c]
        #: The rank of two ids' merge and the id that it makes.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(whole["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.special = re.compile("|".join(re.escape(x["content"]) for x in whole["added_tokens"]) or r"(?!)")
        self.memo = Memo(lambda piece: self.size(piece.encode()))
        self.unusual = Memo(self._library)
        self.back = back

    def merges(self, data: bytes) -> int:
        """Merges made within one pre-token."""
        ids = [self.first[b] for b in data]
        n, merge = len(ids), self.merge
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        if not heap:
            return 0
        heapify(heap)
        after, before, made = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i, new = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merge.get((ids[i], ids[j])) != (rank, new):
                continue  # one of the two has gone into another symbol since
            made += 1
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], new))):
                heappush(heap, (m[0], h, m[1]))
        return made

    def size(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        return len(piece) - self.merges(piece)

    def _library(self, text: str) -> int:
        """Tokens of text whose pre-tokens the library's own stage gives."""
        back = self.back
        return sum(self.size(bytes(back[c] for c in p)) for p, _ in _library(self.path)[1].pre_tokenize_str(text))

    def plain(self, text: str) -> int:
        """Tokens of text without special strings."""
        if not _UNUSUAL.search(text):
            return sum(map(self.memo.__getitem__, _PIECE.findall(text)))
        # a single space between other characters begins a pre-token, whatever they are
        n = 0
        for part in _WORDS.split(text):
            n += self.unusual[part] if _UNUSUAL.search(part) else sum(map(self.memo.__getitem__, _PIECE.findall(part)))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        found = self.special.split(text) if "<|" in text else [text]
        return len(found) - 1 + sum(map(self.plain, found))


@cache
def counter(path: str) -> Counter:
    """One for each Python worker, memo included."""
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), n], ["key", "n_bytes", "n_tokens"])

    col = (F.col(text) if isinstance(text, str) else text).cast("string")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.octet_length(col), F.lit(0)).cast("long").alias("n_bytes"), col.alias("text"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
