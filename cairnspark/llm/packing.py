"""Packing of token ids into windows by multiway Karmarkar-Karp differencing.

Each task packs what it reads, so nothing is shuffled and memory is bounded by one group of pieces. A document's ids
end with a separator. Whole windows are cut off the front of long documents; what is left of each goes into a group,
which closes when it holds ``windows`` windows' worth less a little slack (the document at its edge is cut). Then the
pieces of the group are split over the windows: every piece starts as a partition of its own, and the two partial
partitions of the largest imbalance are merged, fullest part with emptiest, until one is left. If its fullest window
exceeds the capacity, the group is split over one window more.

The last group of a task is smaller; what it holds beyond whole windows becomes sequences of falling powers of two,
which need no padding.

Null text counts as empty: the separator alone. Empty tables give empty results; other columns are ignored, whatever
their names; each row is packed, repeated or not. Sequence ids are unique over all tasks and the same in a repeated
run over the same partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder

CAPACITY = 4096
SEPARATOR = 2
#: Windows of a group, and the share of its capacity that stays free so that no window overflows.
WINDOWS = 64
SLACK = 0.005
#: What is left of a document is cut into pieces of at most this part of a window: the shorter, the more even.
PIECES = 8


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Splits the numbers of ``sizes`` over at most ``k`` parts of nearly equal sums; parts as lists of positions."""
    #: (imbalance, tie, parts by falling sum as (sum, positions)); parts that are not listed are empty.
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heappop(heap), heappop(heap)
        free = k - len(a)
        merged = a + b[:free]
        for j, (s, at) in enumerate(b[free:], 1):  # the fullest of b that finds no empty part meets the emptiest of a
            t, other = a[-j]
            merged[len(a) - j] = (s + t, other + at)
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        heappush(heap, (low - merged[0][0], tie, merged))
        tie += 1
    return [at for _, at in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The least count of windows, from the sum upwards, at which differencing keeps all within the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


class Packer:
    """Packs the documents of one task. Pieces come out as
    (key, start, length, crc32, tokens of the document, sequence, offset)."""

    def __init__(self, first: int, capacity: int = CAPACITY, count: int = WINDOWS, slack: float = SLACK, longest: int | None = None):
        self.sequence, self.capacity, self.slack = first, capacity, slack
        self.longest = longest or max(1, capacity // PIECES)
        self.room = max(capacity, int(count * capacity * (1 - slack)))
        self.group: list[tuple] = []
        self.held = 0

    def _number(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def add(self, key: object, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4

        def piece(start: int, length: int) -> tuple:
            return key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n

        start = 0
        while n - start >= self.capacity:
            yield *piece(start, self.capacity), self._number(), 0
            start += self.capacity
        while start < n:
            length = min(n - start, self.room - self.held, self.longest)
            self.group.append((*piece(start, length), ids[4 * start : 4 * (start + length)]))
            self.held += length
            start += length
            if self.held >= self.room:
                yield from self.close()

    def close(self, last: bool = False) -> Iterator[tuple]:
        group, rest = self.group, []
        if last:
            room = int(self.held / (self.capacity * (1 - self.slack))) * self.capacity * (1 - self.slack)
            group, rest = self._parted(group, int(room))
        self.group, self.held = [], 0
        if group:
            for part in windows([p[2] for p in group], self.capacity):
                number, at = self._number(), 0
                for i in part:
                    yield *group[i][:5], number, at
                    at += group[i][2]
        yield from self._cut(rest)

    @staticmethod
    def _parted(pieces: list[tuple], room: int) -> tuple[list[tuple], list[tuple]]:
        """The pieces up to ``room`` ids, and the rest; the one at the edge is cut."""
        first, rest = [], []
        for key, start, length, crc, n, ids in pieces:
            take = min(length, room)
            room -= take
            if take == length:
                first.append((key, start, length, crc, n, ids))
                continue
            if take:
                first.append((key, start, take, zlib.crc32(ids[: 4 * take]), n, ids[: 4 * take]))
            rest.append((key, start + take, length - take, zlib.crc32(ids[4 * take :]), n, ids[4 * take :]))
        return first, rest

    def _cut(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Sequences of falling powers of two."""
        left = sum(p[2] for p in pieces)
        number, at, room = -1, 0, 0
        for key, start, length, _, n, ids in pieces:
            done = 0
            while done < length:
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    number, at = self._number(), 0
                take = min(length - done, room)
                yield key, start + done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), n, number, at
                done, at, room, left = done + take, at + take, room - take, left - take


NAMES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, encode: Callable[[str | None], bytes] | None = None) -> DataFrame:
    """A row for each piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encode or encoder(path).encode
        end = separator.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)

        types = None
        for batch in batches:
            types = [batch.schema.field(0).type] + [pa.int64()] * 6
            out: list[tuple] = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                out += packer.add(k, code(t.as_py()) + end)
            yield made(out)
        if types:
            yield made(list(packer.close(last=True)))

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES[1:])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
