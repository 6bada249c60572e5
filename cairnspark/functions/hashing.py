"""BLAKE3 as an Arrow UDF: numpy over all blocks of all rows of a batch at once.

The messages of a batch are cut into leaves of 1024 bytes; the n-th 64-byte blocks of all leaves are compressed
together, then the tree is folded level by level over all rows. Null hashes to null.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: initial state (the one of SHA-256), flags and the message order of the next round.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
#: Leaves compressed at once, so that the working set is bounded.
_LEAVES = 1 << 12
#: Bytes of the messages that are hashed at once.
_AT_ONCE = 4 << 20


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _compress(chain: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of blocks (16, n)."""
    n = block.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = chain, _IV[:4, None]
    v[12], v[13] = counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    v[14], v[15] = length, flags
    a, b, c, d = v[0:4], v[4:8], v[8:12], v[12:16]
    m = block
    for r in range(7):
        for side in (0, 1):
            if side:  # diagonals: rows of the square turned by 1, 2, 3
                b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]
            x, y = m[8 * side : 8 * side + 8 : 2], m[8 * side + 1 : 8 * side + 8 : 2]
            a = a + b + x
            d = _turn(d ^ a, 16)
            c = c + d
            b = _turn(b ^ c, 12)
            a = a + b + y
            d = _turn(d ^ a, 8)
            c = c + d
            b = _turn(b ^ c, 7)
            if side:
                b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
        if r < 6:
            m = m[_ORDER]
    return np.concatenate([a ^ c, b ^ d])


def _leaves(data: bytes, starts: np.ndarray, sizes: np.ndarray, counter: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Chaining values of leaves; of a message with one leaf, its digest."""
    n = len(starts)
    padded = np.zeros((n, 1024), np.uint8)
    flat = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(sizes == 1024)
    if len(full):
        padded[full] = np.lib.stride_tricks.sliding_window_view(flat, 1024)[starts[full]]
    for i in np.flatnonzero(sizes < 1024):
        padded[i, : sizes[i]] = flat[starts[i] : starts[i] + sizes[i]]
    words = padded.view("<u4").reshape(n, 16, 16).transpose(1, 2, 0)
    blocks = np.maximum(1, -(-sizes // 64))
    chain = np.repeat(_IV[:, None], n, axis=1)
    for b in range(16):
        at = np.flatnonzero(blocks > b)
        if not len(at):
            break
        last = blocks[at] == b + 1
        flags = np.where(last, _END | np.where(single[at], _ROOT, 0), 0) | (_START if b == 0 else 0)
        length = np.minimum(64, sizes[at] - 64 * b)
        chain[:, at] = _compress(chain[:, at], words[b][:, at], counter[at], length.astype(np.uint32), flags.astype(np.uint32))
    return chain


def blake3_many(messages: list[bytes]) -> list[bytes]:
    """Digests of 32 bytes."""
    if not messages:
        return []
    data = b"".join(messages)
    size = np.array([len(m) for m in messages], np.int64)
    count = np.maximum(1, -(-size // 1024))
    row = np.repeat(np.arange(len(messages)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(size) - size, count) + 1024 * nth
    length = np.minimum(1024, size[row] - 1024 * nth)
    level = np.concatenate([_leaves(data, start[i : i + _LEAVES], length[i : i + _LEAVES], nth[i : i + _LEAVES].astype(np.uint64), count[row[i : i + _LEAVES]] == 1) for i in range(0, len(row), _LEAVES)], axis=1)
    # pairing neighbours level by level, an odd last one going up as it is, is the tree whose left parts are powers of two
    while len(row) > len(messages):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        width = np.diff(np.append(first, len(row)))
        place = np.arange(len(row)) - np.repeat(first, width)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(width, width)))
        up = np.flatnonzero(place % 2 == 0)
        flags = np.where(np.repeat(width, width)[left] == 2, _PARENT | _ROOT, _PARENT).astype(np.uint32)
        made = _compress(np.repeat(_IV[:, None], len(left), axis=1), np.concatenate([level[:, left], level[:, left + 1]]), np.zeros(len(left), np.uint64), np.full(len(left), 64, np.uint32), flags)
        after = level[:, up]
        after[:, np.searchsorted(up, left)] = made
        level, row = after, row[up]
    return [level[:, i].astype("<u4").tobytes() for i in range(len(messages))]


def _hashes(column: pa.Array) -> pa.Array:
    out, lo = [], 0
    while lo < len(column):  # messages are joined for hashing, so not those of a whole batch
        values, size = [], 0
        while lo < len(column) and (not values or size < _AT_ONCE):
            values.append(column[lo].as_py())
            size, lo = size + len(values[-1] or b""), lo + 1
        some = iter(blake3_many([v for v in values if v is not None]))
        out += [None if v is None else next(some) for v in values]
    return pa.array(out, pa.binary())


def blake3(v: Column) -> Column:
    """The digest of a binary column."""
    return F.arrow_udf(_hashes, "binary")(v)


@cache
def gear_table() -> np.ndarray:
    """For each byte the first eight bytes of its digest, as an integer."""
    return np.array([int.from_bytes(h[:8], "little") for h in blake3_many([bytes([i]) for i in range(256)])], np.uint64)
