"""Reproducible random draws.

A draw is a hash of a seed and a row key, so it does not depend on partitioning, retries or the
number of executors. 52 bits fit a double exactly, so the same draw can be computed by any engine
that has md5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

DRAW_BITS = 52
_HEX_DIGITS = DRAW_BITS // 4
_SPAN = float(1 << DRAW_BITS)


def _text(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit("~"))


def row_hash(seed, *key) -> Column:
    """52-bit hash of ``seed|key1|key2…`` as a BIGINT."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in key])
    return F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def uniform(hashed: Column) -> Column:
    """The double strictly inside (0, 1) that a row hash stands for."""
    return (hashed + F.lit(0.5)) / F.lit(_SPAN)


def index(size, hashed: Column) -> Column:
    """The integer in ``[0, size)`` that a row hash stands for."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.floor(uniform(hashed) * size).cast("int")


def draw(seed, *key) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return uniform(row_hash(seed, *key))


def draw_index(size, seed, *key) -> Column:
    """Uniform integer in ``[0, size)``."""
    return index(size, row_hash(seed, *key))


def row_hashes(seeds: Sequence[str], *key) -> Column:
    """A struct of the ``row_hash`` of every seed, its fields named by the seeds: the same numbers.

    The key is put together once and md5 runs over Arrow batches, all rows of a batch at a time, so many draws of a row cost
    little more than one.
    """
    seeds = list(dict.fromkeys(seeds))

    @F.arrow_udf(T.StructType([T.StructField(s, T.LongType()) for s in seeds]))
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(h) for h in text_hashes(texts, seeds)], names=seeds)

    return hashed(F.concat_ws("|", *[_text(k) for k in key]))


_ROTATED = [by[i % 4] for by in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


#: Rows whose blocks are worked on together: they stay in a core's cache.
_TOGETHER = 5000


def _md5_round(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """The state of every row after one more block (RFC 1321); ``words`` is (16, rows)."""
    a, b, c, d = (x.copy() for x in state)
    low = np.empty_like(a)
    for i in range(64):
        if i < 16:
            f, at = c ^ d, i
            f &= b
            f ^= d
        elif i < 32:
            f, at = b ^ c, (5 * i + 1) % 16
            f &= d
            f ^= c
        elif i < 48:
            f, at = b ^ c, (3 * i + 5) % 16
            f ^= d
        else:
            f, at = ~d, 7 * i % 16
            f |= b
            f ^= c
        a += words[at]
        a += _SINES[i]
        f += a
        np.right_shift(f, np.uint32(32 - _ROTATED[i]), out=low)
        f <<= np.uint32(_ROTATED[i])
        f |= low
        f += b
        a, b, c, d = d, f, b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, head: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their texts as md5 blocks of bytes behind ``head`` free ones), rows of one number of blocks at a time."""
    blocks = (lengths + head + 8) // 64 + 1
    for k in np.unique(blocks):
        rows = np.flatnonzero(blocks == k)
        n, size = lengths[rows], 64 * int(k)
        at, before = np.arange(len(rows)) * size + head, np.cumsum(n) - n
        step = np.arange(n.sum())
        if len(rows) == len(lengths):  # texts lie behind each other
            own = data[starts[0] : starts[0] + len(step)]
        else:
            own = data[step + np.repeat(starts[rows] - before, n)]
        buffer = np.zeros(len(rows) * size, np.uint8)
        step += np.repeat(at - before, n)
        buffer[step] = own
        buffer[at + n] = 0x80
        buffer = buffer.reshape(len(rows), size)
        buffer[:, -8:] = ((n + head) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
        yield rows, buffer


def digests(texts: pa.Array, seeds: Sequence[str]) -> np.ndarray:
    """The md5 of ``seed|text`` of every seed and text, none of which is null: (seeds, rows, 4) words in big-endian order."""
    texts = texts.cast(pa.large_string())
    out = np.zeros((len(seeds), len(texts), 4), np.uint32)
    if not len(texts):
        return out
    _, offsets, data = texts.buffers()
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    heads = [f"{s}|".encode() for s in seeds]
    for first in range(0, len(texts), _TOGETHER):
        some = ends[first : first + _TOGETHER + 1]
        for size in sorted({len(h) for h in heads}):
            for rows, buffer in _padded(data, some[:-1], np.diff(some), size):
                words = np.ascontiguousarray(buffer.view("<u4").T)
                for head, found in zip(heads, out):
                    if len(head) != size:
                        continue
                    buffer[:, :size] = np.frombuffer(head, np.uint8)
                    for w in range(-(-size // 4)):
                        words[w] = buffer.view("<u4")[:, w]
                    state = [np.full(len(rows), x, np.uint32) for x in _START]
                    for block in range(0, len(words), 16):
                        state = _md5_round(state, words[block : block + 16])
                    for w, part in enumerate(state):
                        found[first + rows, w] = part.byteswap()
    return out


def text_hashes(texts: pa.Array, seeds: Sequence[str]) -> list[np.ndarray]:
    """``row_hash`` of every seed before each of the texts."""
    front = digests(texts, seeds).astype(np.uint64)
    return list((((front[:, :, 0] << np.uint64(32)) | front[:, :, 1]) >> np.uint64(64 - DRAW_BITS)).astype(np.int64))
