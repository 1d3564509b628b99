"""Token ids as patched frame-of-reference blocks in files, in ascending document order.

The stream of a shard is cut into blocks of ``BLOCK`` ids. A block stores its minimum and the
differences packed at the width that ``PERCENTILE`` percent of them need; the high bits of the others
stand in an exception list (places and values). A segment holds the blocks of some documents, its
documents' lengths as blocks of the same kind, and the place where each block starts, so a reader can
seek to any block. Segments are rows of a Parquet table, so any store that Spark reads can hold them.
"""

from __future__ import annotations

import functools
import itertools
import math
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import WordIds, encode_rows, flattened, partitions, shared_folder, slices

BLOCK = 1024
#: Blocks packed at once.
BATCH = 64
PERCENTILE = 95
END_ID = 0
CACHE_ENTRIES = 800_000
#: New words encoded as one text.
JOINED = 20
_HEAD = struct.Struct("<IBHH")  # minimum, width, ids, exceptions
SEGMENT = "shard long, seq long, base long, n_ids long, doc_ids array<long>, payload binary"


def pack_blocks(rows: np.ndarray) -> list[bytes]:
    """A block of each row of ids: head, packed low bits, exception places (16 bit) and high bits (32 bit)."""
    n = rows.shape[1]
    low = rows.min(axis=1)
    rest = (rows - low[:, None]).astype("<u4")
    at = math.ceil(PERCENTILE / 100 * (n - 1))
    width = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1]  # bits of a whole number
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        bits = np.unpackbits(rest[some].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :w]
        for i, bytes_ in zip(some.tolist(), np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")):
            packed[i] = bytes_.tobytes()
    high = rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]
    row, place = np.nonzero(high)
    high, place = high[row, place].astype("<u4"), place.astype("<u2")
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    return [
        _HEAD.pack(l, w, n, b - a) + p + place[a:b].tobytes() + high[a:b].tobytes()
        for l, w, p, a, b in zip(low.tolist(), width.tolist(), packed, ends[:-1].tolist(), ends[1:].tolist())
    ]


def pack_block(ids: np.ndarray) -> bytes:
    """One block."""
    return pack_blocks(ids[None])[0]


def unpack_block(data: memoryview) -> np.ndarray:
    low, width, n, odd = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (n * width + 7) // 8
    out = np.zeros(n, np.uint64)
    if width:
        bits = np.zeros((n, 32), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
        out += np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    if odd:
        places = np.frombuffer(data, "<u2", odd, at + size)
        high = np.frombuffer(data, "<u4", odd, at + size + 2 * odd)
        out[places] |= high.astype(np.uint64) << np.uint64(width)
    return (out + np.uint64(low)).astype(np.uint32)


def pack(values: np.ndarray) -> bytes:
    """Blocks behind their index: number of values, number of blocks, start of each block."""
    some = [values[i : i + BATCH * BLOCK] for i in range(0, len(values), BATCH * BLOCK)]
    whole = [x[: len(x) // BLOCK * BLOCK].reshape(-1, BLOCK) for x in some]
    blocks = [block for x in whole if len(x) for block in pack_blocks(x)]
    if len(values) % BLOCK:
        blocks.append(pack_block(values[len(values) // BLOCK * BLOCK :]))
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return struct.pack("<QQ", len(values), len(blocks)) + starts.tobytes() + b"".join(blocks)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values [first, last) reading only the blocks that hold them."""
    view = memoryview(data)
    n, count = struct.unpack_from("<QQ", view)
    last = n if last is None else min(last, n)
    starts = np.frombuffer(view, "<u8", count + 1, 16)
    body = 16 + 8 * (count + 1)
    if first >= last:
        return np.zeros(0, np.uint32)
    wanted = range(first // BLOCK, (last - 1) // BLOCK + 1)
    parts = [unpack_block(view[body + int(starts[b]) : body + int(starts[b + 1])]) for b in wanted]
    return np.concatenate(parts)[first - wanted[0] * BLOCK : last - wanted[0] * BLOCK]


@functools.lru_cache(2)
def _tokenizer(path: str, ordinary: bool) -> tuple[Callable[[list[str]], list], WordIds, str]:
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if ordinary:
        tokenizer.encode_special_tokens = True
    added = sorted(x.content for x in tokenizer.get_added_tokens_decoder().values())

    def ids(texts: list[str]) -> list:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # A space is in no token but at its front, so words encoded as one text are told apart by the tokens that begin with one.
    vocabulary = tokenizer.get_vocab()
    marked = np.zeros(1 + max(vocabulary.values()), bool)
    marked[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
    alone = any(" " in x for x in added) or any("\u0120" in token.lstrip("\u0120") for token in vocabulary)

    def words(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not alone and not any(w == "" or w[0].isspace() for w in some):
            flat, _ = flattened(ids([" " + " ".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)]))
            starts = np.flatnonzero(marked[flat])
            if len(starts) == len(some):
                return flat, np.diff(starts, append=len(flat))
        return flattened(ids([" " + w for w in some]))

    whole = "|".join([UNEVEN, *map(re.escape, added)])
    return ids, WordIds(words, CACHE_ENTRIES), whole


# The pattern of byte-level pre-tokens never lets a pre-token run over the place before a space that a visible
# character follows. So the parts between such places are encoded apart, each distinct one once; a text with
# a space before other white space or at its end is encoded in one piece; so is one that holds an added token's
# string, before which a pre-token ends as at the end of a text.
UNEVEN = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"


def encode_texts(texts: pa.Array, path: str, ordinary: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per text) of whole texts, as the tokenizers library gives them with ``add_special_tokens=False``.

    ``ordinary``: strings of special tokens are ordinary text; otherwise each is its single id, as in the library by default.
    """
    ids, words, whole = _tokenizer(path, ordinary)
    return encode_rows(texts, words, whole, ids, first_apart=True)


def _write(batches: Iterator[pa.RecordBatch], path: str, ordinary: bool) -> Iterator[pa.RecordBatch]:
    """Segments of one shard; a shard's rows come together and in order."""
    shard, seq, base = None, 0, 0
    for rows in slices(batches, "text"):
        shards = rows.column("shard").to_numpy()
        for at in np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]):
            to = at + int(np.argmax(np.r_[shards[at:] != shards[at], True]))
            some = rows.slice(at, to - at)
            if shards[at] != shard:
                shard, seq, base = shards[at], 0, 0
            ids, sizes = encode_texts(some.column("text"), path, ordinary)
            counts = (sizes + 1).astype(np.uint32)
            stream = np.insert(ids, np.cumsum(sizes), np.uint32(END_ID))
            lengths = pack(counts)
            yield pa.RecordBatch.from_pydict({
                "shard": [shard], "seq": [seq], "base": [base], "n_ids": [len(stream)],
                "doc_ids": pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "payload": pa.array([struct.pack("<Q", len(lengths)) + lengths + pack(stream)], pa.binary()),
            })
            seq, base = seq + 1, base + len(stream)


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, shards: int | None = None, ordinary: bool = True) -> str:
    """Encode ``text`` and write the segments in ascending ``doc_id`` order; gives the path.

    Shards are ranges of ``doc_id`` between sampled quantiles; a row's order within its shard is
    (doc_id, text). A null id comes first, a null or empty text has the end id alone. Rows that share an
    id stand side by side; extra columns are not read. ``ordinary`` as in ``encode_texts``.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    shards = shards or 2 * partitions(spark)
    cuts = docs.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 20 * shards)).first()[0]
    cuts = sorted(set(cuts or []))
    bounds = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    shard = F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    rows = (
        docs.select("doc_id", "text", F.coalesce(shard, F.lit(0)).cast("long").alias("shard"))
        .repartitionById(len(cuts) + 1, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")
    )
    rows.mapInArrow(lambda it: _write(it, tokenizer, ordinary), SEGMENT).write.parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            payload = row["payload"]
            (size,) = struct.unpack_from("<Q", payload)
            counts = unpack(payload[8 : 8 + size]).astype(np.int64)
            ids = unpack(payload[8 + size :]).astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array(row["shard_start"] + row["base"] + ends - counts, pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            })


def read_digests(spark, path: str) -> DataFrame:
    """One row per document read back from the files: start in the whole stream, ids, crc32.

    A shard's start is the sum of the shards before it, one row per shard.
    """
    segments = spark.read.parquet(path)
    totals = sorted(tuple(r) for r in segments.groupBy("shard").agg(F.sum("n_ids")).collect())
    starts = dict(zip((s for s, _ in totals), itertools.accumulate((n for _, n in totals), initial=0)))
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    begins = spark.createDataFrame(list(starts.items()), "shard long, shard_start long")
    rows = segments.join(F.broadcast(begins), "shard")  # one row per shard
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
