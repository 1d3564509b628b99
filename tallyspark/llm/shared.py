"""Helpers of this package: staging, Arrow slices, and words of many texts as numpy arrays."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import gc
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 2 << 20
#: ``[^\x20\x09-\x0D]+`` are words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
#: Spark's setting to delete shuffle files when an execution ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staging"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.

    What led to the table is not needed again: Spark deletes the shuffle files of the write as it ends, and the
    driver is asked to collect its garbage, which frees those of earlier jobs.
    """
    return Staging(df.sparkSession).table(df, name)


class Staging:
    """Written tables of one job. A table that no later step reads can be dropped before the job ends.

    ``scope`` collects the paths of all tables written in its ``with`` block, whichever job writes them.
    """

    _scopes: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scopes", default=None)

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    @classmethod
    @contextlib.contextmanager
    def scope(cls) -> Iterator[list[str]]:
        paths: list[str] = []
        token = cls._scopes.set(paths)
        try:
            yield paths
        finally:
            cls._scopes.reset(token)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        self.paths[name] = path
        if (scope := self._scopes.get()) is not None:
            scope.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables whose readers have all been written."""
        delete(self.spark, [self.paths.pop(name) for name in names])


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more; those that are gone already don't matter."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_id(text: Column) -> Column:
    """Internal id of a distinct text (null counts as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` holds about ``limit`` bytes; one long text is a run of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    def run(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes."""
    size = 1 << max(16, int(len(data) + 1).bit_length())
    power, inverse = _powers(size)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row number of every word; words never cross rows."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    space = _SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    start = np.flatnonzero(~space & (before | border[:-1]))
    end = np.flatnonzero(~space & (after | border[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lowered, other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words starting at each word, for all but the last n - 1."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * np.uint64((_BASE * (2 * k + 3)) & _M64)
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, in two passes whatever the width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


_PLACE = np.uint64((1 << 28) - 1)


def anchored_runs(hashes: np.ndarray, width: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: first window, last window, anchor.

    A window is ``width`` consecutive hashes; its anchor is the place of the smallest (the leftmost of
    equals), so equal windows have their anchor at the same distance. ``ok`` tells, for each window
    start, whether the window exists. At most 2**28 hashes.
    """
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(ranked, width) & _PLACE).astype(np.int64)
    starts = np.flatnonzero(ok[: len(anchor)])
    if starts.size == 0:
        return starts, starts, starts
    anchor = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], anchor[first]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs; touching intervals join."""
    if len(start) == 0:
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def chunks(data: np.ndarray, offsets: np.ndarray, overlap: int, step: int = 2 * SLICE_BYTES):
    """(data, offsets, first row, place in the row): rows as they are, a long text in overlapping parts."""
    if len(data) <= 2 * step or len(offsets) > 2:
        yield data, offsets, 0
        return
    for at in range(0, max(1, len(data) - overlap), step):
        part = data[at : at + step + overlap]
        yield part, np.array([0, len(part)]), at


def joined_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes of some spans one after another."""
    return b"".join(data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist()))


def spaced_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words [start, end) one after another, one space between two of a row, and where each now starts and ends."""

    def inside(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        step = np.zeros(n + 1, np.int8)
        step[first] += 1
        step[last] -= 1
        return np.cumsum(step[:-1], dtype=np.int8).astype(bool)

    size = end - start
    to = np.cumsum(size + np.append(row[1:] == row[:-1], False)[: len(row)])
    at = np.append(0, to[:-1])[: len(row)]
    out = np.full(to[-1] if len(to) else 0, 0x20, np.uint8)
    out[inside(at, at + size, len(out))] = data[inside(start, end, len(data))]
    return out.tobytes(), at, at + size


def ragged(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``flat[offsets[c] : offsets[c + 1]]`` one after another, and the size of each."""
    size = offsets[codes + 1] - offsets[codes]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[codes] - ends + size, size)
    return flat[at], size


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the size of each list."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, sizes.sum()), sizes


class WordIds:
    """Ids of words met so far, as slots of one flat array; emptied when ``limit`` words are held.

    ``make`` gives the ids of words one after another, and how many each has.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.make, self.limit = make, limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 14, np.int64)

    def slots(self, words: list[str]) -> np.ndarray:
        """The slots of distinct words."""
        if len(self.slot) + len(words) > self.limit and self.slot:
            self.clear()
        found = np.fromiter(map(self.slot.get, words, itertools.repeat(-1)), np.int64, len(words))
        unmet = np.flatnonzero(found < 0)
        new = [words[i] for i in unmet.tolist()]
        found[unmet] = np.arange(len(self.slot), len(self.slot) + len(new))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids, sizes = self.make(some)
            n = len(self.slot)
            base = int(self.offsets[n])
            while n + len(some) + 1 > len(self.offsets):
                self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
            while base + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[base : base + len(ids)] = ids
            self.offsets[n + 1 : n + 1 + len(some)] = base + np.cumsum(sizes)
            self.slot.update(zip(some, range(n, n + len(some))))
        return found

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        coded = words.dictionary_encode()
        slots = self.slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return ragged(self.flat, self.offsets, slots[np.asarray(coded.indices)])


def encode_rows(texts: pa.Array, words: WordIds, uneven: str, many: Callable[[list[str]], list], first_apart: bool):
    """(ids of all rows, ids per row). Rows that match ``uneven`` go through ``many``; the others are cut at spaces.

    ``first_apart``: the part before the first space is not a word like the others and goes through ``many`` too. What goes
    through ``many`` goes in one call, each distinct text once.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = np.asarray(pc.match_substring_regex(texts, uneven))
    lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    parts, ends = lists.values, np.asarray(lists.offsets)
    parts, ends = parts.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]
    ids, size = words.encode(parts)
    rising = np.concatenate([[0], np.cumsum(size)])
    n_rows = len(texts)
    per_row = np.zeros(n_rows, np.int64)
    per_row[~odd] = rising[ends[1:]] - rising[ends[:-1]]
    if not odd.any() and not first_apart:
        return ids, per_row
    # Rows in order: the ids of what goes apart, then those of the words after it.
    apart = texts.filter(pa.array(odd)).cast(pa.string())
    front = np.zeros(len(ends) - 1, np.int64)
    if first_apart:
        apart = pa.concat_arrays([apart, parts.take(pa.array(ends[:-1])).cast(pa.string())])
        front = size[ends[:-1]]
    coded = apart.dictionary_encode()
    own = many(coded.dictionary.to_pylist()) if len(coded.dictionary) else []
    own_ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))])
    own_flat = np.fromiter(itertools.chain.from_iterable(own), np.uint32, own_ends[-1])
    codes = np.asarray(coded.indices).astype(np.int64)
    flat = np.concatenate([ids, own_flat])
    # Two spans of ``flat`` for each row, in order.
    start, stop = np.zeros((n_rows, 2), np.int64), np.zeros((n_rows, 2), np.int64)
    n_odd = int(odd.sum())
    for rows, some in ((odd, codes[:n_odd]), (~odd, codes[n_odd:])):
        if len(some) or rows is odd:
            start[rows, 0], stop[rows, 0] = len(ids) + own_ends[some], len(ids) + own_ends[some + 1]
    start[~odd, 1], stop[~odd, 1] = rising[ends[:-1]] + front, rising[ends[1:]]
    spans = np.empty(2 * n_rows + 1, np.int64)
    sizes = (stop - start).ravel()
    spans[0] = 0
    np.cumsum(sizes, out=spans[1:])
    at = np.arange(spans[-1]) + np.repeat(start.ravel() - spans[:-1], sizes)
    return flat[at], (stop - start).sum(axis=1)
