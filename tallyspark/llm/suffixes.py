"""Removal of repeated byte strings with a sparse, distributed suffix array.

Every string of ``LENGTH`` bytes has an anchor: the place where the smallest hash of ``GRAM`` bytes lies
in it, which depends on its bytes alone. Equal strings therefore share the suffix that starts at their
anchor, so only anchored suffixes need to be sorted: about one in 170 bytes.

1. Anchors whose gram occurs once cannot repeat; a count per gram, combined map-side, leaves the others.
2. All strings of one anchor overlap and form one record. Equal records collapse to one with a count, so
   copies, however many, are one row from here on.
3. Suffixes are range-partitioned by their leading tokens (the first ``LEAD`` bytes behind the anchor)
   between splitters that Spark samples, and sorted by them within the partition.
4. Runs of equal lead are sorted on by multikey quicksort, eight bytes as one character, forward behind the
   anchor and backward before it. Common prefixes of neighbours give, for each split of ``LENGTH`` into a left
   and a right part, the classes of equal strings. Records with different leads share no string of
   ``LENGTH`` > ``LEAD`` bytes at that anchor, so nothing is left to compare across partition boundaries; a
   lead itself never straddles one.
5. The covered part of a record goes back to each of its places; per document the parts are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import anchored_runs, chunks, merged, partitions, slices, span_hashes, staged, text_bytes

LENGTH = 400
GRAM = 64
LEAD = 32
#: Bytes of records sorted in one go inside a task; a batch ends where the lead changes.
BATCH_BYTES = 4 << 20


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first start, last start, anchor, gram hash) of the runs of ``length``-byte strings that share an anchor."""
    gram = min(GRAM, length)
    n = len(data) - gram + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n)
    hashes = span_hashes(data, at, at + gram)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    first, last, anchor = anchored_runs(hashes, length - gram + 1, room >= length)
    return first, last, anchor, hashes[anchor]


def _keys(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        data, offsets = text_bytes(rows.column("text"))
        ids = rows.column("k").to_numpy()
        for part, ends, _ in chunks(data, offsets, length - 1):
            first, _, _, key = _runs(part, ends, length)
            if len(first) == 0:
                continue
            row = np.searchsorted(ends, first, side="right") - 1
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
            yield pa.RecordBatch.from_pydict({
                "k": ids[row[new]], "key": key[new].view(np.int64), "n": np.diff(np.append(new, len(key))),
            })


def _records(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        data, offsets = text_bytes(rows.column("text"))
        ids = rows.column("k").to_numpy()
        wanted = [np.array(x, np.int64) for x in rows.column("keys").to_pylist()]
        pairs = np.unique(np.stack([np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]), np.concatenate(wanted)]), axis=1)
        for part, ends, base in chunks(data, offsets, length - 1):
            first, last, anchor, key = _runs(part, ends, length)
            row = np.searchsorted(ends, first, side="right") - 1
            keep = np.zeros(len(first), bool)
            for r in np.unique(row):
                here = slice(*np.searchsorted(pairs[0], [r, r + 1]))
                mine = slice(*np.searchsorted(row, [r, r + 1]))
                keep[mine] = np.isin(key[mine].view(np.int64), pairs[1][here])
            first, last, anchor, row = first[keep], last[keep], anchor[keep], row[keep]
            body = [part[a:b].tobytes() for a, b in zip(first.tolist(), (last + length).tolist())]
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(ids[row], pa.int64()), "start": pa.array(first - ends[row] + base, pa.int64()),
                "anchor": pa.array(anchor - first, pa.int64()), "body": pa.array(body, pa.binary()),
            })


def multikey_quicksort(keys: np.ndarray, group: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded strings within groups, and common prefix bytes with the one before (-1: new group).

    ``keys`` holds eight bytes a column, as big-endian numbers. Strings are divided by one column; only runs
    that are still equal are divided by the next. A string stands before those that it is a prefix of.
    """
    n, width = keys.shape
    order = np.lexsort((length, group))
    ranked = group[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    common = np.where(fresh, -1, 8 * width)
    for depth in range(width):
        open_ = ~fresh
        open_[:-1] |= ~fresh[1:]
        at = np.flatnonzero(open_)
        if at.size == 0:
            break
        run = np.cumsum(fresh)[at]
        column = keys[order[at], depth]
        by = np.lexsort((column, run))
        order[at] = order[at][by]
        column = column[by]
        parted = (column[1:] != column[:-1]) & (run[1:] == run[:-1])
        where = at[1:][parted]
        differ = column[1:][parted] ^ column[:-1][parted]
        equal = sum((differ < np.uint64(1) << np.uint64(64 - 8 * k)).astype(np.int64) for k in range(1, 8))
        fresh[where] = True
        common[where] = 8 * depth + equal
    size = length[order]
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    return order, common


def _columns(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """Zero-padded strings from ``start`` on, forward or backward, as rows of big-endian 64-bit columns."""
    width = -(-max(1, int(size.max(initial=1))) // 8) * 8
    out = np.zeros((len(start), width), np.uint8)
    reach = np.arange(width)
    inside = reach < size[:, None]
    places = start[:, None] + step * reach
    out[inside] = data[places[inside]]
    return out.view(">u8").astype(np.uint64)


def repeated_parts(bodies: list[bytes], anchor: np.ndarray, group: np.ndarray, counts: np.ndarray, length: int = LENGTH):
    """(low, high) per record: the bytes covered by strings found in another record or place; high 0 for none."""
    size = np.array([len(b) for b in bodies])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    low = np.full(len(bodies), np.iinfo(np.int64).max)
    high = np.zeros(len(bodies), np.int64)
    right_size, strings = size - anchor, size - length + 1
    right, right_common = multikey_quicksort(_columns(data, begin + anchor, right_size, 1), group, right_size)
    left, left_common = multikey_quicksort(_columns(data, begin + anchor - 1, anchor, -1), group, anchor)
    n = len(bodies)
    right_class, left_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for before in range(int(anchor.max(initial=0)) + 1):  # bytes of the string before the anchor
        some = np.flatnonzero((before <= anchor) & (before > anchor - strings))
        if some.size < 2:
            continue
        right_class[right] = np.cumsum(right_common < length - before)
        left_class[left] = np.cumsum(left_common < before)
        both = right_class[some] * (n + 1) + left_class[some]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        twice = np.zeros(some.size, bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = some[order[twice]]
        at = anchor[hit] - before
        low[hit] = np.minimum(low[hit], at)
        high[hit] = np.maximum(high[hit], at + length)
    whole = counts > 1
    low[whole], high[whole] = 0, size[whole]
    return np.where(high > 0, low, 0), high


def _sort(batches: Iterator[pa.RecordBatch], length: int, limit: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    bytes_held = 0

    def out() -> pa.RecordBatch:
        leads = {x: i for i, x in enumerate(dict.fromkeys(h[0] for h in held))}
        group = np.array([leads[h[0]] for h in held])
        counts = np.array([h[3] for h in held])
        alone = np.bincount(group)[group] == 1
        # Alone with its lead: all of it repeats if the record was found twice, else nothing does.
        low, high = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        whole = alone & (counts > 1)
        high[whole] = [len(held[i][2]) for i in np.flatnonzero(whole)]
        rest = np.flatnonzero(~alone)
        if rest.size:
            low[rest], high[rest] = repeated_parts(
                [held[i][2] for i in rest], np.array([held[i][1] for i in rest]), group[rest], counts[rest], length
            )
        found = np.flatnonzero(high)
        return pa.RecordBatch.from_pydict({
            "body_id": pa.array([hashlib.md5(held[i][2]).digest() for i in found], pa.binary()),
            "low": pa.array(low[found], pa.int64()), "high": pa.array(high[found], pa.int64()),
        })

    for batch in batches:
        for row in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("lead", "anchor", "body", "n"))):
            if bytes_held >= limit and row[0] != held[-1][0]:
                yield out()
                held, bytes_held = [], 0
            held.append(row)
            bytes_held += len(row[2])
    if held:
        yield out()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("doc_id", "n_bytes", "sha", "text", "lows", "highs")
    for rows in slices(batches, "text"):
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
        for _, n, sha, text, lows, highs in zip(*(rows.column(c).to_pylist() for c in columns)):
            if lows is None:
                low = high = np.zeros(0, np.int64)
            else:
                low, high = merged(np.array(lows), np.array(highs))
            if sha is None:
                raw = text.encode()
                kept = [raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)])]
                sha = hashlib.sha256(b"".join(kept)).hexdigest()
            out["n_removed"].append(int((high - low).sum()))
            out["n_spans"].append(len(low))
            out["kept_sha256"].append(sha)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").cast(pa.int64()), rows.column("n_bytes"), pa.array(out["n_removed"], pa.int64()),
             pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())],
            names=["doc_id", "n_bytes", *out],
        )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: doc_id, k, n_bytes, sha, text and keys (of texts with candidates only, else their
    sha256). spans: per k the removed parts as lists lows and highs, not yet merged."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("doc_id", "text").alias("k"),
    )
    keys = rows.select("k", "text").mapInArrow(lambda it: _keys(it, length), "k long, key long, n long")
    again = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    candidates = staged(keys.select("k", "key").join(again, "key").groupBy("k").agg(F.collect_set("key").alias("keys")), "suffix-keys")
    bare = F.col("keys").isNull()
    texts = staged(
        rows.join(candidates, "k", "left").select(
            "doc_id", "k", F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(bare, F.sha2("text", 256)).alias("sha"), F.when(~bare, F.col("text")).alias("text"), "keys",
        ),
        "suffix-texts",
    )
    records = texts.where("keys is not null").select("k", "text", "keys").mapInArrow(
        lambda it: _records(it, length), "k long, start long, anchor long, body binary"
    )
    lead = F.expr(f"substring(body, cast(anchor + 1 as int), {min(LEAD, GRAM)})")
    distinct = records.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("n")).withColumn("lead", lead)
    found = (
        distinct.repartitionByRange(2 * partitions(spark), "lead").sortWithinPartitions("lead")
        .select("lead", "anchor", "body", "n").mapInArrow(lambda it: _sort(it, length, BATCH_BYTES), "body_id binary, low long, high long")
    )
    places = records.select("k", "start", F.unhex(F.md5("body")).alias("body_id"))
    spans = places.join(found, "body_id").groupBy("k").agg(
        F.collect_list(F.col("start") + F.col("low")).alias("lows"), F.collect_list(F.col("start") + F.col("high")).alias("highs")
    )
    return texts, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of (doc_id, text).

    Each byte covered by a ``length``-byte string that also starts elsewhere, in the same text too, is
    removed; strings are judged on the input. A null text is empty: 0 bytes, nothing removed. Every copy of
    a text of ``length`` bytes or more is removed whole, repeated rows included. Null ids are kept as null.
    Extra columns are not read; an empty table gives an empty one.
    """
    texts, spans = repeated_spans(docs, length)
    return texts.drop("keys").join(spans, "k", "left").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
