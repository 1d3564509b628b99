"""Removal of repeated word passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` words. Its anchor is the place of the smallest ``GRAM``-word hash in it, so equal
windows share their anchor's gram, the shard key. Keys met in one document only cannot recur; a count
combined map-side leaves the others. The windows of one anchor form one stretch of words. Equal stretches
collapse to one row with their smallest document, and go to the shard of their key. A key with more than ``STRETCHES``
stretches is hot: its stretches are cut into their single windows, each with a hash of all its words for a key, so no shard
gets more of it than its different windows, spread evenly. A shard confirms which windows recur in different documents,
compiles those into an automaton and streams all of its stretches through it, so every document passes through every
automaton that could match it, and no other. Each hit gives the smallest document of the passage; a document with a larger id
loses the words.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import Staging, anchored_runs, gram_hashes, partitions, slices, spaced_words, span_hashes, text_bytes, word_spans

WINDOW = 13
GRAM = 4
#: Stretches of a key that is not hot, and about as many in one automaton; a shard of more is cut where the key changes.
STRETCHES = 8_000
_MIX = 0x9E3779B97F4A7C15


def _words(rows: pa.RecordBatch):
    data, offsets = text_bytes(rows.column("text"))
    start, end, doc = word_spans(data, offsets)
    return data, start, end, doc


def _runs(data, start, end, doc, window: int):
    """Runs of windows by their first word, with the hash of the anchor's gram, and the hashes of all grams."""
    gram = min(GRAM, window)
    if len(start) < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = gram_hashes(span_hashes(data, start, end), gram)
    first, last, anchor = anchored_runs(grams, window - gram + 1, doc[window - 1 :] == doc[: len(doc) - window + 1])
    return first, last, grams[anchor], grams


def _window_keys(grams: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of all words of each window, from the hashes of the grams that cover it."""
    gram = min(GRAM, window)
    out = np.zeros(len(at), np.uint64)
    for step in [*range(0, window - gram, gram), window - gram]:
        out = (out ^ grams[at + step]) * np.uint64(_MIX)
        out ^= out >> np.uint64(29)
    return out


def _keys(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        data, start, end, doc = _words(rows)
        first, _, key, _ = _runs(data, start, end, doc, window)
        if len(first) == 0:
            continue
        row = doc[first]
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
        at = pa.array(row[new])
        yield pa.RecordBatch.from_arrays(
            [rows.column("k").take(at), rows.column("doc_id").take(at), pa.array(key[new].view(np.int64)),
             pa.array(np.diff(np.r_[new, len(row)]), pa.int64())],
            names=["k", "doc_id", "key", "n"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without candidates become their digest at once."""
    for rows in slices(batches, "text"):
        data, start, end, doc = _words(rows)
        count = np.bincount(doc, minlength=rows.num_rows)
        bare = rows.column("keys").is_null().to_pylist()
        joined, at, to = spaced_words(data, start, end, doc)
        base = np.cumsum(count) - count
        sha = [
            hashlib.sha256(joined[at[b] : to[b + c - 1]] if c else b"").hexdigest() if x else None
            for x, b, c in zip(bare, base.tolist(), count.tolist())
        ]
        text = [None if x else t for x, t in zip(bare, rows.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("k"), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()),
             rows.column("keys").cast(pa.list_(pa.int64())), rows.column("hot").cast(pa.list_(pa.int64()))],
            names=["doc_id", "k", "n_words", "sha", "text", "keys", "hot"],
        )


def _stretches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        data, start, end, doc = _words(rows)
        first, last, key, grams = _runs(data, start, end, doc, window)
        keep, split = np.zeros(len(first), bool), np.zeros(len(first), bool)
        row = doc[first]
        for r, (wanted, hot) in enumerate(zip(rows.column("keys").to_pylist(), rows.column("hot").to_pylist())):
            here = slice(*np.searchsorted(row, [r, r + 1]))
            keep[here] = np.isin(key[here].view(np.int64), np.array(wanted, np.int64))
            if hot:
                split[here] = np.isin(key[here].view(np.int64), np.array(hot, np.int64))
        first, last, key, split = first[keep], last[keep], key[keep], split[keep]
        if split.any():
            n = last[split] - first[split] + 1
            one = np.repeat(first[split] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            first, last = np.r_[first[~split], one], np.r_[last[~split], one]
            key = np.r_[key[~split], _window_keys(grams, one, window)]
        row = doc[first]
        base = np.searchsorted(doc, row)
        joined, begin, to = spaced_words(data, start, end, doc)
        body = [joined[a:b].decode() for a, b in zip(begin[first].tolist(), to[last + window - 1].tolist())]
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [rows.column("k").take(at), rows.column("doc_id").take(at), pa.array(first - base, pa.int64()),
             pa.array(key.view(np.int64)), pa.array(body, pa.string())],
            names=["k", "doc_id", "word", "key", "body"],
        )


def _letters(ids: np.ndarray) -> np.ndarray:
    """Word numbers as code points of characters; 0 stays free for gaps and surrogates are left out."""
    return np.where(ids + 1 < 0xD800, ids + 1, ids + 1 + 0x800).astype("<u4")


def _only(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value that all rows of a group share, or -1; groups start at ``first``."""
    least = np.minimum.reduceat(values, first)
    return np.where(least == np.maximum.reduceat(values, first), least, -1)


def locate(bodies: pa.Array, low: np.ndarray, high: np.ndarray, window: int = WINDOW) -> pa.Array:
    """For each window of each stretch (words joined by a space, smallest and largest document): the passage's smallest
    document, or null where it does not recur.

    Windows that stand in two documents are confirmed word by word. Neighbouring ones that only ever stand together make one
    passage; the passages are compiled into an automaton, and all stretches are streamed through it, which locates every
    occurrence. The different words of one call are letters of one alphabet, so
    there must be fewer than 1,111,000 of them; ``_shard`` hands over far fewer.
    """
    import ahocorasick

    words = pc.split_pattern(bodies, " ")
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = pc.dictionary_encode(pc.list_flatten(words)).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # A gap behind each stretch: no passage crosses it.
    letters = np.zeros(len(ids) + len(n), "<u4")
    letters[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = _letters(ids)
    windows = np.maximum(n - window + 1, 0)
    begin = np.cumsum(n + 1) - (n + 1)
    stretch = np.repeat(np.arange(len(n)), windows)
    at = np.arange(len(stretch)) - (np.cumsum(windows) - windows)[stretch] + begin[stretch]
    found, met = np.zeros(len(letters), np.int64), np.zeros(len(letters), bool)
    automaton = ahocorasick.Automaton()
    if len(at):
        passages = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters, window)[at]).view(f"V{4 * window}").ravel()
        order = np.argsort(passages, kind="stable")
        new = np.r_[True, passages[order[1:]] != passages[order[:-1]]]
        first = np.flatnonzero(new)
        lows = np.minimum.reduceat(low[stretch[order]], first)
        recurs = lows < np.maximum.reduceat(high[stretch[order]], first)
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        goes_on = np.r_[at[1:] == at[:-1] + 1, False]
        after = _only(np.where(goes_on, np.r_[group[1:], -1], -1)[order], first)
        before = _only(np.where(np.r_[False, goes_on[:-1]], np.r_[-1, group[:-1]], -1)[order], first)
        # A window and the next one are always together: each is the other's only neighbour.
        tied = (after >= 0) & (before[after] == np.arange(len(first)))
        starts = recurs & ~((before >= 0) & tied[before] & (after[before] == np.arange(len(first))))
        begins = order[first[starts]]
        breaks = np.flatnonzero(~(goes_on & tied[group]))
        length = breaks[np.searchsorted(breaks, begins)] - begins + 1
        values = lows[starts]
        code = letters.tobytes().decode("utf-32-le")
        for i, (p, q) in enumerate(zip(at[begins].tolist(), (at[begins] + window + length - 1).tolist())):
            automaton.add_word(code[p:q], i)
    if len(automaton):
        automaton.make_automaton()
        end, which = np.fromiter(itertools.chain.from_iterable(automaton.iter(code)), np.int64).reshape(-1, 2).T
        n_hit = length[which]
        shift = np.arange(n_hit.sum()) - np.repeat(np.cumsum(n_hit) - n_hit, n_hit)
        found[np.repeat(end - window - n_hit + 2, n_hit) + shift] = np.repeat(values[which], n_hit)
        met[np.repeat(end - window - n_hit + 2, n_hit) + shift] = True
    smallest = pa.array(found[at], pa.int64(), mask=~met[at])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(windows)], pa.int32()), smallest)


def _shard(batches: Iterator[pa.RecordBatch], window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their keys. A key has ``limit`` rows at most, so about twice as many are held."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        bodies = rows.column("body").combine_chunks()
        smallest = locate(bodies, rows.column("low").to_numpy(), rows.column("high").to_numpy(), window)
        ends = smallest.offsets.to_numpy()
        met = np.r_[0, np.cumsum(smallest.values.is_valid().to_numpy(zero_copy_only=False))]
        some = pa.array(np.flatnonzero(met[ends[1:]] > met[ends[:-1]]))
        ids = [hashlib.md5(b.encode()).digest() for b in bodies.take(some).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), smallest.take(some)], names=["body_id", "smallest"])

    held = None
    for batch in batches:
        for i in range(0, batch.num_rows, limit):
            more = pa.Table.from_batches([batch.slice(i, limit)])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows > limit:
                key = held.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield out(held.slice(0, cut))
                    held = held.slice(cut)
    if held is not None and held.num_rows:
        yield out(held)


def _finish(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        data, start, end, doc = _words(rows)
        gone = np.zeros(len(start) + 1, np.int64)
        count = np.bincount(doc, minlength=rows.num_rows)
        base = np.cumsum(count) - count
        for b, words in zip(base.tolist(), rows.column("words").to_pylist()):
            for w in words or ():
                at = b + np.array(w)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
        kept = np.cumsum(gone)[:-1] == 0
        sha = rows.column("sha").to_pylist()
        removed = np.bincount(doc[~kept], minlength=rows.num_rows)
        joined, at, to = spaced_words(data, start[kept], end[kept], doc[kept])
        left = count - removed
        for i, (b, c) in enumerate(zip((np.cumsum(left) - left).tolist(), left.tolist())):
            if sha[i] is None:
                sha[i] = hashlib.sha256(joined[at[b] : to[b + c - 1]] if c else b"").hexdigest()
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def remove_passages(docs: DataFrame, window: int = WINDOW, limit: int = STRETCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of (doc_id, text).

    A word goes if a window that covers it also starts in a document with a smaller id; windows are judged
    on the input. A null, empty or short text loses nothing; a long one is read whole, in one piece (fewer than 2**28
    words). Rows that share an id are the same document for this rule, so equal rows do not remove each other; a null id is
    neither smaller nor larger. Extra columns are not read; an empty table gives an empty one. ``limit`` is the number of
    stretches that makes a key hot; results do not depend on it.
    """
    spark = docs.sparkSession
    # A text is known by its id and a hash: texts of one id would have to collide.
    row = ["k", "doc_id"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("k")
    )
    keys = rows.where("doc_id is not null").mapInArrow(lambda it: _keys(it, window), "k long, doc_id long, key long, n long")
    again = (
        keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n"))
        .where("low < high").select("key", (F.col("n") > limit).alias("is_hot"))
    )
    stage = Staging(spark)
    candidates = stage.table(
        keys.select(*row, "key").join(again, "key").groupBy(*row).agg(
            F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("is_hot"), F.col("key"))).alias("hot")
        ),
        "passage-keys",
    )
    texts = stage.table(
        rows.join(candidates, row, "left").mapInArrow(
            _texts, "doc_id long, k long, n_words long, sha string, text string, keys array<long>, hot array<long>"
        ),
        "passage-texts",
    )
    stage.drop("passage-keys")
    stretches = texts.where("keys is not null").select(*row, "text", "keys", "hot").mapInArrow(
        lambda it: _stretches(it, window), "k long, doc_id long, word long, key long, body string"
    )
    stretches = stage.table(stretches, "passage-stretches")  # read twice, and cutting texts is the dear part
    distinct = stretches.groupBy("key", "body").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    found = distinct.repartition(2 * partitions(spark), "key").sortWithinPartitions("key").mapInArrow(
        lambda it: _shard(it, window, limit), "body_id binary, smallest array<long>"
    )
    # Written tables, so that the shuffled stretches are gone before texts are shuffled again.
    found = stage.table(found, "passage-found")
    places = stretches.select(*row, "word", F.unhex(F.md5("body")).alias("body_id"))
    # A body stands once per key, and a hot key's bodies have keys of their own: one row each.
    hits = places.join(found, "body_id").select(
        *row, F.expr("filter(transform(smallest, (x, i) -> if(x < doc_id, word + i, null)), x -> x is not null)").alias("words")
    )
    gone = stage.table(hits.where(F.size("words") > 0).groupBy(*row).agg(F.collect_list("words").alias("words")), "passage-gone")
    stage.drop("passage-found", "passage-stretches")
    return texts.drop("keys", "hot").join(gone, row, "left").mapInArrow(
        lambda it: _finish(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
