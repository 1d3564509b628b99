"""Quality rules: word statistics, and the log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hashed 1- and 2-grams: one of all texts (raw), one of trusted texts.
Raw counts are scaled to the trusted total and both get the same prior ``PRIOR``, so a gram too rare to
be expected among the trusted says nothing. A text's score is the mean, over its n-grams, of
log(trusted share) - log(raw share). A text is kept if it passes the base rules and scores at least the
threshold: the ``TRUSTED_LOSS`` quantile of trusted texts that did not take part in the trusted counts (one in
``FOLDS``, by a hash of doc_id), less ``MARGIN``, so that about that part of texts like them would go.

Trusted texts are all those labelled 1: texts are joined with their labels, and counts and the threshold cover every one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import gram_hashes, slices, span_hashes, staged, text_bytes, word_spans

BUCKETS = 1 << 16
TRUSTED_LOSS = 0.005
FOLDS = 4
PRIOR = 2.0
MARGIN = 0.02
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(rows: pa.RecordBatch):
    data, offsets = text_bytes(rows.column("text"))
    start, end, doc = word_spans(data, offsets)
    words = span_hashes(data, start, end)
    two = gram_hashes(words, 2)
    inside = doc[1:] == doc[:-1]
    bucket = np.concatenate([words, two[inside]]) % np.uint64(BUCKETS)
    return data, offsets, start, end, doc, words, bucket.astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket met in the partition: its count in all texts and in trusted ones of the fitting folds."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for rows in slices(batches, "text"):
        *_, bucket, doc = _grams(rows)
        raw += np.bincount(bucket, minlength=BUCKETS)
        is_good = rows.column("fits").to_numpy(zero_copy_only=False).astype(bool)
        good += np.bincount(bucket[is_good[doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": some, "raw": raw[some], "good": good[some]})


def _line_repeats(data, offsets, start, end, doc, n_rows) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    new = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, new, side="right") - 1
    left = np.concatenate([offsets[:-1], new + 1])
    right_key = np.concatenate([row_of, np.arange(n_rows)])
    right = np.concatenate([new, offsets[1:]])
    left_key = np.concatenate([np.arange(n_rows), row_of])
    left = left[np.lexsort((left, left_key))]
    order = np.lexsort((right, right_key))
    right, row = right[order], right_key[order]
    if len(start) == 0:
        return np.zeros(n_rows, np.int64)
    at = np.searchsorted(start, left)
    has_word = (at < len(start)) & (start[np.minimum(at, len(start) - 1)] < right)
    left, right, row = left[has_word], right[has_word], row[has_word]
    hashes = span_hashes(data, left, right)
    order = np.lexsort((hashes, row))
    same = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=n_rows)


def _word_repeats(words, doc, n_rows) -> np.ndarray:
    """Words inside 3-word windows that occur twice or more in their text."""
    if len(words) < 3:
        return np.zeros(n_rows, np.int64)
    three = gram_hashes(words, 3)
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    order = inside[np.lexsort((three[inside], doc[inside]))]
    same = (three[order][1:] == three[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[order[twice] + k] = True
    return np.bincount(doc[covered], minlength=n_rows)


STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def _judge(batches: Iterator[pa.RecordBatch], ratios) -> Iterator[pa.RecordBatch]:
    ratio = ratios.value
    for rows in slices(batches, "text"):
        data, offsets, start, end, doc, words, bucket, gram_doc = _grams(rows)
        n = rows.num_rows
        n_words = np.bincount(doc, minlength=n)
        rising = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=rising[1:])
        symbols = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_SYMBOL[data], out=symbols[1:])
        n_grams = np.bincount(gram_doc, minlength=n)
        total = np.bincount(gram_doc, weights=ratio[bucket], minlength=n)
        ids = rows.column("doc_id")
        yield pa.RecordBatch.from_pydict({
            "doc_id": ids.cast(pa.int64()), "n_words": n_words,
            "word_chars": np.bincount(doc, weights=rising[end] - rising[start], minlength=n).astype(np.int64),
            "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
            "n_dup_lines": _line_repeats(data, offsets, start, end, doc, n),
            "n_repeat_words": _word_repeats(words, doc, n),
            "llr": total / np.maximum(1, n_grams),
        })


def _quantile(values: DataFrame, column: str, part: float) -> float | None:
    """Exact quantile (linear between neighbours) of a column rounded to 9 digits, by histograms of its billionths: the driver
    gets at most ``BUCKETS`` counts a pass, however many rows there are."""
    whole = values.select(F.round(F.round(column, 9) * 1e9).cast("bigint").alias("v")).where("v is not null")
    low, high, n = whole.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return None
    place = part * (n - 1)
    found = []
    for rank in (int(place), min(int(place) + 1, n - 1)):
        lo, hi = low, high
        while lo < hi:
            width = -(-(hi - lo + 1) // BUCKETS)
            inside = whole.where(F.col("v").between(lo, hi)).groupBy(F.expr(f"(v - {lo}L) div {width}L").alias("b"))
            for b, m in sorted(tuple(r) for r in inside.agg(F.count("v").alias("m")).collect()):
                if rank < m:
                    break
                rank -= m
            lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
        found.append(lo / 1e9)
    return (int(place) + 1 - place) * found[0] + (place - int(place)) * found[1]


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, fits) of every text; false without a trusted label. Both sides meet by a merge join at any size: a table of ids
    that is broadcast while it is small grows with the labels, and texts are shuffled once in the end all the same."""
    rows = docs.join(trusted.hint("merge"), "doc_id", "left")
    return rows.select("text", F.coalesce("fits", F.lit(False)).alias("fits"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, threshold, kept.

    A null or empty text has no words and fails the base rule. Without trusted texts (or none held
    out) only the base rules decide. A doc_id labelled more than once is trusted if any label is 1; null labels
    are left out. Rows are judged one by one, so repeated rows get the same verdict. Extra columns are not
    read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = trusted.withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)) > 0)
    counts = marked(docs, trusted).mapInArrow(_count, "bucket long, raw long, good long")
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # at most BUCKETS
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    ratio = np.zeros(BUCKETS)
    if good.sum() > 0:
        ratio = np.log(good + PRIOR) - np.log(raw * (good.sum() / raw.sum()) + PRIOR)
    ratios = spark.sparkContext.broadcast(ratio)
    judged = staged(docs.mapInArrow(lambda it: _judge(it, ratios), STATS), "quality")
    held_out = judged.where("n_words > 0").join(trusted.where("not fits"), "doc_id", "left_semi")
    cut = _quantile(held_out, "llr", TRUSTED_LOSS)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    cut = None if cut is None else round(cut - MARGIN, 9)
    passed = F.lit(True) if cut is None else F.round("llr", 9) >= F.lit(cut)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & passed).alias("kept"), "llr", F.lit(cut).cast("double").alias("threshold"),
    )
