"""Language identification: known words by their frequency in each language, then shorter n-grams.

A document's score for a language adds up log frequencies of its words. A word met in training counts by its
frequency per language. An unseen word is judged by the longest order of character n-grams of which training
met any, from ``ORDERS[0]`` down to single characters: the mean of the log frequencies of those n-grams.

Every language, every word and every n-gram of the training documents counts, and totals are those of all of them.
The counts are tables in the shared folder. Only the ``COMMON`` most frequent words are sent to the executors, which
saves shuffles and changes no result: other words meet their counts in joins. Log frequencies are whole
numbers of 1 / ``SCALE``, so sums have the same bits in any order.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Staging, partitions, slices

COMMON = 100_000
#: Text handled at once; bounds a worker's memory.
READ_BYTES = 1 << 20
#: Rows with lists of entries handled at once.
ROWS = 1_000
ORDERS = (5, 4, 3, 2, 1)
SCALE = 1 << 16
UNKNOWN = "und"
#: Added columns.
ADDED = ("lang_pred", "score", "lang_evidence")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case runs of letters of all texts, and the row of each."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    return words.filter(some), np.asarray(rows.filter(some))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text", 4 * READ_BYTES):
        words, at = words_of(rows.column("text"))
        if len(words) == 0:
            continue
        table = pa.table({"lang": rows.column("lang").take(pa.array(at)), "word": words, "n": np.ones(len(at), np.int64)})
        counts = table.group_by(["lang", "word"]).aggregate([("n", "sum")])
        out = pa.table({"lang": counts["lang"].cast(pa.string()), "word": counts["word"].cast(pa.string()), "n": counts["n_sum"]})
        yield from out.to_batches()


@dataclasses.dataclass
class Common:
    """The frequent words: entries ``offsets[row] : offsets[row + 1]`` hold the languages that have the word."""

    n_languages: int
    rows: dict[str, int]
    offsets: np.ndarray
    language: np.ndarray
    gain: np.ndarray


@dataclasses.dataclass
class Model:
    """``base``: log share of an entry that a language does not have, by order (0: words). ``words`` and ``grams``
    are tables of an entry and its ``hits``, the count in each language that has it."""

    languages: list[str]
    base: dict[int, np.ndarray]
    common: Common
    words: DataFrame
    grams: DataFrame
    stage: Staging

    def forget(self) -> None:
        """Delete the tables. What ``identify`` gave before does not read them any more; the model is of no use after it."""
        self.stage.drop("language-words", "language-grams")


def gains(n: np.ndarray) -> np.ndarray:
    """What n occurrences add to the log share of an entry without any: log((n + 0.5) / 0.5)."""
    return np.rint(SCALE * np.log(2.0 * n + 1)).astype(np.int64)


def _grams(word: Column, order: int) -> Column:
    """The n-grams of a word between marks (single characters without marks), behind their order."""
    text = word if order == 1 else F.concat(F.lit("<"), word, F.lit(">"))
    last = F.char_length(text) - (order - 1)
    cut = lambda i: F.concat(F.lit(str(order)), F.substring(text, i, F.lit(order)))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), cut)).otherwise(F.array().cast("array<string>"))


def _hits(counts: DataFrame, entry: str) -> DataFrame:
    return counts.groupBy(entry).agg(F.sort_array(F.collect_list(F.struct("j", "n"))).alias("hits"), F.sum("n").alias("n"))


def fit(labelled: DataFrame, common: int = COMMON) -> Model:
    """The model of rows (text, lang); rows without either are left out.

    Counts are combined per slice and then per task before they are shuffled. ``common`` bounds the words sent to
    every executor and has no influence on results.
    """
    spark = labelled.sparkSession
    stage = Staging(spark)
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = labelled.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stage.table(counts, "language-counts")
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())
    places = spark.createDataFrame(list(enumerate(names)), "j int, lang string")  # one row per language
    counts = counts.join(F.broadcast(places), "lang").select("j", "word", "n")
    words = stage.table(_hits(counts, "word"), "language-words")
    grams = counts.select("j", "n", F.explode(F.concat(*[_grams(F.col("word"), k) for k in ORDERS])).alias("gram"))
    grams = stage.table(_hits(grams.groupBy("gram", "j").agg(F.sum("n").alias("n")), "gram"), "language-grams")
    stage.drop("language-counts")
    base = {}
    both = words.select(F.lit("0").alias("kind"), "hits").unionByName(grams.select(F.substring("gram", 1, 1).alias("kind"), "hits"))
    sizes = {int(r[0]): r[1] for r in both.groupBy("kind").agg(F.count(F.lit(1))).collect()}
    totals = {k: np.zeros(len(names)) for k in (0, *ORDERS)}
    for kind, j, n in both.select("kind", F.inline("hits")).groupBy("kind", "j").agg(F.sum("n")).collect():
        totals[int(kind)][j] = n
    for kind, total in totals.items():
        base[kind] = np.rint(SCALE * np.log(0.5 / (total + 0.5 * max(1, sizes.get(kind, 0))))).astype(np.int64)
    level = F.floor(16 * F.log2("n"))
    least, room = None, common
    for at, m in sorted(map(tuple, words.groupBy(level.alias("at")).agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True):
        room -= m
        if room < 0:
            break
        least = at
    frequent = words.where(level >= least if least is not None else F.lit(False)).select("word", "hits.j", "hits.n").collect()
    flat = lambda i: np.array([x for r in frequent for x in r[i]], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in frequent], dtype=np.int64)])
    held = Common(len(names), {r[0]: i for i, r in enumerate(frequent)}, offsets.astype(np.int64), flat(1), gains(flat(2)))
    return Model(names, base, held, words, grams, stage)


def _read(batches: Iterator[pa.RecordBatch], shared, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums of the frequent words of each text, and its other words."""
    common: Common = shared.value
    width = common.n_languages
    for rows in slices(batches, "text", READ_BYTES):
        n = rows.num_rows
        words, at = words_of(rows.column("text"))
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter((common.rows.get(w, -1) for w in distinct), np.int64, len(distinct))
        row = place[np.asarray(coded.indices)] if len(at) else np.zeros(0, np.int64)
        met = row >= 0
        # Repeats of a word in a text are one entry.
        pairs, times = np.unique(at[met] * max(1, len(common.rows)) + row[met], return_counts=True)
        doc, word = np.divmod(pairs, max(1, len(common.rows)))
        size = common.offsets[word + 1] - common.offsets[word]
        ends = np.cumsum(size)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(common.offsets[word] - ends + size, size)
        sums = np.zeros((n, width), np.int64)
        np.add.at(sums, (np.repeat(doc, size), common.language[entry]), np.repeat(times, size) * common.gain[entry])
        rest = words.filter(pa.array(~met)).cast(pa.string())
        starts = np.concatenate([[0], np.cumsum(np.bincount(at[~met], minlength=n))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*[rows.column(c) for c in columns],
             pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(sums.ravel())),
             pa.array(np.bincount(at[met], minlength=n)), pa.ListArray.from_arrays(pa.array(starts), rest)],
            names=[*columns, "_sums", "_common", "_rest"],
        )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Size of each list (null: 0) and all entries one after another."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(column)


def _field(entries: pa.Array, name: str) -> np.ndarray:
    return pc.struct_field(entries, name).to_numpy(zero_copy_only=False)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word one ``entry``, 4-byte whole numbers: its kind, then each language that has any of its entries and the mean
    gain there (at most ``SCALE`` times 44)."""
    for batch in _parts(batches):
        held, entries = _lists(batch.column("hits"))
        size, hits = _lists(entries)
        word = np.repeat(np.repeat(np.arange(batch.num_rows), held), size)
        j = _field(hits, "j").astype(np.int64)
        width = int(j.max(initial=0)) + 1
        places, at = np.unique(word * width + j, return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, at, gains(_field(hits, "n")).astype(np.int64))
        word, j = np.divmod(places, width)
        ends = np.arange(batch.num_rows + 1) + 2 * np.searchsorted(word, np.arange(batch.num_rows + 1))
        data = np.zeros(ends[-1], "<i4")
        data[ends[:-1]] = batch.column("kind").to_numpy()
        first = 2 * np.arange(len(word)) + word + 1
        data[first], data[first + 1] = j, sums // held[word]
        entry = pa.BinaryArray.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
        )
        yield pa.RecordBatch.from_arrays([batch.column("word"), entry], names=["word", "entry"])


def _unpacked(entries: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind and number of languages of each entry, language and gain of all one after another)."""
    entries = entries.cast(pa.large_binary())
    offsets = np.frombuffer(entries.buffers()[1], np.int64)[entries.offset : entries.offset + len(entries) + 1]
    values = np.frombuffer(entries.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i4")
    starts = (offsets - offsets[0]) // 4
    of_pair = np.ones(len(values), bool)
    of_pair[starts[:-1]] = False
    pairs = values[of_pair].astype(np.int64).reshape(-1, 2)
    return values[starts[:-1]].astype(np.int64), np.diff(starts) // 2, pairs[:, 0], pairs[:, 1]


def _judge(batches: Iterator[pa.RecordBatch], languages: list[str], base: dict[int, np.ndarray], columns: list[str]) -> Iterator[pa.RecordBatch]:
    width = len(languages)
    for rows in _parts(batches):
        n = rows.num_rows
        known = _lists(rows.column("_sums"))[1].to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, width).copy()
        count = rows.column("_common").to_numpy().astype(np.int64)
        total = known + count[:, None] * base[0]
        words = count + rows.column("_n_rest").to_numpy()
        held, entries = _lists(rows.column("_found"))
        if width and len(entries):
            row = np.repeat(np.arange(n), held)
            kind, size, j, gain = _unpacked(entries)
            kinds = max(base) + 1
            times = np.bincount(row * kinds + kind, minlength=n * kinds).reshape(n, kinds)
            for k, own in base.items():
                total += times[:, k, None] * own
            at = np.repeat(row, size) * width + j
            np.add.at(total.reshape(-1), at, gain)
            whole = np.repeat(kind == 0, size)
            np.add.at(known.reshape(-1), at[whole], gain[whole])
        if width:
            best = total.argmax(axis=1)  # the first of equals: names are in order
            top = total[np.arange(n), best]
            share = 1.0 / np.exp((total - top[:, None]) / SCALE).sum(axis=1)
            evidence = known[np.arange(n), best] / SCALE / np.maximum(words, 1)
        fine = (words > 0) & bool(width)
        lang = [languages[best[i]] if f else UNKNOWN for i, f in enumerate(fine.tolist())]
        zero = np.zeros(n)
        yield pa.RecordBatch.from_arrays(
            [*[rows.column(c) for c in columns], pa.array(lang, pa.string()), pa.array(np.where(fine, share if width else zero, 0.0)),
             pa.array(np.where(fine, evidence if width else zero, 0.0))],
            names=[*columns, *ADDED],
        )


def identify(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with lang_pred, score (the share of the best language) and
    lang_evidence: per word of the text, what its occurrences in that language add to the log share; unseen words add 0.

    Only ``text`` is an input. A text that is null or has no letter, and any text if nothing was learned,
    is ``und`` with score 0; equal scores go to the first language by name. Columns called like the
    added ones are replaced.
    """
    named = [c for c in columns or docs.columns if c not in ADDED]
    # Under names of its own, so that no column of docs meets an internal one; text keeps its name.
    columns = ["text" if c == "text" else f"c{i}" for i, c in enumerate(named)]
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(named, columns)] + ([] if "text" in named else [F.col("text")])
    shared = docs.sparkSession.sparkContext.broadcast(model.common)  # bounded by COMMON
    schema = "".join(f"`{n}` {docs.schema[c].dataType.simpleString()}, " for c, n in zip(named, columns))
    read = docs.select(*own).mapInArrow(
        lambda it: _read(it, shared, columns), schema + "_sums array<long>, _common long, _rest array<string>"
    )
    stage = Staging(docs.sparkSession)
    read = stage.table(read.withColumn("_k", F.monotonically_increasing_id()), "language-read")
    rest = read.select("_k", F.explode("_rest").alias("word"))
    need = rest.groupBy("word").agg(F.count(F.lit(1)).alias("times")).select("word")
    need = stage.table(need.join(model.words.select("word", "hits"), "word", "left"), "language-rest")
    weighed_as = "word string, entry binary"
    seen = need.where("hits is not null").select("word", F.lit(0).alias("kind"), F.array("hits").alias("hits"))
    weighed = stage.table(seen.mapInArrow(_weigh, weighed_as), "language-weighed-0")
    names = ["language-weighed-0"]
    # One order after the other, so that only the n-grams of one are on the disk: shorter ones are of words met by no longer one.
    new = need.where("hits is null").select("word").repartition(partitions(docs.sparkSession), "word")
    for k in ORDERS:
        left = new if k == ORDERS[0] else new.join(weighed.select("word"), "word", "left_anti")
        tried = left.select("word", F.explode(_grams(F.col("word"), k)).alias("gram"))
        met = tried.join(model.grams.select("gram", "hits"), "gram").groupBy("word").agg(F.collect_list("hits").alias("hits"))
        met = met.select("word", F.lit(k).alias("kind"), "hits")
        names.append(f"language-weighed-{k}")
        weighed = weighed.unionByName(stage.table(met.mapInArrow(_weigh, weighed_as), names[-1]))
    stage.drop("language-rest")
    # So are those of the words before their entries are collected by text.
    entries = stage.table(rest.join(weighed, "word").select("_k", "entry"), "language-entries")
    stage.drop(*names)
    found = entries.groupBy("_k").agg(F.collect_list("entry").alias("_found"))
    rows = read.withColumn("_n_rest", F.size("_rest").cast("long")).drop("_rest").join(found, "_k", "left")
    languages, base = model.languages, model.base
    judged = rows.mapInArrow(
        lambda it: _judge(it, languages, base, columns), schema + "lang_pred string, score double, lang_evidence double"
    )
    return judged.select(*(F.col(n).alias(c) for c, n in zip(named, columns)), *ADDED)
