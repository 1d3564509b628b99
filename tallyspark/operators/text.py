"""Text features: 1-2-gram tf-idf with sublinear counts, as sparse unit vectors.

Fitting counts terms in one aggregation with map-side combine. Scoring is one map-only pass: the vocabulary, at most
``max_terms`` rows, goes to every task, and Arrow batches are turned into vectors without a loop over rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T


#: A word: two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
WEIGHTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, however it is written."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_terms(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the words of the lower-cased text and its pairs of neighbouring words; null texts have none."""
    words = _fresh(df, "_words")
    found = df.withColumn(words, F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array()))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return found.withColumn(out, F.concat(words, pairs)).drop(words)


def term_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, n, n_texts): how often a term occurs and in how many texts, from one shuffle of combined counts."""
    terms = with_terms(df.select(F.col(text).alias("text")), "text", "terms")

    def marked(values: Column, first: bool) -> Column:
        return F.transform(values, lambda t: F.struct(t.alias("term"), F.lit(first).alias("first")))

    both = F.concat(marked(F.col("terms"), False), marked(F.array_distinct("terms"), True))
    return (
        terms.select(F.inline(both))
        .groupBy("term")
        .agg(F.count_if(~F.col("first")).alias("n"), F.count_if("first").alias("n_texts"))
    )


@dataclasses.dataclass
class TextFeatures:
    """Fitted terms in alphabetical order with their inverse document frequencies; at most ``max_terms`` of them."""

    vocabulary: list[str]
    idf: np.ndarray

    def _map(self, df: DataFrame, text: str, out: str, kind: T.DataType, assemble) -> DataFrame:
        terms = _fresh(df, "_terms")
        size = len(self.vocabulary)
        shipped = df.sparkSession.sparkContext.broadcast((self.vocabulary, np.asarray(self.idf, dtype=float)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, idf = shipped.value
            known = pa.array(vocabulary, pa.string())
            for batch in batches:
                column = batch.schema.get_field_index(terms)
                lists = batch.column(column)
                row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                place = pc.index_in(pc.list_flatten(lists).cast(pa.string()), known)
                met = place.is_valid().to_numpy(zero_copy_only=False)
                at = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cells, counts = np.unique(row[met] * max(size, 1) + at[met], return_counts=True)
                row, at = np.divmod(cells, max(size, 1))
                weight = (1.0 + np.log(counts)) * idf[at]
                norm = np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))
                weight = weight / norm[row]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
                made = assemble(known, size, pa.array(ends), at, weight)
                kept = [batch.column(i) for i in range(batch.num_columns) if i != column]
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*(n for n in batch.schema.names if n != terms), out])

        schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
        return with_terms(df, text, terms).mapInArrow(score, schema)

    def transform(self, df: DataFrame, text: str = "description", out: str = "text_features") -> DataFrame:
        """Add a sparse vector of unit length; a text without known terms, or null, has an empty one."""

        def vector(known, size, ends, at, weight):
            n = len(ends) - 1
            return pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, size), pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(weight, pa.float64())),
                ],
                names=["type", "size", "indices", "values"],
            )

        return self._map(df, text, out, VectorUDT(), vector)

    def weights(self, df: DataFrame, text: str = "description", out: str = "weights") -> DataFrame:
        """Add the same weights with their terms, as an array in the order of the vocabulary."""

        def named(known, size, ends, at, weight):
            pairs = pa.StructArray.from_arrays([known.take(pa.array(at, pa.int64())), pa.array(weight)], names=["term", "weight"])
            return pa.ListArray.from_arrays(ends, pairs)

        return self._map(df, text, out, WEIGHTED, named)


def fit_text_features(train: DataFrame, text: str = "description", max_terms: int = 10_000) -> TextFeatures:
    """The ``max_terms`` terms that occur most often (ties: alphabetically) with ln((1 + texts) / (1 + its texts)) + 1.

    Null texts do not count. The driver gets the chosen terms only.
    """
    rows = train.where(F.col(text).isNotNull())
    n_texts = rows.count()
    chosen = term_counts(rows, text).orderBy(F.desc("n"), "term").limit(max_terms)
    found = sorted((r.term, r.n_texts) for r in chosen.collect())
    frequency = np.array([n for _, n in found], dtype=float)
    return TextFeatures([t for t, _ in found], np.log((1.0 + n_texts) / (1.0 + frequency)) + 1.0)
