"""From raw documents to encoded training text: five stages, each over all that the one before kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import language, lines, mixing, near, pieces
from tallyspark.llm.queries import BUDGET, DOMAINS, LANGUAGES, SOURCES, domain_of, tokenizer_file
from tallyspark.llm.shared import Staging, delete, staged


#: A document whose evidence per word is below this part of its language's median is in no known language
#: (sf0.01: noise 0, labelled documents 0.25 and more). Texts of fewer words are too short to tell and stay.
EVIDENCE = 0.2
LEAST_WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The language found replaces the label; documents without any letter or in no known language go.

    The median evidence of a language is that of all documents whose label is the language found.
    """
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2
    found = staged(language.identify(docs, language.fit(docs.where(train))), "language-found")
    agreed = found.where(F.col("lang") == F.col("lang_pred"))
    usual = agreed.groupBy("lang_pred").agg(F.percentile_approx("lang_evidence", 0.5, 1000).alias("usual"))
    found = found.where(F.col("lang_pred") != language.UNKNOWN).join(F.broadcast(usual), "lang_pred", "left")  # a row per language
    fine = F.col("lang_evidence") >= EVIDENCE * F.coalesce("usual", F.lit(0.0))
    return found.where(fine | (mixing.n_words(F.col("text")) < LEAST_WORDS)).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines close to an earlier line go, and documents of which nothing is left."""
    cut = lines.dedup_lines(docs)
    left = cut.where((F.col("n_removed") == 0) | (mixing.n_words(F.col("text")) > 0))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles) the document with the smallest id stays."""
    gone = near.near_duplicates(docs, width=5).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one row for each epoch in which a document is taken."""
    budget = F.expr(f"_tokens * {BUDGET} div 100")
    return mixing.mix_sources(docs, domain_of(F.col("source")), budget, DOMAINS, LANGUAGES, SOURCES).select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


#: Tables that the stages begun last have staged. When the next stage begins, the result of the one before is written.
_held: list[str] = []


def _scoped(stage):
    """The stage, which first deletes what earlier stages staged, unless its documents are read from there."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = " ".join(docs.inputFiles())
        free = [path for path in _held if path.rpartition("/")[2] not in read]
        delete(spark, free)
        _held[:] = [path for path in _held if path not in free]
        with Staging.scope() as paths:
            out = stage(spark, docs, sf_dir)
        _held.extend(paths)
        return out

    return run_stage


STAGES = [
    ("language ID", _scoped(language_id)),
    ("line dedup", _scoped(line_dedup)),
    ("MinHash near-dedup", _scoped(near_dedup)),
    ("mixing", _scoped(mix_sources)),
    ("SentencePiece encoding", _scoped(sentencepiece_encoding)),
]

#: Language models and piece searches cannot be stated in SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
