"""Exact top-k search by integer inner product, term at a time.

Vectors become integers. Candidate blocks hold one posting list per dimension: places and weights of
the non-zero components. For a block of query rows, each query term scatters its weighted postings into
dense score arrays of the block; ``argpartition`` keeps the best k of a block, and a running merge the
best k of a task. Queries and candidates are both cut into blocks of bounded size, and each (query block,
candidate range) is one row of work, so neither side is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import partitions, staged

SCALE = 64
QUERY_ROWS = 1024
BLOCK_ROWS = 2048
CACHED_ROWS = 32
K = 20


def _pack(batches: Iterator[pa.RecordBatch], rows_each: int) -> Iterator[pa.RecordBatch]:
    """Blocks of valid vectors: ids, row numbers, width and the integers of all rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows_each):
            some = batch.slice(at, rows_each)
            ids, numbers, vectors = [], [], []
            for i, number, v in zip(*(some.column(c).to_pylist() for c in ("vec_id", "number", "vector"))):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.floor(SCALE * np.asarray(v, np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    numbers.append(number)
                    vectors.append(x.astype(np.int64))
            if not ids:
                continue
            width = max(map(len, vectors))
            table = np.zeros((len(ids), width), "<i8")
            for row, v in zip(table, vectors):
                row[: len(v)] = v
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([np.asarray(ids, "<i8").tobytes()], pa.binary()),
                "numbers": pa.array([np.asarray(numbers, "<i8").tobytes()], pa.binary()),
                "width": pa.array([width], pa.int32()), "cells": pa.array([table.tobytes()], pa.binary()),
            })


def pack_vectors(vectors: DataFrame, rows_each: int) -> DataFrame:
    """Blocks of rows (vec_id, number, vector); null vectors and null, NaN or infinite components take no part."""
    return vectors.mapInArrow(lambda it: _pack(it, rows_each), "ids binary, numbers binary, width int, cells binary")


def _table(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, numbers = (np.frombuffer(row[f"{side}{c}"], "<i8") for c in ("ids", "numbers"))
    return ids, numbers, np.frombuffer(row[f"{side}cells"], "<i8").reshape(len(ids), row[f"{side}width"])


def block_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores of a candidate block for all query rows, one term (dimension) at a time.

    Query rows go in groups whose scores fit a core's cache; a posting list that holds most of the block is
    added as a whole column. Scores are 32 bit wherever no sum can overflow.
    """
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width]
    bound = width * int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0))
    kind = np.int32 if bound < 2**31 else np.int64
    columns = np.ascontiguousarray(candidates.T.astype(kind))
    postings = [np.flatnonzero(c) for c in columns]
    queries = queries.astype(kind)
    scores = np.zeros((len(queries), len(candidates)), kind)
    part = np.zeros((CACHED_ROWS, len(candidates)), kind)
    for at in range(0, len(queries), CACHED_ROWS):
        rows = scores[at : at + CACHED_ROWS]
        some = part[: len(rows)]
        for term, posted in enumerate(postings):
            weight = queries[at : at + CACHED_ROWS, term]
            if 2 * posted.size > len(candidates):
                np.multiply(weight[:, None], columns[term], out=some)
                rows += some
            elif posted.size:
                for j in np.flatnonzero(weight):
                    rows[j, posted] += weight[j] * columns[term, posted]
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of a row, ties to smaller ids, by selecting a partition first."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > cut)
        ties = np.flatnonzero(scores == cut)
        if above.size + ties.size > k:
            ties = ties[np.argsort(ids[ties], kind="stable")[: k - above.size]]
        keep = np.concatenate([above, ties])
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


_NONE = np.iinfo(np.int64).min


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by query block; the best so far of one block are held at a time."""
    held, best = None, {}

    def out() -> pa.RecordBatch:
        rows = [(*q, int(i), int(s)) for q, (score, ids) in best.items() for s, i in zip(score, ids)]
        q, number, i, s = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_pydict({
            "query_id": pa.array(q, pa.int64()), "query_number": pa.array(number, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())
        })

    for batch in batches:
        for row in batch.to_pylist():
            if row["query_block"] != held:
                if best:
                    yield out()
                held, best = row["query_block"], {}
            query_ids, query_numbers, queries = _table(row, "q_")
            ids, numbers, candidates = _table(row, "")
            scores = block_scores(queries, candidates)
            for j, q in enumerate(zip(query_ids.tolist(), query_numbers.tolist())):
                line, others = scores[j], ids
                own = numbers == q[1]
                if own.any():
                    line, others = line[~own], ids[~own]
                if q in best:
                    line, others = np.concatenate([best[q][0], line]), np.concatenate([best[q][1], others])
                best[q] = best_of(line, others, k)
    if best:
        yield out()


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query row.

    ``vectors`` has vec_id and vector; ``is_query`` marks the query rows. A component x counts as
    floor(64 x). A query row's candidates are all rows but itself; rows that share an id, or are equal, are queries and
    candidates of their own. Shorter vectors are padded with zeros. Fewer candidates than k give all of them; no queries or no
    candidates give no rows. Extra columns are not read.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    vectors = staged(vectors.withColumn("number", F.monotonically_increasing_id()), "query-vectors")  # the rows' own numbers
    queries = staged(
        pack_vectors(vectors.where(is_query).repartition(max(1, partitions(spark) // 4)), QUERY_ROWS).withColumn(
            "query_block", F.monotonically_increasing_id()
        ),
        "query-blocks",
    )
    blocks = pack_vectors(vectors, BLOCK_ROWS)
    # Every query block meets every candidate block: an equal join on the query block, whose candidate
    # side is repeated once per query block, spread by (query block, slot) so that none is hot.
    slots = max(2, partitions(spark) // 2)
    numbers = queries.select(F.col("query_block").alias("q")).groupBy().agg(F.sort_array(F.collect_list("q")).alias("qs"))
    names = numbers.first()["qs"]  # one number per 1,024 query rows
    candidates = (
        blocks.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)))
        .withColumn("query_block", F.explode(F.lit(names).cast("array<long>") if names else F.array().cast("array<long>")))
    )
    asked = queries.select(
        "query_block", F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers"), F.col("width").alias("q_width"), F.col("cells").alias("q_cells"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"),
    )
    work = candidates.join(asked.hint("merge"), ["query_block", "slot"])
    found = work.select("query_block", *(f"{side}{c}" for side in ("q_", "") for c in ("ids", "numbers", "width", "cells"))).mapInArrow(
        lambda it: _search(it, k), "query_id long, query_number long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id", "query_number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
