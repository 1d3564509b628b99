"""One registered query per operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, jaccard, language, lines, merkle, mixing, near, passages, pieces, quality, suffixes, tokens, topk

TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_ids(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), ordinary=False)
    return tokens.read_digests(spark, path)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return table.select("vec_id", F.col(next(c for c, t in table.dtypes if t.startswith("array"))).alias("vector"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_vectors(spark, sf_dir), F.col("vec_id") % 20 == 0)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    model.forget()
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Production weights of the mixing query: domains, languages, and one hot source held down.
DOMAINS = {"d0": 5, "d1": 3, "d2": 2}
LANGUAGES = {"en": 4, "de": 3, "fr": 2, "es": 1}
SOURCES = {"src0": 2, "src1": 3}
#: Part of all tokens asked for, in percent.
BUDGET = 80


def domain_of(source) -> F.Column:
    """Three domains from the digits of the source's md5, as a stand-in for a catalogue of sources."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(F.coalesce(source, F.lit("?"))), 1, 4), 16, 10).cast("int") % 3).cast("string"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(
        _table(spark, sf_dir, "documents"), domain_of(F.col("source")), F.expr(f"_tokens * {BUDGET} div 100"), DOMAINS, LANGUAGES, SOURCES
    )
    return mixed.select("doc_id", "domain", "language", "leaf_source", "mix_tokens", "leaf_budget", "epoch")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_vectors(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_token_ids, op3_substring_dedup, op4_line_dedup, op5_minhash_dedup, op6_quality_rules,
        op7_exact_top_k, op8_sentencepiece, op9_language_id, op10_mixing, op11_centroid_clustering, op12_merkle_manifest,
        op13_ngram_join,
    )
}

def _rounds_sql(clusters: int, rounds: int) -> str:
    """SQL of the clustering: one CTE per round of assignment and one per round of centroids."""
    parts = [
        f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM v QUALIFY c < {clusters}
        )"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
            SELECT r, min({{'d': CAST(list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c}}) AS m
            FROM v CROSS JOIN c{i} k GROUP BY r
        )"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
            SELECT k.c, coalesce(t.q, k.q) AS q FROM c{i} k LEFT JOIN (
                SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
                    SELECT m.c AS c, i, sum(x) AS s, count(*) AS n
                    FROM (SELECT m, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v JOIN a{i} USING (r)) GROUP BY m.c, i
                ) GROUP BY c
            ) t ON t.c = k.c
        )"""
            )
    return ", ".join(parts) + f"""
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} k ON k.c = m.c
    """


#: What SQL can express. Suffixes, automata, hashes of kept bytes, piece searches and models are tested by brute force.
ORACLES: dict[str, str] = {
    "op4_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents
        ), t AS (
            SELECT doc_id, i, line,
                   list_sort(list_distinct(list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: x <> ''))) AS ws
            FROM l
        ), c AS (
            SELECT ws, len(ws) AS n, min({'d': doc_id, 'i': i}) AS f FROM t WHERE len(ws) > 0 GROUP BY ws
        ), w AS (SELECT f, n, unnest(ws) AS word FROM c), r AS (SELECT word, count(*) AS m FROM w GROUP BY word),
        p AS (
            SELECT f, n, word FROM (
                SELECT w.f, w.n, w.word, row_number() OVER (PARTITION BY w.f ORDER BY r.m, w.word) AS nth FROM w JOIN r USING (word)
            ) WHERE nth <= n - ceil(n * 0.9) + 1
        ), pairs AS (
            SELECT DISTINCT a.f AS af, b.f AS bf FROM p a JOIN p b ON a.word = b.word AND a.f < b.f
            WHERE 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
        ), near AS (
            SELECT DISTINCT bf FROM pairs JOIN c x ON x.f = af JOIN c y ON y.f = bf
            WHERE 100 * len(list_intersect(x.ws, y.ws)) >= 90 * (x.n + y.n - len(list_intersect(x.ws, y.ws)))
        ), keep AS (SELECT f.d AS d, f.i AS i FROM c ANTI JOIN near ON near.bf = c.f)
        SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (len(t.ws) > 0 AND keep.d IS NULL) AS n_removed,
               sha256(coalesce(string_agg(t.line, chr(10) ORDER BY t.i) FILTER (len(t.ws) = 0 OR keep.d IS NOT NULL), '')) AS kept_sha256
        FROM t LEFT JOIN keep ON t.doc_id = keep.d AND t.i = keep.i GROUP BY t.doc_id
    """,
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    "op11_centroid_clustering": _rounds_sql(centroids.CLUSTERS, centroids.ROUNDS),
    "op12_merkle_manifest": r"""
        WITH RECURSIVE part AS (
            SELECT doc_id, text, lang, coalesce('v' || lang, 'n') AS g, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                   list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
                                              lambda x: coalesce(strlen(x) || ':' || x, '-')), lambda a, b: a || b) AS head
            FROM documents
        ), chosen AS (
            SELECT *, xor(list_reduce(flatten([[4294967295], flatten(list_transform(list_filter(string_split(id, ''), lambda x: x <> ''),
                       lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))]),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 3 = 0 AS tampered
            FROM part
        ), leaf AS MATERIALIZED (
            SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
                   sha256(head || coalesce(strlen(text) || ':' || CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS t
            FROM chosen
        ), placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf
        ), tree AS (
            SELECT 0 AS lvl, g, i, n, h FROM placed
            UNION ALL
            SELECT lvl + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lvl, g, i // 8, n
        ), tops AS MATERIALIZED (
            SELECT g, lvl AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
        ), upper_tree AS (
            SELECT 0 AS lvl, '' AS g, i, n, subroot AS h FROM tops
            UNION ALL
            SELECT lvl + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM upper_tree WHERE n > 1 GROUP BY lvl, g, i // 8, n
        ), sides AS MATERIALIZED (
            SELECT lvl, g, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                   coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
            FROM (SELECT * FROM tree UNION ALL SELECT * FROM upper_tree) WHERE n > 1 WINDOW w AS (PARTITION BY lvl, g, i // 8 ORDER BY i)
        ), low AS (
            SELECT g, i AS spot, 0 AS lvl, i, t AS cur, '' AS proof FROM placed
            UNION ALL
            SELECT low.g, spot, low.lvl + 1, low.i // 8, sha256(a || cur || b), proof || a || b FROM low JOIN sides USING (g, lvl, i)
        ), high AS (
            SELECT low.g AS own, spot, 0 AS lvl, tops.i, cur, proof FROM low JOIN tops ON tops.g = low.g AND tops.height = low.lvl
            UNION ALL
            SELECT own, spot, high.lvl + 1, high.i // 8, sha256(a || cur || b), proof || a || b
            FROM high JOIN sides ON sides.g = '' AND sides.lvl = high.lvl AND sides.i = high.i
        )
        SELECT p.doc_id, p.h AS leaf, tops.subroot, r.h AS root, sha256(high.proof) AS proof_sha256, high.cur AS folded_root, high.cur = r.h AS verified
        FROM placed p JOIN tops ON tops.g = p.g JOIN upper_tree r ON r.n = 1
        JOIN high ON high.own = p.g AND high.spot = p.i AND high.lvl = r.lvl
    """,
}
