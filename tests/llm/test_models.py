"""Operators 6, 7, 9 and 10, the SQL twins and the pipeline."""

import collections
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language, mixing, quality, queries, topk
from tallyspark.llm.shared import Staging

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def test_quality_counts(spark, docs, hard):
    rows = [*hard, (50, "# a b c a b c\nx\nx\n\n" + "w " * 60)]
    labels = spark.createDataFrame([(5, 1), (5, None), (99, 1), (None, 1)], "doc_id long, quality int")
    texts = {i: t or "" for i, t in rows}
    for r in quality.quality_rules(docs(rows), labels).collect():
        text = texts[r.doc_id]
        words = re.findall(WORD, text)
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside, seen, twice = [False] * len(words), set(), 0
        for i in range(len(words) - 2):
            if windows[tuple(words[i : i + 3])] > 1:
                inside[i : i + 3] = [True] * 3
        for line in text.split("\n"):
            if re.search(WORD, line):
                twice += line in seen
                seen.add(line)
        n = len(words)
        failed = n < 50 or 100 * sum(inside) > 50 * n
        assert tuple(r)[1:7] == (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, sum(inside), failed)
        assert not (r.kept and failed)
    assert quality.quality_rules(docs([]), labels).collect() == []


def test_quality_counts_and_threshold_cover_every_trusted_text(spark):
    ids = spark.range(60_000)
    docs = ids.selectExpr("id as doc_id", "concat('a', id % 997, ' b', id % 89, ' c', id % 5) as text")
    rules = quality.quality_rules(docs, ids.selectExpr("id as doc_id", "1 as quality"))
    held_out = rules.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.FOLDS)) == 0)
    scores = np.array([round(r.llr, 9) for r in held_out.select("llr").collect()])
    want = np.quantile(scores, quality.TRUSTED_LOSS) - quality.MARGIN
    assert len(scores) > 14_000 and rules.first().threshold == pytest.approx(want, abs=2e-9)


def test_quality_meets_labels_by_the_same_join_at_any_size(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1, True), (2, False)], "doc_id long, fits boolean")
    rows = quality.marked(docs, trusted)
    # The few ids are not broadcast, so shuffled bytes go by the texts, not by whether the ids are few.
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [("a", True), ("b", True), ("c", False), ("d", False), (None, False)], key=str)


def test_quality_keeps_texts_like_the_trusted_and_drops_junk(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_rules(table, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    junk = [r.kept for r in got if r.quality == 0 and r.n_symbols > r.n_words / 2]
    assert sum(good) >= 0.99 * len(good) and junk and not any(junk)


def test_top_k_with_nulls_ties_and_ragged_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)]
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1.0]), (320, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    fine = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for q in (i for i in fine if i % 20 == 0):
        score = {i: int(np.dot(fine[q][: len(v)], v[: len(fine[q])])) for i, v in fine.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:7]
        expected |= {(q, n + 1, i, score[i]) for n, i in enumerate(best)}
    got = topk.exact_top_k(table, F.col("vec_id") % 20 == 0, 7)
    assert {tuple(r) for r in got.collect()} == expected
    assert topk.exact_top_k(table.where("vec_id < 0"), F.col("vec_id") % 20 == 0).collect() == []


def test_rows_that_share_an_id_are_queries_and_candidates_of_their_own(spark):
    rows = [(0, [32.0]), (0, [16.0]), (1, [1.0]), (2, [0.0]), (3, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") == 0, 2).collect()]
    one, two = 64 * 64 * 32 * 16, [64 * 64 * 32, 64 * 64 * 16]
    assert sorted(got) == sorted([(0, 1, 0, one), (0, 2, 1, two[0]), (0, 1, 0, one), (0, 2, 1, two[1])])


def test_language_of_held_out_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(table, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_keeps_no_table_that_its_result_does_not_read(spark):
    with Staging.scope() as paths:
        rows = queries.op9_language_id(spark, SMALL)
        left = sorted(path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in paths if os.path.isdir(path.removeprefix("file:")))
        assert left == ["language-entries", "language-read"]
        assert rows.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_language_backs_off_and_says_und(spark, docs):
    train = spark.createDataFrame([("en", "the house and the tree"), ("de", "das haus und der baum"), (None, "x"), ("en", None)], "lang string, text string")
    model = language.fit(train)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(docs([(1, "Treehouse"), (2, "haus"), (3, "12 !"), (4, None), (5, "")]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"]
    nothing = language.fit(train.where("false"))
    assert language.identify(docs([(1, "house")]), nothing).first().lang_pred == "und"
    assert language.identify(docs([]), model).collect() == []


def fair(budget, children):
    """Water filling by bisection on exact fractions: names to (weight, capacity)."""
    left, open_ = budget, dict(children)
    out = {}
    while open_:
        weights = sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if c * weights <= left * w}
        if not full:
            return out | {k: left * w // weights for k, (w, _) in open_.items()}
        out |= full
        left -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def test_budgets_fill_siblings_before_ancestors(spark):
    tokens = {("a", "en", "s1"): 10, ("a", "en", "s2"): 500, ("a", "de", "s1"): 40, ("b", "en", "s3"): 3000, ("b", "fr", "s3"): 7}
    leaves = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "domain string, language string, leaf_source string, tokens long")
    domains, languages, sources = {"a": 3, "b": 1}, {"en": 2}, {"s1": 5}
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(leaves, F.lit(1000), domains, languages, sources, 1, 2).collect()}
    cap = lambda *head: sum(2 * v for k, v in tokens.items() if k[: len(head)] == head)
    expected = {}
    for d, b in fair(1000, {d: (domains[d], cap(d)) for d in "ab"}).items():
        inner = {k[1] for k in tokens if k[0] == d}
        for lang, c in fair(b, {x: (languages.get(x, 1), cap(d, x)) for x in inner}).items():
            ends = {k[2] for k in tokens if k[:2] == (d, lang)}
            for s, e in fair(c, {x: (sources.get(x, 1), cap(d, lang, x)) for x in ends}).items():
                expected[d, lang, s] = e
    assert got == expected


def test_a_leaf_takes_whole_epochs_and_the_token_prefix_of_the_last(spark, docs, hard):
    table = docs([(i, "w " * (i % 7 + 1)) for i in range(400)] + hard).selectExpr("*", "5 as epoch")
    rows = mixing.mix_sources(table, F.lit("d"), F.expr("_tokens * 150 div 100")).collect()
    budget = rows[0].leaf_budget
    taken = sum(r.mix_tokens for r in rows)
    assert budget - 7 * 130 < taken <= budget
    epochs = collections.Counter((r.doc_id, r.text) for r in rows)
    assert set(epochs.values()) == {1, 2} and len(epochs) == 400 + len(hard)
    again = mixing.mix_sources(table.repartition(3), F.lit("d"), F.expr("_tokens * 150 div 100")).collect()
    assert collections.Counter(map(str, again)) == collections.Counter(map(str, rows))
    assert mixing.mix_sources(docs([]), F.lit("d"), F.expr("_tokens")).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    answer = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in answer.description]
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert collections.Counter(map(str, map(tuple, df.select(*columns).collect()))) == collections.Counter(map(str, answer.fetchall()))


def test_pipeline_stages_do_their_work_and_keep_columns(spark):
    import corpus_pipeline as pipeline

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, kept = table, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.staged(stage(spark, docs, SMALL), "test")
        kept[name] = docs.count()
        if name != pipeline.STAGES[-1][0]:
            assert docs.dtypes == table.dtypes
    assert kept["language ID"] > kept["line dedup"] >= kept["MinHash near-dedup"] > 0
    assert docs.where("n_pieces = 0 and length(text) > 0").isEmpty() and kept["mixing"] == kept["SentencePiece encoding"] > 0


def plain_languages(train, texts):
    """(language, score) of each text by plain counting of all words and n-grams."""
    parts = lambda t: re.findall(r"[^\W\d_]+", t.lower())

    def grams(word, k):
        marked = word if k == 1 else f"<{word}>"
        return [marked[i : i + k] for i in range(len(marked) - k + 1)]

    names = sorted({lang for lang, _ in train})
    counts = {k: {x: collections.Counter() for x in names} for k in range(6)}
    for lang, text in train:
        for word in parts(text):
            counts[0][lang][word] += 1
            for k in range(1, 6):
                counts[k][lang].update(grams(word, k))
    kinds = {k: len(set().union(*counts[k].values())) for k in counts}

    def log(k, lang, x):
        return np.log((counts[k][lang][x] + 0.5) / (counts[k][lang].total() + 0.5 * kinds[k]))

    out = []
    for text in texts:
        total = np.zeros(len(names))
        for word in parts(text):
            met = [word] if any(counts[0][x][word] for x in names) else []
            k = 0 if met else 5
            while not met and k:
                met = [g for g in grams(word, k) if any(counts[k][x][g] for x in names)]
                k -= not met
            if met:
                total += [np.mean([log(k, x, g) for g in met]) for x in names]
        out.append((names[int(total.argmax())], 1 / np.exp(total - total.max()).sum()))
    return out


@pytest.mark.parametrize("common", [0, 40, 10**6])
def test_every_language_word_and_gram_counts(spark, docs, common):
    """More than 64 languages; the last by word count are told like the first, whatever is sent to the executors."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüßéèñçøåłžšč"))

    def word(own):
        return "".join(rng.choice(own, rng.integers(3, 9)))

    train, texts, wanted = [], [], []
    for i in range(70):
        own = rng.choice(letters, 9, replace=False)
        words = [word(own) for _ in range(140 - i)]
        train.append((f"l{i:02}", " ".join([*words, *words[:20]])))
        texts.append(" ".join([*words[-12:], words[0] + words[1]]))
        texts.append(" ".join(words[-8:]))
        wanted += [f"l{i:02}"] * 2
    model = language.fit(spark.createDataFrame(train, "lang string, text string"), common)
    assert len(model.languages) == 70
    got = {r.doc_id: r for r in language.identify(docs(list(enumerate(texts))), model).collect()}
    expected = plain_languages(train, texts)
    assert [got[i].lang_pred for i in range(len(texts))] == [x for x, _ in expected] == wanted
    assert np.allclose([got[i].score for i in range(len(texts))], [s for _, s in expected], atol=2e-3)


def test_the_language_stage_corrects_labels_and_drops_noise_only(spark):
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(9)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxzаžчøł"), rng.integers(3, 9))) for _ in range(80)) for _ in range(8)]
    rows = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(noise)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang")
    wrong = F.col("doc_id") % 50 == 7
    tagged = table.withColumn("lang", F.when(wrong, F.when(F.col("lang") == "de", "fr").otherwise("de")).otherwise(F.col("lang")))
    got = pipeline.language_id(spark, tagged.unionByName(rows, allowMissingColumns=True), "")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    assert {r.doc_id: r.lang for r in got.select("doc_id", "lang").collect()} == truth


def test_an_unseen_word_is_tried_with_shorter_grams_only_if_it_has_no_longer_one(spark, monkeypatch):
    tables = {}
    write = language.Staging.table

    def table(self, df, name):
        tables[name] = write(self, df, name)
        if name.startswith("language-weighed"):
            words[name] = sorted(r.word for r in tables[name].select("word").collect())
        return tables[name]

    words = {}
    monkeypatch.setattr(language.Staging, "table", table)
    labelled = spark.createDataFrame([("abcdefgh ij", "a"), ("mnop", "b")], "text string, lang string")
    docs = spark.createDataFrame([(1, "xabcdey zabcq abcdefgh mnop j q qaq")], "doc_id long, text string")
    assert language.identify(docs, language.fit(labelled, common=0)).count() == 1
    assert words == {
        "language-weighed-0": ["abcdefgh", "mnop"], "language-weighed-5": ["xabcdey"], "language-weighed-4": [],
        "language-weighed-3": ["zabcq"], "language-weighed-2": ["j"], "language-weighed-1": ["qaq"],
    }
