"""Operators 11 to 13 against brute force, and on awkward tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import centroids, jaccard, merkle, queries
from tests.test_registered import duck, table

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_merkle_manifest"])
def test_same_rows_as_sql(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    answer = duck(SMALL).execute(queries.ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in answer.description], answer.fetchall())


# ---------------------------------------------------------------- clustering


def plain_clusters(rows, k, rounds, seed=3):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    middles = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(middles)):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            if own:
                middles[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [nearest(v) for _, v in kept]
    far = {c: sum(d for d, o in last if o == c) for c in range(len(middles))}
    names = [sha(",".join(map(str, m))) for m in middles]
    return sorted((str(i), c, d, far[c], sum(far.values()), names[c]) for (i, _), (d, c) in zip(kept, last))


def test_clusters_with_ties_repeats_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 2]) for i in range(400)]
    rows += [(7, [0.5] * 6), (7, [0.5] * 6), (None, [1.0] * 6), (900, [100.0] * 6)]
    bad = [(1000, None), (1001, [1.0] * 5), (1002, [None] * 6), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (1005, [1e9] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, vector array<double>").withColumn("cluster", F.lit("other")).repartition(5)
    got = centroids.cluster(df, clusters=9, rounds=4, dimensions=6)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_clusters(rows, 9, 4)
    few = centroids.cluster(df.where("vec_id in (900, 1000)"), clusters=9, rounds=2, dimensions=6).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in few] == [(900, 0, 0)]
    assert centroids.cluster(df.limit(0)).collect() == []


def test_the_scan_finds_the_nearest_centroid_exactly():
    rng = np.random.default_rng(5)
    for spread in (2, 1000, 1 << 26):
        vectors = rng.integers(-spread, spread, (500, 8))
        middles = np.concatenate([rng.integers(-spread, spread, (30, 8)), vectors[:3], vectors[:3], np.zeros((1, 8), int)])
        number, distance = centroids.nearest(vectors, middles)
        every = ((vectors[:, None] - middles[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


# ---------------------------------------------------------------- manifest


def plain_manifest(rows, arity=8):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def build(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def sides(levels, i):
        out = []
        for level in levels[:-1]:
            at = i - i % arity
            out.append(("".join(level[at:i]), "".join(level[i + 1 : at + arity])))
            i //= arity
        return out

    langs = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))):
        langs.setdefault(r.lang, []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: build([leaf(r, r.text) for r in langs[x]]) for x in order}
    top = build([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            path = sides(trees[x], i) + sides(top, k)
            bad = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            own = leaf(r, r.text.translate(LOWER) if bad else r.text)
            for a, b in path:
                own = sha(a + own + b)
            out.append((str(r.doc_id), trees[x][0][i], trees[x][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), own, own == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("n_langs, arity", [(1, 8), (11, 8), (3, 2)])
def test_manifest_of_awkward_rows(spark, docs, hard, n_langs, arity):
    rows = hard + [(i, f"Text {i} Of Some Words") for i in range(20, 150)] + [(3, "one"), (3, "one"), (4, "Other"), (500, "A" * 200_000)]
    lang = F.when(F.pmod(F.hash("doc_id"), F.lit(n_langs)) == 0, F.lit(None)).otherwise(F.concat(F.lit("\u00e9"), F.pmod(F.hash("doc_id"), F.lit(n_langs)).cast("string")))
    df = docs(rows).withColumn("lang", lang).withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("source")))
    df = df.selectExpr("*", "1 as g", "2 as h", "3 as i", "4 as leaf", "5 as n").repartition(7)
    got = merkle.document_manifest(df, arity)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_manifest(df.collect(), arity)


def test_manifest_of_one_and_of_no_row(docs):
    one = merkle.document_manifest(docs([(1, "x")])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("") and one.verified
    assert merkle.document_manifest(docs([])).collect() == []


# ---------------------------------------------------------------- n-gram join


def linked(rows, width, percent):
    sets = []
    for _, text in rows:
        words = re.findall(WORD, (text or "").translate(LOWER))
        sets.append({tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)})
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return sorted(
        (str(d), len(sets[i]), str(smallest.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)
    )


@pytest.mark.parametrize("width, percent, hubs", [(5, 80, 8), (2, 80, 1), (3, 50, 2)])
def test_join_equals_all_pairs(docs, hard, width, percent, hubs):
    from tests.llm.test_duplicates import varied

    rows = hard + [(3, "One"), (None, "no id one two three"), (6, "Other text of id six")]
    rows += [(200 + i, " ".join(w)) for i, w in enumerate(varied(120, 60, 11))]
    rows += [(400 + i, f"a{i} b{i} c{i} " + " ".join(f"s{k}" for k in range(12))) for i in range(40)]  # all share a passage
    table = docs(rows).selectExpr("*", "1 as n", "2 as key", "'x' as component_id").repartition(6)
    links, found = jaccard.ngram_join(table, width, percent, bits=6, most=4, hubs=hubs)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == linked(rows, width, percent)
    assert links.where(f"100 * overlap < {percent} * (n_a + n_b - overlap)").count() == 0


def test_join_of_a_long_text_and_of_no_row(docs):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long), (2, long.replace("w60000 ", "changed ")), (3, long[:300_000])]
    assert sorted((r.doc_id, r.component_id) for r in jaccard.linked_documents(docs(rows)).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert jaccard.linked_documents(docs([])).collect() == []
