"""Operators 4 and 5 against brute force over all pairs."""

import random
import re

import pytest

from tallyspark.llm import lines, near

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def varied(n, size, seed):
    """Texts around a few originals, from equal to far."""
    random.seed(seed)
    bases = [[random.choice("abcdefghijklmnop") + str(random.randint(0, 60)) for _ in range(size)] for _ in range(3)]
    out = []
    for _ in range(n):
        words = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 2, 4, 9])):
            words[random.randrange(size)] = f"z{random.randint(0, 9)}"
        out.append(words)
    return out


def kept_lines(rows, percent):
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        parts, stay = (text or "").split("\n"), []
        for line in parts:
            own = set(re.findall(WORD, line))
            if own and any(100 * len(own & x) >= percent * len(own | x) for x in seen):
                seen.append(own)
                continue
            if own:
                seen.append(own)
            stay.append(line)
        out[i] = (None if text is None else "\n".join(stay), 0 if text is None else len(parts), 0 if text is None else len(parts) - len(stay))
    return out


@pytest.mark.parametrize("percent", [90, 70])
def test_similar_lines(docs, hard, percent):
    rows = [r for r in hard if r[0] is not None]
    rows += [(100 + i, " ".join(w[:20]) + "\n" + " ".join(w[20:])) for i, w in enumerate(varied(60, 40, percent))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs(rows), percent).collect()}
    assert got == kept_lines(rows, percent)


def test_lines_of_null_ids_repeated_rows_clashing_columns_and_no_rows(docs):
    table = docs([(None, "a b c"), (3, "a b c"), (4, "q w e"), (4, "q w e")]).selectExpr("*", "7 as n_lines")
    got = lines.dedup_lines(table).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("3", ""), ("4", "q w e"), ("4", "q w e"), ("None", "a b c")]
    assert lines.dedup_lines(docs([])).collect() == []


def groups(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(WORD, (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, hard, width):
    rows = [r for r in hard if r[0] is not None] + [(100 + i, " ".join(w)) for i, w in enumerate(varied(80, 120, width))]
    got = {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(docs(rows), width).collect()}
    assert got == groups(rows, width, 80)


def test_near_duplicates_of_null_ids_repeated_rows_and_no_rows(docs):
    got = near.near_duplicates(docs([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b c"), (6, None)]), 2).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("3", "3", True), ("3", "3", True), ("5", "3", False), ("6", "6", True), ("None", "None", True),
    ]
    assert near.near_duplicates(docs([]), 2).collect() == []


def test_pairs_of_small_collections_find_all_that_plain_tables_would():
    """The tables of all pairs of groups miss a pair at the threshold in fewer than two of a thousand cases."""
    s = (near.PERCENT / 100) ** near.ROWS
    assert (1 - (1 - s) ** near.TENSOR) ** 2 > 0.998
