"""Operators 1 and 3 against brute force over every window."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tallyspark.llm import passages, suffixes

WORD = r"[^\x20\x09-\x0D]+"


def removed_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 80])
def test_repeated_bytes(docs, hard, length):
    rows = [r for r in hard if r[0] is not None]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(docs(rows), length).collect()}
    assert got == dict(zip([i for i, _ in rows], removed_bytes([t for _, t in rows], length)))


def test_repeated_rows_null_ids_and_empty_tables(docs):
    text = "abcdefghij" * 50
    got = suffixes.remove_repeats(docs([(1, text), (1, text), (None, text), (2, "abc")])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 500), ("1", 500), ("2", 0), ("None", 500)]
    assert suffixes.remove_repeats(docs([])).collect() == []
    assert passages.remove_passages(docs([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00", min_size=0, max_size=24), min_size=1, max_size=12))
def test_multikey_quicksort_orders_and_measures_prefixes(words):
    raw = [w.encode() for w in words]
    size = np.array([len(b) for b in raw])
    data = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
    keys = suffixes._columns(data, np.cumsum(size) - size, size, 1)
    order, common = suffixes.multikey_quicksort(keys, np.zeros(len(raw), int), size)
    ranked = [raw[i] for i in order]
    assert ranked == sorted(raw)
    for a, b, n in zip(ranked, ranked[1:], common[1:]):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def removed_words(rows, window):
    words = {i: re.findall(WORD, t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window, limit", [(13, 8000), (5, 8000), (13, 1), (5, 2), (3, 1)])
def test_repeated_passages(docs, hard, window, limit):
    # A low limit makes every recurring key hot; results do not depend on it.
    rows = [r for r in hard if r[0] is not None]
    got = {r.doc_id: tuple(r)[1:] for r in passages.remove_passages(docs(rows), window, limit).collect()}
    assert got == removed_words(rows, window)


def test_passages_of_null_ids_and_equal_ids_stay(docs):
    text = " ".join(map(str, range(40)))
    got = passages.remove_passages(docs([(5, text), (5, text), (None, text), (9, text)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("5", 0), ("5", 0), ("9", 40), ("None", 0)]


def test_many_stretches_behind_one_key(docs):
    # A common phrase with other words around it everywhere, and one passage that recurs among them.
    again = " ".join(f"r{i}" for i in range(9)) + " of the said party"
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(9)) + " of the said party " + " ".join(f"b{i}x{j}" for j in range(9))) for i in range(600)]
    rows += [(600, f"before {again} after"), (601, f"other {again} end")]
    for limit in (50, 8000):
        got = {r.doc_id: tuple(r)[1:] for r in passages.remove_passages(docs(rows), limit=limit).collect()}
        assert got == removed_words(rows, 13)
        assert got[601][1] == 13 and sum(g[1] for g in got.values()) == 13


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=3, max_size=9), st.integers(0, 3)), max_size=12))
def test_locate_finds_every_occurrence(stretches):
    bodies, ids = [" ".join(w) for w, _ in stretches], np.array([i for _, i in stretches], np.int64)
    where = collections.defaultdict(set)
    for w, i in stretches:
        for k in range(len(w) - 2):
            where[tuple(w[k : k + 3])].add(i)
    want = [[min(d) if len(d := where[tuple(w[k : k + 3])]) > 1 else None for k in range(len(w) - 2)] for w, _ in stretches]
    assert passages.locate(pa.array(bodies, pa.string()), ids, ids, 3).to_pylist() == want
