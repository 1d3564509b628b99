"""Operators 2 and 8 against the libraries and exact round trips."""

import functools
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import pieces, queries, tokens

BPE, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@functools.lru_cache(1)
def library():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=0, max_size=3000), st.integers(0, 3000), st.integers(0, 3000))
def test_blocks_give_back_every_value_and_every_range(values, a, b):
    ids = np.array(values, np.uint32)
    packed = tokens.pack(ids)
    assert (tokens.unpack(packed) == ids).all()
    assert (tokens.unpack(packed, a, b) == ids[a:b]).all()


def test_texts_cut_at_spaces_encode_like_whole_texts():
    random.seed(3)
    texts = ["".join(random.choice(" ab1'\n\t.é  \x1cs　") for _ in range(random.randint(0, 40))) for _ in range(2000)]
    ids, sizes = tokens.encode_texts(pa.array([*texts, None, "<|endoftext|> a"]), BPE)
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for n, e in zip(sizes, ends)] == [library_ids(t) for t in [*texts, None, "<|endoftext|> a"]]


def test_files_hold_the_stream_in_order_of_ids(spark, docs, hard, tmp_path):
    path = tokens.write_ids(docs(hard), BPE, str(tmp_path / "ids"), shards=3)
    got = sorted((tuple(r) for r in tokens.read_digests(spark, path).collect()), key=lambda r: r[1])
    start = 0
    for (i, text), row in zip(sorted(hard, key=lambda r: (r[0] is not None, r[0] or 0)), got):
        ids = [*library_ids(text), tokens.END_ID]
        assert row == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_an_empty_table_gives_no_rows(spark, docs, tmp_path):
    assert tokens.read_digests(spark, tokens.write_ids(docs([]), BPE, str(tmp_path / "none"))).collect() == []
    assert pieces.round_trips(docs([]), MODEL).collect() == []


def best_path(model, text):
    """Plain dynamic programming over the whole text."""
    score, length = [0.0], [0]
    for end in range(1, len(text) + 1):
        best, used = score[end - 1] + pieces.BYTE_COST, 0
        for k in range(min(end, model.longest), 0, -1):
            found = model.ids.get(text[end - k : end])
            if found and score[end - k] + found[1] > best:
                best, used = score[end - k] + found[1], k
        score.append(best)
        length.append(used)
    return pieces._ids(model, text, length, len(text))


def test_the_stream_finds_the_best_path_in_a_bounded_window():
    model = pieces.load(MODEL)
    random.seed(4)
    for n in (0, 1, 5, 70, 400):
        for _ in range(20):
            text = "".join(random.choice("thesaç▁\n漢x ") for _ in range(n))
            groups = list(pieces.stream(model, text))
            assert list(itertools.chain.from_iterable(groups)) == best_path(model, text)
    assert len(list(pieces.stream(model, "the thesis of the " * 200))) > 10  # ids come before the end


def test_ids_decode_exactly_here_and_in_the_library(docs, hard):
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = pieces.encode(docs(hard), MODEL)
    for row in pieces.decode(encoded, MODEL).collect():
        text = pieces.plain(row.text or "")
        assert row.decoded == text and theirs.decode(row.piece_ids) == text and row.n_pieces == len(row.piece_ids)
        assert row.piece_ids == pieces.encode_text(pieces.load(MODEL), row.text or "")
    assert all(r.round_trip for r in pieces.round_trips(docs(hard), MODEL).collect())


def test_the_query_gives_special_tokens_their_single_id_like_the_plain_library(spark, docs, tmp_path):
    end = "<|endoftext|>"
    texts = [f"x {end} a", f"in{end}side", f"x\n {end}\n b", f"{end}  two", f"a  {end} {end}", f"{end}", "<|endoftext |>", f"c {end} ", None]
    docs(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    plain, start = Tokenizer.from_file(BPE), 0
    got = sorted((tuple(r) for r in queries.op2_token_ids(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    for row, text in zip(got, texts, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]
        assert (50256 in ids) == (end in (text or ""))
        assert row == (texts.index(text), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_encoded_together_have_the_ids_they_have_alone():
    plain = Tokenizer.from_file(BPE)
    make = tokens._tokenizer(BPE, False)[1].make
    words = ["the", "don't", "a\nb", "x\n", "\u0120\u0120", "\u0301e", "9\u6f22", "\U0001f600", "\x00", "<|endoftext", "ing" * 300]
    for some in (words * tokens.JOINED, ["", *words], [*words, "\na"], ["\u2003x", "y"]):
        flat, sizes = make(some)
        ends = np.cumsum(sizes)
        assert len(sizes) == len(some) and ends[-1] == len(flat)
        for word, a, b in zip(some, ends - sizes, ends):
            assert flat[a:b].tolist() == plain.encode(" " + word, add_special_tokens=False).ids


def test_blocks_packed_together_are_those_packed_alone():
    random.seed(5)
    tops = (1, 2, 300, 50_000, 1 << 32)
    rows = np.array([[random.randrange(random.choice(tops[: 1 + i % 5])) for _ in range(1024)] for i in range(12)], np.uint32)
    together = tokens.pack_blocks(rows)
    assert together == [tokens.pack_block(row) for row in rows]
    for row, block in zip(rows, together):
        assert tokens.unpack_block(memoryview(block)).tolist() == row.tolist()
    stream = rows.ravel()[:-7]
    assert tokens.unpack(tokens.pack(stream)).tolist() == stream.tolist()


def test_words_met_go_with_the_task():
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words of a text", "and some more"]})
    held = pieces.load(MODEL).words
    for run in (pieces._encode(iter([rows]), MODEL, ["doc_id"]), pieces._digest(iter([rows]), MODEL)):
        assert next(run).num_rows == 2 and held.slot  # kept while the task runs
        assert list(run) == [] and not held.slot
