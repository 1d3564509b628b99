"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search keeps, for the last ``longest piece`` characters, the best score and the piece that ends
there. Whenever all surviving paths run through one boundary, the ids before it are final and are
given out, so the window stays bounded however long the text is. Pieces never reach over the start of
a word (a marked space), so each word start is such a boundary: what is committed there depends on the
word alone, and a word met before is taken from a cache of bounded size.

The score of a path is the sum of the scores of its pieces; of equal scores the path whose last piece is
longer wins. Characters that no piece covers become their UTF-8 byte pieces.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import WordIds, encode_rows, flattened, ragged, slices

SPACE = "▁"
CACHE_ENTRIES = 800_000
#: A character without a piece costs more than any path of known pieces (some have a score of -1e9).
BYTE_COST = -1.0e12


class Pieces:
    """Pieces and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        skip = {*special, *self.byte_ids.values()}
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.ids = {p: (i, model.get_score(i)) for i, p in enumerate(self.names) if i not in skip}
        self.unknown = model.unk_id()
        self.special = set(special)
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        #: A word start is a boundary of every path unless a piece holds a mark behind another character.
        self.cut_at_marks = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.words = WordIds(lambda words: flattened([_word(self, SPACE + w) for w in words]), CACHE_ENTRIES)
        raw = [b"" if i in self.special else self.bytes_of.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.names)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_offsets = np.cumsum([0, *map(len, raw)])

    def while_encoding(self, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task. Words met go with it: the worker lives on and runs tasks of other jobs, which need the memory."""
        try:
            yield from rows
        finally:
            self.words.clear()


@functools.lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def stream(pieces: Pieces, chars: Iterable[str]) -> Iterator[list[int]]:
    """Groups of final ids for a stream of characters; holds a window of ``longest`` + open characters.

    For each place of the window: best score and length of the last piece, or 0 for byte pieces.
    """
    window = ""                     # characters behind the last committed boundary
    score, length = [0.0], [0]      # per boundary of the window
    for char in chars:
        window += char
        end = len(window)
        best, used = score[end - 1] + BYTE_COST, 0
        for k in range(min(pieces.longest, end), 0, -1):
            found = pieces.ids.get(window[end - k :])
            if found is not None and score[end - k] + found[1] > best:
                best, used = score[end - k] + found[1], k
        score.append(best)
        length.append(used)
        if end >= 2 * pieces.longest and end % 8 == 0:
            # Surviving paths end at the last ``longest`` boundaries; walk them back until one is left.
            ends = set(range(end - pieces.longest + 1, end + 1))
            while len(ends) > 1:
                last = max(ends)
                ends.discard(last)
                ends.add(last - (length[last] or 1))
            meet = ends.pop()
            if meet > 0:
                yield _ids(pieces, window, length, meet)
                window, base = window[meet:], score[meet]
                score, length = [x - base for x in score[meet:]], [0, *length[meet + 1 :]]
    if window:
        yield _ids(pieces, window, length, len(window))


def _whole(pieces: Pieces, word: str) -> list[int]:
    """The same search when the window holds all of a short word: every path ends at its end."""
    n = len(word)
    score, length = [float("-inf")] * (n + 1), [0] * (n + 1)
    score[0] = 0.0
    get, prefixes = pieces.ids.get, pieces.prefixes
    for start in range(n):
        here = score[start]
        for end in range(start + 1, n + 1):
            part = word[start:end]
            if part not in prefixes:
                break
            found = get(part)
            if found is not None and here + found[1] > score[end]:
                score[end], length[end] = here + found[1], end - start
        if here + BYTE_COST > score[start + 1]:
            score[start + 1], length[start + 1] = here + BYTE_COST, 0
    return _ids(pieces, word, length, n)


def _ids(pieces: Pieces, window: str, length: list[int], end: int) -> list[int]:
    out: list[int] = []
    while end > 0:
        k = length[end]
        if k:
            out.append(pieces.ids[window[end - k : end]][0])
        else:
            k = 1
            raw = window[end - 1].encode("utf-8", "surrogatepass")
            out.extend(pieces.byte_ids.get(b, pieces.unknown) for b in reversed(raw))
        end -= k
    out.reverse()
    return out


def encode_text(pieces: Pieces, text: str) -> list[int]:
    """Ids of a whole text by the stream: spaces become marks, and one stands in front."""
    return list(itertools.chain.from_iterable(stream(pieces, SPACE + text.replace(" ", SPACE)))) if text else []


def _word(pieces: Pieces, word: str) -> list[int]:
    """Ids of one marked word."""
    if len(word) > 4 * pieces.longest:
        return list(itertools.chain.from_iterable(stream(pieces, word)))
    return _whole(pieces, word)


def encode_texts(pieces: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per text) of whole texts.

    A text with runs of spaces, or with marks of its own, goes through the stream; other texts are cut at
    spaces, where all paths meet.
    """
    uneven = f"  |^ | \\z|^\\z|{SPACE}" if pieces.cut_at_marks else "(?s)^.*"
    return encode_rows(texts, pieces.words, uneven, lambda some: [encode_text(pieces, text) for text in some], first_apart=False)


def decode_rows(pieces: Pieces, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """UTF-8 of each row of ids: marks as spaces, the front one dropped; control ids vanish."""
    raw, per_id = ragged(pieces.raw, pieces.raw_offsets, ids.astype(np.int64))
    rising = np.concatenate([[0], np.cumsum(per_id)])
    ends = rising[np.cumsum(sizes)]
    whole = raw.tobytes()
    return [whole[a:b].removeprefix(b" ") for a, b in zip([0, *ends.tolist()], ends.tolist())]


def plain(text: str) -> str:
    """What a round trip gives back: the text with every mark character as a space."""
    return text.replace(SPACE, " ")


def _names(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in ("piece_ids", "n_pieces")]


def _encode(batches: Iterator[pa.RecordBatch], path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    pieces = load(path)
    for rows in pieces.while_encoding(slices(batches, "text")):
        flat, sizes = encode_texts(pieces, rows.column("text"))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*[rows.column(c) for c in columns], pa.ListArray.from_arrays(ends, flat.astype(np.int32)), pa.array(sizes)],
            names=[*columns, "piece_ids", "n_pieces"],
        )


def encode(docs: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) with piece_ids array<int> and n_pieces; a null or empty text has no ids.

    Columns called like the added ones are replaced.
    """
    columns = _names(columns or docs.columns)
    rows = docs.select(*columns, *([] if "text" in columns else ["text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(lambda it: _encode(it, path, columns), f"{schema}, piece_ids array<int>, n_pieces long")


def _decode(batches: Iterator[pa.RecordBatch], path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    pieces = load(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            lists = rows.column("piece_ids")
            flat = np.asarray(lists.flatten()).astype(np.int64)
            raw = decode_rows(pieces, flat, np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            text = [x.decode("utf-8", "replace") if y else None for x, y in zip(raw, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in columns], pa.array(text, pa.string())], names=[*columns, "decoded"]
            )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text of piece_ids; null ids give null."""
    columns = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in columns)
    return encoded.select(*columns).mapInArrow(lambda it: _decode(it, path, columns), f"{schema}, decoded string")


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = load(path)
    for rows in pieces.while_encoding(slices(batches, "text")):
        ids, sizes = encode_texts(pieces, rows.column("text"))
        ends = np.cumsum(sizes)
        little = ids.astype("<u4")
        crc = [zlib.crc32(little[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        back = decode_rows(pieces, ids, sizes)
        same = [a == plain(b or "").encode() for a, b in zip(back, rows.column("text").to_pylist())]
        yield pa.RecordBatch.from_pydict({
            "doc_id": rows.column("doc_id").cast(pa.int64()), "n_pieces": pa.array(sizes, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_()),
        })


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_pieces, crc32 of the ids (little-endian 32 bit), and whether decoding gives the text."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _digest(it, path), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"
    )
