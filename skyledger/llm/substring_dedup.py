"""Substring dedup over sliding spans of sentences.

A sentence ends at a line feed, at . ! or ? unless a word follows at once, or at a
mark of Chinese and Japanese; one of more than `PIECE` words counts as several. It
is cut where the words choose: of every `PIECE` words in a row, before the one of
the least hash. So a passage is cut alike wherever it begins, and one of more than
50 words always has a span of its own. Characters of scripts without spaces
(Chinese, Japanese, Thai) are words. Sentences are compared by their words, in
any case and with any punctuation. From each sentence on, the span is the next
`sentences` of them, or as many more as `words` words take. Every span is hashed
to 96 bits; equal spans of all documents meet in one aggregate that combines
before the shuffle and keeps the least document, and in a join that Spark splits,
so a passage that a third of all documents share is never in one task. Sentences
that any span but the first covers are cut out: in the least document the first
place stays, in all others none does.

Defined results: NULL, empty texts and texts of fewer sentences than a span have
no spans; documents with a NULL id stay as they are; rows that share an id count
as one document for what is first, and each loses its own repeats; cutting out
all sentences leaves an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.storage import stored
from skyledger.llm.text import ALPHANUMERIC, byte_slices, mix, utf8, window_starts, word_hashes, word_spans

PIECE = 10
SENTENCES = 3
WORDS = 20
_END = np.isin(np.arange(256), list(b".!?"))
_FEED = np.uint8(0x0A)
_WIDE_ENDS = [s.encode() for s in "。！？．｡"]
_PLACES = np.random.default_rng(20250119).integers(1, 1 << 62, (2, PIECE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


@dataclass
class Spans:
    """Of all texts of a slice: sentence bytes and the first sentence of each text; for each sentence the end of its span (or -1) and two hashes."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    until: np.ndarray
    hashes: list[np.ndarray]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like word_spans, with characters of scripts without spaces as words; also whether a sentence ends at each byte."""
    stop = np.append(_END[data[:-1]] & ~ALPHANUMERIC[data[1:]], False) | (data == _FEED)
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] |= _END[data[last]]
    if not ((data >= 0xE0) & (data <= 0xEF)).any():
        return *word_spans(data, offsets, ALPHANUMERIC), stop
    a, b = data, np.append(data[1:], 0)
    c = np.append(data[2:], [0, 0]) if len(data) > 1 else np.zeros_like(data)
    mark = np.zeros(len(data), dtype=bool)
    for x, y, z in _WIDE_ENDS:
        mark |= (a == x) & (b == y) & (c == z)
    stop |= mark
    # U+3000 to U+303F but the letters 3005 to 3007, and wide , : ;
    mark |= (a == 0xE3) & (b == 0x80) & ((c < 0x85) | (c > 0x87))
    mark |= (a == 0xEF) & (b == 0xBC) & np.isin(c, [0x8C, 0x9A, 0x9B])
    alone = (((a >= 0xE3) & (a <= 0xE9)) | ((a == 0xE0) & ((b == 0xB8) | (b == 0xB9)))) & ~mark
    plain = data.copy()
    for k in range(3):
        plain[np.flatnonzero(mark) + k] = 0x20
    starts, ends, _ = word_spans(plain, offsets, ALPHANUMERIC)
    at = np.flatnonzero(alone)
    inner = np.unique(np.concatenate((at, at + 3)))  # words also begin and end at these, where they are inside one
    inside = np.searchsorted(starts, inner, side="right") - 1
    inner = inner[(inside >= 0) & (inner > starts[inside]) & (inner < ends[inside])] if len(starts) else inner[:0]
    starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends, np.searchsorted(starts, offsets), stop


def _chosen(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words have the least hash of some `PIECE` words in a row of their text."""
    out = np.zeros(len(hashes), dtype=bool)
    begins = window_starts(first, PIECE)
    best, at = hashes[begins], begins.copy()
    for j in range(1, PIECE):
        less = hashes[begins + j] < best
        best[less], at[less] = hashes[begins[less] + j], begins[less] + j
    out[at] = True
    return out


def spans_of(texts: pa.Array, sentences: int, words: int) -> Spans:
    data, offsets = utf8(texts)
    starts, ends, first, stop = _words(data, offsets)
    n = len(starts)
    if not n:
        none = np.empty(0, np.int64)
        return Spans(none, none, np.zeros(len(offsets), np.int64), none, [np.empty(0, np.uint64)] * 2)
    stops = np.concatenate(([0], np.cumsum(stop)))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = stops[starts[1:]] > stops[ends[:-1]]
    fresh[first[:-1][first[:-1] < n]] = True
    hashes = word_hashes(data, starts, ends)
    whole = np.flatnonzero(fresh)
    long = np.diff(np.append(whole, n)) > PIECE
    fresh |= np.repeat(long, np.diff(np.append(whole, n))) & _chosen(hashes, first)
    heads = np.flatnonzero(fresh)  # first word of each sentence or part of one
    place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    codes = [mix(np.add.reduceat(hashes * own[place], heads)) for own in _PLACES]
    own_first = np.searchsorted(heads, first)
    texts_of = np.repeat(np.arange(len(first) - 1), np.diff(own_first))
    last = own_first[1:][texts_of]
    count = np.append(heads, n)
    # one past the last sentence of the span from each sentence on
    at = np.arange(len(heads))
    until = np.maximum(at + sentences, np.searchsorted(count, count[:-1] + words))
    until = np.where(until <= last, until, -1)
    out = []
    for code, base in zip(codes, _BASES, strict=True):
        powers = np.full(len(code) + 1, base, dtype=np.uint64)
        back = np.full(len(code) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        powers[0] = back[0] = 1
        powers, back = np.cumprod(powers), np.cumprod(back)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(code * powers[:-1])))
        out.append(mix((sums[until] - sums[at]) * back[at] + (until - at).astype(np.uint64)))
    tails = np.append(heads[1:], n) - 1
    return Spans(starts[heads], ends[tails], own_first, until, out)


def _rows(docs: DataFrame, id: str, text: str, sentences: int, words: int) -> DataFrame:
    """A row for each span: document, place, hash, and whether the document has it before."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                found = spans_of(part.column(text), sentences, words)
                at = np.flatnonzero(found.until >= 0)
                row = np.searchsorted(found.first, at, side="right") - 1
                again = np.ones(len(at), dtype=bool)
                order = np.lexsort((at, found.hashes[0][at], row))
                key = found.hashes[0][at][order]
                new = np.append(True, (key[1:] != key[:-1]) | (row[order][1:] != row[order][:-1])) if len(at) else np.empty(0, bool)
                again[order[new]] = False
                columns = [
                    part.column(id).take(pa.array(row)),
                    pa.array((at - found.first[row]).astype(np.int32)),
                    pa.array(found.hashes[0][at].view(np.int64)),
                    pa.array((found.hashes[1][at] >> np.uint64(33)).astype(np.int32)),
                    pa.array(again),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "place", "span", "check", "again"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.where(f"`{id}` is not null").select(id, text).mapInArrow(spans, f"doc {kind}, place int, span bigint, check int, again boolean")


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """`doc` and the sorted places of its spans that are not the first of their kind."""
    rows = stored(_rows(docs, id, text, sentences, words), "spans")
    shared = rows.where("not again").groupBy("span", "check").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least != last")
    # The spans are sorted for this join at every size: the list of shared ones grows with the corpus.
    later = rows.where("not again").select("doc", "place", "span", "check").join(stored(shared, "shared").hint("merge"), ["span", "check"]).where("doc > least")
    every = rows.where("again").select("doc", "place").union(rows.join(stored(later.select("doc", "span", "check"), "later").hint("merge"), ["doc", "span", "check"], "left_semi").select("doc", "place"))
    return stored(every.groupBy("doc").agg(F.sort_array(F.collect_set("place")).alias("places")), "places")


def without_repeated_spans(
    docs: DataFrame, id: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS
) -> DataFrame:
    """All columns of the documents, the text without sentences of repeated spans, with n_sentences and n_sentences_cut."""
    columns = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in ("n_sentences", "n_sentences_cut")}
    back = {c: k for k, c in columns.items()}
    places = repeated_spans(docs, id, text, sentences, words).hint("merge")
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])
    rows = rows.join(places, F.col(back[id]) == F.col("doc"), "left").drop("doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, back[text]):
                found = spans_of(part.column(back[text]), sentences, words)
                n = np.diff(found.first)
                gone = np.zeros(part.num_rows, dtype=np.int64)
                texts = part.column(back[text])
                changed: dict[int, str] = {}
                lists = part.column("places")
                for k in np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False)).tolist():
                    low = int(found.first[k])
                    covered = np.zeros(n[k] + 1, dtype=np.int64)
                    at = np.array(lists[k].as_py(), dtype=np.int64)
                    at = at[at < n[k]]  # rows that share an id may differ in length
                    at = at[found.until[low + at] >= 0]
                    np.add.at(covered, at, 1)
                    np.add.at(covered, found.until[low + at] - low, -1)
                    hit = np.cumsum(covered[:-1]) > 0
                    gone[k] = hit.sum()
                    changed[k] = _kept(texts[k].as_py(), found, low, hit)
                if changed:
                    values = texts.to_pylist()
                    for k, value in changed.items():
                        values[k] = value
                    texts = pa.array(values, texts.type)
                arrays = [texts if c == back[text] else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n), pa.array(gone)], names=[*columns, "n_sentences", "n_sentences_cut"])

    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in columns.items())
    out = rows.mapInArrow(cut, schema + ", n_sentences bigint, n_sentences_cut bigint")
    return out.select(*[F.col(k).alias(c) for k, c in columns.items()], "n_sentences", "n_sentences_cut")


def _kept(text: str, found: Spans, low: int, hit: np.ndarray) -> str:
    """The text from each kept sentence to the next sentence; what stands before the first belongs to it."""
    raw = text.encode()
    if hit.all():
        return ""
    begin = int(found.starts[low]) if low < len(found.starts) else 0
    # byte places are those of the slice; the first word of this text tells its own
    shift = begin - _lead(raw)
    bounds = [0, *(found.starts[low + 1 : low + len(hit)] - shift).tolist(), len(raw)]
    return b"".join(raw[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~hit)).decode()


def _lead(raw: bytes) -> int:
    data = np.frombuffer(raw, dtype=np.uint8)
    return int(_words(data, np.array([0, len(data)]))[0][0])
