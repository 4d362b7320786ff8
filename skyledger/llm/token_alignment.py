"""Alignment of the tokens of two vocabularies over the same bytes, by interval coalescing.

A text is encoded by a byte-level vocabulary (A, a space before the text) and by a
sentence-piece vocabulary (B, which puts that space itself). Tokens are intervals
of bytes. All intervals of A and B, sorted by start, are coalesced: the running
maximum of their ends is the end of what is open, and a group of tokens begins
where a start reaches it. Within a group the overlaps are expanded: at every start
the open token of A and the open token of B are linked.

How often two ids are linked is counted in documents over the whole corpus. A
block of some megabytes of text is one row of a stored table: its documents, its
distinct pairs with the number of documents that hold them, and for each document
which of these pairs it holds how often. Only the distinct pairs of blocks are
shuffled, to be added up by pair and to bring the sums back to their blocks; a
pair that stands in every document is one row a block, and no link or text is
moved on its account. A block and the sums of its pairs meet in one task, and a
block is bounded by its bytes, or is one longer text.

Defined results: a NULL or empty text has no tokens, nor has one whose tokens do
not give its bytes back (a vocabulary may change characters); its numbers are 0
and its digest is empty. Strings of special tokens are plain text. Repeated rows
are documents of their own; ids may be NULL or equal, as documents are carried
along and never joined by id; an empty table gives no rows. Only the columns in
`keep` are carried, inside a struct, so no name of the table clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.storage import stored
from skyledger.llm.text import byte_slices, utf8
from skyledger.llm.tokens import encode_texts

BLOCK = 1 << 23
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class TokenBytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.at[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _byte_letters() -> dict[str, int]:
    """Letters of byte-level vocabularies: printable characters stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(0x100)) - set(shown))
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


@cache
def byte_level_bytes(path: str) -> TokenBytes:
    from tokenizers import Tokenizer

    letters = _byte_letters()
    library = Tokenizer.from_file(path)
    names = {number: token for token, number in library.get_vocab(with_added_tokens=False).items()}
    return TokenBytes([bytes(letters.get(c, 0x3F) for c in names.get(n, "")) for n in range(library.get_vocab_size())])


@cache
def sentence_piece_bytes(path: str) -> TokenBytes:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)

    def own(n: int) -> bytes:
        piece = library.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if library.is_byte(n) else piece.replace("▁", " ").encode()

    return TokenBytes([own(n) for n in range(library.get_piece_size())])


def _restored(ids: np.ndarray, bounds: np.ndarray, table: TokenBytes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts their tokens give back, byte by byte."""
    ends = np.concatenate(([0], np.cumsum(table.sizes[ids])))
    good = np.diff(ends[bounds]) == np.diff(offsets)
    tokens, letters = np.repeat(good, np.diff(bounds)), np.repeat(good, np.diff(offsets))
    wrong = np.flatnonzero(table.joined(ids[tokens]) != data[letters])
    if len(wrong):
        place = np.flatnonzero(letters)[wrong]
        good[np.searchsorted(offsets, place, side="right") - 1] = False
    return good


def coalesce(start_a: np.ndarray, start_b: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each token of A and of B, and the linked places of A and of B, of two tilings of 0 to `end`."""
    start = np.concatenate((start_a, start_b))
    ends = np.concatenate((start_a[1:], [end], start_b[1:], [end]))
    of_b = np.repeat([False, True], [len(start_a), len(start_b)])
    order = np.argsort(start, kind="stable")  # two sorted runs are merged; of equal starts A comes first
    start, of_b = start[order], of_b[order]
    reached = np.maximum.accumulate(ends[order])
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = start[1:] >= reached[:-1]
    group = np.cumsum(opens) - 1
    seen_b = np.cumsum(of_b)
    last = np.ones(len(start), dtype=bool)
    last[:-1] = start[1:] != start[:-1]
    place_a, place_b = (np.arange(1, len(start) + 1) - seen_b)[last] - 1, seen_b[last] - 1
    return group[~of_b], group[of_b], place_a, place_b


@cache
def _id_texts(size: int) -> list[str]:
    return [f"{n}{mark}" for mark in ",|;" for n in range(size)]


def _group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, cuts: np.ndarray, size: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document; `cuts` are the groups where documents begin (one more at the end)."""
    n = int(cuts[-1])
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + before_b[group_a]] = a
    out[np.arange(len(b)) + (before_a + in_a)[group_b]] = b
    heads = before_a + before_b
    out[heads + in_a - 1] += size
    out[heads + in_a + in_b - 1] += 2 * size
    texts = _id_texts(size)
    bounds = np.append(heads, len(out))[cuts].tolist()
    every = out.tolist()
    return ["".join(map(texts.__getitem__, every[x:y]))[:-1] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _aligned(texts: pa.Array, path_a: str, path_b: str) -> dict[str, object]:
    """Numbers and digest of every text, and the linked pairs of the block."""
    rows = len(texts)
    a, at_a = encode_texts(texts, path_a, lead=" ", plain=True)
    b, at_b = encode_texts(texts, path_b)
    a, b = a.astype(np.int64), b.astype(np.int64)
    data, offsets = utf8(texts)
    spaced = np.insert(data, offsets[:-1], 0x20)
    offsets = offsets + np.arange(rows + 1)
    table_a, table_b = byte_level_bytes(path_a), sentence_piece_bytes(path_b)
    good = (np.diff(offsets) > 1) & _restored(a, at_a, table_a, spaced, offsets) & _restored(b, at_b, table_b, spaced, offsets)
    n_a, n_b = np.where(good, np.diff(at_a), 0), np.where(good, np.diff(at_b), 0)
    a, b = a[np.repeat(good, np.diff(at_a))], b[np.repeat(good, np.diff(at_b))]
    out: dict[str, object] = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(rows, np.int64), "n_links": np.zeros(rows, np.int64)}
    out["digest"] = [""] * rows
    out["pairs"] = out["pair_docs"] = np.empty(0, np.int64)
    out["holds"], out["pair"], out["times"] = np.zeros(rows, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32)
    if not len(a):
        return out
    size_a = table_a.sizes[a]
    end = int(size_a.sum())
    start_b = np.cumsum(table_b.sizes[b])
    group_a, group_b, place_a, place_b = coalesce(np.cumsum(size_a) - size_a, start_b - table_b.sizes[b], end)
    first = (np.cumsum(n_a) - n_a)[good]
    cuts = np.append(group_a[first], group_a[-1] + 1)
    out["n_groups"][good] = np.diff(cuts)
    size = max(len(table_a.sizes), len(table_b.sizes))
    own = (hashlib.sha256(text.encode()).hexdigest() for text in _group_texts(a, b, group_a, group_b, cuts, size))
    out["digest"] = [next(own) if g else "" for g in good.tolist()]
    doc = np.repeat(np.arange(rows), n_a)[place_a]
    out["n_links"] = np.bincount(doc, minlength=rows)
    pairs, which = np.unique((a[place_a] << 32) | b[place_b], return_inverse=True)
    held, times = np.unique(doc * len(pairs) + which, return_counts=True)
    out["pairs"], out["pair_docs"] = pairs, np.bincount(held % len(pairs), minlength=len(pairs))
    out["holds"] = np.bincount(held // len(pairs), minlength=rows)
    out["pair"], out["times"] = (held % len(pairs)).astype("<u4"), times.astype("<u4")
    return out


def _filled(texts: pa.Array) -> pa.Array:
    return (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_string())


def _merged(parts: list[dict[str, np.ndarray]]) -> dict[str, pa.Array]:
    """The distinct pairs of a block, and the pairs of its documents as places among them."""
    every = np.concatenate([own["pairs"] for own in parts])
    pairs, place = np.unique(every, return_inverse=True)
    docs = np.bincount(place, np.concatenate([own["pair_docs"] for own in parts]), len(pairs)).astype(np.int64)
    bounds = np.cumsum([0, *[len(own["pairs"]) for own in parts]])
    held = [place[low : low + len(own["pairs"])][own["pair"]] for low, own in zip(bounds.tolist(), parts, strict=False)]
    return {
        "pairs": pa.array([pairs], pa.list_(pa.int64())),
        "pair_docs": pa.array([docs], pa.list_(pa.int64())),
        "pair": pa.array([np.concatenate(held).astype("<u4").tobytes()], pa.binary()),
        "times": pa.array([np.concatenate([own["times"] for own in parts]).tobytes()], pa.binary()),
    }


def _blocks(docs: DataFrame, keep: list[str], text: str, path_a: str, path_b: str) -> DataFrame:
    """One row for each block of texts."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("body"))
    kept = rows.schema["kept"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            # aligned by the megabyte, as arrays of tokens are much larger than texts
            for block in byte_slices(batch, "body", BLOCK):
                parts, docs = [], []
                for cut in byte_slices(block, "body"):
                    got = _aligned(_filled(cut.column("body")), path_a, path_b)
                    fields = [cut.column("kept"), *[pa.array(got.pop(n), pa.int64()) for n in (*_NUMBERS, "holds")], pa.array(got.pop("digest"), pa.string())]
                    docs.append(pa.StructArray.from_arrays(fields, ["kept", *_NUMBERS, "holds", "digest"]))
                    parts.append(got)
                row = {"block": pa.array([(part << 32) | number], pa.int64()), **_merged(parts)}
                row["docs"] = pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), pa.concat_arrays(docs))
                number += 1
                yield pa.RecordBatch.from_pydict({name: row[name] for name in ("block", "docs", "pairs", "pair_docs", "pair", "times")})

    fields = ", ".join(f"{n}: bigint" for n in (*_NUMBERS, "holds"))
    schema = f"block bigint, docs array<struct<kept: {kept}, {fields}, digest: string>>, pairs array<bigint>, pair_docs array<bigint>, pair binary, times binary"
    return rows.mapInArrow(align, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair of ids, and whether no other pair of its A id has more."""
    each = blocks.select(F.inline(F.arrays_zip("pairs", "pair_docs"))).toDF("pair", "docs")
    counts = each.groupBy("pair").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most as many rows as B has ids
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def aligned(docs: DataFrame, keep: list[str], path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The columns `keep` of every document with the numbers of its tokens, groups and links.

    `n_best` counts the links whose pair is in as many documents as any pair of
    the same A id, `count_sum` adds up the documents of the pairs of all links,
    `groups_sha256` digests the groups as text.
    """
    blocks = stored(_blocks(docs, keep, text, path_a, path_b), "token-alignment")
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = asked.join(pair_counts(blocks), "pair").select(F.col("block").alias("of_block"), "place", "n", "best")
    numbers = ", ".join(f"{n} bigint" for n in (*_NUMBERS, "n_best", "count_sum"))
    kept = blocks.schema["docs"].dataType.elementType["kept"].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place] = right.column("n").to_numpy()
        best[place] = right.column("best").to_numpy()
        parts = []
        for k in range(left.num_rows):
            own = left.column("docs")[k].values
            pair = np.frombuffer(left.column("pair")[k].as_py(), "<u4")
            times = np.frombuffer(left.column("times")[k].as_py(), "<u4").astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(own.field("holds").to_numpy())))
            sums = [np.concatenate(([0], np.cumsum(times * table[pair])))[ends] for table in (best, n)]
            columns = [own.field("kept"), *[own.field(c) for c in _NUMBERS], *[pa.array(np.diff(s), pa.int64()) for s in sums], own.field("digest")]
            parts.append(pa.Table.from_arrays(columns, names=["kept", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(parts)

    sides = blocks.select("block", "docs", "pair", "times").groupBy("block").cogroup(known.groupBy("of_block"))
    done = sides.applyInArrow(finish, f"kept {kept}, {numbers}, groups_sha256 string")
    return done.select("kept.*", *_NUMBERS, "n_best", "count_sum", "groups_sha256")
