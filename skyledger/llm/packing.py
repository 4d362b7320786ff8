"""Sequence packing by shortest-pack-first over the histogram of lengths.

Every document becomes its ids and an end id, cut into pieces of at most `size`.
Only the histogram of piece lengths, `size` counts at most, reaches the driver.
There lengths are placed longest first, each into the pack filled least, by
changing counts of packing patterns instead of packs: a length moves whole
patterns and splits a few, so their number follows the lengths, whatever the
corpus holds. Each pattern owns a range of ranks of every length in it. A piece
finds its place by its rank among the pieces of its length: its rank inside the
task that cut it, plus the number of such pieces in the tasks before. So a length
that a third of all pieces have is never gathered anywhere.

Defined results: a NULL or empty text is a document of its end id alone;
repeated rows are packed each; an empty table gives no pieces. The order of
documents in sequences follows no key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.storage import stored
from skyledger.llm.text import byte_slices
from skyledger.llm.tokens import ENCODED, encode_texts, forget

SIZE = 2048
END = 1


def cut_pieces(docs: DataFrame, path: str, id: str, text: str, size: int, end: int, with_ids: bool) -> DataFrame:
    """Pieces with their checksum, the task that cut them and their rank there among pieces of their length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for part in byte_slices(batch, text, ENCODED):
                ids, bounds = encode_texts(part.column(text), path)
                tokens = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end).astype("<u4")
                pieces = -(-tokens // size)
                row = np.repeat(np.arange(len(tokens)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(tokens[row] - start, size)
                low = (np.cumsum(tokens) - tokens)[row] + start
                crc = np.fromiter((zlib.crc32(ids[a : a + n].data) for a, n in zip(low.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                order = np.argsort(length, kind="stable")
                run = np.searchsorted(length[order], length[order])
                rank = np.empty(len(row), dtype=np.int64)
                rank[order] = np.arange(len(row)) - run + used[length[order]]
                used += np.bincount(length, minlength=size + 1)
                columns = {
                    id: part.column(id).take(pa.array(row)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc),
                    "doc_tokens": pa.array(tokens[row]),
                    "task": pa.array(np.full(len(row), task, dtype=np.int32)),
                    "task_rank": pa.array(rank),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)
        forget(path)

    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, task_rank bigint"
    return docs.select(id, text).mapInArrow(cut, schema + (", ids array<bigint>" if with_ids else ""))


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, how many of it)]) for all packs, longest lengths first."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(space: int, packs: int, content: list[tuple[int, int]]) -> None:
        if packs:
            room.setdefault(space, []).append((packs, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in room if s >= length), default=None)
            if space is None:
                fits = min(size // length, left)
                put(size - fits * length, left // fits, [(length, fits)])
                rest = left % fits
                put(size - rest * length, int(rest > 0), [(length, rest)])
                break
            packs, content = room[space].pop()
            if not room[space]:
                del room[space]
            # as many of this length as bring these packs level with the next in room, or as are left for each
            level = max((s for s in room if s < space), default=0)
            fits = max(1, min(space // length, -(-(space - level) // length), -(-left // packs)))
            taken = min(packs, left // fits)
            if taken == 0:
                fits, taken = left, 1
            put(space, packs - taken, content)
            put(space - fits * length, taken, [*content, (length, fits)])
            left -= taken * fits
    return [x for space in sorted(room) for x in room[space]]


def _places(histogram: dict[int, int], size: int) -> dict[int, np.ndarray]:
    """By length: rows of first rank, first sequence, how many a pack, offset of the first of them."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for packs, content in patterns(histogram, size):
        merged: dict[int, int] = {}
        for length, fits in content:
            merged[length] = merged.get(length, 0) + fits
        offset = 0
        for length, fits in merged.items():
            places.setdefault(length, []).append((used[length], sequence, fits, offset))
            used[length] += packs * fits
            offset += length * fits
        sequence += packs
    return {length: np.array(rows, dtype=np.int64) for length, rows in places.items()}


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place in the document, checksum of its ids, and place in a sequence."""
    pieces = stored(cut_pieces(docs, path, id, text, size, end, with_ids), "pieces")
    counts = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(_places(histogram, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(stored(bases, "bases"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    names = [id, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                own = np.flatnonzero(length == value)
                rows = places.value[int(value)]
                rows = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                inside = rank[own] - rows[:, 0]
                sequence[own] = rows[:, 1] + inside // rows[:, 2]
                offset[own] = rows[:, 3] + inside % rows[:, 2] * value
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "rank").mapInArrow(place, schema + ", sequence_id bigint, offset bigint")
