"""Token-id files in ascending document order, compressed by a static range asymmetric numeral system.

A part is one range of document ids, written by one task. It holds segments: a
frequency table shared by the blocks of the segment, then independent blocks of
whole documents. A block holds the index of its documents, checkpoints (state of
all lanes, place, checksum of the ids up to the next one) and the words, and ends
with its own checksum, so blocks and spans between checkpoints decode in parallel
and damage is found where it is. Segments are binary values of a Parquet table:
Spark's commit makes each part appear once even if executors are lost, on any
file system. A document longer than a block is a block of its own.

    segment  b"RANS" u16 version u16 scale  u32 symbols u32 bytes, zlib(symbol deltas u32, frequencies u32)  u32 blocks
    block    u64 bytes, u32 documents u32 lanes u64 tokens u32 every u32 checkpoints u64 words,
             ids i64, valid u8, lengths u64, places u64, checksums u32, states u64, words u32, crc32 u32
    little-endian throughout

Defined results: NULL text is an empty document, which is its end id alone;
rows are ordered by id, NULL first, and rows of one id by a hash of their text;
repeated rows are written each; an empty table gives no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm import ans
from skyledger.llm.text import byte_slices
from skyledger.llm.tokens import ENCODED, encode_texts

END = 1
BLOCK = 1 << 20
SEGMENT = 1 << 22
LANES = 1024
EVERY = 512
_HEAD = struct.Struct("<4sHHII")
_BLOCK = struct.Struct("<IIQIIQ")
_MAGIC = b"RANS"


def _block(ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, slot_of: np.ndarray, freq: np.ndarray) -> bytes:
    lanes = max(1, min(LANES, len(tokens) // 64))
    words, states, places = ans.encode(slot_of[tokens], freq, lanes, EVERY)
    span = EVERY * lanes
    sums = [zlib.crc32(tokens[a : a + span].astype("<u4").data) for a in range(0, len(tokens), span)]
    body = b"".join(
        [
            _BLOCK.pack(len(ids), lanes, len(tokens), EVERY, len(sums), len(words)),
            ids.astype("<i8").tobytes(),
            valid.astype("u1").tobytes(),
            lengths.astype("<u8").tobytes(),
            places.astype("<u8").tobytes(),
            np.array(sums, dtype="<u4").tobytes(),
            states.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def encode_segment(ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """One shared table and the blocks of whole documents under it."""
    counts = np.bincount(tokens)
    used = np.flatnonzero(counts)
    freq = ans.frequencies(counts[used])
    slot_of = np.zeros(len(counts), dtype=np.int64)
    slot_of[used] = np.arange(len(used))
    table = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    ends = np.cumsum(lengths)
    blocks, doc = [], 0
    while doc < len(ids):
        before = int(ends[doc - 1]) if doc else 0
        stop = max(doc + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
        block = _block(ids[doc:stop], valid[doc:stop], lengths[doc:stop], tokens[before : int(ends[stop - 1])], slot_of, freq)
        blocks.append(struct.pack("<Q", len(block)) + block)
        doc = stop
    return b"".join([_HEAD.pack(_MAGIC, 1, ans.SCALE, len(used), len(table)), table, struct.pack("<I", len(blocks)), *blocks])


def decode_segment(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, validity, lengths and tokens of each block; raises on any checksum that fails."""
    magic, version, scale, n, size = _HEAD.unpack_from(data)
    if (magic, version, scale) != (_MAGIC, 1, ans.SCALE):
        raise ValueError("no token segment of this version")
    at = _HEAD.size
    table = np.frombuffer(zlib.decompress(data[at : at + size]), dtype="<u4")
    used, freq = np.cumsum(table[:n]).astype(np.uint32), table[n:].astype(np.uint64)
    symbol = np.repeat(np.arange(n, dtype=np.uint16 if n < 1 << 16 else np.uint32), freq.astype(np.int64))
    at += size
    (blocks,) = struct.unpack_from("<I", data, at)
    at += 4
    for _ in range(blocks):
        (size,) = struct.unpack_from("<Q", data, at)
        body = memoryview(data)[at + 8 : at + 4 + size]
        if struct.unpack_from("<I", data, at + 4 + size)[0] != zlib.crc32(body):
            raise ValueError("a block is damaged")
        at += 8 + size
        docs, lanes, tokens, every, marks, n_words = _BLOCK.unpack_from(body)
        place = _BLOCK.size
        fields = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", marks), ("<u4", marks), ("<u8", marks * lanes), ("<u4", n_words)):
            fields.append(np.frombuffer(body, dtype=kind, count=count, offset=place))
            place += fields[-1].nbytes
        ids, valid, lengths, places, sums, states, words = fields
        out = np.empty(tokens, dtype="<u4")
        for mark in range(marks):  # each span stands alone
            low = mark * every * lanes
            span = min(every * lanes, tokens - low)
            state = states[mark * lanes : (mark + 1) * lanes]
            out[low : low + span] = used[ans.decode(words, state, int(places[mark]), span, freq, symbol)]
            if zlib.crc32(out[low : low + span].data) != sums[mark]:
                raise ValueError("ids between two checkpoints are damaged")
        yield ids, valid.astype(bool), lengths.astype(np.int64), out


def write_token_files(docs: DataFrame, target: str, path: str, id: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Encode every text by the vocabulary file `path`, append `end`, and write the parts to the folder `target`."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, written = TaskContext.get().partitionId(), 0, 0
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, written, waiting, size
            data = encode_segment(*map(np.concatenate, zip(*waiting, strict=True)))
            row = {"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "start": pa.array([written]), "n_tokens": pa.array([size]), "data": pa.array([data], pa.binary())}
            number, written, waiting, size = number + 1, written + size, [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for rows in byte_slices(batch, text, ENCODED):
                ids, bounds = encode_texts(rows.column(text), path)
                own = rows.column(id).cast(pa.int64())
                lengths = np.diff(bounds) + 1
                waiting.append((pc.fill_null(own, 0).to_numpy(), pc.is_valid(own).to_numpy(zero_copy_only=False), lengths, np.insert(ids, bounds[1:], end)))
                size += int(lengths.sum())
                if size >= SEGMENT:
                    yield flush()
        if waiting:
            yield flush()

    ordered = docs.select(id, text).withColumn("tie", F.xxhash64(text)).repartitionByRange(F.col(id).asc_nulls_first(), "tie")
    ordered = ordered.sortWithinPartitions(F.col(id).asc_nulls_first(), "tie").select(id, text)
    files = ordered.mapInArrow(write, "part int, segment int, start bigint, n_tokens bigint, data binary")
    files.write.mode("overwrite").option("compression", "none").parquet(target)


def read_token_files(spark: SparkSession, source: str, id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids_crc32, and on request its ids."""
    files = spark.read.schema("part int, segment int, start bigint, n_tokens bigint, data binary").parquet(source)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start = batch["start"][k].as_py()
                for ids, valid, lengths, tokens in decode_segment(batch["data"][k].as_py()):
                    ends = np.cumsum(lengths)
                    lows = ends - lengths
                    sums = [zlib.crc32(tokens[a:b].data) for a, b in zip(lows.tolist(), ends.tolist(), strict=True)]
                    columns = {
                        "part": pa.array(np.full(len(ids), batch["part"][k].as_py(), dtype=np.int32)),
                        id: pa.array(ids.astype(np.int64), mask=~valid),
                        "start": pa.array(lows + start),
                        "n_tokens": pa.array(lengths),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(tokens.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(columns)
                    start += int(lengths.sum())

    schema = f"part int, `{id}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    docs = files.select("part", "start", "data").mapInArrow(read, schema)
    return docs.join(parts, "part").select(id, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
