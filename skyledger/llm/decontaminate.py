"""Benchmark decontamination: a broadcast set of normalised test n-grams.

Words are runs of characters that are no ASCII punctuation, space or control
character, A-Z taken as a-z. A window is `size` consecutive words of a benchmark
item; an item of fewer words is one window. Each task hashes the windows of its
whole texts, looks them up in the broadcast set, and compares the words of every
hit, so a hash collision is no hit. Words of a document inside any occurrence of
a window are hit; `without_hits` removes those spans, or the document.

The set is broadcast only while the items of a pass hold at most `limit` bytes;
a larger benchmark is split into parts and documents are scanned once per part,
so what a task holds does not grow and no item is left out.

Defined results: a NULL or empty text has no words and no hits; items without
words match nothing; repeated documents get the same result each; items with
the same id count once; empty tables give no rows, or rows without hits.
Columns of the documents named like a result column are replaced by it.
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
from skyledger.llm.text import ALPHANUMERIC, LOWER, byte_slices, utf8, window_hashes, window_starts, word_hashes, word_spans

WINDOW = 10
# Bytes of benchmark text whose windows are broadcast in one pass.
LIMIT = 16 << 20
RESULT = {"n_words": "bigint", "n_hit": "bigint", "hit_items": "array<string>", "hit_bytes": "array<bigint>"}


@dataclass
class Windows:
    """Windows of some items: by size, sorted hashes and a bitmap in front of them; by hash, the words and their items."""

    hashes: dict[int, np.ndarray]
    seen: dict[int, np.ndarray]
    shift: int
    words: dict[tuple[int, int], list[tuple[bytes, set[str]]]]


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: int, size: int) -> bytes:
    return b" ".join(LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(word, word + size))


def windows_of(items: list[tuple[object, str]], size: int = WINDOW) -> Windows:
    """The windows of items given as (id, text)."""
    data, offsets = utf8(pa.array([text for _, text in items], pa.large_string()))
    starts, ends, first = word_spans(data, offsets, ALPHANUMERIC)
    hashes = word_hashes(data, starts, ends)
    words: dict[tuple[int, int], list[tuple[bytes, set[str]]]] = {}
    for k, (item, _) in enumerate(items):
        own = hashes[first[k] : first[k + 1]]
        length = min(size, len(own))
        if not length or item is None:
            continue
        for i, code in enumerate(window_hashes(own, length).tolist()):
            spelled = _spelled(data, starts, ends, int(first[k]) + i, length)
            bucket = words.setdefault((length, code), [])
            for known, ids in bucket:
                if known == spelled:
                    ids.add(str(item))
                    break
            else:
                bucket.append((spelled, {str(item)}))
    by_size = {
        length: np.array(sorted(c for n, c in words if n == length), dtype=np.uint64) for length in {n for n, _ in words}
    }
    bits = max(16, (16 * len(words)).bit_length())
    seen = {}
    for length, codes in by_size.items():
        seen[length] = np.zeros(1 << bits, dtype=bool)
        seen[length][codes >> np.uint64(64 - bits)] = True
    return Windows(by_size, seen, 64 - bits, words)


def _hits(data: np.ndarray, offsets: np.ndarray, known: Windows, rows: int):
    """Per text: number of words, merged (start, end) bytes of hit words, items."""
    starts, ends, first = word_spans(data, offsets, ALPHANUMERIC)
    hashes = word_hashes(data, starts, ends)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    items: list[set[str]] = [set() for _ in range(rows)]
    for length, codes in known.hashes.items():
        own = window_hashes(hashes, length)
        maybe = np.flatnonzero(known.seen[length][own >> np.uint64(known.shift)])
        if not len(maybe):
            continue
        at = np.minimum(np.searchsorted(codes, own[maybe]), len(codes) - 1)
        maybe = maybe[codes[at] == own[maybe]]
        row = np.searchsorted(first, maybe, side="right") - 1
        inside = maybe + length <= first[row + 1]
        for word, k in zip(maybe[inside].tolist(), row[inside].tolist(), strict=True):
            spelled = _spelled(data, starts, ends, word, length)
            for text, ids in known.words[length, int(own[word])]:
                if text == spelled:
                    items[k] |= ids
                    spans[k].append((int(starts[word] - offsets[k]), int(ends[word + length - 1] - offsets[k])))
    return starts, first, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scan(batches: Iterator[pa.RecordBatch], known, text: str, keep: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    windows: Windows = known.value
    for batch in batches:
        for part in byte_slices(batch, text):
            data, offsets = utf8(part.column(text))
            starts, first, spans, items = _hits(data, offsets, windows, part.num_rows)
            if "hit_bytes" in part.schema.names:  # found in an earlier pass
                for k, (flat, ids) in enumerate(zip(part["hit_bytes"].to_pylist(), part["hit_items"].to_pylist(), strict=True)):
                    spans[k] += list(zip(flat[::2], flat[1::2], strict=True))
                    items[k] |= set(ids)
            merged = [_merged(x) for x in spans]
            n_hit = np.zeros(part.num_rows, dtype=np.int64)
            for k, flat in enumerate(merged):
                if flat:
                    edges = np.searchsorted(starts[first[k] : first[k + 1]], np.array(flat) + offsets[k])
                    n_hit[k] = (edges[1::2] - edges[::2]).sum()
            result = [pa.array(np.diff(first)), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(merged, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [x.cast(schema.field(len(keep) + i).type) for i, x in enumerate(result)], schema=schema)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, limit: int = LIMIT, keep: list[str] | None = None
) -> DataFrame:
    """Columns `keep` of the documents (all by default) with the number of words and of hit words, the sorted ids of the
    items with an occurring window, and the byte ranges hit, as a flat list of starts and ends."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("words")).where("words is not null and item is not null")
    total = tests.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = -(-total // limit) or 1
    out = docs.drop(*RESULT)
    for part in range(parts):
        # at most about `limit` bytes: the parts are dealt by a hash of the item
        own = [tuple(r) for r in tests.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).collect()]
        known = spark.sparkContext.broadcast(windows_of(own, size))
        last = part == parts - 1
        names = keep if last else list(dict.fromkeys([*keep, text]))
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in names)] + [f"{c} {t}" for c, t in RESULT.items()])
        arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

        def scan(batches, known=known, names=names, arrow=arrow):
            return _scan(batches, known, text, names, arrow)

        needed = list(dict.fromkeys([*names, text, *([] if part == 0 else RESULT)]))
        out = out.select(*needed).mapInArrow(scan, schema)
        if not last:
            out = stored(out, "decontaminate")
    return out


def without_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """Documents without the benchmark words found in them; all columns stay.

    Hit spans are cut out of the text. A document of which more than
    `drop_share` of the words are hit goes as a whole; 0 drops every hit one.
    """
    columns = {f"c{i}": c for i, c in enumerate(docs.columns)}  # no clash with the result columns
    own = next(k for k, c in columns.items() if c == text)
    hits = benchmark_hits(docs.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()]), benchmark, text=own, **options)
    left = hits.where((F.col("n_hit") == 0) | (F.col("n_hit") <= F.col("n_words") * F.lit(drop_share)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(own), batch.column("hit_bytes")
            changed = np.flatnonzero(pc.list_value_length(ranges).to_numpy(zero_copy_only=False) > 0).tolist()
            if changed:
                new = texts.to_pylist()
                for k in changed:
                    raw, flat = new[k].encode(), ranges[k].as_py()
                    keep = zip([0, *flat[1::2]], [*flat[::2], len(raw)], strict=True)
                    new[k] = b"".join(raw[a:b] for a, b in keep).decode()
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == own else batch.column(k) for k in columns], names=list(columns))

    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in columns.items())
    return left.select(*columns, "hit_bytes").mapInArrow(cut, schema).select(*[F.col(k).alias(c) for k, c in columns.items()])
