"""Near-duplicate documents by b-bit MinHash, each link confirmed on whole shingle sets.

1. One pass over whole texts gives each document its set size, a 128-bit hash of
   its set, 128 minima of which 4 low bits each are kept (64 bytes), and 32 band
   codes of 4 full minima each. At a similarity of 0.8 two sets share no band
   with probability 5e-8.
2. Documents with equal sets are one representative from here on.
3. In each band bucket every member is paired with the least one. Bit counts of
   the packed signatures estimate the similarity, corrected for chance collisions
   of 4 bits; pairs well below the bound (0.2, about five standard deviations) go.
   In a bucket whose members are not all tied together by these pairs, those
   outside its largest component are compared with all others by bit counts, in
   blocks, for what ties different components. Where they fill more than one
   block, the bucket is split by the codes of later bands first (at 0.8 two sets
   share fewer than three of 32 bands with probability 1.2e-5), so rows stay in
   proportion to its members. Documents that likely pairs tie together are a
   group: no pair outside a group is similar.
4. Only texts of groups are shuffled, once. The pairs of step 3 are confirmed on
   whole sets and swallow groups of near copies without pairing all members. In
   a group that is still in several components, the members outside its largest
   one are compared on whole sets with all others, block against block; a task
   returns one link for each two components it joins, so neither buckets nor
   groups are one task or become rows of all pairs. Blocks are bounded in rows
   and in bytes of text.

Defined results: a text of fewer words than a shingle is one shingle; without
words, or NULL, it has no set and is linked with nothing. Rows that share a
document id are one document. A NULL id is never linked and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.components import components
from skyledger.llm.storage import stored
from skyledger.llm.text import NOT_SPACE, byte_slices, mix, utf8, window_hashes, word_hashes, word_spans

LANES, BITS, ROWS = 128, 4, 4
BANDS = LANES // ROWS
PACKED = LANES * BITS // 64
MARGIN = 0.2
BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 23
DEPTH = 3
_LOW = 0x1111111111111111
_RANDOM = np.random.default_rng(20250118)
_A = _RANDOM.integers(0, 1 << 31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, LANES, dtype=np.uint32)
SIGNATURE = [f"sig{i}" for i in range(PACKED)]


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, hashed and sorted."""
    data, offsets = utf8(texts)
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    hashes = word_hashes(data, starts, ends)
    windows = window_hashes(hashes, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(windows[a : b - words + 1]))
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """LANES minima of each set, none of them empty."""
    first = np.cumsum([0, *map(len, sets[:-1])])
    low = mix(np.concatenate(sets) + np.uint64(1)).astype(np.uint32)
    out = np.empty((LANES, len(sets)), dtype=np.uint32)
    for i in range(LANES):
        out[i] = np.minimum.reduceat(low * _A[i] + _B[i], first)
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 to a 64-bit value."""
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(PACKED, 64 // BITS, -1)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)[None, :, None]
    return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64)


def _band_codes(minima: np.ndarray) -> np.ndarray:
    codes = np.empty((BANDS, minima.shape[1]), dtype=np.uint64)
    for band in range(BANDS):
        code = np.full(minima.shape[1], band, dtype=np.uint64)
        for row in minima[band * ROWS : (band + 1) * ROWS]:
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + row)
        codes[band] = code
    return codes.view(np.int64)


def signatures(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """`id`, set size, 128-bit set hash, packed signature and band codes of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                sets = shingle_sets(part.column(text), words)
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                n = part.num_rows
                hashes = np.zeros((2, n), dtype=np.uint64)
                packed = np.zeros((PACKED, n), dtype=np.int64)
                codes = np.empty((BANDS, 0), dtype=np.int64)
                if len(full):
                    some = [sets[k] for k in full]
                    first = np.cumsum([0, *map(len, some[:-1])])
                    every = np.concatenate(some)
                    hashes[0, full] = np.add.reduceat(mix(every), first)
                    hashes[1, full] = np.add.reduceat(mix(every ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                    minima = _minima(some)
                    packed[:, full] = _packed(minima)
                    codes = _band_codes(minima)
                bounds = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes.T.reshape(-1)))
                columns = [part.column(id), pa.array(sizes), *map(pa.array, hashes.view(np.int64)), *map(pa.array, packed), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "set_a", "set_b", *SIGNATURE, "bands"])

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, n_shingles bigint, set_a bigint, set_b bigint, {', '.join(f'{c} bigint' for c in SIGNATURE)}, bands array<bigint>"
    return docs.select(id, text).mapInArrow(sign, schema)


def _estimate(differing):
    """Similarity from the number of differing lanes: 4 bits agree by chance once in 16 times."""
    chance = 1 / (1 << BITS)
    return (1 - differing / LANES - chance) / (1 - chance)


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bit counts allow the similarity."""
    sides = [
        reps.select(F.col("id").alias(s), F.col("n_shingles").alias(f"{s}_n"), *[F.col(c).alias(f"{s}_{c}") for c in SIGNATURE]) for s in "ab"
    ]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    differing = F.lit(0)
    for c in SIGNATURE:
        x = F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(_LOW)))
    near = _estimate(differing) >= percent / 100 - MARGIN
    return both.where(near & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that hold on whole sets. The text of `a` goes once to each block of its partners, that of `b` to its pair."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    pairs = stored(pairs.join(stored(blocks, "blocks"), "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block")), "pairs")
    firsts = pairs.select("a", "block").distinct().join(texts.select(F.col("id").alias("a"), "text"), "a")
    others = pairs.join(texts.select(F.col("id").alias("b"), "text"), "b")
    kind = texts.schema["id"].dataType
    rows = firsts.select("a", "block", F.lit(None).cast(kind).alias("b"), "text").unionByName(others.select("a", "block", "b", "text"))
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole = None, np.empty(0, np.uint64)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                left, right, keep = part["a"].to_pylist(), part["b"].to_pylist(), []
                for k, own in enumerate(sets):
                    if right[k] is None:
                        key, whole = left[k], own
                        continue
                    if left[k] != key:
                        raise ValueError("a pair came without the text of its first document")
                    common = len(np.intersect1d(whole, own, assume_unique=True))
                    if 100 * common >= percent * (len(whole) + len(own) - common):
                        keep.append(k)
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    kind = kind.simpleString()
    return rows.select("a", "b", "text").mapInArrow(confirm, f"a {kind}, b {kind}")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of a partition sorted by it."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        change[0] = last is not None and any(v[0] != w for v, w in zip(values, last, strict=True))
        last = [v[-1] for v in values]
        cuts = np.flatnonzero(change).tolist()
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if low in cuts and rest:
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            if high > low:
                rest.append(batch.slice(low, high - low))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


class _Joined:
    """Components seen by one task; `join` tells whether two were apart."""

    def __init__(self, roots: list):
        codes: dict = {}
        self.own = np.array([codes.setdefault(r, len(codes)) for r in roots], dtype=np.int64)

    def join(self, i: int, j: int) -> bool:
        a, b = self.own[i], self.own[j]
        if a != b:
            self.own[self.own == b] = a
        return a != b


def _block_pairs(rows: DataFrame, key: str, blocks: Column, own: Column, firsts: Column) -> DataFrame:
    """Each row once for each pair of blocks it takes part in. Blocks from `firsts` on are not paired with each other."""
    rows = rows.withColumn("own", own.cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("own") < firsts, blocks).otherwise(firsts).cast("int") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")
    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of either block; both are all rows where a block meets itself."""
    own = table["own"].to_numpy()
    if table["low"][0] == table["high"][0]:
        return np.arange(len(own)), np.arange(len(own))
    first = own == table["low"][0].as_py()
    return np.flatnonzero(first), np.flatnonzero(~first)


def _apart(rows: DataFrame, key: str, firsts: Column, others: Column) -> DataFrame:
    """The rows outside the largest component of a key, in blocks, against all rows; the largest one is not paired with itself."""
    firsts, others = F.ceil(firsts).cast("int"), F.ceil(others).cast("int")
    own = F.when(F.col("root") == F.col("largest"), firsts + F.pmod(F.xxhash64("id"), others)).otherwise(F.pmod(F.xxhash64("id"), firsts))
    return _block_pairs(rows, key, firsts + others, own, firsts)


def _open(tied: DataFrame) -> DataFrame:
    """Members of the buckets that lie in several components, with the largest one, its size and the members in all."""
    parts = tied.groupBy("code", "root").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("code").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return tied.join(stored(sizes.where("most < all"), "buckets"), "code")


def _across(members: DataFrame, kind: str, percent: int) -> DataFrame:
    """Pairs of ids that tie different components of one bucket by their bit counts, one for each two components a task joins."""
    rows = _apart(members, "code", (F.col("all") - F.col("most")) / BLOCK_ROWS, F.col("most") / BLOCK_ROWS)
    rows = rows.select("code", "low", "high", "own", "id", "root", "n_shingles", *SIGNATURE)
    bound = percent / 100 - MARGIN

    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["code", "low", "high"]):
            left, right = _sides(table)
            sig = np.stack([table[c].to_numpy() for c in SIGNATURE], axis=1).view(np.uint64)
            n, joined, a, b = table["n_shingles"].to_numpy(), _Joined(table["root"].to_pylist()), [], []
            for i in left.tolist():
                apart = right[joined.own[right] != joined.own[i]]
                x = sig[apart] ^ sig[i]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                differing = np.bitwise_count(x & np.uint64(_LOW)).sum(axis=1)
                near = (_estimate(differing) >= bound) & (100 * np.minimum(n[apart], n[i]) >= percent * np.maximum(n[apart], n[i]))
                for j in apart[near].tolist():
                    if joined.join(i, j):
                        a.append(i)
                        b.append(j)
            ids = table["id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(ties, f"a {kind}, b {kind}").distinct()


def _within(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links on whole sets between the components of a group: all outside the largest against all others, in blocks."""
    parts = texts.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    size = F.struct("n", "root")
    groups = parts.groupBy("group").agg(
        F.max_by("root", size).alias("largest"),
        *[x.alias(c) for x, c in ((F.max("n"), "most"), (F.sum("n"), "all"), (F.max_by("bytes", size), "most_bytes"), (F.sum("bytes"), "all_bytes"))],
    )
    groups = stored(groups.where("most < all"), "groups")
    blocks = lambda n, size: F.greatest(n / BLOCK_ROWS, size / BLOCK_BYTES)
    firsts = blocks(F.col("all") - F.col("most"), F.col("all_bytes") - F.col("most_bytes"))
    rows = _apart(texts.join(groups, "group"), "group", firsts, blocks(F.col("most"), F.col("most_bytes")))
    rows = rows.select("group", "low", "high", "own", "id", "root", "text")
    kind = texts.schema["id"].dataType.simpleString()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["group", "low", "high"]):
            left, right = _sides(table)
            sets = [s for part in table.to_batches() for cut in byte_slices(part, "text") for s in shingle_sets(cut.column("text"), words)]
            sizes = np.array([len(x) for x in sets])
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
            own = np.split(codes, np.cumsum(sizes)[:-1])
            every = np.concatenate([own[j] for j in right]) if len(right) else codes[:0]
            first = np.concatenate(([0], np.cumsum(sizes[right])[:-1])).astype(np.int64)
            seen = np.zeros(codes.max(initial=0) + 1, dtype=np.uint8)
            joined, a, b = _Joined(table["root"].to_pylist()), [], []
            for i in left.tolist() if len(right) else []:
                if (joined.own[right] == joined.own[i]).all():
                    continue
                seen[own[i]] = 1
                common = np.add.reduceat(seen[every], first, dtype=np.int64)
                seen[own[i]] = 0
                for j in right[100 * common >= percent * (sizes[i] + sizes[right] - common)].tolist():
                    if joined.join(i, j):
                        a.append(i)
                        b.append(j)
            ids = table["id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(links, f"a {kind}, b {kind}")


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _members(coded: DataFrame, hub: Column) -> DataFrame:
    """The rows of codes that two ids or more have, with one of these as the hub."""
    hubs = coded.groupBy("code").agg(hub.alias("hub"), F.min("id").alias("least"), F.max("id").alias("most")).where("least != most")
    return stored(coded.join(stored(hubs.select("code", "hub"), "hubs"), "code"), "members")


def _stars(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of a bucket's hub with each other member."""
    stars = members.where("id != hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    return stored(_likely(stars, reps, percent), "likely")


def _ties(members: DataFrame, likely: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Components of the likely pairs and of what else ties components of one bucket."""
    kind = reps.schema["id"].dataType.simpleString()
    crowded = F.col("all") - F.col("most") > BLOCK_ROWS
    groups = components(likely)
    for depth in range(1, DEPTH + 1):
        # Buckets whose members lie in several components hold pairs not looked at yet.
        tied = stored(_labelled(members.select("code", "id", "band"), groups), "tied")
        open_ = stored(_open(tied), "open")
        ready = open_ if depth == DEPTH else open_.where(~crowded)
        across = stored(_across(ready.join(reps.select("id", "n_shingles", *SIGNATURE), "id"), kind, percent), "across")
        rest = open_.where(crowded).select("id", "code", F.col("band").alias("before"))
        if depth == DEPTH or rest.isEmpty():
            return groups if across.isEmpty() else components(across, known=groups)
        # A crowded bucket is split by the codes of each later band.
        codes = reps.select("id", F.posexplode("bands").alias("band", "next"))
        coded = rest.join(codes, "id").where("band > before").select("id", "band", F.xxhash64("code", "next").alias("code"))
        members = _members(stored(coded, "coded"), F.min_by("id", F.struct(F.xxhash64("id", "code"), "id")))
        groups = components(across.union(_stars(members, reps, percent)), known=groups)
    return groups


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: `id`, n_shingles, component_id (least id that links reach) and kept."""
    signed = stored(signatures(docs, id, text, words), "signatures")
    equal = ["set_a", "set_b"]
    sets = stored(signed.where("n_shingles > 0 and id is not null").groupBy(*equal).agg(F.min("id").alias("id")), "sets")
    reps = stored(signed.where("n_shingles > 0").join(sets, ["id", *equal], "left_semi").dropDuplicates(["id", *equal]), "reps")
    members = _members(reps.select("id", F.posexplode("bands").alias("band", "code")), F.min("id"))
    likely = _stars(members, reps, percent)
    groups = _ties(members, likely, reps, percent)
    grouped = groups.union(groups.select("root", "root").distinct()).select(F.col("node").alias("id"), F.col("root").alias("group"))

    # The one shuffle of texts; by sorting at every size, as the group list grows with the corpus.
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(stored(grouped, "grouped").hint("merge"), "id")
    texts = stored(texts, "texts")
    links = stored(_confirmed(likely, texts, words, percent), "confirmed")
    roots = components(links)
    roots = components(_within(stored(_labelled(texts, roots), "labelled"), words, percent), known=roots)

    rooted = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").select(*equal, F.coalesce("root", "id").alias("component_id"))
    out = signed.select("id", "n_shingles", *equal).join(stored(rooted, "roots"), equal, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have an earlier one in their component; all columns stay."""
    gone = near_duplicates(docs, id, text, words, percent).where(~F.col("kept"))
    gone = stored(gone.select(F.struct(F.col(id)).alias("_gone_")).distinct(), "gone")
    return docs.join(gone, F.struct(F.col(id)) == F.col("_gone_"), "left_anti")
