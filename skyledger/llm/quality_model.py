"""A quality classifier from weak labels: expectation-maximisation, then a hashed linear scorer.

Overlapping heuristic labellers vote good, junk or toxic on every document, or
abstain. Expectation-maximisation over the counts of vote patterns estimates how
often each labeller gives each vote on documents of each class; documents with a
given label keep it. The patterns are bounded by the labellers (VOTES to the
power of their number), not by the corpus, so their counts over all documents
reach the driver. The posteriors of the patterns label all documents for a
logistic scorer over hashed words and votes, which judges every document: each
hashed feature counts by its log-odds among good and other documents, where every
document of the corpus adds its posterior to the sums of its features.

The toxic labeller comes from the labels: the log-odds of each word, by language
where the documents name one, among all labelled documents. It votes on documents
with words that speak for toxic, and abstains on all others; its abstention is no
evidence of any class.

What is fitted on given labels sees a bounded sample of them, chosen by a hash of
the id: the toxic words come from at most `labelled` documents, the scale of the
log-odds from at most `sample` of them with `FEATURES` features in all. These bounds are
parameters; the ids are broadcast, so no text is moved. Votes, counts, posteriors,
sums of features and scores cover all documents and whole texts.

Defined results: a text without words, or NULL, is junk and not kept; labels of
unknown documents or with NULLs are not used; with no labels the labellers
decide alone, and toxic documents are not told apart; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.storage import stored
from skyledger.llm.text import ALPHANUMERIC, byte_slices, give_back, mix, utf8, window_hashes, word_hashes, word_spans

GOOD, JUNK, TOXIC, ABSTAIN = 0, 1, 2, 3
CLASSES, VOTES = 3, 4
BUCKETS = 1 << 20
SAMPLE = 10_000
LABELLED = 40_000
FEATURES = 8_000_000
UNITS = 1 << 16
ALL_WEIGHT = 20.0
GIVEN_WEIGHT = 20
ROUNDS = 60
EPOCHS = 100
RIDGE = 1.0
SHRINK = 20.0
START = 0.2
THRESHOLD = 0.35

# Words speak for toxic from these log-odds on, documents from this sum of them on.
STRONG, EVIDENCE = 1.2, 3.0

# Frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with"  # en
    " als auf das dem den der des die ein eine für ist mit nicht sich und von zu"  # de
    " avec dans de du elle en est et il la le les ne pas pour que qui sur un une"  # fr
    " al como con del el es lo los las no para por se su una y"  # es
).split()

# The classes each labeller tells apart; it votes on documents of others as on good ones.
LABELLERS: dict[str, tuple[int, ...]] = {
    "length": (GOOD, JUNK),
    "symbols": (GOOD, JUNK),
    "stop_words": (GOOD, JUNK),
    "repeats": (GOOD, JUNK),
    "upper_case": (GOOD, JUNK),
    "marks": (GOOD, JUNK),
    "toxic_words": (GOOD, TOXIC),
}
TOXIC_WORDS = list(LABELLERS).index("toxic_words")
# buckets of words, votes, and the constant
SIZE = BUCKETS + len(LABELLERS) * VOTES + 1


def _hash_of(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(words))
    return np.sort(word_hashes(data, *word_spans(data, offsets, ALPHANUMERIC)[:2]))


_STOP = _hash_of(STOP_WORDS)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(0x41, 0x5B)))
_MARK = np.isin(np.arange(256), list(b".!?"))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _vote(good: np.ndarray, bad: np.ndarray, kind: int = JUNK) -> np.ndarray:
    return np.where(bad, kind, np.where(good, GOOD, ABSTAIN)).astype(np.int8)


def _tongues(part: pa.RecordBatch, lang: str | None) -> np.ndarray:
    """A number for the language of each row."""
    if lang is None:
        return np.zeros(part.num_rows, np.uint64)
    coded = part.column(lang).cast(pa.string()).dictionary_encode()
    names = [zlib.crc32(str(x).encode()) for x in coded.dictionary.to_pylist()] + [0]
    return np.array(names, np.uint64)[coded.indices.fill_null(len(names) - 1).to_numpy()]


def _by_tongue(hashes: np.ndarray, tongue: np.uint64) -> np.ndarray:
    """Buckets of words of one language."""
    return (mix(hashes ^ mix(np.array([tongue]))) >> _SHIFT).astype(np.int64)


def votes_and_features(texts: pa.Array, tongues: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A row of votes for each text, and the distinct feature buckets of each: its words and its votes.

    `toxic` has what the words of each bucket by language speak for toxic.
    """
    data, offsets = utf8(texts)
    starts, ends, first = word_spans(data, offsets, ALPHANUMERIC)
    hashes = word_hashes(data, starts, ends)
    n = np.diff(first)
    each = np.maximum(n, 1)
    symbols = _sums(_SYMBOL[data], offsets) / each
    upper = _sums(_UPPER[data], offsets) / np.maximum(np.diff(offsets), 1)
    marks = _sums(_MARK[data], offsets) / each
    stops = _sums(np.isin(hashes, _STOP), first) / each
    own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    evidence = np.array([toxic[np.unique(_by_tongue(w, t))].sum() for w, t in zip(own, tongues, strict=True)])
    windows = window_hashes(hashes, 3)
    fresh = np.fromiter((len(np.unique(windows[a : max(a, b - 2)])) for a, b in zip(first[:-1], first[1:], strict=True)), np.int64, len(n))
    repeats = 1 - fresh / np.maximum(n - 2, 1)
    long = n >= 20
    votes = np.stack(
        [
            _vote(n >= 60, n == 0),
            _vote(symbols < 0.02, symbols > 0.3),
            _vote(stops >= 0.08, long & (stops < 0.02)),
            _vote(long & (repeats < 0.1), long & (repeats > 0.3)),
            _vote(long & (upper < 0.15), long & (upper > 0.4)),
            _vote(long & (marks > 0.02) & (marks < 0.4), long & (marks > 0.6)),
            _vote(np.zeros(len(n), dtype=bool), evidence >= EVIDENCE, TOXIC),
        ],
        axis=1,
    )
    named = np.arange(len(LABELLERS)) * VOTES + votes  # the last buckets are the votes
    features = [np.concatenate((np.unique(w >> _SHIFT).astype(np.int64), BUCKETS + v)) for w, v in zip(own, named, strict=True)]
    return votes, features


def _prior() -> np.ndarray:
    """[labeller, class, vote] before any document is seen: a labeller finds half of what it looks for, and seldom errs."""
    table = np.full((len(LABELLERS), CLASSES, VOTES), 0.003)
    table[:, :, GOOD], table[:, :, ABSTAIN] = 0.85, 0.15
    for k, known in enumerate(LABELLERS.values()):
        for c in set(known) - {GOOD}:
            table[k, c, c], table[k, c, GOOD] = 0.5, 0.4
    return table / table.sum(axis=2, keepdims=True)


def estimate(patterns: np.ndarray, given: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each class for each pattern, and [labeller, class, vote] chances.

    `given` is a class or -1. The prior counts as ten documents of each class.
    """
    prior, known = _prior(), list(LABELLERS.values())
    table, share = prior.copy(), np.array([0.8, 0.1, 0.1])
    fixed = given >= 0
    posterior = np.full((len(patterns), CLASSES), 1 / CLASSES)
    for _ in range(rounds):
        log = np.log(share) + sum(
            np.where((k == TOXIC_WORDS) & (patterns[:, k] == ABSTAIN)[:, None], 0.0, np.log(table[k, :, patterns[:, k]])) for k in range(patterns.shape[1])
        )
        posterior = np.exp(log - log.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        posterior[fixed] = np.eye(CLASSES)[given[fixed]]
        weight = posterior * (counts * np.where(fixed, GIVEN_WEIGHT, 1))[:, None]
        share = (weight.sum(axis=0) + 10) / (weight.sum() + 10 * CLASSES)
        for k in range(patterns.shape[1]):
            for vote in range(VOTES):
                table[k, :, vote] = weight[patterns[:, k] == vote].sum(axis=0)
            apart = [c not in known[k] for c in range(CLASSES)]
            table[k, apart] = table[k, GOOD] = table[k, GOOD] + table[k, apart].sum(axis=0)
            table[k] += 10 * prior[k]
            table[k] /= table[k].sum(axis=1, keepdims=True)
    return posterior, table


def _flat(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All features, the first of each document, and how many."""
    counts = np.fromiter(map(len, features), np.int64, len(features))
    return np.concatenate(features).astype(np.int32), np.cumsum(counts) - counts, counts


def chances(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Chance of each document to be good."""
    index, first, _ = _flat(features)
    return _logistic(np.add.reduceat(weights[index], first) + weights[-1])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(features: list[np.ndarray], target: np.ndarray, sums: np.ndarray, epochs: int = EPOCHS, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic model of the chance that a document is good; the last is the constant.

    Each feature counts by its shrunk log-odds among good and other documents, so
    rare ones start near nothing. Documents with a given label (`target`) count
    for one each; `sums` are the posteriors of all documents by feature (good,
    bad; last: all), and count together `ALL_WEIGHT` times as much as the
    labelled ones. Whole-batch Adam steps in a fixed order fit the scale to the labels, so
    the same rows give the same weights; without labels it stays as it starts.
    """
    index, first, counts = _flat(features) if features else (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
    share = ALL_WEIGHT * max(len(target), 1) / max(sums[:, -1].sum(), 1e-9)
    totals = [target.sum() + share * sums[0, -1], (1 - target).sum() + share * sums[1, -1]]
    part = totals[0] / max(sum(totals), 1e-9)
    odds = np.zeros(SIZE)
    for sign, k, kind, shrink in ((1, 0, target, SHRINK * part), (-1, 1, 1 - target, SHRINK * (1 - part))):
        seen = np.bincount(index, np.repeat(kind, counts), SIZE)[:SIZE] + share * sums[k]
        odds += sign * np.log((seen + shrink + 1e-9) / (totals[k] + shrink + 1e-9))
    odds[-1] = 0.0
    scale, bias = np.full(SIZE, START), 0.0
    if len(target):
        values = odds[index].astype(np.float32)
        speed, spread = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
        for step in range(1, epochs + 1):
            chance = _logistic(np.add.reduceat(scale.astype(np.float32)[index] * values, first) + bias)
            error = (chance - target) / len(target)
            slope = np.append(np.bincount(index, np.repeat(error.astype(np.float32), counts) * values, SIZE) + ridge / len(target) * (scale - START), error.sum())
            speed = 0.9 * speed + 0.1 * slope
            spread = 0.99 * spread + 0.01 * slope**2
            move = 0.02 * (speed / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
            scale -= move[:-1]
            bias -= move[-1]
    out = scale * odds
    out[-1] = bias
    return out


def _code(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (VOTES ** np.arange(votes.shape[1]))


def _votes(code: int) -> list[int]:
    return [code // VOTES**k % VOTES for k in range(len(LABELLERS))]


def _given(labels: DataFrame | None, votes: DataFrame, id: str) -> DataFrame:
    """Votes with the class that the labels give, or -1."""
    if labels is None:
        return votes.withColumn("given", F.lit(-1))
    known = _label_rows(labels, id)
    kind = F.when(F.col("quality") == 0, JUNK).when(F.col("toxic") == 1, TOXIC).otherwise(GOOD)
    return votes.join(known.select("id", kind.alias("given")), "id", "left").withColumn("given", F.coalesce("given", F.lit(-1)))


def _label_rows(labels: DataFrame, id: str) -> DataFrame:
    known = labels.where(f"`{id}` is not null and quality is not null and toxic is not null").groupBy(F.col(id).alias("id"))
    return known.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def log_odds(toxic: Column, clean: Column, all_toxic: Column, all_clean: Column) -> Column:
    """Shrunk log-odds of words that so many of all documents of a language have; 0 for words without evidence."""
    share = all_toxic / F.greatest(all_toxic + all_clean, F.lit(1))
    one, other = SHRINK * share + 1e-9, SHRINK * (1 - share) + 1e-9
    return F.log((toxic + one) / (all_toxic + one)) - F.log((clean + other) / (all_clean + other))


def toxic_words(docs: DataFrame, labels: DataFrame | None, id: str, text: str, lang: str | None, labelled: int = LABELLED) -> np.ndarray:
    """For each bucket of words by language, its log-odds for toxic among labelled documents if they are strong, else 0."""
    out = np.zeros(BUCKETS, np.float32)
    if labels is None:
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                tongues, toxic = _tongues(part, lang), part.column("toxic").to_numpy(zero_copy_only=False)
                data, offsets = utf8(part.column(text))
                starts, ends, first = word_spans(data, offsets, ALPHANUMERIC)
                hashes = word_hashes(data, starts, ends)
                for tongue in np.unique(tongues):
                    rows = np.flatnonzero(tongues == tongue)
                    # the bucket -1 counts the documents
                    found = [np.append(np.unique(_by_tongue(hashes[first[i] : first[i + 1]], tongue)), -1) for i in rows]
                    words, at = np.unique(np.concatenate(found), return_inverse=True)
                    bad = np.repeat(toxic[rows] == 1, list(map(len, found)))
                    sums = [np.bincount(at, which, len(words)).astype(np.int64) for which in (bad, ~bad)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), tongue, np.int64)), pa.array(words), *map(pa.array, sums)], names=["tongue", "word", "toxic", "clean"])

    names = [F.col(f"`{c}`") for c in dict.fromkeys([text, *([lang] if lang else [])])]
    # at most `labelled` rows of an id and a label
    given = _label_rows(labels, id).select(F.col("id").alias("_id"), "toxic").orderBy(F.xxhash64("_id"), "_id").limit(labelled)
    known = docs.select(F.col(f"`{id}`").alias("_id"), *names).join(F.broadcast(given), "_id").select(*names, "toxic")
    counts = known.mapInArrow(count, "tongue bigint, word bigint, toxic bigint, clean bigint").groupBy("tongue", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = stored(counts, "toxic-words")
    whole = counts.where("word = -1").select("tongue", F.col("toxic").alias("all_toxic"), F.col("clean").alias("all_clean"))  # a row for each language
    odds = log_odds(F.col("toxic"), F.col("clean"), F.col("all_toxic"), F.col("all_clean"))
    words = counts.where("word >= 0 and toxic > 1").join(whole, "tongue").withColumn("odds", odds).where(F.col("odds") >= STRONG)
    # at most BUCKETS rows, whatever the languages
    table = words.groupBy("word").agg(F.max("odds").alias("odds")).toArrow()
    out[table["word"].to_numpy()] = table["odds"].to_numpy().astype(np.float32)
    return out


def train(docs: DataFrame, labels: DataFrame | None, toxic: np.ndarray, id: str = "doc_id", text: str = "text", lang: str | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer."""
    kind = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(toxic)
    tongue = [lang] if lang else []

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(id), pa.array(_code(votes_and_features(part.column(text), _tongues(part, lang), shared.value)[0]))], names=["id", "pattern"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                features = pa.array(votes_and_features(part.column(text), _tongues(part, lang), shared.value)[1], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("pattern"), part.column("given"), features], names=["id", "pattern", "given", "features"])

    votes = stored(docs.select(*dict.fromkeys([id, text, *tongue])).mapInArrow(vote, f"id {kind}, pattern bigint"), "votes")
    votes = stored(_given(labels, votes, id), "votes")
    # at most VOTES ** len(LABELLERS) patterns for each given class
    rows = [tuple(r) for r in votes.groupBy("pattern", "given").count().collect()]
    # a pattern that only documents with labels have gets a posterior, too
    rows = sorted([*rows, *((p, -1, 0) for p in {r[0] for r in rows} - {r[0] for r in rows if r[1] < 0})])
    patterns, given = np.array([_votes(r[0]) for r in rows], dtype=np.int64).reshape(-1, len(LABELLERS)), np.array([r[1] for r in rows], dtype=np.int64)
    posterior, _ = estimate(patterns, given, np.array([r[2] for r in rows], dtype=np.float64))
    good = {(r[0], r[1]): p for r, p in zip(rows, posterior[:, GOOD].tolist(), strict=True)}
    units = {r[0]: round(good[r[0], -1] * UNITS) for r in rows if r[1] < 0}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE))
        for batch in batches:
            for part in byte_slices(batch, text):
                found, features = votes_and_features(part.column(text), _tongues(part, lang), shared.value)
                own = np.array([units[code] for code in _code(found).tolist()], np.float64)
                index, _, counts = _flat(features)
                for k, share in enumerate((own, UNITS - own)):
                    sums[k] += np.bincount(index, np.repeat(share, counts), SIZE)
                    sums[k, -1] += share.sum()  # the last counts documents
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(s[used].astype(np.int64)) for s in sums]], names=["feature", "good", "bad"])

    each = docs.select(*dict.fromkeys([text, *tongue])).mapInArrow(add, "feature bigint, good bigint, bad bigint")
    table = each.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # at most SIZE rows
    sums = np.zeros((2, SIZE))
    for k, name in enumerate(("good", "bad")):
        sums[k, table["feature"].to_numpy()] = table[name].to_numpy() / UNITS
    del table
    give_back()

    order = F.xxhash64("id")
    ids = votes.where("id is not null and given >= 0").groupBy("id").agg(F.min("pattern").alias("pattern"), F.min("given").alias("given"))
    chosen = F.broadcast(stored(ids.orderBy(order, "id").limit(sample), "sample"))  # `sample` rows
    texts = docs.select(F.col(id).alias("id"), *dict.fromkeys([text, *tongue])).join(chosen, "id").select("id", *dict.fromkeys([text, *tongue]), "pattern", "given")
    described = stored(texts.mapInArrow(describe, f"id {kind}, pattern bigint, given int, features array<bigint>").dropDuplicates(["id"]), "described")
    # of at most `sample` documents those whose features fit the bound
    sizes = described.select("id", F.size("features").alias("n")).withColumn("all", F.sum("n").over(Window.orderBy(order, "id")))
    table = described.join(F.broadcast(sizes.where(F.col("all") <= FEATURES).select("id")), "id").toArrow().sort_by("id")
    features = [np.asarray(x.values).astype(np.int32) for x in table["features"]]
    keys = zip(table["pattern"].to_pylist(), table["given"].to_pylist(), strict=True)
    target = np.array([good.get(k, 0.5) for k in keys])
    del table, keys
    give_back()
    return fit(features, target, sums)


def scored(
    docs: DataFrame,
    labels: DataFrame | None,
    id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
    lang: str | None = "lang",
) -> DataFrame:
    """Columns `keep` with quality_score, the chance that a document is good, and quality_kept.

    `lang` names the column of languages; without such a column all documents count as of one.
    """
    lang = lang if lang in docs.columns else None
    toxic = toxic_words(docs, labels, id, text, lang)
    weights = docs.sparkSession.sparkContext.broadcast((train(docs, labels, toxic, id, text, lang, sample).astype(np.float32), toxic))
    names = [c for c in keep if c not in ("quality_score", "quality_kept")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                scorer, known = weights.value
                votes, features = votes_and_features(part.column(text), _tongues(part, lang), known)
                chance = chances(scorer, features).astype(np.float64)
                kept = (chance >= threshold) & (votes[:, 0] != JUNK)  # the first labeller calls junk what has no words
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(chance), pa.array(kept)], names=[*names, "quality_score", "quality_kept"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["quality_score double", "quality_kept boolean"])
    return docs.select(*dict.fromkeys([*names, text, *([lang] if lang else [])])).mapInArrow(score, schema)


def without_junk(docs: DataFrame, labels: DataFrame | None, id: str = "doc_id", text: str = "text", lang: str | None = "lang", **options) -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    plain = {f"c{i}": c for i, c in enumerate(docs.columns)}  # no clash with the result columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in plain.items()])
    back = {c: k for k, c in plain.items()}
    labels = labels.withColumnRenamed(id, back[id]) if labels is not None else None
    kept = scored(renamed, labels, back[id], back[text], tuple(plain), lang=back.get(lang), **options).where("quality_kept")
    return kept.select(*[F.col(k).alias(c) for k, c in plain.items()])
