"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and the beginnings of its words, hashed into
buckets. A linear model adds up the weights of terms; the machine adds, for every
pair of terms that stand in one text, the product of their factors, so that an
insult together with a group that is mentioned weighs more than both alone. The
sum over all pairs costs one pass over the terms: half of the square of the sum
of factors less the sum of their squares.

Learning sees labelled documents that `learn` admits, at most `sample` of them,
half of each class as far as there are so many, chosen by a hash of their id. The
bound is that parameter: their ids are broadcast, so no text is moved, and their
terms reach the driver only for the `VOCABULARY` buckets that tell the classes
apart best by a chi-square over the sample. Rows are weighted to the share of the
classes among all labels admitted, with toxic ones `TOXIC_WEIGHT` times that. Scores cover all documents and whole texts, in
one pass without a shuffle. Nothing but the text is an input of a score.

Defined results: a NULL or empty text, or one without known terms, gets the
score of the bias alone; ids with labels that differ, are NULL or neither 0 nor 1
are not used; several documents of one id learn from its label each; without
labels of both classes every score is the share of toxic ones, 0 without labels;
an empty table gives no rows. Columns other than the id and the text of the
documents and the two of the labels are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.storage import stored
from skyledger.llm.text import ALPHANUMERIC, byte_slices, mix, utf8, word_hashes, word_spans

BUCKETS = 1 << 20
SAMPLE = 20_000
VOCABULARY = 4096
FACTORS = 8
STARTS = (4, 6, 8)
EPOCHS = 10
STEPS = 1500
BATCH = 64
RATE = 0.05
RIDGE = 1e-3
TOXIC_WEIGHT = 3.0
SEEN = 3


@dataclass(frozen=True)
class Machine:
    """`buckets` (sorted) are the known terms; weights and factors have a row for each."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of each text to be toxic."""
        doc, term = known_terms(column, self.buckets)
        rows = len(column)
        total = np.bincount(doc, self.weights[term], rows) + self.bias
        scale = _scale(np.bincount(doc, minlength=rows))
        for f in range(self.factors.shape[1]):
            own = self.factors[term, f]
            total += 0.5 * scale * (np.bincount(doc, own, rows) ** 2 - np.bincount(doc, own * own, rows))
        return _logistic(total)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def _scale(terms: np.ndarray) -> np.ndarray:
    """Pairs weigh by the terms a text has, so that long texts do not drown in them."""
    return 1.0 / np.maximum(terms, 1.0)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and beginning of a word; a word gives several."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets, ALPHANUMERIC)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    hashes = [word_hashes(data, starts, ends)]
    for size in STARTS:
        hashes.append(mix(word_hashes(data, starts, np.minimum(starts + size, ends)) ^ np.uint64(size)))
    buckets = (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.tile(doc, len(hashes)), buckets


def known_terms(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among the known buckets), once for each text and term, by text."""
    doc, bucket = terms(column)
    place = np.full(BUCKETS, -1, np.int64)
    place[known] = np.arange(len(known))
    term = place[bucket]
    held = term >= 0
    pairs = np.unique(doc[held] * max(len(known), 1) + term[held])
    return pairs // max(len(known), 1), pairs % max(len(known), 1)


def fit(at: np.ndarray, term: np.ndarray, toxic: np.ndarray, weight: np.ndarray, buckets: np.ndarray,
        factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 11) -> Machine:
    """Fit by adaptive gradient steps, at least `STEPS` of them; the terms of row i are `term[at[i]:at[i + 1]]`."""
    size, rng = len(buckets), np.random.default_rng(seed)
    share = float(np.clip(np.average(toxic, weights=weight), 1e-4, 1 - 1e-4))
    bias, weights = np.log(share / (1 - share)), np.zeros(size)
    table = rng.normal(0.0, 0.05, (size, factors))
    past_bias, past_weights, past_table = 1e-6, np.full(size, 1e-6), np.full((size, factors), 1e-6)
    sizes = np.diff(at)
    for _ in range(max(epochs, -(-STEPS * BATCH // max(len(toxic), 1)))):
        order = rng.permutation(len(toxic))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            x = np.zeros((len(rows), size))
            own = sizes[rows]
            x[np.repeat(np.arange(len(rows)), own), term[np.repeat(at[rows] - np.cumsum(own) + own, own) + np.arange(own.sum())]] = 1.0
            scale = _scale(x.sum(axis=1))[:, None]
            sums = x @ table
            pairs = 0.5 * scale[:, 0] * ((sums**2).sum(axis=1) - x @ (table**2).sum(axis=1))
            error = weight[rows] * (_logistic(bias + x @ weights + pairs) - toxic[rows]) / len(rows)
            step = error.sum()
            past_bias += step**2
            bias -= RATE * step / np.sqrt(past_bias)
            step = error @ x + RIDGE * weights
            past_weights += step**2
            weights -= RATE * step / np.sqrt(past_weights)
            pull = error[:, None] * scale
            step = x.T @ (pull * sums) - table * (x.T @ pull) + RIDGE * table
            past_table += step**2
            table -= RATE * step / np.sqrt(past_table)
    return Machine(buckets, float(bias), weights, table)


def given_labels(labels: DataFrame, id: str, label: str, learn: Column) -> DataFrame:
    """(id, toxic) for each id whose labels agree and that `learn` admits."""
    rows = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("toxic"))
    agreed = rows.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"), F.count_if(F.col("toxic").isNull()).alias("gaps"))
    used = (F.col("toxic") == F.col("most")) & F.col("toxic").isin(0, 1) & (F.col("gaps") == 0) & F.col("id").isNotNull()
    return agreed.where(used & learn).select("id", "toxic")


def train(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit a machine on labelled documents; `learn` is a condition on the column ``id``."""
    given = stored(given_labels(labels, id, label, learn), "toxicity-labels")
    totals = {row["toxic"]: row["n"] for row in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    nothing = np.empty(0, np.int64)
    if not 0 < share < 1:
        edge = -30.0 if share == 0 else 30.0
        return Machine(nothing, edge, np.empty(0), np.empty((0, FACTORS)))
    halves = [given.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for k in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))  # `sample` rows of two numbers at most
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("body")).join(chosen, "id").select("toxic", "body")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "body"):
                doc, bucket = terms(part.column("body"))
                pairs = np.unique(doc * BUCKETS + bucket)
                bounds = np.searchsorted(pairs, np.arange(len(part) + 1) * BUCKETS).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array((pairs % BUCKETS).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), lists], ["toxic", "buckets"])

    spelled = stored(rows.mapInArrow(spell, "toxic int, buckets array<int>"), "toxicity-terms")
    sizes = spelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {row["toxic"]: row["n"] for row in sizes}
    if len(n) < 2:
        return Machine(nothing, float(np.log(share / (1 - share))), np.empty(0), np.empty((0, FACTORS)))
    n_toxic, n_all = F.lit(float(n[1])), F.lit(float(n[0] + n[1]))
    seen = spelled.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("toxic").alias("hit"), F.count("*").alias("n"))
    off = F.col("hit") - F.col("n") * n_toxic / n_all
    strength = off * off / (F.col("n") * (n_all - F.col("n") + 1))
    best = seen.where(F.col("n") >= SEEN).orderBy(strength.desc(), "bucket").limit(VOCABULARY)
    buckets = np.sort(np.array([row["bucket"] for row in best.select("bucket").collect()], np.int64))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int16)
        place[buckets] = np.arange(len(buckets))
        for batch in batches:
            lists = batch.column("buckets")
            values, bounds = place[lists.flatten().to_numpy()], lists.offsets.to_numpy()
            held = values >= 0
            ends = np.concatenate(([0], np.cumsum(held)))[bounds - bounds[0]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values[held]))], ["toxic", "terms"])

    table = spelled.mapInArrow(narrow, "toxic int, terms array<smallint>").toArrow().combine_chunks()
    lists = table.column("terms").combine_chunks()
    at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    toxic = table.column("toxic").to_numpy().astype(np.float64)
    # the same rows in the same order, whatever the tasks
    term = lists.flatten().to_numpy().astype(np.int64)
    order = sorted(range(len(toxic)), key=lambda i: (toxic[i], term[at[i] : at[i + 1]].tobytes()))
    sizes = np.diff(at)[order]
    term = np.concatenate([term[at[i] : at[i + 1]] for i in order])
    at, toxic = np.concatenate(([0], np.cumsum(sizes))), toxic[order]
    weight = np.where(toxic == 1, TOXIC_WEIGHT * share * len(toxic) / n[1], (1 - share) * len(toxic) / n[0])
    return fit(at, term, toxic, weight, buckets)


def scored(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every document with its score from 0 to 1."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("body"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "body"):
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(machine.scores(part.column("body")))], ["kept", "score"])

    return rows.mapInArrow(score, f"kept {rows.schema['kept'].dataType.simpleString()}, score double").select("kept.*", "score")
