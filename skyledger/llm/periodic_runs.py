"""Periodic runs of words, found exactly by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), of at least `repeats` periods and `least` words, that no neighbouring
word extends keeping the period. Texts that loop, boilerplate that is pasted over
and over, and generated filler are such runs.

The words of a slice of texts become numbers, with a mark of its own between any
two texts. Recompression makes a run-length grammar of them, level by level: a
block step replaces every maximal block of one symbol by a symbol of (symbol,
times); a pair step divides the symbols into left and right ones and replaces
each left symbol followed by a right one. Both steps see only neighbours, so
equal stretches are parsed alike but for their ends. Hence the longest common
extension of two places is answered by one walk up the levels and one down, with
a bounded number of comparisons a level, and exactly: symbols are named by what
they stand for, not by hashes.

Places to ask about lie on the harmonic grid: a run of four periods q or more
holds four places in a row that are multiples of q, and their words are equal.
Such places are extended to both sides by grammar queries; a place inside a
stretch that is already known is not asked again.

Each text is read whole, by one Arrow function; the work is one pass without a
shuffle, and memory follows the slice of about a megabyte, or one longer text.

Defined results: a NULL or empty text has no words and no runs; repeated rows are
scanned each; rows with equal or NULL ids are told apart by being rows; an empty
table gives no rows; no column of the table clashes with the results, as only the
columns named in `keep` are carried along, under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.text import byte_slices

REPEATS = 4
LEAST = 6
ROUNDS = 4
HELD = 1 << 19
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Grammar:
    """Levels of a recompression of `symbols`; negative symbols are marks that are never combined.

    Level h has `symbols[h]`; the symbol k of level h + 1 stands for those of
    level h from `first[h][k]` to `first[h][k + 1]`, and `parent[h]` leads back.
    """

    def __init__(self, symbols: np.ndarray, seed: int = 17):
        self.symbols, self.first, self.parent = [symbols], [], []
        bits = np.random.default_rng(seed)
        new = int(symbols.max(initial=0)) + 1
        while True:
            now = self.symbols[-1]
            word = now >= 0
            if not np.any(word[1:] & word[:-1]):
                return
            same = now[1:] == now[:-1]
            if same.any():
                new = self._blocks(now, same, new)
            else:
                new = self._pairs(now, word, new, bits)

    def _level(self, first: np.ndarray, symbols: np.ndarray, size: int) -> None:
        marks = np.zeros(size, np.int64)
        marks[first] = 1
        self.parent.append(np.cumsum(marks) - 1)
        self.first.append(np.append(first, size))
        self.symbols.append(symbols)

    def _blocks(self, now: np.ndarray, same: np.ndarray, new: int) -> int:
        first = np.concatenate(([0], np.flatnonzero(~same) + 1))
        sizes = np.diff(np.append(first, len(now)))
        made = now[first].copy()
        long = np.flatnonzero(sizes > 1)
        names, which = _names(made[long], sizes[long])
        made[long] = new + which
        self._level(first, made, len(now))
        return new + names

    def _pairs(self, now: np.ndarray, word: np.ndarray, new: int, bits: np.random.Generator) -> int:
        used, which = np.unique(now, return_inverse=True)
        side = bits.integers(0, 2, len(used), dtype=np.int8)[which].astype(bool)
        both = word[:-1] & word[1:]
        there, back = both & ~side[:-1] & side[1:], both & side[:-1] & ~side[1:]
        joined = np.flatnonzero(there if there.sum() >= back.sum() else back)
        head = np.ones(len(now), dtype=bool)
        head[joined + 1] = False
        first = np.flatnonzero(head)
        names, which = _names(now[joined], now[joined + 1])
        whole = now.copy()
        whole[joined] = new + which
        self._level(first, whole[first], len(now))
        return new + names

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from the places i and j on; marks end it."""
        a, b = i.copy(), j.copy()
        stop = np.full(len(a), len(self.first))
        for h, (first, parent) in enumerate(zip(self.first, self.parent, strict=True)):
            live = np.flatnonzero(stop > h)
            if not len(live):
                break
            symbols, x, y = self.symbols[h], a[live], b[live]
            up, vp = parent[x], parent[y]
            ragged = np.flatnonzero((first[up] != x) | (first[vp] != y))
            if len(ragged):
                xr, yr = x[ragged], y[ragged]
                equal = symbols[xr] == symbols[yr]
                step = np.where(equal, np.minimum(first[up[ragged] + 1] - xr, first[vp[ragged] + 1] - yr), 0)
                xr, yr = xr + step, yr + step
                x[ragged], y[ragged] = xr, yr
                up[ragged], vp[ragged] = parent[xr], parent[yr]
                ends = ragged[~equal | (first[parent[xr]] != xr) | (first[parent[yr]] != yr)]
                stop[live[ends]] = h
            on = stop[live] > h
            a[live], b[live] = np.where(on, up, x), np.where(on, vp, y)
        for h in range(len(self.first) - 1, -1, -1):
            down = np.flatnonzero(stop > h)
            first, symbols = self.first[h], self.symbols[h]
            up, vp = a[down], b[down]
            x, y = first[up], first[vp]
            step = np.where(symbols[x] == symbols[y], np.minimum(first[up + 1] - x, first[vp + 1] - y), 0)
            # of two pairs with the same head only the head is common
            a[down], b[down] = x + self._common(h, x, y, step), y + self._common(h, x, y, step)
        return a - i

    def _common(self, h: int, x: np.ndarray, y: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Symbols of level h that two different symbols of the next level have in common at the front."""
        symbols = self.symbols[h]
        last = np.maximum(step - 1, 0)
        return np.where((step > 0) & (symbols[x + last] != symbols[y + last]), 1, step)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before the places i and j; marks end it."""
        a, b = i.copy(), j.copy()
        stop = np.full(len(a), len(self.first))
        for h, (first, parent) in enumerate(zip(self.first, self.parent, strict=True)):
            live = np.flatnonzero(stop > h)
            if not len(live):
                break
            symbols, x, y = self.symbols[h], a[live], b[live]
            ragged = np.flatnonzero((first[parent[x]] != x) | (first[parent[y]] != y))
            if len(ragged):
                xr, yr = x[ragged], y[ragged]
                equal = symbols[xr - 1] == symbols[yr - 1]
                step = np.where(equal, np.minimum(xr - first[parent[xr - 1]], yr - first[parent[yr - 1]]), 0)
                xr, yr = xr - step, yr - step
                x[ragged], y[ragged] = xr, yr
                ends = ragged[~equal | (first[parent[xr]] != xr) | (first[parent[yr]] != yr)]
                stop[live[ends]] = h
            on = stop[live] > h
            a[live], b[live] = np.where(on, parent[x], x), np.where(on, parent[y], y)
        for h in range(len(self.first) - 1, -1, -1):
            down = np.flatnonzero(stop > h)
            first, symbols = self.first[h], self.symbols[h]
            up, vp = a[down], b[down]
            x, y = first[up], first[vp]
            step = np.where(symbols[x - 1] == symbols[y - 1], np.minimum(x - first[up - 1], y - first[vp - 1]), 0)
            last = np.maximum(step, 1)
            step = np.where((step > 0) & (symbols[x - last] != symbols[y - last]), 1, step)
            a[down], b[down] = x - step, y - step
        return i - a


def _names(left: np.ndarray, right: np.ndarray) -> tuple[int, np.ndarray]:
    """Number the distinct pairs of two columns of values from 0 to 2**31."""
    keys, which = np.unique((left.astype(np.int64) << 32) | right.astype(np.int64), return_inverse=True)
    return len(keys), which


def text_words(text: str | None) -> list[bytes]:
    """What stands between spaces and the characters 9 to 13."""
    return (text or "").encode().split()


def word_numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, a mark before, between and after the texts, and the place of each text's first word."""
    known: dict[bytes, int] = {}
    fresh = count()
    parts, at, mark = [np.array([-1], np.int64)], [], -1
    place = 1
    for words in texts:
        parts.append(np.fromiter(map(known.setdefault, words, fresh), np.int64, len(words)))
        at.append(place)
        mark -= 1
        parts.append(np.array([mark], np.int64))
        place += len(words) + 1
    return np.concatenate(parts), np.array([*at, place], np.int64)


def find_runs(symbols: np.ndarray, longest: int, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run between marks, by start and period.

    `longest` is the number of words of the longest text.
    """
    grammar = None
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    places, periods, held = [], [], 0
    last = longest // repeats
    for q in range(1, last + 1):
        i = _candidates(symbols, q, repeats)
        if len(i):
            places.append(i)
            periods.append(np.full(len(i), q))
            held += len(i)
        if held and (held > HELD or q == last):
            grammar = grammar or Grammar(symbols)
            found.append(_extended(grammar, np.concatenate(places), np.concatenate(periods), repeats, least))
            places, periods, held = [], [], 0
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    start, end, p = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    # a multiple of the smallest period gives the same stretch
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[smallest], end[smallest], p[smallest]
    order = np.lexsort((p, start))
    return start[order], (end - start)[order], p[order]


def _candidates(symbols: np.ndarray, q: int, repeats: int) -> np.ndarray:
    """Multiples of q that begin `repeats` equal words q apart, as every run of period q holds one."""
    grid = symbols[::q]
    equal = grid[1:] == grid[:-1]
    places = len(equal) - (repeats - 2)
    if places <= 0:
        return np.empty(0, np.int64)
    chain = equal[:places].copy()
    for k in range(1, repeats - 1):
        chain &= equal[k : places + k]
    i = np.flatnonzero(chain) * q
    half = q // 2
    # a run repeats the words halfway to the next place as well
    return i[symbols[i + half] == symbols[i + half + q]]


def _extended(
    grammar: Grammar, i: np.ndarray, q: np.ndarray, repeats: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the stretches of period q around the places i, if long enough."""
    starts, ends, kept = [], [], []
    turn = 0
    while len(i):
        turn += 1
        # of neighbours on the grid the first is asked; after some rounds all that are left are
        ask = np.ones(len(i), dtype=bool)
        if turn <= ROUNDS:
            ask[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + q[1:])
        a, p = i[ask], q[ask]
        start, end = a - grammar.before(a, a + p), a + p + grammar.after(a, a + p)
        whole = end - start >= np.maximum(repeats * p, least)
        starts.append(start[whole])
        ends.append(end[whole])
        kept.append(p[whole])
        chain = np.cumsum(ask) - 1
        rest = ~ask & (i >= end[chain] - p[chain])
        i, q = i[rest], q[rest]
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(kept)


def _scan(texts: list[str | None], repeats: int, least: int) -> tuple[np.ndarray, pa.Array, list[str]]:
    words = [text_words(text) for text in texts]
    symbols, at = word_numbers(words)
    sizes = np.diff(at) - 1
    start, length, period = find_runs(symbols, int(sizes.max(initial=0)), repeats, least)
    owner = np.searchsorted(at, start, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([start - at[owner], length, period], ["start", "length", "period"])
    # a word goes if a run holds it after its first period
    depth = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    gone = np.cumsum(depth)[:-1] > 0
    collapsed = []
    for k, own in enumerate(words):
        if bounds[k] < bounds[k + 1]:
            own = [own[w] for w in np.flatnonzero(~gone[at[k] : at[k + 1] - 1]).tolist()]
        collapsed.append(b" ".join(own).decode())
    return sizes, pa.ListArray.from_arrays(pa.array(bounds), runs), collapsed


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """The columns `keep` of every row, with n_words, runs and the text with each run cut to its first period.

    `runs` has start (a word number), length and period, by start and period;
    `collapsed` joins the words that stay with single spaces.
    """
    if repeats < 3 or least < repeats:
        raise ValueError("runs have three periods and `repeats` words at least")
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("body"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "body"):
                sizes, runs, collapsed = _scan(part.column("body").to_pylist(), repeats, least)
                yield pa.RecordBatch.from_arrays(
                    [part.column("kept"), pa.array(sizes, pa.int64()), runs.cast(_RUN), pa.array(collapsed, pa.string())],
                    ["kept", "n_words", "runs", "collapsed"],
                )

    kept = rows.schema["kept"].dataType.simpleString()
    out = rows.mapInArrow(scan, f"kept {kept}, n_words bigint, runs {RUN}, collapsed string")
    return out.select("kept.*", "n_words", "runs", "collapsed")
