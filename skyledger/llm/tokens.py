"""Exact token ids of whole texts from pieces that are encoded once.

A text is cut where no token can reach across, so the ids of a text are the ids
of its pieces in order. Natural text repeats its pieces: texts are cut as Arrow
arrays, each task encodes the distinct pieces of a batch with the tokenizer
library and remembers them for the next batches. The memory has two generations
of a fixed number of entries, the older one is dropped when the newer is full;
it only saves work, as a piece that is not in it is encoded again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skyledger.llm.text import give_back

ENTRIES = 300_000
# bytes of text that are encoded at a time
ENCODED = 1 << 22
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class _Generation:
    """Pieces with their ids, one after another."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.chars += sum(map(len, pieces))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, ids))

    def find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))

    def own(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of entries."""
        low = self.at[numbers]
        sizes = self.at[numbers + 1] - low
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return sizes, self.ids[np.repeat(low - ends[:-1], sizes) + np.arange(ends[-1])]


class Pieces:
    """Ids of pieces, looked up by batch. `encode` gives the ids of a list of pieces.

    With `tail`, a comma or full stop after a letter is a token of its own, so a
    new piece that ends so is made from the piece before it. `words` gives the
    sizes and ids of pieces that are letters, after a space if `spaced`, and is faster.
    """

    def __init__(self, encode: Callable, tail: bool, words: Callable | None = None, spaced: bool = False,
                 entries: int = ENTRIES):
        self.encode, self.tail, self.words, self.entries = encode, tail, words, entries
        self.whole = re.compile((" " if spaced else "") + _LETTERS_ONLY).fullmatch
        self.now, self.old = _Generation(), _Generation()

    def turn(self) -> None:
        """Drop the older generation if the newer is full. Entry numbers hold until the next call."""
        now = self.now
        if len(now.index) > self.entries or len(now.ids) > 8 * self.entries or now.chars > 32 * self.entries:
            self.now, self.old = _Generation(), now

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The entry of each of some distinct pieces; those missing are encoded first."""
        found = self.now.find(pieces)
        holes = np.flatnonzero(found < 0)
        if len(holes):
            missing = [pieces[i] for i in holes.tolist()]
            before = self.old.find(missing)
            known = before >= 0
            again = [p for p, k in zip(missing, known.tolist(), strict=True) if k]
            self.now.add(again, *self.old.own(before[known]))
            self._learn([p for p, k in zip(missing, known.tolist(), strict=True) if not k])
            found[holes] = self.now.find(missing)
        return found

    def _learn(self, new: list[str]) -> None:
        cut = [p for p in new if self.tail and p[-1:] in (",", ".") and p[-2:-1] in _LETTERS and len(p) > 1]
        if cut:
            tails = set(cut)
            stems = [p[:-1] for p in cut]
            new = [p for p in dict.fromkeys(chain(stems, (",", "."), new)) if p not in tails and p not in self.now.index]
        self._encode(new)
        if cut:
            now = self.now
            sizes, ids = now.own(now.find(stems))
            marks = np.array([now.ids[now.at[now.index[p]]] for p in (",", ".")], np.uint32)
            last = marks[np.fromiter((p[-1] == "." for p in cut), np.int64, len(cut))]
            now.add(cut, sizes + 1, np.insert(ids, np.cumsum(sizes), last))

    def _encode(self, pieces: list[str]) -> None:
        words = [p for p in pieces if self.whole(p)] if self.words else []
        if words:
            known = set(words)
            pieces = [p for p in pieces if p not in known]
            self.now.add(words, *self.words(words))
        ids = self.encode(pieces) if pieces else []
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.now.add(pieces, sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))


# letters only, one run for every pattern; without the letter whose lower case is two characters
_LETTERS_ONLY = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"
_CHUNK = 1000


def _joined(library, mark: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Sizes and ids of words that are encoded many at a time, as one text with a space between any two.

    `mark` is what the space or the end of a word is in a token: Ġ at the
    beginning of the first token of a word, or </w> at the end of its last one.
    """
    vocabulary = library.get_vocab()
    marked = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, number in vocabulary.items():
        marked[number] = token.startswith(mark) if mark == "Ġ" else token.endswith(mark)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" " + " ".join(map(str.lstrip, words[i : i + _CHUNK])) for i in range(0, len(words), _CHUNK)]
        parts = [np.array(e.ids, np.uint32) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(marked[ids])
        edges = np.append(ends, len(ids)) if mark == "Ġ" else np.concatenate(([0], ends + 1))
        if len(edges) != len(words) + 1 or edges[0] or edges[-1] != len(ids):
            raise ValueError("words were cut otherwise than expected")
        return np.diff(edges), ids

    return encode


_SPACES = r"\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# anything but single spaces and line feeds between two words
_BYTE_HARD = rf"\A[ \n]|[ \n][ \n]|[ \n]\z|[{_SPACES}]"
_BYTE_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_level_pieces(text: str) -> list[str]:
    """Pieces for byte-level BPE with the usual pattern: a single space between
    two other characters starts a piece of the pattern."""
    return _BYTE_CUT.split(text) if text else []


_PIECE_HARD = r"  |\A | \z|▁"
_PIECE_CUT = re.compile("(?<=[^ ▁])(?= +[^ ])")


def sentence_pieces(text: str) -> list[str]:
    """Pieces for a sentence-piece model whose pieces hold a space mark at their start only, or are runs of marks.

    The library puts a mark before what it encodes, so the space before a later piece is left off.
    """
    if not text:
        return []
    head, *rest = _PIECE_CUT.split(text)
    return [head, *[p[1:] for p in rest]]


@cache
def _library(path: str, plain: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = plain
        return library
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


_kept: dict[tuple[str, bool], Pieces] = {}


def pieces_of(path: str, plain: bool = False) -> Pieces:
    """The memory of a task's process for a vocabulary file."""
    if (path, plain) not in _kept:
        _kept[path, plain] = _pieces(path, plain)
    return _kept[path, plain]


def forget(path: str, plain: bool = False) -> None:
    """Drop the memory for a vocabulary file: several idle processes would hold theirs while others work."""
    _kept.pop((path, plain), None)
    give_back()


def _pieces(path: str, plain: bool) -> Pieces:
    library = _library(path, plain)
    if path.endswith(".json"):
        spaced = _keeps_space(path)
        words = _joined(library, "Ġ" if spaced else "</w>")
        return Pieces(lambda new: [e.ids for e in library.encode_batch_fast(new, add_special_tokens=False)], True, words, spaced)
    return Pieces(lambda new: library.encode(new, num_threads=1), tail=False)


@cache
def _keeps_space(path: str) -> bool:
    """Whether the tokens of a .json file keep white space: it has no normalizer."""
    import json

    with open(path) as f:
        return json.load(f)["normalizer"] is None


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between the spaces of all texts, and where each text begins."""
    parts = pc.split_pattern(texts, " ")
    bounds = parts.offsets.to_numpy()
    return parts.flatten(), bounds - bounds[0]


def _distinct(parts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct parts, which hold no space, and which of them each part is."""
    coded = parts.dictionary_encode()
    names, which = coded.dictionary, coded.indices.to_numpy()
    if not len(names):
        return [], which
    # one decoding of all is faster than one of each
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.string())), " ")
    return whole[0].as_py().split(" "), which


def _easy(texts: pa.Array, known: Pieces, spaced: bool, lead: str, feed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the pieces of texts that are words between single spaces.

    The first piece of a text is `lead` and its first word, the others are a
    space and a word where `spaced`. With `feed` a line feed is such a gap, too,
    and begins its piece.
    """
    parts, bounds = _split(pc.replace_substring(texts, "\n", " \n") if feed else texts)
    names, which = _distinct(parts)
    if not spaced and not lead:
        return known.numbers(names)[which], bounds
    firsts = bounds[:-1]
    heads, head_of = np.unique(which[firsts], return_inverse=True)
    own = [lead + names[i] for i in heads.tolist()]
    if spaced:
        # a name may stand at a head only; with a space before it, it is a piece like any other
        later = np.ones(len(which), dtype=bool)
        later[firsts] = False
        used = np.zeros(len(names), dtype=bool)
        used[which[later]] = True
        rest = [" " + names[i] if names[i][:1] != "\n" else names[i] for i in np.flatnonzero(used).tolist()]
    else:
        used = np.ones(len(names), dtype=bool)
        rest = names
    both = list(dict.fromkeys(chain(own, rest)))
    entry = dict(zip(both, known.numbers(both).tolist(), strict=True))
    table = np.zeros(len(names), np.int64)
    table[used] = [entry[p] for p in rest]
    out = table[which]
    out[firsts] = np.array([entry[p] for p in own], np.int64)[head_of]
    return out, bounds


def _numbers(texts: pa.Array, path: str, lead: str, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the pieces of all texts, and where each text begins (one more at the end)."""
    known = pieces_of(path, plain)
    known.turn()
    if not path.endswith(".model") and not _keeps_space(path):
        parts, bounds = _split(pc.replace_substring(texts, "\n", " "))
        full = pc.not_equal(parts, "")
        names, which = _distinct(parts.filter(full))
        ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        return known.numbers(names)[which], ends[bounds]
    model = path.endswith(".model")
    hard = pc.match_substring_regex(texts, _PIECE_HARD if model else _BYTE_HARD).to_numpy(zero_copy_only=False)
    if not hard.any():
        return _easy(texts, known, not model, lead, not model)
    cut = sentence_pieces if model else byte_level_pieces
    slow = [cut(lead + text) for text in texts.filter(pa.array(hard)).to_pylist()]
    distinct = list(dict.fromkeys(chain.from_iterable(slow)))
    easy = texts.filter(pa.array(~hard))
    fast, at = _easy(easy, known, not model, lead, not model)
    entry = dict(zip(distinct, known.numbers(distinct).tolist(), strict=True))
    sizes = np.zeros(len(texts), np.int64)
    sizes[hard] = [len(own) for own in slow]
    sizes[~hard] = np.diff(at)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(bounds[-1], np.int64)
    from_slow = np.repeat(hard, sizes)
    out[from_slow] = [entry[p] for own in slow for p in own]
    out[~from_slow] = fast
    return out, bounds


def _column(texts: list[str] | pa.Array) -> pa.Array:
    """Texts as one Arrow array; NULL counts as empty."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    return column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())


def encode_texts(texts: list[str] | pa.Array, path: str, lead: str = "", plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each begins (one more at the end).

    `lead` (nothing or a space) is put before every text; with `plain`, the
    strings of special tokens inside texts are ordinary text.
    """
    numbers, bounds = _numbers(_column(texts), path, lead, plain)
    sizes, ids = pieces_of(path, plain).now.own(numbers)
    return ids, np.concatenate(([0], np.cumsum(sizes)))[bounds]


def count_texts(texts: list[str] | pa.Array, path: str) -> np.ndarray:
    """Number of tokens of each text."""
    numbers, bounds = _numbers(_column(texts), path, "", False)
    ends = np.concatenate(([0], np.cumsum(np.diff(pieces_of(path).now.at)[numbers])))
    return np.diff(ends[bounds])
