"""Plain versions of the operators, row by row."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np

from skyledger.llm.text import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    failed = n < 50 or 100 * len(repeat) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed


def near_duplicates(rows: list[tuple], k: int, percent: int = 80) -> dict:
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    inverted, common = defaultdict(list), Counter()
    for i, own in sets.items():
        for x in own:
            inverted[x].append(i)
    for ids in inverted.values():
        ids.sort()
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def decontaminated(rows: list[tuple], items: list[tuple], size: int = 10) -> dict:
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(size, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows[tuple(w[j : j + n])].add(str(item))
    out = {}
    for i, text in rows:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    found |= own
                    hit.update(range(j, j + n))
        names = ",".join(sorted(found))
        out[i] = (len(w), len(hit), len(found), sha256(names.encode()).hexdigest(), bool(hit))
    return out


_ALONE = re.compile("([\u0E00-\u0E7F\u3005-\u3007\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF])")


def one_edit(a: tuple, b: tuple) -> bool:
    """Whether one word replaced, added or left out makes the one the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def repeated_lines(rows: list[tuple], near: int = 10) -> dict:
    """Every line against every earlier different one."""
    lines = []
    for i, text in rows:
        for place, line in enumerate((text or "").split("\n")):
            if words := tuple(WORD.findall(_ALONE.sub(r" \1 ", line))):
                lines.append((i, place, words))
    lines.sort(key=lambda x: x[:2])
    first: dict[tuple, tuple] = {}
    for i, place, w in lines:
        first.setdefault(w, (i, place))
    sized = defaultdict(list)
    for w in first:
        sized[len(w)].append(w)
    edited = set()
    for w in first:
        earlier = (v for n in (len(w) - 1, len(w), len(w) + 1) if max(n, len(w)) >= near for v in sized[n])
        if any(first[v] < first[w] and one_edit(v, w) for v in earlier):
            edited.add(w)
    out = defaultdict(list)
    for i, place, w in lines:
        if w in edited or first[w] != (i, place):
            out[i].append(place)
    return dict(out)


_WIDE = "\u0E00-\u0E7F\u3005-\u3007\u3040-\u9FFF"
_SPAN_WORD = re.compile(f"[{_WIDE}]|[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\u3000-\u303F\uFF01\uFF0C\uFF0E\uFF1A\uFF1B\uFF1F\uFF61{_WIDE}]+")
_SPAN_END = re.compile("[.!?](?![A-Za-z0-9\\x80-\U0010FFFF])|[\\n。！？．｡]")


def sentences(text: str | None, piece: int = 10) -> list[tuple[str, ...]]:
    """Words between ends of sentences; sentences of more than `piece` words begin anew at words that have the
    least hash among some `piece` words in a row of the text, the first of equal ones."""
    text = lower(text)
    found = list(_SPAN_WORD.finditer(text))
    words = [m[0] for m in found]
    data = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
    hashes = word_hashes(np.frombuffer(data, np.uint8), ends - [len(w.encode()) for w in words], ends).tolist() if words else []
    least = {min(range(k, k + piece), key=lambda j: (hashes[j], j)) for k in range(len(words) - piece + 1)}
    marks = {m.start() for m in _SPAN_END.finditer(text)}
    out: list[list[int]] = []
    for k, m in enumerate(found):
        if not k or any(at in marks for at in range(found[k - 1].end(), m.start())):
            out.append([])
        out[-1].append(k)
    parts: list[tuple[str, ...]] = []
    for own in out:
        cuts = [0, *[n for n, k in enumerate(own) if n and len(own) > piece and k in least], len(own)]
        parts += [tuple(words[k] for k in own[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return parts


def cut_sentences(rows: list[tuple], least: int = 3, words: int = 20) -> dict:
    """By id: number of sentences and how many go."""
    first, spans, out = {}, defaultdict(list), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        own = sentences(text)
        out[i] = [len(own), set()]
        for a in range(len(own)):
            b = a + least
            while b <= len(own) and sum(map(len, own[a:b])) < words:
                b += 1
            if b <= len(own):
                spans[i].append((a, b, tuple(own[a:b])))
                first.setdefault(spans[i][-1][2], (i, a))
    for i, own in spans.items():
        for a, b, span in own:
            if first[span] != (i, a):
                out[i][1].update(range(a, b))
    return {i: (n, len(gone)) for i, (n, gone) in out.items()}


def crc32(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
