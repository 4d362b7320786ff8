"""Secret scans with a recursive decoding worklist.

The base patterns run over the whole text. Then encoded stretches are put on a
worklist: percent and Unicode escapes of a whole layer at once, base64 (also in its URL alphabet) and,
inside decoded or unescaped bytes, gzip, zlib and bzip2. Each decoded layer is scanned by the
same patterns and searched for encoded stretches again, until nothing new is
found. A layer seen before in the same stretch ends its branch, so cycles stop;
every layer is shorter than what it came from, but for compressed ones, which
are read part by part, so memory does not follow what they unfold to. A secret of a layer gets the place in the
original text: escapes map character by character, so it gets just the escaped
stretch; base64 maps to the groups of four that hold it, and a compressed layer
to the rest of its stretch. Base64 is decoded in its four alignments, over line
breaks too (the first line has 16 characters or more), and bytes are read as
Latin-1 and UTF-16, so what surrounds a secret does not matter. Texts without any encoded stretch cost a few byte searches.

Spans are in code points, ends exclusive; kinds are assign, access and hex.

Defined results: NULL and empty texts have no spans; equal spans of a kind count
once; repeated rows are
scanned each; kept columns named like a result column give way to it.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skyledger.llm.text import byte_slices, utf8

KINDS = ("assign", "access", "hex")
# Compressed content is read in parts of this many bytes, each with the end of the one before.
CHUNK = 1 << 24
TAIL = 4096
STEP = 1 << 16
# The base patterns.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LEAST = {"assign": 12, "access": 18, "hex": 16}
_HEX = re.compile(rf"[0-9a-f]{{{_LEAST['hex']},}}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
# Lines of wrapped base64 are one stretch.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
# Where compressed streams may begin.
_HEADER = re.compile(rb"\x1f\x8b\x08|\x78(?=[\x01\x5e\x9c\xda])|BZh[1-9]")
# What decoded bytes need for a secret or a further layer.
_SEED = re.compile(rb"[A-Za-z0-9+/_-]{16}|AKIA|%[0-9A-Fa-f]{2}|\\[uxU]|&#|\0|(?i:passw|secret|token|api_?key)|" + _HEADER.pattern)
# Escapes of bytes, the plain characters between them, and stretches of both.
_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|[\x21-\x7e]")
_BYTES = re.compile(r"[\x21-\x7e]+")

_HEX_BYTE = np.isin(np.arange(256), list(b"0123456789abcdef"))
_ALPHABET = bytes.maketrans(b"-_", b"+/")
_BASE64_BYTE = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))

# A layer: its text, and for each of its characters where it begins and ends in the original, and whether the last step decoded it.
Layer = tuple[str, np.ndarray, np.ndarray, np.ndarray]
Span = tuple[int, int, str]


def base_spans(text: str) -> Iterator[Span]:
    """Matches of the base patterns that are long enough."""
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= _LEAST["assign"]:
                yield m.start(), m.end(), "assign"
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= _LEAST["access"]:
                yield m.start(), m.end(), "access"
    for m in _HEX.finditer(text):
        yield m.start(), m.end(), "hex"


def _unescaped(text: str, low: np.ndarray, high: np.ndarray) -> Iterator[Layer]:
    """A layer with one level of its escapes replaced."""
    out: list[str] = []
    bounds: list[tuple[int, int, int]] = []  # where decoded characters begin and end in the layer, and their place
    done = at = 0

    def put(char: str, a: int, b: int) -> None:
        nonlocal done
        out.append(char)
        bounds.append((a, b, done))
        done += 1

    for m in _ESCAPE.finditer(text):
        out.append(text[at : m.start()])
        done += m.start() - at
        at = m.end()
        if m[1]:
            raw, i = bytes.fromhex(m[1].replace("%", "")), m.start()
            while raw:  # one character of UTF-8 after another, each with its own escapes
                n = next((n for n in range(1, 5) if _is_utf8(raw[:n])), 1)
                put(raw[:n].decode("utf-8", "replace"), i, i + 3 * n)
                raw, i = raw[n:], i + 3 * n
        else:
            code = int(m[5]) if m[5] else int(m[2] or m[3] or m[4] or m[6], 16)
            put(chr(code) if code < 0x110000 else "�", m.start(), m.end())
    if not bounds:
        return
    out.append(text[at:])
    begins, ends, places = np.array(bounds).T
    # each plain character is as far from its place in the layer as the decoded ones before it have taken
    shift = np.zeros(done + len(text) - at, np.int64)
    np.add.at(shift, places, ends - begins - 1)
    source = np.arange(len(shift)) + np.cumsum(shift)
    fresh = np.zeros(len(shift), dtype=bool)
    fresh[places] = True
    source[places] = begins
    until = source + 1
    until[places] = ends
    yield "".join(out), low[source], high[until - 1], fresh


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _engine(head: bytes):
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if head[:2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"):  # not "x "
        return zlib.decompressobj()
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else None


def _unfolded(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of compressed bytes, through compressed content and all members too, in chunks of at most CHUNK; what follows them as it is."""
    head = next(chunks, b"")
    while len(head) < 3 and (more := next(chunks, b"")):
        head += more
    if _engine(head) is None:
        yield head
        yield from chunks
        return
    rest: list[bytes] = []

    def inside() -> Iterator[bytes]:
        head_now: bytes = head
        while (engine := _engine(head_now)) is not None:
            left, got = b"", False
            for chunk in chain([head_now], chunks):
                while (chunk or not getattr(engine, "needs_input", True)) and not engine.eof:
                    try:
                        out = engine.decompress(chunk, CHUNK)
                    except (zlib.error, OSError):  # damaged: what came before it stands, or it is plain
                        if not got:
                            rest.append(head_now)
                        return
                    chunk = getattr(engine, "unconsumed_tail", b"")
                    if out:
                        got = True
                        yield out
                    elif not chunk:
                        break
                if engine.eof:
                    left = engine.unused_data.lstrip(b"\0")
                    break
            while len(left) < 3 and (more := next(chunks, b"")):
                left = (left + more).lstrip(b"\0")
            head_now = left
        rest.append(head_now)

    yield from _unfolded(inside())
    yield from rest
    yield from chunks


def _members(raw: memoryview, used: list[int]) -> Iterator[bytes]:
    """The content of compressed members from the first byte on; `used` gets the bytes of those that ended well. A damaged one gives what it can."""
    at = 0
    while (engine := _engine(bytes(raw[at : at + 3]))) is not None:
        until, chunk = at, b""
        while not engine.eof:
            if not chunk and getattr(engine, "needs_input", True):
                chunk = bytes(raw[until : until + STEP])
                until += len(chunk)
                if not chunk:
                    return
            try:
                out = engine.decompress(chunk, CHUNK)
            except (zlib.error, OSError):
                return
            chunk = getattr(engine, "unconsumed_tail", b"")
            if out:
                yield out
        at = until - len(engine.unused_data)
        while at < len(raw) and not raw[at]:
            at += 1
        used[0] = at


def _texts(chunks: Iterator[bytes]) -> Iterator[str]:
    """Text of compressed content in parts cut at white space; each begins with the last TAIL characters of the one before."""
    held = b""
    for chunk in _unfolded(chunks):
        held += chunk
        cut = max(held.rfind(b" "), held.rfind(b"\n"))
        if len(held) >= CHUNK and cut > TAIL:
            yield from (text for text, _, _ in _readings(held[:cut]))
            held = held[cut - TAIL :]
    yield from (text for text, _, _ in _readings(held))


def _readings(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Bytes as Latin-1, and as both phases of UTF-16 if there is a NUL, with the first byte and bytes a character.

    The patterns are ASCII, so Latin-1 shows all that UTF-8 does, whatever bytes surround it.
    """
    yield raw.decode("latin-1"), 0, 1
    if b"\0" in raw:
        for phase in (0, 1):
            units = np.frombuffer(raw[phase:] + b"\0" * ((len(raw) - phase) % 2), dtype="<u2")
            yield np.where(units < 256, units, 0xFFFD).astype("<u2").tobytes().decode("utf-16-le"), phase, 2


def _streams(raw: bytes) -> Iterator[tuple[int, str]]:
    """The content of each compressed stream that begins anywhere in the bytes, and where.

    A header that no stream follows gives nothing, as the bytes are read plainly too; the search goes on behind whole streams.
    """
    view, at = memoryview(raw), 0
    while m := _HEADER.search(raw, at):
        used = [1]
        for text in _texts(_members(view[m.start() :], used)):
            if text:
                yield m.start(), text
        at = m.start() + used[0]


def _from_bytes(raw: bytes, low: np.ndarray, high: np.ndarray) -> Iterator[Layer]:
    """The layers in bytes whose places in the original are given."""
    for text, first, width in _readings(raw):
        at = first + width * np.arange(len(text))
        yield text, low[at], high[np.minimum(at + width, len(raw)) - 1], np.ones(len(text), dtype=bool)
    yield from _compressed(raw, low, high)


def _compressed(raw: bytes, low: np.ndarray, high: np.ndarray) -> Iterator[Layer]:
    for at, text in _streams(raw):
        yield text, np.full(len(text), low[at]), np.full(len(text), high[-1]), np.ones(len(text), dtype=bool)


def _decoded(stretch: str, low: np.ndarray, high: np.ndarray) -> Iterator[Layer]:
    """What a base64 stretch holds from any of its characters on: the four alignments show all of them."""
    body = stretch.encode("ascii").translate(_ALPHABET, b"\r\n\t ")
    inside = None
    for first in range(4):
        part = body[first:]
        if len(part) % 4 == 1:
            part = part[:-1]
        raw = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
        if not _SEED.search(raw):
            continue
        if inside is None:
            inside = np.flatnonzero(_BASE64_BYTE[np.frombuffer(stretch.encode("ascii"), dtype=np.uint8)])
        group = first + np.arange(len(raw)) // 3 * 4
        yield from _from_bytes(raw, low[inside[group]], high[inside[np.minimum(group + 3, len(body) - 1)]])


def _escaped_bytes(text: str, low: np.ndarray, high: np.ndarray) -> Iterator[Layer]:
    """Compressed content and UTF-16 in bytes written as escapes, among plain characters or not."""
    done = 0
    while escape := _ESCAPE.search(text, done):
        begin, end = escape.start(), _BYTES.match(text, escape.start()).end()
        while begin > done and "\x21" <= text[begin - 1] <= "\x7e":
            begin -= 1
        done = end
        raw, places = bytearray(), []
        for m in _BYTE.finditer(text, begin, end):
            digits = next(filter(None, m.groups()[:4]), None)
            code = int(digits, 16) if digits else int(m[5]) if m[5] else ord(m[0])
            if code < 256:
                raw.append(code)
                places.append((m.start(), m.end()))
        if not raw:
            continue
        begins, ends = np.array(places).T
        if 0 in raw:
            yield from list(_from_bytes(bytes(raw), low[begins], high[ends - 1]))[1:]
        else:
            yield from _compressed(bytes(raw), low[begins], high[ends - 1])


def _layers(layer: str, low: np.ndarray, high: np.ndarray, fresh: np.ndarray) -> Iterator[Layer]:
    """What a layer decodes to; stretches without a fresh character have been decoded with the layer before."""
    if "%" in layer or "\\" in layer or "&#" in layer:
        yield from _unescaped(layer, low, high)
        yield from _escaped_bytes(layer, low, high)
    for m in _BASE64.finditer(layer):
        if fresh[m.start() : m.end()].any():
            yield from _decoded(m[0], low[m.start() : m.end()], high[m.start() : m.end()])


def decoded_spans(text: str) -> set[Span]:
    """Secrets that decoding shows, at their places in the text."""
    found: set[Span] = set()
    at = np.arange(len(text))
    work: list[tuple[Layer, frozenset[bytes]]] = [((text, at, at + 1, np.ones(len(text), dtype=bool)), frozenset())]
    while work:
        outer, seen = work.pop()
        for layer, low, high, fresh in _layers(*outer):
            mark = hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest()
            if mark in seen:
                continue
            found.update((int(low[a]), int(high[b - 1]), kind) for a, b, kind in base_spans(layer) if fresh[a:b].any())
            work.append(((layer, low, high, fresh), seen | {mark}))
    return found


def _ordered(spans: set[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """Which texts have a run of at least `least` bytes of the table."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    long = starts[ends - starts >= least]
    # a run over a border of texts counts for both: that only costs a scan
    hit = np.zeros(len(offsets) - 1, dtype=bool)
    for at, end in zip(long.tolist(), ends[ends - starts >= least].tolist(), strict=True):
        first = np.searchsorted(offsets, at, side="right") - 1
        hit[first : np.searchsorted(offsets, end, side="left")] = True
    return hit


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with the counts of base spans, base_spans and all spans, each spelled kind:start:end."""
    result = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_spans": "string", "spans": "string"}
    names = [c for c in keep if c not in result]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                data, offsets = utf8(part.column(text))
                runs = _runs(data, offsets, _HEX_BYTE, _LEAST["hex"]) | _runs(data, offsets, _BASE64_BYTE, 16)
                columns: dict[str, list] = {c: [] for c in result}
                for k, raw in enumerate(pc.fill_null(part.column(text), "").to_pylist()):
                    small = raw.lower() if ":" in raw or "=" in raw else ""
                    base: list[Span] = []
                    more: set[Span] = set()
                    if runs[k] or "AKIA" in raw or any(name in small for name in _NAMES):
                        base = _ordered(set(base_spans(raw)))
                    if runs[k] or "%" in raw or "\\" in raw or "&#" in raw:
                        more = decoded_spans(raw)
                    for kind in KINDS:
                        columns[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                    columns["base_spans"].append(_spelled(base))
                    columns["spans"].append(_spelled(_ordered(more.union(base))) if more else columns["base_spans"][-1])
                kinds = {"bigint": pa.int64(), "string": pa.string()}
                arrays = [pa.array(v, kinds[result[c]]) for c, v in columns.items()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *arrays], names=[*names, *result])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{c} {t}" for c, t in result.items()])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(scan, schema)
