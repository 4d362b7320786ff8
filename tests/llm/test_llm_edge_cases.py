"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from skyledger.llm import decontaminate, line_dedup, minhash, packing, quality_model, quality_rules, secrets, substring_dedup, token_counts, token_files

LINE = "one two three four five six seven eight nine ten eleven twelve"
PROSE = ". ".join(f"the {a} and {b} of it" for a in ("red", "blue", "old", "far") for b in ("tree", "hill", "road", "lake"))
LONG = " ".join(f"word{n} the of and" for n in range(40_000))
ROWS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "   \n\t\n", None),
    (4, "x", "b"),
    (5, PROSE, "b"),
    (6, PROSE, "b"),
    (6, PROSE, "b"),
    (7, LONG, None),
    (8, LINE + "\n" + LINE, "c"),
    (None, PROSE, "c"),
    (None, None, None),
]
BYTES, SPLIT, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
CLASH = ["n_words", "kept", "hit_bytes", "line", "words", "doc", "places", "root", "quality_kept", "c0", "_text", "id", "n_sentences", "task", "group"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, LINE), (2, None), (None, "x"), (3, ""), (4, "x"), (1, LINE)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (4, 0, 0), (5, 1, 0), (None, 1, 1), (7, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


def plain(docs):
    return {
        "lines": line_dedup.repeated_lines(docs),
        "rules": quality_rules.judged(docs),
        "pack": packing.pack(docs, BYTES),
        "near": minhash.near_duplicates(docs),
        "spans": substring_dedup.without_repeated_spans(docs),
        "secrets": secrets.secret_spans(docs),
        "counts": token_counts.token_counts(docs, PIECES),
    }


def test_values(spark, docs, benchmark, tmp_path):
    rules = {(r.doc_id, r.n_words): r for r in quality_rules.judged(docs).collect()}
    assert rules[1, 0].base_failed and not rules[2, 0].kept and rules[7, 160_000].n_words == 160_000
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert near[1] == (0, 1, True) and near[4] == (1, 4, True) and near[6][1:] == (5, False) and near[None][1:] == (None, True)
    assert {(r.doc, tuple(r.places)) for r in line_dedup.repeated_lines(docs).collect()} == {(6, (0,)), (8, (1,))}
    counts = [(r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, PIECES).collect()]
    assert len(counts) == len(ROWS) and (1, 0) in counts and (2, 0) in counts
    hits = {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in decontaminate.benchmark_hits(docs, benchmark).collect()}
    assert hits[4] == (1, 1, ["4"]) and hits[8] == (24, 24, ["1"]) and hits[1] == (0, 0, [])
    spans = {r.doc_id: (r.text, r.n_sentences_cut) for r in substring_dedup.without_repeated_spans(docs).collect()}
    assert spans[6] == ("", 16) and spans[5] == (PROSE, 0) and spans[1] == (None, 0) and spans[None][1] == 0
    pieces = packing.pack(docs, BYTES).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == 1 and max(r.length for r in pieces if r.doc_id == 7) == 2048
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    target = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, target, SPLIT)
    files = token_files.read_token_files(spark, target, with_ids=True).collect()
    assert sorted(r.start for r in files)[0] == 0 and len(files) == len(ROWS)
    assert [r.doc_id for r in sorted(files, key=lambda r: r.start)] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert [r.ids for r in files if r.doc_id in (1, 2, 3)] == [[1]] * 3


def test_clashing_columns_stay(spark, docs, benchmark, labels):
    from pyspark.sql import functions as F

    wide = docs.withColumns({c: F.lit(7) for c in CLASH})
    for name, out in plain(wide).items():
        assert out.count() is not None, name
    for out in (
        decontaminate.without_hits(wide, benchmark),
        line_dedup.without_repeated_lines(wide),
        minhash.without_near_duplicates(wide),
        quality_model.without_junk(wide, labels),
    ):
        assert out.columns == wide.columns
        assert all(r[c] == 7 for r in out.collect() for c in CLASH)


def test_empty_tables(spark, docs, benchmark, labels, tmp_path):
    none = docs.limit(0)
    for name, out in plain(none).items():
        assert out.count() == 0, name
    assert decontaminate.benchmark_hits(none, benchmark).count() == 0
    assert decontaminate.benchmark_hits(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert quality_model.scored(none, labels.limit(0)).count() == 0
    assert quality_model.scored(docs, None).count() == len(ROWS)
    target = f"file://{tmp_path}/none"
    token_files.write_token_files(none, target, SPLIT)
    assert token_files.read_token_files(spark, target).count() == 0


def test_stages(spark, docs, benchmark, labels, tmp_path):
    sf = f"file://{tmp_path}"
    benchmark.write.parquet(f"{sf}/benchmark.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= table.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    after = {n: {r.doc_id: r.text for r in f(spark, docs, sf).collect()} for n, f in corpus_pipeline.STAGES[:-1]}
    assert names == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    assert 5 in after["quality_classifier"] and not {1, 2, 3} & set(after["quality_classifier"])
    assert 6 not in after["line_dedup"] and after["line_dedup"][8] == LINE and after["line_dedup"][1] is None
    assert 6 not in after["minhash_near_dedup"] and 5 in after["minhash_near_dedup"]
    assert 4 not in after["benchmark_decontamination"] and after["benchmark_decontamination"][5] == PROSE
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)


def test_large_benchmark_is_scanned_in_parts(spark, docs, benchmark):
    whole = decontaminate.benchmark_hits(docs, benchmark, keep=["doc_id"]).collect()
    parts = decontaminate.benchmark_hits(docs, benchmark, keep=["doc_id"], limit=20).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))


def test_near_copies_in_many_blocks(spark, monkeypatch):
    """Groups larger than a block, whose members are linked by way of others only."""
    import random

    import brute

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1000)
    pick = random.Random(5)
    base = [f"w{n}" for n in range(60)]
    rows, text = [], list(base)
    for i in range(60):
        text = list(text) if i % 3 else list(base)
        for _ in range(pick.randint(1, 4)):
            text[pick.randrange(60)] = f"v{pick.randrange(10**6)}"
        rows.append((i * 7 % 60, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, words=4).collect()}
    assert got == brute.near_duplicates(rows, 4)


def test_patterns_place_every_piece():
    histogram = {2048: 7, 2047: 3, 1024: 5, 700: 11, 3: 1000, 1: 5000}
    used: dict[int, int] = {}
    for packs, content in packing.patterns(histogram):
        assert packs > 0 and sum(n * k for n, k in content) <= 2048
        for length, k in content:
            used[length] = used.get(length, 0) + packs * k
    assert used == histogram


def test_classifier_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    judged = quality_model.scored(docs, labels.where("doc_id % 3 != 0")).join(held, "doc_id")
    share = {
        kind: judged.where(kind).agg(F.avg(F.col("quality_kept").cast("int"))).first()[0] for kind in ("quality = 1 and toxic = 0", "quality = 0")
    }
    assert share["quality = 1 and toxic = 0"] > 0.97 and share["quality = 0"] < 0.25


def test_toxic_words_come_from_labels(spark):
    """Toxic words that no list in the code names, in two languages; a word may be toxic in one of them only."""
    import random

    from pyspark.sql import functions as F

    pick = random.Random(7)
    plain = [f"word{n}" for n in range(300)]
    bad = {"xx": ["grumf", "zolk", "plain7"], "yy": ["vrang", "hust", "plain8"]}
    rows = []
    for i in range(800):
        lang = "xx" if i % 2 else "yy"
        words = pick.choices(plain, k=80) + [w for w in ("plain7", "plain8") if w not in bad[lang]]
        if toxic := i % 8 < 2:
            words += pick.choices(bad[lang], k=5)
        pick.shuffle(words)
        rows.append((i, " ".join(words), lang, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = docs.where("doc_id % 16 < 8").select("doc_id", F.lit(1).alias("quality"), "toxic")
    judged = quality_model.scored(docs.drop("toxic"), labels).join(docs, "doc_id").where("doc_id % 16 >= 8")
    kept = {(r.lang, r.toxic): r.share for r in judged.groupBy("lang", "toxic").agg(F.avg(F.col("quality_kept").cast("int")).alias("share")).collect()}
    assert max(kept["xx", 1], kept["yy", 1]) < 0.1 and min(kept["xx", 0], kept["yy", 0]) > 0.9


def test_held_out_toxic_documents_per_language(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_model.scored(docs, labels.where("doc_id % 3 != 0"), keep=("doc_id", "lang")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    found = {r.lang: r.share for r in judged.where("toxic = 1").groupBy("lang").agg(F.avg(1 - F.col("quality_kept").cast("int")).alias("share")).collect()}
    assert found["en"] > 0.97 and min(found["de"], found["fr"]) > 0.8 and found["es"] > 0.5
    clean = judged.where("quality = 1 and toxic = 0").agg(F.avg(F.col("quality_kept").cast("int"))).first()[0]
    assert clean > 0.97


def test_passages_are_cut_at_any_offset(spark):
    """A passage of 51 words, without marks, with marks before symbols, and of Chinese, at all phases of its surroundings."""
    import random

    pick = random.Random(11)
    fresh = lambda n: " ".join(f"own{pick.randrange(10**9)}" for _ in range(n))
    words = [f"shared{n}" for n in range(51)]
    marked = " ".join(w + (".&&&" if n % 7 == 6 else "") for n, w in enumerate(words))
    chinese = "".join(chr(0x4E00 + pick.randrange(5000)) + ("。" if n % 9 == 8 else "") for n in range(60))
    for passage, least in ((" ".join(words), 20), (marked, 20), (chinese, 20)):
        rows = [(k, f"{fresh(k)} {passage} {fresh(30 - k)}") for k in range(30)]
        count = (lambda t: sum(c in chinese for c in t if c > "\u4e00")) if passage is chinese else (lambda t: t.count("shared"))
        out = {r.doc_id: r for r in substring_dedup.without_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out[0].text == rows[0][1]
        for k in range(1, 30):
            assert count(rows[k][1]) - count(out[k].text) >= least, (passage, k)
            assert all(w in out[k].text for w in rows[k][1].split() if w.startswith("own"))


@pytest.mark.parametrize(
    "secret",
    [
        r"\u0022password\u0022: \u0022abcdefgh12345678\u0022",
        "token%3D abcdefghijklmnop",
        "p%61ssword = abcdefgh12345678",
        "secret&#58; abcdefgh12345678",
        r"\x41\x4bIAA1B2C3D4E5F6G7H8",
    ],
)
def test_partly_escaped_secrets_with_spaces(secret):
    (span,) = secrets.decoded_spans(f"é x {secret} y %41 z")
    assert 4 <= span[0] < span[1] <= 4 + len(secret) and span[1] - span[0] > 12


def _forms():
    import base64
    import bz2
    import gzip
    import textwrap
    import urllib.parse
    import zlib

    body = 'x password = "abcdefgh12345678" y'
    raw, coded = body.encode(), base64.b64encode(body.encode()).decode()
    noise = " ".join(f"{n * 7919 % 1000}line" for n in range(60)).encode()
    packed = [gzip.compress(raw), zlib.compress(raw), bz2.compress(raw)]
    return {
        "path": f"https://x.io/{coded}",
        "names": f"a-b_c/{coded}",
        "wrapped": "\n".join(textwrap.wrap(base64.b64encode(noise[:70] + raw).decode(), 64)),
        "short_wrapped": "\n".join(textwrap.wrap(coded, 20)),
        "wrapped_gzip": "\r\n".join(textwrap.wrap(base64.b64encode(gzip.compress(noise + raw)).decode(), 76)),
        "utf_16": base64.b64encode(body.encode("utf-16")).decode(),
        "utf_16_be": base64.b64encode(body.encode("utf-16-be")).decode(),
        "nul": base64.b64encode(b"ab\0" + raw).decode(),
        "bom": base64.b64encode(b"\xef\xbb\xbf" + raw).decode(),
        "control": base64.b64encode(b"\x1b[0m" + raw + b"\xff").decode(),
        **{f"percent_{n}": urllib.parse.quote_from_bytes(x) for n, x in enumerate(packed)},
        **{f"hex_{n}": "".join(f"\\x{b:02x}" for b in x) for n, x in enumerate(packed)},
        "members": base64.b64encode(gzip.compress(b"first") + packed[0]).decode(),
        "bzip2_members": base64.b64encode(bz2.compress(b"first") + packed[2]).decode(),
        "mixed_members": base64.b64encode(gzip.compress(gzip.compress(b"first") + packed[2])).decode(),
    }


@pytest.mark.parametrize("form", list(_forms()))
def test_secrets_in_any_form(form):
    wrapped = _forms()[form]
    found = secrets.decoded_spans(f"é see {wrapped} end")
    assert {s[2] for s in found} == {"assign"} and all(6 <= a < b <= 6 + len(wrapped) for a, b, _ in found)


def test_short_lines_and_text_without_spaces(spark):
    ten = [f"w{n}" for n in range(10)]
    chinese = "".join(chr(0x4E00 + n) for n in range(12))
    rows = [
        (0, "Home\n" + " ".join(ten) + "\n" + chinese + "\n\n" + "a b c d e f g h"),
        (1, "Home\n" + " ".join(ten[:4] + ten[5:]) + "\n" + chinese[:5] + "\u6000" + chinese[6:] + "\n\n" + "a b c d e f g x"),  # nine words
        (2, "own\n" + chinese[::-1] + "\n" + chinese[:4] + "\nHome"),
        (3, chinese[:4]),
    ]
    got = {r.doc: list(r.places) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [0, 1, 2], 2: [3], 3: [0]}


def test_each_equal_line_goes_but_blank_ones(spark):
    import brute

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc: set(r.places) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {i: set(places) for i, places in brute.repeated_lines(rows).items()}


def test_lines_of_any_white_space_and_script(spark):
    """Words are told apart by every kind of white space, and by characters of scripts without spaces."""
    import brute

    words = [f"w{n}" for n in range(10)]
    rows = [
        (1, " ".join(words) + "\n\t\x0b \r\n漢字かな交じり文です\n"),
        (2, "\t".join(words) + "\nx\x0by\x0cz\n漢 字かな交じり文です"),
        (3, "\x0c".join([*words[:4], "other", *words[5:]]) + " \r\nx y z\r\n\u00a0\n漢字かな交じり文だす"),
        (4, "é " + "  ".join(words) + "\n\u00a0"),
    ]
    got = {r.doc: list(r.places) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeated_lines(rows)


def test_false_headers_give_no_layers():
    """Bytes that only look like the start of a compressed stream add nothing, so layers stay in proportion to the text."""
    import base64

    text = base64.b64encode(random.Random(4).randbytes(300_000)).decode()
    at = np.arange(len(text))
    layers = list(secrets._layers(text, at, at + 1, np.ones(len(text), dtype=bool)))
    assert sum(len(layer[0]) for layer in layers) < 10 * len(text)


def test_members_one_after_another_are_read_once():
    import base64
    import gzip

    members = [gzip.compress(b"password=%012d " % n) for n in range(300)]
    raw = b"".join(members)
    assert len(list(secrets._streams(raw))) == 1
    text = base64.b64encode(raw).decode()
    assert {(a, b) for a, b, kind in secrets.decoded_spans(text) if kind == "assign"} == {(0, len(text))}
