"""Periodic runs, token alignment and toxicity against plain versions, held-out labels and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm_edge_cases import ROWS
from tokenizers import Tokenizer

from skyledger.llm import periodic_runs, queries, token_alignment, toxicity
from skyledger.llm.storage import ship_code

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows(spark):
    ship_code(spark)
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# -- periodic runs ----------------------------------------------------------


def plain_runs(words: list, repeats: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing the words with themselves at every distance."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([number[w] for w in words], np.int64)
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(x) // repeats + 1):
        equal = np.concatenate(([False], x[q:] == x[:-q], [False]))
        turns = np.flatnonzero(equal[1:] != equal[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b + q - a >= max(least, repeats * q):
                out.setdefault((a, b + q - a), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def looped(doc_id, text) -> list[str]:
    words = [w.decode() for w in (text or "").encode().split()]
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text) -> tuple:
    words = looped(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_runs_of_whole_texts(spark, rows):
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect())
    want = sorted(expected(*r) for r in rows)
    assert got == want
    assert sum(w[1] > 0 for w in want) > 10


def test_runs_of_random_words():
    pick = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(pick.randint(1, 5)):
            letters = pick.randint(1, 4)
            words = [str(pick.randrange(letters)) for _ in range(pick.randint(0, 60))]
            for _ in range(pick.randint(0, 3)):
                unit = [str(pick.randrange(letters)) for _ in range(pick.randint(1, 6))]
                at = pick.randint(0, len(words))
                words[at:at] = unit * pick.randint(2, 9)
            texts.append(words)
        for repeats, least in ((4, 6), (3, 3)):
            _, runs, _ = periodic_runs._scan([" ".join(w) for w in texts], repeats, least)
            got = [[(r["start"], r["length"], r["period"]) for r in own] for own in runs.to_pylist()]
            assert got == [plain_runs(w, repeats, least) for w in texts]


def test_extensions_by_the_grammar():
    pick = random.Random(9)
    words = [pick.randrange(2) for _ in range(300)] + [7] * 50 + [1, 2, 3] * 30
    symbols = np.array([-1, *words, -2], np.int64)
    grammar = periodic_runs.Grammar(symbols)
    i = np.array([pick.randint(1, len(words)) for _ in range(3000)])
    j = np.array([pick.randint(1, len(words)) for _ in range(3000)])
    i, j = i[i != j], j[i != j]
    x = symbols.tolist()
    for a, b, after, before in zip(i.tolist(), j.tolist(), grammar.after(i, j).tolist(), grammar.before(i, j).tolist(), strict=True):
        n = 0
        while x[a + n] == x[b + n]:
            n += 1
        m = 0
        while x[a - m - 1] == x[b - m - 1]:
            m += 1
        assert (after, before) == (n, m)


def test_long_and_uniform_texts_take_time_in_proportion():
    for text, runs in ((" a" * 200_000, 1), (" ".join(["a b c d e f g h i j"] * 20_000), 1), (" ".join(map(str, range(200_000))), 0)):
        sizes, found, collapsed = periodic_runs._scan([text], 4, 6)
        assert sizes.tolist() == [200_000] and len(found[0]) == runs
        assert len(collapsed[0].split()) in (1, 10, 200_000)


def test_runs_edge_cases(spark):
    docs = spark.createDataFrame([*ROWS, (9, "a " * 7, None), (9, "a a " * 6, None)], "doc_id long, text string, runs string")
    found = periodic_runs.periodic_runs(docs, ["doc_id"]).collect()
    assert len(found) == len(ROWS) + 2
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(([tuple(x) for x in r.runs], r.collapsed if len(r.collapsed) < 20 else None))
    assert by_id[1] == by_id[2] == by_id[3] == [([], "")] and len(by_id[6]) == 2 and len(by_id[None]) == 2
    assert sorted(by_id[9]) == [([(0, 6, 1)], "a a"), ([(0, 7, 1)], "a")]
    assert queries.with_loops(docs.limit(0)).count() == 0 and periodic_runs.periodic_runs(docs.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, ["doc_id"], repeats=2)


# -- token alignment --------------------------------------------------------


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    letters = token_alignment._byte_letters()
    docs, holders = [], defaultdict(int)
    for doc_id, text in rows:
        a = library.encode(" " + (text or ""), add_special_tokens=False)
        b = model.encode(text or "")
        bytes_a = [bytes(letters[c] for c in token) for token in a.tokens]
        bytes_b = [bytes([int(model.id_to_piece(n)[3:5], 16)]) if model.is_byte(n) else model.id_to_piece(n).replace("▁", " ").encode() for n in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        owner_a = [k for k, token in enumerate(bytes_a) for _ in token]
        owner_b = [k for k, token in enumerate(bytes_b) for _ in token]
        pairs = sorted(set(zip(owner_a, owner_b, strict=True)))
        links = [(a.ids[x], b[y]) for x, y in pairs]
        groups: list[tuple[list[int], list[int]]] = []
        for at in range(len(whole)):
            new_a, new_b = (at == 0 or own[at] != own[at - 1] for own in (owner_a, owner_b))
            if new_a and new_b:
                groups.append(([], []))
            if new_a:
                groups[-1][0].append(a.ids[owner_a[at]])
            if new_b:
                groups[-1][1].append(b[owner_b[at]])
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        for pair in set(links):
            holders[pair] += 1
        docs.append((doc_id, len(a.ids), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest()))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    return sorted(
        (i, a, b, g, len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), digest) for i, a, b, g, links, digest in docs
    )


def test_alignment_of_whole_texts(spark, rows):
    got = queries.op13_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain_alignment(rows)


def test_alignment_of_odd_texts(spark):
    ship_code(spark)
    pick = random.Random(3)
    odd = ["a", "word", " ", "  ", "\n", "\t", ",", "'s", "12", "é", "▁", "<|endoftext|>", "中文", "　", "\r\n", "😀", " the", "\x00", "</s>", "<0x41>", "Ab", " "]
    made = [(k, "".join(pick.choice(odd) for _ in range(pick.randint(0, 25)))) for k in range(400)]
    made += [(1000, None), (1001, ""), (1002, " "), (1003, "the same"), (1003, "the same")]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    got = token_alignment.aligned(docs, ["doc_id"], A, B)
    assert sorted(tuple(r) for r in got.collect()) == plain_alignment(made)


def test_alignment_edge_cases(spark):
    ship_code(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, block string")
    got = token_alignment.aligned(docs, ["doc_id", "block"], A, B).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert len(got) == len(ROWS) and {r.block for r in by_id[4]} == {"b"} and by_id[7][0].n_links > 160_000
    assert [tuple(r)[2:] for r in by_id[1] + by_id[2]] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert tuple(by_id[5][0])[2:] == tuple(by_id[6][0])[2:] == tuple(by_id[6][1])[2:]
    assert token_alignment.aligned(docs.limit(0), ["doc_id"], A, B).count() == 0
    empty = token_alignment.aligned(docs.where("doc_id = 1"), ["doc_id"], A, B).collect()
    assert [tuple(r) for r in empty] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_moves_pairs_of_blocks_and_no_texts(spark):
    ship_code(spark)
    blocks = token_alignment._blocks(spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id"], "text", A, B)
    assert blocks.columns == ["block", "docs", "pairs", "pair_docs", "pair", "times"]
    assert blocks.select(F.countDistinct("block") == F.count("*")).first()[0]


# -- toxicity ---------------------------------------------------------------


def machine_on(texts: list[str], toxic: list[int], factors: int) -> toxicity.Machine:
    import pyarrow as pa

    column = pa.array(texts, pa.large_string())
    buckets = np.unique(toxicity.terms(column)[1])
    doc, term = toxicity.known_terms(column, buckets)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return toxicity.fit(at, term, np.array(toxic, float), np.ones(len(texts)), buckets, factors)


def test_pairs_of_terms_count_where_single_terms_do_not():
    """Both or neither of two words: no sum of their weights can tell."""
    import pyarrow as pa

    pick = random.Random(4)
    texts, toxic = [], []
    for _ in range(2000):
        insult, group = pick.random() < 0.5, pick.random() < 0.5
        words = [pick.choice(("one", "two", "six", "ten")) for _ in range(3)] + ["vermin"] * insult + ["zorbs"] * group
        pick.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(insult == group))
    truth = np.array(toxic)
    column = pa.array(texts, pa.large_string())
    pairwise = (machine_on(texts, toxic, 8).scores(column) >= 0.5).astype(int)
    additive = (machine_on(texts, toxic, 0).scores(column) >= 0.5).astype(int)
    assert (pairwise == truth).mean() > 0.95 and (additive == truth).mean() < 0.8


def test_scores_equal_the_sum_over_all_pairs():
    import pyarrow as pa

    texts = ["b a c", "a", "", "unknown", "c c c a"]
    machine = machine_on(["a b", "b c", "c a", "a b c"], [0, 1, 0, 1], 4)
    column = pa.array([*texts, None], pa.large_string())
    doc, term = toxicity.known_terms(column, machine.buckets)
    for k, score in enumerate(machine.scores(column).tolist()):
        own = term[doc == k].tolist()
        pairs = sum(float(machine.factors[x] @ machine.factors[y]) for i, x in enumerate(own) for y in own[i + 1 :])
        total = machine.bias + sum(machine.weights[x] for x in own) + pairs / max(len(own), 1)
        assert score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9)


def test_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    scores = queries.op11_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where("toxic IS NOT NULL")
    rows = scores.where("held_out").join(labels, "doc_id").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    caught, flagged = sum(r.predicted for r in toxic) / len(toxic), sum(r.predicted for r in clean) / len(clean)
    assert len(toxic) > 80 and caught > 0.85 and flagged < 0.01


def test_toxicity_edge_cases(spark):
    ship_code(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, toxic string")
    learn = F.col("id") % 5 != 0
    schema = "doc_id long, toxic int, bucket string"
    assert all(r.score < 1e-9 for r in toxicity.scored(docs, toxicity.train(docs, spark.createDataFrame([], schema), learn), ["doc_id"]).collect())
    one_class = spark.createDataFrame([(6, 1, ""), (7, 1, "")], schema)
    assert all(r.score > 0.99 for r in toxicity.scored(docs, toxicity.train(docs, one_class, learn), ["doc_id"]).collect())
    unknown = spark.createDataFrame([(96, 1, ""), (97, 0, "")], schema)
    assert all(r.score == pytest.approx(0.5) for r in toxicity.scored(docs, toxicity.train(docs, unknown, learn), ["doc_id"]).collect())
    mixed = spark.createDataFrame([(6, 1, ""), (8, 0, ""), (8, 0, ""), (7, 0, ""), (7, 1, ""), (4, None, ""), (3, 2, ""), (None, 1, ""), (5, 0, "")], schema)
    assert {(r.id, r.toxic) for r in toxicity.given_labels(mixed, "doc_id", "toxic", learn).collect()} == {(6, 1), (8, 0)}
    machine = toxicity.train(docs, mixed, learn)
    got = toxicity.scored(docs, machine, ["doc_id", "toxic"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    again = toxicity.train(docs.repartition(3), mixed, learn)
    assert np.array_equal(machine.buckets, again.buckets) and np.allclose(machine.weights, again.weights)
    assert toxicity.scored(docs.limit(0), machine, ["doc_id"]).count() == 0


def test_the_sample_is_bounded_and_of_both_classes(spark):
    ship_code(spark)
    docs = spark.createDataFrame([(k, f"w{k % 7} word {'bad' if k % 3 == 0 else 'good'} text") for k in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    machine = toxicity.train(docs, labels, F.col("id") % 5 != 0, sample=40)
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, machine, ["doc_id"]).collect()}
    assert all((scores[k] >= 0.5) == (k % 3 == 0) for k in range(600))


def test_tilings_are_merged(monkeypatch):
    """Tokens of A and B come in order each, so they are merged and not sorted by two keys; of equal starts A comes first."""
    monkeypatch.setattr(np, "lexsort", None)
    got = token_alignment.coalesce(np.array([0, 3, 5, 9]), np.array([0, 2, 5, 7, 9]), 12)
    assert [x.tolist() for x in got] == [[0, 0, 1, 2], [0, 0, 1, 1, 2], [0, 0, 1, 2, 2, 3], [0, 1, 1, 2, 3, 4]]
