"""Components of links, and how often their steps are written."""

from __future__ import annotations

import random

from skyledger.llm import components as module
from skyledger.llm.components import components


def _roots(links):
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def test_components_end_at_stars(spark, monkeypatch):
    writes = []
    written = module.stored
    monkeypatch.setattr(module, "stored", lambda df, label: writes.append(label) or written(df, label))
    seed = random.Random(4)
    chain = [(n, n + 1) for n in range(40)]
    links = chain + [(seed.randrange(100, 300), seed.randrange(100, 300)) for _ in range(150)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    own = components(frame)
    assert {r["node"]: r["root"] for r in own.collect()} == _roots(links) and own.count() == len(_roots(links))

    # links that are known take no further step, new ones go on from the roots found
    writes.clear()
    again = components(frame, known=own)
    few = len(writes)
    writes.clear()
    none = components(frame.limit(0), known=own)
    assert {tuple(r) for r in none.collect()} == {tuple(r) for r in own.collect()} and len(writes) == 2
    more = [(40, 150), (1000, 999)]
    wider = components(spark.createDataFrame(more, "a long, b long"), known=own)
    assert {r["node"]: r["root"] for r in wider.collect()} == _roots(links + more)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in own.collect()} and few <= 6
    assert components(frame.limit(0)).count() == 0
