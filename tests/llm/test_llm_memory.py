"""What processes hold once the work on their batches is over."""

from __future__ import annotations

import shutil

import public_tokenizers

from skyledger.llm import packing
from skyledger.llm.storage import ship_code


def test_packing_leaves_no_pieces_in_idle_processes(spark, tmp_path):
    """A task's memory of pieces ends with the task; else each idle process holds its own while others work."""
    ship_code(spark)
    path = shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), tmp_path / "own.json")
    docs = spark.range(64).selectExpr("id AS doc_id", "concat_ws(' ', 'a few words', id) AS text").repartition(16)
    assert packing.pack(docs, str(path)).count() == 64

    def held(batches):
        import pyarrow as pa

        from skyledger.llm import tokens

        for batch in batches:
            kept = any(own == str(path) for own, _ in tokens._kept)
            yield pa.RecordBatch.from_pydict({"kept": pa.array([kept] * batch.num_rows)})

    rows = spark.range(64).repartition(64).mapInArrow(held, "kept boolean").collect()
    assert len(rows) == 64 and not any(r.kept for r in rows)
