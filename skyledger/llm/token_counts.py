"""Token counts: whole texts encoded in Arrow batches that return lengths only.

Batches are cut to about a megabyte of text whatever their number of rows, and
every text is split where no token reaches across, so a very long text is many
short pieces to the library. The split is exact, see `tokens`.

Defined results: NULL counts as an empty text, which has no tokens; special
strings inside a text are treated as the library does by default; repeated rows
are counted each. Only the columns `keep` and the text are read; a kept column
named like a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skyledger.llm.text import byte_slices
from skyledger.llm.tokens import ENCODED, count_texts


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with n_bytes (UTF-8) and n_tokens by the vocabulary file `path`."""
    names = [c for c in keep if c not in ("n_bytes", "n_tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text, ENCODED):
                texts = pc.fill_null(part.column(text), "")
                n_bytes = pc.binary_length(texts).cast(pa.int64())
                counts = pa.array(count_texts(texts, path))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], n_bytes, counts], names=[*names, "n_bytes", "n_tokens"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["n_bytes bigint", "n_tokens bigint"])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(count, schema)
