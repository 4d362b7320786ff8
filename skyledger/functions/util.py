"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """``table[key]`` as one CASE expression; ``default`` (NULL) for other keys."""
    result = None
    for name, value in table.items():
        branch = key == F.lit(name)
        result = F.when(branch, F.lit(value)) if result is None else result.when(branch, F.lit(value))
    return result.otherwise(default if default is not None else F.lit(None))


def none_text(text: Column, texts: Iterable[str], zero: str) -> Column:
    """Replace NULL and the given texts by ``zero``."""
    return F.when(text.isNull() | text.isin(*texts), F.lit(zero)).otherwise(text)


def apart(column: Column) -> Column:
    """The same value, by a lambda over one element.

    A projection or filter that holds a lambda is compiled by itself, as many
    short methods. As part of a whole stage it would be one method, and one of
    more than 8000 bytes is left to the interpreter. Only what the lambda is over
    is not compiled, so it should be cheap.
    """
    return F.get(F.transform(F.array(column), lambda value: value), F.lit(0))
