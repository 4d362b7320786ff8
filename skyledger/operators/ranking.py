"""Best row per group as aggregates.

A ``row_number() = 1`` window sorts every input row. The same pick written as an
aggregate is combined on the map side, so each task sends at most one candidate
per group however many rows a hot group has.

Order follows the SQL the results must agree with: NULL sorts as the largest
value, i.e. first under DESC and last under ASC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def desc(number: Column) -> list[Column]:
    return [number.isNotNull(), -number]


def asc(value: Column) -> list[Column]:
    return [value.isNull(), value]


def best(order: Sequence[Column], **payload: Column) -> Column:
    """Aggregate: the payload struct of the row that comes first in ``order``.

    ``min_by`` and not a minimum over one struct: that would be indifferent to
    duplicates, and the optimizer would drop a ``distinct`` placed below it to
    shrink the rows.
    """
    ranked = F.struct(*[c.alias(f"by{i}") for i, c in enumerate(order)])
    return F.min_by(F.struct(*[c.alias(n) for n, c in payload.items()]), ranked)


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the last one in ``order``.

    Spark pushes the ``= 1`` below the shuffle (window group limit), so a key
    with very many copies shrinks to one row per task before it moves.
    """
    window = Window.partitionBy(*key).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


# Wind: speed is DECIMAL(5,1) and direction INT, so the pair fits one BIGINT
# whose order is "speed DESC NULLS FIRST, direction ASC NULLS LAST". A BIGINT
# maximum stays in the hash aggregate (no sort), which a struct would not.
_SPEED_NULL = 1 << 20  # above every DECIMAL(5,1) times ten
_DIRECTION_NULL = 1 << 32  # above every INT
_DIRECTION_BITS = 34


def pack_wind(speed: Column, direction: Column) -> Column:
    high = F.coalesce((speed * 10).cast("bigint"), F.lit(_SPEED_NULL))
    low = F.lit(_DIRECTION_NULL) - F.coalesce(direction.cast("bigint"), F.lit(_DIRECTION_NULL))
    return high * F.lit(1 << _DIRECTION_BITS) + low


def unpack_wind(packed: Column) -> tuple[Column, Column]:
    high = F.shiftright(packed, _DIRECTION_BITS)
    low = F.lit(_DIRECTION_NULL) - packed.bitwiseAND(F.lit((1 << _DIRECTION_BITS) - 1))
    speed = F.when(high != _SPEED_NULL, (high.cast("decimal(10,0)") / 10).cast("decimal(5,1)"))
    direction = F.when(low != _DIRECTION_NULL, low.cast("int"))
    return speed, direction
