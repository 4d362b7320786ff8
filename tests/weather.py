"""Small weather fixtures and brute-force twins of the views."""

from __future__ import annotations

import random
from decimal import Decimal

from skyledger.constants import SHORT, ULTRA
from skyledger.schemas import SNAPSHOT

ICONS = ["맑음_d.png", "비_d.png", "눈비_d.png", "눈_d.png", "소나기_d.png", "약한비_n.png", "약한비_d.png", None]
RAIN = ["0mm", "1mm 미만", "30~50mm", "50mm 이상", "1", "2", "3", None, "7.5mm", "7.5", "30.0~50.0mm", "많음"]
SNOW = ["0cm", "0.5cm 미만", "5.0cm 이상", "1", "2", None, "1.5cm"]


def tenths(number: int) -> Decimal:
    """One decimal place, as the stored type has."""
    return Decimal(number).scaleb(-1)


def state(feed: str, n: int, seed: int = 7, cities: int = 4) -> list[dict]:
    """Random latest-state rows; the first city holds a third of them and more."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        city = 0 if rng.random() < 0.4 else rng.randrange(cities)
        row = {
            "city": f"c{city}", "province": "p", "lat": Decimal(33 + city), "lng": Decimal(125 + city),
            "basetime": f"202401{rng.randrange(1, 3):02d}{rng.choice(['02', '05', '17', '23'])}00",
            "icon_map": rng.choice(ICONS), "PTY": 0, "SKY": 1, "REH": rng.choice([None, *range(0, 101)]),
            "VEC": rng.choice([None, -1, 400, *range(0, 361)]),
            "WSD": None if rng.random() < 0.01 else tenths(rng.randrange(-20, 250)),
            "geom": (125.0 + city, 33.0 + city),
        }
        temp = None if rng.random() < 0.1 else tenths(rng.randrange(-200, 400))
        if feed == ULTRA:
            row |= {"fcsthour": i, "T1H": temp, "RN1": rng.choice(RAIN)}
        else:
            row |= {
                "fcstdate": f"202401{rng.randrange(3, 6):02d}", "fcsthour": f"{i:06d}", "TMP": temp,
                "PCP": rng.choice(RAIN), "SNO": rng.choice(SNOW),
                "POP": None if rng.random() < 0.05 else rng.randrange(0, 101),
            }
        rows.append(row)
    return rows


def frame(spark, feed: str, rows: list[dict]):
    names = SNAPSHOT[feed].names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SNAPSHOT[feed])


def groups(rows: list[dict], *keys: str) -> dict:
    out: dict = {}
    for row in rows:
        out.setdefault(tuple(row[k] for k in keys), []).append(row)
    return out


def high_first(value):
    """Sort key of DESC with NULL first."""
    return (0, 0) if value is None else (1, -value)


def null_last(value):
    """Sort key of ASC with NULL last."""
    return (1, "") if value is None else (0, value)


__all__ = ["SHORT", "ULTRA", "frame", "groups", "high_first", "null_last", "state"]
