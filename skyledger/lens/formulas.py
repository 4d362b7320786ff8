"""The weather lens: weather values as plain arithmetic on driver columns.

The driver tables hold no weather. Each value below is an ANSI expression over
one event (or customer) that Spark and DuckDB read alike, so the input of a
query is defined once; only the few date formats differ per dialect.
"""

from __future__ import annotations

from collections.abc import Mapping

SPARK: Mapping[str, str] = {
    "ymd": "date_format({0}, 'yyyyMMdd')",
    "hh": "date_format({0}, 'HH')",
    "plus": "date_add(CAST({0} AS DATE), CAST({1} AS INT))",
    "text": "CAST({0} AS STRING)",
}
DUCK: Mapping[str, str] = {
    "ymd": "strftime({0}, '%Y%m%d')",
    "hh": "strftime({0}, '%H')",
    "plus": "(CAST({0} AS DATE) + CAST({1} AS INTEGER))",
    "text": "CAST({0} AS VARCHAR)",
}


class Dialect:
    def __init__(self, forms: Mapping[str, str]):
        self._forms = forms

    def __getattr__(self, name: str):
        form = self._forms[name]
        return lambda *args: form.format(*args)

    def pad2(self, number: str) -> str:
        return f"lpad({self.text(number)}, 2, '0')"


spark_sql = Dialect(SPARK)
duck_sql = Dialect(DUCK)


def tenth(number: str) -> str:
    return f"(({number}) / CAST(10 AS DOUBLE))"


PLACE = {
    "city": "n_name",
    "province": "r_name",
    "lat": "((330 + 2 * n_nationkey) / CAST(10 AS DOUBLE))",
    "lng": "((498 + n_nationkey) / CAST(4 AS DOUBLE))",
}


def temp(k: str) -> str:
    return tenth(f"({k} * 29) % 551 - 150")


def numbers(k: str) -> dict[str, str]:
    """Number categories of observation ``k``."""
    return {
        "REH": f"(({k} * 11) % 101)",
        "POP": f"((({k} * 5) % 11) * 10)",
        "VEC": f"(({k} * 37) % 361)",
        "WSD": tenth(f"({k} * 13) % 251"),
        "UUU": tenth(f"({k} * 17) % 201 - 100"),
        "VVV": tenth(f"({k} * 19) % 201 - 100"),
    }


def codes(d: Dialect, k: str) -> dict[str, str]:
    """Code categories of observation ``k``, as text."""
    return {
        "PTY": d.text(f"{k} % 8"),
        "SKY": f"CASE {k} % 3 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE '4' END",
        "LGT": f"CASE WHEN {k} % 13 = 0 THEN '3.5' ELSE '0' END",
    }


def rain(d: Dialect, k: str) -> str:
    """Rain text as it lies in the zones."""
    return (
        f"CASE {k} % 9 WHEN 0 THEN '0mm' WHEN 1 THEN '1mm 미만' WHEN 2 THEN '30~50mm' WHEN 3 THEN '50mm 이상'"
        f" WHEN 4 THEN '1' WHEN 5 THEN '2' WHEN 6 THEN '3' WHEN 7 THEN NULL"
        f" ELSE {d.text(f'{k} % 30')} || '.5mm' END"
    )


def snow(d: Dialect, k: str) -> str:
    """Snow text as it lies in the zones."""
    return (
        f"CASE {k} % 7 WHEN 0 THEN '0cm' WHEN 1 THEN '0.5cm 미만' WHEN 2 THEN '5.0cm 이상'"
        f" WHEN 3 THEN '1' WHEN 4 THEN '2' WHEN 5 THEN NULL ELSE {d.text(f'{k} % 5')} || '.5cm' END"
    )


def sent_rain(d: Dialect, k: str) -> str:
    """Rain text as the API sends it."""
    return (
        f"CASE {k} % 9 WHEN 0 THEN '강수없음' WHEN 1 THEN '1mm 미만' WHEN 2 THEN '30~50mm' WHEN 3 THEN '50mm 이상'"
        f" WHEN 4 THEN '0' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '적설없음'"
        f" ELSE {d.text(f'{k} % 30')} || '.5mm' END"
    )


def sent_snow(d: Dialect, k: str) -> str:
    """Snow text as the API sends it."""
    return (
        f"CASE {k} % 7 WHEN 0 THEN '적설없음' WHEN 1 THEN '0.5cm 미만' WHEN 2 THEN '5.0cm 이상'"
        f" WHEN 3 THEN '0' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE {d.text(f'{k} % 7')} || '.5cm' END"
    )


ICON = (
    "CASE (event_id * 7 + user_id) % 8 WHEN 0 THEN '맑음_d.png' WHEN 1 THEN '비_d.png' WHEN 2 THEN '눈비_d.png'"
    " WHEN 3 THEN '눈_d.png' WHEN 4 THEN '소나기_d.png' WHEN 5 THEN '약한비_d.png' WHEN 6 THEN '흐림_d.png' END"
)


def base_hour(d: Dialect) -> str:
    """Hour of the event's issue: every six hours."""
    return d.pad2("hour(ts) - hour(ts) % 6")


def raw_now(d: Dialect) -> dict[str, str]:
    k = "event_id"
    n, c = numbers(k), codes(d, k)
    return {
        **PLACE,
        "basetime": f"{d.ymd('ts')} || {base_hour(d)} || '00'",
        "PTY": c["PTY"],
        "T1H": f"CASE WHEN event_id % 97 = 0 THEN CAST(-999 AS DOUBLE) ELSE {temp(k)} END",
        "REH": n["REH"],
        "RN1": rain(d, k),
        **{name: n[name] for name in ("VEC", "WSD", "UUU", "VVV")},
    }


def raw_ultra(d: Dialect) -> dict[str, str]:
    k = "event_id"
    n, c = numbers(k), codes(d, k)
    return {
        **PLACE,
        "basetime": f"{d.ymd('ts')} || {base_hour(d)} || '30'",
        "fcsthour": "(event_id % 7 + 1)",
        "icon_map": ICON,
        "PTY": c["PTY"],
        "SKY": c["SKY"],
        "T1H": temp(k),
        "REH": n["REH"],
        "RN1": rain(d, k),
        "LGT": c["LGT"],
        **{name: n[name] for name in ("VEC", "WSD", "UUU", "VVV")},
    }


def raw_short(d: Dialect) -> dict[str, str]:
    """Forecast of the event's date, issued zero to four days before."""
    k = "event_id"
    n, c = numbers(k), codes(d, k)
    return {
        **PLACE,
        "basetime": f"{d.ymd(d.plus('ts', '-(event_id % 5)'))} || {d.pad2('2 + 3 * (event_id % 8)')} || '00'",
        "fcstdate": d.ymd("ts"),
        "fcsthour": f"{d.hh('ts')} || '00'",
        "icon_map": ICON,
        "PTY": c["PTY"],
        "SKY": c["SKY"],
        "TMP": temp(k),
        "REH": n["REH"],
        "PCP": rain(d, k),
        "SNO": snow(d, k),
        "POP": n["POP"],
        **{name: n[name] for name in ("VEC", "WSD", "UUU", "VVV")},
    }


# -- payload items ----------------------------------------------------------

ULTRA_K = "(event_id * 7 + i)"
SHORT_K = "(event_id * 5 + i)"


def slot_time(d: Dialect, lead: str) -> str:
    """``HH00`` text, ``lead`` hours after the event's issue."""
    return f"{d.pad2(f'(hour(ts) - hour(ts) % 6 + {lead}) % 24')} || '00'"


def wind_text(d: Dialect, k: str) -> str:
    """Wind speed as sent; now and then it is no number, or none that fits."""
    bad = f"CASE {k} % 3 WHEN 0 THEN 'bad' WHEN 1 THEN 'NaN' ELSE '12345' END"
    return f"CASE WHEN {k} % 53 = 0 THEN {bad} ELSE {d.text(numbers(k)['WSD'])} END"


def short_hour(d: Dialect) -> str:
    return f"{d.pad2('(event_id * 3 + i * 5) % 24')} || '00'"


GRID_LAT = "(33 + (c_custkey % 550) / CAST(100 AS DOUBLE))"
GRID_LNG = "(124.5 + ((c_custkey * 7) % 650) / CAST(100 AS DOUBLE))"
