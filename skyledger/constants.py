"""Fixed values of the weather domain: codes, texts, names and thresholds.

Everything here is data the published results depend on, so it is stated once
and in full.
"""

# -- feeds ------------------------------------------------------------------

NOW = "now"
ULTRA = "ultraShort"
SHORT = "shortFcst"
FEEDS = (NOW, ULTRA, SHORT)

# The item categories each feed carries.
CATEGORIES = {
    NOW: ("PTY", "T1H", "REH", "RN1", "VEC", "WSD", "UUU", "VVV"),
    ULTRA: ("PTY", "SKY", "LGT", "RN1", "T1H", "REH", "VEC", "WSD", "UUU", "VVV"),
    SHORT: ("PTY", "SKY", "PCP", "SNO", "TMP", "REH", "POP", "VEC", "WSD", "UUU", "VVV"),
}

# Categories stored as numbers. A row that lacks one of them, or
# holds text there, is not usable.
FLOAT_CATEGORIES = ("T1H", "TMP", "WSD", "UUU", "VVV")
INT_CATEGORIES = ("REH", "POP", "VEC")

# Observation columns that the latest-state tables do not keep.
SNAPSHOT_DROPS = ("LGT", "UUU", "VVV")

# Fixed value: a temperature that stands for "not measured".
MISSING_TEMP = -999.0

# -- weather names ----------------------------------------------------------

# Weather keys that have an icon.
WEATHER_KEYS = (
    "눈비",
    "약한눈",
    "눈",
    "강한눈",
    "약한비",
    "비",
    "강한비",
    "소나기",
    "안개",
    "흐림",
    "번개,뇌우",
    "구름많음",
    "구름조금",
    "맑음",
)

# Icon folder -> suffix of the icon file name.
ICON_SUFFIX = {"day": "_d.png", "night": "_n.png"}

# How severe a weather key is; every other key counts as 1.
SEVERITY_SHORT = {
    "강한눈": 8,
    "강한비": 7,
    "눈비": 6,
    "눈": 5,
    "비": 4,
    "약한눈": 3,
    "약한비": 2,
}
SEVERITY_ULTRA = {"번개,뇌우": 9, **SEVERITY_SHORT}
SEVERITY_OTHER = 1

# The sixteen wind names, clockwise from north.
COMPASS = (
    "북풍",
    "북북동",
    "북동",
    "동북동",
    "동풍",
    "동남동",
    "동남풍",
    "남남동",
    "남풍",
    "남남서",
    "남서풍",
    "서남서",
    "서풍",
    "서북서",
    "북서풍",
    "북북서",
)

# -- precipitation texts ----------------------------------------------------

# Texts that mean "none", per field, and what they become.
NO_RAIN_NOW = ("강수없음", "적설없음", "")
NO_RAIN = ("강수없음", "", "0")
NO_SNOW = ("적설없음", "", "0")
ZERO_RAIN = "0mm"
ZERO_SNOW = "0cm"

# Texts with a set sort value.
RAIN_ORDER = {"0mm": 0.0, "1mm 미만": 0.5, "30~50mm": 30.0, "50mm 이상": 50.0}
RAIN_CODE_ORDER = {"1": 1.0, "2": 2.0, "3": 3.0}
SNOW_ORDER = {"0cm": 0.0, "0.5cm 미만": 0.25, "5.0cm 이상": 5.0}
SNOW_CODE_ORDER = {"1": 1.0, "2": 2.0}

# Meaning of the qualitative codes three days ahead, and the
# base hours that use codes (the others use numbers).
RAIN_CODE_TEXT = {"1": "시간당 3mm 미만", "2": "시간당 3~15mm", "3": "시간당 15mm 이상"}
SNOW_CODE_TEXT = {"1": "시간당 1cm 미만", "2": "시간당 1cm 이상"}
CODE_BASE_HOURS = ("02", "05", "08", "11", "14")
NUMBER_BASE_HOURS = ("17", "20", "23")

# -- grid -------------------------------------------------------------------

# Lambert conformal conic, two standard parallels, 5 km cells.
GRID_EARTH_RADIUS_KM = 6371.00877
GRID_CELL_KM = 5.0
GRID_PARALLELS = (30.0, 60.0)
GRID_ORIGIN_LNG = 126.0
GRID_ORIGIN_LAT = 38.0
GRID_ORIGIN_CELL = (43, 136)

# -- published documents ----------------------------------------------------

# Names of the published layouts.
LAYOUTS = ("cond", "rain", "wind", "humid")

# Date group -> days after today.
DATE_GROUPS = {"today": 0, "tomorrow": 1, "dayafter": 2, "twodaysafter": 3}

# Seconds a published document stays valid.
TTL_ULTRA = 7200
TTL_SHORT = 21600

# Map display tiers. Cities in no list belong to OTHER_TIER.
TIER_CITIES = {
    1: ("서울", "부산", "대전", "대구", "광주", "백령도", "울릉도", "제주시", "강릉"),
    2: ("인천", "세종", "목포", "여수", "포항", "춘천", "서산", "전주", "울산"),
    3: (
        "수원",
        "고양",
        "성남",
        "속초",
        "원주",
        "청주",
        "천안",
        "군산",
        "순천",
        "창원",
        "진주",
        "경주",
        "서귀포시",
    ),
}
OTHER_TIER = 4
TIER_MIN_ZOOM = {1: 7, 2: 8, 3: 9, 4: 11}
TIER_MAX_ZOOM = 20
