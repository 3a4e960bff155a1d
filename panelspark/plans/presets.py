"""Fixed values of the published models: periods, lags, lists and mappings."""

from __future__ import annotations

from dataclasses import dataclass

# Period, province of the wide forecast, population for national rates.
START, END = "2020-01-01", "2021-06-26"
VACCINATION_START = "2021-01-01"
CENSUS_SINCE = "2019-12-01"
TARGET_PROVINCE = "M"
NATIONAL_POPULATION = 47_394_220

# Sources in subset order, and how their locations are collapsed to one row per day.
SOURCES = ["casos_uci", "casos", "aemet", "googletrends", "mitma", "mscbs", "holidays"]
COLLAPSE = {"casos_uci": "sum", "casos": "sum", "aemet": "mean", "googletrends": "sum", "mitma": "sum", "mscbs": "sum", "holidays": "max"}
PER_100K = ["casos_uci", "casos", "mitma", "mscbs"]

# Age groups that are merged.
AGE_BANDS = {"0-9": "0-59", "10-19": "0-59", "20-29": "0-59", "30-39": "0-59", "40-49": "0-59", "50-59": "0-59"}

# Region label with a footnote mark in the vaccination sheets.
REGION_FIXES = {"C. Valenciana*": "C. Valenciana"}

# Search words by theme.
THEMES = {
    "behavior": ["paliativos", "ambulancia", "cementerio", "tanatorio", "hospital"],
    "symptom": ["enferma", "enfermo", "dolor", "entubado", "respiración asistida", "enfermo terminal", "temperatura", "fiebre", "uci",
                "infectados", "muerte"],
    "policy": ["confinamiento", "vacuna", "janssen", "astrazeneca", "pfizer", "pandemia", "coronavirus", "covid"],
}
KEYWORD_THEMES = {word: theme for theme, words in THEMES.items() for word in words}

# Search words of the cases model.
SYMPTOM_WORDS = ["ambulancia", "dolor", "enferma", "enfermo", "enfermo terminal", "fiebre", "respiración asistida", "temperatura", "tos", "uci",
                 "entubado", "infectados"]

CASE_COLUMNS = ["num_casos", "num_casos_prueba_pcr", "num_casos_prueba_test_ac", "num_casos_prueba_ag", "num_casos_prueba_elisa",
                "num_casos_prueba_desconocida"]
OUTCOME_COLUMNS = ["num_casos", "num_hosp", "num_uci", "num_def"]
WEATHER_NUMBERS = ["altitud", "tmed", "prec", "tmin", "tmax", "dir", "velmedia", "racha", "sol", "presMax", "presMin"]
WEATHER_STATS = {"tmed": ["mean", "std", "min", "max"], "prec": ["sum", "mean", "std", "min", "max"],
                 "tmin": ["mean", "std", "min", "max"], "tmax": ["mean", "std", "min", "max"]}
FLOW_STATS = ["sum", "mean", "std", "min", "max"]


@dataclass(frozen=True)
class SearchPreset:
    """Lags are in days; a negative lag looks ahead."""

    target: str
    target_lag: int
    outcome_lags: tuple[int, ...]
    case_lags: tuple[int, ...]
    other_lags: tuple[int, ...]
    per_100k: bool = True
    words: tuple[str, ...] | None = None


# The three searches.
DEATHS = SearchPreset("num_def", -7, (1, 7, 14, 21), (0, 7, 14, 21), (10, 20, 30))
CASES = SearchPreset("num_casos", -7, (1, 7, 14), tuple(range(0, 30, 10)), tuple(range(0, 30, 3)), words=tuple(SYMPTOM_WORDS))
HOSPITAL = SearchPreset("ratio_population__num_hosp", -7, (1, 7, 14), tuple(range(0, 30, 7)), tuple(range(0, 30, 7)), per_100k=False)
P_LIMIT, ROUNDS, TEST_SHARE, SEED = 0.05, 5, 0.3, 42

# The wide forecast.
WIDE_LAGS = {"uci": (1, 7, 10, 14), "tests": (1, 10, 15, 21), "aemet": (0, 5, 10, 21), "google_trends": (0, 5, 10, 21), "mitma": (0, 5, 10, 21),
             "mscbs": (0, 5, 10, 21), "holidays": (0, 5, 10, 21)}
WARMUP, HORIZON = 21, 7
