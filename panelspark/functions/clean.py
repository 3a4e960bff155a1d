"""Column expressions that bring source text to typed values. Bad text becomes NULL, cell by cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names.
SPANISH_MONTHS = {
    "enero": 1,
    "febrero": 2,
    "marzo": 3,
    "abril": 4,
    "mayo": 5,
    "junio": 6,
    "julio": 7,
    "agosto": 8,
    "septiembre": 9,
    "octubre": 10,
    "noviembre": 11,
    "diciembre": 12,
}


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def flat_name(*parts) -> str:
    """Join the parts of a compound column name, leaving out empty ones."""
    return "__".join(str(p) for p in parts if p not in (None, ""))


def comma_decimal(col: str | Column) -> Column:
    return F.replace(as_column(col), F.lit(","), F.lit(".")).try_cast("double")


def thousands_int(col: str | Column) -> Column:
    return F.replace(as_column(col), F.lit("."), F.lit("")).try_cast("bigint")


def safe_date(col: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(as_column(col), F.lit(fmt)).cast("date")


def spanish_date(col: str | Column) -> Column:
    """Dates such as ``1 de julio de 2020``."""
    text = F.lower(F.trim(as_column(col)))
    shape = r"^(\d{1,2}) de (\p{L}+) de (\d{4})$"
    month = F.try_element_at(literal_map(SPANISH_MONTHS), F.regexp_extract(text, shape, 2))
    iso = F.concat(F.regexp_extract(text, shape, 3), F.lit("-"), month.cast("string"),
                   F.lit("-"), F.regexp_extract(text, shape, 1))
    return safe_date(iso, "yyyy-M-d")


def prefix_code(col: str | Column, length: int = 2) -> Column:
    return F.substring(as_column(col), 1, length)


def recode(col: str | Column, mapping: dict) -> Column:
    """Replace mapped values, keep all others."""
    value = as_column(col)
    return F.coalesce(F.try_element_at(literal_map(mapping), value), value)


def strip_marker(col: str | Column, marker: str) -> Column:
    return F.replace(as_column(col), F.lit(marker), F.lit(""))


def rate_per_100k(value: str | Column, population: str | Column | float) -> Column:
    base = F.lit(float(population)) if isinstance(population, (int, float)) else as_column(population)
    return F.try_divide(as_column(value).cast("double"), base) * F.lit(100_000.0)
