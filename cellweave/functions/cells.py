"""Column expressions that bring raw values into canonical form, and small geometry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def place_code(x: Column, *, whole: str = "53", whole_code: int = 530010, width: int = 6) -> Column:
    """The first digits of a place code as a number, null if they aren't one; one prefix stands for a single place."""
    return F.when(F.left(x, F.lit(len(whole))) == whole, F.lit(whole_code)).otherwise(F.left(x, F.lit(width)).try_cast("int"))


def any_date(x: Column, *, first: int = 1990, last: int = 2035) -> Column:
    """A date from ISO, YYYYMMDD, DDMMYYYY or YYYYMM text within the years; null otherwise.

    Eight digits are read year first if that gives a year in range.
    """
    t = F.trim(x)
    forms = [(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", t), (r"^\d{8}$", "yyyyMMdd", t), (r"^\d{8}$", "ddMMyyyy", t), (r"^\d{6}$", "yyyyMMdd", F.concat(t, F.lit("01")))]
    made = []
    for pattern, form, value in forms:
        d = F.when(t.rlike(pattern), F.try_to_date(value, form))
        made.append(F.when(F.year(d).between(first, last), d))
    return F.coalesce(*made)


def sunday_of(date: Column) -> Column:
    return F.date_sub(date, F.dayofweek(date) - 1)


def epi_week(date: Column) -> tuple[Column, Column]:
    """Epidemiological year and week: weeks run Sunday to Saturday, week 1 is the one that holds 4 January."""
    start = sunday_of(date)
    year = F.year(F.date_add(start, 3))  # the year that most days of the week are in
    return year, (F.datediff(start, sunday_of(F.make_date(year, F.lit(1), F.lit(4)))) / 7).cast("int") + 1


def band(x: Column, edges: tuple[int, ...]) -> Column:
    """Index of the right-open band of x: the last edge that is not above it; null below the first."""
    out = F.lit(None).cast("int")
    for i, edge in enumerate(edges):
        out = F.when(x >= edge, F.lit(i)).otherwise(out)
    return out


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, *, radius: float = 6371.0) -> Column:
    """Kilometres between points given in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def planar(lat: Column, lon: Column, *, at: float, radius: float = 6371.0) -> tuple[Column, Column]:
    """Kilometres east and north on a map that is true at latitude ``at``."""
    return F.radians(lon) * F.cos(F.radians(F.lit(at))) * radius, F.radians(lat) * radius


def categories(text: Column, pattern: str, *, width: int = 3) -> Column:
    """Distinct categories (leading characters) of the codes that a cell packs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.left(x, F.lit(width))))
