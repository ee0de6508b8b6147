"""Dates in loose text, spreadsheet serials, approximate dates, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS

# --- Fixed values ---
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
SERIAL_EPOCH = "1899-12-30"
SERIAL_MAX = 80_000
SERIAL_MIN = 20_000
# --------------------

DAY_FIRST = "(\\d{1,2})\\.(\\d{2})\\.(\\d{4})"


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def day_first_date(text: Column) -> Column:
    """First ``dd.mm.yyyy`` in a text as a date."""
    d, m, y = (F.regexp_extract(text, DAY_FIRST, i) for i in (1, 2, 3))
    return F.when(y != "", _ymd(y, m, d))


def day_first_all(text: Column) -> Column:
    """Every ``dd.mm.yyyy`` in a text, kept as text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DAY_FIRST), 0)


def worded_date(text: Column) -> Column:
    """First ``20 августа 2026`` in a text as a date."""
    shape = f"(?iu)(\\d{{1,2}}){SPACE_CLASS}+([а-я]+){SPACE_CLASS}+(\\d{{4}})"
    day, word, year = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(word))
    return F.when(month > 0, _ymd(year, month.cast("string"), day))


def date_words(day: Column) -> Column:
    """A date in words and digits, so that both can be searched."""
    word = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))
    return F.when(
        day.isNotNull(),
        F.concat_ws(" ", F.dayofmonth(day).cast("string"), word, F.year(day).cast("string"), F.date_format(day, "dd.MM.yyyy")),
    ).otherwise(F.lit(""))


def serial_date(cell: Column, minimum: int = SERIAL_MIN) -> Column:
    """Spreadsheet day number as a date; numbers out of range are not dates."""
    n = cell.try_cast("double")
    return F.when((n >= minimum) & (n <= SERIAL_MAX), F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(n).cast("int")))


def any_date(cell: Column, minimum: int = SERIAL_MIN) -> Column:
    """A serial when the cell is a number, else the first day-first date."""
    return F.coalesce(serial_date(cell, minimum), day_first_date(cell))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def exact_or_before(text: Column) -> Column:
    """``2026-08-28`` is exact; ``<2026-05`` only says 'before'; the other field stays empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.struct(
        iso_date(t).alias("exact"),
        F.regexp_extract(t, "^<(\\d{4}(?:-\\d{2}(?:-\\d{2})?)?)$", 1).alias("before"),
    )


def two_of_three(a: Column, b: Column) -> Column:
    """Equal ``dd.mm.yyyy`` texts, or two of the three parts agree."""
    shape = "^\\d{2}\\.\\d{2}\\.\\d{4}$"
    pa, pb = F.split(a, "\\."), F.split(b, "\\.")
    agree = sum((F.get(pa, F.lit(i)) == F.get(pb, F.lit(i))).cast("int") for i in range(3))
    return (a != "") & (b != "") & ((a == b) | (a.rlike(shape) & b.rlike(shape) & (agree >= 2)))
