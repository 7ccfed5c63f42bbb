"""Tolerant parsing of published text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(col: Column) -> Column:
    """Finite number or null; anything that is not plainly numeric (NaN too) is null."""
    text = F.trim(col)
    return F.when(text.rlike(NUMBER), text.cast("double"))


def num_sentinel(col: Column) -> Column:
    text = F.trim(col)
    return F.when(~text.isin(K.NUMERIC_NULLS), number(text))


def iso_date(col: Column) -> Column:
    text = F.substring(F.trim(col), 1, 10)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def date_multi(col: Column) -> Column:
    """dd/mm/yyyy as published, or ISO."""
    text = F.trim(col)
    dmy = F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(text, "dd/MM/yyyy"))
    return F.coalesce(dmy, iso_date(text))


def quarter_date(col: Column) -> Column:
    """`2021-Q3` -> 2021-07-01."""
    year = F.regexp_extract(col, r"^(\d{4})-?Q([1-4])$", 1)
    quarter = F.regexp_extract(col, r"^(\d{4})-?Q([1-4])$", 2)
    return F.when(year != "", F.make_date(
        year.try_cast("int"), (quarter.try_cast("int") - 1) * 3 + 1, F.lit(1)))


def price_text(col: Column) -> Column:
    value = number(F.regexp_replace(col, "[^0-9.]", ""))
    return F.when(value > 0, value)


def sale_year(col: Column) -> Column:
    tail = F.trim(F.element_at(F.split(col, "/"), -1))
    return F.when(tail.rlike(r"^\d+$"), tail.try_cast("int"))


def month_no(col: Column) -> Column:
    """Months since year zero; differences ignore the day of month."""
    return F.year(col) * 12 + F.month(col)
