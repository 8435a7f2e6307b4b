"""Scalar text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(file: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")


def suffix(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"(?<=.)(\.[^.]*)$", 1))


def csv_cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def day(ms: Column) -> Column:
    """Date of epoch milliseconds in the session's zone, a dash for null."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.lit("—"))


def iso_date(text: Column) -> Column:
    """The date of a strict ISO string, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def clean_number(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)
