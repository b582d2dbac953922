"""Typing of wide-sheet cells: statuses, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tariffa import fixed_values as fv
from tariffa.functions.text import case, col, decimal, strip


def number(c) -> Column:
    """Text or number to double; anything else, and NaN, to null."""
    return decimal(strip(col(c).cast("string")))


def typed_cell(c) -> Column:
    """struct(rate_usd, availability_status, los_restriction) of one mixed cell.

    Sheets are read as text, so numeric text counts as a price. Zero and blank mean
    that nothing was quoted. A word outside the known list keeps its text behind a
    prefix, so it can be counted instead of being lost.
    """
    raw = strip(col(c).cast("string"))
    low = F.lower(raw)
    price = decimal(raw)
    is_price = price.isNotNull() & (price != 0)
    nights = F.regexp_extract(raw, fv.LOS_WORD, 1)
    status = case(
        [(raw.isNull() | (raw == "") | (low == "nan") | (price == 0), "blank"), (is_price, "available")]
        + [(low == word, name) for word, name in fv.STATUS_WORDS]
        + [(raw == fv.NOT_LOADED_MARK, "not_loaded"), (nights != "", "los_restricted")],
        F.concat(F.lit(fv.UNKNOWN_STATUS_PREFIX), raw),
    )
    return F.struct(
        F.when(is_price, price).alias("rate_usd"),
        status.alias("availability_status"),
        F.when(nights != "", nights.try_cast("int")).alias("los_restriction"),
    )


def sheet_date(c) -> Column:
    """Serial day number or date text to a date; blank, zero and other text to null."""
    raw = strip(col(c).cast("string"))
    serial = decimal(raw)
    known = F.when(serial.between(-600_000, 2_958_465) & (serial != 0), serial)  # up to year 9999
    day = F.date_add(F.lit(fv.SERIAL_DAY_ORIGIN).cast("date"), F.floor(known).cast("int"))
    return F.when(serial.isNull(), raw.try_cast("date")).otherwise(day)


def day_label(label, date) -> Column:
    """The given weekday text, trimmed; without one, the short English name of the date."""
    return F.coalesce(F.nullif(strip(label), F.lit("")), F.date_format(col(date), "EEE"))


def updated_day(stamp, file_time) -> Column:
    """Day and month of an 'Updated dd/mm hh:mm' stamp, with the year of the file.

    A day more than 90 days after the file time belongs to the year before. An
    impossible day gives null.
    """
    def of_year(year):
        parts = [F.lpad(year.cast("string"), 4, "0")] + [
            F.lpad(F.regexp_extract(col(stamp), fv.SHEET_UPDATED_PATTERN, g), 2, "0") for g in (2, 1)
        ]
        return F.concat_ws("-", *parts).try_cast("date")

    year = F.year(col(file_time))
    this_year = of_year(year)
    too_late = this_year.cast("timestamp") > col(file_time) + F.expr("INTERVAL 90 DAYS")
    return F.when(col(stamp).isNull(), F.lit(None).cast("date")).when(too_late, of_year(year - 1)).otherwise(this_year)


def iso_year(date) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(date))


def weekday(date) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(col(date))
