"""Dates and times as text, in the forms YYYYMMDD, HHMMSS.frac and YYYYMMDDHHMMSS.frac&ZZXX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_da_tm(date: Column | str, time: Column | str) -> Column:
    """Timestamp of a date and a time; the time is filled with zeros on the right, a missing date is 1900-01-01, what can't be read is null."""
    date, time = _c(date), _c(time)
    whole = F.substring(F.rpad(F.substring_index(time, ".", 1), 6, "0"), 1, 6)
    day = F.substring(F.coalesce(F.nullif(date, F.lit("")), F.lit("19000101")), 1, 8)
    fraction = F.when(F.instr(time, ".") > 0, F.concat(F.lit("0."), F.substring_index(F.substring_index(time, ".", 2), ".", -1)).try_cast("double")).otherwise(0.0)
    base = F.try_to_timestamp(F.concat(day, whole), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return F.when(time.isNotNull() & (time != ""), base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(fraction, F.lit(0.0)).cast("decimal(18,6)")))


def parse_dt(value: Column | str) -> Column:
    """Timestamp of a combined value; the offset is dropped, a date alone is midnight, fewer than eight characters are null."""
    value = _c(value)
    rest = F.regexp_extract(F.substring(value, 9, 100), "^([^+-]*)", 1)
    return F.when(F.length(value) >= 8, parse_da_tm(F.substring(value, 1, 8), F.when(rest == "", F.lit("000000")).otherwise(rest)))


def shift_date(value: Column | str, days: Column | int) -> Column:
    """The first eight digits moved by ``days``; what follows stays, and so does what is no date."""
    value = _c(value)
    day = F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd")
    return F.when(value.rlike("^[0-9]{8}") & day.isNotNull(), F.concat(F.date_format(F.date_add(day, days), "yyyyMMdd"), F.substring(value, 9, 1000))).otherwise(value)


def short_date(value: Column | str) -> Column:
    """DD.MM.YYYY of a YYYYMMDD value; others pass, empty ones are a dash."""
    value = _c(value)
    return F.when(value.rlike("^[0-9]{8}$"), F.concat_ws(".", F.substring(value, 7, 2), F.substring(value, 5, 2), F.substring(value, 1, 4))).otherwise(F.coalesce(F.nullif(value, F.lit("")), F.lit("—")))


def long_date(value: Column | str, months: list[str]) -> Column:
    """Day, month name and year of a YYYYMMDD value."""
    value = _c(value)
    name = F.element_at(F.array(*map(F.lit, months)), F.greatest(F.lit(1), F.least(F.lit(12), F.substring(value, 5, 2).try_cast("int"))))
    return F.when(value.rlike("^[0-9]{4}(0[1-9]|1[0-2])[0-9]{2}$"), F.concat_ws(" ", F.substring(value, 7, 2).cast("int").cast("string"), name, F.substring(value, 1, 4))).otherwise(value)


def months_between(a: Column | str, b: Column | str) -> Column:
    """Days from a to b over 30.44, null unless positive."""
    days = F.datediff(F.try_to_date(_c(b), "yyyyMMdd"), F.try_to_date(_c(a), "yyyyMMdd"))
    return F.when(days > 0, days / 30.44)
