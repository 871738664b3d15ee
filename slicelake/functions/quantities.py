"""Calibrated quantities: rescaled values, lean body mass, uptake factors, diameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicelake.functions.dates import parse_da_tm, parse_dt


def rescale(v: Column, slope: Column, intercept: Column) -> Column:
    return v * slope + intercept


def voi_window(v: Column, centre: Column, width: Column, invert: Column) -> Column:
    """Linear window to 0..255, truncated."""
    x = F.least(F.greatest((v - (centre - width / 2)) / width, F.lit(0.0)), F.lit(1.0)) * 255
    return F.when(invert, 255 - x).otherwise(x).cast("int")


def reported_diameter(long_: Column, short_: Column, convention: Column, kind: Column) -> tuple[Column, Column]:
    """The number that a convention asks for, and how it was chosen."""
    mean = (long_ + short_) / 2
    small = (convention == "fleischner") & (mean < 10)
    value = F.when(kind == "node", short_).when(small, mean).otherwise(long_)
    label = F.when(kind == "node", "short axis").when(small, "average of axes, under 10 mm").when(convention == "recist", "long axis, recist").otherwise("long axis, 10 mm or more")
    return value, label


def lean_body_mass(weight: Column, height: Column, sex: Column, formula: str = "janmahasatian") -> Column:
    """Kilograms; null unless weight and height are positive and sex is M or F."""
    sex = F.substring(F.upper(sex), 1, 1)
    if formula == "james":
        ratio = F.pow(weight / (height * 100), F.lit(2))
        mass = F.when(sex == "M", 1.10 * weight - 120 * ratio).when(sex == "F", 1.07 * weight - 148 * ratio)
    else:
        bmi = weight / (height * height)
        mass = F.when(sex == "M", 9270 * weight / (6680 + 216 * bmi)).when(sex == "F", 9270 * weight / (8780 + 244 * bmi))
    return F.when((weight > 0) & (height > 0), mass)


def scan_start(decay_dt: Column, series_date: Column, series_time: Column, earliest_acquisition: Column) -> tuple[Column, Column]:
    """The start of a scan and its source: the decay correction time, the earliest acquisition if before the series, the series, the acquisition."""
    fixed, series = parse_dt(decay_dt), parse_da_tm(series_date, series_time)
    early = earliest_acquisition < series
    at = F.coalesce(fixed, F.when(early, earliest_acquisition), series, earliest_acquisition)
    source = F.when(fixed.isNotNull(), "decay correction").when(early, "earliest acquisition").when(series.isNotNull(), "series").when(earliest_acquisition.isNotNull(), "acquisition")
    return at, source


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def suv_factor(start: Column, weight: Column | None = None, window: tuple[float, float] = (45.0, 90.0)) -> dict[str, Column]:
    """factor, error, warnings and uptake minutes of a PET series; one cascade, in the order in which a row can fail.

    Reads total_dose, half_life, rp_start_dt, rp_start_time, series_date, patient_weight, units,
    decay_correction, activity_scale and suv_scale; ``start`` is the scan's start. ``weight`` overrides the header.
    """
    c = F.col
    dose, half, units, decay = c("total_dose"), c("half_life"), c("units"), c("decay_correction")
    w = c("patient_weight") if weight is None else F.coalesce(weight, c("patient_weight"))
    injection = F.coalesce(parse_dt(c("rp_start_dt")), parse_da_tm(c("series_date"), c("rp_start_time")))
    uptake = _seconds(injection, start)
    counts = units == "CNTS"
    scaled = counts & c("activity_scale").isNotNull()
    given = counts & c("activity_scale").isNull() & c("suv_scale").isNotNull()
    wrong = lambda x: x.isNull() | (x <= 0) | F.isnan(x) | (x == float("inf"))
    error = (
        F.when(dose.isNull(), "no radiopharmaceutical").when(wrong(dose) | wrong(half), "invalid dose or half-life").when(w.isNull() | (w == 0), "weight missing").when(~w.between(20, 400), "implausible weight")
        .when(units == "GML", F.lit(None).cast("string")).when(given, F.lit(None).cast("string")).when(counts & ~scaled, "counts without scale").when(~scaled & (units != "BQML"), "units not supported")
        .when((decay == "START") & uptake.isNull(), "missing injection or scan start").when((decay == "START") & (uptake < 0), "injection after scan start").when(~decay.isin("START", "ADMIN"), "decay correction not supported")
    )
    at_scan = F.when(decay == "START", dose * F.exp(-math.log(2) * uptake / half)).otherwise(dose)
    factor = F.when(error.isNull(), F.when(units == "GML", 1.0).when(given, c("suv_scale")).otherwise(F.when(scaled, c("activity_scale")).otherwise(1.0) * (w * 1000.0) / at_scan))
    timed = error.isNull() & (units != "GML") & ~given
    minutes = F.when(timed, uptake / 60)
    starts = timed & (decay == "START")
    warnings = F.filter(F.array(F.when(starts & (uptake > 6 * 3600), "implausible uptake interval"), F.when(starts & ~(uptake / 60).between(*window), "uptake outside window")), lambda x: x.isNotNull())
    return {"factor": factor, "error": error, "uptake_min": minutes, "warnings": F.array_join(warnings, ";")}


def growth_flag(before: Column, after: Column, volume_before: Column, volume_after: Column) -> Column:
    """Growth at 2 mm of diameter or a quarter of volume."""
    return F.when((after - before >= 2) | (volume_after >= 1.25 * volume_before), "growth").otherwise("no measurable change")
