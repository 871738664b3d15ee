"""Inventories of series and studies from slice headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicelake.functions.geometry import dot, normal_of, plane_of

c = F.col


def slice_order(instances: DataFrame) -> DataFrame:
    """Adds k, the slice's index by position along the normal; never by instance number."""
    return instances.withColumn("k", (F.row_number().over(Window.partitionBy("series_uid").orderBy("z", "sop_uid")) - 1).cast("int"))


def slice_gaps(instances: DataFrame) -> DataFrame:
    """Adds gap, the distance to the slice before."""
    return slice_order(instances).withColumn("gap", c("z") - F.lag("z").over(Window.partitionBy("series_uid").orderBy("k")))


def with_spacing(instances: DataFrame) -> DataFrame:
    """Adds k, gap, and for each series n and dz: the median gap, or the thickness of a single slice. One shuffle, by series."""
    w = Window.partitionBy("series_uid")
    rows = slice_gaps(instances).withColumns({"n": F.count("*").over(w), "mid": F.percentile("gap", F.lit(0.5)).over(w), "thick": F.min_by("slice_thickness", "path").over(w)})
    return rows.withColumn("dz", F.when(c("n") > 1, c("mid")).otherwise(c("thick"))).drop("mid", "thick")


def slice_spacing(instances: DataFrame) -> DataFrame:
    """(series_uid, n, dz) of each series."""
    return with_spacing(instances).groupBy("series_uid").agg(F.first("n").alias("n"), F.first("dz").alias("dz"))


def gap_facts() -> list[Column]:
    """Aggregates over a series' rows of with_spacing(): duplicates, missing slices, and irregular spacing by a strict and by an advisory rule."""
    off = F.abs(c("gap") - c("dz")) > F.greatest(F.lit(0.05), c("dz") * 0.02)
    return [
        F.first("dz").alias("dz"), F.count_if(c("gap") <= 1e-4).alias("duplicates"), F.count_if(c("gap") > 1.5 * c("dz")).alias("missing"), F.coalesce(F.bool_or(off), F.lit(False)).alias("strict_bad"),
        F.coalesce(F.max("gap") - F.min("gap") > 0.05 * F.first("dz") + 1e-3, F.lit(False)).alias("advisory_bad"),
    ]


def spacing_gaps(instances: DataFrame) -> DataFrame:
    """One row for each series: its slices, spacing, and what is wrong with it."""
    return with_spacing(instances).groupBy("series_uid").agg(F.first("n").alias("n"), *gap_facts())


def first_header(*columns: str) -> Column:
    """Attributes of a series as a struct, from its first header in path order."""
    return F.min_by(F.struct(*columns), F.struct("path", "sop_uid")).alias("header")


def series_inventory(instances: DataFrame) -> DataFrame:
    """One row for each series: counts, matrix, spacing, coverage, acquisition facts by modality, and what is wrong with its geometry."""
    kept = ("study_uid", "modality", "series_number", "n_rows", "n_cols", "row_sp", "slice_thickness", "rescale_slope", "units", "decay_correction", "patient_weight", "te", "tr", "ti", "iop")
    rows = with_spacing(instances).groupBy("series_uid").agg(
        first_header(*kept), F.count("*").alias("images"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.bool_or(c("number_of_frames") > 1).alias("multiframe"), F.array_join(F.sort_array(F.collect_set("folder")), ";").alias("folders"), *gap_facts()
    )
    rows = rows.select("*", "header.*").withColumn("plane", plane_of(c("iop"))).drop("iop", "header")
    rows = rows.withColumn("coverage_mm", c("z_max") - c("z_min"))
    for modality, names in (("CT", ["rescale_slope"]), ("PT", ["units", "decay_correction", "patient_weight"]), ("MR", ["te", "tr", "ti"])):
        rows = rows.withColumns({x: F.when(c("modality") == modality, c(x)) for x in names})
    return rows


def common_folder(folders: Column) -> Column:
    """The longest path that all of an array of paths begin with."""
    split = F.transform(folders, lambda x: F.split(x, "/"))
    least = F.array_min(F.transform(split, lambda x: F.size(x)))
    first = F.get(split, 0)
    same = F.filter(F.sequence(F.lit(1), least), lambda i: F.forall(split, lambda x: F.slice(x, 1, i) == F.slice(first, 1, i)))
    return F.array_join(F.slice(first, 1, F.coalesce(F.array_max(same), F.lit(0))), "/")


def study_cards(instances: DataFrame) -> DataFrame:
    """One row for each study: folder, dates, whether they agree, modalities, counts, and whether it is supported."""
    rows = instances.groupBy("study_uid").agg(
        common_folder(F.sort_array(F.collect_set("folder"))).alias("folder"), F.min("study_date").alias("date"), (F.count_distinct("study_date") > 1).alias("dates_differ"), F.sort_array(F.collect_set("modality")).alias("modality_list"), F.count_distinct("series_uid").alias("series"), F.count("*").alias("images")
    )
    return rows.withColumn("supported", supported(c("modality_list"))).withColumn("modalities", F.array_join("modality_list", ",")).drop("modality_list")


def supported(modalities: Column) -> Column:
    return F.arrays_overlap(modalities, F.array(F.lit("CT"), F.lit("MR"), F.lit("PT")))


def distinct_dimensions(instances: DataFrame) -> DataFrame:
    """Distinct sequence names and b-values of each series and the number of stacks that they split it into."""
    rows = instances.groupBy("series_uid").agg(F.array_join(F.sort_array(F.collect_set("sequence_name")), ",").alias("sequences"), F.array_join(F.transform(F.sort_array(F.collect_set("b_value")), lambda b: b.cast("int").cast("string")), ",").alias("b_values"), F.count_distinct(F.struct("sequence_name", "te", "ti", "b_value")).alias("stacks"))
    return rows


def stack_split(instances: DataFrame) -> DataFrame:
    """Adds stack, the number of a slice's acquisition within its series."""
    order = Window.partitionBy("series_uid").orderBy(F.struct("sequence_name", "te", "ti", "b_value"))
    return instances.withColumn("stack", F.dense_rank().over(order))


def select_series(series: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolves (request, study_uid, wanted) by series UID first, else by number; status ok, not_found or ambiguous."""
    by_uid = requests.join(series.select("study_uid", c("series_uid").alias("wanted"), c("series_uid").alias("a")), ["study_uid", "wanted"], "left")
    by_number = series.groupBy("study_uid", c("series_number").alias("wanted")).agg(F.count_distinct("series_uid").alias("n"), F.min("series_uid").alias("b"))
    rows = by_uid.join(by_number, ["study_uid", "wanted"], "left")
    status = F.when(c("a").isNotNull(), "ok").when(c("n").isNull(), "not_found").when(c("n") > 1, "ambiguous").otherwise("ok")
    return rows.select("request", status.alias("status"), F.coalesce("a", F.when(c("n") == 1, c("b"))).alias("series_uid"))


def redact(df: DataFrame, on: bool = True) -> DataFrame:
    return df.withColumns({x: F.lit("<redacted>") for x in ("accession", "patient_id", "institution")}) if on else df


def sample_slices(slices: DataFrame, spacing: DataFrame, step_mm: float, z_min: float, z_max: float) -> DataFrame:
    """Every max(1, round(step / dz))-th slice, then the z range, both ends in."""
    stride = F.greatest(F.lit(1), F.bround(F.lit(step_mm) / c("dz")).cast("int"))
    rows = slices.join(spacing.select("series_uid", "dz"), "series_uid")
    return rows.where((c("k") % F.when(c("dz") > 0, stride).otherwise(1) == 0) & c("z").between(z_min, z_max)).drop("dz")


def reject_reasons(instances: DataFrame) -> DataFrame:
    """(series_uid, reason) of each series that can't be measured; several reasons are several rows."""
    reasons = F.array(
        F.when(c("number_of_frames") > 1, "multi-frame"), F.when(~c("photometric").isin("MONOCHROME1", "MONOCHROME2"), "colour"), F.when(c("iop").isNull(), "geometry missing"), F.when((c("modality") == "CT") & (c("rescale_slope").isNull() | c("rescale_intercept").isNull()), "calibration missing")
    )
    return instances.select("series_uid", F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason")).distinct()


def repeated_acquisitions(series: DataFrame) -> DataFrame:
    """Later series of a study with the signature of an earlier one, with that one's number; nulls are equal."""
    order = [c("series_number").try_cast("int").isNull(), c("series_number").try_cast("int"), c("series_number"), c("series_uid")]
    w = Window.partitionBy("study_uid", "sequence_name", "tr", "te", "ti", "image_types").orderBy(*order)
    return series.withColumn("first_uid", F.first("series_uid").over(w)).withColumn("repeat_of", F.first("series_number").over(w)).where("first_uid <> series_uid").select("series_uid", "repeat_of")


def natural_series_order(series: DataFrame) -> DataFrame:
    """Adds place: numeric series numbers first by value, then the others by text."""
    number = c("series_number").try_cast("int")
    return series.withColumn("place", F.row_number().over(Window.partitionBy("study_uid").orderBy(number.isNull(), number, "series_number", "series_uid")))


def series_cards(instances: DataFrame) -> DataFrame:
    """A row for each series as a picker shows it: geometry note and whether it can be drawn."""
    rows = with_spacing(instances).groupBy("series_uid").agg(first_header("study_uid", "modality", "series_number"), F.count("*").alias("images"), F.bool_or(c("number_of_frames") > 1).alias("multi"), F.bool_and(c("iop").isNotNull()).alias("placed"), *gap_facts())
    note = F.when(~c("placed"), "unknown").when(c("advisory_bad") | ~(c("dz") > 0), "irregular").otherwise("regular")
    return rows.select("series_uid", "header.study_uid", "header.modality", "header.series_number", "images", note.alias("geometry"), (~c("multi") & c("placed")).alias("renderable"))


def tilt_fit(instances: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(series_uid, shear_x, shear_y, shear_z, tilt_deg, row_drift, col_drift, status): how far the slice origins of each series stray from the line along its own normal.

    Positions are the origins' projections on the normal of the first header in path order; the residual of a slice is the
    3-vector from the normal line through the first position to its origin. Shear, in mm a mm, is the least-squares
    solution of residual = distance * shear by summed normal equations. Drifts are pixels a slice along columns (row_drift)
    and rows (col_drift) of the image at the median spacing. A series whose residuals all lie within ``tolerance``
    in each coordinate is straight and has no shear; one whose residuals are a line to within it is tilted, any other not a line; one whose
    headers differ in orientation is mixed. Headers without orientation or position take no part. One shuffle, by series.
    """
    w = Window.partitionBy("series_uid")
    kept = instances.where("iop is not null and ipp_x is not null and ipp_y is not null and ipp_z is not null")
    head = F.min_by(F.struct("iop", "row_sp", "col_sp"), F.struct("path", "sop_uid")).over(w)
    rows = kept.select("series_uid", "sop_uid", "iop", F.array("ipp_x", "ipp_y", "ipp_z").alias("at"), head.alias("head"))
    n = normal_of(c("head.iop"))
    rows = rows.withColumn("along", dot([c("at")[i] for i in range(3)], n))
    first = F.min_by("at", F.struct("along", "sop_uid")).over(w)
    in_order = w.orderBy("along", "sop_uid")
    turned = F.exists(F.zip_with("iop", "head.iop", lambda x, y: F.abs(x - y)), lambda x: x > 1e-4)
    rows = rows.withColumns({"d": c("along") - F.min("along").over(w), "first": first, "gap": c("along") - F.lag("along").over(in_order), "turned": turned})
    rows = rows.withColumns({f"r{i}": c("at")[i] - c("first")[i] - c("d") * n[i] for i in range(3)})
    ss = F.sum(c("d") * c("d")).over(w)
    rows = rows.withColumns({f"s{i}": F.when(ss > 0, F.sum(c("d") * c(f"r{i}")).over(w) / ss).otherwise(0.0) for i in range(3)})
    off = lambda f: F.greatest(*[F.abs(f(i)) for i in range(3)])
    fit = rows.groupBy("series_uid").agg(
        F.first("head").alias("head"), *[F.first(f"s{i}").alias(f"s{i}") for i in range(3)], F.bool_or("turned").alias("turned"), F.max(off(lambda i: c(f"r{i}"))).alias("off"),
        F.max(off(lambda i: c(f"r{i}") - c("d") * c(f"s{i}"))).alias("rest"), F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(0.0)).alias("dz"),
    )
    tilted = c("off") > tolerance
    status = F.when(c("turned"), "mixed").when(~tilted, "straight").when(c("rest") <= tolerance, "tilted").otherwise("not a line")
    shear = [F.when(tilted, c(f"s{i}")).otherwise(0.0) for i in range(3)]
    drift = lambda at, spacing: dot(shear, [c("head.iop")[at + i] for i in range(3)]) * c("dz") / c(spacing) + 0.0
    return fit.select(
        "series_uid", *[x.alias(f"shear_{a}") for x, a in zip(shear, "xyz", strict=True)], F.degrees(F.atan(F.sqrt(dot(shear, shear)))).alias("tilt_deg"),
        drift(3, "head.row_sp").alias("row_drift"), drift(0, "head.col_sp").alias("col_drift"), status.alias("status"),
    )


def inventory_lines(inventory: DataFrame) -> DataFrame:
    """A Markdown table row for each series; cells by modality."""
    cell = F.when(c("modality") == "CT", F.concat(F.lit("slope "), F.coalesce(c("rescale_slope").cast("int").cast("string"), F.lit("?")))).when(c("modality") == "PT", F.concat_ws(" ", "units", "decay_correction")).otherwise(F.concat(F.lit("TE "), F.coalesce(c("te").cast("int").cast("string"), F.lit("?"))))
    return inventory.select("series_uid", F.concat(F.lit("| "), F.concat_ws(" | ", "series_number", "modality", c("images").cast("string"), "plane", cell), F.lit(" |")).alias("line"))
