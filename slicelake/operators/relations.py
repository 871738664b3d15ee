"""Joins, windows and set operations over slices, series, claims and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def dangling_refs(refs: DataFrame, sops: DataFrame) -> DataFrame:
    """References whose slice is unknown in its series."""
    return refs.join(sops.select("series_uid", "sop_uid"), ["series_uid", "sop_uid"], "left_anti")


def unread_slices(sops: DataFrame, passes: DataFrame, covered: DataFrame, skipped: DataFrame) -> DataFrame:
    """(series_uid, sop_uid, purpose) that a pass requires, that no reviewed page covers and that no scope skips."""
    need = sops.select("series_uid", "sop_uid").join(passes, "series_uid")
    keys = ["series_uid", "sop_uid", "purpose"]
    return need.join(covered.select(*keys), keys, "left_anti").join(skipped.select(*keys), keys, "left_anti")


def nearest_slice(requests: DataFrame, slices: DataFrame, key: str = "series_uid") -> DataFrame:
    """For each (request, key, at) the slice nearest in z, the first of equal ones; none further out than half a spacing.

    ``slices`` has key, k, z and dz. Requests and slices of a series are ordered together, and each request takes the
    last slice before it or the first after it, so that the work is that of sorting them, not of all their pairs.
    """
    places = slices.groupBy(key, c("z").alias("at")).agg(F.min("k").alias("k"), F.max("dz").alias("dz"))
    asked = requests.select("request", key, "at").distinct().withColumn("asks", F.lit(1))
    rows = places.withColumn("asks", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    of, slice_ = Window.partitionBy(key), F.when(c("asks") == 0, F.struct("at", "k"))
    so_far = lambda *order: F.last(slice_, ignorenulls=True).over(of.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"low": so_far("at", "asks"), "high": so_far(c("at").desc(), "asks"), "first": F.min(slice_["at"]).over(of), "last": F.max(slice_["at"]).over(of), "half": F.max("dz").over(of) / 2})
    rows = rows.where((c("asks") == 1) & (c("at") >= c("first") - c("half")) & (c("at") <= c("last") + c("half")))
    below, above = c("at") - c("low.at"), c("high.at") - c("at")
    k = F.when(c("low").isNull() | (above < below), c("high.k")).when(c("high").isNull() | (below < above), c("low.k")).otherwise(F.least("low.k", "high.k"))
    return rows.select("request", key, "at", k.alias("k"))


def attach_series(refs: DataFrame, series: DataFrame) -> DataFrame:
    """References with their series' study and modality."""
    return refs.join(series, "series_uid").select("sop_uid", "study_uid", "modality")


def slice_by_instance(slices: DataFrame, wanted: list[int]) -> DataFrame:
    """(series_uid, wanted, k, status) for each series and wanted instance number: the first slice of that number."""
    asked = slices.select("series_uid").distinct().withColumn("wanted", F.explode(F.array(*map(F.lit, wanted))))
    found = slices.groupBy("series_uid", c("instance_number").alias("wanted")).agg(F.min("k").alias("k"))
    return asked.join(found, ["series_uid", "wanted"], "left").withColumn("status", F.when(c("k").isNull(), "missing").otherwise("ok"))


def locate_point(nearest: DataFrame, points: DataFrame) -> DataFrame:
    """(request, k, row_at, col_at) of points (request, ipp_x, ipp_y, row_sp, col_sp) on their nearest slices."""
    return nearest.select("request", "k").join(points, "request").select("request", "k", F.bround(c("ipp_y") / c("row_sp")).cast("int").alias("row_at"), F.bround(c("ipp_x") / c("col_sp")).cast("int").alias("col_at"))


def fusion_positions(pairs: DataFrame, slices: DataFrame, step: float = 1.0, zmin: float | None = None, zmax: float | None = None) -> DataFrame:
    """(a_uid, b_uid, z, ka, kb): places ``step`` apart from the top of what two series share, within ``zmin`` and ``zmax`` where given, and the slice of each that is nearest."""
    pairs = pairs if zmin is None else pairs.withColumn("lo", F.greatest("lo", F.lit(float(zmin))))
    pairs = (pairs if zmax is None else pairs.withColumn("hi", F.least("hi", F.lit(float(zmax))))).where("lo <= hi")
    places = F.transform(F.sequence(F.lit(0), F.floor((c("hi") - c("lo")) / step).cast("int")), lambda i: c("hi") - i * step)
    rows = pairs.withColumn("z", F.explode(places)).select("a_uid", "b_uid", "z")
    for key, name in (("a_uid", "ka"), ("b_uid", "kb")):
        asked = rows.select(c("z").alias("request"), key, c("z").alias("at"))
        near = nearest_slice(asked, slices.select(c("series_uid").alias(key), "k", "z", F.lit(0.0).alias("dz")), key)
        rows = rows.join(near.select(key, c("at").alias("z"), c("k").alias(name)), [key, "z"])
    return rows.select("a_uid", "b_uid", "z", "ka", "kb")


def pair_modalities(series: DataFrame, a: str = "PT", b: str = "CT") -> DataFrame:
    """Series of two modalities with the same study and the same non-empty frame, whose z ranges overlap."""
    x = series.where((c("modality") == a) & (c("frame_uid") != "")).select("study_uid", "frame_uid", c("series_uid").alias("a_uid"), c("z_min").alias("a_lo"), c("z_max").alias("a_hi"))
    y = series.where(c("modality") == b).select("study_uid", "frame_uid", c("series_uid").alias("b_uid"), c("z_min").alias("b_lo"), c("z_max").alias("b_hi"))
    return x.join(y, ["study_uid", "frame_uid"]).where(F.greatest("a_lo", "b_lo") < F.least("a_hi", "b_hi")).select("a_uid", "b_uid", F.greatest("a_lo", "b_lo").alias("lo"), F.least("a_hi", "b_hi").alias("hi"))


def pair_sequences(series: DataFrame, *carried: str) -> DataFrame:
    """Pairs (pre, post) of MR series of a patient, earlier and later, with equal non-empty frame and matrix, and orientation and both spacings within a tolerance. ``carried`` columns come along as name1 of the earlier and name2 of the later series."""
    cols = ("patient_id", "frame_uid", "n_rows", "n_cols")
    own = lambda uid, n: series.where(c("frame_uid") != "").select(*cols, c("series_uid").alias(uid), c("row_sp").alias(f"r{n}"), c("col_sp").alias(f"c{n}"), *[F.get("iop", F.lit(i)).alias(f"o{n}{i}") for i in range(6)], c("study_date").alias(f"d{n}"), *[c(x).alias(f"{x}{n}") for x in carried])
    close = reduce(Column.__and__, [F.abs(c(f"o1{i}") - c(f"o2{i}")) <= 1e-4 for i in range(6)])  # numbers of their own, compared in generated code
    alike = lambda x: F.abs(c(f"{x}1") - c(f"{x}2")) <= 1e-8 + 1e-5 * F.abs(f"{x}2")
    later = F.struct("d1", "pre") < F.struct("d2", "post")
    return own("pre", 1).join(own("post", 2), list(cols)).where(later & alike("r") & alike("c") & close).select("pre", "post", *[f"{x}{n}" for x in carried for n in (1, 2)])


def packed_slices(slices: DataFrame) -> DataFrame:
    """(series_uid, slices, reach): the slices (series_uid, k, x, y, z, dz) of each series as an array, and how far a match may be from one of them."""
    return slices.groupBy("series_uid").agg(F.collect_list(F.struct("k", "x", "y", "z")).alias("slices"), F.max(F.greatest(F.lit(0.5), c("dz") / 2)).alias("reach"))  # equal for all slices of a series


def match_packed(pairs: DataFrame) -> DataFrame:
    """match_slices() of pairs that carry the packed slices of both series (pre, post, slices1, slices2, reach2). A pair is worked out within its row: nothing is shuffled, and memory holds the slices of two series."""
    off = lambda s, t: F.sqrt(sum(F.pow(s[a] - t[a], F.lit(2)) for a in "xyz"))
    placed = F.filter("slices2", lambda t: t["x"].isNotNull() & t["y"].isNotNull() & t["z"].isNotNull())
    nearest = lambda s: F.array_min(F.transform("placed", lambda t: F.struct(off(s, t).alias("off_mm"), t["k"].alias("kb"))))
    rows = pairs.withColumn("placed", placed).withColumn("found", F.transform("slices1", lambda s: F.struct(s["k"].alias("k"), nearest(s).alias("best"))))
    within = lambda x: x["best"]["off_mm"] <= c("reach2")
    rows = rows.select("pre", "post", F.coalesce(F.forall("found", within), F.lit(False)).alias("aligned"), "reach2", F.explode("found").alias("f"))
    return rows.select("pre", "post", c("f.k").alias("k"), F.when(within(c("f")), c("f.best.kb")).alias("kb"), F.when(within(c("f")), c("f.best.off_mm")).alias("off_mm"), "aligned")


def match_slices(pairs: DataFrame, slices: DataFrame) -> DataFrame:
    """(pre, post, k, kb, off_mm, aligned) of each slice of ``pre`` and the slice of ``post`` whose origin is nearest, the first of equal ones; kb is null where none is within reach.

    ``slices`` (series_uid, k, x, y, z, dz) have origins in mm. A match needs a distance of at most max(0.5, dz / 2), dz of the
    later series. A pair one of whose slices has no match is not aligned: it asks for a registration. Where pairs are made of series
    anyway, pair_sequences() can carry packed_slices() for match_packed(), which spares the shuffles of the pairs.
    """
    packed = packed_slices(slices)
    of = lambda uid, n: packed.select(c("series_uid").alias(uid), *[c(x).alias(f"{x}{n}") for x in ("slices", "reach")])
    return match_packed(pairs.join(of("post", 2), "post").join(of("pre", 1), "pre"))


def claim_study_grid(claims: DataFrame, studies: DataFrame, timeline: DataFrame) -> DataFrame:
    """Every claim of a session with every study of the session; status from the timeline, else not_covered."""
    return claims.join(studies, "session_id").join(timeline, ["claim_id", "study_uid"], "left").withColumn("status", F.coalesce("status", F.lit("not_covered")))


def page_attested(pages: DataFrame, sources: DataFrame, sheets: DataFrame, sops: DataFrame) -> DataFrame:
    """(page_id, attested, reason): a page counts if its sheet was shown, or if all its source slices were."""
    shown = sources.join(sops.select("sop_uid").distinct().withColumn("seen", F.lit(True)), "sop_uid", "left")
    counts = shown.groupBy("page_id").agg(F.count("*").alias("n"), F.count("seen").alias("seen"))
    sheet = sheets.select("page_id").distinct().withColumn("sheet", F.lit(True))
    rows = pages.join(sheet, "page_id", "left").join(counts, "page_id", "left")
    reason = F.when(c("sheet"), "sheet displayed").when(c("n").isNull(), "no sources").when(c("n") == c("seen"), F.concat(F.lit("all "), c("n").cast("string"), F.lit(" displayed"))).otherwise(F.concat((c("n") - c("seen")).cast("string"), F.lit(" of "), c("n").cast("string"), F.lit(" missing")))
    return rows.select("page_id", F.coalesce(c("sheet") | (c("n") == c("seen")), F.lit(False)).alias("attested"), reason.alias("reason"))


def audit_match(review: DataFrame, truth: DataFrame, disclosed: DataFrame) -> DataFrame:
    """(patient, site, status, leaked): matched, matched (leaked), partial, missed or overcalled.

    Rows have patient, site, kind and size in mm. A nodule matches within 2 mm, any other kind of the truth within a fifth of its size;
    another kind is partial. ``disclosed`` (patient, site) are facts that were known before the reading: a match on one proves less.
    """
    own = review.select("patient", "site", c("kind").alias("own_kind"), c("size").alias("own"))
    rows = own.join(truth.select("patient", "site", "kind", c("size").alias("true")), ["patient", "site"], "full_outer")
    rows = rows.join(disclosed.select("patient", "site").distinct().withColumn("known", F.lit(True)), ["patient", "site"], "left").withColumn("leaked", F.coalesce("known", F.lit(False)))
    close = (c("own_kind") == c("kind")) & (F.abs(c("own") - c("true")) <= F.when(c("kind") == "nodule", 2.0).otherwise(0.2 * c("true")))
    status = F.when(c("true").isNull(), "overcalled").when(c("own").isNull(), "missed").when(close & c("leaked"), "matched (leaked)").when(close, "matched").otherwise("partial")
    return rows.select("patient", "site", status.alias("status"), "leaked")


def identity_documents(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Documents and how many of the names they hold, with those missing; ``names`` is a request's list, an array, on each row."""
    rows = docs.join(names, "request")
    gone = F.filter("names", lambda n: ~F.contains(c("text"), n))
    return rows.select("doc_id", (F.size(gone) == 0).alias("complete"), F.array_join(gone, ",").alias("missing"))


def chronology(studies: DataFrame, key: str = "session_id") -> DataFrame:
    """Adds place, a study's rank by date, time and uid."""
    return studies.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("study_date", "study_key")))


def best_measurement(measures: DataFrame) -> DataFrame:
    """For each claim and study the longest value, in mm if any is."""
    w = Window.partitionBy("claim_id", "study_uid").orderBy((c("unit") == "mm").desc(), c("value").desc())
    return measures.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def measured_change(measures: DataFrame) -> DataFrame:
    """First and last value of each claim, where their units agree, with the change and the change in percent."""
    by = F.struct("study_date", "study_key")
    rows = measures.groupBy("claim_id").agg(F.min_by("value", by).alias("first"), F.max_by("value", by).alias("last"), F.min_by("unit", by).alias("u1"), F.max_by("unit", by).alias("unit"), F.count("*").alias("n"))
    delta = c("last") - c("first")
    return rows.where("n > 1 and u1 = unit").select("claim_id", "first", "last", "unit", delta.alias("delta"), F.when(c("first") != 0, 100 * delta / c("first")).alias("percent"))


def latest_state(edits: DataFrame, key: str, at: Column) -> DataFrame:
    """The last edit of each key."""
    return edits.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(at.desc()))).where("place = 1").drop("place")


def bounded_log(events: DataFrame, key: str, n: int) -> DataFrame:
    """The last n entries of each key."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(c("ts").desc(), c("event_id").desc()))).where(c("place") <= n)


def within_budget(pages: DataFrame, limit: int) -> DataFrame:
    """Adds kept: whether a page is in the longest prefix whose encoded sizes (four thirds of the file's) fit the limit."""
    size = F.ceil(c("bytes") * 4 / 3)
    return pages.withColumn("kept", F.sum(size).over(Window.partitionBy("session_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)) <= limit)


def paginate(items: DataFrame, key: str, order: str, per_page: int) -> DataFrame:
    """Adds page and slot in reading order."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return items.withColumn("i", i).withColumn("page", F.floor(c("i") / per_page).cast("int")).withColumn("slot", (c("i") % per_page).cast("int")).drop("i")
