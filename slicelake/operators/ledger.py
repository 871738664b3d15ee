"""Integrity rules and summaries of an evidence ledger; a rule that fails is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def violations(rows: DataFrame, owner: Column, rules: dict[str, Column]) -> DataFrame:
    """(owner, rule) for each rule whose condition doesn't hold; a null condition doesn't."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return rows.select(owner.alias("owner"), F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("rule"))


def filled(x: str) -> Column:
    return F.coalesce(c(x), F.lit("")) != ""


#: What fields of a ledger may hold.
BLIND = ("not_claimed", "partial", "blinded")
REGION_STATUSES = ("finding", "no_finding", "limited", "not_covered")
PRIORITIES = ("important", "routine", "incidental")
CONFIDENCES = ("low", "moderate", "high")
UNITS = ("mm", "HU", "SUVbw", "mL", "mm2", "mm3")
COMPARISONS = ("new", "increased", "decreased", "stable", "resolved", "indeterminate", "not_comparable")
CHANGES = ("new", "increased", "decreased", "stable", "resolved")
TIMEPOINTS = ("present", "not_seen", "not_covered", "indeterminate")
OVERALL = ("compared", "limited", "not_comparable")
PATIENT_FIELDS = ("meaning", "importance", "uncertainty", "discuss_with_doctor")


def validate_session(sessions: DataFrame, languages: tuple[str, ...] = ("en", "tr")) -> DataFrame:
    """Rules of a session's own fields: rows (session, complete, reader, disclosure, blind, limits, patient_context, patient_limits, language, pages, mode, compared, compared_reason, compared_text)."""
    single = c("mode") != "comparison"
    return violations(sessions, c("session"), {
        "Reading not complete": c("complete"), "Record model/reader": filled("reader"), "Disclose prior context/leakage, even when none": filled("disclosure"), "Invalid blind status": c("blind").isin(*BLIND),
        "Record actual coverage and sensitivity limitations": filled("limits"), "Explain examination scope in plain language (patient_context)": filled("patient_context"), "Explain limitations in plain language (patient_limitations)": filled("patient_limits"),
        "Unsupported report language": c("language").isin(*languages), "No rendered pages registered": c("pages") > 0,
        "Comparison not completed": single | c("compared").isin(*OVERALL), "Comparison limitations/method missing": single | filled("compared_reason"), "Plain-language comparison explanation missing": single | filled("compared_text"),
    })


def validate_pages(pages: DataFrame, series: DataFrame) -> DataFrame:
    """Rules of pages (path, study, series, purpose, reviewed) against the known series (study, series)."""
    known = series.select("study", "series").distinct().withColumn("known", F.lit(True))
    return violations(pages.join(known, ["study", "series"], "left"), c("path"), {"Unreviewed page": c("reviewed"), "Page needs valid study and series UID": c("known"), "Page purpose missing": filled("purpose")})


def validate_series(series: DataFrame, pages: DataFrame, unread: DataFrame) -> DataFrame:
    """Rules of series (study, series, modality, disposition, checked, reason, passes); pages (study, series); and of each pass (study, series, purpose, n, scoped, basis) the slices that nothing covers."""
    shown = pages.select("study", "series").distinct().withColumn("shown", F.lit(True))
    other, image = c("disposition") != "read", c("modality").isin("CT", "MR", "PT")
    own = violations(series.join(shown, ["study", "series"], "left"), c("series"), {
        "disposition pending": c("disposition").isin("read", "excluded", "unsupported"), "read series geometry not checked": other | c("checked"), "read series has no pages": other | c("shown"),
        "read image series needs declared exhaustive passes": other | ~image | (c("passes") > 0), "excluded/unsupported series needs reason": (c("disposition") == "read") | filled("reason"),
    })
    read = unread.join(series.where("disposition = 'read'").select("study", "series"), ["study", "series"], "left_semi")
    return own.unionByName(violations(read, F.concat_ws(" ", "series", "purpose"), {"pass scope needs a stated basis": ~F.coalesce("scoped", F.lit(False)) | filled("basis"), "unread/unrendered slices": c("n") == 0}))


def validate_refs(owners: DataFrame, refs: DataFrame, series: DataFrame, slices: DataFrame) -> DataFrame:
    """Rules of the references (owner, study, series, sop, row_at, col_at) of all ``owners`` (owner), against series (study, series, disposition) and slices (study, series, sop, n_rows, n_cols)."""
    none = owners.select("owner").distinct().join(refs.select("owner"), "owner", "left_anti").select("owner", F.lit("source references missing").alias("rule"))
    rows = refs.join(series.select("study", "series", "disposition"), ["study", "series"], "left").join(slices.withColumn("known", F.lit(True)), ["study", "series", "sop"], "left")
    placed = c("known") & c("row_at").isNotNull() & c("col_at").isNotNull()
    inside = (c("row_at") >= 0) & (c("row_at") < c("n_rows")) & (c("col_at") >= 0) & (c("col_at") < c("n_cols"))
    found = violations(rows, c("owner"), {"unknown source SOP/series/study": c("known"), "referenced series has not been read": c("disposition").isNull() | (c("disposition") == "read"), "coordinates out of range": ~F.coalesce(placed, F.lit(False)) | inside})
    return none.unionByName(found)


def validate_owner_pages(owners: DataFrame, shown: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules of the pages (owner, path) that ``owners`` (owner, study; null for any) stand on, against the registered ones (path, study)."""
    none = owners.join(shown.select("owner"), "owner", "left_anti").select("owner", F.lit("inspected image pages missing").alias("rule"))
    rows = owners.join(shown, "owner").join(pages.select("path", c("study").alias("of")).withColumn("known", F.lit(True)), "path", "left")
    return none.unionByName(violations(rows, c("owner"), {"unregistered page": c("known"), "page belongs to another study": c("study").isNull() | c("known").isNull() | (c("of") == c("study"))}))


def validate_regions(regions: DataFrame, refs: DataFrame, shown: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules of regions (owner, study, status, text, explanation); of those that claim to know, also of the studies of their references (owner, study) and of their pages."""
    own = violations(regions, c("owner"), {"unresolved region": c("status").isin(*REGION_STATUSES), "explanation missing": filled("text"), "patient-friendly explanation missing": filled("explanation")})
    known = regions.where(c("status").isin("finding", "no_finding")).select("owner", "study")
    bare = known.join(refs.select("owner"), "owner", "left_anti").select("owner", F.lit("source references missing").alias("rule"))
    studies = known.join(refs.select("owner", c("study").alias("of")), "owner").groupBy("owner").agg(F.bool_and(c("of").eqNullSafe(c("study"))).alias("same"))
    return own.unionByName(bare).unionByName(violations(studies, c("owner"), {"wrong study reference": c("same")})).unionByName(validate_owner_pages(known, shown.select("owner", "path"), pages))


def validate_claims(claims: DataFrame) -> DataFrame:
    """Rules of claims (session, claim, text, priority, confidence, and the four patient fields; place, their order, where it is known); of claims with one id in a session all but the first are flagged."""
    order = [c("place")] if "place" in claims.columns else [c("claim")]
    n = F.row_number().over(Window.partitionBy("session", "claim").orderBy(*order))
    rules = {"Claim IDs must be unique": filled("claim") & (c("n") == 1), "text missing": filled("text"), "priority missing": c("priority").isin(*PRIORITIES), "confidence missing": c("confidence").isin(*CONFIDENCES)}
    rules |= {f"patient explanation {x} missing": filled(x) for x in PATIENT_FIELDS}
    return violations(claims.withColumn("n", n), F.concat_ws("/", "session", "claim"), rules)


def validate_measurements(measurements: DataFrame, files: DataFrame) -> DataFrame:
    """Rules of measurements (owner, unit, value, method, row_at, col_at, file, hash) against a manifest of evidence files (file, now)."""
    rows = measurements.join(files.select("file", "now"), "file", "left")
    number = c("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return violations(rows, c("owner"), {
        "measurement needs native row/column coordinates": c("row_at").isNotNull() & c("col_at").isNotNull(), "invalid measurement unit": c("unit").isin(*UNITS), "invalid measured value": number, "measurement method missing": filled("method"),
        "measurement tool output missing": c("now").isNotNull(), "measurement output hash missing": filled("hash"), "measurement output changed": c("now").isNull() | (c("now") == c("hash")),
    })


def validate_comparison(claims: DataFrame, studies: DataFrame, timeline: DataFrame, refs: DataFrame) -> DataFrame:
    """Rules of a comparison: claims (session, claim, status, reason, from_study, to_study), a session's studies in order (session, study, place), timepoints (claim, study, status, text, explanation, ref_study) and evidence (claim, study)."""
    counts = studies.groupBy("session").agg(F.count_distinct("study").alias("studies"))
    points = timeline.join(claims.select("session", "claim"), "claim").join(studies.select("session", "study", F.lit(True).alias("of_session")), ["session", "study"], "left")
    covered = points.groupBy("claim").agg(F.count("*").alias("points"), F.count_distinct("study").alias("distinct"), F.bool_and(F.coalesce("of_session", F.lit(False))).alias("all_known"))
    at = lambda x: studies.select("session", c("study").alias(f"{x}_study"), c("place").alias(f"{x}_place"))
    seen = lambda x: refs.select("claim", c("study").alias(f"{x}_study"), F.lit(True).alias(f"{x}_seen")).distinct()
    rows = claims.join(counts, "session", "left").join(covered, "claim", "left")
    for x in ("from", "to"):
        rows = rows.join(at(x), ["session", f"{x}_study"], "left").join(seen(x), ["claim", f"{x}_study"], "left")
    still = ~F.coalesce(c("status").isin(*CHANGES), F.lit(False))
    own = violations(rows, c("claim"), {
        "comparison status missing": c("status").isin(*COMPARISONS), "comparison rationale missing": filled("reason"),
        "timeline must cover every supplied study": c("all_known") & (c("points") == c("studies")) & (c("distinct") == c("studies")),
        "change claim needs explicit distinct comparison endpoints": still | (c("from_place").isNotNull() & c("to_place").isNotNull() & (c("from_study") != c("to_study"))),
        "comparison endpoints reversed": still | c("from_place").isNull() | c("to_place").isNull() | (c("from_place") < c("to_place")), "change claim needs both endpoint studies' evidence": still | (c("from_seen") & c("to_seen")),
    })
    seen_ = ~F.coalesce(c("status").isin("present", "not_seen"), F.lit(False))
    return own.unionByName(violations(timeline, F.concat_ws("/", "claim", "study"), {
        "invalid timepoint": c("status").isin(*TIMEPOINTS), "timepoint needs professional and plain-language descriptions": filled("text") & filled("explanation"),
        "source references missing": seen_ | c("ref_study").isNotNull(), "timepoint source belongs to a different study": seen_ | c("ref_study").isNull() | (c("ref_study") == c("study")),
    }))


def prepare_checks(instances: DataFrame) -> DataFrame:
    """Per folder: one study, one identity, one valid date, no repeated slice; and no study in two folders."""
    rows = instances.groupBy("folder").agg(
        F.count_distinct("study_uid").alias("studies"), F.count_distinct(F.struct("patient_id", "patient_name", "birth_date")).alias("people"), F.count_distinct("study_date").alias("dates"), F.bool_and(c("study_date").rlike("^[0-9]{8}$")).alias("valid"), (F.count("*") - F.count_distinct("sop_uid")).alias("repeated")
    )
    own = violations(rows, c("folder"), {"several studies": c("studies") == 1, "several identities": c("people") == 1, "several dates": c("dates") == 1, "invalid date": c("valid"), "repeated slices": c("repeated") == 0})
    spread = instances.groupBy("study_uid").agg(F.count_distinct("folder").alias("n")).where("n > 1")
    return own.unionByName(spread.select(c("study_uid").alias("owner"), F.lit("study in several folders").alias("rule")))


def _distinct(slices: DataFrame, *by: str) -> DataFrame:
    """A row for each slice of a group ``by``, rendered or reviewed if any of its rows is."""
    return slices.groupBy(*by, "sop_uid").agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(x) for x in ("rendered", "reviewed")])


def _counts() -> list[Column]:
    return [F.count("sop_uid").alias("slices"), *[F.count_if(c(x) & c("sop_uid").isNotNull()).alias(x) for x in ("rendered", "reviewed")]]


def coverage(slices: DataFrame) -> DataFrame:
    """Slices, rendered and reviewed for each (study, series, pass), with subtotals; rows have study_uid, series_uid, purpose, sop_uid, rendered, reviewed.

    A subtotal counts a slice once, in however many passes, series or studies it occurs: each level's slices are those of the level below without
    their repetitions. Levels of a study are worked out where its rows are; only the grand total's slices are shuffled again.
    """
    keys = ("study_uid", "series_uid", "purpose")
    rows, out = slices.repartition(keys[0]), []
    for n in (3, 2, 1, 0):
        rows = _distinct(rows, *keys[:n])
        of_level = rows.groupBy(*keys[:n]).agg(*_counts())
        out.append(of_level.select(*[c(x) if i < n else F.lit(None).cast(slices.schema[x].dataType).alias(x) for i, x in enumerate(keys)], "slices", "rendered", "reviewed"))
    return reduce(DataFrame.unionByName, out)


def verdict_tally(claims: DataFrame) -> DataFrame:
    return claims.groupBy("session_id").agg(
        F.count_if(c("verdict").isin("resolved", "decreased")).alias("better"), F.count_if(c("verdict") == "increased").alias("worse"), F.count_if(c("verdict").isin("new", "indeterminate")).alias("attention"), F.count("*").alias("total")
    ).withColumn("same", c("total") - c("better") - c("worse") - c("attention"))


def input_fingerprint(sources: DataFrame) -> DataFrame:
    """One hash over the ordered hashes (ord, hash) of each session's sources."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "hash"))), lambda x: x["hash"])
    return sources.groupBy("session_id").agg(F.sha2(F.array_join(ordered, "|"), 256).alias("fingerprint"))


def verify_hashes(tracked: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status): ok, missing or changed."""
    rows = tracked.select("path", c("hash").alias("h1")).join(manifest.select("path", c("hash").alias("h2")), "path", "left")
    return rows.select("path", F.when(c("h2").isNull(), "missing").when(c("h1") != c("h2"), "changed").otherwise("ok").alias("status"))


def required_passes(series: DataFrame) -> DataFrame:
    """(study_uid, series_uid, purpose) of each series (study_uid, series_uid, modality) by its study's mix of modalities: a CT beside a PET has less to show than one alone."""
    with_pet = F.bool_or(c("modality") == "PT").over(Window.partitionBy("study_uid"))
    names = lambda *x: F.array(*map(F.lit, x))
    wanted = (
        F.when((c("modality") == "CT") & ~c("with_pet"), names("lung:native", "lung:mip", "soft:native", "bone:native")).when(c("modality") == "CT", names("soft:native"))
        .when(c("modality") == "PT", names("pet:native", "pet:fused")).when(c("modality") == "MR", names("mr:native"))
    )
    return series.withColumn("with_pet", with_pet).select("study_uid", "series_uid", F.explode(wanted).alias("purpose"))


def technical_alerts(studies: DataFrame, series: DataFrame, suv: DataFrame, passes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(owner, level, code, text): problems of geometry, quantitation and coverage; never anatomy.

    ``studies`` (study_uid, modalities), ``series`` (series_uid, disposition, reason, required: an array of passes), ``suv`` (series_uid,
    warnings: an array, error, weight_source), ``passes`` (series_uid, purpose, slices, rendered, reviewed) and ``sessions`` (session_id,
    mode, comparison). Each table is read once; a row may raise several alerts, a warning of an array each its own.
    """
    alert = lambda code, level, when, text: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("text")))
    rows = lambda df, owner, *found: df.select(owner.alias("owner"), F.explode(F.array_compact(F.array(*found))).alias("a")).select("owner", "a.*")
    has = lambda m: F.array_contains("modalities", m)
    none = F.array().cast("array<string>")
    of_study = rows(studies, c("study_uid"), alert("pet_without_ct", "warning", has("PT") & ~has("CT"), F.lit("PET without a CT of its study: no fusion")))
    of_series = rows(
        series, c("series_uid"), alert("series_unsupported", "warning", c("disposition") == "unsupported", F.coalesce(F.nullif("reason", F.lit("")), F.lit("unsupported geometry"))),
        alert("passes_missing", "error", (c("disposition") == "read") & (F.size(F.coalesce("required", none)) == 0), F.lit("read without declared passes")),
    )
    warned = suv.select("series_uid", F.explode("warnings").alias("w"))
    of_suv = rows(warned, c("series_uid"), alert("suv_warning", "warning", c("w").isNotNull(), c("w"))).unionByName(rows(
        suv, c("series_uid"), alert("suv_unavailable", "error", F.coalesce("error", F.lit("")) != "", c("error")), alert("weight_external", "info", c("weight_source").startswith("argument"), F.lit("SUV by a weight that the header doesn't hold")),
    ))
    short, seen = c("slices") - c("rendered"), c("slices") - c("reviewed")
    of_pass = rows(
        passes, F.concat_ws(" ", "series_uid", "purpose"), alert("unrendered_slices", "error", short > 0, F.concat(short.cast("string"), F.lit(" slices not rendered"))),
        alert("unreviewed_slices", "warning", (short <= 0) & (seen > 0), F.concat(seen.cast("string"), F.lit(" slices rendered but not seen"))),
    )
    of_session = rows(sessions, c("session_id"), alert("comparison_pending", "info", (c("mode") == "comparison") & (c("comparison") == "pending"), F.lit("comparison not recorded yet")))
    return of_study.unionByName(of_series).unionByName(of_suv).unionByName(of_pass).unionByName(of_session)


def build_findings(sessions: DataFrame, studies: DataFrame, claims: DataFrame, timeline: DataFrame, refs: DataFrame, measurements: DataFrame) -> DataFrame:
    """A row for each claim and study of its session: presence, reference, measurement, and the claim's verdict and change.

    Sessions (session, mode), studies (session, study, place), claims (session, claim, status), timeline (session, claim, study, status, ref), refs
    (session, claim, study, place, ref), measurements (session, claim, study, place, unit, value, drawn, ref). The reference is that of the
    first measurement drawn on the image, else the timeline's, else the claim's first, else any measurement's. The measurement is the
    largest in mm, of other units only where none is. Without a timeline entry a study with a reference is present, any other not covered. The verdict is what
    was recorded, never computed; of one study it is present. Change is from the first study to the last where both have a value of one unit.
    """
    from slicelake.functions.labels import presence

    key = ["session", "claim", "study"]
    several = studies.groupBy("session").agg((F.count_distinct("study") > 1).alias("several"), F.min("place").alias("first"), F.max("place").alias("last"))
    several = several.join(sessions, "session").select("session", "first", "last", (c("several") & (c("mode") == "comparison")).alias("compared"))
    grid = claims.select("session", "claim", "status").join(studies, "session").join(several, "session")
    kinds = [
        measurements.where("drawn").select(*key, F.lit(0).alias("kind"), "place", "ref"), timeline.select(*key, F.lit(1).alias("kind"), F.lit(0).alias("place"), "ref"),
        refs.select(*key, F.lit(2).alias("kind"), "place", "ref"), measurements.select(*key, F.lit(3).alias("kind"), "place", "ref"),
    ]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionByName(k)
    ref = every.where("ref is not null").groupBy(*key).agg(F.min_by("ref", F.struct("kind", "place", "ref")).alias("ref"))
    best = measurements.where("value is not null").groupBy(*key).agg(F.max_by(F.struct("unit", "value"), F.struct(c("unit") == "mm", "value", -c("place"))).alias("m"))
    entry = timeline.select(*key, c("status").alias("at_status"))
    rows = grid.join(entry, key, "left").join(ref, key, "left").join(best, key, "left")
    w = Window.partitionBy("session", "claim")
    end = lambda at: F.max(F.when(c("place") == c(at), c("m"))).over(w)
    rows = rows.withColumns({"a": end("first"), "b": end("last")})
    changed = c("compared") & (c("first") < c("last")) & (c("a.unit") == c("b.unit"))
    verdict = F.when(~c("compared"), "present").when(c("status").isin(*COMPARISONS), c("status")).otherwise("not_comparable")
    return rows.select(
        *key, "place", presence(c("at_status"), c("ref").isNotNull()).alias("presence"), "ref", c("m.unit").alias("unit"), c("m.value").alias("value"), verdict.alias("verdict"),
        F.when(changed, c("a.value")).alias("from_value"), F.when(changed, c("b.value")).alias("to_value"), F.when(changed & (c("a.value") > 0), (c("b.value") - c("a.value")) / c("a.value") * 100).alias("delta_pct"),
    )


def _lines(df: DataFrame, voice: str, section: int, key: Column | str, order: list[Column], **values: Column) -> DataFrame:
    """(session_id, voice, section, a, b, e, key, values): lines of one kind; ``order`` tells where they stand in their section."""
    key = F.lit(key) if isinstance(key, str) else key
    places = [*order, *[F.lit(0)] * (3 - len(order))]
    entries = [x for n, v in values.items() for x in (F.lit(n), v.cast("string"))]
    return df.select("session_id", F.lit(voice).alias("voice"), F.lit(section).alias("section"), *[p.cast("long").alias(n) for p, n in zip(places, "abe", strict=True)], key.alias("key"), (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("values"))


def report_lines(sessions: DataFrame, studies: DataFrame, regions: DataFrame, claims: DataFrame, measurements: DataFrame, timeline: DataFrame, errors: DataFrame, texts: DataFrame) -> DataFrame:
    """(session_id, lang, voice, n, line): the report of each session for professionals and the guide in plain words, in every language of ``texts`` (lang, dates, texts).

    Only finished sessions (session_id, mode, reader, date, finished) without ``errors`` (session_id) have one. Studies (session_id,
    study, place, date, modalities, folder), regions (session_id, study, place, region, status, text, explanation), claims (session_id, claim, place,
    text, priority and the four patient fields), measurements (session_id, claim, place, value, unit, method) and the timeline
    (session_id, claim, study, text, explanation) are put in order of their places, each kind under its heading; null texts
    are empty. A session without claims says so; over one study it has no timeline. Lines are numbered from 1 in each document.
    """
    from slicelake.functions.locale import date_in, filled_in

    own = sessions.where("finished").join(errors.select("session_id").distinct(), "session_id", "left_anti")
    of = lambda df: df.join(own.select("session_id", "mode"), "session_id")
    at = studies.select("session_id", "study", c("place").alias("sp"), c("date").alias("study_date"))
    claim_at = claims.select("session_id", "claim", c("place").alias("cp"))
    several = own.where("mode = 'comparison'")
    with_claims = claims.select("session_id").distinct()
    region, point = of(regions).join(at, ["session_id", "study"]), of(timeline).where("mode = 'comparison'").join(at, ["session_id", "study"]).join(claim_at, ["session_id", "claim"])
    marked = F.when(c("status").isin("finding", "limited"), "region_marked").otherwise("region")
    text = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    heads = lambda voice, *keys: [_lines(own, voice, n, k, []) for n, k in keys]
    parts = [
        _lines(own, "report", 0, F.concat(F.lit("title_"), "mode"), []), *heads("report", (1, "draft")), _lines(own, "report", 2, "signed", [], reader=text("reader"), date=text("date")), *heads("report", (3, "studies")),
        _lines(of(studies), "report", 4, "study", [c("place")], date=text("date"), modalities=text("modalities"), folder=text("folder")), *heads("report", (5, "findings")),
        _lines(region, "report", 6, marked, [c("sp"), c("place")], region=text("region"), word_status=c("status"), text=text("text")), *heads("report", (7, "results")),
        _lines(of(claims), "report", 8, F.when(c("priority") == "important", "claim_marked").otherwise("claim"), [c("place")], n=c("place"), claim=c("claim"), text=text("text")),
        _lines(of(measurements).join(claim_at, ["session_id", "claim"]), "report", 8, "measured", [c("cp"), c("place") + 1], value=text("value"), unit=text("unit"), method=text("method")),
        _lines(own.join(with_claims, "session_id", "left_anti"), "report", 9, "no_claims", []), _lines(several.join(with_claims, "session_id", "left_semi"), "report", 10, "timeline", []),
        _lines(point, "report", 11, "point", [c("cp"), c("sp")], claim=c("claim"), date=text("study_date"), text=text("text")),
        *heads("guide", (0, "guide_title"), (1, "guide_note")),
        *[_lines(of(claims), "guide", 2, k, [c("place"), F.lit(i)], claim=c("claim"), text=text(x)) for i, (k, x) in enumerate((("guide_claim", "text"), ("meaning", "meaning"), ("importance", "importance"), ("uncertainty", "uncertainty"), ("ask", "discuss_with_doctor")))],
        _lines(point, "guide", 2, "guide_point", [c("cp"), F.lit(5), c("sp")], date=text("study_date"), explanation=text("explanation")), *heads("guide", (3, "guide_regions")),
        _lines(region, "guide", 4, "guide_region", [c("sp"), c("place")], region=text("region"), word_status=c("status"), explanation=text("explanation")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.crossJoin(F.broadcast(texts))  # a row for each language
    of_word = lambda k, v: F.when(k == "date", date_in(v, c("dates"))).when(k.startswith("word_"), F.coalesce(F.try_element_at("texts", F.concat(F.lit("word."), v)), v)).otherwise(v)
    line = filled_in(F.try_element_at("texts", c("key")), F.transform_values("values", of_word))
    n = F.row_number().over(Window.partitionBy("session_id", "lang", "voice").orderBy("section", "a", "b", "e", "key", "line"))
    return rows.withColumn("line", line).select("session_id", "lang", "voice", n.alias("n"), "line")


def locks(reviews: DataFrame) -> DataFrame:
    """The first seal of each review (hash, size, time); later ones are refused."""
    place = F.row_number().over(Window.partitionBy("review").orderBy("at", "hash"))
    return reviews.withColumn("status", F.when(place == 1, "locked").otherwise("refused"))


def verify_locks(sealed: DataFrame, now: DataFrame) -> DataFrame:
    """(review, status) of locked reviews (review, hash, size) against what stands there now: ok, changed or missing."""
    rows = sealed.select("review", "hash", "size").join(now.select("review", c("hash").alias("h"), c("size").alias("n")), "review", "left")
    return rows.select("review", F.when(c("h").isNull(), "missing").when((c("h") == c("hash")) & (c("n") == c("size")), "ok").otherwise("changed").alias("status"))
