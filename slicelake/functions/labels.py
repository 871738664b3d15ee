"""Labels from text and tags: sequences, tissues, names, patterns, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words by which a finding's tissue is known, with its band of Hounsfield units.
TISSUES = [
    ("kalsifi|granülom|granulom|kireç|stapler|klips", "kalsifik", 120, 3200),
    ("bül|amfizem|hava kist|pnömotoraks", "hava", -1024, -650),
    ("efüzyon|plevral sıvı|basit kist|kortikal kist|su kesesi|sıvı dansite", "sıvı", -30, 45),
    ("kitle|solid nodül|lenf nod|güdük|stump|herni|jinekomasti|yumuşak doku", "yumuşak doku", -30, 180),
    ("damar|vasküler|vaskuler", "damar", -20, 400),
]
#: The words by which a lesion's profile is known.
PROFILES = [("efüzyon|effusion|plevral sıvı", "effusion"), ("(^|[ ,(])bül([ ,.)]|$)|bulla", "bulla"), ("kist|cyst", "cyst"), ("kitle|nodül|nodule|mass|solid", "solid")]


def tissue_of(text: Column) -> Column:
    """struct(label, lo, hi) of the first family of words that a text holds; null if none."""
    low, out = F.lower(text), F.lit(None).cast("struct<label: string, lo: int, hi: int>")
    for words, label, lo, hi in reversed(TISSUES):
        out = F.when(low.rlike(words), F.struct(F.lit(label).alias("label"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))).otherwise(out)
    return out


def expected_tissue(headline: Column, technical: Column) -> Column:
    """The tissue that the headline names; where it names none, what the technical wording with the headline names."""
    return F.coalesce(tissue_of(headline), tissue_of(F.concat_ws(" ", technical, headline)))


def tissue_profile(text: Column) -> Column:
    low, out = F.lower(text), F.lit("auto")
    for words, label in reversed(PROFILES):
        out = F.when(low.rlike(words), label).otherwise(out)
    return out


def seed_profile(hu: Column, profile: Column) -> tuple[Column, Column]:
    """The profile of a seed (auto: bulla below -650, else solid) and whether its value contradicts it."""
    chosen = F.when(profile == "auto", F.when(hu < -650, "bulla").otherwise("solid")).otherwise(profile)
    return chosen, ((chosen == "bulla") & (hu >= -650)) | (chosen.isin("solid", "effusion") & (hu < -650))


def mr_guess(image_type: Column, scanning: Column, te: Column, tr: Column, ti: Column, name: Column, thickness: Column, contrast: Column, protocol: Column | None = None) -> Column:
    """A sequence's likely label from its image type, timing and name, or the protocol's name where it has none; a hint, not a fact. A timing of 0 is none."""
    kinds = F.transform(image_type, F.upper)
    has = lambda x: F.coalesce(F.array_contains(kinds, x), F.lit(False))
    te, tr, ti = (F.nullif(x, F.lit(0.0)) for x in (te, tr, ti))
    name = F.lower(F.coalesce(F.nullif(name, F.lit("")), protocol if protocol is not None else F.lit(None).cast("string"), F.lit("")))
    spin, gradient = (F.array_contains(scanning, x) for x in ("SE", "GR"))
    thin = F.coalesce(F.nullif(thickness, F.lit(0.0)), F.lit(9.0)) <= 1.5
    timed = [
        ((ti > 1500) & (te > 80), F.concat(F.lit("T2 FLAIR"), F.when(name.contains("spc") | thin, " 3D").otherwise(""))),
        (ti.between(600, 1300) & (te < 10), F.lit("T1 MPRAGE/3D GRE")),
        (spin & (te >= 70), F.lit("T2 TSE")),
        (spin & (te < 30) & (tr < 900), F.lit("T1 SE")),
        (gradient & (te < 6) & (tr < 60), F.lit("T1 GRE (localizer / fast)")),
        (gradient & (te > 15), F.lit("T2* GRE")),
    ]
    notes = F.array(F.when(has("DERIVED") & has("PARALLEL"), "reformat of 3D acquisition"), F.concat(F.lit("contrast agent tag: "), F.nullif(contrast, F.lit(""))))
    notes = F.array_join(F.filter(notes, lambda x: x.isNotNull()), "; ")
    by_time = F.concat(_first(timed, F.lit("unclassified")), F.when(notes != "", F.concat(F.lit(" ["), notes, F.lit("]"))).otherwise(""))
    b = F.regexp_extract(name, "b([0-9]+)", 1)
    swi = name.contains("swi")
    typed = [
        (has("DIFFUSION") & has("ADC"), F.lit("DWI ADC map")),
        (has("DIFFUSION"), F.concat(F.lit("DWI trace"), F.when(b != "", F.concat(F.lit(" b="), b)).otherwise(""))),
        (has("SWI"), F.lit("SWI (magnitude/processed)")),
        (has("MNIP") | has("MINIP"), F.lit("SWI minIP")),
        (has("P") & swi, F.lit("SWI phase")),
        (has("M") & swi, F.lit("SWI raw magnitude")),
        (has("MIP"), F.lit("MIP reformat")),
    ]
    return _first(typed, by_time)


def _first(cases: list[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first case that holds."""
    for test, value in reversed(cases):
        other = F.when(test, value).otherwise(other)
    return other


def mentions(value: Column, needles: Column) -> Column:
    """Whether a value holds any needle of three characters or more, in any case."""
    return F.exists(needles, lambda n: F.coalesce((F.length(n) >= 3) & F.lower(value).contains(F.lower(n)), F.lit(False)))


def looks_like_instance_uid(keyword: Column) -> Column:
    return keyword.rlike("Instance|FrameOfReference|Concatenation|Referenced") & ~keyword.contains("Class")


def valid_uid(x: Column) -> Column:
    return x.rlike("^[0-9.]{1,64}$")


def valid_sha(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def safe_name(x: Column) -> Column:
    """Only letters, digits, dot, dash and underscore; runs of others are one underscore."""
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_")


def series_dir(number: Column, uid: Column) -> Column:
    """S and three digits, or a hash of the UID where the number is none."""
    n = number.try_cast("int")
    return F.when(n.isNotNull(), F.concat(F.lit("S"), F.lpad(n.cast("string"), 3, "0"))).otherwise(F.concat(F.lit("S"), F.substring(F.sha2(uid, 256), 1, 8)))


def file_stem(number: Column, uid: Column) -> Column:
    return F.when(number.isNotNull(), F.lpad(number.cast("string"), 5, "0")).otherwise(F.substring(F.sha2(uid, 256), 1, 12))


def format_number(x: Column) -> Column:
    """Integers bare, others with one decimal."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.1f", x))


def change_label(before: Column, after: Column, unit: Column) -> Column:
    return F.concat(format_number(before), F.lit(" → "), format_number(after), F.lit(" "), unit)


def presence(status: Column, has_ref: Column) -> Column:
    """present, absent, not_covered or unknown; without a status, whether a reference exists."""
    known = F.when(status == "present", "present").when(status.isin("not_seen", "resolved"), "absent").when(status == "not_covered", "not_covered").when(status.isNotNull(), "unknown")
    return F.coalesce(known, F.when(has_ref, "present").otherwise("not_covered"))


#: The validator's messages, by where each is fixed. A message of a series, region or claim begins with its name.
SESSION_MESSAGES = (
    "Reading not complete", "Record model/reader", "Disclose prior context/leakage, even when none", "Record actual coverage and sensitivity limitations", "Explain examination scope in plain language (patient_context)",
    "Explain limitations in plain language (patient_limitations)", "Invalid blind status", "Unsupported report language",
)
COMPARISON_MESSAGES = ("Comparison not completed", "Comparison limitations/method missing", "Plain-language comparison explanation missing")
PAGE_MESSAGES = ("No rendered pages registered", "Page purpose missing", "Page needs valid study and series UID")
PAGE_STARTS = ("Unreviewed page: ", "Missing/changed input: ", "page marked reviewed without a view attestation: ")
SERIES_MESSAGES = ("disposition pending", "excluded/unsupported series needs reason", "read series geometry not checked", "read image series needs declared exhaustive passes", "read series has no pages")
REGION_MESSAGES = (
    "explanation missing", "patient-friendly explanation missing", "unresolved region", "source references missing", "inspected image pages missing", "coordinates out of range", "unknown source SOP/series/study", "unregistered page",
    "page belongs to another study", "wrong study reference", "referenced series has not been read",
)
CLAIM_MESSAGES = (
    "text missing", "confidence missing", "priority missing", "measurement method missing", "invalid measurement unit", "invalid measured value", "measurement needs native row/column coordinates", "measurement tool output missing",
    "measurement output hash missing", "measurement output changed",
)
CLAIM_COMPARISONS = (
    "comparison status missing", "comparison rationale missing", "comparison endpoints reversed", "change claim needs explicit distinct comparison endpoints", "change claim needs both endpoint studies' evidence", "timeline must cover every supplied study",
    "timepoint needs professional and plain-language descriptions", "timepoint source belongs to a different study", "invalid timepoint",
)
#: Places in the order in which they are shown; what no rule knows comes last.
PLACES = ("session", "series", "pages", "region", "claim", "comparison")


def classify_blocker(message: Column) -> Column:
    """Where a validation message is fixed; null for one that no rule knows."""
    after, one_word = F.regexp_extract(message, "^(.+?): (.+)$", 2), message.rlike("^[^ \\t\\r\\n]+: ")
    rest = F.regexp_extract(message, "^.+: (.+)$", 1)  # a region's name may hold a colon
    return (
        F.when(message.isin(*SESSION_MESSAGES), "session").when(message == "Claim IDs must be unique", "claim").when(message.isin(*COMPARISON_MESSAGES), "comparison")
        .when(message.isin(*PAGE_MESSAGES) | F.coalesce(*[F.when(message.startswith(x) & (F.length(message) > len(x)), True) for x in PAGE_STARTS], F.lit(False)), "pages")
        .when(message.rlike("^Series [^ ]+: ") & after.isin(*SERIES_MESSAGES), "series").when(message.rlike("^Series [^ ]+ [^ ]+: [0-9]+ unread/unrendered slices$"), "series")
        .when(rest.isin(*REGION_MESSAGES), "region")
        .when(one_word & (after.isin(*CLAIM_MESSAGES) | after.rlike("^patient explanation [^ ]+ missing$")), "claim").when(one_word & after.isin(*CLAIM_COMPARISONS), "comparison")
    )


def fit_grid(w: Column, h: Column, grid: Column, max_side: Column, pad: int = 2) -> dict[str, Column]:
    """Columns and rows of the largest grid of undiminished tiles that fits; auto is the largest, another is reduced."""
    low = F.lower(F.trim(grid))
    cols, rows = F.split_part(low, F.lit("x"), F.lit(1)).try_cast("int"), F.split_part(low, F.lit("x"), F.lit(2)).try_cast("int")
    auto = low.isin("auto", "")
    big_c, big_r = F.greatest(F.lit(1), F.floor(max_side / (w + pad))).cast("int"), F.greatest(F.lit(1), F.floor(max_side / (h + pad))).cast("int")
    status = F.when((w + pad > max_side) | (h + pad > max_side), "tile too large").when(auto, "ok").when(cols.isNull() | rows.isNull(), "bad grid").when((cols < 1) | (rows < 1) | (cols * rows > 144), "out of range").when((cols <= big_c) & (rows <= big_r), "ok").otherwise("reduced")
    ok = status.isin("ok", "reduced")
    return {"cols": F.when(ok, F.when(auto, big_c).otherwise(F.least(cols, big_c))), "rows": F.when(ok, F.when(auto, big_r).otherwise(F.least(rows, big_r))), "status": status}
