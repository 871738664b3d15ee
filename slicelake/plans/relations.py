"""Queries of joins, windows, set operations and top-k lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slicelake import fixtures as X
from slicelake.functions import dates as D
from slicelake.operators import inventory as I
from slicelake.operators import relations as R
from slicelake.plans.inventory import FIRST, ORD, SER, SPC, series_of
from slicelake.plans.registry import query

c = F.col
BAD = "rf AS (SELECT series_uid, CASE WHEN instance_number % 4 = 0 THEN sop_uid || '.x' ELSE sop_uid END AS sop_uid, patient_id FROM instances)"


def refs_of(i):
    return i.select("series_uid", F.when(c("instance_number") % 4 == 0, F.concat("sop_uid", F.lit(".x"))).otherwise(c("sop_uid")).alias("sop_uid"), "patient_id")


@query("j01_attach_series", "instances", f"{BAD}, {SER} SELECT rf.sop_uid, study_uid, modality FROM rf JOIN ser USING (series_uid)")
def _(s, d):
    i = X.instances(s, d)
    return R.attach_series(refs_of(i), series_of(i))


@query("j02_dangling_refs", "instances", f"{BAD} SELECT series_uid, sop_uid FROM rf ANTI JOIN instances USING (series_uid, sop_uid)")
def _(s, d):
    i = X.instances(s, d)
    return R.dangling_refs(refs_of(i), i).select("series_uid", "sop_uid")


PASSES = "ps AS (SELECT DISTINCT series_uid, purpose FROM instances, (VALUES ('CT', 'lung:native'), ('CT', 'soft:native'), ('PT', 'pet:native'), ('MR', 'mr:native')) v(m, purpose) WHERE modality = m), cv AS (SELECT series_uid, sop_uid, 'lung:native' AS purpose FROM instances WHERE instance_number % 3 <> 0 UNION ALL SELECT series_uid, sop_uid, 'mr:native' FROM instances WHERE slice_location > 25), sk AS (SELECT series_uid, sop_uid, 'soft:native' AS purpose FROM instances WHERE z < 3), need AS (SELECT DISTINCT i.series_uid, sop_uid, purpose FROM instances i JOIN ps USING (series_uid))"


def pass_names():
    return F.when(c("modality") == "CT", F.array(F.lit("lung:native"), F.lit("soft:native"))).when(c("modality") == "PT", F.array(F.lit("pet:native"))).otherwise(F.array(F.lit("mr:native")))


def passes_of(i):
    passes = i.select("series_uid", F.explode(pass_names()).alias("purpose")).distinct()
    covered = i.where("instance_number % 3 <> 0").select("series_uid", "sop_uid", F.lit("lung:native").alias("purpose")).union(i.where("slice_location > 25").select("series_uid", "sop_uid", F.lit("mr:native")))
    return passes, covered, i.where("z < 3").select("series_uid", "sop_uid", F.lit("soft:native").alias("purpose"))


def slice_state(i, *more):
    """A row for each (series_uid, sop_uid): its modality, one for all headers of a series, as its uid holds the modality's letter; what passes_of() says of its headers, whether a pass covers or skips it; ``more`` aggregates. One shuffle, by series."""
    said = {"lung": c("instance_number") % 3 != 0, "mr": c("slice_location") > 25, "soft": c("z") < 3}
    rows = i.withColumns(said).repartition("series_uid")  # what is asked of a header goes before the shuffle, not the header
    return rows.groupBy("series_uid", "sop_uid").agg(F.min("modality").alias("modality"), *[F.coalesce(F.bool_or(x), F.lit(False)).alias(x) for x in said], *more)


def unread_passes():
    """The passes of a row of slice_state() that nothing covers or skips."""
    ct = c("modality") == "CT"
    open_ = [F.when(ct & ~c("lung"), "lung:native"), F.when(ct & ~c("soft"), "soft:native"), F.when(c("modality") == "PT", "pet:native"), F.when((c("modality") == "MR") & ~c("mr"), "mr:native")]
    return F.array_compact(F.array(*open_))


@query("j03_unread_slices", "instances", f"{PASSES} SELECT * FROM need ANTI JOIN cv USING (series_uid, sop_uid, purpose) ANTI JOIN sk USING (series_uid, sop_uid, purpose)")
def _(s, d):
    i = X.instances(s, d)
    return R.unread_slices(i.select("series_uid", "sop_uid").distinct(), *passes_of(i))


NEAR = f"{SPC}, e AS (SELECT series_uid, min(z) AS lo, max(z) AS hi FROM so GROUP BY series_uid), rq AS (SELECT sop_uid AS request, series_uid, slice_location / 6 AS place FROM instances), n AS (SELECT request, rq.series_uid, place, arg_min(k, (abs(z - place), k)) AS k FROM rq JOIN so USING (series_uid) JOIN sp USING (series_uid) JOIN e USING (series_uid) WHERE place >= lo - dz / 2 AND place <= hi + dz / 2 GROUP BY request, rq.series_uid, place)"


def nearest(s, d):
    i = X.instances(s, d)
    slices = I.with_spacing(i).select("series_uid", "k", "z", "dz")
    return R.nearest_slice(i.select(c("sop_uid").alias("request"), "series_uid", (c("slice_location") / 6).alias("at")), slices)


@query("j04_nearest_slice", "instances", f"{NEAR} SELECT request, round(place, 6) AS place, k FROM n")
def _(s, d):
    return nearest(s, d).select("request", F.round("at", 6).alias("place"), "k")


@query("j15_locate_point", "instances", f"{NEAR} SELECT request, k, CAST(round_even(ipp_y / row_sp, 0) AS INT) AS row_at, CAST(round_even(ipp_x / col_sp, 0) AS INT) AS col_at FROM n JOIN instances ON request = sop_uid")
def _(s, d):
    i = X.instances(s, d).withColumnRenamed("sop_uid", "request")
    return R.locate_point(nearest(s, d), i)


@query("j21_slice_by_instance", "instances", f"{ORD}, q AS (SELECT DISTINCT series_uid, unnest(list_value(1, 3, 9)) AS wanted FROM instances), m AS (SELECT q.series_uid, wanted, min(k) AS k FROM q LEFT JOIN so ON q.series_uid = so.series_uid AND instance_number = wanted GROUP BY ALL) SELECT series_uid, wanted, k, CASE WHEN k IS NULL THEN 'missing' ELSE 'ok' END AS status FROM m")
def _(s, d):
    return R.slice_by_instance(I.slice_order(X.instances(s, d)), [1, 3, 9])


ZS = f"{SER}, zs AS (SELECT series_uid, min(z) AS z_min, max(z) AS z_max FROM instances GROUP BY series_uid), sz AS (SELECT * FROM ser JOIN zs USING (series_uid))"


def ranged(s, d):
    i = X.instances(s, d)
    return series_of(i).join(i.groupBy("series_uid").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max")), "series_uid")


PAIRS = f"{ZS}, pm AS (SELECT a.series_uid AS a_uid, b.series_uid AS b_uid, greatest(a.z_min, b.z_min) AS lo, least(a.z_max, b.z_max) AS hi FROM sz a JOIN sz b ON a.study_uid = b.study_uid AND a.frame_uid = b.frame_uid WHERE a.modality = 'PT' AND b.modality = 'CT' AND a.frame_uid <> '' AND greatest(a.z_min, b.z_min) < least(a.z_max, b.z_max))"


@query("j09_pair_modalities", "instances", f"{PAIRS} SELECT * FROM pm")
def _(s, d):
    return R.pair_modalities(ranged(s, d))


@query("p12_fusion_positions", "instances", f"{PAIRS}, g AS (SELECT a_uid, b_uid, hi - unnest(generate_series(0, CAST(floor(hi - lo) AS INT))) AS z FROM pm), {ORD} SELECT a_uid, b_uid, z, (SELECT arg_min(k, (abs(so.z - g.z), k)) FROM so WHERE so.series_uid = a_uid) AS ka, (SELECT arg_min(k, (abs(so.z - g.z), k)) FROM so WHERE so.series_uid = b_uid) AS kb FROM g")
def _(s, d):
    return R.fusion_positions(R.pair_modalities(ranged(s, d)), I.slice_order(X.instances(s, d)))


#: MR series of all patients of a folder's hundred count as one patient's, so that pairs occur.
MR = f"{FIRST}, m AS (SELECT series_uid, n_rows, n_cols, row_sp, col_sp, iop, study_date, frame_uid, 'G' || (substr(patient_id, 2)::INT % 20) AS patient_id FROM first_row WHERE modality = 'MR' AND iop IS NOT NULL AND frame_uid <> ''), pr AS (SELECT a.series_uid AS pre, b.series_uid AS post FROM m a JOIN m b ON a.patient_id = b.patient_id AND a.frame_uid = b.frame_uid AND a.n_rows = b.n_rows AND a.n_cols = b.n_cols WHERE (a.study_date, a.series_uid) < (b.study_date, b.series_uid) AND abs(a.row_sp - b.row_sp) <= 1e-8 + 1e-5 * abs(b.row_sp) AND abs(a.col_sp - b.col_sp) <= 1e-8 + 1e-5 * abs(b.col_sp) AND len(list_filter(list_zip(a.iop, b.iop), lambda t : abs(t[1] - t[2]) > 1e-4)) = 0)"


def mr_instances(s, d):
    """The headers of MR series: all of a series are of one modality, as its uid holds the modality's letter."""
    return X.instances(s, d).where("modality = 'MR'")


def mr_series(s, d):
    cols = ("patient_id", "frame_uid", "n_rows", "n_cols", "row_sp", "col_sp", "iop", "study_date", "modality")
    m = mr_instances(s, d).groupBy("series_uid").agg(I.first_header(*cols)).select("series_uid", "header.*").where("modality = 'MR' and iop is not null")
    return m.withColumn("patient_id", F.concat(F.lit("G"), (F.substring("patient_id", 2, 20).cast("int") % 20).cast("string")))


@query("j10_pair_sequences", "instances", f"{MR} SELECT pre, post FROM pr")
def _(s, d):
    return R.pair_sequences(mr_series(s, d))


@query("j10_match_slices", "instances", f"""{MR}, {SPC}, sl AS (SELECT so.series_uid, k, ipp_x AS x, ipp_y AS y, z, dz FROM so JOIN sp USING (series_uid)),
a AS (SELECT pre, post, a.k, b.k AS kb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS off_mm, greatest(0.5, b.dz / 2) AS reach FROM pr JOIN sl a ON a.series_uid = pre JOIN sl b ON b.series_uid = post), n AS (SELECT pre, post, k, arg_min(kb, (off_mm, kb)) AS kb, min(off_mm) AS off_mm FROM a WHERE off_mm <= reach GROUP BY ALL),
r AS (SELECT pre, post, k, kb, round(off_mm, 6) AS off_mm FROM (SELECT DISTINCT pre, post, k FROM a) LEFT JOIN n USING (pre, post, k)) SELECT *, bool_and(kb IS NOT NULL) OVER (PARTITION BY pre, post) AS aligned FROM r""")
def _(s, d):
    slices = I.with_spacing(mr_instances(s, d)).select("series_uid", "k", c("ipp_x").alias("x"), c("ipp_y").alias("y"), "z", "dz")
    series = mr_series(s, d).join(R.packed_slices(slices), "series_uid")
    return R.match_packed(R.pair_sequences(series, "slices", "reach")).withColumn("off_mm", F.round("off_mm", 6))


GRID = "st AS (SELECT DISTINCT session_id, 'Y' || left(study_date, 4) AS study_uid FROM claims), cl AS (SELECT DISTINCT claim_id, session_id FROM claims), tl AS (SELECT claim_id, 'Y' || left(study_date, 4) AS study_uid, arg_max(status, study_key) AS status FROM claims GROUP BY ALL), gr AS (SELECT claim_id, cl.session_id, st.study_uid, coalesce(status, 'not_covered') AS status FROM cl JOIN st USING (session_id) LEFT JOIN tl USING (claim_id, study_uid))"


def grid(s, d):
    x = X.claims(s, d).withColumn("study_uid", F.concat(F.lit("Y"), F.substring("study_date", 1, 4)))
    return R.claim_study_grid(x.select("claim_id", "session_id").distinct(), x.select("session_id", "study_uid").distinct(), x.groupBy("claim_id", "study_uid").agg(F.max_by("status", "study_key").alias("status")))


@query("j11_claim_study_grid", "claims", f"{GRID} SELECT claim_id, session_id, study_uid, status FROM gr")
def _(s, d):
    return grid(s, d).select("claim_id", "session_id", "study_uid", "status")


PG = "pg AS (SELECT DISTINCT session_id || '/' || reader AS page_id FROM view_events), src AS (SELECT DISTINCT session_id || '/' || reader AS page_id, sop_uid FROM view_events WHERE event_id % 4 <> 0), ok AS (SELECT * FROM view_events WHERE (CASE WHEN source = 'page' THEN page_path IS NOT NULL ELSE sop_uid <> '' END) AND dwell_ms >= 400 AND scale >= 1 AND focused AND visible), sh AS (SELECT DISTINCT session_id || '/' || reader AS page_id FROM ok WHERE source = 'page'), sn AS (SELECT DISTINCT sop_uid FROM ok WHERE source = 'viewer'), ct AS (SELECT page_id, count(*) AS n, count(sn.sop_uid) AS seen FROM src LEFT JOIN sn ON src.sop_uid = sn.sop_uid GROUP BY page_id), at AS (SELECT pg.page_id, sh.page_id IS NOT NULL OR coalesce(n = seen, false) AS attested, CASE WHEN sh.page_id IS NOT NULL THEN 'sheet displayed' WHEN n IS NULL THEN 'no sources' WHEN n = seen THEN 'all ' || n || ' displayed' ELSE (n - seen) || ' of ' || n || ' missing' END AS reason FROM pg LEFT JOIN sh ON pg.page_id = sh.page_id LEFT JOIN ct ON pg.page_id = ct.page_id)".replace("at AS (", "att AS (")


def attested(s, d):
    from slicelake.streaming.attest import accepted

    e = X.view_events(s, d).withColumn("page_id", F.concat_ws("/", "session_id", "reader"))
    ok = accepted(e)
    return R.page_attested(e.select("page_id").distinct(), e.where("event_id % 4 <> 0").select("page_id", "sop_uid").distinct(), ok.where("source = 'page'"), ok.where("source = 'viewer'"))


@query("j13_page_attested", "view_events", f"{PG} SELECT * FROM att")
def _(s, d):
    return attested(s, d)


@query("l15_reconcile_reviewed", "view_events", f"{PG}, w AS (SELECT *, length(page_id) % 2 = 0 AS was FROM att) SELECT page_id, attested AS reviewed, CASE WHEN attested AND NOT was THEN 'promoted' WHEN was AND NOT attested THEN 'refused' ELSE 'unchanged' END AS change FROM w")
def _(s, d):
    was = F.length("page_id") % 2 == 0
    return attested(s, d).select("page_id", c("attested").alias("reviewed"), F.when(c("attested") & ~was, "promoted").when(was & ~c("attested"), "refused").otherwise("unchanged").alias("change"))


@query("j14_apply_pass_scope", "instances", f"{PASSES}, k AS (SELECT series_uid, count(*) AS skipped FROM sk GROUP BY series_uid) SELECT ps.series_uid, purpose, CASE WHEN purpose = 'soft:native' THEN coalesce(skipped, 0) ELSE 0 END AS skipped FROM ps LEFT JOIN k USING (series_uid)")
def _(s, d):
    passes, _, skipped = passes_of(X.instances(s, d))
    return passes.join(skipped.groupBy("series_uid", "purpose").agg(F.count("*").alias("n")), ["series_uid", "purpose"], "left").select("series_uid", "purpose", F.coalesce("n", F.lit(0)).cast("long").alias("skipped"))


AUD = "rv AS (SELECT doc_id % 500 AS patient, lang AS site, max(n_chars)::DOUBLE / 100 AS size, CASE WHEN max(doc_id) % 2 = 0 THEN 'nodule' ELSE 'mass' END AS kind FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL), tr AS (SELECT doc_id % 500 AS patient, lang AS site, avg(n_chars) / 100 AS size, CASE WHEN min(doc_id) % 2 = 0 THEN 'nodule' ELSE 'mass' END AS kind FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL), au AS (SELECT patient, site, CASE WHEN t.size IS NULL THEN 'overcalled' WHEN r.size IS NULL THEN 'missed' WHEN r.kind = t.kind AND abs(r.size - t.size) <= CASE t.kind WHEN 'nodule' THEN 2 ELSE 0.2::DOUBLE * t.size END THEN CASE WHEN patient % 4 = 0 THEN 'matched (leaked)' ELSE 'matched' END ELSE 'partial' END AS status, patient % 4 = 0 AS leaked FROM rv r FULL JOIN tr t USING (patient, site))"


def audited(s, d):
    x = X.load(s, d, "documents").select("doc_id", (c("doc_id") % 500).alias("patient"), c("lang").alias("site"), "n_chars")
    kind = lambda f: F.when(f("doc_id") % 2 == 0, "nodule").otherwise("mass").alias("kind")
    g = lambda f, a, k: x.where(f).groupBy("patient", "site").agg((a / 100).alias("size"), kind(k))
    return R.audit_match(g("doc_id % 3 <> 0", F.max("n_chars").cast("double"), F.max), g("doc_id % 5 <> 0", F.avg("n_chars"), F.min), x.where("patient % 4 = 0"))


@query("j16_audit_match", "", f"{AUD} SELECT * FROM au")
def _(s, d):
    return audited(s, d)


@query("a25_audit_summary", "", f"{AUD} SELECT CASE WHEN patient % 3 = 0 THEN 'high' ELSE 'low' END AS importance, status, count(*) AS n FROM au GROUP BY CUBE (1, 2)")
def _(s, d):
    return audited(s, d).withColumn("importance", F.when(c("patient") % 3 == 0, "high").otherwise("low")).cube("importance", "status").agg(F.count("*").alias("n"))


@query("o07_severity_misses", "", f"{AUD}, o AS (SELECT patient, site, CASE WHEN patient % 3 = 0 THEN 'high' ELSE 'low' END AS importance FROM au WHERE status = 'missed') SELECT *, row_number() OVER (PARTITION BY site ORDER BY importance, patient)::INT AS place FROM o")
def _(s, d):
    m = audited(s, d).where("status = 'missed'").select("patient", "site", F.when(c("patient") % 3 == 0, "high").otherwise("low").alias("importance"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("importance", "patient")))


@query("j18_identity_documents", "", "SELECT doc_id, len(list_filter(list_value('the', 'tion', lang), lambda n : NOT contains(text, n))) = 0 AS complete, array_to_string(list_filter(list_value('the', 'tion', lang), lambda n : NOT contains(text, n)), ',') AS missing FROM documents")
def _(s, d):
    docs = X.load(s, d, "documents")
    names = docs.select(c("lang").alias("request")).distinct().withColumn("names", F.array(F.lit("the"), F.lit("tion"), "request"))
    return R.identity_documents(docs.withColumnRenamed("lang", "request"), names)


@query("w05_paginate", "instances", f"{ORD} SELECT sop_uid, CAST(k // 3 AS INT) AS page, CAST(k % 3 AS INT) AS slot FROM so")
def _(s, d):
    return R.paginate(I.slice_order(X.instances(s, d)), "series_uid", "k", 3).select("sop_uid", "page", "slot")


CH = "w AS (SELECT claim_id, first_value(value) OVER o AS first, last_value(value) OVER o AS last, first_value(unit) OVER o AS u1, last_value(unit) OVER o AS unit, count(*) OVER (PARTITION BY claim_id) AS n FROM claims WINDOW o AS (PARTITION BY claim_id ORDER BY study_date, study_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), ch AS (SELECT DISTINCT claim_id, first, last, unit, last - first AS delta, CASE WHEN first <> 0 THEN 100 * (last - first) / first END AS percent FROM w WHERE n > 1 AND u1 = unit)"


@query("w07_measured_change", "claims", f"{CH} SELECT claim_id, first, last, unit, round(delta, 4) AS delta, round(percent, 6) AS percent FROM ch")
def _(s, d):
    return R.measured_change(X.claims(s, d)).withColumns({"delta": F.round("delta", 4), "percent": F.round("percent", 6)})


@query("w08_chronology", "claims", "SELECT session_id, study_uid, CAST(row_number() OVER (PARTITION BY session_id ORDER BY study_date, study_key) AS INT) AS place FROM claims")
def _(s, d):
    return R.chronology(X.claims(s, d)).select("session_id", "study_uid", "place")


@query("w09_best_measurement", "claims", "x AS (SELECT claim_id, 'Y' || left(study_date, 4) AS study_uid, unit, value FROM claims), w AS (SELECT *, row_number() OVER (PARTITION BY claim_id, study_uid ORDER BY (unit = 'mm') DESC, value DESC) AS rn FROM x) SELECT claim_id, study_uid, unit, value FROM w WHERE rn = 1")
def _(s, d):
    x = X.claims(s, d).select("claim_id", F.concat(F.lit("Y"), F.substring("study_date", 1, 4)).alias("study_uid"), "unit", "value")
    return R.best_measurement(x)


@query("w11_months_between_studies", "claims", "w AS (SELECT claim_id, study_uid, study_date, lag(study_date) OVER (PARTITION BY claim_id ORDER BY study_date, study_key) AS p FROM claims), m AS (SELECT claim_id, study_uid, date_diff('day', strptime(p, '%Y%m%d'), strptime(study_date, '%Y%m%d')) AS days FROM w) SELECT claim_id, study_uid, round(CASE WHEN days > 0 THEN days / 30.44::DOUBLE END, 6) AS months FROM m")
def _(s, d):
    p = F.lag("study_date").over(Window.partitionBy("claim_id").orderBy("study_date", "study_key"))
    return X.claims(s, d).withColumn("p", p).select("claim_id", "study_uid", F.round(D.months_between("p", "study_date"), 6).alias("months"))


@query("w12_latest_state", "view_events", "w AS (SELECT *, row_number() OVER (PARTITION BY sop_uid ORDER BY ts DESC, event_id DESC) AS rn FROM view_events) SELECT sop_uid, event_id, reader, dwell_ms FROM w WHERE rn = 1")
def _(s, d):
    return R.latest_state(X.view_events(s, d), "sop_uid", F.struct("ts", "event_id")).select("sop_uid", "event_id", "reader", "dwell_ms")


@query("w13_bounded_log", "view_events", "w AS (SELECT event_id, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM view_events) SELECT * FROM w WHERE place <= 20")
def _(s, d):
    return R.bounded_log(X.view_events(s, d), "session_id", 20).select("event_id", "session_id", "place")


@query("w14_within_budget", "", "p AS (SELECT page_id, CAST(page_id % 20 AS BIGINT) AS session_id, length(html) AS bytes FROM pages) SELECT page_id, sum(CAST(ceil(bytes * 4 / 3) AS BIGINT)) OVER (PARTITION BY session_id ORDER BY page_id ROWS UNBOUNDED PRECEDING) <= 20000 AS kept FROM p")
def _(s, d):
    return R.within_budget(X.load(s, d, "pages").select("page_id", (c("page_id") % 20).alias("session_id"), F.length("html").alias("bytes")), 20000).select("page_id", "kept")


@query("o04_finding_severity_order", "claims", "x AS (SELECT session_id, claim_id, study_key, CASE verdict WHEN 'new' THEN 0 WHEN 'increased' THEN 1 WHEN 'stable' THEN 2 WHEN 'decreased' THEN 3 ELSE 4 END AS v, CASE priority WHEN 'high' THEN 0 WHEN 'routine' THEN 1 ELSE 2 END AS p FROM claims) SELECT session_id, study_key, CAST(row_number() OVER (PARTITION BY session_id ORDER BY v, p, study_key) AS INT) AS place FROM x")
def _(s, d):
    rank = lambda x, *names: F.coalesce(F.element_at(F.create_map(*[y for i, n in enumerate(names) for y in (F.lit(n), F.lit(i))]), x), F.lit(len(names)))
    order = Window.partitionBy("session_id").orderBy(rank(c("verdict"), "new", "increased", "stable", "decreased"), rank(c("priority"), "high", "routine"), "study_key")
    return X.claims(s, d).select("session_id", "study_key", F.row_number().over(order).alias("place"))


@query("o05_recent_sessions", "view_events", "SELECT session_id, max(ts) AS at FROM view_events GROUP BY session_id ORDER BY max(ts) DESC, session_id LIMIT 16".replace(" AS at", " AS seen_at"))
def _(s, d):
    return X.view_events(s, d).groupBy("session_id").agg(F.max("ts").alias("seen_at")).orderBy(c("seen_at").desc(), "session_id").limit(16)


@query("u01_tracked_files", "instances", "SELECT path, 'source' AS kind FROM instances UNION SELECT 'pages/' || page_id, 'page' FROM pages UNION SELECT DISTINCT folder, 'identity' FROM instances")
def _(s, d):
    i = X.instances(s, d)
    return i.select("path", F.lit("source").alias("kind")).unionByName(X.load(s, d, "pages").select(F.concat(F.lit("pages/"), "page_id").alias("path"), F.lit("page").alias("kind"))).unionByName(i.select(c("folder").alias("path"), F.lit("identity").alias("kind"))).distinct()


@query("u02_missing_sops", "instances", f"{PASSES} SELECT * FROM need EXCEPT SELECT * FROM cv EXCEPT SELECT * FROM sk")
def _(s, d):
    return slice_state(X.instances(s, d)).where("series_uid is not null").select("series_uid", "sop_uid", F.explode(unread_passes()).alias("purpose"))


@query("u03_valid_skips", "instances", "SELECT series_uid, sop_uid FROM (SELECT series_uid, CASE WHEN instance_number % 4 = 0 THEN sop_uid || '.x' ELSE sop_uid END AS sop_uid FROM instances WHERE z < 5) INTERSECT SELECT series_uid, sop_uid FROM instances")
def _(s, d):
    i = X.instances(s, d)
    return refs_of(i.where("z < 5")).select("series_uid", "sop_uid").intersect(i.select("series_uid", "sop_uid"))


@query("u04_timeline_complete", "claims", f"{GRID}, t AS (SELECT claim_id, list_sort(list(DISTINCT study_uid)) AS x FROM tl GROUP BY 1), q AS (SELECT session_id, list_sort(list(DISTINCT study_uid)) AS y FROM st GROUP BY 1) SELECT cl.claim_id, x = y AS complete FROM cl JOIN t USING (claim_id) JOIN q USING (session_id)")
def _(s, d):
    x = X.claims(s, d).withColumn("study_uid", F.concat(F.lit("Y"), F.substring("study_date", 1, 4)))
    t = x.groupBy("claim_id", "session_id").agg(F.collect_set("study_uid").alias("x"))
    return t.join(x.groupBy("session_id").agg(F.collect_set("study_uid").alias("y")), "session_id").select("claim_id", ((F.size(F.array_except("x", "y")) == 0) & (F.size(F.array_except("y", "x")) == 0)).alias("complete"))


@query("u05_endpoints_have_evidence", "claims", "e AS (SELECT claim_id, min(study_uid) AS a, max(study_uid) AS b FROM claims GROUP BY 1), f AS (SELECT claim_id, list(study_uid) AS refs FROM claims WHERE status <> 'not_covered' GROUP BY 1) SELECT e.claim_id, coalesce(list_contains(refs, a) AND list_contains(refs, b), false) AS ok FROM e LEFT JOIN f USING (claim_id)")
def _(s, d):
    g = X.claims(s, d).groupBy("claim_id").agg(F.min("study_uid").alias("a"), F.max("study_uid").alias("b"), F.collect_set(F.when(c("status") != "not_covered", c("study_uid"))).alias("refs"))
    return g.select("claim_id", (F.size(F.array_except(F.array("a", "b"), "refs")) == 0).alias("ok"))


@query("u06_single_identity", "instances", "SELECT folder, count(DISTINCT (patient_id, patient_name, birth_date)) = 1 AS single FROM instances GROUP BY folder")
def _(s, d):
    return X.instances(s, d).groupBy("folder").agg((F.count_distinct(F.struct("patient_id", "patient_name", "birth_date")) == 1).alias("single"))


@query("u07_skipped_slices", "instances", f"{PASSES}, x AS (SELECT * FROM need EXCEPT SELECT * FROM cv) SELECT series_uid, purpose, count(*) AS skipped, 'z below 3' AS basis FROM x GROUP BY series_uid, purpose")
def _(s, d):
    i = X.instances(s, d)
    passes, covered, _ = passes_of(i)
    need = i.select("series_uid", "sop_uid").distinct().join(passes, "series_uid").select("series_uid", "sop_uid", "purpose")
    return need.subtract(covered).groupBy("series_uid", "purpose").agg(F.count("*").alias("skipped"), F.lit("z below 3").alias("basis"))


@query("u08_missing_translations", "", "k AS (SELECT DISTINCT lang, 'k' || (doc_id % 60) AS key FROM documents), l AS (SELECT DISTINCT lang FROM documents) SELECT l.lang, e.key FROM l, k e WHERE e.lang = 'en' AND l.lang <> 'en' EXCEPT SELECT lang, key FROM k")
def _(s, d):
    k = X.load(s, d, "documents").select("lang", F.concat(F.lit("k"), (c("doc_id") % 60).cast("string")).alias("key")).distinct()
    langs = k.select("lang").distinct().where("lang <> 'en'")
    return langs.join(k.where("lang = 'en'").select("key")).select("lang", "key").subtract(k)


@query("p09_errors_for", "", "SELECT conv_id, turn, text LIKE '%th%' OR text LIKE '%on%' AS kept FROM conversations")
def _(s, d):
    return X.load(s, d, "conversations").select("conv_id", "turn", F.exists(F.array(F.lit("th"), F.lit("on")), lambda n: F.contains(c("text"), n)).alias("kept"))
