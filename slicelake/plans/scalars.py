"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicelake import fixtures as X
from slicelake.functions import dates as D
from slicelake.functions import geometry as G
from slicelake.functions import keyed as K
from slicelake.functions import labels as L
from slicelake.functions import quantities as Q
from slicelake.plans.registry import query

c = F.col
PARSE = "CASE WHEN {t} IS NULL OR {t} = '' THEN NULL ELSE try_strptime(left(coalesce(nullif({d}, ''), '19000101'), 8) || left(rpad(split_part({t}, '.', 1), 6, '0'), 6), '%Y%m%d%H%M%S') + to_microseconds(CAST(round(coalesce(TRY_CAST('0.' || nullif(split_part({t}, '.', 2), '') AS DOUBLE), 0) * 1000000) AS BIGINT)) END"
REST = "coalesce(nullif(regexp_extract(substr({s}, 9), '^([^+-]*)', 1), ''), '000000')"


def parse(d: str, t: str) -> str:
    return PARSE.format(d=d, t=t)


def parse_dt(s: str) -> str:
    return f"CASE WHEN length({s}) >= 8 THEN {parse(f'left({s}, 8)', '(' + REST.format(s=s) + ')')} END"


@query("f01_parse_da_tm", "instances", f"SELECT sop_uid, series_time, {parse('series_date', 'series_time')} AS at, {parse('study_date', 'study_time')} AS study_at FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", "series_time", D.parse_da_tm("series_date", "series_time").alias("at"), D.parse_da_tm("study_date", "study_time").alias("study_at"))


@query("f02_parse_dt", "instances", f"SELECT sop_uid, decay_correction_dt, {parse_dt('decay_correction_dt')} AS at, {parse_dt('study_date')} AS midnight FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", "decay_correction_dt", D.parse_dt("decay_correction_dt").alias("at"), D.parse_dt("study_date").alias("midnight"))


@query("f03_shift_date", "instances", "SELECT sop_uid, strftime(strptime(study_date, '%Y%m%d') - INTERVAL 77 DAY, '%Y%m%d') AS moved, CASE WHEN decay_correction_dt IS NULL THEN NULL ELSE strftime(strptime(left(decay_correction_dt, 8), '%Y%m%d') - INTERVAL 77 DAY, '%Y%m%d') || substr(decay_correction_dt, 9) END AS moved_dt, study_time AS not_a_date FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", D.shift_date("study_date", -77).alias("moved"), D.shift_date("decay_correction_dt", -77).alias("moved_dt"), D.shift_date("study_time", -77).alias("not_a_date"))


@query("f04_date_text", "", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS short_date, CAST(day(o_orderdate) AS VARCHAR) || ' ' || list_value('Ocak','Şubat','Mart','Nisan','Mayıs','Haziran','Temmuz','Ağustos','Eylül','Ekim','Kasım','Aralık')[month(o_orderdate)] || ' ' || year(o_orderdate) AS long_date, o_orderpriority AS passed FROM orders")
def _(s, d):
    months = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return X.load(s, d, "orders").select("o_orderkey", D.short_date(day).alias("short_date"), D.long_date(day, months).alias("long_date"), D.short_date("o_orderpriority").alias("passed"))


def hmac_sql(key: str, value: str) -> str:
    import hashlib

    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    i, o = (bytes(b ^ p for b in k).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode({value}))))"


KEY = "archive-key"


@query("f05_hmac_sha256", "", f"SELECT c_custkey, {hmac_sql(KEY, 'c_name')} AS digest FROM customer")
def _(s, d):
    return X.load(s, d, "customer").select("c_custkey", K.hmac_sha256(KEY, c("c_name")).alias("digest"))


@query("f06_pseudo_ids", "", f"SELECT c_custkey, 'OR-' || upper(left({hmac_sql(KEY, 'c_name')}, 12)) AS patient_id, 'ANON^' || upper(left({hmac_sql(KEY, 'c_name')}, 8)) AS name FROM customer")
def _(s, d):
    return X.load(s, d, "customer").select("c_custkey", K.pseudo_patient_id(KEY, c("c_name")).alias("patient_id"), K.pseudo_name(KEY, c("c_name")).alias("name"))


@query("f07_pseudo_uid", "", f"h AS (SELECT c_custkey, {hmac_sql(KEY, 'c_name')} AS h FROM customer) SELECT c_custkey, '2.25.' || CAST(CAST(('0x' || substr(h, 1, 16))::UBIGINT AS UHUGEINT) * 18446744073709551616::UHUGEINT + CAST(('0x' || substr(h, 17, 16))::UBIGINT AS UHUGEINT) AS VARCHAR) AS uid FROM h")
def _(s, d):
    return X.load(s, d, "customer").select("c_custkey", K.pseudo_uid(KEY, c("c_name")).alias("uid"))


@query("f08_salt_date_shift", "", "SELECT n_nationkey, -(CAST(('0x' || left(sha256(n_name), 2)) AS INT) % 365 + 1) AS days FROM nation")
def _(s, d):
    return X.load(s, d, "nation").select("n_nationkey", (-(F.conv(F.substring(F.sha2("n_name", 256), 1, 2), 16, 10).cast("int") % 365 + 1)).cast("int").alias("days"))


@query("f09_rescale", "instances", "SELECT sop_uid, slice_location * rescale_slope + rescale_intercept AS hu FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", Q.rescale(c("slice_location"), c("rescale_slope"), c("rescale_intercept")).alias("hu"))


@query("f10_voi_window", "voxels", "SELECT series, k, r, c, CAST(trunc(least(greatest((v - (40 - 400 / 2.0::DOUBLE)) / 400::DOUBLE, 0), 1) * 255) AS INT) AS grey, CAST(trunc(255 - least(greatest((v - (-600 - 1500 / 2.0::DOUBLE)) / 1500::DOUBLE, 0), 1) * 255) AS INT) AS inverse FROM voxels")
def _(s, d):
    v = lambda centre, width, inv: Q.voi_window(c("v"), F.lit(float(centre)), F.lit(float(width)), F.lit(inv))
    return X.grid_voxels(s, d).select("series", "k", "r", "c", v(40, 400, False).alias("grey"), v(-600, 1500, True).alias("inverse"))


@query("f11_reported_diameter", "", """a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DOUBLE AS long_mm, l_quantity::DOUBLE * 0.5::DOUBLE AS short_mm, CASE WHEN l_orderkey % 2 = 0 THEN 'fleischner' ELSE 'recist' END AS convention, CASE WHEN l_partkey % 5 = 0 THEN 'node' ELSE 'nodule' END AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN kind = 'node' THEN short_mm WHEN convention = 'fleischner' AND (long_mm + short_mm) / 2 < 10 THEN (long_mm + short_mm) / 2 ELSE long_mm END AS mm,
CASE WHEN kind = 'node' THEN 'short axis' WHEN convention = 'fleischner' AND (long_mm + short_mm) / 2 < 10 THEN 'average of axes, under 10 mm' WHEN convention = 'recist' THEN 'long axis, recist' ELSE 'long axis, 10 mm or more' END AS how FROM a""")
def _(s, d):
    long_ = c("l_quantity").cast("double")
    mm, how = Q.reported_diameter(long_, long_ * 0.5, F.when(c("l_orderkey") % 2 == 0, "fleischner").otherwise("recist"), F.when(c("l_partkey") % 5 == 0, "node").otherwise("nodule"))
    return X.load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mm.alias("mm"), how.alias("how"))


@query("f12_lean_body_mass", "instances", """SELECT sop_uid, round(CASE WHEN patient_weight > 0 AND patient_size > 0 THEN CASE patient_sex WHEN 'M' THEN 9270 * patient_weight / (6680 + 216 * (patient_weight / (patient_size * patient_size))) WHEN 'F' THEN 9270 * patient_weight / (8780 + 244 * (patient_weight / (patient_size * patient_size))) END END, 6) AS lbm,
round(CASE WHEN patient_weight > 0 AND patient_size > 0 THEN CASE patient_sex WHEN 'M' THEN 1.10::DOUBLE * patient_weight - 120 * pow(patient_weight / (patient_size * 100), 2) WHEN 'F' THEN 1.07::DOUBLE * patient_weight - 148 * pow(patient_weight / (patient_size * 100), 2) END END, 6) AS james FROM instances""")
def _(s, d):
    f = lambda k: F.round(Q.lean_body_mass(c("patient_weight"), c("patient_size"), c("patient_sex"), k), 6)
    return X.instances(s, d).select("sop_uid", f("janmahasatian").alias("lbm"), f("james").alias("james"))


START_SQL = f"""e AS (SELECT series_uid, min({parse('acquisition_date', 'acquisition_time')}) AS early FROM instances GROUP BY series_uid),
s AS (SELECT DISTINCT i.series_uid, early, {parse_dt('decay_correction_dt')} AS fixed, {parse('series_date', 'series_time')} AS series FROM instances i JOIN e USING (series_uid)),
t AS (SELECT series_uid, coalesce(fixed, CASE WHEN early < series THEN early END, series, early) AS start, CASE WHEN fixed IS NOT NULL THEN 'decay correction' WHEN early < series THEN 'earliest acquisition' WHEN series IS NOT NULL THEN 'series' WHEN early IS NOT NULL THEN 'acquisition' END AS source FROM s)"""


def scan_starts(instances):
    """(series_uid, start, source) of each series."""
    from slicelake.functions.quantities import scan_start

    rows = instances.groupBy("series_uid").agg(F.min(D.parse_da_tm("acquisition_date", "acquisition_time")).alias("early"), *[F.min_by(x, "path").alias(x) for x in ("decay_correction_dt", "series_date", "series_time")])
    at, source = scan_start(c("decay_correction_dt"), c("series_date"), c("series_time"), c("early"))
    return rows.select("series_uid", at.alias("start"), source.alias("source"))


@query("f13_scan_start", "instances", START_SQL + " SELECT series_uid, start, source FROM t")
def _(s, d):
    return scan_starts(X.instances(s, d))


INJ = f"coalesce({parse_dt('rp_start_dt')}, {parse('series_date', 'rp_start_time')})"


@query("f14_suv_factor", "instances", START_SQL + f""", a AS (SELECT i.*, start, (epoch_us(start) - epoch_us({INJ})) / 1e6::DOUBLE AS up FROM instances i JOIN t USING (series_uid) WHERE modality = 'PT'),
b AS (SELECT *, CASE WHEN total_dose IS NULL THEN 'no radiopharmaceutical' WHEN total_dose <= 0 OR half_life <= 0 OR half_life IS NULL THEN 'invalid dose or half-life' WHEN patient_weight IS NULL OR patient_weight = 0 THEN 'weight missing' WHEN NOT patient_weight BETWEEN 20 AND 400 THEN 'implausible weight'
  WHEN units = 'GML' THEN NULL WHEN units = 'CNTS' AND activity_scale IS NULL AND suv_scale IS NOT NULL THEN NULL WHEN units = 'CNTS' AND activity_scale IS NULL THEN 'counts without scale' WHEN units NOT IN ('CNTS', 'BQML') THEN 'units not supported'
  WHEN decay_correction = 'START' AND up IS NULL THEN 'missing injection or scan start' WHEN decay_correction = 'START' AND up < 0 THEN 'injection after scan start' WHEN decay_correction NOT IN ('START', 'ADMIN') THEN 'decay correction not supported' END AS error,
  units = 'CNTS' AND activity_scale IS NULL AND suv_scale IS NOT NULL AS given FROM a)
SELECT sop_uid, error, round(CASE WHEN error IS NULL THEN CASE WHEN units = 'GML' THEN 1 WHEN given THEN suv_scale ELSE (CASE WHEN units = 'CNTS' THEN activity_scale ELSE 1 END) * (patient_weight * 1000) / (CASE WHEN decay_correction = 'START' THEN total_dose * exp(-ln(2) * up / half_life) ELSE total_dose END) END END, 9) AS factor,
round(CASE WHEN error IS NULL AND units <> 'GML' AND NOT given THEN up / 60 END, 6) AS uptake_min,
concat_ws(';', CASE WHEN error IS NULL AND units <> 'GML' AND NOT given AND decay_correction = 'START' AND up > 21600 THEN 'implausible uptake interval' END, CASE WHEN error IS NULL AND units <> 'GML' AND NOT given AND decay_correction = 'START' AND NOT up / 60 BETWEEN 45 AND 90 THEN 'uptake outside window' END) AS warnings FROM b""")
def _(s, d):
    i = X.instances(s, d)
    f = Q.suv_factor(c("start"))
    return i.where("modality = 'PT'").join(scan_starts(i), "series_uid").select("sop_uid", f["error"].alias("error"), F.round(f["factor"], 9).alias("factor"), F.round(f["uptake_min"], 6).alias("uptake_min"), f["warnings"].alias("warnings"))


NORMAL = ("(iop[2] * iop[6] - iop[3] * iop[5])", "(iop[3] * iop[4] - iop[1] * iop[6])", "(iop[1] * iop[5] - iop[2] * iop[4])")
PLANE = "CASE WHEN iop IS NULL THEN '?' WHEN abs({0}) >= abs({1}) AND abs({0}) >= abs({2}) THEN 'SAG' WHEN abs({1}) >= abs({2}) THEN 'COR' ELSE 'AX' END".format(*NORMAL)


@query("f15_plane_of", "instances", f"SELECT sop_uid, {PLANE} AS plane FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", G.plane_of(c("iop")).alias("plane"))


@query("f16_z_of", "instances", "SELECT sop_uid, coalesce({0} * ipp_x + {1} * ipp_y + {2} * ipp_z, ipp_z) + 0.0::DOUBLE AS z FROM instances".format(*NORMAL))
def _(s, d):
    return X.instances(s, d).select("sop_uid", G.z_of([c("ipp_x"), c("ipp_y"), c("ipp_z")], c("iop"), c("slice_location"), c("instance_number")).alias("z"))


@query("f17_direction_label", "", """v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
u AS (SELECT vec_id, 0 AS a, abs(x) AS m, CASE WHEN x > 0 THEN 'L' ELSE 'R' END AS l FROM v UNION ALL SELECT vec_id, 1, abs(y), CASE WHEN y > 0 THEN 'P' ELSE 'A' END FROM v UNION ALL SELECT vec_id, 2, abs(z), CASE WHEN z > 0 THEN 'S' ELSE 'I' END FROM v),
g AS (SELECT vec_id, string_agg(l, '' ORDER BY m DESC, a) FILTER (m > 0.1::DOUBLE) AS label FROM u GROUP BY vec_id)
SELECT v.vec_id, coalesce(label, '') AS label, CASE WHEN greatest(abs(x), abs(y), abs(z)) < 0.2::DOUBLE THEN '' WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x >= 0 THEN 'L' ELSE 'R' END WHEN abs(y) >= abs(z) THEN CASE WHEN y >= 0 THEN 'P' ELSE 'A' END ELSE CASE WHEN z >= 0 THEN 'H' ELSE 'F' END END AS letter FROM v JOIN g USING (vec_id)""")
def _(s, d):
    x, y, z = (c("embedding")[i].cast("double") for i in range(3))
    return X.load(s, d, "embeddings").select("vec_id", G.direction_label(x, y, z).alias("label"), G.direction_letter(x, y, z, 0.2).alias("letter"))


@query("f18_patient_point", "instances", "SELECT sop_uid, ipp_x + 5 * col_sp * iop[1] + 7 * row_sp * iop[4] + 0.0::DOUBLE AS x, ipp_y + 5 * col_sp * iop[2] + 7 * row_sp * iop[5] + 0.0::DOUBLE AS y, ipp_z + 5 * col_sp * iop[3] + 7 * row_sp * iop[6] + 0.0::DOUBLE AS z FROM instances WHERE iop IS NOT NULL")
def _(s, d):
    p = G.patient_point([c("ipp_x"), c("ipp_y"), c("ipp_z")], c("iop"), c("row_sp"), c("col_sp"), F.lit(7), F.lit(5))
    return X.instances(s, d).where("iop is not null").select("sop_uid", *[v.alias(n) for v, n in zip(p, "xyz", strict=True)])


@query("f19_geometry_scalars", "instances", "SELECT sop_uid, row_sp * col_sp * slice_thickness AS voxel_mm3, slice_thickness / col_sp AS aspect, round(2 * sqrt(slice_location / 3.141592653589793::DOUBLE), 6) AS equivalent_mm, round(2 * sqrt(3::DOUBLE) * row_sp, 6) AS sphere_mm FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", (c("row_sp") * c("col_sp") * c("slice_thickness")).alias("voxel_mm3"), (c("slice_thickness") / c("col_sp")).alias("aspect"), F.round(G.equivalent_diameter(c("slice_location")), 6).alias("equivalent_mm"), F.round(2 * F.sqrt(F.lit(3.0)) * c("row_sp"), 6).alias("sphere_mm"))


@query("f20_fit_grid", "", """p AS (SELECT p_partkey, p_size * 12 AS w, p_size * 10 AS h, CASE WHEN p_partkey % 4 = 0 THEN 'auto' WHEN p_partkey % 4 = 1 THEN '3x3' WHEN p_partkey % 4 = 2 THEN '13x12' ELSE '4x2' END AS grid FROM part),
q AS (SELECT *, TRY_CAST(split_part(grid, 'x', 1) AS INT) AS gc, TRY_CAST(split_part(grid, 'x', 2) AS INT) AS gr, CAST(greatest(1, floor(500 / (w + 2))) AS INT) AS bc, CAST(greatest(1, floor(500 / (h + 2))) AS INT) AS br FROM p),
t AS (SELECT *, CASE WHEN w + 2 > 500 OR h + 2 > 500 THEN 'tile too large' WHEN grid = 'auto' THEN 'ok' WHEN gc IS NULL OR gr IS NULL THEN 'bad grid' WHEN gc < 1 OR gr < 1 OR gc * gr > 144 THEN 'out of range' WHEN gc <= bc AND gr <= br THEN 'ok' ELSE 'reduced' END AS status FROM q)
SELECT p_partkey, grid, CASE WHEN status IN ('ok', 'reduced') THEN CASE WHEN grid = 'auto' THEN bc ELSE least(gc, bc) END END AS cols, CASE WHEN status IN ('ok', 'reduced') THEN CASE WHEN grid = 'auto' THEN br ELSE least(gr, br) END END AS rows, status FROM t""")
def _(s, d):
    grid = F.when(c("p_partkey") % 4 == 0, "auto").when(c("p_partkey") % 4 == 1, "3x3").when(c("p_partkey") % 4 == 2, "13x12").otherwise("4x2")
    g = L.fit_grid(c("p_size") * 12, c("p_size") * 10, grid, F.lit(500))
    return X.load(s, d, "part").select("p_partkey", grid.alias("grid"), *[v.alias(k) for k, v in g.items()])


MR_SQL = """CASE WHEN list_contains(image_type, 'DIFFUSION') AND list_contains(image_type, 'ADC') THEN 'DWI ADC map' WHEN list_contains(image_type, 'DIFFUSION') THEN 'DWI trace' || CASE WHEN regexp_extract(sequence_name, 'b([0-9]+)', 1) <> '' THEN ' b=' || regexp_extract(sequence_name, 'b([0-9]+)', 1) ELSE '' END
WHEN list_contains(image_type, 'SWI') THEN 'SWI (magnitude/processed)' WHEN list_contains(image_type, 'P') AND contains(sequence_name, 'swi') THEN 'SWI phase' WHEN list_contains(image_type, 'M') AND contains(sequence_name, 'swi') THEN 'SWI raw magnitude'
ELSE CASE WHEN ti > 1500 AND te > 80 THEN 'T2 FLAIR' || CASE WHEN contains(sequence_name, 'spc') OR slice_thickness <= 1.5 THEN ' 3D' ELSE '' END WHEN ti BETWEEN 600 AND 1300 AND te < 10 THEN 'T1 MPRAGE/3D GRE' WHEN list_contains(scanning_sequence, 'SE') AND te >= 70 THEN 'T2 TSE' WHEN list_contains(scanning_sequence, 'SE') AND te < 30 AND tr < 900 THEN 'T1 SE'
  WHEN list_contains(scanning_sequence, 'GR') AND te < 6 AND tr < 60 THEN 'T1 GRE (localizer / fast)' WHEN list_contains(scanning_sequence, 'GR') AND te > 15 THEN 'T2* GRE' ELSE 'unclassified' END
  || CASE WHEN concat_ws('; ', CASE WHEN list_contains(image_type, 'DERIVED') AND list_contains(image_type, 'PARALLEL') THEN 'reformat of 3D acquisition' END, 'contrast agent tag: ' || contrast_agent) <> '' THEN ' [' || concat_ws('; ', CASE WHEN list_contains(image_type, 'DERIVED') AND list_contains(image_type, 'PARALLEL') THEN 'reformat of 3D acquisition' END, 'contrast agent tag: ' || contrast_agent) || ']' ELSE '' END END"""


@query("f22_mr_guess", "instances", f"SELECT sop_uid, {MR_SQL} AS guess FROM instances WHERE modality = 'MR'")
def _(s, d):
    return X.instances(s, d).where("modality = 'MR'").select("sop_uid", L.mr_guess(*map(c, ("image_type", "scanning_sequence", "te", "tr", "ti", "sequence_name", "slice_thickness", "contrast_agent"))).alias("guess"))


@query("f23_inventory_hints", "instances", """h AS (SELECT series_uid, unnest(list_value(CASE WHEN number_of_frames > 1 THEN 'multi-frame object' END, CASE WHEN modality = 'CT' AND gantry_tilt_tag <> 0 THEN 'gantry tilt' END, CASE WHEN modality = 'CT' AND slice_thickness > 1.5 THEN 'thick sections' END,
CASE WHEN modality = 'PT' AND units <> 'BQML' THEN 'units ' || units END, CASE WHEN modality = 'PT' AND decay_correction NOT IN ('START', 'ADMIN') THEN 'decay correction ' || decay_correction END, CASE WHEN modality = 'PT' AND patient_weight IS NULL THEN 'weight missing' END)) AS hint FROM instances)
SELECT series_uid, hint, count(*) AS n FROM h WHERE hint IS NOT NULL GROUP BY ALL""")
def _(s, d):
    ct, pt = c("modality") == "CT", c("modality") == "PT"
    hints = F.array(
        F.when(c("number_of_frames") > 1, "multi-frame object"), F.when(ct & (c("gantry_tilt_tag") != 0), "gantry tilt"), F.when(ct & (c("slice_thickness") > 1.5), "thick sections"), F.when(pt & (c("units") != "BQML"), F.concat(F.lit("units "), "units")),
        F.when(pt & ~c("decay_correction").isin("START", "ADMIN"), F.concat(F.lit("decay correction "), "decay_correction")), F.when(pt & c("patient_weight").isNull(), "weight missing"),
    )
    return X.instances(s, d).select("series_uid", F.explode(F.filter(hints, lambda x: x.isNotNull())).alias("hint")).groupBy("series_uid", "hint").agg(F.count("*").alias("n"))


PHRASES = "list_value('kalsifiye granülom', 'sağda BÜL, amfizem', 'plevral sıvı effusion', 'solid nodül', 'damar', 'basit kist', 'A bulla', 'no word of these')"
#: Whole texts, each with a phrase after it, under a headline that is a source's name or a phrase.
TEXTS = f"t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {PHRASES}[1 + (doc_id // 3) % 8] ELSE source END AS headline, text || ' ' || {PHRASES}[1 + doc_id % 8] AS technical, doc_id % 2000 - 1000 AS hu FROM documents)"
#: Patterns written out once more, so that a slip in the library's table shows.
TISSUE_SQL = """SELECT *, CASE WHEN regexp_matches({0}, 'kalsifi|granülom|granulom|kireç|stapler|klips') THEN 1 WHEN regexp_matches({0}, 'bül|amfizem|hava kist|pnömotoraks') THEN 2 WHEN regexp_matches({0}, 'efüzyon|plevral sıvı|basit kist|kortikal kist|su kesesi|sıvı dansite') THEN 3
WHEN regexp_matches({0}, 'kitle|solid nodül|lenf nod|güdük|stump|herni|jinekomasti|yumuşak doku') THEN 4 WHEN regexp_matches({0}, 'damar|vasküler|vaskuler') THEN 5 END AS {1} FROM {2}"""


def finding_texts(s, d):
    phrases = F.expr(f"{PHRASES}".replace("list_value", "array"))
    pick = lambda i: F.get(phrases, (i % 8).cast("int"))
    return X.load(s, d, "documents").select("doc_id", F.when(c("doc_id") % 3 == 0, pick(F.floor(c("doc_id") / 3))).otherwise(c("source")).alias("headline"), F.concat("text", F.lit(" "), pick(c("doc_id"))).alias("technical"), (c("doc_id") % 2000 - 1000).alias("hu"))


@query("f24_expected_tissue", "", f"""{TEXTS}, a AS ({TISSUE_SQL.format("lower(headline)", "h", "t")}), b AS ({TISSUE_SQL.format("lower(technical || ' ' || headline)", "w", "a")}), e AS (SELECT doc_id, hu, coalesce(h, w) AS i FROM b), f(i, label, lo, hi) AS (VALUES (1, 'kalsifik', 120, 3200), (2, 'hava', -1024, -650), (3, 'sıvı', -30, 45), (4, 'yumuşak doku', -30, 180), (5, 'damar', -20, 400))
SELECT doc_id, label, lo, hi, hu BETWEEN lo AND hi AS agrees FROM e LEFT JOIN f USING (i)""")
def _(s, d):
    return finding_texts(s, d).withColumn("t", L.expected_tissue(c("headline"), c("technical"))).select("doc_id", "t.label", "t.lo", "t.hi", c("hu").between(c("t.lo"), c("t.hi")).alias("agrees"))


@query("f25_tissue_profile", "", f"{TEXTS} SELECT doc_id, CASE WHEN regexp_matches(lower(technical), 'efüzyon|effusion|plevral sıvı') THEN 'effusion' WHEN regexp_matches(lower(technical), '(^|[ ,(])bül([ ,.)]|$)|bulla') THEN 'bulla' WHEN regexp_matches(lower(technical), 'kist|cyst') THEN 'cyst' WHEN regexp_matches(lower(technical), 'kitle|nodül|nodule|mass|solid') THEN 'solid' ELSE 'auto' END AS profile FROM t")
def _(s, d):
    return finding_texts(s, d).select("doc_id", L.tissue_profile(c("technical")).alias("profile"))


@query("f26_mentions", "", "SELECT doc_id, len(list_filter(list_value(lang, source, 'tion'), lambda n : length(n) >= 3 AND contains(lower(text), lower(n)))) > 0 AS mentioned FROM documents")
def _(s, d):
    return X.load(s, d, "documents").select("doc_id", L.mentions(c("text"), F.array("lang", "source", F.lit("tion"))).alias("mentioned"))


KEYWORDS = "list_value('SOPInstanceUID', 'SOPClassUID', 'FrameOfReferenceUID', 'ReferencedSOPClassUID', 'TransferSyntaxUID', '')"


@query("f27_instance_uid_keyword", "", f"k AS (SELECT conv_id, turn, text || {KEYWORDS}[1 + (conv_id + turn) % 6] AS keyword FROM conversations) SELECT conv_id, turn, regexp_matches(keyword, 'Instance|FrameOfReference|Concatenation|Referenced') AND NOT contains(keyword, 'Class') AS is_instance FROM k")
def _(s, d):
    k = F.concat("text", F.get(F.expr(KEYWORDS.replace("list_value", "array")), ((c("conv_id") + c("turn")) % 6).cast("int")))
    return X.load(s, d, "conversations").select("conv_id", "turn", L.looks_like_instance_uid(k).alias("is_instance"))


@query("f28_valid_patterns", "instances", "SELECT sop_uid, regexp_full_match(sop_uid, '[0-9.]{1,64}') AS uid_ok, regexp_full_match(frame_uid, '[0-9.]{1,64}') AS frame_ok, regexp_full_match(sha256(path), '[0-9a-f]{64}') AS sha_ok, regexp_full_match(patient_name, '[a-z_]+(:[a-z_]+)?') AS pass_ok FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", L.valid_uid(c("sop_uid")).alias("uid_ok"), L.valid_uid(c("frame_uid")).alias("frame_ok"), L.valid_sha(F.sha2("path", 256)).alias("sha_ok"), c("patient_name").rlike("^[a-z_]+(:[a-z_]+)?$").alias("pass_ok"))


#: Messages about real rows, and texts that are none.
MESSAGES = """CASE conv_id % 16 WHEN 0 THEN 'Reading not complete' WHEN 1 THEN 'Series ' || turn || ': disposition pending' WHEN 2 THEN 'Series ' || turn || ' lung: ' || conv_id || ' unread/unrendered slices' WHEN 3 THEN 'Unreviewed page: pages/' || turn || '.png' WHEN 4 THEN role || ' lobe: unresolved region'
WHEN 5 THEN 'C' || turn || ': text missing' WHEN 6 THEN 'C' || turn || ': patient explanation ' || role || ' missing' WHEN 7 THEN 'C' || turn || ': timeline must cover every supplied study' WHEN 8 THEN 'Comparison not completed' WHEN 9 THEN role || ': ' || turn || ': coordinates out of range' WHEN 10 THEN 'C ' || turn || ': text missing'
WHEN 11 THEN 'No rendered pages registered' WHEN 12 THEN 'Claim IDs must be unique' WHEN 13 THEN 'C' || turn || ': comparison endpoints reversed' WHEN 14 THEN 'Series ' || turn || ' lung: unread/unrendered slices' ELSE text END"""


@query("f29_classify_blocker", "", f"""m AS (SELECT conv_id, turn, {MESSAGES} AS x FROM conversations) SELECT conv_id, turn, CASE WHEN x = 'Reading not complete' THEN 'session' WHEN x = 'Claim IDs must be unique' THEN 'claim' WHEN x = 'Comparison not completed' THEN 'comparison' WHEN x = 'No rendered pages registered' OR regexp_full_match(x, 'Unreviewed page: .+') THEN 'pages'
WHEN regexp_full_match(x, 'Series \\S+: disposition pending') OR regexp_full_match(x, 'Series \\S+ \\S+: \\d+ unread/unrendered slices') THEN 'series' WHEN regexp_full_match(x, '.+: (unresolved region|coordinates out of range)') THEN 'region' WHEN regexp_full_match(x, '\\S+: (text missing|patient explanation \\S+ missing)') THEN 'claim'
WHEN regexp_full_match(x, '\\S+: (timeline must cover every supplied study|comparison endpoints reversed)') THEN 'comparison' END AS place FROM m""")
def _(s, d):
    return X.load(s, d, "conversations").select("conv_id", "turn", L.classify_blocker(F.expr(MESSAGES)).alias("place"))


@query("f30_distance_mm", "instances", "SELECT sop_uid, round(sqrt(pow((3 - ipp_x) * row_sp, 2) + pow((4 - ipp_y) * col_sp, 2)), 6) AS mm FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", F.round(G.distance_mm(F.lit(3), F.lit(4), c("ipp_x"), c("ipp_y"), c("row_sp"), c("col_sp")), 6).alias("mm"))


@query("f33_names", "instances", "SELECT sop_uid, regexp_replace(institution, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, CASE WHEN TRY_CAST(series_number AS INT) IS NOT NULL THEN 'S' || lpad(series_number, 3, '0') ELSE 'S' || left(sha256(series_uid), 8) END AS dir, lpad(CAST(instance_number AS VARCHAR), 5, '0') AS stem FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", L.safe_name(c("institution")).alias("safe"), L.series_dir(c("series_number"), c("series_uid")).alias("dir"), L.file_stem(c("instance_number"), c("sop_uid")).alias("stem"))


@query("f34_change_label", "", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' → ' || CASE WHEN l_quantity % 2 = 0 THEN CAST(CAST(l_quantity / 2 AS BIGINT) AS VARCHAR) ELSE printf('%.1f', l_quantity / 2) END || ' mm' AS label FROM lineitem")
def _(s, d):
    q = c("l_quantity").cast("double")
    return X.load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", L.change_label(q, q / 2, F.lit("mm")).alias("label"))


@query("f35_lesion_marker", "", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN round((l_partkey % 64 + l_suppkey % 64) / 2.0::DOUBLE) WHEN l_partkey % 3 = 1 THEN (l_partkey % 64)::DOUBLE ELSE 7::DOUBLE END AS row_at, CASE WHEN l_partkey % 3 = 2 THEN 'address' ELSE 'extent' END AS kind FROM lineitem""")
def _(s, d):
    points = F.filter(F.array(F.when(c("l_partkey") % 3 != 2, c("l_partkey") % 64), F.when(c("l_partkey") % 3 == 0, c("l_suppkey") % 64)), lambda p: p.isNotNull())
    row = F.when(F.size(points) == 2, F.round((F.get(points, 0) + F.get(points, 1)) / 2.0)).otherwise(F.coalesce(F.get(points, 0), F.lit(7)).cast("double"))
    return X.load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", row.alias("row_at"), F.when(F.size(points) == 0, "address").otherwise("extent").alias("kind"))


@query("f36_project_voxel", "voxels", "p AS (SELECT unnest(list_value('axial', 'coronal', 'sagittal')) AS plane) SELECT plane, series, k, r, c, CASE plane WHEN 'axial' THEN k WHEN 'coronal' THEN r ELSE c END AS idx, CASE plane WHEN 'axial' THEN r ELSE 7 - k END AS row_at, CASE plane WHEN 'sagittal' THEN r ELSE c END AS col_at FROM voxels, p")
def _(s, d):
    i, r, k = G.project_voxel(c("k"), c("r"), c("c"), c("plane"), F.lit(8))
    return X.grid_voxels(s, d).withColumn("plane", F.explode(F.array(*map(F.lit, ("axial", "coronal", "sagittal"))))).select("plane", "series", "k", "r", "c", i.alias("idx"), r.alias("row_at"), k.alias("col_at"))


@query("f37_growth_flag", "claims", "w AS (SELECT claim_id, study_key, value, lag(value) OVER (PARTITION BY claim_id ORDER BY study_date, study_key) AS before FROM claims) SELECT claim_id, study_key, CASE WHEN value - before >= 2 OR value >= 1.25 * before THEN 'growth' ELSE 'no measurable change' END AS flag FROM w WHERE before IS NOT NULL")
def _(s, d):
    from pyspark.sql import Window

    w = X.claims(s, d).withColumn("before", F.lag("value").over(Window.partitionBy("claim_id").orderBy("study_date", "study_key")))
    return w.where("before is not null").select("claim_id", "study_key", Q.growth_flag(c("before"), c("value"), c("before"), c("value")).alias("flag"))


@query("f38_presence", "claims", "SELECT claim_id, study_key, CASE status WHEN 'present' THEN 'present' WHEN 'not_seen' THEN 'absent' WHEN 'resolved' THEN 'absent' WHEN 'not_covered' THEN 'not_covered' ELSE 'unknown' END AS presence FROM claims")
def _(s, d):
    return X.claims(s, d).select("claim_id", "study_key", L.presence(c("status"), F.lit(True)).alias("presence"))


@query("f39_seed_profile", "voxels", "a AS (SELECT *, CASE WHEN (r + c) % 3 = 0 THEN 'solid' WHEN (r + c) % 3 = 1 THEN 'bulla' ELSE 'auto' END AS p FROM voxels), b AS (SELECT *, CASE WHEN p = 'auto' THEN CASE WHEN v < -650 THEN 'bulla' ELSE 'solid' END ELSE p END AS profile FROM a) SELECT series, k, r, c, profile, (profile = 'bulla' AND v >= -650) OR (profile = 'solid' AND v < -650) AS contradicts FROM b")
def _(s, d):
    p, bad = L.seed_profile(c("v"), F.when((c("r") + c("c")) % 3 == 0, "solid").when((c("r") + c("c")) % 3 == 1, "bulla").otherwise("auto"))
    return X.grid_voxels(s, d).select("series", "k", "r", "c", p.alias("profile"), bad.alias("contradicts"))
