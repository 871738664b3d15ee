"""Queries over voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicelake import fixtures as X
from slicelake.operators import voxels as V
from slicelake.operators.inventory import tilt_fit
from slicelake.plans.registry import query

c = F.col
K = "series, k, r, c"


NUM = "((k::BIGINT << 21) + r << 21) + c"


def comp(mask: str, out: str, conn: int = 26) -> str:
    """SQL of the connected components of a mask, series by series: ``out`` has its columns and component, the least voxel number, and size."""
    near = {26: "greatest(abs(k), abs(r), abs(c)) = 1", 4: "k = 0 AND abs(r) + abs(c) = 1", 6: "abs(k) + abs(r) + abs(c) = 1"}[conn]
    return f"""{out}_m AS (SELECT *, {NUM} AS num, hash(series, k, r, c) AS id FROM {mask}),
{out}_o AS (SELECT * FROM (SELECT a.k, b.r, d.c FROM (SELECT unnest(list_value(-1, 0, 1)) AS k) a, (SELECT unnest(list_value(-1, 0, 1)) AS r) b, (SELECT unnest(list_value(-1, 0, 1)) AS c) d) WHERE {near}),
{out}_s AS (SELECT m.id, m.series, m.k + o.k AS k, m.r + o.r AS r, m.c + o.c AS c FROM {out}_m m, {out}_o o),
{out}_e AS (SELECT s.id AS a, b.id AS b FROM {out}_s s JOIN {out}_m b USING (series, k, r, c)),
{out}_cc(id, root) USING KEY (id) AS (SELECT id, num FROM {out}_m UNION SELECT e.b, min(cc.root) FROM {out}_cc cc JOIN {out}_e e ON e.a = cc.id JOIN recurring.{out}_cc l ON l.id = e.b WHERE cc.root < l.root GROUP BY e.b),
{out} AS (SELECT m.* EXCLUDE (id, num), root AS component, count(*) OVER (PARTITION BY series, root) AS size FROM {out}_m m JOIN {out}_cc USING (id))"""


def big(s, d):
    return X.vector_voxels(s, d)


@query("p04_threshold", "voxels", f"SELECT {K}, v, v > -200 AND v < 400 AS in_band FROM voxels WHERE (v > -200 AND v < 400) OR v >= 700")
def _(s, d):
    x = X.grid_voxels(s, d)
    return V.threshold(x, -200, 400).union(V.threshold(x, 700, strict=False)).select(*V.KEY, "v", ((c("v") > -200) & (c("v") < 400)).alias("in_band"))


@query("p05_crop", "voxels", f"SELECT {K}, v FROM voxels WHERE r >= greatest(0, 20 - 16) AND r < least(64, 20 + 16) AND c >= greatest(0, 60 - 16) AND c < least(64, 60 + 16)")
def _(s, d):
    return V.crop(X.grid_voxels(s, d), 20, 60, 16, 64, 64)


@query("p08_tile_positions", "", "b AS (SELECT p_partkey, p_size AS lo, p_size * 3 AS hi FROM part), i AS (SELECT *, unnest(generate_series(0, 5)) AS i FROM b) SELECT p_partkey, CAST(i AS INT) AS i, CAST(trunc(round(lo + (hi - lo) * 0.06::DOUBLE + ((hi - lo) * 0.88::DOUBLE) * i / 5, 9)) AS INT) AS at FROM i")
def _(s, d):
    b = X.load(s, d, "part").select("p_partkey", c("p_size").alias("lo"), (c("p_size") * 3).alias("hi")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return b.select("p_partkey", "i", F.round(c("lo") + (c("hi") - c("lo")) * 0.06 + ((c("hi") - c("lo")) * 0.88) * c("i") / 5, 9).cast("int").alias("at"))


@query("p10_context_slices", "voxels", "n AS (SELECT series, max(k) AS hi, min(k) AS lo FROM voxels GROUP BY series), q AS (SELECT DISTINCT series, k FROM voxels WHERE r = 3), i AS (SELECT series, k, k + unnest(list_value(-4, -2, 0, 2, 4)) AS place FROM q) SELECT i.series, i.k, CAST(place AS INT) AS place FROM i JOIN n USING (series) WHERE place BETWEEN lo AND hi")
def _(s, d):
    x = X.grid_voxels(s, d)
    return V.context_slices(x.where("r = 3").select("series", "k").distinct(), 4, 2, V.series_ends(x))


@query("p11_tiled_regions", "", "s AS (SELECT p_partkey, 32 + p_size * 4 AS side FROM part), o AS (SELECT p_partkey, side, list_distinct(list_concat(range(0, side - 32 + 1, 24), list_value(side - 32))) AS o FROM s) SELECT p_partkey, CAST(a AS INT) AS r0, CAST(b AS INT) AS c0 FROM (SELECT p_partkey, a, unnest(o) AS b FROM (SELECT p_partkey, o, unnest(o) AS a FROM o))")
def _(s, d):
    side = 32 + c("p_size") * 4
    origins = F.array_union(F.sequence(F.lit(0), side - 32, F.lit(24)), F.array(side - 32))
    return X.load(s, d, "part").select("p_partkey", origins.alias("o")).select("p_partkey", "o", F.explode("o").alias("r0")).select("p_partkey", "r0", F.explode("o").alias("c0"))


#: Decimals of the grid's values.
PLACES = 4
ROIS = "rois AS (SELECT series || '.' || k || '.' || r AS roi, series, k, r AS r0, min(c) AS c0, 3 + (r % 4) AS rad FROM voxels GROUP BY series, k, r), fv AS (SELECT roi, v.series, v.k, v.r, v.c, v FROM rois JOIN voxels v ON rois.series = v.series AND rois.k = v.k WHERE r0 - rad >= 0 AND c0 - rad >= 0 AND r0 + rad < 64 AND c0 + rad < 64 AND (r - r0) * (r - r0) + (c - c0) * (c - c0) <= rad * rad)"


def rois_of(x):
    return x.groupBy("series", "k", "r").agg(F.min("c").alias("c0")).select(F.concat_ws(".", "series", "k", "r").alias("roi"), "series", "k", c("r").alias("r0"), "c0", (3 + c("r") % 4).alias("rad"))


def found_of(s, d):
    x = X.grid_voxels(s, d)
    return V.roi_voxels(rois_of(x), x, 64, 64), x


@query("j05_roi_voxels", "voxels", f"{ROIS} SELECT roi, r, c, v FROM fv")
def _(s, d):
    return found_of(s, d)[0].select("roi", "r", "c", "v")


@query("a05_roi_stats", "voxels", f"{ROIS} SELECT roi, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS sd, min(v) AS least, max(v) AS most FROM fv GROUP BY roi")
def _(s, d):
    return V.roi_stats(found_of(s, d)[0]).withColumns({x: F.round(c(x) * 1e5) / 1e5 for x in ("mean", "sd")})  # as SQL rounds doubles: the product, not the decimal digits


@query("a06_suv_max", "voxels", f"{ROIS}, t AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY v DESC, r, c) AS rn FROM fv) SELECT roi, t.r AS pr, t.c AS pc, t.v AS peak, round(avg(x.v), 5) AS mean9 FROM t JOIN voxels x ON t.series = x.series AND t.k = x.k AND abs(t.r - x.r) <= 1 AND abs(t.c - x.c) <= 1 WHERE rn = 1 GROUP BY ALL")
def _(s, d):
    f, x = found_of(s, d)
    return V.suv_max(f, x).withColumn("mean9", F.round("mean9", 5))


@query("a24_reference_activity", "voxels", f"{ROIS}, g AS (SELECT roi, any_value(series) AS series, any_value(r0) AS r0, avg(v) AS mean FROM (SELECT fv.*, r0 FROM fv JOIN rois USING (roi, series, k)) GROUP BY roi), ref AS (SELECT fv.series, avg(v) AS ref_mean, stddev_pop(v) AS ref_sd FROM fv JOIN rois USING (roi) WHERE r0 < 8 GROUP BY fv.series) SELECT roi, round(mean / ref_mean, 6) + 0.0::DOUBLE AS ratio, round(ref_mean, 5) + 0.0::DOUBLE AS ref_mean, round(ref_sd, 5) AS ref_sd FROM g LEFT JOIN ref USING (series)")
def _(s, d):
    f, x = found_of(s, d)
    rois = rois_of(x).select("roi", "series", (c("r0") < 8).alias("reference"))
    out = V.reference_activity(V.roi_stats(f, PLACES).select("roi", "n", "mean", "sd", "total").join(rois, "roi"), PLACES)
    return out.withColumns({x: F.round(c(x) * 10.0**n) / 10.0**n + 0.0 for x, n in (("ratio", 6), ("ref_mean", 5), ("ref_sd", 5))})


BOXES = "boxes AS (SELECT p_partkey AS box, p_partkey % 8 AS series, p_size AS r0, p_size + 10 AS r1, p_partkey % 40 AS c0, p_partkey % 40 + 12 AS c1 FROM part), bv AS (SELECT box, v.* FROM boxes b JOIN voxels v ON b.series = v.series AND r >= r0 AND r < r1 AND c >= c0 AND c < c1)"


def boxed(s, d):
    b = X.load(s, d, "part").select(c("p_partkey").alias("box"), (c("p_partkey") % 8).cast("int").alias("series"), c("p_size").alias("r0"), (c("p_size") + 10).alias("r1"), (c("p_partkey") % 40).alias("c0"), (c("p_partkey") % 40 + 12).alias("c1"))
    return V.box_voxels(b, X.grid_voxels(s, d))


@query("j06_box_voxels", "voxels", f"{BOXES} SELECT box, {K}, v FROM bv")
def _(s, d):
    return boxed(s, d)


@query("a10_extent", "voxels", f"{BOXES}, p AS (SELECT box, k, count(*) AS n FROM bv WHERE v > -400 AND v < 600 GROUP BY ALL HAVING count(*) >= 2) SELECT box, count(*) AS slices, min(k) AS k0, max(k) AS k1, CAST(sum(n) AS BIGINT) AS voxels, abs(max(k) - min(k)) * 1.5::DOUBLE + 1.5::DOUBLE AS extent_mm FROM p GROUP BY box")
def _(s, d):
    return V.extent(boxed(s, d), -400, 600, 2, 1.5)


@query("j08_neighbour_pairs", "voxels", "m AS (SELECT * FROM voxels WHERE v > 300) SELECT a.series, ((a.k::BIGINT << 21) + a.r << 21) + a.c AS a, ((b.k::BIGINT << 21) + b.r << 21) + b.c AS b FROM m a JOIN m b ON a.series = b.series AND b.k BETWEEN a.k AND a.k + 1 AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 WHERE (a.k, a.r, a.c) < (b.k, b.r, b.c)")
def _(s, d):
    return V.neighbour_pairs(X.grid_voxels(s, d).where("v > 300"), 26)


@query("v01_connected_components", "vvoxels", f"m AS (SELECT * FROM vvoxels WHERE v >= 200), {comp('m', 'cc')} SELECT {K}, component, size FROM cc WHERE size >= 2")
def _(s, d):
    return V.connected_components(big(s, d).where("v >= 200"), 26, 2).select(*V.KEY, "component", "size")


def hot_sql(voxels: str, least: int) -> str:
    return f"m AS (SELECT * FROM {voxels} WHERE v >= {least}), {comp('m', 'cc')}, pk AS (SELECT *, row_number() OVER (PARTITION BY series, component ORDER BY v DESC, k, r, c) AS rn FROM cc), h AS (SELECT series, component, count(*) AS voxels, count(*) * 0.008::DOUBLE AS ml, max(v) AS most, avg(v) AS mean, min(k) AS k0, max(k) AS k1, (max(k) - min(k) + 1) * 2.0::DOUBLE AS extent_mm, max(CASE WHEN rn = 1 THEN k END) AS pk, max(CASE WHEN rn = 1 THEN r END) AS pr, max(CASE WHEN rn = 1 THEN c END) AS pc FROM pk WHERE size >= 3 GROUP BY series, component)"


def placed(x):
    """Slices of the volumes 2 mm apart, and of a CT of every study 3 mm apart that begins later."""
    k = x.select("series", "k").distinct()
    study = F.concat(F.lit("S"), (c("series") % 3).cast("string")).alias("study_uid")
    pet = k.select("series", "k", study, (c("k") * 2.0 + 0.5).alias("z"), *[F.lit(v).alias(n) for n, v in (("ipp_x", -25.6), ("ipp_y", -20.0), ("row_sp", 0.7), ("col_sp", 0.9))])
    return pet, k.select(study, "k").distinct().select("study_uid", "k", (c("k") * 3.0 + 5.0).alias("z"), (c("k") + 1).alias("instance"))


@query("a07_hotspots", "vvoxels", f"""{hot_sql('vvoxels', 200)}, ct AS (SELECT DISTINCT k, k * 3.0::DOUBLE + 5 AS z, k + 1 AS instance FROM vvoxels), co AS (SELECT greatest((SELECT min(z) FROM ct), min(k) * 2.0::DOUBLE + 0.5) AS low, least((SELECT max(z) FROM ct), max(k) * 2.0::DOUBLE + 0.5) AS high FROM vvoxels),
z AS (SELECT *, pk * 2.0::DOUBLE + 0.5 AS z_mm, -25.6::DOUBLE + pc * 0.9::DOUBLE AS x_mm, -20.0::DOUBLE + pr * 0.7::DOUBLE AS y_mm FROM h), i AS (SELECT z_mm, arg_min(instance, (abs(ct.z - z_mm), ct.k)) AS ct_instance FROM (SELECT DISTINCT z_mm FROM z), ct, co WHERE z_mm BETWEEN low AND high GROUP BY z_mm)
SELECT component, voxels, round(ml, 6) AS ml, most, round(mean, 6) AS mean, k0, k1, extent_mm, pk, pr, pc, z.z_mm, round(x_mm, 6) AS x_mm, round(y_mm, 6) AS y_mm, CASE WHEN x_mm < 0 THEN 'R' ELSE 'L' END AS side, ct_instance FROM z LEFT JOIN i USING (z_mm)""")
def _(s, d):
    x = big(s, d)
    h = V.hotspots(V.connected_components(x.where("v >= 200"), 26, 3), *placed(x), 0.008, 2.0)
    return h.drop("series", "study_uid").withColumns({n: F.round(n, 6) for n in ("ml", "mean", "x_mm", "y_mm")})


@query("o02_top_hotspots", "voxels", f"{hot_sql('voxels', 300)}, r AS (SELECT *, 'S' || (series % 3) AS study_uid, CAST(row_number() OVER (PARTITION BY series % 3 ORDER BY most DESC, series, pk, pr, pc) AS INT) AS place FROM h) SELECT study_uid, series, component, most, place FROM r WHERE place <= 5")
def _(s, d):
    x = X.grid_voxels(s, d)
    h = V.hotspots(V.connected_components(x.where("v >= 300"), 26, 3), *placed(x), 0.008, 2.0)
    return V.top_hotspots(h, 5).select("study_uid", "series", "component", "most", "place")


GROW = f"""seeds AS (SELECT {NUM} AS seed, series, k AS sk, r AS sr, c AS sc FROM vvoxels WHERE v >= 330),
b AS (SELECT seed AS series, v.k, v.r, v.c, v, sk, sr, sc FROM seeds s JOIN vvoxels v ON s.series = v.series AND abs(v.k - sk) <= 6 AND abs(v.r - sr) <= 6 AND abs(v.c - sc) <= 6 WHERE v > 80 AND v < 2000 AND pow((v.k - sk) * 2.0::DOUBLE, 2) + pow((v.r - sr) * 1.0::DOUBLE, 2) + pow((v.c - sc) * 1.0::DOUBLE, 2) <= 36),
{comp('b', 'gc')}, g AS (SELECT gc.series AS seed, gc.k, gc.r, gc.c, gc.v FROM gc JOIN gc s ON gc.series = s.series AND gc.component = s.component WHERE s.k = s.sk AND s.r = s.sr AND s.c = s.sc)"""


def seeds_of(x):
    """Voxels of 330 or more as seeds, by their numbers: the fixture has one series."""
    return x.where("v >= 330").select(V.node(c("k"), c("r"), c("c")).alias("seed"), "series", c("k").alias("sk"), c("r").alias("sr"), c("c").alias("sc"))


def grown(s, d):
    x = big(s, d)
    return V.grow_region(seeds_of(x), x, 80, 2000, 6.0, 26, (2.0, 1.0, 1.0))


@query("v02_grow_region", "vvoxels", f"{GROW} SELECT seed, k, r, c, v FROM g")
def _(s, d):
    return grown(s, d).select("seed", "k", "r", "c", "v")


@query("v02_seed_status", "vvoxels", f"seeds AS (SELECT {NUM} AS seed, series, k AS sk, r AS sr, c + 20 AS sc FROM vvoxels WHERE v >= 330) SELECT seed, v, CASE WHEN v IS NULL THEN 'outside the image' WHEN v > 80 AND v < 2000 THEN 'grown' ELSE 'outside the band' END AS status FROM seeds s LEFT JOIN vvoxels v ON s.series = v.series AND sk = k AND sr = r AND sc = c")
def _(s, d):
    x = big(s, d)
    return V.seed_status(seeds_of(x).withColumn("sc", c("sc") + 20), x, 80, 2000)


@query("a09_region_3d", "vvoxels", f"{GROW}, p AS (SELECT seed, k, count(*) AS n FROM g GROUP BY ALL) SELECT seed, CAST(sum(n) AS BIGINT) AS voxels, round(sum(n) * 0.002, 6)::DOUBLE AS ml, min(k) AS k0, max(k) AS k1, (max(k) - min(k)) * 2.0::DOUBLE + 2.0::DOUBLE AS craniocaudal_mm, arg_min(k, (-n, k)) AS largest_k FROM p GROUP BY seed")
def _(s, d):
    return V.region_3d(grown(s, d), 0.002, 2.0).withColumn("ml", F.round("ml", 6))


@query("a08_region_2d", "vvoxels", f"{GROW} SELECT seed, k, count(*) AS px, count(*) * 1.0::DOUBLE AS area_mm2, round(2 * sqrt(count(*) / 3.141592653589793::DOUBLE), 6) AS equivalent_mm, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, min(v) AS least, max(v) AS most, min(r) = 0 OR min(c) = 0 OR max(r) = 49 OR max(c) = 63 AS at_edge FROM g GROUP BY seed, k")
def _(s, d):
    return V.region_2d(grown(s, d), 1.0, 50, 64).withColumns({x: F.round(x, 6) for x in ("equivalent_mm", "mean", "sd")})


MASK = "m AS (SELECT series, k, r, c FROM voxels WHERE v > 0)"


def mask(s, d):
    return X.grid_voxels(s, d).where("v > 0").select(*V.KEY)


EDGE = "ed AS (SELECT DISTINCT a.* FROM m a, (SELECT unnest(list_value(1, -1, 0, 0)) AS dr, unnest(list_value(0, 0, 1, -1)) AS dc) o WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.series = a.series AND b.k = a.k AND b.r = a.r + dr AND b.c = a.c + dc))"


@query("v04_boundary", "voxels", f"{MASK}, {EDGE} SELECT {K} FROM ed")
def _(s, d):
    return V.boundary(mask(s, d), 4)


MASK2 = "m AS (SELECT series, k, r, c FROM voxels WHERE v > 450)"
FERET = f"""{MASK2}, {EDGE}, q AS (SELECT series, k, r * 0.7::DOUBLE AS y, c * 0.9::DOUBLE AS x FROM ed), pr AS (SELECT a.series, a.k, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2, sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d FROM q a JOIN q b ON a.series = b.series AND a.k = b.k AND (a.y, a.x) <= (b.y, b.x)),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, k ORDER BY round(d, 9) DESC, y1, x1, y2, x2) AS rn FROM pr) WHERE rn = 1),
t AS (SELECT w.series, w.k, d, y1, x1, y2, x2, q.y * CASE WHEN d > 0 THEN (x2 - x1) / d ELSE 1 END - q.x * CASE WHEN d > 0 THEN (y2 - y1) / d ELSE 0 END AS t FROM w JOIN q ON q.series = w.series AND q.k = w.k)
SELECT series, k, round(d + 0.8::DOUBLE, 5) AS long_mm, round(max(t) - min(t) + 0.8::DOUBLE, 5) AS short_mm, CAST(round(y1 / 0.7::DOUBLE) AS INT) AS r1, CAST(round(x1 / 0.9::DOUBLE) AS INT) AS c1, CAST(round(y2 / 0.7::DOUBLE) AS INT) AS r2, CAST(round(x2 / 0.9::DOUBLE) AS INT) AS c2 FROM t GROUP BY series, k, d, y1, x1, y2, x2"""


@query("v03_feret", "voxels", FERET)
def _(s, d):
    return V.feret(X.grid_voxels(s, d).where("v > 450").select(*V.KEY), 0.7, 0.9).withColumns({x: F.round(x, 5) for x in ("long_mm", "short_mm")})


VM = "m AS (SELECT series, k, r, c FROM vvoxels WHERE v > -60)"


def vmask(s, d):
    return big(s, d).where("v > -60").select(*V.KEY)


def inner(mask: str, out: str) -> str:
    """SQL of the voxels of a mask that no path over edges within a slice joins to the image's border."""
    return f"""{out}_m AS (SELECT {K}, hash(series, k, r, c) AS id FROM {mask}), {out}_e AS (SELECT m.id AS a, hash(series, k, r + o.dr, c + o.dc) AS b FROM {out}_m m, (SELECT unnest(list_value(1, -1, 0, 0)) AS dr, unnest(list_value(0, 0, 1, -1)) AS dc) o),
{out}_r(id) AS (SELECT id FROM {out}_m WHERE r = 0 OR c = 0 OR r = 49 OR c = 63 UNION SELECT m.id FROM {out}_r t JOIN {out}_e e ON e.a = t.id JOIN {out}_m m ON m.id = e.b), {out} AS (SELECT {K} FROM {out}_m ANTI JOIN {out}_r USING (id))"""


HOLES = f"em AS (SELECT v.series, v.k, v.r, v.c FROM vvoxels v ANTI JOIN m USING (series, k, r, c)), {inner('em', 'hole')}"


@query("v05_enclosed_air", "vvoxels", f"{VM}, {HOLES} SELECT {K} FROM hole")
def _(s, d):
    x = big(s, d)
    return V.enclosed(x.join(vmask(s, d), list(V.KEY), "left_anti").select(*V.KEY), 50, 64)


ERODED = "SELECT series, k, r - dr AS r, c - dc AS c FROM {}, st GROUP BY ALL HAVING count(*) = 5"
DILATED = "SELECT DISTINCT series, k, r + dr AS r, c + dc AS c FROM {}, st WHERE r + dr BETWEEN 0 AND 49 AND c + dc BETWEEN 0 AND 63"
LUNG = f"""st AS (SELECT unnest(list_value(0, 1, -1, 0, 0)) AS dr, unnest(list_value(0, 0, 0, 1, -1)) AS dc), air AS (SELECT {K} FROM vvoxels WHERE -v < -100), {inner('air', 'ins')},
er AS ({ERODED.format('ins')}), op AS (SELECT DISTINCT series, k, r + dr AS r, c + dc AS c FROM er, st), d1 AS ({DILATED.format('op')}), d2 AS ({DILATED.format('d1')}), e1 AS ({ERODED.format('d2')}), e2 AS ({ERODED.format('e1')}), un AS (SELECT {K} FROM ins UNION SELECT {K} FROM e2),
bg AS (SELECT v.series, v.k, v.r, v.c FROM vvoxels v SEMI JOIN un USING (series, k) ANTI JOIN un USING (series, k, r, c)), {inner('bg', 'hl')}, fl AS (SELECT {K} FROM un UNION ALL SELECT {K} FROM hl), {comp('fl', 'fc', 6)},
sz AS (SELECT series, component, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, component DESC) AS place FROM fc GROUP BY series, component)"""


@query("v08_lung_mask", "vvoxels", f"{LUNG} SELECT {K} FROM fc JOIN sz USING (series, component) WHERE place <= 2")
def _(s, d):
    return V.lung_mask(big(s, d).withColumn("v", -c("v")), 50, 64, thr=-100.0)


@query("v06_fill_holes", "vvoxels", f"{VM}, {HOLES} SELECT {K} FROM m UNION ALL SELECT {K} FROM hole")
def _(s, d):
    return V.fill_holes(big(s, d).select(*V.KEY, (c("v") > -60).alias("inside")), 50, 64)


@query("a21_aerated_fraction", "vvoxels", f"{VM}, {HOLES}, body AS (SELECT {K} FROM m UNION ALL SELECT {K} FROM hole), h AS (SELECT v.series, v.k, count(*) AS n FROM vvoxels v JOIN body USING (series, k, r, c) WHERE v < -80 GROUP BY ALL) SELECT s.series, s.k, coalesce(n, 0) / 3200.0::DOUBLE AS fraction FROM (SELECT DISTINCT series, k FROM vvoxels) s LEFT JOIN h USING (series, k)")
def _(s, d):
    return V.aerated_fraction(big(s, d), 50, 64, air=-80, body=-60)


STEPS4 = "st AS (SELECT unnest(list_value(0, 1, -1, 0, 0)) AS dr, unnest(list_value(0, 0, 0, 1, -1)) AS dc)"
DIL = "di AS (SELECT DISTINCT series, k, r + dr AS r, c + dc AS c FROM m, st)"


@query("v07_dilate", "voxels", f"{MASK2}, {STEPS4}, {DIL} SELECT * FROM di")
def _(s, d):
    return V.dilate(X.grid_voxels(s, d).where("v > 450").select(*V.KEY), V.offsets(4))


@query("v07_erode", "vvoxels", f"m AS (SELECT series, k, r, c FROM vvoxels WHERE v > -100), {STEPS4} SELECT series, k, r - dr AS r, c - dc AS c FROM m, st GROUP BY ALL HAVING count(*) = 5")
def _(s, d):
    return V.erode(big(s, d).where("v > -100").select(*V.KEY), V.offsets(4))


@query("v07_close", "voxels", f"{MASK}, {STEPS4}, {DIL} SELECT series, k, r - dr AS r, c - dc AS c FROM di, st GROUP BY ALL HAVING count(*) = 5")
def _(s, d):
    return V.closed(mask(s, d), V.offsets(4))


@query("v07_open", "vvoxels", f"{VM}, {STEPS4}, er AS (SELECT series, k, r - dr AS r, c - dc AS c FROM m, st GROUP BY ALL HAVING count(*) = 5) SELECT DISTINCT series, k, r + dr AS r, c + dc AS c FROM er, st")
def _(s, d):
    return V.opened(vmask(s, d), V.offsets(4))


@query("w03_longest_run", "voxels", """s AS (SELECT series * 64 + r AS series, k, avg(v) AS m FROM voxels GROUP BY ALL), e AS (SELECT series, min(k) AS lo, max(k) AS hi FROM s GROUP BY series), g AS (SELECT series, k, k - row_number() OVER (PARTITION BY series ORDER BY k) AS i FROM s WHERE m > 0), u AS (SELECT series, i, min(k) AS a, max(k) AS b FROM g GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY b - a DESC, a) AS rn FROM u)
SELECT series, greatest(lo, a - 1) AS a, least(hi, b + 1) AS b FROM w JOIN e USING (series) WHERE rn = 1""")
def _(s, d):
    x = X.grid_voxels(s, d).groupBy((c("series") * 64 + c("r")).alias("series"), "k").agg(V.whole_sum(c("v"), PLACES).alias("m"))  # of the mean's sign, and 0 where the mean is
    return V.longest_run(x, c("m") > 0, 1)


@query("w04_slab_mip", "voxels", f"SELECT {K}, max(v) OVER w AS hi, min(v) OVER w AS lo FROM voxels WINDOW w AS (PARTITION BY series, r, c ORDER BY k RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(s, d):
    x = X.grid_voxels(s, d)
    return V.slab(x.withColumn("v0", c("v")), 2).withColumnRenamed("v", "hi").withColumn("v", c("v0")).transform(lambda y: V.slab(y, 2, low=True)).select(*V.KEY, "hi", c("v").alias("lo"))


@query("w06_row_runs", "voxels", f"{MASK}, i AS (SELECT *, c - row_number() OVER (PARTITION BY series, k, r ORDER BY c) AS i FROM m) SELECT series, k, r, min(c) AS c0, max(c) AS c1 FROM i GROUP BY series, k, r, i")
def _(s, d):
    return V.row_runs(mask(s, d))


@query("v23_unpack_runs", "voxels", f"{MASK} SELECT {K} FROM m")
def _(s, d):
    return V.unpack_runs(V.row_runs(mask(s, d)))


@query("w10_line_profile", "voxels", """g AS (SELECT p_partkey AS segment, p_partkey % 8 AS series, 1 + p_partkey % 7 AS k, p_size AS r1, p_partkey % 60 AS c1, 60 - p_size AS r2, p_partkey % 50 AS c2 FROM part), n AS (SELECT *, greatest(abs(r2 - r1), abs(c2 - c1)) AS n FROM g), i AS (SELECT *, unnest(generate_series(0, n)) AS i FROM n),
a AS (SELECT segment, series, k, CAST(i AS INT) AS i, CAST(round_even(r1 + ((r2 - r1) * i)::DOUBLE / greatest(n, 1), 0) AS INT) AS r, CAST(round_even(c1 + ((c2 - c1) * i)::DOUBLE / greatest(n, 1), 0) AS INT) AS c FROM i) SELECT segment, i, a.r, a.c, v FROM a LEFT JOIN voxels v ON a.series = v.series AND a.k = v.k AND a.r = v.r AND a.c = v.c""")
def _(s, d):
    p = c("p_partkey")
    g = X.load(s, d, "part").select(p.alias("segment"), (p % 8).cast("int").alias("series"), (1 + p % 7).cast("int").alias("k"), c("p_size").alias("r1"), (p % 60).cast("int").alias("c1"), (60 - c("p_size")).alias("r2"), (p % 50).cast("int").alias("c2"))
    return V.line_profile(g, X.grid_voxels(s, d))


@query("a11_percentile_window", "voxels", "SELECT series, round(quantile_cont(v, 0.005), 6) AS lo, round(quantile_cont(v, 0.995), 6) AS hi FROM voxels GROUP BY series")
def _(s, d):
    return V.percentile_window(X.grid_voxels(s, d)).withColumns({x: F.round(x, 6) for x in ("lo", "hi")})


@query("a12_suggested_windows", "voxels", """n AS (SELECT series, count(DISTINCT k) AS n FROM voxels GROUP BY series), p AS (SELECT v.series, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM voxels v JOIN n USING (series) WHERE k % greatest(1, n // 8) = 0 GROUP BY v.series)
SELECT series, 'auto' AS name, round((lo + hi) / 2, 6) AS center, round(hi - lo, 6) AS width FROM p UNION ALL SELECT series, name, center, width FROM n, (VALUES ('lung', -600.0::DOUBLE, 1500.0::DOUBLE), ('mediastinum', 40.0::DOUBLE, 400.0::DOUBLE), ('bone', 400.0::DOUBLE, 1800.0::DOUBLE)) w(name, center, width)""")
def _(s, d):
    x = X.grid_voxels(s, d)
    n = x.groupBy("series").agg(F.count_distinct("k").alias("n"))
    p = x.join(n, "series").where(c("k") % F.greatest(F.lit(1), F.floor(c("n") / 8)) == 0).groupBy("series").agg(F.expr("percentile(v, 0.01D)").alias("lo"), F.expr("percentile(v, 0.99D)").alias("hi"))
    own = p.select("series", F.lit("auto").alias("name"), F.round((c("lo") + c("hi")) / 2, 6).alias("center"), F.round(c("hi") - c("lo"), 6).alias("width"))
    presets = s.createDataFrame([("lung", -600.0, 1500.0), ("mediastinum", 40.0, 400.0), ("bone", 400.0, 1800.0)], "name string, center double, width double")
    return own.union(n.select("series").crossJoin(F.broadcast(presets)))  # three rows


@query("a13_project", "voxels", "SELECT 'k' AS axis, series, r AS a, c AS b, max(v) AS hi, min(v) AS lo FROM voxels GROUP BY ALL UNION ALL SELECT 'r', series, k, c, max(v), min(v) FROM voxels GROUP BY ALL")
def _(s, d):
    x = X.grid_voxels(s, d)
    f = lambda axis, a, b: V.project(x, axis).withColumnRenamed("v", "hi").join(V.project(x, axis, True).withColumnRenamed("v", "lo"), ["series", a, b]).select(F.lit(axis).alias("axis"), "series", c(a).alias("a"), c(b).alias("b"), "hi", "lo")
    return f("k", "r", "c").union(f("r", "k", "c"))


@query("a14_depth_projection", "voxels", "w AS (SELECT series, k, r, c, greatest(v, -1350) AS v, row_number() OVER (PARTITION BY series, k, c ORDER BY greatest(v, -1350) DESC, r) AS rn FROM voxels) SELECT series, k, c, r AS depth, v FROM w WHERE rn = 1")
def _(s, d):
    return V.depth_projection(X.grid_voxels(s, d))


@query("a15_body_bbox", "voxels", """s AS (SELECT * FROM voxels WHERE k % 4 = 0), n AS (SELECT series, count(DISTINCT k) AS n FROM s GROUP BY series), h AS (SELECT s.series, r, c FROM s JOIN n USING (series) WHERE v > 900 GROUP BY s.series, r, c, n HAVING count(*) >= greatest(1, n // 20)), b AS (SELECT series, min(r) AS a, max(r) AS b, min(c) AS e, max(c) AS f FROM h GROUP BY series)
SELECT n.series, 0 AS r0, 64 AS r1, 0 AS c0, 64 AS c1 FROM n WHERE false UNION ALL SELECT n.series, coalesce(greatest(0, a - 8), 0), coalesce(least(64, b + 9), 64), coalesce(greatest(0, e - 8), 0), coalesce(least(64, f + 9), 64) FROM n LEFT JOIN (SELECT series, min(r) AS a, max(r) AS b, min(c) AS e, max(c) AS f FROM (SELECT series, r, c FROM s WHERE v > -500 GROUP BY ALL HAVING count(*) >= 2) GROUP BY series) b USING (series)""")
def _(s, d):
    return V.body_bbox(X.grid_voxels(s, d), 64, 64)


BAND = """m AS (SELECT point, profile, quantile_cont(v, 0.5) AS median FROM b GROUP BY ALL), e AS (SELECT b.point, b.profile, median, greatest(15, 1.4826::DOUBLE * quantile_cont(abs(v - median), 0.5)) AS spread FROM b JOIN m USING (point) GROUP BY ALL),
bd AS (SELECT *, CASE WHEN profile = 'bulla' THEN -1100 WHEN profile = 'effusion' THEN greatest(-40, median - 45) WHEN profile = 'cyst' THEN greatest(-200, median - greatest(70, 3 * spread)) WHEN median > 450 THEN 150 ELSE greatest(-450, median - greatest(180, 4 * spread)) END AS lo,
CASE WHEN profile = 'bulla' THEN least(-450, median + greatest(100, 3 * spread)) WHEN profile = 'effusion' THEN least(75, median + 45) WHEN profile = 'cyst' THEN median + greatest(80, 3 * spread) WHEN median > 450 THEN 4000 ELSE median + greatest(250, 4 * spread) END AS hi FROM e)"""


@query("a20_robust_band", "voxels", f"""q AS (SELECT p_partkey AS point, p_partkey % 8 AS series, 1 + p_partkey % 7 AS pk, p_size AS pr, p_partkey % 64 AS pc, list_value('bulla', 'effusion', 'cyst', 'solid')[1 + p_size % 4] AS profile FROM part), b AS (SELECT point, profile, v FROM q JOIN voxels v ON q.series = v.series WHERE pow((k - pk) * 2.0::DOUBLE, 2) + pow((r - pr) * 1.0::DOUBLE, 2) + pow((c - pc) * 1.0::DOUBLE, 2) <= 25),
{BAND} SELECT point, profile, round(median, 5) AS median, round(spread, 5) AS spread, round(lo, 5)::DOUBLE AS lo, round(hi, 5)::DOUBLE AS hi FROM bd""")
def _(s, d):
    x, p = X.grid_voxels(s, d), points(s, d)
    profile = F.element_at(F.array(*map(F.lit, V.PROFILES)), (1 + c("pr") % 4).cast("int"))
    b = V.ball_voxels(p, x, 5.0, (2.0, 1.0, 1.0)).join(x, list(V.KEY)).join(p.select("point", profile.alias("profile")), "point")
    return V.robust_band(b).withColumns({y: F.round(y, 5) for y in ("median", "spread", "lo", "hi")})


def points(s, d):
    p = c("p_partkey")
    return X.load(s, d, "part").select(p.alias("point"), (p % 8).cast("int").alias("series"), (1 + p % 7).alias("pk"), c("p_size").alias("pr"), (p % 64).alias("pc"))


@query("j20_ball_voxels", "voxels", "q AS (SELECT p_partkey AS point, p_partkey % 8 AS series, 1 + p_partkey % 7 AS pk, p_size AS pr, p_partkey % 64 AS pc FROM part) SELECT point, v.series, v.k, v.r, v.c FROM q JOIN voxels v ON q.series = v.series WHERE pow((k - pk) * 2.0::DOUBLE, 2) + pow((r - pr) * 1.0::DOUBLE, 2) + pow((c - pc) * 1.0::DOUBLE, 2) <= 25")
def _(s, d):
    return V.ball_voxels(points(s, d), X.grid_voxels(s, d), 5.0, (2.0, 1.0, 1.0))


@query("a22_value_range", "voxels", "SELECT series, min(v) AS lo, max(v) AS hi, bool_and(isfinite(v)) AS finite, bool_and(v = floor(v)) AND min(v) >= -32768 AND max(v) <= 32767 AS lossless_int16 FROM voxels GROUP BY series")
def _(s, d):
    return V.value_range(X.grid_voxels(s, d))


def summary_sql(g: str) -> str:
    """SQL of the summaries of masks g (seed, k, r, c, v), as ``ls``."""
    return f"""sa AS (SELECT seed, count(*) AS voxels, count(*) * 0.002::DOUBLE AS ml, min(k) AS k0, max(k) AS k1, (max(k) - min(k) + 1) * 2.0::DOUBLE AS craniocaudal_mm, avg(v) AS mean, avg(k) * 2.0::DOUBLE AS k_mm, avg(r) AS r_mm, avg(c) AS c_mm, quantile_cont(v, 0.02) AS heat_lo, quantile_cont(v, 0.98) AS heat_hi FROM {g} GROUP BY seed),
sf AS (SELECT g.seed, arg_min({{'k': k, 'r': r, 'c': c}}, (round(pow(k * 2.0::DOUBLE - k_mm, 2) + pow(r - r_mm, 2) + pow(c - c_mm, 2), 6), k, r, c)) AS f FROM {g} g JOIN sa USING (seed) GROUP BY g.seed),
sr AS (SELECT seed, k, r, min(c) AS c0, max(c) AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY seed, k, r ORDER BY c) AS i FROM {g}) GROUP BY seed, k, r, i), sd AS (SELECT seed, 'M' || sum(('0x' || left(md5(k || '.' || r || '.' || c0 || '.' || c1), 12))::BIGINT) AS id FROM sr GROUP BY seed),
ls AS (SELECT seed, voxels, round(ml, 6) AS ml, k0, k1, craniocaudal_mm, round(mean, 6) AS mean, round(k_mm, 6) AS k_mm, round(r_mm, 6) AS r_mm, round(c_mm, 6) AS c_mm, f.k AS focus_k, f.r AS focus_r, f.c AS focus_c, round(heat_lo, 6) AS heat_lo, round(heat_hi, 6) AS heat_hi, id FROM sa JOIN sf USING (seed) JOIN sd USING (seed))"""


def rounded_summary(df):
    return df.withColumns({x: F.round(x, 6) for x in ("ml", "mean", "k_mm", "r_mm", "c_mm", "heat_lo", "heat_hi")})


@query("a26_lesion_summary", "vvoxels", f"{GROW}, {summary_sql('g')} SELECT * FROM ls")
def _(s, d):
    from slicelake.scratch import written

    return rounded_summary(V.lesion_summary(written(grown(s, d), "grown"), (2.0, 1.0, 1.0)))


@query("v21_plane_descriptions", "voxels", f"{MASK}, p AS (SELECT series, unnest(list_value('axial', 'coronal', 'sagittal')) AS plane, k, r, c FROM m), q AS (SELECT series, plane, CASE plane WHEN 'axial' THEN k WHEN 'coronal' THEN r ELSE c END AS idx, CASE plane WHEN 'axial' THEN r ELSE 7 - k END AS y, CASE plane WHEN 'sagittal' THEN r ELSE c END AS x FROM p) SELECT series, plane, idx, count(*) AS pixels, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM q GROUP BY ALL")
def _(s, d):
    return V.plane_descriptions(mask(s, d), 8).withColumns({x: F.round(x, 6) for x in ("cy", "cx")})


@query("v21_plane_runs", "voxels", f"{MASK}, p AS (SELECT series, unnest(list_value('axial', 'coronal', 'sagittal')) AS plane, k, r, c FROM m), q AS (SELECT series, plane, CASE plane WHEN 'axial' THEN k WHEN 'coronal' THEN r ELSE c END AS idx, CASE plane WHEN 'axial' THEN r ELSE 7 - k END AS y, CASE plane WHEN 'sagittal' THEN r ELSE c END AS x FROM p), i AS (SELECT *, x - row_number() OVER (PARTITION BY series, plane, idx, y ORDER BY x) AS i FROM q) SELECT series, plane, idx, y, min(x) AS x0, max(x) AS x1 FROM i GROUP BY series, plane, idx, y, i")
def _(s, d):
    return V.plane_runs(mask(s, d), 8)


@query("v22_mask_overlap", "voxels", "a AS (SELECT * FROM voxels WHERE v > 0), b AS (SELECT * FROM voxels WHERE v < 300), n AS (SELECT series, count(*) AS n FROM a GROUP BY series), o AS (SELECT series, count(*) AS n FROM b GROUP BY series), i AS (SELECT series, count(*) AS n FROM a WHERE v < 300 GROUP BY series) SELECT n.series, round(2 * i.n / (n.n + o.n)::DOUBLE, 9) AS dice FROM n JOIN o USING (series) JOIN i USING (series)")
def _(s, d):
    x = X.grid_voxels(s, d)
    return V.dice(x.where("v > 0"), x.where("v < 300")).withColumn("dice", F.round("dice", 9))


@query("v20_layer_thickness", "vvoxels", f"{VM}, ou AS (SELECT DISTINCT series, k, r + dr AS r, c + dc AS c FROM m, (SELECT unnest(list_value(1, -1, 0, 0)) AS dr, unnest(list_value(0, 0, 1, -1)) AS dc) o), bo AS (SELECT * FROM ou ANTI JOIN m USING (series, k, r, c)), n AS (SELECT m.series, m.k, m.r, m.c, min(sqrt(pow((m.r - e.r) * 0.7::DOUBLE, 2) + pow((m.c - e.c) * 0.9::DOUBLE, 2))) AS depth FROM m JOIN bo e ON m.series = e.series AND m.k = e.k GROUP BY ALL) SELECT series, k, round(2 * max(depth), 6) AS thickness FROM n GROUP BY ALL")
def _(s, d):
    return V.layer_thickness(vmask(s, d), (0.7, 0.9)).withColumn("thickness", F.round("thickness", 6))


def trilinear(f: float, rows: int, cols: int, name: str) -> str:
    return f"""n AS (SELECT series, min(k) AS k0, max(k) AS k1 FROM {name} GROUP BY series), tk AS (SELECT series, k0, unnest(generate_series(0, CAST(floor((k1 - k0) / {f}::DOUBLE) AS INT))) AS k FROM n), tr AS (SELECT unnest(generate_series(0, CAST(floor({rows - 1} / {f}::DOUBLE) AS INT))) AS r), tc AS (SELECT unnest(generate_series(0, CAST(floor({cols - 1} / {f}::DOUBLE) AS INT))) AS c),
g AS (SELECT series, k, r, c, k0 + k * {f}::DOUBLE AS z, r * {f}::DOUBLE AS y, c * {f}::DOUBLE AS x FROM tk, tr, tc), o AS (SELECT a.a, b.b, e.e FROM (SELECT unnest(list_value(0, 1)) AS a) a, (SELECT unnest(list_value(0, 1)) AS b) b, (SELECT unnest(list_value(0, 1)) AS e) e),
w AS (SELECT g.*, CAST(floor(z) + a AS INT) AS sa, CAST(floor(y) + b AS INT) AS sb, CAST(floor(x) + e AS INT) AS se, (CASE WHEN a = 0 THEN 1 - (z - floor(z)) ELSE z - floor(z) END) * (CASE WHEN b = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN e = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM g, o)
SELECT w.series, CAST(w.k AS INT) AS k, CAST(w.r AS INT) AS r, CAST(w.c AS INT) AS c, round(sum(w * coalesce(v.v, 0)), 6) + 0.0::DOUBLE AS v FROM w LEFT JOIN {name} v ON v.series = w.series AND v.k = sa AND v.r = sb AND v.c = se WHERE w > 0 GROUP BY w.series, w.k, w.r, w.c"""


@query("v10_resample_iso", "vvoxels", trilinear(0.75, 50, 64, "vvoxels"))
def _(s, d):
    return V.resample_iso(big(s, d), 0.75, 50, 64).withColumn("v", F.round("v", 6) + 0.0)


@query("v17_preview", "vvoxels", trilinear(2.5, 50, 64, "vvoxels"))
def _(s, d):
    return V.resample_iso(big(s, d), 2.5, 50, 64).withColumn("v", F.round("v", 6) + 0.0)


KERNEL = [0.25, 0.5, 0.25]


@query("v11_separable_filter", "vvoxels", f"t AS (SELECT unnest(list_value(-1, 0, 1)) AS o, unnest(list_value(0.25::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE)) AS w), a AS (SELECT {K}, w, CASE WHEN c + o < 0 THEN -(c + o) - 1 WHEN c + o >= 64 THEN 127 - (c + o) ELSE c + o END AS at FROM vvoxels, t) SELECT a.series, a.k, a.r, a.c, sum(w * v) AS v FROM a JOIN vvoxels v ON a.series = v.series AND a.k = v.k AND a.r = v.r AND a.at = v.c GROUP BY ALL")
def _(s, d):
    return V.separable_filter(big(s, d), KERNEL, "c", 64)


@query("v13_local_maxima", "vvoxels", f"""w1 AS (SELECT {K}, v, max(v) OVER (PARTITION BY series, r, c ORDER BY k RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM vvoxels), w2 AS (SELECT {K}, v, max(m) OVER (PARTITION BY series, k, c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM w1), w3 AS (SELECT {K}, v, max(m) OVER (PARTITION BY series, k, r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM w2),
p AS (SELECT {K}, v FROM w3 WHERE v >= 150 AND v = m), {comp('p', 'pc')}, z AS (SELECT *, row_number() OVER (PARTITION BY series, component ORDER BY {K}) AS rn FROM pc) SELECT {K}, v FROM z WHERE rn = 1""")
def _(s, d):
    return V.local_maxima(big(s, d), 150)


@query("v15_deshear", "vvoxels", f"f AS (SELECT series, min(v) AS f FROM vvoxels GROUP BY series) SELECT g.series, g.k, g.r, g.c, coalesce(v.v, f) AS v FROM vvoxels g JOIN f USING (series) LEFT JOIN vvoxels v ON v.series = g.series AND v.k = g.k AND g.r = v.r + CAST(round_even(v.k * 0.63::DOUBLE, 0) AS INT) AND g.c = v.c + CAST(round_even(v.k * -0.27::DOUBLE, 0) AS INT)")
def _(s, d):
    # the slices' headers: 1 mm apart, pixels of 0.7 by 0.9 mm, origins that drift by 0.63 and -0.27 pixels a slice
    x = big(s, d)
    headers = x.select("series", "k").distinct().select(
        c("series").alias("series_uid"), c("k").cast("string").alias("sop_uid"), c("k").cast("string").alias("path"), F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)]).alias("iop"),
        (c("k") * 0.9 * -0.27).alias("ipp_x"), (c("k") * 0.7 * 0.63).alias("ipp_y"), c("k").cast("double").alias("ipp_z"), F.lit(0.7).alias("row_sp"), F.lit(0.9).alias("col_sp"),
    )
    return V.deshear(x, tilt_fit(headers).withColumnRenamed("series_uid", "series"), 50, 64)


@query("v16_rotate_mip", "vvoxels", """g AS (SELECT series, k, r, c, unnest(list_value(0, 30, 75)) AS deg FROM vvoxels), a AS (SELECT *, CAST(round_even(round((r - 24.5::DOUBLE) * cos(radians(deg)) + (c - 31.5::DOUBLE) * sin(radians(deg)) + 24.5::DOUBLE, 6), 0) AS INT) AS sr, CAST(round_even(round((c - 31.5::DOUBLE) * cos(radians(deg)) - (r - 24.5::DOUBLE) * sin(radians(deg)) + 31.5::DOUBLE, 6), 0) AS INT) AS sc FROM g)
SELECT deg, a.series, a.k, a.c, max(coalesce(v, 0)) AS v FROM a LEFT JOIN vvoxels v ON v.series = a.series AND v.k = a.k AND v.r = sr AND v.c = sc GROUP BY ALL""")
def _(s, d):
    return V.rotate_mip(big(s, d), [0, 30, 75], 50, 64)
