"""The canonical tables, derived from the generic test tables.

Each adapter is one SELECT that Spark and an ANSI SQL engine both run; ``ARR(`` stands for the array
constructor, which the two spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INSTANCES = """
SELECT '1.2.' || o_orderkey AS study_uid,
  '1.2.' || o_orderkey || '.' || ascii(l_returnflag) AS series_uid,
  '1.2.' || o_orderkey || '.' || ascii(l_returnflag) || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS sop_uid,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '1.9.' || (o_orderkey % 1000) || CASE WHEN o_orderkey % 5 = 0 THEN '.' || ascii(l_returnflag) ELSE '' END END AS frame_uid,
  'P' || o_custkey AS patient_id, c_name AS patient_name, '19' || (40 + o_custkey % 60) || '0101' AS birth_date,
  'ACC' || o_orderkey AS accession, 'Site ' || c_nationkey AS institution,
  'arch/' || (o_custkey % 50) || '/' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '/' || o_orderkey ELSE '' END AS folder,
  'arch/' || (o_custkey % 50) || '/' || o_custkey || '/' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS path,
  CASE l_returnflag WHEN 'A' THEN 'CT' WHEN 'N' THEN 'MR' ELSE 'PT' END AS modality,
  CASE l_returnflag WHEN 'A' THEN '10' WHEN 'N' THEN '9' ELSE 'R' END AS series_number,
  CAST(l_linenumber AS INT) AS instance_number, 64 AS n_rows, CAST(64 + 64 * (o_orderkey % 2) AS INT) AS n_cols,
  CAST(0.5 AS DOUBLE) + (o_orderkey % 4) * CAST(0.25 AS DOUBLE) AS row_sp, CAST(0.5 AS DOUBLE) + (o_orderkey % 4) * CAST(0.25 AS DOUBLE) AS col_sp,
  CAST(l_partkey % 10 AS DOUBLE) AS ipp_x, CAST(l_suppkey % 10 AS DOUBLE) AS ipp_y, CAST(l_linenumber AS DOUBLE) AS ipp_z,
  CASE WHEN o_orderkey % 4 = 3 THEN ARR(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(-1 AS DOUBLE))
    WHEN o_orderkey % 4 = 2 THEN ARR(CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(-1 AS DOUBLE))
    WHEN o_orderkey % 17 = 0 THEN NULL
    ELSE ARR(CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)) END AS iop,
  CAST(l_linenumber AS DOUBLE) AS z, CAST(l_quantity AS DOUBLE) AS slice_location,
  CAST(1 + o_orderkey % 3 AS DOUBLE) AS slice_thickness, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 12.5 ELSE 0 END AS DOUBLE) AS gantry_tilt_tag,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(1 + l_partkey % 2 AS DOUBLE) END AS rescale_slope, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(-1000 AS DOUBLE) END AS rescale_intercept,
  CASE WHEN l_suppkey % 23 = 0 THEN 'RGB' ELSE 'MONOCHROME2' END AS photometric, CASE WHEN l_partkey % 29 = 0 THEN 2 ELSE 1 END AS number_of_frames,
  CASE WHEN o_orderkey % 7 = 0 THEN ARR('DERIVED', 'PRIMARY', 'DIFFUSION', 'ADC') WHEN o_orderkey % 7 = 1 THEN ARR('ORIGINAL', 'PRIMARY', 'DIFFUSION') WHEN o_orderkey % 7 = 2 THEN ARR('ORIGINAL', 'SWI') WHEN o_orderkey % 7 = 3 THEN ARR('DERIVED', 'PARALLEL', 'P') ELSE ARR('ORIGINAL', 'PRIMARY', 'M') END AS image_type,
  CASE WHEN o_orderkey % 2 = 0 THEN ARR('SE') ELSE ARR('GR') END AS scanning_sequence,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 90 WHEN o_orderkey % 5 = 1 THEN 20 ELSE 4 END AS DOUBLE) AS te, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 50 ELSE 600 END AS DOUBLE) AS tr,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(1800 AS DOUBLE) WHEN o_orderkey % 6 = 1 THEN CAST(900 AS DOUBLE) END AS ti,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ep_b1000' WHEN o_orderkey % 4 = 1 THEN 'swi3d' ELSE 'spc' END AS sequence_name, CASE WHEN o_orderkey % 11 = 0 THEN 'Gadolinium' END AS contrast_agent,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(l_linenumber % 3 AS DOUBLE) * 500 END AS b_value,
  CASE WHEN o_orderkey % 8 = 0 THEN 'CNTS' WHEN o_orderkey % 8 = 1 THEN 'GML' WHEN o_orderkey % 8 = 2 THEN 'PROPCPS' ELSE 'BQML' END AS units,
  CASE o_orderstatus WHEN 'F' THEN 'START' WHEN 'O' THEN 'ADMIN' ELSE 'NONE' END AS decay_correction,
  CASE WHEN o_orderkey % 13 = 0 THEN replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') || '110500.250000+0100' END AS decay_correction_dt,
  replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS study_date, CASE WHEN o_orderkey % 19 = 0 THEN '25' ELSE '1' || (o_orderkey % 10) || '3000' END AS study_time,
  replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS series_date, '11' || CASE WHEN o_orderkey % 2 = 0 THEN '00' ELSE '30' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '15.5' END AS series_time,
  replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS acquisition_date, '1' || CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE '1' END || '4500' AS acquisition_time,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(15 + o_custkey % 80 AS DOUBLE) END AS patient_weight, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST(1.5 AS DOUBLE) + (o_custkey % 5) * CAST(0.1 AS DOUBLE) END AS patient_size,
  CASE WHEN o_custkey % 3 = 0 THEN 'M' WHEN o_custkey % 3 = 1 THEN 'F' ELSE 'O' END AS patient_sex,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(l_extendedprice * 10000 AS DOUBLE) END AS total_dose, CASE WHEN o_orderkey % 37 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(6586.2 AS DOUBLE) END AS half_life,
  CASE WHEN o_orderkey % 3 = 0 THEN replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') || '1010' || '00' END AS rp_start_dt, '10' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '2000' END AS rp_start_time,
  CASE WHEN o_orderkey % 16 = 0 THEN CAST(0.5 AS DOUBLE) END AS activity_scale, CASE WHEN o_orderkey % 16 = 8 THEN CAST(0.0021 AS DOUBLE) END AS suv_scale,
  CASE WHEN l_partkey % 41 = 0 THEN 'YES' ELSE 'NO' END AS burned_in, p_name AS series_desc, p_type AS study_desc
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
"""

GRID_VOXELS = """
SELECT CAST(l_suppkey % 8 + 8 * floor(l_orderkey / CAST(16384 AS DOUBLE)) AS INT) AS series, CAST(l_linenumber AS INT) AS k, CAST(l_partkey % 64 AS INT) AS r, CAST(l_orderkey % 64 AS INT) AS c,
  CAST(round(avg(l_quantity) * 40 - 1000, 4) AS DOUBLE) + CAST(0 AS DOUBLE) AS v
FROM {lineitem} GROUP BY l_suppkey % 8 + 8 * floor(l_orderkey / CAST(16384 AS DOUBLE)), l_linenumber, l_partkey % 64, l_orderkey % 64
"""

VIEW_EVENTS = """
SELECT event_id, ts, CAST(user_id AS STRING) AS reader, 'S' || (user_id % 20) AS session_id, event_type AS series_uid, event_type || '.' || JSONK(props) AS sop_uid,
  CAST(value * 20 AS DOUBLE) AS dwell_ms, CAST(0.5 AS DOUBLE) + (event_id % 5) * CAST(0.25 AS DOUBLE) AS scale, event_id % 7 <> 0 AS focused, event_id % 11 <> 0 AS visible,
  CASE WHEN event_id % 3 = 0 THEN 'page' ELSE 'viewer' END AS source, CASE WHEN event_id % 3 = 0 THEN 'pages/' || (event_id % 40) || '.png' END AS page_path
FROM {events}
"""

CLAIMS = """
SELECT 'C' || o_custkey AS claim_id, 'S' || (o_custkey % 50) AS session_id, 'T' || o_orderkey AS study_uid, replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS study_date,
  CAST(o_orderkey AS BIGINT) AS study_key, CAST(o_totalprice AS DOUBLE) AS value, CASE WHEN o_orderstatus = 'P' THEN 'HU' ELSE 'mm' END AS unit,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'present' WHEN '2-HIGH' THEN 'not_seen' WHEN '3-MEDIUM' THEN 'resolved' WHEN '4-NOT SPECIFIED' THEN 'indeterminate' ELSE 'not_covered' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'increased' WHEN '2-HIGH' THEN 'decreased' WHEN '3-MEDIUM' THEN 'resolved' WHEN '4-NOT SPECIFIED' THEN 'new' ELSE 'stable' END AS verdict,
  CASE WHEN o_orderkey % 3 = 0 THEN 'high' WHEN o_orderkey % 3 = 1 THEN 'routine' ELSE 'low' END AS priority
FROM {orders}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    select = select.replace("ARR(", "array(").replace("JSONK(props)", "get_json_object(props, '$.k')")
    return spark.sql(select, **{t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in select})


def _sql(select: str) -> str:
    select = select.replace("ARR(", "list_value(").replace("JSONK(props)", "json_extract_string(props, '$.k')")
    return select.format(**{t: t for t in TABLES})


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, INSTANCES)


def grid_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, GRID_VOXELS)


def view_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, VIEW_EVENTS)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, CLAIMS)


def vector_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten slices of 50 by 64 for each 500 vectors; values in -530 to 460."""
    return load(spark, sf_dir, "embeddings").selectExpr("cast(0 as int) as series", "cast(vec_id div 50 as int) as k", "cast(vec_id % 50 as int) as r", "posexplode(embedding) as (c, e)").selectExpr("series", "k", "r", "c", "round(1000 * cast(e as double)) + 0D as v")


#: The same adapters as common table expressions, put before a query's SQL.
WITH = {
    "instances": f"instances AS ({_sql(INSTANCES)})",
    "voxels": f"voxels AS ({_sql(GRID_VOXELS)})",
    "view_events": f"view_events AS ({_sql(VIEW_EVENTS)})",
    "claims": f"claims AS ({_sql(CLAIMS)})",
    "vvoxels": "vvoxels AS (SELECT 0::INT AS series, (vec_id // 50)::INT AS k, (vec_id % 50)::INT AS r, (c - 1)::INT AS c, round(1000 * embedding[c]::DOUBLE) + 0.0::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS c FROM embeddings))",
}


def sql(tables: str, rest: str) -> str:
    """``rest`` (further expressions, then SELECT) after the named adapters; rest starts with SELECT or with a name AS."""
    parts = ", ".join(WITH[t] for t in tables.split())
    rest = rest.strip()
    joint = " " if rest.upper().startswith("SELECT") else ", "
    return f"WITH RECURSIVE {parts}{joint}{rest}" if parts else (rest if joint == " " else f"WITH RECURSIVE {rest}")
