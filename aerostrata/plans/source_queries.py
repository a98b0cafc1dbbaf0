"""Queries of sources, predicates, crops, ledgers, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerostrata.functions import scalar as S
from aerostrata.operators import crop as C
from aerostrata.operators import ledger as L
from aerostrata.operators import predicates as P
from aerostrata.plans.fixtures import duck, fixture
from aerostrata.plans.registry import query
from aerostrata.sources import readers as R

IN_BOX = "lat BETWEEN -56.5 AND -17.0 AND lon BETWEEN -76.0 AND -66.0"
FIN = "CASE WHEN {0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0}) THEN {0} END"


def base(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(duck(f"SELECT station_id, coalesce(nombre, '') AS nombre, comuna, {FIN.format('lon')} AS lon, {FIN.format('lat')} AS lat FROM v_station", "v_station"))
def station_catalogue(spark, d):
    """Station dimension with unusable coordinates as null."""
    return fixture(spark, d, "v_station").select("station_id", F.coalesce("nombre", F.lit("")).alias("nombre"), "comuna", S.finite("lon").alias("lon"), S.finite("lat").alias("lat"))


_PATHS = """SELECT concat('data/sinca/', pollutant, '/', res, '/R', CAST(station % 16 AS STRING), '_', CAST(station AS STRING), '_', res, '_', lo, '_', hi, '.csv') AS path
 FROM (SELECT pollutant, station, CASE WHEN station % 2 = 0 THEN 'horario' ELSE 'diario' END AS res, {lo} AS lo, {hi} AS hi FROM {src} GROUP BY pollutant, station)"""


@query(
    duck(
        "SELECT path, split_part(path, '/', 3) AS pollutant, split_part(path, '/', 4) AS resolution, split_part(split_part(path, '/', 5), '_', 1) AS region, "
        "split_part(split_part(path, '/', 5), '_', 2) AS station, split_part(split_part(path, '/', 5), '_', 4) AS date_from, replace(split_part(split_part(path, '/', 5), '_', 5), '.csv', '') AS date_to FROM ("
        + _PATHS.format(lo="strftime(min(ts), '%y%m%d')", hi="strftime(max(ts), '%y%m%d')", src="v_obs")
        + ")",
        "v_obs",
    )
)
def series_path_dims(spark, d):
    """Dimensions of station series from their file paths."""
    obs = fixture(spark, d, "v_obs")
    paths = spark.sql(_PATHS.format(lo="date_format(min(ts), 'yyMMdd')", hi="date_format(max(ts), 'yyMMdd')", src="{obs}"), obs=obs)
    return R.series_dims(paths)


@query(
    duck(
        "SELECT event_id, variable, ts, lat + i * 1.25e0 AS lat, lon + j * 0.625e0 AS lon, value + 2 * i + j AS value FROM v_grid, (SELECT 0 AS i UNION ALL SELECT 1) a, (SELECT 0 AS j UNION ALL SELECT 1) b",
        "v_grid",
    )
)
def grid_explode(spark, d):
    """Cells of grids that arrive as axes and nested arrays."""
    g = fixture(spark, d, "v_grid")
    nested = g.select(
        "event_id",
        "variable",
        "ts",
        F.expr("array(lat, lat + 1.25e0)").alias("lats"),
        F.expr("array(lon, lon + 0.625e0)").alias("lons"),
        F.expr("array(array(value, value + 1), array(value + 2, value + 3))").alias("cells"),
    )
    return R.grid_rows(nested, "lats", "lons", "cells")


@query(
    duck(
        "SELECT granule_id, ts, i AS scanline, j AS ground_pixel, lat + i AS lat, lon + j AS lon, value + 10 * i + j AS value FROM v_swath, (SELECT 0 AS i UNION ALL SELECT 1) a, (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) b",
        "v_swath",
    )
)
def swath_explode(spark, d):
    """Pixels of swaths that arrive as nested arrays."""
    s = fixture(spark, d, "v_swath")

    def nested(step_i: str, step_j: str, c: str) -> str:
        return f"transform(sequence(0, 1), i -> transform(sequence(0, 2), j -> {c} + {step_i} * i + {step_j} * j))"

    arrays = s.select("granule_id", "ts", F.expr(nested("1", "0", "lat")).alias("a"), F.expr(nested("0", "1", "lon")).alias("o"), F.expr(nested("10", "1", "value")).alias("v"))
    return R.swath_rows(arrays, "a", "o", "v")


@query(
    duck(
        "SELECT pollutant, param_code, count(*) AS n FROM v_obs JOIN (VALUES ('pm25', 'PM25'), ('pm10', 'PM10'), ('so2', '0001'), ('no2', '0003'), ('o3', '0008'), ('co', '0004')) p(pollutant, param_code) USING (pollutant) GROUP BY ALL",
        "v_obs",
    )
)
def param_code_lookup(spark, d):
    """Rows of each pollutant with its parameter code."""
    return fixture(spark, d, "v_obs").join(F.broadcast(R.param_codes(spark)), "pollutant").groupBy("pollutant", "param_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    duck(
        "SELECT obj_key, size FROM v_listing WHERE contains(lower(obj_key), 'v6gl03') AND ends_with(lower(obj_key), '.nc') AND NOT starts_with(split_part(obj_key, '/', -1), '._') AND contains(lower(obj_key), 'annual')",
        "v_listing",
    )
)
def listing_filter(spark, d):
    """Annual objects of the current version."""
    return P.match_keys(fixture(spark, d, "v_listing"), "V6GL03", "annual")


@query(duck(f"SELECT granule_id, scanline, ground_pixel, lon, lat, value FROM v_swath WHERE {IN_BOX}", "v_swath"))
def bbox_filter(spark, d):
    """Pixels inside the area."""
    return P.within_bbox(fixture(spark, d, "v_swath")).select("granule_id", "scanline", "ground_pixel", "lon", "lat", "value")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1996-02-28' AND o_orderdate < DATE '1996-03-02'")
def date_range(spark, d):
    """Orders of some days, both ends included."""
    return P.between_days(base(spark, d, "orders"), "o_orderdate", "1996-02-28", "1996-03-01").select("o_orderkey", "o_orderdate")


@query("SELECT event_id, value AS pm25, user_id AS no2 FROM events")
def resolve_vars(spark, d):
    """Variables under the first of their names that the table has."""
    return P.resolve_columns(base(spark, d, "events"), {"pm25": ["PM25_RH35_GCC", "pm25_rh35_gcc", "value"], "no2": ["NO2", "user_id"], "co": ["CO", "co"]}, ["event_id"])


@query("SELECT event_id, ts, value FROM (SELECT *, 1 + user_id % 72 AS model_level FROM events) WHERE model_level = 60 AND hour(ts) IN (0, 3, 6, 9, 12, 15, 18, 21)")
def synoptic_hours(spark, d):
    """One model level at the three-hourly slots."""
    rows = base(spark, d, "events").withColumn("model_level", 1 + F.col("user_id") % 72)
    return P.select_levels(rows, 60, range(0, 24, 3)).select("event_id", "ts", "value")


@query(duck("SELECT doc_id, length(text) > 400 AND NOT contains(text, 'Sin datos') AND NOT contains(lower(text), 'no existe') AS useful FROM v_reply", "v_reply"))
def useful_text(spark, d):
    """Whether a reply holds data."""
    return fixture(spark, d, "v_reply").select("doc_id", P.is_useful(F.col("text")).alias("useful"))


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click', 'signup')")
def unknown_codes(spark, d):
    """Codes outside a domain."""
    return P.unknown_codes(base(spark, d, "events"), spark.createDataFrame([("view",), ("click",), ("signup",)], "event_type string"), "event_type")


@query(
    duck(
        f"SELECT station_id, lon, lat, CASE WHEN lon IS NULL OR lat IS NULL THEN 'missing' WHEN isnan(lon) OR isinf(lon) OR isnan(lat) OR isinf(lat) THEN 'not finite' WHEN {IN_BOX} THEN 'good' ELSE 'outside' END AS quality FROM v_station",
        "v_station",
    )
)
def station_quality(spark, d):
    """Flags of station coordinates."""
    return P.station_quality(fixture(spark, d, "v_station")).select("station_id", "lon", "lat", "quality")


@query(
    duck(
        "SELECT DISTINCT name FROM (SELECT granule AS name FROM v_catalogue UNION ALL SELECT replace(name, '.vacio', '') FROM v_ledger) WHERE NOT contains(name, '.chile.')",
        "v_catalogue",
        "v_ledger",
    )
)
def backlog(spark, d):
    """Raw granules over two folders."""
    names = fixture(spark, d, "v_catalogue").select(F.col("granule").alias("name"))
    return L.backlog(names, fixture(spark, d, "v_ledger").select(F.regexp_replace("name", r"\.vacio$", "").alias("name")))


@query("SELECT o_orderpriority AS product, count(*) FILTER (WHERE o_totalprice >= 1000 AND o_orderstatus <> 'P') AS good, count(*) FILTER (WHERE NOT (o_totalprice >= 1000 AND o_orderstatus <> 'P')) AS quarantined FROM orders GROUP BY 1")
def valid_split(spark, d):
    """Granules kept and quarantined by product."""
    good, bad = P.split_valid(base(spark, d, "orders"), (F.col("o_totalprice") >= 1000) & (F.col("o_orderstatus") != "P"))
    both = good.select("o_orderpriority", F.lit(1).alias("g"), F.lit(0).alias("b")).union(bad.select("o_orderpriority", F.lit(0), F.lit(1)))
    return both.groupBy(F.col("o_orderpriority").alias("product")).agg(F.sum("g").alias("good"), F.sum("b").alias("quarantined"))


@query("SELECT p_partkey, p_brand FROM part WHERE replace(p_brand, 'Brand#', '') = '10'")
def version_filter(spark, d):
    """Products of exactly one version text."""
    rows = base(spark, d, "part").withColumn("version", F.regexp_replace("p_brand", "Brand#", ""))
    return P.select_version(rows, "10").select("p_partkey", "p_brand")


_BOX = f"box AS (SELECT granule_id, min(scanline) s0, max(scanline) s1, min(ground_pixel) p0, max(ground_pixel) p1 FROM v_swath WHERE {IN_BOX} GROUP BY granule_id)"
_CUT = _BOX + ", cut AS (SELECT v.* FROM v_swath v JOIN box USING (granule_id) WHERE scanline BETWEEN s0 AND s1 AND ground_pixel BETWEEN p0 AND p1)"


@query(duck(f"WITH {_CUT} SELECT * FROM cut", "v_swath"))
def crop_index_box(spark, d):
    """Pixels of each granule's index box."""
    return C.crop_index_box(fixture(spark, d, "v_swath"))


@query(duck(f"SELECT event_id, variable, lat, lon, value FROM v_grid WHERE {IN_BOX}", "v_grid"))
def crop_grid(spark, d):
    """Grid cells inside the area."""
    return C.crop_grid(fixture(spark, d, "v_grid")).select("event_id", "variable", "lat", "lon", "value")


@query(duck(f"SELECT granule_id, 'empty' AS status FROM v_swath GROUP BY granule_id HAVING NOT bool_or({IN_BOX})", "v_swath"))
def empty_granules(spark, d):
    """Granules without a pixel inside."""
    return C.empty_granules(fixture(spark, d, "v_swath"))


@query(
    duck(
        f"""WITH {_CUT} SELECT granule_id, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max,
 arg_min(ts, (scanline, ground_pixel, ts)) AS time_start, arg_max(ts, (scanline, ground_pixel, ts)) AS time_end FROM cut GROUP BY granule_id""",
        "v_swath",
    )
)
def granule_coverage(spark, d):
    """Extent and first and last time of the cropped granules."""
    return C.coverage(C.crop_index_box(fixture(spark, d, "v_swath")))


@query(
    duck(
        f"""WITH {_CUT} SELECT granule_id, n AS pixels, coalesce(m, 0) AS kept, round(coalesce(m, 0) / n, 6) AS share
 FROM (SELECT granule_id, count(*) n FROM v_swath GROUP BY 1) LEFT JOIN (SELECT granule_id, count(*) m FROM cut GROUP BY 1) USING (granule_id)""",
        "v_swath",
    )
)
def crop_ratio(spark, d):
    """Share of pixels that a crop keeps."""
    s = fixture(spark, d, "v_swath")
    return C.crop_ratio(s, C.crop_index_box(s)).withColumn("share", F.round("share", 6))


@query(
    duck(
        """SELECT station_id, pollutant, resolution, concat('R', CAST(comuna AS STRING), '_', station_id, '_', resolution, '_190101_241231.csv') AS file_name,
 concat('./R', CAST(comuna AS STRING), '/', station_id, '/Cal/', param_code, '//', param_code, '.', resolution, '.', resolution, '.ic') AS macro
 FROM v_station, (VALUES ('pm25', 'PM25'), ('pm10', 'PM10'), ('so2', '0001'), ('no2', '0003'), ('o3', '0008'), ('co', '0004')) p(pollutant, param_code), (VALUES ('horario'), ('diario')) r(resolution)""",
        "v_station",
    )
)
def request_plan(spark, d):
    """Series to ask for: stations, pollutants and resolutions."""
    stations = fixture(spark, d, "v_station").withColumn("region", F.concat(F.lit("R"), F.col("comuna").cast("string")))
    return L.request_plan(stations, R.PARAM_CODES, ["horario", "diario"], "190101", "241231").select("station_id", "pollutant", "resolution", "file_name", "macro")


_PENDING = "replace(granule, '.nc', '.chile.nc') NOT IN (SELECT replace(name, '.vacio', '') FROM v_ledger)"


@query(duck(f"SELECT * FROM v_catalogue WHERE {_PENDING}", "v_catalogue", "v_ledger"))
def pending_work(spark, d):
    """Granules neither done nor empty."""
    return L.pending(fixture(spark, d, "v_catalogue"), fixture(spark, d, "v_ledger"))


@query(duck(f"SELECT product, count(*) AS n_pending FROM v_catalogue WHERE {_PENDING} GROUP BY product", "v_catalogue", "v_ledger"))
def plan_counts(spark, d):
    """Pending granules by product."""
    return L.plan_counts(fixture(spark, d, "v_catalogue"), fixture(spark, d, "v_ledger"))


_STATUS = """st AS (SELECT d.doc_id, d.source, CASE WHEN r.doc_id % 19 = 0 THEN 'error' WHEN length(r.text) > 400 AND NOT contains(r.text, 'Sin datos') AND NOT contains(lower(r.text), 'no existe') THEN 'ok' ELSE 'no data' END AS status,
 r.text FROM documents d LEFT JOIN (SELECT * FROM v_reply WHERE doc_id % 23 <> 0) r ON d.doc_id = r.doc_id)"""


def _status(spark, d):
    plan = base(spark, d, "documents").select("doc_id", "source")
    replies = fixture(spark, d, "v_reply").where("doc_id % 23 <> 0").withColumn("failure", F.when(F.col("doc_id") % 19 == 0, "timeout"))
    return L.request_status(plan, replies, "doc_id", "text", "failure")


@query(
    duck(
        f"WITH {_STATUS} SELECT doc_id, source, status, CASE status WHEN 'error' THEN 'error: timeout' WHEN 'no data' THEN 'no data' END AS reason, CASE WHEN status = 'ok' THEN strlen(text) END AS bytes FROM st",
        "v_reply",
    )
)
def manifest_split(spark, d):
    """Status of each request."""
    return _status(spark, d).select("doc_id", "source", "status", "reason", "bytes")


@query(duck(f"WITH {_STATUS} SELECT status, count(*) AS n, coalesce(sum(CASE WHEN status = 'ok' THEN strlen(text) END), 0)::BIGINT AS bytes FROM st GROUP BY status", "v_reply"))
def run_summary(spark, d):
    """Requests and bytes by status."""
    return L.run_summary(_status(spark, d))


@query("SELECT strftime(o_orderdate, '%Y%m') AS month, count(DISTINCT o_orderdate) AS steps, count(DISTINCT o_orderpriority) AS variables FROM orders GROUP BY 1")
def month_completeness(spark, d):
    """Time steps and variables of each month."""
    return L.month_completeness(base(spark, d, "orders"), "o_orderdate", "o_orderpriority")


@query(
    """SELECT count(*) AS n_missing, concat(array_to_string(list_sort(list(month))[1:6], ', '), CASE WHEN count(*) > 6 THEN ', ...' ELSE '' END) AS missing
 FROM (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders EXCEPT SELECT strftime(o_orderdate, '%Y%m') FROM orders WHERE month(o_orderdate) NOT IN (2, 7))"""
)
def missing_months(spark, d):
    """Months that are expected and absent."""
    months = base(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month"), F.month("o_orderdate").alias("m"))
    return L.missing_months(months, months.where(~F.col("m").isin(2, 7)))


@query(duck("SELECT k AS station, coalesce(n, 0) AS n_years FROM (SELECT DISTINCT s_suppkey AS k FROM supplier) LEFT JOIN (SELECT l_suppkey, count(DISTINCT CASE WHEN l_linenumber <> 7 THEN year(l_shipdate) END) AS n FROM lineitem GROUP BY 1) ON k = l_suppkey"))
def years_with_data(spark, d):
    """Years with data of every station; every seventh line of an order stands for a missing value."""
    obs = base(spark, d, "lineitem").selectExpr("l_suppkey as station", "l_shipdate as ts", "case when l_linenumber <> 7 then l_quantity end as value")
    return L.years_with_data(obs, base(spark, d, "supplier").select(F.col("s_suppkey").alias("station")), "station")


@query(
    """WITH a AS (SELECT s_suppkey AS k, s_name AS nombre, s_nationkey AS comuna FROM supplier WHERE s_suppkey % 10 <> 0),
 b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN upper(s_name) || '!' ELSE s_name END AS nombre, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END AS comuna FROM supplier WHERE s_suppkey % 13 <> 0)
 SELECT coalesce(a.k, b.k) AS k, 'row' AS field, CASE WHEN a.k IS NOT NULL THEN 'present' END AS left_value, CASE WHEN b.k IS NOT NULL THEN 'present' END AS right_value FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
 UNION ALL SELECT a.k, 'nombre', a.nombre, b.nombre FROM a JOIN b ON a.k = b.k WHERE a.nombre IS DISTINCT FROM b.nombre
 UNION ALL SELECT a.k, 'comuna', CAST(a.comuna AS VARCHAR), CAST(b.comuna AS VARCHAR) FROM a JOIN b ON a.k = b.k WHERE a.comuna IS DISTINCT FROM b.comuna"""
)
def reconcile(spark, d):
    """Differences of two station catalogues."""
    s = base(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("nombre"), F.col("s_nationkey").alias("comuna"))
    b = s.where("k % 13 <> 0").withColumn("nombre", F.expr("case when k % 7 = 0 then concat(upper(nombre), '!') else nombre end")).withColumn("comuna", F.expr("case when k % 4 = 0 then null else comuna end"))
    return L.reconcile(s.where("k % 10 <> 0"), b, ["k"], ["nombre", "comuna"])


@query(duck("SELECT station_id, nombre FROM v_station ORDER BY comuna, station_id LIMIT 3", "v_station"))
def first_stations(spark, d):
    """The first stations in order of comuna and code."""
    return L.first_stations(fixture(spark, d, "v_station"), 3, ["comuna", "station_id"]).select("station_id", "nombre")


@query(duck("SELECT obj_key, size // 1048576 AS size_mb FROM v_listing ORDER BY obj_key LIMIT 40", "v_listing"))
def list_keys(spark, d):
    """The first keys of a listing with their megabytes."""
    return L.list_keys(fixture(spark, d, "v_listing"), 40)


@query("SELECT event_id, ts, value, CASE WHEN day(ts) > 20 THEN event_type END AS event_type FROM events WHERE day(ts) <= 10 OR day(ts) > 20")
def concat_chunks(spark, d):
    """Chunks in time, one of which lacks a column."""
    e = base(spark, d, "events")
    return L.concat_time(e.where("day(ts) > 20").select("event_id", "ts", "value", "event_type"), e.where("day(ts) <= 10").select("event_id", "ts", "value"))


@query("SELECT sensor, count(*) AS n, sum(l_quantity) AS total FROM (SELECT 'terra' AS sensor, l_quantity FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'aqua', l_quantity FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def union_sensors(spark, d):
    """Two sensors in one table."""
    li = base(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    tables = {"terra": li.where("l_returnflag = 'A'"), "aqua": li.where("l_returnflag = 'R'"), "other": li.where("l_returnflag = 'N'")}
    return L.union_sensors(tables, ["terra", "aqua"]).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') AS yymmdd FROM orders")
def fmt_yymmdd(spark, d):
    """Dates as yyMMdd."""
    return base(spark, d, "orders").select("o_orderkey", S.yymmdd(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("yymmdd"))


_SPANS = "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY o_custkey"


def _spans(spark, d):
    return base(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))


@query(f"SELECT o_custkey, CAST(m AS DATE) AS month, last_day(m) AS month_end FROM (SELECT o_custkey, unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM ({_SPANS}))")
def month_sequence(spark, d):
    """Months of each customer's span, partial first ones kept."""
    return S.months_between(_spans(spark, d), "lo", "hi").select("o_custkey", "month", "month_end")


@query(
    f"SELECT o_custkey, CAST(s AS DATE) AS chunk_start, least(CAST(s + INTERVAL 4 DAY AS DATE), hi) AS chunk_end FROM (SELECT o_custkey, hi, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 5 DAY)) AS s FROM ({_SPANS}))"
)
def day_chunks(spark, d):
    """Five-day chunks of a span, the last one clipped."""
    return S.day_chunks(_spans(spark, d), "lo", "hi").select("o_custkey", "chunk_start", "chunk_end")


@query(f"SELECT o_custkey, unnest(range(year(lo), year(hi) + 1)) AS year FROM ({_SPANS})")
def year_sequence(spark, d):
    """Calendar years of a span."""
    return S.years_between(_spans(spark, d), "lo", "hi").select("o_custkey", F.col("year").cast("long").alias("year"))


@query(duck("SELECT obj_key, CASE WHEN ends_with(obj_key, '.nc') THEN regexp_replace(split_part(obj_key, '/', -1), '\\.nc$', '.chile.nc') END AS crop_name FROM v_listing", "v_listing"))
def crop_name(spark, d):
    """Names of cropped files."""
    return fixture(spark, d, "v_listing").select("obj_key", S.crop_name("obj_key").alias("crop_name"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(concat(' ', p_name, ' ,, ', p_type, ', '), ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS parsed FROM part")
def parse_list(spark, d):
    """Comma lists as clean arrays."""
    text = F.concat(F.lit(" "), "p_name", F.lit(" ,, "), "p_type", F.lit(", "))
    return base(spark, d, "part").select("p_partkey", F.array_join(S.parse_list(text), "|").alias("parsed"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, strlen(text) // 1024 AS kb FROM documents")
def text_sizes(spark, d):
    """Characters, bytes and whole kilobytes of texts."""
    return base(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.expr("octet_length(text) div 1024").alias("kb"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 50 = 7 THEN NULL ELSE round(l_suppkey * 0.02e0 + l_linenumber, 6) END AS value FROM lineitem")
def unpack_values(spark, d):
    """Packed integers as values, the fill value as null."""
    rows = base(spark, d, "lineitem").withColumn("raw", F.when(F.col("l_suppkey") % 50 == 7, -32767).otherwise(F.col("l_suppkey")))
    value = S.unpack(F.col("raw"), F.lit(-32767), F.lit(0.02), F.col("l_linenumber").cast("double"))
    return rows.select("l_orderkey", "l_linenumber", F.round(value, 6).alias("value"))
