"""Views over the base tables in the shapes that the operators take; one text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LON = "-80e0 + ({0}*37 % 997)*0.02e0"
_LAT = "-60e0 + ({0}*61 % 991)*0.05e0"
_POLLUTANT = "CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'error' THEN 'no2' WHEN 'purchase' THEN 'o3' ELSE 'so2' END"

#: name: (base tables, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_station": (
        ("supplier",),
        f"""SELECT CAST(s_suppkey AS STRING) station_id, s_suppkey k, s_name nombre, s_nationkey comuna,
 CASE WHEN s_suppkey % 9 = 4 THEN CAST('Infinity' AS DOUBLE) ELSE {_LON.format("s_suppkey")} END lon,
 CASE WHEN s_suppkey % 9 = 4 THEN CAST('Infinity' AS DOUBLE) ELSE {_LAT.format("s_suppkey")} END lat FROM supplier""",
    ),
    "v_geo": (("nation", "region"), "SELECT n_nationkey comuna, n_name comuna_name, r_regionkey zone, r_name macrozone FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "v_obs": (
        ("events",),
        f"SELECT event_id, user_id % 25 comuna, user_id station, {_POLLUTANT} pollutant, ts, value, {_LON.format('user_id')} lon, {_LAT.format('user_id')} lat FROM events",
    ),
    "v_swath": (
        ("lineitem",),
        """SELECT l_orderkey % 200 granule_id, l_partkey % 120 scanline, l_suppkey % 60 ground_pixel, l_shipdate ts,
 -90e0 + (l_orderkey % 200)*0.2e0 + (l_suppkey % 60)*0.3e0 - (l_partkey % 120)*0.05e0 lon,
 -70e0 + (l_partkey % 120)*0.55e0 + (l_suppkey % 60)*0.1e0 lat, l_extendedprice value FROM lineitem""",
    ),
    "v_grid": (
        ("events",),
        f"SELECT event_id, {_POLLUTANT} variable, ts, -60e0 + (user_id % 40)*1.25e0 lat, -80e0 + (event_id % 32)*0.625e0 lon, value FROM events",
    ),
    "v_catalogue": (("orders",), "SELECT CONCAT('S5P_', CAST(o_orderkey AS STRING), '.nc') granule, o_orderpriority product, o_orderdate obs_day FROM orders"),
    "v_ledger": (
        ("orders",),
        "SELECT CONCAT('S5P_', CAST(o_orderkey AS STRING), CASE WHEN o_orderstatus = 'F' THEN '.chile.nc' ELSE '.chile.nc.vacio' END) name FROM orders WHERE o_orderstatus IN ('F','P')",
    ),
    "v_listing": (
        ("part",),
        """SELECT CONCAT(CASE WHEN p_partkey % 5 = 0 THEN 'V5GL02' ELSE 'V6GL03' END, '/FineResolution/SA/', CASE WHEN p_size % 2 = 0 THEN 'Annual/' ELSE 'Monthly/' END,
 CASE WHEN p_partkey % 7 = 0 THEN '._' ELSE '' END, 'P', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 11 = 0 THEN '.txt' ELSE '.nc' END) obj_key, p_partkey * 52428 size FROM part""",
    ),
    "v_comuna_edge": (
        ("nation",),
        """SELECT n_nationkey comuna, e.i edge, -76e0+(n_nationkey%5)*2e0 + CASE WHEN e.i IN (1,2) THEN 2e0 ELSE 0e0 END lon1,
 -56.5e0+CAST(FLOOR(n_nationkey/5e0) AS DOUBLE)*7.9e0 + CASE e.i WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 WHEN 2 THEN 8.9e0 ELSE 7.9e0 END lat1,
 -76e0+(n_nationkey%5)*2e0 + CASE WHEN e.i IN (0,1) THEN 2e0 ELSE 0e0 END lon2,
 -56.5e0+CAST(FLOOR(n_nationkey/5e0) AS DOUBLE)*7.9e0 + CASE e.i WHEN 0 THEN 1e0 WHEN 1 THEN 8.9e0 WHEN 2 THEN 7.9e0 ELSE 0e0 END lat2
 FROM nation CROSS JOIN (SELECT 0 i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) e""",
    ),
    "v_comuna_rect": (
        ("nation",),
        """SELECT n_nationkey comuna, e.i edge, -79.7e0 + (n_nationkey % 5)*3.7e0 + CASE WHEN e.i IN (1,2) THEN 3.7e0 ELSE 0e0 END lon1,
 -58.3e0 + CAST(FLOOR(n_nationkey/5e0) AS DOUBLE)*7.3e0 + CASE WHEN e.i IN (2,3) THEN 7.3e0 ELSE 0e0 END lat1,
 -79.7e0 + (n_nationkey % 5)*3.7e0 + CASE WHEN e.i IN (0,1) THEN 3.7e0 ELSE 0e0 END lon2,
 -58.3e0 + CAST(FLOOR(n_nationkey/5e0) AS DOUBLE)*7.3e0 + CASE WHEN e.i IN (1,2) THEN 7.3e0 ELSE 0e0 END lat2
 FROM nation CROSS JOIN (SELECT 0 i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) e""",
    ),
    "v_place": (("customer",), "SELECT c_custkey place, -180e0 + (c_custkey*37 % 3600)*0.1e0 lon, -90e0 + (c_custkey*61 % 1801)*0.1e0 lat FROM customer"),
    "v_visit": (
        ("orders",),
        f"SELECT o_orderkey visit, o_custkey % 100 station, {_LON.format('(o_custkey % 100)')} lon, {_LAT.format('(o_custkey % 100)')} lat, o_orderdate ts FROM orders",
    ),
    "v_reply": (
        ("documents",),
        """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN CONCAT(text, ' Sin datos') WHEN doc_id % 13 = 0 THEN CONCAT(text, ' No Existe')
 WHEN doc_id % 17 = 0 THEN CONCAT(text, ' SIN DATOS') ELSE text END text FROM documents""",
    ),
    # daily mean of each station and pollutant, with a predictor that goes with the value
    "v_panel": (
        ("events",),
        f"""SELECT pollutant, station, comuna, CAST(day AS TIMESTAMP_NTZ) AS day, lon, lat, AVG(value) value, AVG(value)*0.5e0 + (station % 7)*3e0 + EXTRACT(DAY FROM day)*0.25e0 x,
 CAST(EXTRACT(DAY FROM day) AS DOUBLE) day_no FROM (SELECT {_POLLUTANT} pollutant, user_id station, user_id % 25 comuna, date_trunc('DAY', ts) AS day, value,
 {_LON.format("user_id")} lon, {_LAT.format("user_id")} lat FROM events) GROUP BY pollutant, station, comuna, day, lon, lat""",
    ),
    # out-of-fold predictions of two engines
    "v_oof": (
        ("events", "nation", "region"),
        f"""SELECT {_POLLUTANT} pollutant, user_id station, r_name macrozone, ts, CASE WHEN event_id % 2 = 0 THEN 'gwr' ELSE 'gbt' END engine, value obs,
 value * 0.9e0 + (event_id % 17) - 4e0 pred FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON r_regionkey = n_regionkey""",
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    tables, text = VIEWS[name]
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def duck(text: str, *views: str) -> str:
    """DuckDB SQL with the views it needs in front."""
    heads = ", ".join(f"{v} AS ({VIEWS[v][1].replace('TIMESTAMP_NTZ', 'TIMESTAMP')})" for v in views)
    text = text.strip()
    if not heads:
        return text
    return f"WITH {heads}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {heads} {text}"
