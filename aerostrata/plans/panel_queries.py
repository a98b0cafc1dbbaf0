"""Queries of geography joins, alignment, aggregation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerostrata.operators import aggregate as A
from aerostrata.operators import geo as G
from aerostrata.operators import panel as N
from aerostrata.operators import predicates as P
from aerostrata.plans.fixtures import duck, fixture
from aerostrata.plans.registry import query

KM = "2 * 6371.0e0 * asin(least(1e0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
_HOURLY = "hourly AS (SELECT pollutant, comuna, date_trunc('hour', ts) AS hour, avg(value) AS mean_value, count(*) AS n FROM v_obs GROUP BY 1, 2, 3)"


def _hourly(spark, d):
    return A.comuna_hourly(fixture(spark, d, "v_obs"))


@query(duck(f"WITH {_HOURLY} SELECT pollutant, comuna, hour, round(mean_value, 6) AS mean_value, n FROM hourly", "v_obs"))
def comuna_hourly(spark, d):
    """Mean by pollutant, comuna and hour."""
    return _hourly(spark, d).withColumn("mean_value", F.round("mean_value", 6))


@query(duck(f"WITH {_HOURLY} SELECT pollutant, comuna, CAST(hour AS DATE) AS obs_day, round(avg(mean_value), 6) AS mean_value, count(*) AS n_hours FROM hourly GROUP BY 1, 2, 3 HAVING count(*) >= 2", "v_obs"))
def comuna_daily(spark, d):
    """Mean of hourly means by day, where there are two hours at least."""
    return A.comuna_daily(_hourly(spark, d), min_hours=2).withColumn("mean_value", F.round("mean_value", 6))


@query(duck(f"WITH {_HOURLY} SELECT pollutant, macrozone, hour, round(avg(mean_value), 6) AS mean_value, count(*) AS n_comunas FROM hourly JOIN v_geo USING (comuna) GROUP BY 1, 2, 3", "v_obs", "v_geo"))
def macrozone_hourly(spark, d):
    """Hourly mean over the comunas of each macrozone."""
    return A.macrozone_hourly(_hourly(spark, d), fixture(spark, d, "v_geo").select("comuna", "macrozone")).withColumn("mean_value", F.round("mean_value", 6))


@query(duck("SELECT macrozone, comuna_name, count(*) AS n_stations, count(*) FILTER (WHERE NOT isinf(lon)) AS n_placed FROM v_station JOIN v_geo USING (comuna) GROUP BY 1, 2", "v_station", "v_geo"))
def geo_rollup(spark, d):
    """Stations of each comuna and macrozone."""
    joined = G.with_geography(fixture(spark, d, "v_station"), fixture(spark, d, "v_geo"))
    placed = F.sum((F.abs("lon") < float("inf")).cast("long")).alias("n_placed")
    return joined.groupBy("macrozone", "comuna_name").agg(F.count(F.lit(1)).alias("n_stations"), placed)


@query(
    duck(
        """WITH cells AS (SELECT DISTINCT lon, lat FROM v_swath), hit AS (
 SELECT lon, lat, comuna FROM cells JOIN v_comuna_edge ON (lat1 <= lat) <> (lat2 <= lat) AND lon < lon1 + (lat - lat1) * (lon2 - lon1) / nullif(lat2 - lat1, 0)
 GROUP BY lon, lat, comuna HAVING count(*) % 2 = 1)
 SELECT granule_id, comuna, count(*) AS n_pixels, round(avg(value), 6) AS mean_value FROM v_swath JOIN hit USING (lon, lat) GROUP BY granule_id, comuna""",
        "v_swath",
        "v_comuna_edge",
    )
)
def pixel_to_comuna(spark, d):
    """Pixels of each granule by the comuna that holds them."""
    placed = G.assign_comuna(fixture(spark, d, "v_swath"), fixture(spark, d, "v_comuna_edge"))
    return placed.groupBy("granule_id", "comuna").agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    duck(
        """WITH s AS (SELECT station_id, CAST(floor(lon / 0.625e0 + 0.5e0) AS BIGINT) cx, CAST(floor(lat / 1.25e0 + 0.5e0) AS BIGINT) cy FROM v_station WHERE NOT isinf(lon) AND NOT isinf(lat)),
 g AS (SELECT *, CAST(floor(lon / 0.625e0 + 0.5e0) AS BIGINT) cx, CAST(floor(lat / 1.25e0 + 0.5e0) AS BIGINT) cy FROM v_grid)
 SELECT station_id, variable, count(*) AS n, round(avg(value), 6) AS mean_value FROM s JOIN g USING (cx, cy) GROUP BY 1, 2""",
        "v_station",
        "v_grid",
    )
)
def collocate(spark, d):
    """Grid values of each station's cell."""
    stations = P.station_quality(fixture(spark, d, "v_station")).where("quality in ('good', 'outside')")
    joined = G.collocate(stations, fixture(spark, d, "v_grid"), 0.625, 1.25)
    return joined.groupBy("station_id", "variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    duck(
        """WITH p AS (SELECT event_id, comuna, ts, value, date_trunc('day', ts) + INTERVAL 3 HOUR * CAST(floor(hour(ts) / 3) AS INT) AS period FROM v_obs WHERE pollutant = 'pm25'),
 s AS (SELECT comuna, date_trunc('day', ts) + INTERVAL 3 HOUR * CAST(floor(hour(ts) / 3) AS INT) AS period, max(value) AS cams FROM v_obs WHERE pollutant = 'no2' GROUP BY 1, 2)
 SELECT event_id, p.comuna, ts, value, cams FROM p LEFT JOIN s ON p.comuna = s.comuna AND p.period = s.period""",
        "v_obs",
    )
)
def align_floor(spark, d):
    """Hourly rows with the three-hourly value of their period."""
    obs = fixture(spark, d, "v_obs")
    src = obs.where("pollutant = 'no2'").groupBy("comuna", N.floor_to("ts", "3-hourly").alias("ts")).agg(F.max("value").alias("cams"))
    return N.align_floor(obs.where("pollutant = 'pm25'").select("event_id", "comuna", "ts", "value"), src, "3-hourly", ["comuna"])


@query(
    duck(
        """SELECT p.event_id, p.comuna, p.ts, s.latest FROM (SELECT * FROM v_obs WHERE pollutant = 'pm25') p ASOF LEFT JOIN
 (SELECT comuna, ts, max(value) AS latest FROM v_obs WHERE pollutant = 'no2' GROUP BY comuna, ts) s ON p.comuna = s.comuna AND p.ts >= s.ts""",
        "v_obs",
    )
)
def align_asof(spark, d):
    """Rows with the latest value of another series at or before their time."""
    obs = fixture(spark, d, "v_obs")
    src = obs.where("pollutant = 'no2'").groupBy("comuna", "ts").agg(F.max("value").alias("latest"))
    return N.align_asof(obs.where("pollutant = 'pm25'").select("event_id", "comuna", "ts"), src, ["comuna"], "latest")


@query(
    duck(
        f"""WITH {_HOURLY} SELECT o.comuna, o.hour, round(o.mean_value, 6) AS observed, round(a.mean_value, 6) AS no2, round(b.mean_value, 6) AS o3, g.zone AS zone
 FROM hourly o LEFT JOIN hourly a ON a.pollutant = 'no2' AND a.comuna = o.comuna AND a.hour = o.hour LEFT JOIN hourly b ON b.pollutant = 'o3' AND b.comuna = o.comuna AND b.hour = o.hour
 LEFT JOIN v_geo g ON g.comuna = o.comuna WHERE o.pollutant = 'pm25'""",
        "v_obs",
        "v_geo",
    )
)
def panel(spark, d):
    """Observed values with predictors of the same comuna and hour and a static one."""
    hourly = _hourly(spark, d)
    sources = {p: hourly.where(F.col("pollutant") == p).select("comuna", "hour", F.round("mean_value", 6).alias("value")) for p in ("no2", "o3")}
    obs = hourly.where("pollutant = 'pm25'").select("comuna", "hour", F.round("mean_value", 6).alias("observed"))
    return N.build_panel(obs, sources, ["comuna", "hour"], fixture(spark, d, "v_geo").select("comuna", "zone"))


_NEAR = f"""near AS (SELECT t.station_id AS target, s.station_id AS station, {KM.format(x1="t.lon", y1="t.lat", x2="s.lon", y2="s.lat")} AS km
 FROM v_station t, v_station s WHERE NOT isinf(t.lon) AND NOT isinf(s.lon) AND t.station_id <> s.station_id)"""


@query(
    duck(
        f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY km, station) AS rank FROM near WHERE km <= 1500) SELECT target, station, round(km, 4) AS km, rank FROM r WHERE rank <= 4",
        "v_station",
    )
)
def nearest_stations(spark, d):
    """The four nearest stations of each station within 1,500 km."""
    s = fixture(spark, d, "v_station").where("abs(lon) < double('infinity')")
    pairs = G.neighbours(s.withColumnRenamed("station_id", "target"), s.withColumnRenamed("station_id", "station"), 5, 1500.0).where("target <> station")
    from pyspark.sql import Window

    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("km", "station"))).where("rank <= 4")
    return ranked.select("target", "station", F.round("km", 4).alias("km"), F.col("rank").cast("long").alias("rank"))


_METRICS = """count(*) AS n, sum((obs - pred) * (obs - pred)) AS sse, sum(obs) AS so, sum(obs * obs) AS soo, sum(pred) AS sp, sum(pred * pred) AS spp, sum(obs * pred) AS sop"""


@query(
    duck(
        f"""WITH s AS (SELECT pollutant, station, macrozone, {_METRICS} FROM v_oof GROUP BY GROUPING SETS ((pollutant), (pollutant, station), (pollutant, macrozone)))
 SELECT pollutant, station, macrozone, n, round(CASE WHEN n > 1 AND soo - so * so / n > 1e-9 THEN 1 - sse / (soo - so * so / n) END, 6) AS r2, round(sqrt(sse / n), 6) AS rmse, round((sp - so) / n, 6) AS bias,
 round(CASE WHEN n > 1 AND soo - so * so / n > 1e-9 AND spp - sp * sp / n > 1e-9 THEN (sop - so * sp / n) * (sop - so * sp / n) / ((soo - so * so / n) * (spp - sp * sp / n)) END, 6) AS corr2 FROM s""",
        "v_oof",
    )
)
def cv_metrics(spark, d):
    """Validation metrics by pollutant, station and macrozone."""
    m = A.metrics(fixture(spark, d, "v_oof"), [["pollutant"], ["pollutant", "station"], ["pollutant", "macrozone"]])
    return m.select("pollutant", "station", "macrozone", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "bias", "corr2")])


@query(
    duck(
        """WITH r AS (SELECT pollutant, hour(ts) AS hour_of_day, month(ts) AS month, year(ts) AS year, pred - obs AS r FROM v_oof)
 SELECT pollutant, hour_of_day, month, year, round(avg(r), 6) AS mean_residual, count(r) AS n FROM r GROUP BY GROUPING SETS ((pollutant, hour_of_day), (pollutant, month), (pollutant, year))""",
        "v_oof",
    )
)
def temporal_bias(spark, d):
    """Mean residual by hour of day, month and year."""
    return A.temporal_bias(fixture(spark, d, "v_oof")).withColumn("mean_residual", F.round("mean_residual", 6))


@query(
    duck(
        "SELECT pollutant, round(sqrt(avg((obs - pred) * (obs - pred)) FILTER (WHERE engine = 'gbt')), 6) AS gbt, round(sqrt(avg((obs - pred) * (obs - pred)) FILTER (WHERE engine = 'gwr')), 6) AS gwr FROM v_oof GROUP BY pollutant",
        "v_oof",
    )
)
def compare_engines(spark, d):
    """RMSE of the engines side by side."""
    return A.compare_engines(fixture(spark, d, "v_oof"), ["gbt", "gwr"]).select("pollutant", F.round("gbt", 6).alias("gbt"), F.round("gwr", 6).alias("gwr"))


@query(
    duck(
        """WITH s AS (SELECT pollutant, macrozone, engine, round(sqrt(avg((obs - pred) * (obs - pred))), 6) AS rmse FROM v_oof GROUP BY 1, 2, 3)
 SELECT pollutant, macrozone, engine, rmse, rank() OVER (PARTITION BY pollutant, macrozone ORDER BY rmse) AS rank FROM s""",
        "v_oof",
    )
)
def rank_engines(spark, d):
    """Engines in order of their RMSE for each pollutant and macrozone."""
    rmse = F.round(F.sqrt(F.avg((F.col("obs") - F.col("pred")) * (F.col("obs") - F.col("pred")))), 6).alias("rmse")
    scores = fixture(spark, d, "v_oof").groupBy("pollutant", "macrozone", "engine").agg(rmse).withColumn("_by", F.concat_ws("|", "pollutant", "macrozone"))
    return A.rank_engines(scores, by="_by").select("pollutant", "macrozone", "engine", "rmse", F.col("rank").cast("long").alias("rank"))


@query(
    duck(
        f"""WITH p AS (SELECT a.pollutant, {KM.format(x1="a.lon", y1="a.lat", x2="b.lon", y2="b.lat")} AS km, 0.5e0 * (a.value - b.value) * (a.value - b.value) AS h
 FROM v_panel a JOIN v_panel b ON a.pollutant = b.pollutant AND a.day = b.day AND a.station < b.station)
 SELECT pollutant, CAST(floor(km / 200e0) AS BIGINT) AS distance_bin, round(avg(h), 4) AS gamma, count(*) AS n_pairs FROM p WHERE km <= 2000 GROUP BY 1, 2""",
        "v_panel",
    )
)
def semivariogram(spark, d):
    """Half mean squared differences of stations by distance."""
    return A.semivariogram(fixture(spark, d, "v_panel"), 200.0, 2000.0, ("pollutant", "day")).withColumn("gamma", F.round("gamma", 4))


@query(
    duck(
        f"""WITH {_HOURLY}, g AS (SELECT pollutant, comuna, hour AS gap_start, lead(hour) OVER (PARTITION BY pollutant, comuna ORDER BY hour) AS gap_end FROM hourly)
 SELECT pollutant, comuna, gap_start, gap_end, date_diff('hour', gap_start, gap_end) - 1 AS missing FROM g WHERE date_diff('hour', gap_start, gap_end) > 1""",
        "v_obs",
    )
)
def hour_gaps(spark, d):
    """Runs of missing hours of each series."""
    return A.hour_gaps(_hourly(spark, d), ["pollutant", "comuna"])


@query(
    duck(
        f"""WITH {_HOURLY}, p AS (SELECT DISTINCT pollutant FROM v_obs) SELECT s.pollutant, s.comuna, s.hour, round(h.mean_value, 6) AS estimate
 FROM (SELECT pollutant, comuna, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS hour FROM v_geo, p) s
 LEFT JOIN hourly h ON h.pollutant = s.pollutant AND h.comuna = s.comuna AND h.hour = s.hour""",
        "v_obs",
        "v_geo",
    )
)
def surface_spine(spark, d):
    """Every pollutant, comuna and hour of a month with its estimate."""
    pollutants = F.explode(F.array(*[F.lit(p) for p in ("pm25", "pm10", "no2", "o3", "so2")])).alias("pollutant")
    places = fixture(spark, d, "v_geo").select("comuna", pollutants)
    estimates = _hourly(spark, d).select("pollutant", "comuna", "hour", F.round("mean_value", 6).alias("estimate"))
    return N.surface_spine(places, "2024-01-01 00:00:00", "2024-01-31 23:00:00", estimates, ["pollutant", "comuna", "hour"])
