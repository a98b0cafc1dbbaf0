"""Queries of surfaces: engines side by side, blocks, area weights, and neighbours without a radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerostrata.operators import aggregate as A
from aerostrata.operators import boosting as B
from aerostrata.operators import engines as E
from aerostrata.operators import geo as G
from aerostrata.operators import panel as N
from aerostrata.operators.network import keep, pair_arrays
from aerostrata.plans.engine_queries import FEATURES, KEYS
from aerostrata.plans.fixtures import duck, fixture
from aerostrata.plans.panel_queries import KM
from aerostrata.plans.registry import query

GRID, CENTER = (0.625, 1.25), (-80.0, -60.0)
_SHARES = """rect AS (SELECT comuna, min(lon1) AS w, max(lon1) AS e, min(lat1) AS s, max(lat1) AS n FROM v_comuna_rect GROUP BY 1),
 shares AS (SELECT lon, lat, comuna, greatest(0e0, least(lon + 0.3125e0, e) - greatest(lon - 0.3125e0, w)) * greatest(0e0, least(lat + 0.625e0, n) - greatest(lat - 0.625e0, s)) / 0.78125e0 AS share
  FROM (SELECT DISTINCT lon, lat FROM v_grid), rect)"""


def _shares(spark, d) -> DataFrame:
    return G.cell_shares(fixture(spark, d, "v_grid"), fixture(spark, d, "v_comuna_rect"), GRID, CENTER)


@query(duck(f"WITH {_SHARES} SELECT lon, lat, comuna, round(share, 6) AS share FROM shares WHERE share > 1e-9", "v_grid", "v_comuna_rect"))
def area_weights(spark, d):
    """The part of every grid cell that each comuna covers."""
    return _shares(spark, d).withColumn("share", F.round("share", 6))


@query(
    duck(
        f"""WITH {_SHARES} SELECT variable, comuna, date_trunc('hour', ts) AS hour, round(sum(share * value) / sum(share), 9) AS mean_value, count(*) AS n
 FROM v_grid JOIN shares USING (lon, lat) WHERE share > 1e-9 GROUP BY 1, 2, 3""",
        "v_grid",
        "v_comuna_rect",
    )
)
def comuna_area_hourly(spark, d):
    """Mean over the cells of each comuna by variable and hour, weighted by the area that they share with it."""
    rows = fixture(spark, d, "v_grid").join(_shares(spark, d), ["lon", "lat"])
    return A.comuna_hourly(rows, weights="share", keys=["variable", "comuna"]).withColumn("mean_value", F.round("mean_value", 9))


@query(
    duck(
        f"""WITH near AS (SELECT place, station_id AS station, {KM.format(x1="p.lon", y1="p.lat", x2="s.lon", y2="s.lat")} AS km FROM v_place p, v_station s WHERE NOT isinf(s.lon)),
 r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY km, station) AS rank FROM near) SELECT place, station, round(km, 4) AS km, rank FROM r WHERE rank <= 3""",
        "v_place",
        "v_station",
    )
)
def nearest_anywhere(spark, d):
    """The three nearest stations of places all over the globe, however far they are."""
    stations = fixture(spark, d, "v_station").where("abs(lon) < double('infinity')").withColumnRenamed("station_id", "station")
    found = G.nearest(fixture(spark, d, "v_place"), stations, 3, target="place")
    return found.select("place", "station", F.round("km", 4).alias("km"), F.col("rank").cast("long").alias("rank"))


@query(
    duck(
        f"""WITH st AS (SELECT DISTINCT station, lon, lat FROM v_visit),
 met AS (SELECT station, granule_id, scanline, ground_pixel, p.ts, value, {KM.format(x1="p.lon", y1="p.lat", x2="st.lon", y2="st.lat")} AS km FROM v_swath p, st WHERE abs(p.lat - st.lat) < 1),
 r AS (SELECT visit, granule_id, scanline, ground_pixel, km, abs(date_diff('minute', met.ts, v.ts)) AS minutes, value, row_number() OVER (PARTITION BY visit, granule_id
  ORDER BY km, abs(date_diff('minute', met.ts, v.ts)), scanline, ground_pixel, value) AS k FROM v_visit v JOIN met ON met.station = v.station AND abs(date_diff('minute', met.ts, v.ts)) <= 1440 WHERE km <= 60)
 SELECT visit, granule_id, scanline, ground_pixel, round(km, 4) AS km, CAST(minutes AS DOUBLE) AS minutes, value FROM r WHERE k = 1""",
        "v_visit",
        "v_swath",
    )
)
def collocate_swath(spark, d):
    """The nearest pixel of each granule within 60 km and a day of every visit."""
    return G.collocate_swath(fixture(spark, d, "v_visit"), fixture(spark, d, "v_swath"), 60.0, 1440.0).withColumn("km", F.round("km", 4))


@query(
    duck(
        """WITH s AS (SELECT pollutant, engine, sqrt(avg((obs - pred) * (obs - pred))) AS rmse, count(*) AS n FROM v_oof GROUP BY 1, 2)
 SELECT pollutant, engine, round(rmse, 6) AS rmse, n, row_number() OVER (PARTITION BY pollutant ORDER BY rmse, engine) AS rank FROM s""",
        "v_oof",
    )
)
def engine_choice(spark, d):
    """Engines of each pollutant by their out-of-fold error."""
    return N.choose_engines(fixture(spark, d, "v_oof")).withColumn("rmse", F.round("rmse", 6)).withColumn("rank", F.col("rank").cast("long"))


def _kriging(panel: DataFrame, targets: DataFrame, stations: DataFrame, sums: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The eight nearest stations of places (target, lon, lat), and the pollutants' variograms."""
    near = G.nearest(targets, stations, 8).withColumnRenamed("station", "source")
    return near, E.variograms(panel, 100.0, 1500.0, KEYS, sums=sums)


#: Nugget, sill and reach of a given variogram.
GIVEN = (0.5, 10.0, 300.0)
_GAMMA = "(0.5e0 + 10e0 * (1 - exp(-{} / 300e0)))"


@query(
    duck(
        f"""WITH st AS (SELECT DISTINCT station, lon, lat FROM v_panel),
 d AS (SELECT t.station AS target, s.station, s.lon, s.lat, {KM.format(x1="t.lon", y1="t.lat", x2="s.lon", y2="s.lat")} AS km FROM st t JOIN st s ON t.station <> s.station),
 r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY km, station) AS k FROM d),
 two AS (SELECT a.target, a.station AS s1, b.station AS s2, {_GAMMA.format("a.km")} AS g1, {_GAMMA.format("b.km")} AS g2, {_GAMMA.format(KM.format(x1="a.lon", y1="a.lat", x2="b.lon", y2="b.lat"))} AS g12
  FROM r a JOIN r b ON a.target = b.target AND a.k = 1 AND b.k = 2),
 z AS (SELECT target, keys.pollutant, keys.day, g1, g2, g12, p.value AS z1, q.value AS z2, 0.5e0 + (g2 - g1) / (2 * g12) AS w
  FROM two CROSS JOIN (SELECT DISTINCT pollutant, day FROM v_panel) keys LEFT JOIN v_panel p ON p.station = s1 AND p.pollutant = keys.pollutant AND p.day = keys.day
  LEFT JOIN v_panel q ON q.station = s2 AND q.pollutant = keys.pollutant AND q.day = keys.day WHERE p.value IS NOT NULL OR q.value IS NOT NULL)
 SELECT target, pollutant, day, CASE WHEN z1 IS NULL OR z2 IS NULL THEN 1 ELSE 2 END AS n, round(CASE WHEN z2 IS NULL THEN z1 WHEN z1 IS NULL THEN z2 ELSE w * z1 + (1 - w) * z2 END, 4) AS pred,
  round(CASE WHEN z2 IS NULL THEN 2 * g1 WHEN z1 IS NULL THEN 2 * g2 ELSE w * g1 + (1 - w) * g2 + g1 - (1 - w) * g12 END, 6) AS variance FROM z""",
        "v_panel",
    )
)
def krige_two(spark, d):
    """Ordinary kriging of every station from its two nearest neighbours, by a given variogram."""
    panel = fixture(spark, d, "v_panel")
    stations = panel.select("station", "lon", "lat").distinct()
    near = G.nearest(stations.withColumnRenamed("station", "target"), stations, 3).where("target <> station").withColumnRenamed("station", "source")
    made = E.krige(panel, near, stations, GIVEN, KEYS, time="day")
    return made.select("target", "pollutant", "day", "n", F.round("pred", 4).alias("pred"), F.round("variance", 6).alias("variance"))


@query()
def krige_comunas(spark, d):
    """Means of comunas by block kriging over points inside them."""
    panel = fixture(spark, d, "v_panel")
    stations = panel.select("station", "lon", "lat").distinct()
    points = G.block_points(fixture(spark, d, "v_comuna_edge"), 1.0).withColumnRenamed("comuna", "target")
    centers = points.groupBy("target").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    near, models = _kriging(panel, centers, stations)
    return E.krige_blocks(panel, near, stations, points, models, KEYS, time="day").withColumnRenamed("target", "comuna")


@query()
def surface_engines(spark, d):
    """Every pollutant, comuna and day with an estimate by the pollutant's best engine that has one there: regression, kriging or boosting,
    compared by leaving stations out, on the same rows."""
    # read by each engine, twice: the panel, its stations, and the sums over their pairs, from which come the variograms of all and without each station
    panel = keep(fixture(spark, d, "v_panel"))
    stations = keep(panel.select("station", "lon", "lat").distinct())
    sums = keep(pair_arrays(panel, 100.0, 1500.0, KEYS))
    keys = ["pollutant", "comuna", "day"]
    places = panel.select("station", "comuna", "lon", "lat").distinct().groupBy("comuna").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    pollutants, days = (panel.agg(F.collect_set(c)).scalar() for c in ("pollutant", "day"))
    spine = places.select("comuna", "lon", "lat", F.explode(pollutants).alias("pollutant")).select("*", F.explode(days).alias("day"))
    spine = spine.join(panel.groupBy(*keys).agg(F.avg("x").alias("x")), keys, "left").withColumn("day_no", F.dayofmonth("day").cast("double"))

    targets = places.withColumnRenamed("comuna", "target")
    pairs = G.near_pairs(targets, stations.withColumnRenamed("station", "source"), E.reach(300.0), "target", "source")
    fits = E.gwr_fit(panel, pairs, [300.0], KEYS).withColumnRenamed("target", "comuna")
    near, models = _kriging(panel, targets, stations, sums)
    kriged = E.krige(panel, near, stations, models, KEYS, time="day").withColumnRenamed("target", "comuna")
    model = B.fit(panel, FEATURES, by="pollutant", trees=4, depth=3)
    estimates = {
        "gwr": spine.join(fits, keys).withColumn("estimate", F.col("intercept") + F.col("slope") * F.col("x")),
        "kriging": kriged.withColumnRenamed("pred", "estimate"),
        "gbt": model.score(spine, "estimate"),
    }

    row = ["pollutant", "station", "day"]
    own = G.nearest(stations.withColumnRenamed("station", "target"), stations, 9).where("target <> station").withColumnRenamed("station", "source")
    loso = E.krige(panel, own, stations, E.loso_variograms(panel, 100.0, 1500.0, KEYS, sums=sums), KEYS, time="day").withColumnRenamed("target", "station")
    observed = panel.select(*row, F.col("value").alias("obs"))
    out_of_fold = {
        "gwr": E.gwr_network(panel, [300.0], KEYS).withColumnRenamed("target", "station"),
        "kriging": loso.select(*row, "pred").join(observed, row),  # others' days have no observation
        "gbt": model.out_of_fold(panel).withColumnRenamed("value", "obs"),
    }
    oof = None
    for name, df in out_of_fold.items():
        part = df.select(*row, "obs", "pred", F.lit(name).alias("engine"))
        oof = part if oof is None else oof.unionByName(part)
    by_day = panel.groupBy("pollutant", "day").agg(F.avg("value").alias("mean_value"))
    overall = panel.groupBy("pollutant").agg(F.avg("value").alias("mean_value"))
    return N.surface_of_engines(spine, estimates, N.choose_engines(oof, row), [("day mean", by_day, ["pollutant", "day"]), ("mean", overall, ["pollutant"])], keys)
