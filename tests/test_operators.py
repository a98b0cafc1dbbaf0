"""Edge cases and properties of the exposure operators."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerostrata.functions import scalar as S
from aerostrata.operators import aggregate, crop, engines, geo, ledger, panel, predicates
from aerostrata.plans.fixtures import fixture
from aerostrata.sources import readers, sinks

DIR = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")


def test_bbox_edges_and_wild_values(spark):
    rows = [(1, -76.0, -56.5), (2, -66.0, -17.0), (3, -65.999, -20.0), (4, NAN, -20.0), (5, INF, -20.0), (6, None, -20.0), (7, -70.0, NAN)]
    df = spark.createDataFrame(rows, "i int, lon double, lat double")
    assert [r.i for r in predicates.within_bbox(df).orderBy("i").collect()] == [1, 2]
    flags = {r.i: r.quality for r in predicates.station_quality(df).collect()}
    assert flags == {1: "good", 2: "good", 3: "outside", 4: "not finite", 5: "not finite", 6: "missing", 7: "not finite"}
    assert S.CHILE.as_nwse() == (-17.0, -76.0, -56.5, -66.0)


def test_useful_reply(spark):
    x = "a" * 400
    rows = [(1, x), (2, x + "b"), (3, x + " Sin datos"), (4, x + " SIN DATOS"), (5, x + " No Existe"), (6, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    assert [r.i for r in df.where(predicates.is_useful(F.col("t"))).orderBy("i").collect()] == [2, 4]


def test_index_box_holds_area_and_is_idempotent(spark):
    swath = fixture(spark, DIR, "v_swath").cache()
    cut = crop.crop_index_box(swath)
    strict = predicates.within_bbox(swath)
    assert strict.exceptAll(cut).count() == 0
    assert cut.count() > strict.count()
    again = crop.crop_index_box(cut)
    assert again.count() == cut.count()
    one = spark.createDataFrame([(1, 5, 5, -70.0, -30.0), (1, 6, 6, 0.0, 0.0), (2, 1, 1, 0.0, 0.0)], "granule_id int, scanline int, ground_pixel int, lon double, lat double")
    assert [(r.scanline, r.ground_pixel) for r in crop.crop_index_box(one).collect()] == [(5, 5)]
    assert [tuple(r) for r in crop.empty_granules(one).collect()] == [(2, "empty")]


def test_coverage_uses_array_order(spark):
    t = dt.datetime
    rows = [(1, 0, 0, NAN, -30.0, t(2020, 1, 2)), (1, 0, 1, -70.0, INF, t(2020, 1, 3)), (1, 1, 0, -71.0, -31.0, t(2020, 1, 1))]
    df = spark.createDataFrame(rows, "granule_id int, scanline int, ground_pixel int, lon double, lat double, ts timestamp_ntz")
    r = crop.coverage(df).first()
    assert (r.lon_min, r.lon_max, r.lat_min, r.lat_max) == (-71.0, -70.0, -31.0, -30.0)
    assert (r.time_start, r.time_end) == (t(2020, 1, 2), t(2020, 1, 1))


def test_pending_keeps_names_without_crop_name(spark):
    cat = spark.createDataFrame([("a.nc",), ("b.nc4",), ("c.nc",), (None,), ("odd.txt",)], "granule string")
    led = spark.createDataFrame([("a.chile.nc",), ("b.chile.nc4.vacio",)], "name string")
    assert {r.granule for r in ledger.pending(cat, led).collect()} == {"c.nc", None, "odd.txt"}


def test_dates(spark):
    df = spark.sql("select date '2020-01-15' lo, date '2020-03-02' hi")
    assert [str(r.month) for r in S.months_between(df, "lo", "hi").collect()] == ["2020-01-01", "2020-02-01", "2020-03-01"]
    assert [str(r.month_end) for r in S.months_between(df, "lo", "hi", whole_only=True).collect()] == ["2020-02-29", "2020-03-31"]
    chunks = S.day_chunks(spark.sql("select date '2020-02-25' lo, date '2020-03-03' hi"), "lo", "hi").collect()
    assert [(str(r.chunk_start), str(r.chunk_end)) for r in chunks] == [("2020-02-25", "2020-02-29"), ("2020-03-01", "2020-03-03")]


def test_domain_errors(spark):
    df, domain = spark.createDataFrame([("a",), ("z",)], "c string"), spark.createDataFrame([("a",)], "c string")
    with pytest.raises(ValueError, match="z"):
        predicates.require_known(df, domain, "c")
    with pytest.raises(ValueError):
        predicates.resolve_columns(df, {"x": ["y"]})
    with pytest.raises(ValueError):
        ledger.union_sensors({"terra": df}, ["aqua"])
    with pytest.raises(ValueError):
        panel.build_panel(df, {"p": df.withColumn("observed", F.lit(1))}, ["c"])


def test_point_in_polygon_at_most_one(spark):
    placed = geo.assign_comuna(fixture(spark, DIR, "v_swath").select("lon", "lat").distinct(), fixture(spark, DIR, "v_comuna_edge"))
    assert placed.groupBy("lon", "lat").count().where("count > 1").count() == 0


def test_hourly_counts_sum_to_rows(spark):
    obs = fixture(spark, DIR, "v_obs")
    assert aggregate.comuna_hourly(obs).agg(F.sum("n")).first()[0] == obs.count()
    weighted = aggregate.comuna_hourly(obs.withColumn("w", F.lit(2.0)), weights="w")
    both = weighted.withColumnRenamed("mean_value", "m").join(aggregate.comuna_hourly(obs), ["pollutant", "comuna", "hour"])
    assert both.where("abs(m - mean_value) > 1e-9").count() == 0


def test_wide_kernel_is_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.uniform(-71, -70)), float(rng.uniform(-34, -33)), 0, float(x), float(3 + 2 * x + rng.normal())) for i, x in enumerate(rng.normal(size=30))]
    df = spark.createDataFrame(rows, "station int, lon double, lat double, hour int, x double, value double")
    pairs = engines.loso_pairs(df, 500.0)
    got = {r.target: r.slope for r in engines.gwr_loso(df, pairs, [1e9]).collect()}
    x, y = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    for i in range(30):
        keep = np.arange(30) != i
        assert got[i] == pytest.approx(np.polyfit(x[keep], y[keep], 1)[0], rel=1e-6)
    multi = {r.target: r.pred for r in engines.gwr_multi(df, ["x"], 1e9).collect()}
    single = {r.target: r.pred for r in engines.gwr_loso(df, pairs, [1e9]).collect()}
    assert all(multi[k] == pytest.approx(v, rel=1e-4) for k, v in single.items())


def test_network_regression_equals_pairs(spark):
    """Matrix products by key against sums over pairs, also in small blocks, with stations that lack a value and keys with few."""
    panel = fixture(spark, DIR, "v_panel").where("day < timestamp_ntz '2024-01-06 00:00:00'").withColumn("x", F.expr("if(station % 11 = 3, null, x)"))
    known = panel.where("x is not null")
    pairs = engines.loso_pairs(panel.select("station", "lon", "lat").distinct(), engines.reach(200.0))
    keys = ["bandwidth", "target", "pollutant", "day"]
    want = {tuple(r[k] for k in keys): r for r in engines.gwr_loso(known, pairs, [100.0, 200.0], ("pollutant", "day")).collect()}
    for block in (7, 512):
        got = {tuple(r[k] for k in keys): r for r in engines.gwr_network(panel, [100.0, 200.0], ("pollutant", "day"), block=block).collect()}
        assert set(got) == set(want) and want
        assert all(got[k].n == want[k].n and got[k].pred == pytest.approx(want[k].pred, rel=1e-6, abs=1e-6) and got[k].obs == want[k].obs for k in want)
    assert engines.gwr_network(panel.limit(0), [100.0], ("pollutant", "day")).count() == 0


def test_kriging_weights(spark):
    places = spark.createDataFrame([(i, -70.0 - i * 0.1, -33.0 - (i % 3) * 0.1) for i in range(6)], "station int, lon double, lat double")
    values = places.select("station", F.lit(0).alias("hour"), (F.col("station") * 2.0).alias("value"))
    near = geo.neighbours(places.withColumnRenamed("station", "target"), places, 6, 500.0).withColumnRenamed("station", "source")
    out = engines.krige(values, near, places, (0.0, 1.0, 50.0)).collect()
    assert len(out) == 6
    for r in out:
        assert r.weights == pytest.approx(1.0, abs=1e-6)
        assert r.pred == pytest.approx(2.0 * r.target, abs=1e-6)  # exact at a station without nugget


def test_asof_and_gaps(spark):
    t = dt.datetime
    p = spark.createDataFrame([(1, t(2020, 1, 1, 5)), (1, t(2020, 1, 1, 1))], "k int, ts timestamp_ntz")
    s = spark.createDataFrame([(1, t(2020, 1, 1, 2), 7.0), (1, t(2020, 1, 1, 5), 9.0)], "k int, ts timestamp_ntz, v double")
    assert {(r.ts.hour, r.v) for r in panel.align_asof(p, s, ["k"], "v").collect()} == {(5, 9.0), (1, None)}
    h = p.select("k", F.col("ts").alias("hour"))
    assert [tuple(r)[1:] for r in aggregate.hour_gaps(h, ["k"]).collect()] == [(t(2020, 1, 1, 1), t(2020, 1, 1, 5), 3)]


def test_sources_and_sinks(spark, tmp_path):
    stations = [{"region": "RV", "estacion": "0001", "comuna": "Concón", "lat": INF, "lon": INF, "nombre_region": "Valparaíso", "param_pm25": "x"}]
    (tmp_path / "s.json").write_text(json.dumps(stations))
    r = readers.read_station_config(spark, str(tmp_path / "s.json")).first()
    assert (r.estacion, r.nombre, r.lat) == ("0001", "", INF)
    (tmp_path / "s.csv").write_text('region_sinca,estacion,nombre,comuna,lat,lon,n_anios_con_datos\nRV,F01,"A, b",Concón,inf,inf,0\n')
    r = readers.read_station_csv(spark, str(tmp_path / "s.csv")).first()
    assert (r.nombre, r.lat, r.n_anios_con_datos) == ("A, b", INF, 0)
    folder = tmp_path / "sinca" / "pm25" / "horario"
    folder.mkdir(parents=True)
    (folder / "RV_F01_horario_190101_241231.csv").write_text("x;1\n")
    r = readers.read_series(spark, str(tmp_path / "sinca"), "a string, b int", sep=";").first()
    assert (r.pollutant, r.resolution, r.region, r.station, r.date_from, r.b) == ("pm25", "horario", "RV", "F01", "190101", 1)
    assert readers.read_listing(spark, str(tmp_path / "sinca")).first()["size"] == 4
    days = spark.createDataFrame([("p", "2020-01-01", 1), ("p", "2020-01-02", 2)], "product string, granule_day string, v int")
    out = str(tmp_path / "crop")
    sinks.write_cropped(days, out)
    sinks.write_cropped(days.where("v = 2"), out)  # a second run of one day leaves the other
    assert spark.read.parquet(out).count() == 2
    sinks.write_manifest(days, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    grid = spark.sql("select timestamp_ntz '2020-02-01 00:00:00' ts, 1.0 value, 'no2' pollutant")
    sinks.write_monthly(grid, str(tmp_path / "g"))
    sinks.write_panel(grid, str(tmp_path / "p"))
    sinks.write_surface(grid.withColumnRenamed("ts", "hour"), str(tmp_path / "f"))
    sinks.write_report(grid, str(tmp_path / "r"))
    assert (tmp_path / "f" / "pollutant=no2" / "year=2020" / "month=2").is_dir()
    assert readers.products(spark).where("version = '10'").count() == 1


def test_grid_swath_and_static_readers(spark, tmp_path):
    grid = spark.createDataFrame([("a", -30.0, -70.0, 1.0), ("b", -31.0, -71.0, 2.0)], "product string, lat double, lon double, value double")
    grid.write.partitionBy("product").parquet(str(tmp_path / "grid"))
    assert [(r.product, r.value) for r in readers.read_grid(spark, str(tmp_path / "grid"), "b").collect()] == [("b", 2.0)]
    grid.drop("product").write.parquet(str(tmp_path / "plain"))
    assert {r["product"] for r in readers.read_grid(spark, str(tmp_path / "plain"), "c").collect()} == {"c"}
    nested = spark.createDataFrame([("g", [-30.0, -31.0], [-70.0, -71.0], [[1.0, 2.0], [3.0, 4.0]])], "id string, lats array<double>, lons array<double>, v array<array<double>>")
    assert {(r.lat, r.lon, r.value) for r in readers.grid_rows(nested, "lats", "lons", "v").collect()} == {(-30.0, -70.0, 1.0), (-30.0, -71.0, 2.0), (-31.0, -70.0, 3.0), (-31.0, -71.0, 4.0)}
    pixels = spark.createDataFrame([(1, 0, 0, -30.0, -70.0, 5.0)], "granule_id int, scanline int, ground_pixel int, lat double, lon double, value double")
    pixels.write.parquet(str(tmp_path / "swath"))
    assert [tuple(r) for r in readers.read_swath(spark, str(tmp_path / "swath")).collect()] == [(1, 0, 0, -30.0, -70.0, 5.0)]
    static = spark.createDataFrame([(1, 0.5, 9), (2, 0.7, 8)], "comuna int, urban double, roads int")
    static.write.parquet(str(tmp_path / "static"))
    assert readers.read_static(spark, str(tmp_path / "static"), ["urban"]).columns == ["comuna", "urban"]
    assert readers.read_static(spark, str(tmp_path / "static")).count() == 2
    obs = spark.createDataFrame([(1, 3.0), (3, 4.0)], "comuna int, observed double")
    joined = panel.build_panel(obs, {}, ["comuna"], readers.read_static(spark, str(tmp_path / "static"), ["urban"]))
    assert {(r.comuna, r.urban) for r in joined.collect()} == {(1, 0.5), (3, None)}
    with pytest.raises(ValueError, match="rivers"):
        readers.read_static(spark, str(tmp_path / "static"), ["rivers"])
    static.union(static.limit(1)).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="repeated comuna"):
        readers.read_static(spark, str(tmp_path / "twice"))


def test_macrozones(spark):
    zones = {r.nombre_region: r.macrozone for r in geo.macrozones(spark).collect()}
    assert len(zones) == 16 and zones["Biobío"] == "Sur" and zones["Atacama"] == "Norte Chico"


def test_history_and_metadata(spark):
    covered = spark.createDataFrame([(1, -30.0), (2, -31.0), (3, -32.0)], "granule_id int, lat_min double")
    meta = spark.createDataFrame([(1, "made", 7), (2, None, 8)], "granule_id int, history string, orbit int")
    got = {r.granule_id: (r.history, r.orbit, r.lat_min) for r in crop.with_history(covered, meta, "cropped").collect()}
    assert got == {1: ("made\ncropped", 7, -30.0), 2: ("cropped", 8, -31.0), 3: ("cropped", None, -32.0)}


def test_missing_variables_are_warned_of(spark):
    df = spark.range(1).withColumnRenamed("id", "no2")
    with pytest.warns(UserWarning, match="o3"):
        assert predicates.resolve_columns(df, {"NO2": ["NO2_x", "no2"], "o3": ["O3"]}).columns == ["NO2"]


def test_writes_leave_other_partitions(spark, tmp_path):
    rows = spark.sql("select explode(sequence(timestamp_ntz '2020-01-01 00:00:00', timestamp_ntz '2020-03-01 00:00:00', interval 1 month)) hour, 'no2' pollutant, 1.0D estimate")
    sinks.write_surface(rows, str(tmp_path / "s"))
    sinks.write_surface(rows.where("month(hour) = 2").withColumn("estimate", F.lit(5.0)), str(tmp_path / "s"))
    assert sorted((r.month, float(r.estimate)) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, 1.0), (2, 5.0), (3, 1.0)]
    two = rows.select("pollutant", "estimate").limit(1).union(rows.select(F.lit("o3"), "estimate").limit(1))
    sinks.write_panel(two, str(tmp_path / "p"))
    sinks.write_panel(two.where("pollutant = 'o3'"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_report(spark.range(50).repartition(5), str(tmp_path / "r"))
    sinks.write_report(spark.range(50).repartition(5), str(tmp_path / "many"), one_file_rows=10)
    assert len(list((tmp_path / "r").glob("*.json"))) == 1 and len(list((tmp_path / "many").glob("*.json"))) == 5


def km_by_hand(a, b):
    x1, y1, x2, y2 = map(np.radians, (*a, *b))
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h)))


@pytest.mark.parametrize("reach", [50.0, 700.0, 3000.0, 12000.0])
def test_near_pairs_all_over_the_globe(spark, reach):
    """Across the date line, at the poles and with a crowd in one place, against all pairs."""
    rng = np.random.default_rng(1)
    spots = [(float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for _ in range(60)]
    spots += [(179.9, 10.0), (-179.9, 10.0), (0.0, 90.0), (100.0, 89.9), (0.0, -90.0), (-70.0, -33.0)] + [(-70.0 + i * 0.01, -33.0) for i in range(40)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "station int, lon double, lat double")
    got = {(r.target, r.source): r.km for r in engines.loso_pairs(df, reach).collect()}
    want = {(i, j): km_by_hand(a, b) for i, a in enumerate(spots) for j, b in enumerate(spots) if i != j}
    assert set(got) == {k for k, d in want.items() if d <= reach}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


@pytest.mark.parametrize("reach", [0.001, 30.0, 20015.0, 21000.0])
def test_pairs_of_a_crowd_are_dealt_over_tasks(spark, monkeypatch, reach):
    """Most stations in one cell, some at one place, two at opposite ends, one without a place: all pairs, and none of the tasks has most of them."""
    monkeypatch.setattr(geo, "SIDE", 20)
    monkeypatch.setattr(geo, "TASK_PAIRS", 500)
    rng = np.random.default_rng(4)
    spots = [(float(x), float(y)) for x, y in rng.uniform((-70.9, -33.7), (-70.4, -33.2), (150, 2))] + [(-70.5, -33.5)] * 5 + [(109.5, 33.5), (179.99, 0.0), (-179.99, 0.0), (float("nan"), 1.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "station int, lon double, lat double")
    rows = engines.loso_pairs(df, reach).withColumn("task", F.spark_partition_id()).collect()
    want = {(i, j): km_by_hand(a, b) for i, a in enumerate(spots) for j, b in enumerate(spots) if i != j}
    assert len(rows) == len({(r.target, r.source) for r in rows})
    assert {(r.target, r.source) for r in rows} == {k for k, d in want.items() if d <= reach}
    if reach > 1:
        tasks = [r.task for r in rows]
        assert max(tasks.count(t) for t in set(tasks)) < len(rows) / 2


def test_asof_carries_over_periods(spark):
    """A key with most of the rows, gaps of months and ties, against a search by hand."""
    rng = np.random.default_rng(3)
    start = dt.datetime(2020, 1, 1)

    def times(n):
        return [start + dt.timedelta(hours=int(h)) for h in rng.integers(0, 24 * 400, n)]

    left = [(k, t) for k, n in ((1, 300), (2, 5), (None, 5)) for t in times(n)]
    right = [(k, t, float(v)) for k, n in ((1, 12), (2, 2), (None, 2)) for t, v in zip(times(n), rng.integers(0, 99, n), strict=True)]
    right += [(1, right[0][1], 500.0), (1, right[0][1], None)]
    p = spark.createDataFrame(left, "k int, ts timestamp_ntz")
    s = spark.createDataFrame(right, "k int, ts timestamp_ntz, v double")
    got = sorted((r.k or 0, r.ts, r.v) for r in panel.align_asof(p, s, ["k"], "v").collect())

    def latest(k, t):
        past = [(u, v) for j, u, v in right if j == k and u <= t and v is not None]
        return max(past)[1] if past else None

    assert got == sorted((k or 0, t, latest(k, t)) for k, t in left)


def test_points_of_real_shapes(spark):
    """A concave polygon, one with a hole-like notch and shared edges, against a ray by hand; crowded points."""
    shapes = {1: [(-70.0, -33.0), (-69.0, -33.0), (-69.0, -32.0), (-69.5, -32.6), (-70.0, -32.0)], 2: [(-69.0, -33.0), (-66.3, -33.0), (-66.3, -31.1), (-69.0, -32.0)]}
    edges = [(c, i, *s[i], *s[(i + 1) % len(s)]) for c, s in shapes.items() for i in range(len(s))]
    e = spark.createDataFrame(edges, "comuna int, edge int, lon1 double, lat1 double, lon2 double, lat2 double")
    rng = np.random.default_rng(4)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-70.5, -66, 600), rng.uniform(-33.5, -30.5, 600), strict=True))]
    points += [(900 + i, -69.4, -32.9) for i in range(50)] + [(990, None, -32.0), (991, NAN, -32.0), (992, -69.0, -32.5)]

    def holds(s, x, y):
        n = 0
        for (x1, y1), (x2, y2) in zip(s, s[1:] + s[:1], strict=True):
            n += (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return n % 2 == 1

    got = sorted((r.i, r.comuna) for r in geo.assign_comuna(spark.createDataFrame(points, "i int, lon double, lat double"), e).collect())
    assert got == sorted((i, c) for i, x, y in points if x is not None and x == x for c, s in shapes.items() if holds(s, x, y))


def test_surface_has_no_gaps(spark):
    rows = spark.sql("select * from values (1, 1, 2.0D), (1, 2, null), (2, 1, 4.0D), (2, 3, 1.0D) t(comuna, hour, x)")
    fits = spark.sql("select * from values (1, 1, 3.0D, 1.0D), (1, 2, 3.0D, 1.0D) t(comuna, hour, slope, intercept)")
    by_hour = spark.sql("select * from values (1, 9.0D), (2, 8.0D) t(hour, mean_value)")
    overall = spark.sql("select 1 as one, 7.0D as mean_value")
    made = panel.surface(rows.withColumn("one", F.lit(1)), fits, [("hour", by_hour, ["hour"]), ("all", overall, ["one"])], ["comuna", "hour"], "gwr")
    assert {(r.comuna, r.hour): (r.estimate, r.engine) for r in made.collect()} == {(1, 1): (7.0, "gwr"), (1, 2): (8.0, "hour"), (2, 1): (9.0, "hour"), (2, 3): (7.0, "all")}


def steps(spark, n=12, hours=20):
    """Stations whose value is a step of a; b is noise."""
    rng = np.random.default_rng(0)
    rows = [(f"s{i}", h, "pm25" if i % 2 else "no2", float(a), float(b), 10.0 if a > 0.5 else 2.0) for i in range(n) for h in range(hours) for a, b in [rng.uniform(size=2)]]
    return spark.createDataFrame(rows, "station string, hour int, pollutant string, a double, b double, value double")


def test_boosting_by_values(spark):
    table = steps(spark)
    holes = table.withColumn("a", F.when(F.col("hour") == 3, None).otherwise(F.col("a")))
    got = engines.gbt_oof(holes, ["a", "b"], folds=5, maxIter=2, maxDepth=2)
    assert got.count() == table.count()  # no row is lost
    assert got.where("pred is null").select("hour").distinct().collect() == [(3,)]
    near = got.where("pred is not null")
    assert near.where("abs(pred - value) < 0.5").count() >= 0.95 * near.count()
    assert {r.n for r in got.groupBy("fold").agg(F.count_distinct("station").alias("n")).collect()} == {2, 3}
    assert got.groupBy("station").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    few = table.where("station in ('s1', 's2', 's3')")
    alone = engines.gbt_oof(few, ["a", "b"], folds=None, maxIter=1, maxDepth=1)  # exact: every station by itself
    assert {r.n for r in alone.groupBy("fold").agg(F.count_distinct("station").alias("n")).collect()} == {1} and alone.count() == few.count()
    from pyspark.ml.linalg import Vectors

    for name in ("s1", "s2", "s3"):
        model = engines.fit_gbt(few.where(F.col("station") != name), ["a", "b"], maxIter=1, maxDepth=1)
        for r in alone.where(F.col("station") == name).limit(5).collect():
            assert model.predict(Vectors.dense([r.a, r.b])) == pytest.approx(r.pred)
    ranked = engines.importances(spark, engines.fit_gbt(table, ["b", "a"], maxIter=2, maxDepth=2), ["b", "a"]).orderBy("rank").collect()
    assert [r.feature for r in ranked] == ["a", "b"] and ranked[0].importance > 0.9 and sum(r.importance for r in ranked) == pytest.approx(1.0)
    top = engines.top_features(table, ["b", "a"], 1, maxIter=2, maxDepth=2).collect()
    assert {(r.pollutant, r.feature, r["rank"]) for r in top} == {("no2", "a", 1), ("pm25", "a", 1)}


def test_kriging_by_hand_without_the_held_out_station(spark):
    rng = np.random.default_rng(6)
    spots = [(-70.0 + float(x), -33.0 + float(y)) for x, y in rng.uniform(0, 3, (9, 2))]
    rows = [("p", i, h, *spots[i], float(5 * np.sin(i) + h + rng.normal())) for i in range(9) for h in range(4)]
    table = spark.createDataFrame(rows, "pollutant string, station int, hour int, lon double, lat double, value double")
    models = engines.loso_variograms(table, 40.0, 600.0, ("pollutant", "hour"))
    fitted = {r.target: (r.nugget, r.sill, r.reach) for r in models.collect()}
    z = {(i, h): v for _, i, h, _, _, v in rows}
    for out in range(9):
        bins = {}
        for i in range(9):
            for j in range(i):
                d = km_by_hand(spots[i], spots[j])
                if out not in (i, j) and d <= 600:
                    for h in range(4):
                        bins.setdefault(int(d // 40), []).append(0.5 * (z[i, h] - z[j, h]) ** 2)
        want = engines.fit_exponential([((b + 0.5) * 40, np.mean(g), float(len(g))) for b, g in sorted(bins.items())])
        assert fitted[out] == pytest.approx(want, rel=1e-6, abs=1e-6)
    places = table.select("station", "lon", "lat").distinct()
    near = geo.neighbours(places.withColumnRenamed("station", "target"), places, 5, 600.0).where("target <> station").withColumnRenamed("station", "source")
    sources = {}
    for r in near.collect():
        sources.setdefault(r.target, []).append(r.source)
    for r in engines.krige(table, near, places, models, ("pollutant", "hour")).collect():
        nugget, sill, reach = fitted[r.target]
        near_by = sorted(sources[r.target])

        def gamma(a, b):
            d = km_by_hand(spots[a], spots[b])
            return nugget + sill * (1 - np.exp(-d / reach)) if d > 0 else 0.0

        n = len(near_by)
        m = np.ones((n + 1, n + 1))
        m[n, n] = 0
        m[:n, :n] = [[gamma(a, b) for b in near_by] for a in near_by]
        w = np.linalg.solve(m, [*(gamma(a, r.target) for a in near_by), 1.0])
        assert r.pred == pytest.approx(float(w[:n] @ [z[a, r.hour] for a in near_by]), rel=1e-6, abs=1e-6) and r.n == n


def test_empty_tables(spark):
    swath = fixture(spark, DIR, "v_swath").limit(0)
    assert crop.crop_index_box(swath).count() == 0
    obs = fixture(spark, DIR, "v_obs").limit(0)
    assert aggregate.comuna_hourly(obs).count() == 0
    oof = fixture(spark, DIR, "v_oof").limit(0)
    assert aggregate.metrics(oof, [["pollutant"]]).count() == 0


def test_regressions_reach_as_far_as_their_kernel(spark):
    from aerostrata.plans import engine_queries as Q
    from aerostrata.plans.fixtures import fixture

    rows = Q.gwr_loso(spark, DIR).select("target", "pollutant", "day", "n", "pred").orderBy("target", "pollutant", "day").limit(5).collect()
    panel = fixture(spark, DIR, "v_panel").toPandas()
    for r in rows:
        same = panel[(panel.pollutant == r.pollutant) & (panel.day == r.day)]
        me, others = same[same.station == r.target].iloc[0], same[same.station != r.target]
        a, b = np.radians(me.lat), np.radians(others.lat)
        h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(me.lon - others.lon) / 2) ** 2
        w = np.exp(-0.5 * (2 * 6371.0 * np.arcsin(np.sqrt(h)) / 300.0) ** 2)
        assert r.n == (w >= 1e-12).sum()
        mx, my = np.average(others.x, weights=w), np.average(others.value, weights=w)
        slope = (w * (others.x - mx) * (others.value - my)).sum() / (w * (others.x - mx) ** 2).sum()
        assert abs(my + slope * (me.x - mx) - r.pred) < 0.02
    assert len(rows) == 5


def test_day_chunks_cover_whole_spans(spark):
    from aerostrata.plans import source_queries as Q

    chunks = Q.day_chunks(spark, DIR)
    last = {r.o_custkey: r.last for r in chunks.groupBy("o_custkey").agg(F.max("chunk_end").alias("last")).collect()}
    orders = spark.read.parquet(f"{DIR}/orders.parquet").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("hi"))
    assert last == {r.o_custkey: r.hi for r in orders.collect()}
