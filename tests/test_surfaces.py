"""Engines side by side, block kriging, area shares, neighbours and swaths against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerostrata.operators import aggregate, boxes, engines, geo, network, panel
from aerostrata.plans.fixtures import fixture

DIR = "/root/testdata/sf0.01"
RNG = np.random.default_rng


def km_by_hand(a, b):
    x1, y1, x2, y2 = map(np.radians, (*a, *b))
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h)))


def edges_of(spark, polygons):
    rows = [(c, i, *p[i], *p[(i + 1) % len(p)]) for c, rings in polygons.items() for p in rings for i in range(len(p))]
    return spark.createDataFrame([(c, i, float(a), float(b), float(x), float(y)) for c, i, a, b, x, y in rows], "comuna int, edge int, lon1 double, lat1 double, lon2 double, lat2 double")


def clipped_area(ring, w, e, s, n):
    """Area of a ring inside a box, half-plane by half-plane."""
    for axis, at, keep in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = keep * (p[axis] - at), keep * (q[axis] - at)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2 if ring else 0.0


def star(rng, x, y, size, n=9):
    at = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(0.3, 1, n) * size
    return [(float(x + a * np.cos(t)), float(y + a * np.sin(t))) for a, t in zip(r, at)]


def test_shares_are_areas_clipped_by_hand(spark):
    """Stars of any shape and direction, one with a hole, on cells wider than high, against clipping by four half-planes."""
    rng = RNG(4)
    polygons = {k: [star(rng, rng.uniform(-72, -68), rng.uniform(-40, -36), rng.uniform(0.1, 2.5))] for k in range(6)}
    polygons[1][0].reverse()
    hole = [(-70.2, -38.2), (-70.2, -37.9), (-69.9, -37.9), (-69.9, -38.2)]
    polygons[9] = [[(-71.0, -39.0), (-69.0, -39.0), (-69.0, -37.0), (-71.0, -37.0)], hole]
    dx, dy, ox, oy = 0.5, 0.3, -71.15, -38.04
    centers = [(ox + i * dx, oy + j * dy) for i in range(-8, 9) for j in range(-12, 13)]
    cells = spark.createDataFrame([*centers, centers[0], (None, 1.0), (float("nan"), 1.0)], "lon double, lat double")
    got = {(round(r.lon, 6), round(r.lat, 6), r.comuna): r.share for r in geo.cell_shares(cells, edges_of(spark, polygons), (dx, dy), (ox, oy)).collect()}
    for x, y in centers:
        for c, (ring, *inner) in polygons.items():
            box = (x - dx / 2, x + dx / 2, y - dy / 2, y + dy / 2)
            want = (clipped_area(ring, *box) - sum(clipped_area(r, *box) for r in inner)) / (dx * dy)
            assert got.get((round(x, 6), round(y, 6), c), 0.0) == pytest.approx(want, abs=1e-8)


def test_shares_of_a_partition_add_up(spark):
    rects = fixture(spark, DIR, "v_comuna_rect")
    inside = spark.createDataFrame([(-79.0 + 0.625 * i, -57.0 + 1.25 * j) for i in range(20) for j in range(20)], "lon double, lat double")
    sums = geo.cell_shares(inside, rects, (0.625, 1.25), (-79.0, -57.0)).groupBy("lon", "lat").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 400 and all(r.s == pytest.approx(1.0, abs=1e-9) for r in sums)
    assert geo.cell_shares(inside.limit(0), rects, (0.625, 1.25), (-79.0, -57.0)).count() == 0


def holds(ring, x, y):
    n = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        n += (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return n % 2 == 1


def test_points_by_quadtree(spark):
    """A coast of 10,000 edges, stars, and polygons whose ends and sides lie on the lines of the cells, with points on all of these lines."""
    rng = RNG(5)
    t = np.linspace(0, 2 * np.pi, 10_000, endpoint=False)
    r = 1.3 + 0.2 * np.sin(7 * t) + 0.02 * rng.normal(size=10_000)
    polygons = {1: [(float(x), float(y)) for x, y in zip(-70 + r * np.cos(t), -33 + r * np.sin(t))], 2: star(rng, -67, -33, 1.4), 3: star(rng, -73, -33, 0.2)}
    polygons |= {4: [(-70.0, -38.0), (-69.0, -38.0), (-69.0, -36.5), (-69.5, -37.0), (-70.0, -36.5)], 5: [(-69.0, -38.0), (-67.5, -38.0), (-67.5, -36.0), (-69.0, -36.5)], 6: [(-65.0, -38.0), (-61.0, -36.0), (-65.0, -34.0)]}
    e = edges_of(spark, {k: [p] for k, p in polygons.items()})
    spots = [(float(x), float(y)) for x, y in np.c_[rng.uniform(-74, -60, 2500), rng.uniform(-39, -31, 2500)]]
    spots += [(-74 + 0.25 * i, -38.5 + 0.25 * j) for i in range(50) for j in range(28)] + polygons[2] + polygons[4] + polygons[6] + polygons[1][::500]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "i int, lon double, lat double")
    got = sorted((r.i, r.comuna) for r in geo.assign_comuna(points, e).collect())
    assert got == sorted((i, c) for i, p in enumerate(spots) for c, s in polygons.items() if holds(s, *p))
    cells = geo._leaves(e, "comuna", 0.5)
    assert cells.where("comuna = 1 and size(edges) = 0").count() > 5
    most = geo._leaves(e, "comuna", 0.5, cells.where("comuna = 1 and size(edges) > 64").select("comuna", "_cx", "_cy")).agg(F.max(F.size("edges"))).first()[0]
    assert most < 300
    assert geo.assign_comuna(points.limit(0), e).count() == 0 and geo.assign_comuna(points, e.limit(0)).count() == 0


def test_nearest_by_cells_is_exact(spark, monkeypatch):
    """All levels of cells: oceans, poles, the date line, many at one place, fewer than asked for."""
    monkeypatch.setattr(geo, "FEW_PAIRS", 0)
    monkeypatch.setattr(geo, "LEAF", 2)
    monkeypatch.setattr(geo, "DEEPEST", 5)
    rng = RNG(3)
    spots = [(float(x), float(y)) for x, y in np.c_[rng.uniform(-80, -60, 200), rng.uniform(-60, -10, 200)]] + [(179.9, 10.0), (-179.9, 10.1), (0.0, 90.0), (90.0, 89.9), (10.0, -90.0)] + [(-70.0, -33.0)] * 9
    asked = [(float(x), float(y)) for x, y in np.c_[rng.uniform(-180, 180, 80), rng.uniform(-90, 90, 80)]] + [(180.0, 10.0), (-180.0, 10.0), (45.0, 90.0), (-70.0, -33.0), (0.0, -90.0), (360.0, 0.0), (-0.0, 0.0)]
    stations = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "station int, lon double, lat double")
    targets = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "target int, lon double, lat double")
    got = {}
    for r in geo.nearest(targets, stations, 4).collect():
        got.setdefault(r.target, {})[r["rank"]] = (r.station, r.km)
    assert set(got) == set(range(len(asked)))
    for i, p in enumerate(asked):
        want = sorted((round(float(km_by_hand(p, q)), 6), j) for j, q in enumerate(spots))[:4]
        assert [got[i][k][1] for k in range(1, 5)] == pytest.approx([d for d, _ in want], abs=1e-5)
        assert len({got[i][k][0] for k in range(1, 5)}) == 4
    assert geo.nearest(targets, stations.limit(3), 4).count() == 3 * len(asked)
    near = geo.neighbours(stations.withColumnRenamed("station", "target"), stations, 3, 50.0)
    assert {(r.target, r.station) for r in near.collect()} == {(r.target, r.station) for r in geo.nearest(stations.withColumnRenamed("station", "target"), stations, 3).where("km <= 50").collect()}


def test_nearest_starts_at_the_finest_level_with_few_pairs(spark, monkeypatch):
    """Three levels of cells at these places: one bound of pairs, not one for each level and side; the answers are those of all pairs."""
    rng = RNG(8)
    spots = np.c_[rng.uniform(-80, -60, 2_400), rng.uniform(-60, -10, 2_400)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "station int, lon double, lat double")
    bounds, bounded = [], geo._bounded
    monkeypatch.setattr(geo, "_bounded", lambda pairs, k: bounds.append(k) or bounded(pairs, k))
    got = {(r.target, r["rank"]): (r.station, r.km) for r in geo.nearest(df.withColumnRenamed("station", "target"), df, 3).collect()}
    assert len(bounds) == 1 and len(got) == 3 * len(spots)
    for i in range(0, len(spots), 7):
        km = km_by_hand(spots[i], (spots[:, 0], spots[:, 1]))
        for rank, j in enumerate(np.argsort(km)[:3], 1):
            assert got[i, rank] == (j, pytest.approx(km[j], abs=1e-6))


def test_nearest_wherever_they_are(spark):
    """Crowds, empty oceans, poles and the date line; fewer stations than asked for; places that are none."""
    rng = RNG(2)
    spots = [(float(x), float(y)) for x, y in np.c_[rng.normal(-70.6, 0.02, 60), rng.normal(-33.4, 0.02, 60)]]
    spots += [(float(x), float(y)) for x, y in np.c_[rng.uniform(-180, 180, 25), rng.uniform(-90, 90, 25)]] + [(179.9, 10.0), (-179.9, 10.1), (0.0, 90.0), (90.0, 89.9), (10.0, -90.0)]
    asked = [(float(x), float(y)) for x, y in np.c_[rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60)]] + [(180.0, 10.0), (-180.0, 10.0), (45.0, 90.0), (-70.6, -33.4), (-120.0, -45.0), (190.0, 0.0)]
    stations = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(900, float("nan"), 0.0), (901, None, 1.0)], "station int, lon double, lat double")
    targets = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)] + [(900, None, 0.0), (901, 5.0, float("inf"))], "target int, lon double, lat double")
    got = {}
    for r in geo.nearest(targets, stations, 4).collect():
        got.setdefault(r.target, []).append((r["rank"], r.station, r.km))
    assert set(got) == set(range(len(asked)))
    for i, p in enumerate(asked):
        want = sorted((float(km_by_hand(p, s)), j) for j, s in enumerate(spots))[:4]
        assert [x[2] for x in sorted(got[i])] == pytest.approx([d for d, _ in want], abs=1e-6)
        assert [x[1] for x in sorted(got[i])] == [j for _, j in want]
    assert geo.nearest(targets.where("target < 3"), stations.where("station < 2"), 4).count() == 6
    assert geo.nearest(targets, stations.limit(0), 4).count() == 0


def test_swath_pixels_of_visits(spark):
    rng = RNG(3)
    base = np.datetime64("2020-01-01T00:00:00")
    at = lambda m: (base + np.timedelta64(int(m), "m")).astype("datetime64[us]").item()
    pixels = [(int(rng.integers(3)), int(i), int(rng.integers(5)), float(rng.uniform(-71, -69)), float(rng.uniform(-34, -32)), at(rng.integers(0, 600)), float(i)) for i in range(300)]
    pixels += [(1, 900, 0, float("nan"), -33.0, at(5), 1.0), (1, 901, 0, None, -33.0, at(5), 1.0), (1, 902, 0, -70.0, -33.0, None, 1.0)]
    spots = [(float(rng.uniform(-71, -69)), float(rng.uniform(-34, -32))) for _ in range(6)]
    visits = [(v, int(v % 6), *spots[v % 6], at(rng.integers(-60, 700))) for v in range(40)] + [(99, 0, *spots[0], None)]
    p = spark.createDataFrame(pixels, "granule_id int, scanline int, ground_pixel int, lon double, lat double, ts timestamp_ntz, value double")
    v = spark.createDataFrame(visits, "visit int, station int, lon double, lat double, ts timestamp_ntz")
    got = {(r.visit, r.granule_id): (r.scanline, r.ground_pixel, r.value) for r in geo.collocate_swath(v, p, 40.0, 45.0).collect()}
    want = {}
    for visit, _, x, y, t in visits:
        for g, s, q, lon, lat, ts, value in pixels:
            if t is None or ts is None or lon is None or lon != lon:
                continue
            d, off = float(km_by_hand((x, y), (lon, lat))), abs((ts - t).total_seconds()) / 60
            if d <= 40 and off <= 45:
                want[visit, g] = min(want.get((visit, g), (9e9,)), (d, off, s, q, value))
    assert want and got == {k: w[2:] for k, w in want.items()}


def small_panel(rng, stations=14, days=5, missing=0.3):
    rows, spots = [], [(-70 + float(rng.uniform(0, 3)), -33 + float(rng.uniform(0, 3))) for _ in range(stations)]
    for day in range(days):
        for s in range(stations):
            if rng.uniform() > missing:
                rows.append((["p", "q"][s % 7 == day % 7], s, np.datetime64(f"2020-01-3{day % 2}").item() if day < 2 else np.datetime64(f"2020-02-0{day}").item(), *spots[s], float(rng.normal(500 + s, 3)), float(rng.normal()), float(rng.normal())))
    return rows, spots


PANEL = "pollutant string, station int, day date, lon double, lat double, value double, f double, g double"


@pytest.mark.parametrize("block", [3, 512])
def test_pair_sums_by_hand(spark, block):
    """With gaps, two months and blocks of a few stations."""
    rows, spots = small_panel(RNG(7))
    got = {(r.pollutant, r.station, r.bin): (r.h, r.n) for r in network.pair_sums(spark.createDataFrame(rows, PANEL), 60.0, 250.0, ("pollutant", "day"), block=block).collect()}
    want = {}
    for a in rows:
        for b in rows:
            d = km_by_hand(spots[a[1]], spots[b[1]])
            if a[0] == b[0] and a[2] == b[2] and a[1] != b[1] and d <= 250:
                h, n = want.get((a[0], a[1], int(d // 60)), (0.0, 0))
                want[a[0], a[1], int(d // 60)] = (h + 0.5 * (a[5] - b[5]) ** 2, n + 1)
    assert set(got) == set(want)
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], rel=1e-8, abs=1e-8) for k in want)
    bins = {(r.pollutant, r.distance_bin): r for r in aggregate.semivariogram(spark.createDataFrame(rows, PANEL), 60.0, 250.0, ("pollutant", "day")).collect()}
    for (p, b), r in bins.items():
        ends = [w for (q, _, c), w in want.items() if (q, c) == (p, b)]
        assert r.n_pairs == sum(n for _, n in ends) / 2 and r.gamma == pytest.approx(sum(h for h, _ in ends) / sum(n for _, n in ends))
    assert network.pair_sums(spark.createDataFrame(rows, PANEL).limit(0), 60.0, 250.0, ("pollutant", "day")).count() == 0


def test_blocks_of_pairs_are_bounded(monkeypatch):
    """What is formed at a time doesn't grow with the stations of a side; a tile of two sides forms each pair once."""
    rng, monkey = RNG(43), monkeypatch.setattr
    monkey(network, "CELLS", 400)
    made = []
    for low in (0, 100):
        s = np.repeat(np.arange(low, low + 100), 3)
        pdf = pd.DataFrame({"pollutant": "p", "day": np.tile([1, 2, 3], 100), "station": s, "lon": s * 0.01, "lat": s % 7 * 0.1, "value": rng.normal(size=300)})
        made.append(network.Side(pdf, ("pollutant", "day"), ["value"]))
    blocks = list(network._half_squares(network.Tile(*made, False), 100.0, 1e5, 1001, 512))
    assert max(h.size for *_, h, _ in blocks) <= 400 and sum(n.sum() for *_, n in blocks) == 3 * 100 * 100


def test_tiles_give_the_same_sums_and_fits(spark):
    """Networks dealt into many sides: no task holds more than two of them, and the results are those of one side."""
    rows, _ = small_panel(RNG(17), stations=40)
    df, keys = spark.createDataFrame(rows, PANEL), ("pollutant", "day")
    for side in (7, 16):
        for made in (network.pair_sums, network.pair_totals):
            one, many = ({tuple(r)[:-2]: tuple(r)[-2:] for r in made(df, 60.0, 250.0, keys, block=4, side=s).collect()} for s in (None, side))
            assert set(one) == set(many) and all(many[k] == pytest.approx(one[k], rel=1e-8, abs=1e-8) for k in one)
        one, many = ({(r.target, r.pollutant, r.day): (r.n, r.obs, r.pred) for r in network.local_fits(df, ["f"], [150.0], keys, block=4, side=s).collect()} for s in (None, side))
        assert set(one) == set(many) and all(many[k] == pytest.approx(one[k], rel=1e-8) for k in one)
    seen = []
    for r in network.tiles(df.select(*keys, "station", "lon", "lat", "value"), keys, "month", ["value"], lambda t: pd.DataFrame({"l": [len(t.left.stations)], "r": [len(t.right.stations)]}), "l long, r long", side=7).collect():
        seen.append(max(r.l, r.r))
    assert len(seen) > 30 and max(seen) < 20


@pytest.mark.parametrize("block", [4, 512])
def test_local_fits_are_weighted_least_squares(spark, block):
    rows, spots = small_panel(RNG(9), days=4)
    got = {(r.pollutant, r.target, r.day): r for r in network.local_fits(spark.createDataFrame(rows, PANEL), ["f", "g"], [150.0], ("pollutant", "day"), block=block).collect()}
    seen = 0
    for p, s, day, _, _, y, f, g in rows:
        others = [r for r in rows if r[0] == p and r[2] == day and r[1] != s]
        w = np.array([np.exp(-0.5 * (km_by_hand(spots[s], spots[r[1]]) / 150.0) ** 2) for r in others])
        others, w = [r for r, k in zip(others, w) if k >= 1e-12], w[w >= 1e-12]
        if len(others) <= 3:
            assert (p, s, day) not in got
            continue
        x = np.array([[1.0, r[6], r[7]] for r in others])
        beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], np.array([r[5] for r in others]) * np.sqrt(w), rcond=None)[0]
        r = got[p, s, day]
        assert r.n == len(others) and r.obs == y
        if np.linalg.cond(x * np.sqrt(w)[:, None]) < 50:  # the ridge shows in others
            assert r.pred == pytest.approx(float(beta @ [1.0, f, g]), rel=1e-4)
            seen += 1
    assert seen > 10 and len(got) <= len(rows)


def kriging_inputs(spark):
    rng = RNG(11)
    rows = [(["p", "q"][h % 2], i, h, -70 + float(x), -33 + float(y), float(5 * np.sin(i) + h)) for i, (x, y) in enumerate(rng.uniform(0, 3, (10, 2))) for h in range(3) if (i + h) % 4]
    values = spark.createDataFrame(rows, "pollutant string, station int, hour int, lon double, lat double, value double")
    models = spark.createDataFrame([("p", 0.2, 3.0, 90.0), ("q", 0.0, 5.0, 200.0)], "pollutant string, nugget double, sill double, reach double")
    edges = edges_of(spark, {1: [[(-69.9, -32.9), (-69.0, -32.7), (-69.2, -32.0), (-69.8, -32.1)]], 2: [[(-68.5, -31.5), (-67.9, -31.5), (-67.9, -30.9), (-68.5, -30.9)]], 3: [[(-68.01, -31.71), (-68.02, -31.72), (-68.03, -31.71)]]})
    return values, values.select("station", "lon", "lat").distinct(), models, geo.block_points(edges, 0.2).withColumnRenamed("comuna", "target")


def test_block_kriging_is_the_mean_over_its_points(spark):
    values, stations, models, points = kriging_inputs(spark)
    points = points.cache()
    centers = points.groupBy("target").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    near = geo.nearest(centers, stations, 5).withColumnRenamed("station", "source")
    keys = ("pollutant", "hour")
    blocks = {(r.target, r.pollutant, r.hour): r for r in engines.krige_blocks(values, near, stations, points, models, keys).collect()}
    single = points.withColumn("point", F.monotonically_increasing_id()).cache()
    each = near.select("target", "source").join(single.select("target", "point", F.col("lon").alias("px"), F.col("lat").alias("py")), "target")
    each = each.join(stations.withColumnRenamed("station", "source"), "source").withColumn("km", network_km())
    by_point = engines.krige(values, each.select(F.col("point").alias("target"), "source", "km"), stations, models, keys)
    of = {r.point: r.target for r in single.collect()}
    preds = {}
    for r in by_point.collect():
        preds.setdefault((of[r.target], r.pollutant, r.hour), []).append((r.pred, r.variance))
    assert set(blocks) == set(preds) and {k[0] for k in blocks} == {1, 2, 3}
    for k, r in blocks.items():
        p, v = np.array(preds[k]).T
        assert r.pred == pytest.approx(p.mean(), rel=1e-7) and r.weights == pytest.approx(1.0, abs=1e-8)
        assert r.variance < v.mean() - 1e-9 if len(p) > 1 else r.variance == pytest.approx(v[0])


def network_km():
    from aerostrata.functions.scalar import haversine_km

    return haversine_km(F.col("px"), F.col("py"), F.col("lon"), F.col("lat"))


def test_points_of_blocks(spark):
    rng = RNG(12)
    polygons = {k: [star(rng, -70 + k, -33, 0.9)] for k in range(3)} | {7: [[(-60.01, -33.01), (-60.02, -33.02), (-60.03, -33.01)]]}
    got = geo.block_points(edges_of(spark, polygons), 0.25).collect()
    assert [(round(r.lon, 9), round(r.lat, 9)) for r in got if r.comuna == 7] == [(-60.02, -33.013333333)]
    assert all((r.lon / 0.25).is_integer() and (r.lat / 0.25).is_integer() for r in got if r.comuna != 7)
    for k in range(3):
        area = clipped_area(polygons[k][0], -90, -50, -60, -10) / 0.0625
        assert abs(sum(r.comuna == k for r in got) - area) < 0.5 * area + 4


def test_the_best_engine_that_has_an_estimate(spark):
    oof = spark.createDataFrame(
        [("p", 1, "a", 1.0, 2.0), ("p", 1, "b", 1.0, 1.1), ("p", 2, "a", 1.0, 1.0), ("p", 2, "b", 1.0, None), ("q", 1, "a", 5.0, 5.5), ("q", 1, "b", 5.0, 9.0), ("r", 1, "b", 1.0, 2.0), ("r", 1, "a", 1.0, 0.0)],
        "pollutant string, station int, engine string, obs double, pred double",
    )
    choice = panel.choose_engines(oof, ["pollutant", "station"])
    assert {(r.pollutant, r.engine, r["rank"], r.n) for r in choice.collect()} == {("p", "b", 1, 1), ("p", "a", 2, 1), ("q", "a", 1, 1), ("q", "b", 2, 1), ("r", "a", 1, 1), ("r", "b", 2, 1)}
    assert {(r.engine, r.n) for r in panel.choose_engines(oof).where("pollutant = 'p'").collect()} == {("a", 2), ("b", 1)}
    spine = spark.createDataFrame([(p, h) for p in ("p", "q", "s") for h in range(3)] + [(None, 0)], "pollutant string, hour int")
    made = {
        "a": spark.createDataFrame([("p", 0, 1.0), ("p", 1, 2.0), ("q", 0, float("nan")), ("s", 0, 8.0)], "pollutant string, hour int, estimate double"),
        "b": spark.createDataFrame([("p", 1, 20.0), ("p", 2, None), ("q", 0, 30.0)], "pollutant string, hour int, estimate double"),
    }
    means = [("mean", spark.createDataFrame([("p", 0.5), ("q", 0.6), ("s", 0.7)], "pollutant string, mean_value double"), ["pollutant"])]
    got = {(r.pollutant, r.hour): (r.engine, r.estimate) for r in panel.surface_of_engines(spine, made, choice, means, ["pollutant", "hour"]).collect()}
    want = {("p", 0): ("a", 1.0), ("p", 1): ("b", 20.0), ("p", 2): ("mean", 0.5), ("q", 0): ("b", 30.0), ("q", 1): ("mean", 0.6), ("q", 2): ("mean", 0.6), (None, 0): (None, None)}
    assert got == want | {("s", h): ("mean", 0.7) for h in range(3)}


def test_predictions_are_read_once(spark):
    """Scores on shared rows come from one pass over the predictions, whatever made them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def predict(x):
        seen.add(1)
        return x

    rows = [("p", s, e, 1.0, float(s + k)) for s in range(50) for k, e in enumerate("abc") if e != "c" or s % 5] + [("q", 1, "a", 1.0, 2.0), (None, 1, "a", 1.0, 2.0)]
    oof = spark.createDataFrame(rows, "pollutant string, station int, engine string, obs double, pred double").withColumn("pred", predict("pred"))
    got = {(r.pollutant, r.engine): (r["rank"], r.n, r.rmse) for r in panel.choose_engines(oof, ["pollutant", "station"]).collect()}
    shared = [s for s in range(50) if s % 5]
    want = {("p", e): (k + 1, 40, pytest.approx(np.sqrt(np.mean([(s + k - 1) ** 2 for s in shared])))) for k, e in enumerate("abc")}
    assert got == want | {("q", "a"): (1, 1, pytest.approx(1.0))}
    assert seen.value <= 2 * len(rows)  # a filter on the column evaluates it once more; three passes would be six times


def test_many_variograms_are_those_of_single_fits():
    """Together, with gaps, two bins and one bin, against least squares range by range."""
    rng = RNG(41)
    d = (np.arange(9) + 0.5) * 40
    g, w = np.abs(rng.normal(30, 9, (60, 9))) + d / 9, rng.integers(0, 50, (60, 9)).astype(float)
    w[:, 0] += 1
    w[5, 1:], w[6, 2:], w[6, 1] = 0, 0, 7
    made = engines.fit_exponentials(d, g, w)
    for i in range(60):
        at, found = w[i] > 0, []
        for rng_km in np.linspace(d[at].max() / 20, d[at].max() * 2, 60):
            m, sw = np.stack([np.ones(at.sum()), 1 - np.exp(-d[at] / rng_km)], axis=1), np.sqrt(w[i, at])
            c = np.maximum(np.linalg.lstsq(m * sw[:, None], g[i, at] * sw, rcond=None)[0], 0)
            found.append(((w[i, at] * (m @ c - g[i, at]) ** 2).sum(), c[0], max(c[1], 1e-9), rng_km))
        least = min(f[0] for f in found)
        best = next(f for f in found if f[0] <= least + 1e-12 * (w[i, at] * g[i, at] ** 2).sum())
        assert tuple(made[i]) == pytest.approx(best[1:], rel=1e-6)


def test_kriging_systems_are_solved_together():
    """Systems of any scale against least squares one by one; two sources at one place share their weight."""
    rng = RNG(42)
    for n in (1, 2, 5):
        lon, lat = -70 + rng.uniform(0, 2, (40, n)), -33 + rng.uniform(0, 2, (40, n))
        if n > 1:
            lon[3, 1], lat[3, 1] = lon[3, 0], lat[3, 0]
        g0 = rng.uniform(1, 5, (40, n))
        model = np.stack([rng.uniform(0, 1, 40), 10.0 ** rng.uniform(-9, 3, 40), rng.uniform(50, 400, 40), rng.uniform(0, 1, 40)], axis=1)
        w, variance = engines._weights(lon, lat, g0, model)
        for i in range(40):
            x, y = np.radians(lon[i]), np.radians(lat[i])
            km = network.great_circle(x[:, None], y[:, None], x[None], y[None])
            m = np.ones((n + 1, n + 1))
            m[:n, :n], m[n, n] = np.where(km > 0, model[i, 0] + model[i, 1] * (1 - np.exp(-km / model[i, 2])), 0.0), 0
            b = np.append(g0[i], 1.0)
            want = np.linalg.lstsq(m, b, rcond=None)[0]
            assert w[i] == pytest.approx(want[:n], rel=1e-6, abs=1e-8) and variance[i] == pytest.approx(want @ b - model[i, 3], rel=1e-6, abs=1e-8)
        assert n == 1 or w[3, 0] == pytest.approx(w[3, 1])


def test_surface_of_all_engines_has_no_gap(spark):
    from aerostrata.plans.surface_queries import surface_engines

    made = surface_engines(spark, "/root/testdata/sf0.001").cache()
    shape = fixture(spark, "/root/testdata/sf0.001", "v_panel").agg(F.count_distinct("pollutant") * F.count_distinct("comuna") * F.count_distinct("day")).first()[0]
    assert made.count() == made.select("pollutant", "comuna", "day").distinct().count() == shape
    assert made.where("estimate is null").count() == 0
    tags = {r.engine for r in made.select("engine").distinct().collect()}
    assert tags <= {"gwr", "kriging", "gbt", "day mean", "mean"} and tags & {"kriging", "gbt"}


def test_kriging_deals_targets_into_groups(spark, monkeypatch):
    """Targets that share a group don't share weights, and calls to a group don't grow with targets."""
    rng = RNG(23)
    spots = {i: (-70 + float(x), -33 + float(y)) for i, (x, y) in enumerate(rng.uniform(0, 3, (12, 2)))}
    values = spark.createDataFrame([(i, h, *spots[i], float(i * h)) for i in spots for h in range(4) if (i + h) % 5], "station int, hour int, lon double, lat double, value double")
    places = values.select("station", "lon", "lat").distinct()
    near = geo.nearest(places.withColumnRenamed("station", "target"), places, 4).where("target <> station").withColumnRenamed("station", "source")
    made = []
    for groups in (1, 4_096):
        monkeypatch.setattr(engines, "DEALT", groups)
        made.append({(r.target, r.hour): tuple(r)[2:] for r in engines.krige(values, near, places, (0.5, 3.0, 90.0)).collect()})
    assert set(made[0]) == set(made[1]) and len(made[0]) > 40
    assert all(made[0][k] == pytest.approx(made[1][k], abs=1e-9) for k in made[0])


def test_kriged_rows_are_spread_over_tasks(spark):
    """However few bytes the rows have, a task sorts those of few targets."""
    rng = RNG(24)
    places = spark.createDataFrame([(i, -70 + float(x), -33 + float(y)) for i, (x, y) in enumerate(rng.uniform(0, 3, (12, 2)))], "station int, lon double, lat double")
    near = geo.nearest(places.withColumnRenamed("station", "target"), places, 4).where("target <> station").withColumnRenamed("station", "source")
    rows = engines.krige(places.selectExpr("station", "1 hour", "lon value"), near, places, (0.5, 3.0, 90.0)).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 12 and len({r.task for r in rows}) > 8


def joined_rows(df):
    """Rows that the joins of a finished query made."""

    def nodes(plan):
        yield plan
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            yield from nodes(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            yield from nodes(plan.plan())
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    return sum(p.metrics().apply("numOutputRows").value() for p in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName())


def test_swath_crowds_do_not_multiply(spark):
    """Many visits of a station on the day that a granule has many pixels near it: each visit gets the nearest, ties by scanline and pixel."""
    pixels = spark.range(2000).selectExpr("1L granule_id", "id % 50 scanline", "id div 50 ground_pixel", "-70d + (id % 7) * 0.01 lon", "-33d lat", "timestamp_ntz '2020-01-02 00:00:00' ts", "cast(id as double) value")
    visits = spark.range(2000).selectExpr("id visit", "0L station", "-70d lon", "-33d lat", "timestamp_ntz '2020-01-02 06:00:00' ts")
    found = geo.collocate_swath(visits, pixels, 60.0, 1440.0)
    rows = found.collect()
    # the nearest pixels are those with id % 7 = 0, the first of them by scanline and pixel is id 0
    assert len(rows) == 2000 and {(r.scanline, r.ground_pixel, r.km, r.minutes, r.value) for r in rows} == {(0, 0, 0.0, 360.0, 0.0)}
    assert 2_000 <= joined_rows(found) < 20_000  # not 4,000,000


def test_boxes_give_the_fits_of_all_pairs(spark, monkeypatch):
    """Crowds, lone stations, the date line and a pole: sums over boxes are those over tiles, the numbers within reach are equal."""
    rng = RNG(31)
    spots = [*np.c_[rng.uniform(-75, -60, 500), rng.uniform(-40, -20, 500)], *np.c_[rng.normal(180, 2, 120) % 360 - 180, rng.normal(3, 2, 120)], *np.c_[rng.uniform(-180, 180, 120), rng.uniform(86, 90, 120)]]
    spots = [tuple(map(float, p)) for p in spots] + [(-50.0, -60.0), (0.0, 90.0)]
    days = [np.datetime64("2020-01-30").item(), np.datetime64("2020-01-31").item(), np.datetime64("2020-02-01").item()]
    rows = [(p, s, d, *spots[s], float(rng.normal(50, 3)), float(rng.normal(9, 2)), float(rng.normal())) for s in range(len(spots)) for d in days for p in ("p", "q") if rng.uniform() < 0.7]
    df, keys = spark.createDataFrame(rows, PANEL), ("pollutant", "day")
    made = []
    for many in (10**9, 0):
        monkeypatch.setattr(network, "MANY", many)
        monkeypatch.setattr(network, "FILLED", 0)
        made.append({(r.bandwidth, r.target, r.pollutant, r.day): (r.n, r.obs, r.pred, *r.beta) for r in network.local_fits(df, ["f"], [150.0, 400.0], keys).collect()})
    assert len(made[0]) > 4_000 and set(made[0]) == set(made[1])
    assert all(made[1][k][0] == made[0][k][0] and made[1][k][1:] == pytest.approx(made[0][k][1:], rel=1e-6, abs=1e-6) for k in made[0])
    monkeypatch.setattr(boxes, "PART", 40)
    parted = {(r.target, r.pollutant, r.day): (r.n, r.pred) for r in network.local_fits(df, ["f", "g"], [400.0], keys).collect()}
    monkeypatch.setattr(network, "MANY", 10**9)
    for r in network.local_fits(df, ["f", "g"], [400.0], keys).collect():
        assert parted[r.target, r.pollutant, r.day] == (r.n, pytest.approx(r.pred, rel=1e-6))
