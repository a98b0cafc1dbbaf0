"""What the stations of a network have in common, as matrix products over a period of keys.

Stations are dealt into sides by their hash. A task gets two sides of one period (a month, or a day of a large network), packed into two
rows, and works on a tile: stations by stations in blocks, and stations by keys with gaps counted out. Distances and kernels are formed
once a tile for all keys and pollutants of the period, and only between the latitudes within reach. What a task holds is
bounded by the side, not by the network; no table has a row a pair. A row is sent once for each tile of its side. The work is
that of all pairs. Stations stand still; repeated rows of a station and key count by their mean.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from aerostrata.functions.scalar import EARTH_KM

#: Weight of the Gaussian kernel below which a station counts as out of reach.
NO_WEIGHT = 1e-12
#: Stations of a side at most, sides of a large network at least (for the sake of tasks), and stations from which on a side is parted for that.
SIDE, SIDES, FEW = 16_384, 6, 1_024
#: Sides of a large network at least where every unordered pair of them is a tile; pairs of a block of these, about (a core's cache holds their numbers).
PAIR_SIDES, CELLS = 10, 1 << 20
#: Stations from which on regressions go by boxes, stations of a box for that on average, and stations of a box and key below which its fits go by tiles.
MANY, FILLED, SPARSE = 32_768, 160, 32


def keep(df: DataFrame) -> DataFrame:
    """A table that is read several times, persisted in two partitions a core, so that its readers have no more tasks than that."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)


def by_period(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Rows with the period of their last key. A last key that isn't a time is a period by itself."""
    time = keys[-1]
    timed = dict(df.dtypes)[time].startswith(("timestamp", "date"))
    return df.withColumn("_period", F.date_trunc(period, F.col(time).cast("timestamp")) if timed else F.col(time).cast("string"))


def kinds(df: DataFrame, **more: str) -> str:
    """DDL of columns of a table, and more."""
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"`{c}` {t}" for c, t in more.items()]])


class Side:
    """Some stations' rows of a period: places in order of latitude, series (values of the keys but the last), times, columns."""

    def __init__(self, pdf: pd.DataFrame, keys: Sequence[str], columns: Sequence[str]):
        if pdf.duplicated(["station", *keys]).any():
            pdf = pdf.groupby(["station", *keys], as_index=False, sort=False).agg({"lon": "first", "lat": "first", **dict.fromkeys(columns, "mean")})
        pdf = pdf.sort_values(["lat", "station"], kind="stable")
        s, stations = pd.factorize(pdf["station"])
        t, self.times = pd.factorize(pdf[keys[-1]])
        series = pdf.groupby(list(keys[:-1]), sort=False).ngroup().to_numpy() if len(keys) > 1 else np.zeros(len(pdf), np.int64)
        first = np.unique(series, return_index=True)[1]
        self.series = [tuple(pdf[k].iloc[at] for k in keys[:-1]) for at in first]
        self.stations = np.asarray(stations)
        place = np.unique(s, return_index=True)[1]
        self.lon, self.lat = (np.radians(pdf[c].to_numpy(float)[place]) for c in ("lon", "lat"))
        self.s, self.t, self.g = s.astype(np.int32), t.astype(np.int32), series.astype(np.int32)
        self.values = pdf[list(columns)].to_numpy(float)

    def points(self) -> np.ndarray:
        """Places on the unit sphere: (3, stations)."""
        return np.stack([np.cos(self.lat) * np.cos(self.lon), np.cos(self.lat) * np.sin(self.lon), np.sin(self.lat)])

    def matrices(self, series: tuple, times: pd.Index) -> tuple[np.ndarray, np.ndarray] | None:
        """Of a series: whether a station has a row at a time, and its values (stations, times, columns)."""
        if series not in self.series:
            return None
        of = self.g == self.series.index(series)
        s, t = self.s[of], times.get_indexer(pd.Index(self.times))[self.t[of]]
        s, t, values = s[t >= 0], t[t >= 0], self.values[of][t >= 0]
        mask, held = np.zeros((len(self.stations), len(times))), np.zeros((len(self.stations), len(times), values.shape[1]))
        mask[s, t], held[s, t] = 1.0, values
        return mask, held


class Tile:
    """Two sides of a period, and what they share."""

    def __init__(self, left: Side, right: Side, same: bool):
        self.left, self.right, self.same = left, right, same
        self.twin = np.arange(len(left.stations)) if same else pd.Index(right.stations).get_indexer(left.stations)  # where a station is on the right
        found = pd.Index(left.times).intersection(pd.Index(right.times))
        self.times = found.sort_values()
        self.series = [x for x in left.series if x in right.series]

    def blocks(self, block: int, max_km: float) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
        """Some stations of the left side at a time: which, the right side's within reach by latitude, the distances, which are others."""
        p, q, reach = self.left.points(), self.right.points(), max_km / EARTH_KM + 1e-9
        for k in range(0, len(self.left.stations), block):
            at = slice(k, min(len(self.left.stations), k + block))
            low, high = np.searchsorted(self.right.lat, [self.left.lat[at][0] - reach, self.left.lat[at][-1] + reach], side="left")
            if low == high:
                continue
            to = slice(int(low), int(high))
            h = np.zeros((at.stop - k, to.stop - to.start))
            for a, b in zip(p, q, strict=True):
                d = a[at, None] - b[None, to]
                d *= d
                h += d
            np.sqrt(h, out=h)
            h *= 0.5
            np.minimum(h, 1.0, out=h)
            np.arcsin(h, out=h)
            h *= 2 * EARTH_KM
            other = self.twin[at, None] != np.arange(to.start, to.stop)[None]
            yield at, to, h, other


def great_circle(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Kilometres between places in radians."""
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))


def tiles(rows: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str], work: Callable[[Tile], pd.DataFrame], schema: str, half: bool = False, side: int | None = None, left: DataFrame | None = None, least: int = SIDES) -> DataFrame:
    """What `work` makes of the tiles of all periods: every ordered pair of sides, or with `half` every unordered one. With `left`, rows
    of some stations, the left sides are made of these alone, so that all others are sent once for each of few sides."""

    def deal(df: DataFrame) -> tuple[DataFrame, int]:
        n = df.select("station").distinct().count()
        sides = max(1, -(-n // (side or SIDE)), min(least, -(-n // FEW)))
        return by_period(df, keys, period).withColumn("_side", F.pmod(F.xxhash64("station"), F.lit(sides)).cast("int")), sides

    dealt, sides = deal(rows)
    names = list(keys)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_period": [pdf["_period"].iloc[0]], "_side": [pdf["_side"].iloc[0]], "_rows": [pickle.dumps(Side(pdf, names, columns), protocol=5)]})

    shape = f"_period {dict(dealt.dtypes)['_period']}, _side int, _rows binary"
    packed = dealt.groupBy("_period", "_side").applyInPandas(lambda pdf: pack(pdf), shape)
    if left is not None:
        chosen, lefts = deal(left)
        chosen = chosen.groupBy("_period", "_side").applyInPandas(lambda pdf: pack(pdf), shape)
        ends = [chosen.select("_period", F.lit(True).alias("_left"), "_rows", F.col("_side").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("j"))]
        ends += [packed.select("_period", F.lit(False).alias("_left"), "_rows", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))).alias("i"), F.col("_side").alias("j"))]

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            held = {bool(x): pickle.loads(r) for x, r in zip(pdf["_left"], pdf["_rows"], strict=True)}
            return work(Tile(held[True], held[False], False)) if len(held) == 2 else pd.DataFrame()

        return ends[0].unionByName(ends[1]).repartition(sides * lefts, "_period", "i", "j").groupBy("_period", "i", "j").applyInPandas(lambda pdf: meet(pdf), schema)
    mine, all_sides = F.col("_side"), F.sequence(F.lit(0), F.lit(sides - 1))
    as_left = F.transform(all_sides, lambda j: F.struct(mine.alias("i"), j.alias("j")))
    as_right = F.transform(all_sides, lambda i: F.struct(i.alias("i"), mine.alias("j")))
    wanted = F.array_distinct(F.concat(as_left, as_right))
    if half:
        wanted = F.filter(wanted, lambda t: t["i"] <= t["j"])
    sent = packed.select("_period", "_side", "_rows", F.explode(wanted).alias("_t")).select("_period", "_side", "_rows", "_t.i", "_t.j")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        held = {int(s): pickle.loads(r) for s, r in zip(pdf["_side"], pdf["_rows"], strict=True)}
        if i not in held or j not in held:
            return pd.DataFrame()
        return work(Tile(held[i], held[j], i == j))

    # a tile is much work for few bytes, so one has a task of its own, among so many that few share one by their hash
    number = sides * (sides + 1) // 2 if half else sides * sides
    return sent.repartition(max(number, min(8 * number, 2_000)), "_period", "i", "j").groupBy("_period", "i", "j").applyInPandas(lambda pdf: tile(pdf), schema)


def _pair_rows(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return obs.select(*keys, "station", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("value").cast("double").alias("value")).dropna()


def _half_squares(tile: Tile, bin_km: float, max_km: float, bins: int, block: int) -> Iterator[tuple[slice, slice, tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """By block of a tile and series: which stations of both sides, the series, bins of their pairs (`bins` where there is none), half squared
    differences, numbers. Bins are the same array for all series of a block."""
    factors = []
    for series in tile.series:
        (m, z), (mr, zr) = tile.left.matrices(series, tile.times), tile.right.matrices(series, tile.times)
        z, zr = z[:, :, 0], zr[:, :, 0]
        mean = (z.sum() + zr.sum()) / max(m.sum() + mr.sum(), 1)  # differences stay, squares get small
        z, zr = np.where(m > 0, z - mean, 0.0), np.where(mr > 0, zr - mean, 0.0)
        factors.append((series, m, z, np.concatenate([mr, 0.5 * zr**2, zr], axis=1)))
    for at, to, km, other in tile.blocks(max(1, min(block, CELLS // len(tile.right.stations))), max_km):
        cell = np.where(other & (km <= max_km), km / bin_km, bins).astype(np.int64)
        for series, m, z, right in factors:
            h = np.concatenate([0.5 * z[at] ** 2, m[at], -z[at]], axis=1) @ right[to].T
            yield at, to, series, cell, np.maximum(h, 0.0, out=h), m[at] @ right[to, : m.shape[1]].T


def pair_arrays(obs: DataFrame, bin_km: float, max_km: float, keys: Sequence[str], period: str = "month", block: int = 512, side: int | None = None) -> DataFrame:
    """(first key, station, h, n): what `pair_sums` has, as arrays by bin, of the stations that have a pair.

    A tile of two sides gives the sums of both, so every pair is formed once, and what leaves it is a row a station and first key."""
    rows = _pair_rows(obs, keys)
    name, bins = keys[0], int(max_km // bin_km) + 1
    columns = [[f"{c}{i}" for i in range(bins)] for c in "hn"]

    def sums(tile: Tile) -> pd.DataFrame:
        ends = [tile.left] if tile.same else [tile.left, tile.right]
        total = {x[0]: [np.zeros((2, len(e.stations), bins + 1)) for e in ends] for x in tile.series}
        last = None
        for at, to, series, cell, *found in _half_squares(tile, bin_km, max_km, bins, block):
            if cell is not last:
                last, shape = cell, cell.shape
                spots = [(cell + np.arange(shape[0])[:, None] * (bins + 1)).ravel(), None if tile.same else (cell + np.arange(shape[1])[None] * (bins + 1)).ravel()]
            for out, of, spot, size in zip(total[series[0]], (at, to), spots, shape, strict=False):
                for k, x in enumerate(found):
                    out[k, of] += np.bincount(spot, weights=x.ravel(), minlength=size * (bins + 1)).reshape(size, bins + 1)
        parts = []
        for value, outs in total.items():
            for end, out in zip(ends, outs, strict=True):
                h, n = out[0, :, :bins], out[1, :, :bins].round().astype(np.int64)
                some = np.flatnonzero(n.any(axis=1))
                made = {name: [value] * len(some), "station": end.stations[some]}
                parts.append(pd.DataFrame(made | {c: x[some, i] for cs, x in zip(columns, (h, n), strict=True) for i, c in enumerate(cs)}))
        return pd.concat(parts) if parts else pd.DataFrame()

    types = dict.fromkeys(columns[0], "double") | dict.fromkeys(columns[1], "long")
    part = tiles(rows, keys, period, ["value"], sums, kinds(rows.select(name, "station"), **types), half=True, side=side or 2 * SIDE, least=PAIR_SIDES)
    added = part.groupBy(name, "station").agg(*[F.sum(c).alias(c) for c in types])
    return added.select(name, "station", *[F.array(*cs).alias(c) for c, cs in zip("hn", columns, strict=True)])


def pair_sums(obs: DataFrame, bin_km: float, max_km: float, keys: Sequence[str], period: str = "month", block: int = 512, side: int | None = None) -> DataFrame:
    """(first key, station, bin, h, n): over all keys, half the squared differences of a station to the others that report at the
    same key, summed by bin of distance, and their number. A pair counts at both of its stations."""
    arrays = pair_arrays(obs, bin_km, max_km, keys, period, block, side)
    rows = arrays.select(keys[0], "station", F.posexplode(F.arrays_zip("h", "n")).alias("bin", "_x"))
    return rows.select(keys[0], "station", F.col("bin").cast("long").alias("bin"), "_x.h", "_x.n").where("n > 0")


def pair_totals(obs: DataFrame, bin_km: float, max_km: float, keys: Sequence[str], period: str = "month", block: int = 512, side: int | None = None) -> DataFrame:
    """(first key, bin, h, n): the sums of `pair_sums` over all stations, every pair once."""
    rows = _pair_rows(obs, keys)
    name, bins = keys[0], int(max_km // bin_km) + 1

    def sums(tile: Tile) -> pd.DataFrame:
        total = {x[0]: np.zeros((2, bins + 1)) for x in tile.series}
        for _, _, series, cell, h, n in _half_squares(tile, bin_km, max_km, bins, block):
            for k, x in enumerate((h, n)):
                total[series[0]][k] += np.bincount(cell.ravel(), weights=x.ravel(), minlength=bins + 1) / (2 if tile.same else 1)
        parts = []
        for value, (h, n) in total.items():
            found = np.flatnonzero(n[:bins] > 0.25)
            parts.append(pd.DataFrame({name: [value] * len(found), "bin": found, "h": h[found], "n": n[found].round().astype(np.int64)}))
        return pd.concat(parts) if parts else pd.DataFrame()

    part = tiles(rows, keys, period, ["value"], sums, kinds(rows.select(name), bin="long", h="double", n="long"), half=True, side=side)
    return part.groupBy(name, "bin").agg(F.sum("h").alias("h"), F.sum("n").alias("n"))


def _boxed(rows: DataFrame, widths: Sequence[float]) -> list[tuple[float, bool, int]]:
    """Of each bandwidth whether its boxes are full enough, and stations of the fullest box."""
    from aerostrata.operators.boxes import Boxes

    stations = rows.groupBy("station").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat")).persist()
    n, low, high = stations.agg(F.count(F.lit(1)), F.min("lat"), F.max("lat")).first()
    found = []
    for width in widths:
        most = boxes = 0
        if n >= MANY and low >= -90 and high <= 90:
            boxes, most = stations.groupBy(Boxes(width).of(F.col("lon"), F.col("lat"))).count().agg(F.count(F.lit(1)), F.max("count")).first()
        found.append((width, bool(boxes) and n >= FILLED * boxes, most or 0))
    stations.unpersist()
    return found


def local_fits(panel: DataFrame, features: Sequence[str], bandwidths: Sequence[float], keys: Sequence[str], y: str = "value", period: str = "month", block: int = 512, side: int | None = None) -> DataFrame:
    """Leave-one-station-out regressions of every station and key on the others, Gaussian in the distance:
    (bandwidth, target, keys, n, beta, obs, pred), beta with the intercept first.

    Of a large network the sums come from boxes (`boxes.kernel_sums`), but for boxes with few stations at a key: a kernel that is small at all
    stations is not known well enough from nodes. All other sums come from tiles.
    A tile gives the normal matrices of its left side's targets over its right side's stations, as one product of weights and products of
    predictors; tiles are added up, then solved. With one predictor they are solved in closed form, and degenerate ones or those of
    fewer than three stations give no row; with more, a small ridge keeps collinear ones solvable, and as many stations as
    coefficients give none.
    """
    from aerostrata.operators.boxes import Boxes, kernel_sums

    columns = [f"_f{i}" for i in range(len(features))]
    numbers = {"lon": "lon", "lat": "lat", **dict(zip(columns, features, strict=True)), "_y": y}
    rows = panel.select(*keys, "station", *[F.col(f).cast("double").alias(c) for c, f in numbers.items()]).dropna()
    p = len(features) + 1
    up = np.triu_indices(p)
    sums = [f"_s{i}" for i in range(len(up[0]) + p)]
    own = [*columns, "_y"]
    widths = [float(b) for b in bandwidths]

    def terms(present: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What is added up of rows (..., predictors and y)."""
        f = np.concatenate([present[..., None], values[..., :-1]], axis=-1)
        return np.concatenate([f[..., up[0]] * f[..., up[1]], f * values[..., -1:]], axis=-1)

    def normal(tile: Tile, widths: Sequence[float]) -> pd.DataFrame:
        known = []
        for series in tile.series:
            (m, own_values), (mr, values) = tile.left.matrices(series, tile.times), tile.right.matrices(series, tile.times)
            made = terms(mr, values)
            known.append((series, m, own_values, mr, made.reshape(len(made), -1)))
        parts = []
        for at, to, km, other in tile.blocks(block, max(widths) * np.sqrt(-2 * np.log(NO_WEIGHT)) * 1.001):
            for width in widths:
                w = np.exp(-0.5 * (km / width) ** 2)
                w[~other | (w < NO_WEIGHT)] = 0.0
                met = (w > 0).astype(float)
                for series, m, own_values, mr, flat in known:
                    n = (met @ mr[to]).round().astype(np.int64)
                    i, t = np.nonzero((m[at] > 0) & (n > 0))
                    if not len(i):
                        continue
                    got = (w @ flat[to]).reshape(*n.shape, -1)[i, t]
                    made = {"bandwidth": width, "target": tile.left.stations[at][i], **dict(zip(keys[:-1], ([v] * len(i) for v in series), strict=True)), keys[-1]: tile.times[t]}
                    made |= {"n": n[i, t]} | dict(zip(sums, got.T, strict=True)) | dict(zip(own, own_values[at][i, t].T, strict=True))
                    parts.append(pd.DataFrame(made))
        return pd.concat(parts) if parts else pd.DataFrame()

    base = ", ".join(["bandwidth double", kinds(rows.select(F.col("station").alias("target"), *keys))])
    schema = ", ".join([base, "n long", *[f"{c} double" for c in [*sums, *own]]])

    def by_tiles(widths: Sequence[float], left: DataFrame | None = None) -> DataFrame:
        part = tiles(rows, keys, period, own, lambda tile: normal(tile, widths), schema, side=side or 2 * SIDE, left=left)
        return part.groupBy("bandwidth", "target", *keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums], *[F.first(c).alias(c) for c in own])

    made, tiled = [], []
    for width, filled, crowd in _boxed(rows, widths):
        if not filled:
            tiled.append(width)
            continue
        grid = Boxes(width)
        placed = by_period(rows, keys, period).withColumn("_box", grid.of(F.col("lon"), F.col("lat")))
        sparse = placed.groupBy("_period", "_box", *keys).agg(F.approx_count_distinct("station").alias("_k")).where(F.col("_k") < SPARSE).drop("_k").persist()
        some = not sparse.isEmpty()
        if some:
            placed = placed.join(sparse.withColumn("_weak", F.lit(1.0)), ["_period", "_box", *keys], "left").withColumn("_weak", F.coalesce("_weak", F.lit(0.0)))
            made.append(by_tiles([width], placed.where("_weak > 0").drop("_period", "_box", "_weak")))
        else:
            sparse.unpersist()
            placed = placed.withColumn("_weak", F.lit(0.0))
        made.append(kernel_sums(placed, grid, keys, own, lambda v: terms(np.ones(v.shape[:-1]), v), len(sums), sums, schema, crowd))
    if tiled:
        made.append(by_tiles(tiled))
    whole = made[0]
    for more in made[1:]:
        whole = whole.unionByName(more)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, got = pdf["n"].to_numpy(), pdf[sums].to_numpy(float)
        a, b = got[:, : len(up[0])], got[:, len(up[0]) :]
        if p == 2:
            sw, sx, sxx, sy, sxy = *a.T, *b.T
            det = sw * sxx - sx * sx
            fine = (n >= 3) & (det > 1e-9 * sw * sxx)
            slope = (sw * sxy - sx * sy)[fine] / det[fine]
            beta = np.stack([(sy[fine] - slope * sx[fine]) / sw[fine], slope], axis=1)
        else:
            fine = n > p
            m = np.zeros((int(fine.sum()), p, p))
            m[:, up[0], up[1]] = a[fine]
            m[:, up[1], up[0]] = a[fine]
            scale = np.maximum(np.trace(m, axis1=1, axis2=2) / p, 1e-12)
            m += 1e-8 * scale[:, None, None] * np.eye(p)
            beta = np.linalg.solve(m, b[fine][:, :, None])[:, :, 0]
        out = pdf[fine]
        f = np.concatenate([np.ones((len(out), 1)), out[columns].to_numpy(float)], axis=1)
        return out[["bandwidth", "target", *keys, "n"]].assign(beta=pd.Series(list(beta), dtype=object, index=out.index), obs=out["_y"], pred=(beta * f).sum(axis=1))

    return whole.mapInPandas(lambda batches: map(solve, batches), f"{base}, n long, beta array<double>, obs double, pred double")
