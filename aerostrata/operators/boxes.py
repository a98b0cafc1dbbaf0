"""Gaussian sums over all stations of a network without a look at every pair.

The kernel is smooth, so between two boxes two bandwidths wide it is known from its values at 18 by 18 Chebyshev nodes of each, to 1e-13. The
rows of a box become moments at its nodes; the moments of all boxes within reach become the sums at the nodes of a box, whose stations
read them off. What is done for a row doesn't depend on how many others there are, what is done between boxes doesn't depend on rows.

The number of stations within reach is exact: a box is parted into cells with centres and radii. Pairs of cells that are wholly within
reach count by their sums, those that are wholly beyond it not at all, and only those across the edge by their stations. For this a box's
places and who reports when (a bit a station and key) are sent to the boxes within reach: 35 bytes a station for 150 keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerostrata.functions.scalar import EARTH_KM
from aerostrata.operators.network import NO_WEIGHT, Side, great_circle

#: Nodes of a box in a direction, stations of a part of a box at most (about), stations of a cell (about).
NODES, PART, CELL = 18, 8_192, 12


class Boxes:
    """Bands of latitude, each in columns as wide as it is high at its end nearer to the equator."""

    def __init__(self, bandwidth: float):
        self.bandwidth, self.reach = bandwidth, float(bandwidth * np.sqrt(-2 * np.log(NO_WEIGHT)))
        self.height = float(min(np.degrees(2 * bandwidth / EARTH_KM), 30.0))
        bands = int(np.ceil(180 / self.height))
        self.low = -90 + self.height * np.arange(bands)
        high = np.minimum(self.low + self.height, 90)
        nearest = np.where(self.low * high <= 0, 0, np.minimum(np.abs(self.low), np.abs(high)))
        wide = np.minimum(self.height / np.maximum(np.cos(np.radians(nearest)), 1e-3), 30)
        self.columns = np.ceil(360 / wide).astype(int)
        k = (np.arange(NODES) + 0.5) * np.pi / NODES
        self.nodes, self.signs = np.cos(k), (-1.0) ** np.arange(NODES) * np.sin(k)

    def of(self, lon: Column, lat: Column) -> Column:
        """Number of a place's box: its band and its column."""
        band = F.least(F.floor((lat + 90) / self.height), F.lit(len(self.low) - 1)).cast("int")
        columns = F.element_at(F.array(*[F.lit(int(c)) for c in self.columns]), band + 1)
        column = F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / (F.lit(360.0) / columns)).cast("int"), columns - 1)
        return band * 1_000 + column

    def bands_near(self, band: int) -> list[int]:
        apart = np.maximum(np.abs(np.arange(len(self.low)) - band) - 1, 0) * self.height
        return [int(b) for b in np.flatnonzero(np.radians(apart) * EARTH_KM <= self.reach + 1)]

    def frame(self, box: int) -> tuple[float, float, float]:
        """West and south end in degrees, and the width."""
        band, column = divmod(int(box), 1_000)
        width = 360 / self.columns[band]
        return -180 + column * width, self.low[band], width

    def places(self, box: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of a box in radians."""
        west, south, width = self.frame(box)
        x, y = west + (self.nodes + 1) / 2 * width, south + (self.nodes + 1) / 2 * self.height
        return np.radians(np.tile(x, NODES)), np.radians(np.repeat(y, NODES))

    def basis(self, box: int, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Values of the nodes' polynomials at places in radians: (places, nodes)."""
        west, south, width = self.frame(box)
        made = []
        for u in (((np.degrees(lat) - south) / self.height) * 2 - 1, (np.mod(np.degrees(lon) - west + 1, 360) - 1) / width * 2 - 1):
            d = u[:, None] - self.nodes[None]
            hit = d == 0
            b = self.signs / np.where(hit, 1.0, d)
            b /= b.sum(axis=1, keepdims=True)
            at = hit.any(axis=1)
            b[at] = hit[at]
            made.append(b)
        return (made[0][:, :, None] * made[1][:, None, :]).reshape(len(lon), -1)

    def gap(self, a: int, b: int) -> float:
        """Kilometres that no two places of two boxes fall below."""
        centres, radii = [], []
        for box in (a, b):
            west, south, width = self.frame(box)
            x, y = np.radians(west + width / 2), np.radians(south + self.height / 2)
            ends = np.radians([south, south + self.height / 2, min(south + self.height, 90.0)])
            centres.append((x, y))
            radii.append(great_circle(x, y, x, ends).max() + EARTH_KM * np.cos(ends).max() * np.radians(width) / 2)
        return float(great_circle(*centres[0], *centres[1]) - sum(radii))


def _cells(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places parted by latitude and then by longitude: an order, where cells start in it, their centres and radii."""
    rows = max(1, int(round(np.sqrt(len(lon) / CELL))))
    row = np.empty(len(lon), np.int64)
    row[np.argsort(lat, kind="stable")] = np.arange(len(lon)) * rows // len(lon)
    order = np.lexsort((lon, row))
    size = np.bincount(row, minlength=rows)
    place = np.arange(len(lon)) - np.repeat(np.cumsum(size) - size, size)
    cell = row[order] * rows + place * rows // np.maximum(np.repeat(size, size), 1)
    start = np.flatnonzero(np.diff(cell, prepend=-1))
    n = np.diff(np.append(start, len(lon)))
    x, y = (np.add.reduceat(v[order], start) / n for v in (lon, lat))
    radius = np.maximum.reduceat(great_circle(lon[order], lat[order], np.repeat(x, n), np.repeat(y, n)), start)
    return order, start, x, y, radius


def _keys(side: Side) -> list[tuple]:
    return [(*series, t) for series in side.series for t in side.times]


def _presence(side: Side) -> np.ndarray:
    """Which stations report at which of `_keys`."""
    held = np.zeros((len(side.stations), len(side.series) * len(side.times)), np.uint8)
    held[side.s, side.g.astype(np.int64) * len(side.times) + side.t] = 1
    return held


def kernel_sums(rows: DataFrame, boxes: Boxes, keys: Sequence[str], columns: Sequence[str], terms, n_terms: int, sums: Sequence[str], schema: str, crowd: int) -> DataFrame:
    """(bandwidth, target, keys, n, sums, columns) of every row, over the other stations of its key, from rows
    (_period, _box, _weak, station, lon, lat, keys, columns). `terms` makes what is added up from (rows, columns). Rows with _weak get none, but count
    for others. `crowd`: stations of the fullest box."""
    names, kinds = list(keys), dict(rows.dtypes)
    parts = -(-crowd // PART)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("station"), F.lit(parts)).cast("int"))
    grouped = dealt.groupBy("_period", "_box", "_part")
    period = f"_period {kinds['_period']}"

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        box, side = int(pdf["_box"].iloc[0]), Side(pdf, names, columns)
        basis, made = boxes.basis(box, side.lon, side.lat), []
        for g, series in enumerate(side.series):
            of = side.g == g
            held = np.zeros((len(side.stations), len(side.times), n_terms))
            held[side.s[of], side.t[of]] = terms(side.values[of])
            made.append((pickle.dumps(series), pickle.dumps((side.times, (basis.T @ held.reshape(len(held), -1)).reshape(-1, len(side.times), n_terms)))))
        return pd.DataFrame({"_period": pdf["_period"].iloc[0], "_box": box, "_series": [a for a, _ in made], "_held": [b for _, b in made]})

    def seen(pdf: pd.DataFrame) -> pd.DataFrame:
        side = Side(pdf, names, columns)
        order, start, x, y, radius = _cells(side.lon, side.lat)
        held = (side.lon[order], side.lat[order], start, x, y, radius, _keys(side), np.packbits(_presence(side)[order], axis=1))
        return pd.DataFrame({"_period": [pdf["_period"].iloc[0]], "_box": [int(pdf["_box"].iloc[0])], "_held": [pickle.dumps(held)]})

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {c: [pdf[c].iloc[0]] for c in ("_period", "_box", "_part")}
        return pd.DataFrame(head | {"_kind": ["targets"], "_from": [int(pdf["_box"].iloc[0])], "_held": [pickle.dumps(Side(pdf, names, [*columns, "_weak"]))]})

    near = F.array(*[F.array(*[F.lit(b) for b in boxes.bands_near(k)]) for k in range(len(boxes.low))])
    by_band = grouped.applyInPandas(lambda pdf: moments(pdf), f"{period}, _box int, _series binary, _held binary")
    by_band = by_band.withColumn("_band", F.explode(F.element_at(near, F.floor(F.col("_box") / 1_000).cast("int") + 1)))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums at the nodes of a band's boxes, of one series."""
        band, source = int(pdf["_band"].iloc[0]), {}
        for box, held in zip(pdf["_box"], pdf["_held"], strict=True):
            source.setdefault(int(box), []).append(pickle.loads(held))
        times = pd.Index(sorted({t for parts in source.values() for index, _ in parts for t in index}))
        total = {b: np.zeros((NODES * NODES, len(times) * n_terms)) for b in source if b // 1_000 == band}
        for box, held in source.items():
            m = np.zeros((NODES * NODES, len(times), n_terms))
            for index, part in held:
                m[:, times.get_indexer(index)] += part
            m, (sx, sy) = m.reshape(NODES * NODES, -1), boxes.places(box)
            for target, out in total.items():
                if boxes.gap(box, target) <= boxes.reach:
                    x, y = boxes.places(target)
                    out += np.exp(-0.5 * (great_circle(x[:, None], y[:, None], sx[None], sy[None]) / boxes.bandwidth) ** 2) @ m
        found = [pickle.dumps((pickle.loads(pdf["_series"].iloc[0]), times, m)) for m in total.values()]
        return pd.DataFrame({"_period": [pdf["_period"].iloc[0]] * len(found), "_box": list(total), "_held": found}) if found else pd.DataFrame()

    local = by_band.repartition(200, "_period", "_band", "_series").groupBy("_period", "_band", "_series").applyInPandas(lambda pdf: gather(pdf), f"{period}, _box int, _held binary")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    local = local.select("_period", "_box", every_part.alias("_part"), F.lit("local").alias("_kind"), F.col("_box").alias("_from"), "_held")

    occupied = rows.select("_period", "_box").distinct()
    pairs = occupied.withColumnRenamed("_box", "_from").withColumn("_band", F.explode(F.element_at(near, F.floor(F.col("_from") / 1_000).cast("int") + 1)))
    pairs = pairs.join(occupied.withColumn("_band", F.floor(F.col("_box") / 1_000).cast("int")), ["_period", "_band"])  # a row a pair of boxes
    within = F.pandas_udf(lambda a, b: pd.Series([boxes.gap(p, q) <= boxes.reach for p, q in zip(a, b, strict=True)], dtype=bool), "boolean")
    pairs = pairs.where(within("_from", "_box")).select("_period", "_from", "_box")
    known = grouped.applyInPandas(lambda pdf: seen(pdf), f"{period}, _box int, _held binary").withColumnRenamed("_box", "_from")
    known = known.join(pairs, ["_period", "_from"]).select("_period", "_box", every_part.alias("_part"), F.lit("seen").alias("_kind"), "_from", "_held")
    own = grouped.applyInPandas(lambda pdf: targets(pdf), f"{period}, _box int, _part int, _kind string, _from int, _held binary")

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        """What the stations of a part of a box have."""
        mine = pdf[pdf["_kind"] == "targets"]["_held"]
        if not len(mine):
            return pd.DataFrame()
        side, box = pickle.loads(mine.iloc[0]), int(pdf["_box"].iloc[0])
        wanted = _keys(side)
        n = _within(side, wanted, [pickle.loads(h) for h in pdf[pdf["_kind"] == "seen"]["_held"]], boxes)
        basis, out = boxes.basis(box, side.lon, side.lat), []
        for held in pdf[pdf["_kind"] == "local"]["_held"]:
            series, times, nodes = pickle.loads(held)
            if series not in side.series:
                continue
            g = side.series.index(series)
            of = np.flatnonzero((side.g == g) & (side.values[:, -1] == 0))
            if not len(of):
                continue
            at = times.get_indexer(pd.Index(side.times))[side.t[of]]
            got = (basis @ nodes).reshape(len(basis), len(times), n_terms)[side.s[of], at] - terms(side.values[of][:, :-1])  # a station itself has weight 1
            of_n = n[side.s[of], g * len(side.times) + side.t[of]] - 1
            made = {"bandwidth": boxes.bandwidth, "target": side.stations[side.s[of]], **dict(zip(names[:-1], ([v] * len(of) for v in series), strict=True)), names[-1]: side.times[side.t[of]]}
            made |= {"n": of_n} | dict(zip(sums, got.T, strict=True)) | dict(zip(columns, side.values[of].T, strict=False))
            out.append(pd.DataFrame(made))
        return pd.concat(out) if out else pd.DataFrame()

    sent = own.unionByName(local).unionByName(known)
    return sent.repartition(200, "_period", "_box", "_part").groupBy("_period", "_box", "_part").applyInPandas(lambda pdf: read(pdf), schema)


def _within(side: Side, wanted: list[tuple], packs: list[tuple], boxes: Boxes) -> np.ndarray:
    """Stations within reach of each station of a side that report at each key, itself too: (stations, keys)."""
    place = {k: i for i, k in enumerate(wanted)}
    lon, lat, first, cx, cy, cr, masks, offset = [], [], [], [], [], [], [], 0
    for x, y, start, ax, ay, r, held, bits in packs:
        mask = np.zeros((len(x), len(wanted)), np.uint8)
        at = np.array([place.get(k, -1) for k in held])
        mask[:, at[at >= 0]] = np.unpackbits(bits, axis=1, count=len(held))[:, at >= 0]
        for to, what in ((lon, x), (lat, y), (first, start + offset), (cx, ax), (cy, ay), (cr, r), (masks, mask)):
            to.append(what)
        offset += len(x)
    lon, lat, first, cx, cy, cr, mask = (np.concatenate(v) for v in (lon, lat, first, cx, cy, cr, masks))
    size = np.diff(np.append(first, len(lon)))
    cell_sums = np.add.reduceat(mask, first, axis=0, dtype=np.float64)
    order, start, tx, ty, tr = _cells(side.lon, side.lat)
    out, ends = np.zeros((len(side.lon), len(wanted)), np.int64), np.append(start, len(side.lon))
    for k in range(0, len(start), 64):
        some = slice(k, min(k + 64, len(start)))
        d = great_circle(tx[some, None], ty[some, None], cx[None], cy[None])
        slack = tr[some, None] + cr[None] + 1e-6
        inside, across = d + slack <= boxes.reach, np.abs(d - boxes.reach) < slack
        whole = (inside.astype(float) @ cell_sums).round().astype(np.int64)
        for i in range(some.stop - k):
            mine = order[ends[k + i] : ends[k + i + 1]]
            out[mine] += whole[i]
            cells = np.flatnonzero(across[i] & ~inside[i])
            if len(cells):
                n = size[cells]
                at = np.arange(n.sum()) + np.repeat(first[cells] - (np.cumsum(n) - n), n)
                km = great_circle(side.lon[mine, None], side.lat[mine, None], lon[None, at], lat[None, at])
                met = np.exp(-0.5 * (km / boxes.bandwidth) ** 2) >= NO_WEIGHT
                out[mine] += (met.astype(np.float32) @ mask[at].astype(np.float32)).round().astype(np.int64)
    return out
