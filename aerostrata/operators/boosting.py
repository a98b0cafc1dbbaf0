"""Gradient boosting of all leave-one-station-out folds at once.

A fold is a model of its own: its rows are all rows but those of a station (or of a group of stations), and one more model has all rows. Trees
grow level by level, those of all folds and pollutants in the same jobs: a fit of `trees` trees of `depth` levels takes as many jobs however
many stations there are. The result is that of a refit without the station, with the same bins.

Sums over all rows are shared by the models whose splits are the same so far, and few are different: with y less the mean, a model's
residuals add up to the sum of y, less its start times the number of rows, less each leaf value of an earlier tree times the number of rows
that this leaf shares with the place asked for. So rows are summed once for each distinct tree and for each pair of an earlier and a
growing tree that occur together (pieces), not once for each fold. A fold then takes its own rows away, which stand in
its row of the table of models; what it costs follows its own rows. With a number of folds their own sums are pieces as well.

Bins are cut at quantiles of each feature over all rows, of targets nothing is looked at. Trees stay in a table of a row a model; the driver
holds pieces and the models of all rows. Rows that lack the target or a feature teach nothing and are predicted as null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Numbers of one array over models and bins, at a time: what stays in a core's cache.
CELLS = 1 << 17
_MODEL = "_g int, fold int, base double, feature binary, cut binary, leaf binary, gain binary"


@dataclass
class Boosted:
    """Trees: those of all rows of each pollutant in arrays, those of the folds in a table."""

    features: list[str]
    edges: list[np.ndarray]
    groups: dict
    mean: np.ndarray  # of each group
    depth: int
    rate: float
    by: str | None
    held: DataFrame  # (group, station, fold)
    models: DataFrame | None = None  # (_g, fold, base, feature, cut, leaf), fold -1 for all rows
    feature: list[np.ndarray] = field(default_factory=list)  # a tree: (groups, inner nodes), of the models of all rows
    cut: list[np.ndarray] = field(default_factory=list)  # a bin goes left up to it
    gain: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)  # (groups, leaves)

    def _scored(self, df: DataFrame, name: str) -> DataFrame:
        """Rows with the prediction of the model beside them (_base, _feature, _cut, _leaf)."""
        rows = df.withColumns({f"_f{i}": F.col(f).cast("double") for i, f in enumerate(self.features)})
        edges, depth, rate, mean = self.edges, self.depth, self.rate, self.mean

        @F.pandas_udf("double")
        def score(group: pd.Series, base: pd.Series, feature: pd.Series, cut: pd.Series, leaf: pd.Series, *values: pd.Series) -> pd.Series:
            found = pd.concat(values, axis=1).to_numpy(float)
            out = np.full(len(group), np.nan)
            ok = np.flatnonzero(base.notna().to_numpy() & np.isfinite(found).all(axis=1))
            if len(ok):
                f, c, v = _arrays(feature.iloc[ok], cut.iloc[ok], leaf.iloc[ok], depth)
                out[ok] = mean[group.to_numpy()[ok].astype(int)] + base.to_numpy(float)[ok] + rate * _predict(_binned(found[ok], edges), f, c, v, depth)
            return pd.Series(out)

        made = score("_g", "_base", "_feature", "_cut", "_leaf", *[F.col(f"_f{i}") for i in range(len(self.features))])
        return rows.withColumn(name, F.nullif(made, F.lit(float("nan")))).drop("_g", "_base", "_feature", "_cut", "_leaf", *[f"_f{i}" for i in range(len(self.features))])

    def _models(self) -> DataFrame:
        return self.models.select(F.col("_g").alias("_mg"), F.col("fold").alias("_mfold"), *[F.col(c).alias(f"_{c}") for c in ("base", "feature", "cut", "leaf")])

    def out_of_fold(self, panel: DataFrame, name: str = "pred") -> DataFrame:
        """The panel with fold and the prediction of the model that hasn't seen the row's station."""
        keys = ([self.by] if self.by else []) + ["station"]
        held = self.held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "fold", _code(self, F.col(self.by) if self.by else None).alias("_g"))
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        if not self.groups:
            return panel.withColumns({"fold": F.lit(None).cast("int"), name: F.lit(None).cast("double")})
        held = held.join(self._models(), (F.col("_g") == F.col("_mg")) & (F.col("fold") == F.col("_mfold"))).drop("_mg", "_mfold")
        return self._scored(panel.join(held, on, "left").drop(*[f"_k{i}" for i in range(len(keys))]), name)

    def score(self, rows: DataFrame, name: str = "pred") -> DataFrame:
        """Rows with the prediction of the model of all rows of their pollutant."""
        if not self.groups:
            return rows.withColumn(name, F.lit(None).cast("double"))
        whole = F.broadcast(self._models().where("_mfold = -1").drop("_mfold"))  # a row a group
        coded = rows.withColumn("_g", _code(self, F.col(self.by) if self.by else None))
        return self._scored(coded.join(whole, F.col("_g") == F.col("_mg"), "left").drop("_mg"), name)

    def importances(self, spark: SparkSession) -> DataFrame:
        """(group, feature, importance, rank): shares of the squared error that splits by a feature took away, in the models of all rows."""
        rows = []
        for value, k in self.groups.items():
            total = np.zeros(len(self.features))
            for feature, gain in zip(self.feature, self.gain, strict=True):
                np.add.at(total, np.maximum(feature[k], 0), np.where(feature[k] >= 0, gain[k], 0.0))
            share = total / total.sum() if total.sum() > 0 else total
            order = sorted(range(len(share)), key=lambda i: (-share[i], self.features[i]))
            rows += [(value, self.features[i], float(share[i]), r + 1) for r, i in enumerate(order)]
        kind = "string" if self.by is None else dict(self.held.dtypes)[self.by]
        df = spark.createDataFrame(rows, f"_group {kind}, feature string, importance double, rank int")
        return df.drop("_group") if self.by is None else df.withColumnRenamed("_group", self.by)


def _code(model: Boosted, value: Column | None) -> Column:
    """Number of a row's group; null where it was never seen."""
    if value is None:
        return F.lit(0)
    code = F.lit(None).cast("int")
    for v, g in model.groups.items():
        code = F.when(value.eqNullSafe(F.lit(v)), F.lit(g)).otherwise(code)
    return code


def _binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)], axis=1)


def _arrays(feature, cut, leaf, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed trees of some models: (models, trees, inner nodes) twice and (models, trees, leaves)."""
    n, inner = len(feature), 2**depth - 1
    f, c = (np.frombuffer(b"".join(x), np.int16).reshape(n, -1, inner).astype(np.int64) for x in (feature, cut))
    return f, c, np.frombuffer(b"".join(leaf)).reshape(n, -1, inner + 1)


def _nodes(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after some levels of a tree: one for all rows (inner nodes,) or each its own (rows, inner nodes)."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for level in range(levels):
        at = node + 2**level - 1
        f, c = (a[at] if a.ndim == 1 else a[rows, at] for a in (feature, cut))
        node = 2 * node + (x[rows, np.maximum(f, 0)] > c)
    return node


def _predict(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the leaf values of each row's own trees."""
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for t in range(leaf.shape[1]):
        out += leaf[rows, t, _nodes(x, feature[:, t], cut[:, t], depth)]
    return out


def _pieces(batches: Iterator[pd.DataFrame], asked: dict, n_features: int, bins: int, level: int, depth: int) -> Iterator[pd.DataFrame]:
    """Of a partition (piece, sums): number and sum of y by feature, node and bin of a growing tree, or numbers by leaf of an earlier tree too.

    `asked`: (group, fold or -1) to a list of (piece, growing tree, earlier tree or None), trees as (feature, cut)."""
    size, leaves, held = 2**level * bins, 2**depth, {}
    for pdf in batches:
        x_all, y_all, n_all = pdf[[f"b{i}" for i in range(n_features)]].to_numpy(np.int64), pdf["y"].to_numpy(float), pdf["n"].to_numpy(float)
        g_all, fold_all = pdf["_g"].to_numpy(int), pdf["fold"].to_numpy(int)
        for (g, fold), wanted in asked.items():
            of = np.flatnonzero(g_all == g) if fold < 0 else np.flatnonzero((g_all == g) & (fold_all == fold))
            x, y, n, known = x_all[of], y_all[of], n_all[of], {}

            def node(tree, levels, x=x, known=known):
                if (tree, levels) not in known:
                    known[tree, levels] = _nodes(x, *(np.frombuffer(b, np.int16).astype(np.int64) for b in tree), levels)
                return known[tree, levels]

            for piece, tree, earlier in wanted:
                if piece not in held:
                    held[piece] = np.zeros((2 if earlier is None else leaves, n_features * size))
                first = node(tree, level) * bins
                for i in range(n_features):
                    cell, part = first + x[:, i], slice(i * size, (i + 1) * size)
                    if earlier is None:
                        held[piece][0, part] += np.bincount(cell, weights=n, minlength=size)
                        held[piece][1, part] += np.bincount(cell, weights=y, minlength=size)
                    else:
                        held[piece][:, part] += np.bincount(cell * leaves + node(earlier, depth), weights=n, minlength=size * leaves).reshape(size, leaves).T
    yield pd.DataFrame({"piece": list(held), "sums": [m.tobytes() for m in held.values()]})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "sums": [sum(np.frombuffer(b) for b in pdf["sums"]).tobytes()]})


def _best(n: np.ndarray, s: np.ndarray, min_rows: int) -> dict[str, np.ndarray]:
    """Best split of each node of some models, from (models, features, nodes, bins): feature -1 where none is worth it. Ties, but for
    rounding, go to the first feature and bin."""
    models, _, width, bins = n.shape
    s = np.where(n > 0, s, 0.0)
    left = np.stack([np.cumsum(n, axis=3), np.cumsum(s, axis=3)])
    whole = left[..., -1:]
    right = whole - left
    right[1] = np.where(right[0] > 0, right[1], 0.0)

    def mean(x):
        return np.where(x[0] > 0, x[1] / np.maximum(x[0], 1), 0.0)

    both = mean(left) * left[1] + mean(right) * right[1]
    gain = both - mean(whole) * whole[1]
    fits = (left[0] >= min_rows) & (right[0] >= min_rows)
    gain = np.where(fits, gain, -1.0).transpose(0, 2, 1, 3).reshape(models, width, -1)
    slack = 1e-9 + 1e-12 * np.where(fits, both, 0.0).transpose(0, 2, 1, 3).reshape(models, width, -1).max(axis=2)
    top = gain.max(axis=2)
    at = (gain >= (top - slack)[:, :, None]).argmax(axis=2)
    f, b, some = at // bins, at % bins, top > slack
    m, node = np.arange(models)[:, None], np.arange(width)[None]
    stay = mean(whole)[:, 0, :, 0]
    out = {"feature": np.where(some, f, -1), "cut": np.where(some, b, bins), "gain": np.where(some, np.take_along_axis(gain, at[:, :, None], 2)[:, :, 0], 0.0)}
    return out | {"left": np.where(some, mean(left)[m, f, node, b], stay), "right": np.where(some, mean(right)[m, f, node, b], stay)}


def _grow(batches: Iterator[pd.DataFrame], found: dict, n_features: int, bins: int, tree: int, level: int, depth: int, rate: float, min_rows: int) -> Iterator[pd.DataFrame]:
    """Models with the splits of one more level, and after the last one with the tree's leaves."""
    width, inner = 2**level, 2**depth - 1
    size = n_features * width * bins

    def whole(g: int, fold: int, trees: tuple, base: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and residuals of models with the same trees, from pieces."""
        n, y = found[g, fold, trees[-1], None]
        s = y[None] - base[:, None] * n[None]
        for t in range(tree):
            s -= rate * (leaf[:, t] @ found[g, fold, trees[-1], trees[t]])
        return n, s

    for pdf in batches:
        if level == 0:  # a new tree, without a split
            pdf["feature"] = [b + np.full(inner, -1, np.int16).tobytes() for b in pdf["feature"]]
            pdf["cut"] = [b + np.full(inner, bins, np.int16).tobytes() for b in pdf["cut"]]
            pdf["leaf"] = [b + bytes(8 * (inner + 1)) for b in pdf["leaf"]]
            pdf["gain"] = [b + bytes(8 * inner) for b in pdf["gain"]]
        base = np.nan_to_num(pdf["base"].to_numpy(float))
        feature, cut, leaf = (a.copy() for a in _arrays(pdf["feature"], pdf["cut"], pdf["leaf"], depth))
        gain = np.frombuffer(b"".join(pdf["gain"])).reshape(len(pdf), -1, inner).copy()
        kinds = pdf.groupby([pdf["_g"], pdf["feature"], pdf["cut"]], sort=False).indices
        for (g, f_key, c_key), of in kinds.items():
            trees = tuple(zip(*([b[k : k + 2 * inner] for k in range(0, len(b), 2 * inner)] for b in (f_key, c_key)), strict=True))
            for k in range(0, len(of), max(1, CELLS // size)):
                at = of[k : k + max(1, CELLS // size)]
                n, s = whole(g, -1, trees, base[at], leaf[at])
                n = np.repeat(n[None], len(at), axis=0)
                lengths = pdf["y"].iloc[at].map(len).to_numpy()
                if lengths.sum():
                    model = np.repeat(np.arange(len(at)), lengths)
                    x = np.stack([np.concatenate(pdf[f"b{i}"].iloc[at].to_list()) for i in range(n_features)], axis=1).astype(np.int64)
                    mine = at[model]
                    r = np.concatenate(pdf["y"].iloc[at].to_list()) - base[mine] - rate * _predict(x, feature[mine], cut[mine], leaf[mine, :tree], depth)
                    node = _nodes(x, *(np.frombuffer(b, np.int16).astype(np.int64) for b in trees[-1]), level)
                    cell = (((model[:, None] * n_features + np.arange(n_features)) * width + node[:, None]) * bins + x).ravel()
                    n -= np.bincount(cell, minlength=n.size).reshape(n.shape)
                    s -= np.bincount(cell, weights=np.repeat(r, n_features), minlength=n.size).reshape(n.shape)
                for j, fold in enumerate(pdf["fold"].iloc[at]):
                    if (g, fold, trees[-1], None) in found and fold >= 0:
                        own = whole(g, fold, trees, base[at[j : j + 1]], leaf[at[j : j + 1]])
                        n[j] -= own[0]
                        s[j] -= own[1][0]
                best = _best(n.reshape(len(at), n_features, width, bins), s.reshape(len(at), n_features, width, bins), min_rows)
                nodes = slice(width - 1, 2 * width - 1)
                feature[at, tree, nodes], cut[at, tree, nodes], gain[at, tree, nodes] = best["feature"], best["cut"], best["gain"]
                if level == depth - 1:
                    leaf[at, tree] = np.stack([best["left"], best["right"]], axis=2).reshape(len(at), -1)
        for name, made, kind in (("feature", feature, np.int16), ("cut", cut, np.int16), ("leaf", leaf, float), ("gain", gain, float)):
            pdf[name] = [m.astype(kind).tobytes() for m in made]
        yield pdf


def fit(
    panel: DataFrame,
    features: Sequence[str],
    y: str = "value",
    by: str | None = None,
    folds: int | None = None,
    trees: int = 10,
    depth: int = 3,
    rate: float = 0.3,
    bins: int = 32,
    min_rows: int = 5,
    edges: Sequence[Sequence[float]] | None = None,
) -> Boosted:
    """Models of all folds and of all rows, for each value of `by`. `folds` None leaves out one station each, a number deals the
    stations into so many. `edges` gives the upper ends of the bins but the last of each feature instead of quantiles."""
    spark = panel.sparkSession
    finite = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    for f in features:
        finite = finite & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    group = [by] if by else []
    known = panel.where(finite).select(*group, "station", F.col(y).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    parts = spark.sparkContext.defaultParallelism
    known = known.coalesce(2 * parts).persist(StorageLevel.MEMORY_AND_DISK)  # else its shuffle is written for each of its readers
    stations = known.groupBy(*group, "station").agg(F.sum("_y").alias("_s"), F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.xxhash64("station"), "station")) - 1  # stations of one network
    held = stations.withColumn("fold", (place if folds is None else place % folds).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
    total = held.groupBy(*group).agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")).collect()  # a row for each group

    names = sorted({r[by] if by else None for r in total}, key=lambda v: (v is not None, str(v))) if total and total[0]["n"] else []
    groups = {v: g for g, v in enumerate(names)}
    sums = np.zeros((2, len(names)))
    for r in total if names else []:
        sums[:, groups[r[by] if by else None]] = r["s"], r["n"]
    mean = sums[0] / np.maximum(sums[1], 1)
    if edges is None:
        ask = [F.percentile_approx(f"_f{i}", [k / bins for k in range(1, bins)], 10_000).alias(f"q{i}") for i in range(len(features))]
        row = known.agg(*ask).first()
        edges = [sorted(set(row[f"q{i}"] or ())) for i in range(len(features))]
    cuts = [np.array(e, float) for e in edges]
    wide = max((len(c) for c in cuts), default=0) + 1
    model = Boosted(list(features), cuts, groups, mean, depth, rate, by, held.select(*group, "station", "fold"))
    if not names:
        known.unpersist()
        return model

    keys, n_features = [*group, "station"], len(features)
    bin_names = [f"b{i}" for i in range(n_features)]
    few = folds is not None  # of few folds each is large: their rows stay dealt out
    on = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "fold")

    def folded(df: DataFrame) -> DataFrame:
        return df.join(on, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])

    rows = (folded(known) if few else known.withColumn("fold", F.lit(-1))).withColumn("_g", _code(model, F.col(by) if by else None))

    def placed(batches):
        for pdf in batches:
            x = _binned(pdf[[f"_f{i}" for i in range(n_features)]].to_numpy(float), cuts)
            yield pd.DataFrame({k: pdf[k] for k in keys} | {"_g": pdf["_g"], "fold": pdf["fold"], "y": pdf["_y"] - mean[pdf["_g"].to_numpy(int)]} | {b: x[:, i].astype(np.int16) for i, b in enumerate(bin_names)})

    types = dict(known.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "_g int, fold int, y double", *[f"{b} smallint" for b in bin_names]])
    rows = rows.select(*keys, "_g", "fold", "_y", *[f"_f{i}" for i in range(n_features)]).mapInPandas(placed, schema)
    cells = rows.select("_g", "fold", "y", *bin_names).repartition(parts, "_g", "fold", *bin_names)  # one shuffle: the sums come after it
    cells = cells.groupBy("_g", "fold", *bin_names).agg(F.sum("y").alias("y"), F.count(F.lit(1)).cast("double").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    totals = [F.sum("y").alias("_s"), F.count(F.lit(1)).alias("_n")]
    if few:
        own = rows.groupBy("_g", "fold").agg(*totals)
    else:  # a station is a fold, so its number joins its row, not its rows
        own = folded(rows.drop("fold").groupBy(*keys, "_g").agg(*totals, F.collect_list(F.struct("y", *bin_names)).alias("_own")))
    taken = [F.array().cast(f"array<{t}>").alias(c) if few else F.col("_own")[c].alias(c) for c, t in [("y", "double"), *[(b, "smallint") for b in bin_names]]]
    size = F.lit(None).cast("double")
    for g in range(len(names)):
        size = F.when(F.col("_g") == g, float(sums[1, g])).otherwise(size)
    # y is less the mean, so the rows of the others add up to what the fold's own lack
    base = F.when(size > F.col("_n"), -F.col("_s") / (size - F.col("_n"))).otherwise(F.lit(float("nan")))
    empty = [F.lit(b"").alias(c) for c in ("feature", "cut", "leaf", "gain")]
    alone = spark.createDataFrame([(g, -1) for g in range(len(names))], "_g int, fold int").select("_g", "fold", F.lit(0.0).alias("base"), *empty, *[F.array().cast(f"array<{t}>").alias(c) for c, t in [("y", "double"), *[(b, "smallint") for b in bin_names]]])
    state = own.select("_g", "fold", base.alias("base"), *empty, *taken).unionByName(alone).coalesce(parts).localCheckpoint()
    schema = ", ".join([_MODEL, "y array<double>", *[f"{b} array<smallint>" for b in bin_names]])
    inner = 2 * (2**depth - 1)

    try:
        for tree in range(trees):
            for level in range(depth):
                kinds = state.select("_g", F.col("fold") if few else F.lit(-1).alias("fold"), "feature", "cut").distinct().collect()  # a row for each distinct model
                asked: dict = {}
                for r in kinds:
                    f, c = bytes(r["feature"]), bytes(r["cut"])
                    if level == 0:
                        f, c = f + np.full(inner // 2, -1, np.int16).tobytes(), c + np.full(inner // 2, wide, np.int16).tobytes()
                    forest = [(f[k : k + inner], c[k : k + inner]) for k in range(0, len(f), inner)]
                    for fold in {-1, r["fold"]}:
                        asked.setdefault((r["_g"], fold), set()).update((forest[-1], earlier) for earlier in (None, *forest[:-1]))
                names_of = [(g, fold, *pair) for (g, fold), pairs in asked.items() for pair in pairs]
                listed: dict = {}
                for piece, (g, fold, growing, earlier) in enumerate(names_of):
                    listed.setdefault((g, fold), []).append((piece, growing, earlier))
                sent = spark.sparkContext.broadcast(listed)
                parts = cells.mapInPandas(lambda batches, sent=sent, level=level: _pieces(batches, sent.value, n_features, wide, level, depth), "piece int, sums binary")
                made = parts.groupBy("piece").applyInPandas(_added, "piece int, sums binary").collect()  # a row a piece
                found = spark.sparkContext.broadcast({names_of[r["piece"]]: np.frombuffer(bytes(r["sums"])).reshape(-1, n_features * 2**level * wide) for r in made})
                grown = state.mapInPandas(lambda batches, found=found, tree=tree, level=level: _grow(batches, found.value, n_features, wide, tree, level, depth, rate, min_rows), schema)
                state = grown.localCheckpoint()  # else plans hold those of all levels before
                sent.destroy()
                found.destroy()
    finally:
        cells.unpersist()
        known.unpersist()
    whole = sorted(state.where("fold = -1").select("_g", "feature", "cut", "leaf", "gain").collect(), key=lambda r: r["_g"])
    feature, cut, leaf = _arrays(*([bytes(r[c]) for r in whole] for c in ("feature", "cut", "leaf")), depth)
    gain = np.frombuffer(b"".join(bytes(r["gain"]) for r in whole)).reshape(feature.shape)
    for kept, new in ((model.feature, feature), (model.cut, cut), (model.gain, gain), (model.leaf, leaf)):
        kept.extend(new[:, t] for t in range(trees))
    model.models = state.select("_g", "fold", "base", "feature", "cut", "leaf")
    return model
