"""Boosting of all folds at once against refits and against trees grown by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerostrata.operators import boosting

SCHEMA = "pollutant string, station string, a double, b double, value double"


def table(spark, n=300, stations=6):
    rng = np.random.default_rng(1)
    rows = [(["p", "q"][i % 2], f"s{i % stations}", float(a), float(b), float((1 + i % 2) * (a > 0) + b * b + rng.normal() * 0.1)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def grown(x, y, edges, trees, depth, rate, min_rows):
    """Predictor of boosted trees, node by node."""
    base = y.mean()
    forest = []

    def tree(rows, r, level):
        best = (1e-9, None)
        if level < depth:
            for f, e in enumerate(edges):
                for t in e:
                    left = rows[x[rows, f] <= t]
                    right = rows[x[rows, f] > t]
                    if len(left) >= min_rows and len(right) >= min_rows:
                        gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right) - r[rows].sum() ** 2 / len(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, t, left, right))
        if best[1] is None:
            return r[rows].mean()
        f, t, left, right = best[1]
        return f, t, tree(left, r, level + 1), tree(right, r, level + 1)

    def value(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def predict(row):
        return base + rate * sum(value(t, row) for t in forest)

    for _ in range(trees):
        forest.append(tree(np.arange(len(y)), y - np.array([predict(row) for row in x]), 0))
    return predict


def test_folds_are_refits_without_the_station(spark):
    df = table(spark)
    edges = [[-1.0, -0.4, 0.0, 0.4, 1.0], [-1.5, -0.7, 0.7, 1.5]]
    model = boosting.fit(df, ["a", "b"], by="pollutant", trees=2, depth=2, rate=0.5, edges=edges)
    got = model.out_of_fold(df).toPandas()
    full = model.score(df).toPandas()
    data = df.toPandas()
    for p in ("p", "q"):
        of = data[data.pollutant == p]
        for out in [*sorted(set(of.station))[:2], None]:
            seen, asked = of[of.station != out], (full if out is None else got[got.station == out])
            predict = grown(seen[["a", "b"]].to_numpy(), seen.value.to_numpy(), edges, 2, 2, 0.5, 5)
            asked = asked[asked.pollutant == p].head(25)
            assert asked.pred.to_numpy() == pytest.approx(np.array([predict(r) for r in asked[["a", "b"]].to_numpy()]), abs=1e-9)
    assert got.groupby(["pollutant", "fold"]).station.nunique().eq(1).all()


def test_jobs_do_not_grow_with_stations(spark):
    def jobs(stations):
        df = table(spark, 240, stations).persist()
        df.count()
        spark.sparkContext.setJobGroup(f"boost{stations}", "")
        boosting.fit(df, ["a"], trees=1, depth=1, edges=[[0.0]])
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost{stations}"))
        spark.sparkContext.setJobGroup("", "")
        return done

    assert jobs(40) == jobs(4) > 0


def test_it_learns_and_tells_features_apart(spark):
    df = table(spark, 500).withColumn("a", F.when(F.col("a") > 2, None).otherwise(F.col("a")))
    model = boosting.fit(df, ["b", "a"], by="pollutant", folds=2, trees=6)
    got = model.out_of_fold(df).toPandas()
    assert len(got) == 500 and got.pred.isna().equals(got.a.isna())
    known = got.dropna()
    assert ((known.pred - known.value) ** 2).mean() < 0.4 * known.value.var()
    assert known.groupby("pollutant").fold.nunique().eq(2).all()
    ranked = model.importances(spark).toPandas()
    assert set(ranked.groupby("pollutant").importance.sum().round(9)) == {1.0} and len(ranked) == 4
    one = boosting.fit(df, ["b", "a"], trees=1, depth=1)
    assert one.importances(spark).columns == ["feature", "importance", "rank"]
    new = spark.createDataFrame([("p", 0.5, 0.5), ("z", 0.5, 0.5), (None, 0.5, 0.5), ("p", None, 0.5), ("p", float("nan"), 0.5)], "pollutant string, a double, b double")
    assert [r.pred is not None for r in model.score(new).collect()] == [True, False, False, False, False]


def test_small_and_empty_panels(spark):
    df = table(spark)
    alone = boosting.fit(df.where("station = 's0' and pollutant = 'p'"), ["a"], trees=1, depth=1)
    assert alone.out_of_fold(df.where("station = 's0' and pollutant = 'p'")).where("pred is not null").count() == 0  # nothing else to learn from
    assert alone.score(df.limit(3)).where("pred is null").count() == 0
    empty = boosting.fit(df.limit(0), ["a", "b"], by="pollutant", trees=1, depth=1)
    assert empty.out_of_fold(df).where("pred is not null").count() == 0 and empty.importances(spark).count() == 0
    few = df.where("station in ('s0', 's1')").limit(4)
    assert boosting.fit(few, ["a"], trees=2, depth=2).feature[0].max() == -1  # too few rows for a split


def test_folds_share_the_sums_of_their_trees(spark):
    """Many stations, few different trees: trees stay in a table, and each fold still equals a refit."""
    df = table(spark, 3000, 600).where("pollutant = 'p'")
    edges = [[-1.0, -0.4, 0.0, 0.4, 1.0], [-1.5, -0.7, 0.7, 1.5]]
    model = boosting.fit(df, ["a", "b"], by="pollutant", trees=2, depth=2, rate=0.5, edges=edges)
    stations = df.select("station").distinct().count()
    assert model.models.count() == stations + 1
    assert model.models.select("feature", "cut").distinct().count() < stations / 4
    assert [len(f) for f in model.feature] == [1, 1]  # the driver holds the model of all rows only
    data, got = df.toPandas(), model.out_of_fold(df).toPandas()
    for out in sorted(set(data.station))[::100]:
        seen, asked = data[data.station != out], got[got.station == out]
        predict = grown(seen[["a", "b"]].to_numpy(), seen.value.to_numpy(), edges, 2, 2, 0.5, 5)
        assert asked.pred.to_numpy() == pytest.approx(np.array([predict(r) for r in asked[["a", "b"]].to_numpy()]), abs=1e-9)


def test_a_fit_reads_its_panel_once(spark):
    """What makes the panel (a shuffle, a scan) isn't repeated for stations, quantiles, sums and own rows."""
    df = table(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    for folds in (None, 2):
        before = read.value
        boosting.fit(df.mapInPandas(counted, SCHEMA), ["a", "b"], by="pollutant", trees=1, depth=1, folds=folds)
        assert read.value - before == 300
