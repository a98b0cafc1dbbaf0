"""Cadence alignment and panel assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CADENCES = ("hourly", "3-hourly", "daily", "monthly", "annual")


def floor_to(ts: Column | str, cadence: str) -> Column:
    """Start of the period a time falls in, as timestamp_ntz."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if cadence == "3-hourly":
        day = F.date_trunc("day", c).cast("timestamp_ntz")
        return (day + F.make_dt_interval(hours=(F.floor(F.hour(c) / 3) * 3).cast("int"))).cast("timestamp_ntz")
    unit = {"hourly": "hour", "daily": "day", "monthly": "month", "annual": "year"}[cadence]
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def align_floor(panel: DataFrame, source: DataFrame, cadence: str, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Panel rows with the source row of their own period (source times are period starts); missing ones stay null."""
    src = source.withColumn("_period", floor_to(ts, cadence)).drop(ts)
    return panel.withColumn("_period", floor_to(ts, cadence)).join(src, [*keys, "_period"], "left").drop("_period")


def align_asof(panel: DataFrame, source: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", period: str = "month") -> DataFrame:
    """Panel rows with the latest known source value at or before their time.

    One sorted window over both sides for each key and period, so that a long record isn't one task's work; where a
    period has no value yet, it takes the last one of an earlier period, from a table of one row a key and period.
    """
    rest = [c for c in panel.columns if c not in (*keys, ts)]
    part = F.date_trunc(period, ts).alias("_period")
    known = source.where(F.col(value).isNotNull())
    lasts = known.groupBy(*keys, part).agg(F.max_by(value, F.struct(ts, value)).alias("_last"))
    spans = lasts.unionByName(panel.select(*keys, part).distinct().withColumn("_last", F.lit(None).cast(source.schema[value].dataType)))
    spans = spans.groupBy(*keys, "_period").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    both = panel.select(*keys, ts, *rest, F.lit(None).cast(source.schema[value].dataType).alias(value), F.lit(1).alias("_side")).unionByName(
        known.select(*keys, ts, value, F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys, "_period").orderBy(ts, "_side", F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("_period", part).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")
    on = [latest[k].eqNullSafe(carried[k]) for k in (*keys, "_period")]
    joined = latest.join(carried, on, "left")
    return joined.select(*[latest[c] for c in (*keys, ts, *rest)], F.coalesce(latest[value], carried["_carried"]).alias(value))


def build_panel(obs: DataFrame, predictors: dict[str, DataFrame], keys: Sequence[str], static: DataFrame | None = None, static_key: str = "comuna") -> DataFrame:
    """Observations with the value of each predictor at the same keys, and static predictors by comuna.

    The observed value is only ever the target: a predictor table that has a column `observed` is refused.
    """
    out = obs
    for name, df in predictors.items():
        if "observed" in df.columns:
            raise ValueError(f"predictor {name} holds observed values")
        out = out.join(df.select(*keys, F.col("value").alias(name)), list(keys), "left")
    return out if static is None else out.join(static, static_key, "left")


def surface_spine(comunas: DataFrame, lo: str, hi: str, estimates: DataFrame, keys: Sequence[str] = ("comuna", "hour")) -> DataFrame:
    """Every comuna and hour from lo to hi (both included) with its estimate; the hours are made inside each comuna's row."""
    hours = F.explode(F.sequence(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"), F.expr("interval 1 hour")))
    return comunas.withColumn("hour", hours).join(estimates, list(keys), "left")


def surface(spine: DataFrame, fits: DataFrame, means: Sequence[tuple[str, DataFrame, Sequence[str]]], keys: Sequence[str], engine: str, x: str = "x") -> DataFrame:
    """Every row of the spine with an estimate and the engine that gave it, so that no hour stays empty.

    `fits` has (keys, slope, intercept) of the engine's local regressions; where there is none, or no predictor, the first of `means`
    that has a row is taken: (tag, table with mean_value, its keys), from the narrowest to the widest. Null only where none has.
    """
    out = spine.join(fits.select(*keys, "slope", "intercept"), list(keys), "left").withColumn("estimate", F.col("intercept") + F.col("slope") * F.col(x))
    out = out.withColumn("engine", F.when(F.col("estimate").isNotNull(), F.lit(engine)))
    for tag, table, by in means:
        out = out.join(table.select(*by, F.col("mean_value").alias("_mean")), list(by), "left")
        out = out.withColumn("engine", F.when(F.col("engine").isNull() & F.col("_mean").isNotNull(), F.lit(tag)).otherwise(F.col("engine")))
        out = out.withColumn("estimate", F.coalesce("estimate", "_mean")).drop("_mean")
    return out.drop("slope", "intercept", x)


def choose_engines(oof: DataFrame, keys: Sequence[str] | None = None, by: str = "pollutant") -> DataFrame:
    """(by, engine, rmse, n, rank) of out-of-fold rows (by, engine, obs, pred), best first (ties: by name). With `keys`, which name a row, engines
    are compared on the rows that all engines of their pollutant predict."""
    known = oof.where("obs is not null and pred is not null and not isnan(pred)")
    error = F.col("obs") - F.col("pred")
    if keys is None:
        scores = known.groupBy(by, "engine").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    else:  # errors are added up by the set of engines that predict a row, so predictions are read once
        known = known.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, F.struct("engine", (error * error).alias("e")).alias("_p"))
        found = known.groupBy(*keys).agg(F.collect_list("_p").alias("_p"))
        found = found.select(by, F.array_sort(F.array_compact(F.array_distinct("_p.engine"))).alias("_set"), F.explode("_p").alias("_p"))
        sums = found.groupBy(by, "_set", "_p.engine").agg(F.sum("_p.e").alias("_e"), F.count(F.lit(1)).alias("n"))
        wanted = F.size(F.array_distinct(F.flatten(F.collect_set("_set").over(Window.partitionBy(by)))))  # a row for each set and engine
        sums = sums.withColumn("_all", wanted).where(F.size("_set") == F.col("_all"))
        scores = sums.groupBy(by, "engine").agg(F.sqrt(F.sum("_e") / F.sum("n")).alias("rmse"), F.sum("n").alias("n"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rmse", "engine")))


def surface_of_engines(spine: DataFrame, estimates: dict[str, DataFrame], choice: DataFrame, means: Sequence[tuple[str, DataFrame, Sequence[str]]], keys: Sequence[str], by: str = "pollutant") -> DataFrame:
    """Every row of the spine with an estimate and the engine that made it: the best one of its pollutant (`choice`: by, engine, rank) that
    has an estimate (`estimates`: keys and estimate by engine) there, else the first of `means`, as in `surface`."""
    out, columns = spine.select(*keys), {}
    for i, (name, df) in enumerate(sorted(estimates.items())):
        columns[name] = f"_e{i}"
        made = df.where("estimate is not null and not isnan(estimate)").select(*keys, F.col("estimate").alias(columns[name]))
        out = out.join(made, list(keys), "left")
    order = choice.where(F.col("engine").isin(*columns)).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "engine"))), lambda x: x["engine"]).alias("_order"))
    value = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), F.col(c))])
    out = out.join(order, by, "left").withColumn("_by", value)
    out = out.withColumn("engine", F.expr("get(filter(coalesce(_order, array()), e -> _by[e] IS NOT NULL), 0)"))
    out = out.withColumn("estimate", F.expr("_by[engine]")).drop("_order", "_by", *columns.values())
    for tag, table, on in means:
        out = out.join(table.select(*on, F.col("mean_value").alias("_mean")), list(on), "left")
        out = out.withColumn("engine", F.when(F.col("engine").isNull() & F.col("_mean").isNotNull(), F.lit(tag)).otherwise(F.col("engine")))
        out = out.withColumn("estimate", F.coalesce("estimate", "_mean")).drop("_mean")
    return out
