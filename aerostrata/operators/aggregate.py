"""Exposure aggregates and validation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerostrata.operators.network import pair_totals


def hour_of(ts: Column | str) -> Column:
    """The hour a time falls in, as timestamp_ntz."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def comuna_hourly(df: DataFrame, weights: str | None = None, keys: Sequence[str] = ("pollutant", "comuna"), ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean and number of pixels by key and hour; weighted if a weight column is given. Null values don't count."""
    known = df.where(F.col(value).isNotNull())
    mean = F.avg(value) if weights is None else F.sum(F.col(weights) * F.col(value)) / F.nullif(F.sum(weights), F.lit(0.0))
    return known.groupBy(*keys, hour_of(ts).alias("hour")).agg(mean.alias("mean_value"), F.count(F.lit(1)).alias("n"))


def comuna_daily(hourly: DataFrame, min_hours: int = 0, keys: Sequence[str] = ("pollutant", "comuna")) -> DataFrame:
    """Mean of the hourly means and number of hours by key and day; days with fewer than min_hours are left out."""
    out = hourly.groupBy(*keys, F.to_date("hour").alias("obs_day")).agg(F.avg("mean_value").alias("mean_value"), F.count(F.lit(1)).alias("n_hours"))
    return out.where(F.col("n_hours") >= min_hours) if min_hours else out


def macrozone_hourly(hourly: DataFrame, geo: DataFrame, weight: str | None = None) -> DataFrame:
    """Hourly mean over the comunas of a macrozone, unweighted unless a weight column (such as population) is given."""
    joined = hourly.join(geo, "comuna")
    mean = F.avg("mean_value") if weight is None else F.sum(F.col(weight) * F.col("mean_value")) / F.nullif(F.sum(weight), F.lit(0.0))
    return joined.groupBy("pollutant", "macrozone", "hour").agg(mean.alias("mean_value"), F.count(F.lit(1)).alias("n_comunas"))


def metrics(oof: DataFrame, by: Sequence[Sequence[str]], obs: str = "obs", pred: str = "pred") -> DataFrame:
    """R2 (1 - SSE/SST), RMSE, bias and squared correlation for each grouping set of `by`, in one pass."""
    columns = sorted({c for s in by for c in s})
    o, p = F.col(obs), F.col(pred)
    sums = oof.where(o.isNotNull() & p.isNotNull()).groupingSets([[F.col(c) for c in s] for s in by], *columns).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((o - p) * (o - p)).alias("_sse"),
        F.sum(o).alias("_so"),
        F.sum(o * o).alias("_soo"),
        F.sum(p).alias("_sp"),
        F.sum(p * p).alias("_spp"),
        F.sum(o * p).alias("_sop"),
    )
    sst = F.col("_soo") - F.col("_so") * F.col("_so") / F.col("n")
    spp = F.col("_spp") - F.col("_sp") * F.col("_sp") / F.col("n")
    cov = F.col("_sop") - F.col("_so") * F.col("_sp") / F.col("n")
    many = F.col("n") > 1
    return sums.select(
        *columns,
        "n",
        F.when(many & (sst > 1e-9), 1 - F.col("_sse") / sst).alias("r2"),
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        ((F.col("_sp") - F.col("_so")) / F.col("n")).alias("bias"),
        F.when(many & (sst > 1e-9) & (spp > 1e-9), cov * cov / (sst * spp)).alias("corr2"),
    )


def temporal_bias(oof: DataFrame, ts: str = "ts") -> DataFrame:
    """Mean residual by pollutant and hour of day, month and year, as one table of grouping sets."""
    rows = oof.select("pollutant", F.hour(ts).alias("hour_of_day"), F.month(ts).alias("month"), F.year(ts).alias("year"), (F.col("pred") - F.col("obs")).alias("_r"))
    p = F.col("pollutant")
    sets = [[p, F.col("hour_of_day")], [p, F.col("month")], [p, F.col("year")]]
    return rows.groupingSets(sets, "pollutant", "hour_of_day", "month", "year").agg(F.avg("_r").alias("mean_residual"), F.count("_r").alias("n"))


def compare_engines(oof: DataFrame, engines: Sequence[str]) -> DataFrame:
    """RMSE of each engine side by side, by pollutant."""
    return oof.groupBy("pollutant").pivot("engine", list(engines)).agg(F.sqrt(F.avg((F.col("obs") - F.col("pred")) * (F.col("obs") - F.col("pred")))))


def rank_engines(scores: DataFrame, score: str = "rmse", by: str = "pollutant", name: str = "engine") -> DataFrame:
    """Rank of each engine by ascending score, ties share a rank."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(score)))


def semivariogram(obs: DataFrame, bin_km: float, max_km: float, keys: Sequence[str] = ("pollutant", "hour"), period: str = "month") -> DataFrame:
    """Empirical semivariogram: half the mean squared difference of station pairs of the same hour, by distance bin, without a row a pair."""
    sums = pair_totals(obs, bin_km, max_km, keys, period)
    return sums.select(keys[0], F.col("bin").alias("distance_bin"), (F.col("h") / F.col("n")).alias("gamma"), F.col("n").alias("n_pairs"))


def hour_gaps(df: DataFrame, keys: Sequence[str], hour: str = "hour") -> DataFrame:
    """Runs of missing hours between two hours of a series: last hour before, next hour after, hours missing."""
    after = F.lead(hour).over(Window.partitionBy(*keys).orderBy(hour))
    steps = df.select(*keys, hour).distinct().withColumn("gap_end", after)
    hours = ((F.unix_micros(F.col("gap_end").cast("timestamp")) - F.unix_micros(F.col(hour).cast("timestamp"))) / 3_600_000_000).cast("long")
    return steps.withColumn("missing", hours - 1).where("missing > 0").select(*keys, F.col(hour).alias("gap_start"), "gap_end", "missing")
