"""Request plans, pending work, request status, summaries and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerostrata.functions.scalar import crop_name
from aerostrata.operators.predicates import is_useful, raw_only


def request_plan(stations: DataFrame, pollutants: Sequence[tuple[str, str]], resolutions: Sequence[str], date_from: str, date_to: str) -> DataFrame:
    """Every station with every (pollutant, parameter code) and resolution, made inside the station's row: file name and query text."""
    codes = F.array(*[F.struct(F.lit(p).alias("pollutant"), F.lit(c).alias("param_code")) for p, c in pollutants])
    plan = stations.withColumn("_p", F.explode(codes)).withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in resolutions])))
    plan = plan.withColumn("pollutant", F.col("_p.pollutant")).withColumn("param_code", F.col("_p.param_code")).drop("_p")
    name = F.format_string(f"%s_%s_%s_{date_from}_{date_to}.csv", "region", "station_id", "resolution")
    macro = F.format_string("./%s/%s/Cal/%s//%s.%s.%s.ic", "region", "station_id", "param_code", "param_code", "resolution", "resolution")
    return plan.withColumn("file_name", name).withColumn("macro", macro)


def pending(catalogue: DataFrame, ledger: DataFrame, granule: str = "granule", name: str = "name") -> DataFrame:
    """Granules without a done or empty entry in the ledger; a name that gives no crop name stays pending."""
    seen = ledger.select(F.regexp_replace(name, r"\.vacio$", "").alias("_crop")).distinct()
    return catalogue.withColumn("_crop", crop_name(granule)).join(seen, "_crop", "left_anti").drop("_crop")


def plan_counts(catalogue: DataFrame, ledger: DataFrame, by: Sequence[str] = ("product",)) -> DataFrame:
    """How many granules each source would process."""
    return pending(catalogue, ledger).groupBy(*by).agg(F.count(F.lit(1)).alias("n_pending"))


def request_status(plan: DataFrame, replies: DataFrame, key: str, text: str = "text", error: str | None = None) -> DataFrame:
    """The plan with status (ok, no data, error), reason and bytes of each reply; a missing reply has no data."""
    joined = plan.join(replies, key, "left")
    failed = F.col(error).isNotNull() if error else F.lit(False)
    status = F.when(failed, "error").when(is_useful(F.col(text)), "ok").otherwise("no data")
    reason = F.when(failed, F.concat(F.lit("error: "), F.col(error) if error else F.lit(""))).when(status == "no data", "no data")
    return joined.withColumn("status", status).withColumn("reason", reason).withColumn("bytes", F.when(F.col("status") == "ok", F.octet_length(text).cast("long")))


def run_summary(ledger: DataFrame) -> DataFrame:
    """Requests and bytes by status."""
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def month_completeness(df: DataFrame, ts: str = "ts", variable: str = "variable") -> DataFrame:
    """Distinct time steps and variables of each month."""
    return df.groupBy(F.date_format(ts, "yyyyMM").alias("month")).agg(F.countDistinct(ts).alias("steps"), F.countDistinct(variable).alias("variables"))


def missing_months(expected: DataFrame, got: DataFrame, month: str = "month", show: int = 6) -> DataFrame:
    """Number of expected months that are absent and the first few of them, with an ellipsis if there are more."""
    lost = expected.select(month).distinct().join(got.select(month).distinct(), month, "left_anti")
    listed = lost.agg(F.array_sort(F.collect_list(month)).alias("m"))
    text = F.concat(F.array_join(F.slice("m", 1, show), ", "), F.when(F.size("m") > show, F.lit(", ...")).otherwise(F.lit("")))
    return listed.select(F.size("m").cast("long").alias("n_missing"), text.alias("missing"))


def years_with_data(obs: DataFrame, stations: DataFrame, station: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Calendar years with a value for every station, zero where there is none."""
    n = obs.where(F.col(value).isNotNull()).groupBy(station).agg(F.countDistinct(F.year(ts)).alias("n_years"))
    return stations.select(station).distinct().join(n, station, "left").select(station, F.coalesce("n_years", F.lit(0).cast("long")).alias("n_years"))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Differences of two catalogues: key columns, field (or "row" where one side lacks it), left and right value as text."""
    left = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns])
    right = b.select(*keys, F.lit(True).alias("_b"), *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns])
    both = left.join(right, list(keys), "full_outer")

    def entry(field: Column, x: Column, y: Column) -> Column:
        return F.struct(field.alias("field"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"))

    lone = F.col("_a").isNull() | F.col("_b").isNull()
    row = F.when(lone, entry(F.lit("row"), F.when(F.col("_a"), "present"), F.when(F.col("_b"), "present")))
    fields = [F.when(~lone & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), entry(F.lit(c), F.col(f"_a_{c}"), F.col(f"_b_{c}"))) for c in columns]
    return both.select(*keys, F.explode(F.array_compact(F.array(row, *fields))).alias("d")).select(*keys, "d.field", "d.left_value", "d.right_value")


def first_stations(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in an explicit order; 0 means all."""
    return df.orderBy(*order).limit(n) if n else df


def list_keys(df: DataFrame, n: int, key: str = "obj_key", size: str = "size") -> DataFrame:
    """The first n keys with whole megabytes."""
    return df.orderBy(key).limit(n).select(key, F.expr(f"{size} div 1048576").alias("size_mb"))


def backlog(*folders: DataFrame, name: str = "name") -> DataFrame:
    """Raw names over several folders, each once."""
    out = folders[0].select(name)
    for f in folders[1:]:
        out = out.union(f.select(name))
    return raw_only(out, name).distinct()


def concat_time(*chunks: DataFrame) -> DataFrame:
    """Chunks that abut in time, one after the other; columns that some lack become null."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def union_sensors(tables: dict[str, DataFrame], wanted: Sequence[str]) -> DataFrame:
    """Tables of the wanted sensors in one, with the sensor's name; raises for a sensor that has no table."""
    unknown = sorted(set(wanted) - set(tables))
    if unknown or not wanted:
        raise ValueError(f"unknown sensors: {', '.join(unknown) or 'none wanted'}")
    return concat_time(*[tables[s].withColumn("sensor", F.lit(s)) for s in wanted])
