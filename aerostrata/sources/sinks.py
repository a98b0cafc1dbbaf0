"""Sinks: manifests, cropped granules, monthly grids, panels, surfaces and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_manifest(df: DataFrame, path: str) -> None:
    """CSV with a header row, overwritten by each run."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_cropped(
    df: DataFrame,
    path: str,
    days: tuple[str, str] = ("product", "granule_day"),
    granule: str = "granule_id",
    empty: DataFrame | None = None,
    name: str | None = None,
) -> dict[str, int]:
    """Cropped rows by product and day, each granule once: the number of granules taken and of those that were there already.

    A delivery (the granules of `df` that no earlier delivery has, and those of `empty`, which the area doesn't meet) is
    written aside with a list of its granules, read back, compared, and renamed into place as one folder `delivery=<name>`. So a delivery is
    there as a whole or not at all, one that comes later leaves earlier ones of its day alone, and a repeated one
    changes nothing. A delivery of a given name is made once. Rows are found by `spark.read.parquet(path)`, the list by `delivered`. Where
    the rows have no column `granule`, a day is a granule. One writer at a time; the rename is atomic where the file system's is.
    """
    spark = df.sparkSession
    name = name or uuid.uuid4().hex
    target, aside = f"{path}/delivery={name}", f"{path}/_aside/{name}"
    if exists(spark, target):
        return {"taken": 0, "repeated": 0}
    keys = [*days, *([granule] if granule in df.columns else [])]
    known = delivered(spark, path, df.select(*keys))
    listed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pixels"))
    if empty is not None:
        listed = listed.unionByName(empty.select(*keys).distinct().withColumn("n_pixels", F.lit(0).cast("long"))).groupBy(*keys).agg(F.max("n_pixels").alias("n_pixels"))
    remove(spark, aside)
    try:
        _not_in(listed, known, keys).write.parquet(f"{aside}/_granules")
        fresh = spark.read.schema(listed.schema).parquet(f"{aside}/_granules")
        totals = fresh.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_pixels") > 0).alias("full"), F.sum("n_pixels").alias("rows")).first()
        if totals["full"]:
            rows = df.join(fresh.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi")
            rows.hint("rebalance", *days).write.partitionBy(*days).mode("append").parquet(aside)
            found = spark.read.parquet(aside).count()
            if found != totals["rows"]:
                raise OSError(f"{found} rows of {totals['rows']} could be read back from {aside}")
        if totals["n"] and not rename(spark, aside, target):
            raise OSError(f"{aside} could not be renamed to {target}")
    finally:
        remove(spark, aside)
    return {"taken": totals["n"], "repeated": listed.count() - totals["n"]}


def delivered(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Granules of all deliveries below a path, those without a pixel too, with the columns of `like`; none where there is no delivery.
    Only the deliveries' lists are read."""
    if not glob(spark, f"{path}/delivery=*/_granules"):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(f"{path}/delivery=*/_granules")


def _not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, null ones too, aren't in another table."""
    held = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return df.join(held, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_anti")


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names."""
    fs, place = _hadoop(spark, pattern)
    return [str(x.getPath().toString()) for x in fs.globStatus(place) or ()]


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder."""
    fs, place = _hadoop(spark, path)
    return fs.delete(place, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder; a target that is there already is an error."""
    fs, place = _hadoop(spark, source)
    end = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(end):
        raise OSError(f"{target} is there already")
    return fs.rename(place, end)


def write_monthly(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Grid rows by year and month; only months that are written are replaced."""
    dated = df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))
    _write_partitions(dated, path, "year", "month")


def _write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that are written, leave the others; rebalancing splits a large partition over tasks."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Modelling panel by pollutant; pollutants that aren't written stay."""
    _write_partitions(df, path, "pollutant")


def write_surface(df: DataFrame, path: str, ts: str = "hour") -> None:
    """Exposure surface by pollutant, year and month; months that aren't written stay."""
    _write_partitions(df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)), path, "pollutant", "year", "month")


def write_report(df: DataFrame, path: str, kind: str = "json", one_file_rows: int = 100_000) -> None:
    """Metrics as JSON, importances and comparisons as CSV; in one file where there are at most `one_file_rows` rows, as usual."""
    small = df.limit(one_file_rows + 1).count() <= one_file_rows
    out = (df.coalesce(1) if small else df).write.mode("overwrite")
    out.json(path) if kind == "json" else out.option("header", True).csv(path)
