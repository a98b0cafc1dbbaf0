"""Crop operators of swaths and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerostrata.functions.scalar import CHILE, Bbox, finite
from aerostrata.operators.predicates import inside, within_bbox


def index_boxes(df: DataFrame, bbox: Bbox = CHILE, granule: str = "granule_id") -> DataFrame:
    """Least and greatest scanline and ground pixel of the pixels inside the area, a row per granule that has any."""
    return (
        within_bbox(df, bbox)
        .groupBy(granule)
        .agg(F.min("scanline").alias("s_lo"), F.max("scanline").alias("s_hi"), F.min("ground_pixel").alias("p_lo"), F.max("ground_pixel").alias("p_hi"))
    )


def crop_index_box(df: DataFrame, bbox: Bbox = CHILE, granule: str = "granule_id") -> DataFrame:
    """Every pixel of a granule's index box, also those of the box that lie outside the area; all columns are kept."""
    cut = df.join(index_boxes(df, bbox, granule), granule)
    return cut.where(F.col("scanline").between(F.col("s_lo"), F.col("s_hi")) & F.col("ground_pixel").between(F.col("p_lo"), F.col("p_hi"))).select(*df.columns)


def crop_grid(df: DataFrame, bbox: Bbox = CHILE) -> DataFrame:
    """Cells of a regular grid inside the area, edges included."""
    return within_bbox(df, bbox)


def empty_granules(df: DataFrame, bbox: Bbox = CHILE, granule: str = "granule_id") -> DataFrame:
    """Granules without a pixel inside, as ledger rows."""
    any_inside = df.groupBy(granule).agg(F.max(F.coalesce(inside(bbox), F.lit(False))).alias("hit"))
    return any_inside.where(~F.col("hit")).select(granule, F.lit("empty").alias("status"))


def coverage(df: DataFrame, granule: str = "granule_id", ts: str = "ts", order: tuple[str, ...] = ("scanline", "ground_pixel")) -> DataFrame:
    """Extent of the finite coordinates, and the first and last time in array order (not the least and greatest)."""
    place = F.struct(*order, ts)
    return df.groupBy(granule).agg(
        F.min(finite("lat")).alias("lat_min"),
        F.max(finite("lat")).alias("lat_max"),
        F.min(finite("lon")).alias("lon_min"),
        F.max(finite("lon")).alias("lon_max"),
        F.min_by(ts, place).alias("time_start"),
        F.max_by(ts, place).alias("time_end"),
    )


def with_history(covered: DataFrame, metadata: DataFrame, line: str, granule: str = "granule_id", history: str = "history") -> DataFrame:
    """Coverage beside the granule's own metadata, which stay as they are (orbit statistics are those of the whole orbit) but for
    the history, which gets a line more."""
    joined = covered.join(metadata, granule, "left")
    return joined.withColumn(history, F.concat_ws("\n", F.nullif(F.col(history), F.lit("")), F.lit(line)))


def crop_ratio(before: DataFrame, after: DataFrame, granule: str = "granule_id") -> DataFrame:
    """Pixels of each granule before and after a crop, and the share kept."""
    n, m = before.groupBy(granule).agg(F.count(F.lit(1)).alias("pixels")), after.groupBy(granule).agg(F.count(F.lit(1)).alias("kept"))
    out = n.join(m, granule, "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    return out.withColumn("share", F.col("kept") / F.col("pixels"))
