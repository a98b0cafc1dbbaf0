"""Scalar functions as column expressions: dates, names, lists, sizes, packed values, distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


@dataclass(frozen=True)
class Bbox:
    """Bounding box in degrees, west, south, east, north."""

    west: float
    south: float
    east: float
    north: float

    def as_nwse(self) -> tuple[float, float, float, float]:
        return self.north, self.west, self.south, self.east


#: Default area of interest, continental Chile.
CHILE = Bbox(-76.0, -56.5, -66.0, -17.0)


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def yymmdd(c: Column | str) -> Column:
    """ISO date text or date as yyMMdd text."""
    return F.date_format(F.to_date(c), "yyMMdd")


def unpack(raw: Column, fill: Column, scale: Column, offset: Column) -> Column:
    """Packed value: null at the fill value, else raw * scale + offset."""
    return F.when(~raw.eqNullSafe(fill), raw.cast("double") * scale + offset)


def basename(c: Column | str) -> Column:
    return F.substring_index(c, "/", -1)


def crop_name(c: Column | str) -> Column:
    """Name of the cropped file: .nc becomes .chile.nc, .nc4 .chile.nc4, at the end only; null for other names."""
    base = basename(c)
    return F.when(base.rlike(r"\.nc4?$"), F.regexp_replace(base, r"\.(nc4?)$", ".chile.$1"))


def parse_list(c: Column | str) -> Column:
    """Comma list: trimmed, lower-cased, without empty parts."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def months_between(df: DataFrame, lo: str, hi: str, whole_only: bool = False) -> DataFrame:
    """A row per month from lo to hi: month (its first day) and month_end. `whole_only` leaves out a partial first month."""
    out = df.withColumn("month", F.explode(F.sequence(F.trunc(lo, "MM"), F.col(hi), F.expr("interval 1 month"))))
    out = out.where(F.col("month") >= F.col(lo)) if whole_only else out
    return out.withColumn("month_end", F.last_day("month"))


def day_chunks(df: DataFrame, lo: str, hi: str, days: int = 5) -> DataFrame:
    """A row per chunk of some days from lo to hi, the last one clipped: chunk_start, chunk_end."""
    start = F.explode(F.sequence(F.col(lo), F.col(hi), F.expr(f"interval {days} day")))
    return df.withColumn("chunk_start", start).withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(hi)))


def years_between(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """A row per calendar year touched by lo to hi."""
    return df.withColumn("year", F.explode(F.sequence(F.year(lo), F.year(hi))))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
