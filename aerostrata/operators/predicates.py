"""Filters and checks: area, dates, variables, levels, keys, replies, codes, stations, granules, versions."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerostrata.functions.scalar import CHILE, Bbox, basename


def inside(bbox: Bbox = CHILE, lon: str = "lon", lat: str = "lat") -> Column:
    """Inclusive on all four sides; NaN and null are outside."""
    return F.col(lat).between(bbox.south, bbox.north) & F.col(lon).between(bbox.west, bbox.east)


def within_bbox(df: DataFrame, bbox: Bbox = CHILE, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.where(inside(bbox, lon, lat))


def between_days(df: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    """Days lo to hi (ISO text), both included; pushes down to the scan."""
    kind = df.schema[ts].dataType
    return df.where((F.col(ts) >= F.lit(lo).cast(kind)) & (F.col(ts) < F.date_add(F.lit(hi).cast("date"), 1).cast(kind)))


def resolve_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Each name from the first of its candidates that the table has; names without one are left out with a warning.
    Raises if no name can be resolved."""
    found = {name: next((c for c in options if c in df.columns), None) for name, options in candidates.items()}
    if not any(found.values()):
        raise ValueError(f"none of {sorted(candidates)} is among the columns {df.columns}")
    missing = sorted(name for name, c in found.items() if c is None)
    if missing:
        warnings.warn(f"no column for {', '.join(missing)}", stacklevel=2)
    return df.select(*keep, *[F.col(f"`{c}`").alias(name) for name, c in found.items() if c])


def select_levels(df: DataFrame, level: int | None, hours: Sequence[int], ts: str = "ts", level_column: str = "model_level") -> DataFrame:
    """One model level (None: no such column) and the given hours of the day."""
    out = df.where(F.hour(ts).isin(*hours))
    return out if level is None else out.where(F.col(level_column) == level)


def match_keys(df: DataFrame, version: str, temporal: str = "todo", key: str = "obj_key") -> DataFrame:
    """Keys of a product version that end in .nc and aren't hidden files; `temporal` is todo (all), annual or monthly."""
    low, base = F.lower(F.col(key)), basename(F.col(key))
    ok = low.contains(version.lower()) & low.endswith(".nc") & ~base.startswith("._")
    return df.where(ok if temporal == "todo" else ok & low.contains(temporal))


def is_useful(text: Column) -> Column:
    """Over 400 characters and neither "Sin datos" (as written) nor "no existe" (in any case) in it."""
    return F.coalesce((F.length(text) > 400) & ~text.contains("Sin datos") & ~F.lower(text).contains("no existe"), F.lit(False))


def unknown_codes(df: DataFrame, domain: DataFrame, column: str) -> DataFrame:
    """Distinct codes that the domain lacks."""
    return df.select(column).distinct().join(domain.select(column).distinct(), column, "left_anti")


def require_known(df: DataFrame, domain: DataFrame, column: str) -> DataFrame:
    """The table itself; raises with the offenders if it has codes outside the domain."""
    bad = [r[0] for r in unknown_codes(df, domain, column).orderBy(column).limit(20).collect()]
    if bad:
        raise ValueError(f"unknown {column}: {', '.join(map(str, bad))}")
    return df


def station_quality(df: DataFrame, bbox: Bbox = CHILE, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds quality: missing, not finite, outside or good."""

    def wild(c: str) -> Column:
        return F.isnan(c) | (F.abs(F.col(c)) == float("inf"))

    flag = (
        F.when(F.col(lat).isNull() | F.col(lon).isNull(), "missing").when(wild(lat) | wild(lon), "not finite").when(inside(bbox, lon, lat), "good").otherwise("outside")
    )
    return df.withColumn("quality", flag)


def raw_only(df: DataFrame, name: str = "name") -> DataFrame:
    """Names that aren't crop outputs."""
    return df.where(~F.col(name).contains(".chile."))


def split_valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the rule holds, and the rest (nulls of the rule count as broken)."""
    ok = F.coalesce(rule, F.lit(False))
    return df.where(ok), df.where(~ok)


def select_version(df: DataFrame, version: str, column: str = "version") -> DataFrame:
    """Exact text match; versions are never numbers."""
    return df.where(F.col(column) == F.lit(version))
