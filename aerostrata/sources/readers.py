"""Sources: station catalogues, series trees, grids, swaths, object listings, static predictors, fixed dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATION_JSON = "region string, estacion string, nombre string, comuna string, lat double, lon double, nombre_region string, param_pm25 string"
STATION_CSV = "region_sinca string, estacion string, nombre string, comuna string, lat double, lon double, n_anios_con_datos int"

#: Parameter code of each pollutant in station requests.
PARAM_CODES = (("pm25", "PM25"), ("pm10", "PM10"), ("so2", "0001"), ("no2", "0003"), ("o3", "0008"), ("co", "0004"))
#: Product, short name, version, pollutant, level, cadence, start of coverage, whether it is cropped here.
PRODUCTS = (
    ("tropomi_no2", "S5P_L2__NO2____HiR", "2", "no2", "swath", "orbit", "2018-04", True),
    ("tropomi_o3", "S5P_L2__O3_TOT_HiR", "2", "o3", "swath", "orbit", "2018-04", True),
    ("tropomi_so2", "S5P_L2__SO2____HiR", "2", "so2", "swath", "orbit", "2018-04", True),
    ("tropomi_co", "S5P_L2__CO_____HiR", "2", "co", "swath", "orbit", "2018-04", True),
    ("omi_no2", "OMNO2d", "004", "no2", "grid", "daily", "2004-10", True),
    ("omi_o3", "OMTO3d", "004", "o3", "grid", "daily", "2004-10", True),
    ("omi_so2", "OMSO2e", "004", "so2", "grid", "daily", "2004-10", True),
    ("mopitt_co", "MOP03J", "10", "co", "grid", "daily", "2000-03", True),
    ("modis_terra", "MOD04_3K", "6.1", "aod", "swath", "granule", None, True),
    ("modis_aqua", "MYD04_3K", "6.1", "aod", "swath", "granule", None, True),
    ("maiac", "MCD19A2", "061", "aod", "grid", "granule", None, True),
    ("merra2_aer", "M2T1NXAER", "5.12.4", "aerosol", "grid", "hourly", "1980-01", True),
    ("cams_eac4", "cams-global-reanalysis-eac4", None, "all", "grid", "3-hourly", "2003-01", False),
    ("geoscf", "aqc_tavg_1hr_g1440x721_v1", None, "all", "grid", "hourly", "2018-01", False),
    ("acag_pm25", "V6GL03", "V6GL03", "pm25", "grid", "annual", None, True),
)


def read_station_config(spark: SparkSession, path: str) -> DataFrame:
    """Station catalogue from a JSON array; codes stay text, a missing name is empty, Infinity is read as such."""
    return spark.read.schema(STATION_JSON).json(path, multiLine=True).withColumn("nombre", F.coalesce("nombre", F.lit("")))


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """Station catalogue from CSV, with the token inf as infinity."""
    return spark.read.schema(STATION_CSV).csv(path, header=True, positiveInf="inf", negativeInf="-inf")


def series_dims(df: DataFrame, path: str = "path") -> DataFrame:
    """Pollutant, resolution, region, station and period from a series path
    <pollutant>/<resolution>/<region>_<station>_<resolution>_<from>_<to>.csv; null where the path has another form."""
    pattern = r"([^/]+)/([^/]+)/([^/_]+)_([^/_]+)_\2_([^/_]+)_([^/_]+)\.csv$"
    names = ("pollutant", "resolution", "region", "station", "date_from", "date_to")
    return df.select("*", *[F.when(F.col(path).rlike(pattern), F.regexp_extract(path, pattern, i + 1)).alias(n) for i, n in enumerate(names)])


def read_series(spark: SparkSession, root: str, schema: str, **options) -> DataFrame:
    """All series files below a folder with the dimensions of their paths; the body's layout is the caller's."""
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(root, **options)
    return series_dims(raw.withColumn("path", F.col("_metadata.file_path")))


def grid_rows(df: DataFrame, lats: str, lons: str, values: str) -> DataFrame:
    """Cells of a regular grid held as axes and a nested array: (lat, lon, value) rows beside the other columns."""
    keep = [c for c in df.columns if c not in (lats, lons, values)]
    by_lat = df.select(*keep, lats, lons, F.posexplode(values).alias("_i", "_row"))
    cells = by_lat.select(*keep, F.get(lats, F.col("_i")).alias("lat"), lons, F.posexplode("_row").alias("_j", "value"))
    return cells.select(*keep, "lat", F.get(lons, F.col("_j")).alias("lon"), "value")


def swath_rows(df: DataFrame, lats: str, lons: str, values: str) -> DataFrame:
    """Pixels of a swath held as nested arrays: (scanline, ground_pixel, lat, lon, value) rows beside the other columns."""
    keep = [c for c in df.columns if c not in (lats, lons, values)]
    lines = df.select(*keep, F.posexplode(F.arrays_zip(F.col(lats).alias("a"), F.col(lons).alias("o"), F.col(values).alias("v"))).alias("scanline", "_l"))
    pixels = lines.select(*keep, "scanline", F.posexplode(F.arrays_zip(F.col("_l.a").alias("lat"), F.col("_l.o").alias("lon"), F.col("_l.v").alias("value"))).alias("ground_pixel", "_p"))
    return pixels.select(*keep, "scanline", "ground_pixel", "_p.lat", "_p.lon", "_p.value")


def read_grid(spark: SparkSession, path: str, product: str) -> DataFrame:
    """A grid product's long rows; partition columns prune."""
    df = spark.read.parquet(path)
    return df.where(F.col("product") == product) if "product" in df.columns else df.withColumn("product", F.lit(product))


def read_swath(spark: SparkSession, path: str) -> DataFrame:
    """Swath pixels as long rows."""
    return spark.read.parquet(path)


def read_static(spark: SparkSession, path: str, predictors: Sequence[str] | None = None, key: str = "comuna") -> DataFrame:
    """Static predictors, one row a comuna: the wanted ones (all if none are named). Raises where a predictor is missing or a
    comuna is repeated, as a join would then repeat the panel's rows."""
    df = spark.read.parquet(path)
    lost = [c for c in (key, *(predictors or ())) if c not in df.columns]
    if lost:
        raise ValueError(f"no column {', '.join(lost)} in {path}")
    twice = [r[0] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"repeated {key}: {', '.join(map(str, twice))}")
    return df if predictors is None else df.select(key, *predictors)


def read_listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(obj_key, size) of the objects below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_replace(F.col("path"), r"^[a-zA-Z0-9]+:/*", "/")
    return files.select(key.alias("obj_key"), F.col("length").alias("size")).where(F.col("obj_key").contains(prefix))


def products(spark: SparkSession) -> DataFrame:
    """The product catalogue."""
    return spark.createDataFrame(PRODUCTS, "product string, short_name string, version string, pollutant string, level string, cadence string, coverage_start string, needs_crop boolean")


def param_codes(spark: SparkSession) -> DataFrame:
    """Parameter codes of the six pollutants."""
    return spark.createDataFrame(PARAM_CODES, "pollutant string, param_code string")
