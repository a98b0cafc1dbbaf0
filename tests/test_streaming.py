"""Streams give what batches give, once."""

from pyspark.sql import functions as F

from aerostrata.operators import aggregate, crop
from aerostrata.plans.fixtures import fixture
from aerostrata.streaming import ingest

DIR = "/root/testdata/sf0.001"


def landed(swath, folder, prefix=""):
    """Write each granule as one file of a folder."""
    import shutil

    swath.withColumn("g", F.col("granule_id")).repartition(1).write.partitionBy("g").parquet(str(folder) + "_parts" + prefix)
    folder.mkdir(exist_ok=True)
    for path in sorted(folder.parent.glob(f"{folder.name}_parts{prefix}/g=*/*.parquet")):
        shutil.copy(path, folder / f"{prefix}{path.parent.name[2:]}.parquet")


def test_ingest_takes_a_granule_once_and_whole(spark, tmp_path):
    """A granule that comes again under another name, in two files or with bad rows."""
    kind = "granule_id int, scanline int, ground_pixel int, lon double, lat double, ts timestamp_ntz, value double"
    rows = [(g, s, p, -70.0 - g * 0.1, -30.0, None, 1.0) for g in (1, 2, 3) for s in range(3) for p in range(3)]
    rows += [(4, 0, 0, 10.0, 10.0, None, 1.0), (5, 0, 0, None, -30.0, None, 1.0), (3, 9, 9, None, None, None, 1.0)]
    swath = spark.createDataFrame(rows, kind)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        ingest.ingest_stream(spark, str(tmp_path / "landing"), out, check, swath.schema, files=9).awaitTermination()
        return {(r.granule_id, r.status): r.n_bad for r in spark.read.parquet(out + "/ledger").collect()}

    landed(swath.where("granule_id <> 2"), tmp_path / "landing")
    spark.createDataFrame([(None, 0, 0, -70.0, -30.0, None, 1.0)], kind).coalesce(1).write.parquet(str(tmp_path / "nameless"))
    for path in (tmp_path / "nameless").glob("*.parquet"):
        path.rename(tmp_path / "landing" / "nameless.parquet")
    assert run() == {(1, "done"): 0, (3, "done"): 1, (4, "empty"): 0, (5, "bad"): 1, (None, "bad"): 1}
    before = spark.read.parquet(out + "/pixels").count()
    assert before == 18
    bad = spark.read.parquet(out + "/quarantine")
    assert sorted((r.granule_id or 0, r.reason) for r in bad.collect()) == [(0, "no granule or place"), (3, "no granule or place"), (5, "no granule or place")]
    landed(swath.where("granule_id = 1"), tmp_path / "landing", "again_")  # the same granule, another file name
    landed(swath.where("granule_id = 2 and scanline < 2"), tmp_path / "landing", "a_")
    landed(swath.where("granule_id = 2 and scanline = 2"), tmp_path / "landing", "b_")  # one granule in two files
    got = run()
    assert got[1, "repeated"] == 0 and got[2, "split"] == 0
    assert spark.read.parquet(out + "/pixels").count() == before
    assert spark.read.parquet(out + "/quarantine").where("reason = 'granule in several files'").count() == 9


def test_ingest_equals_batch_and_restarts(spark, tmp_path):
    swath = fixture(spark, "/root/testdata/sf0.01", "v_swath").where("granule_id < 40")
    # a granule is one file, as in a landing folder
    landed(swath, tmp_path / "landing")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.ingest_stream(spark, str(tmp_path / "landing"), out, check, swath.schema, files=3).awaitTermination()
    got = spark.read.parquet(out + "/pixels").drop("batch", "file")
    want = crop.crop_index_box(swath)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert spark.read.parquet(out + "/ledger").count() == 40
    ingest.ingest_stream(spark, str(tmp_path / "landing"), out, check, swath.schema, files=3).awaitTermination()
    assert spark.read.parquet(out + "/pixels").count() == want.count()


def test_hourly_stream_equals_batch(spark, tmp_path):
    obs = fixture(spark, DIR, "v_obs")
    obs.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    q = ingest.comuna_hourly_stream(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("hourly_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("hourly_stream").select("pollutant", "comuna", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")
    want = aggregate.comuna_hourly(obs).select("pollutant", "comuna", "hour", "n")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_dedupe(spark, tmp_path):
    swath = fixture(spark, DIR, "v_swath").where("granule_id < 3").dropDuplicates(["granule_id", "scanline", "ground_pixel"])
    swath.write.parquet(str(tmp_path / "in"))
    swath.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(swath.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = ingest.dedupe_granules(stream, late="9000 days").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == swath.count()
