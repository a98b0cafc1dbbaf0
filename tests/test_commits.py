"""Granules are written once and whole, whatever is killed, repeated or started anew."""

import time

import pytest
from pyspark.sql import functions as F

from aerostrata.sources import sinks
from aerostrata.streaming import ingest

SWATH = "granule_id int, scanline int, ground_pixel int, lon double, lat double, ts timestamp_ntz, value double"


def granules(spark, *names, size=3):
    rows = [("no2", "2020-01-01", g, i, float(i)) for g in names for i in range(size)]
    return spark.createDataFrame(rows, "product string, granule_day string, granule_id string, scanline int, value double")


def held(spark, path):
    return {(r.granule_id, r.n) for r in spark.read.parquet(path).groupBy("granule_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_a_day_takes_later_granules(spark, tmp_path):
    out = str(tmp_path / "crop")
    assert sinks.write_cropped(granules(spark, "g1"), out) == {"taken": 1, "repeated": 0}
    assert sinks.write_cropped(granules(spark, "g2", "g1", size=5), out) == {"taken": 1, "repeated": 1}
    assert held(spark, out) == {("g1", 3), ("g2", 5)}
    days = granules(spark, "g3").withColumn("granule_day", F.lit("2020-01-02")).unionByName(granules(spark, None))
    sinks.write_cropped(days, out, empty=granules(spark, "g4"))
    sinks.write_cropped(granules(spark, None, "g4"), out)  # a null name and a granule that the area doesn't meet are known, too
    assert held(spark, out) == {("g1", 3), ("g2", 5), ("g3", 3), (None, 3)}
    assert spark.read.parquet(out).where("granule_day = '2020-01-02'").count() == 3
    assert {r.granule_id for r in sinks.delivered(spark, out, granules(spark).select("granule_id")).collect()} == {"g1", "g2", "g3", "g4", None}


def test_a_repeated_delivery_changes_nothing(spark, tmp_path):
    out = tmp_path / "crop"
    sinks.write_cropped(granules(spark, "g1", "g2"), str(out), name="first")
    before = sorted(p.relative_to(out) for p in out.rglob("*"))
    assert sinks.write_cropped(granules(spark, "g1", "g2"), str(out)) == {"taken": 0, "repeated": 2}
    assert sinks.write_cropped(granules(spark, "g3"), str(out), name="first") == {"taken": 0, "repeated": 0}
    assert sinks.write_cropped(granules(spark), str(out)) == {"taken": 0, "repeated": 0}
    assert sorted(p.relative_to(out) for p in out.rglob("*") if "_aside" not in p.parts) == [p for p in before if "_aside" not in p.parts]


@pytest.mark.parametrize("when", ["writing", "renaming"])
def test_a_killed_write_leaves_the_old_state(spark, tmp_path, monkeypatch, when):
    out = str(tmp_path / "crop")
    sinks.write_cropped(granules(spark, "g1"), out)
    with monkeypatch.context() as m:
        if when == "writing":
            broken = granules(spark, "g2").withColumn("value", F.when(F.col("scanline") == 2, F.raise_error(F.lit("power cut"))).otherwise(F.col("value")))
        else:
            broken = granules(spark, "g2")
            m.setattr(sinks, "remove", lambda *a: False)  # a killed process doesn't clean up

            def cut(*a):
                raise KeyboardInterrupt

            m.setattr(sinks, "rename", cut)
        with pytest.raises((Exception, KeyboardInterrupt)):
            sinks.write_cropped(broken, out)
    assert held(spark, out) == {("g1", 3)}
    assert sinks.write_cropped(granules(spark, "g1", "g2"), out) == {"taken": 1, "repeated": 1}
    assert held(spark, out) == {("g1", 3), ("g2", 3)}


def rows_of(*names, size=3):
    return [(g, s, p, -70.0 - g * 0.1, -30.0, None, None if p == 1 else 1.0) for g in names for s in range(size) for p in range(size)]


def land(spark, folder, name, rows, schema=SWATH):
    """One file in a landing folder."""
    folder.mkdir(exist_ok=True)
    tmp = folder.parent / f"_{folder.name}_{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp))
    next(tmp.glob("*.parquet")).rename(folder / f"{name}.parquet")


def run(spark, tmp_path, landing="landing", check="check", schema=SWATH, **more):
    out = str(tmp_path / "out")
    ingest.ingest_stream(spark, str(tmp_path / landing), out, str(tmp_path / check), schema, **more).awaitTermination()
    ledger = sorted((r.granule_id or 0, r.status) for r in spark.read.parquet(out + "/ledger").collect())
    pixels = {(r.granule_id, r.n) for r in spark.read.parquet(out + "/pixels").groupBy("granule_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    return ledger, pixels


def test_a_new_checkpoint_or_landing_folder_keeps_what_is_there(spark, tmp_path):
    land(spark, tmp_path / "landing", "a", rows_of(1))
    assert run(spark, tmp_path) == ([(1, "done")], {(1, 9)})
    land(spark, tmp_path / "landing", "b", rows_of(2))
    ledger, pixels = run(spark, tmp_path, check="anew")  # reads a and b again, as its batch 0
    assert ledger == [(1, "done"), (1, "repeated"), (2, "done")] and pixels == {(1, 9), (2, 9)}
    land(spark, tmp_path / "second", "a", rows_of(2, 3))
    ledger, pixels = run(spark, tmp_path, landing="second", check="third")
    assert ledger == [(1, "done"), (1, "repeated"), (2, "done"), (2, "repeated"), (3, "done")] and pixels == {(1, 9), (2, 9), (3, 9)}


def test_a_batch_that_was_killed_is_swept_and_run_again(spark, tmp_path, monkeypatch):
    land(spark, tmp_path / "landing", "a", rows_of(1))
    run(spark, tmp_path)
    land(spark, tmp_path / "landing", "b", rows_of(2))
    with monkeypatch.context() as m:
        m.setattr(ingest, "coverage", lambda df: df.select(F.raise_error(F.lit("power cut"))))
        with pytest.raises(Exception, match="power cut"):
            run(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out" / "pixels")).where("granule_id = 2").count() == 9  # left behind
    ledger, pixels = run(spark, tmp_path, check="anew")
    assert pixels == {(1, 9), (2, 9)} and (2, "done") in ledger
    assert ingest.sweep(spark, str(tmp_path / "out")) == []


def test_a_merged_ledger_says_the_same(spark, tmp_path, monkeypatch):
    """Also where the old folders outlive a killed merge; the last batch of a checkpoint stays, as it may run again."""
    out = str(tmp_path / "out")
    for k in range(4):
        land(spark, tmp_path / "landing", f"f{k}", rows_of(k))
    before = run(spark, tmp_path, files=1)
    with monkeypatch.context() as m:
        m.setattr(ingest, "remove", lambda *a: False)
        assert ingest.compact_ledger(spark, out, most=1) == 3
    assert len(list((tmp_path / "out" / "ledger").glob("batch=*"))) == 5
    assert ingest.sweep(spark, out) == []  # nothing of the merged batches goes but their ledgers
    assert len(list((tmp_path / "out" / "ledger").glob("batch=*"))) == 2
    assert ingest.compact_ledger(spark, out, most=1) == 0
    assert ingest.compact_ledger(spark, out, most=0) == 1 and ingest.sweep(spark, out) == []  # once more
    assert run(spark, tmp_path, files=1) == before
    ledger, pixels = run(spark, tmp_path, check="anew")
    assert pixels == before[1] and ledger == sorted(before[0] + [(k, "repeated") for k in range(4)])


def test_parts_of_a_granule_are_joined_over_batches(spark, tmp_path):
    schema = SWATH + ", parts int"
    part = lambda rows, n: [(*r, n) for r in rows]
    land(spark, tmp_path / "landing", "1a", part(rows_of(1)[:4], 2), schema)
    land(spark, tmp_path / "landing", "2", part(rows_of(2), 1), schema)
    land(spark, tmp_path / "landing", "3a", part(rows_of(3)[:5], 3), schema)
    more = {"schema": schema, "parts": "parts", "wait_ms": 3_600_000, "files": 1}
    assert run(spark, tmp_path, **more) == ([(2, "done")], {(2, 9)})
    land(spark, tmp_path / "landing", "1b", part(rows_of(1)[4:], 2), schema)
    land(spark, tmp_path / "landing", "3b", part(rows_of(3)[5:7], 3), schema)
    ledger, pixels = run(spark, tmp_path, **more)
    assert ledger == [(1, "done"), (2, "done")] and pixels == {(1, 9), (2, 9)}
    whole = spark.read.parquet(str(tmp_path / "out" / "pixels")).where("granule_id = 1")
    assert sorted((r.scanline, r.ground_pixel, r.value) for r in whole.collect()) == [(s, p, None if p == 1 else 1.0) for s in range(3) for p in range(3)]
    assert not (tmp_path / "out" / "quarantine").exists() or spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 0


def test_a_granule_without_all_its_files_is_given_up(spark, tmp_path):
    schema = SWATH + ", parts int"
    land(spark, tmp_path / "landing", "1a", [(*r, 2) for r in rows_of(1)[:4]], schema)
    land(spark, tmp_path / "landing", "2", [(*r, None) for r in rows_of(2)] + [(None, 0, 0, -70.0, -30.0, None, 1.0, 2)], schema)
    more = {"schema": schema, "parts": "parts", "wait_ms": 1}
    run(spark, tmp_path, **more)
    time.sleep(0.1)
    land(spark, tmp_path / "landing", "3", [(*r, 1) for r in rows_of(3)], schema)
    run(spark, tmp_path, **more)
    ledger = {(r.granule_id, r.status) for r in spark.read.parquet(str(tmp_path / "out" / "ledger")).collect()}
    assert ledger == {(1, "incomplete"), (2, "done"), (3, "done"), (None, "bad")}
    assert {(r.granule_id, r.reason) for r in spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()} == {(1, "granule incomplete"), (None, "no granule or place")}


def test_granules_of_unknown_size_wait_for_silence(spark, tmp_path):
    land(spark, tmp_path / "landing", "1a", rows_of(1)[:4])
    land(spark, tmp_path / "landing", "1b", rows_of(1)[4:])
    land(spark, tmp_path / "landing", "1c", rows_of(1)[4:])  # the same rows under another name are rows of their own
    run_with = {"wait_ms": 1, "files": 1}
    ingest.ingest_stream(spark, str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "check"), SWATH, wait_ms=600_000, files=1).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "ledger")).count() == 0
    land(spark, tmp_path / "second", "1", rows_of(1))
    land(spark, tmp_path / "second", "2", rows_of(2))
    ingest.ingest_stream(spark, str(tmp_path / "second"), str(tmp_path / "out"), str(tmp_path / "other"), SWATH, **run_with).awaitTermination()
    time.sleep(0.1)
    land(spark, tmp_path / "second", "3", rows_of(3))
    ledger, pixels = run(spark, tmp_path, landing="second", check="other", **run_with)
    assert (1, "done") in ledger and (2, "done") in ledger and {(1, 9), (2, 9)} <= pixels
