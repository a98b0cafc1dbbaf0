"""Streaming ingest of granules and streaming hourly means."""

from __future__ import annotations

import json
import pickle
import re
import uuid
import zlib

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from aerostrata.functions.scalar import CHILE, Bbox
from aerostrata.operators.crop import coverage, crop_index_box, empty_granules
from aerostrata.operators.predicates import split_valid
from aerostrata.sources.sinks import exists, glob, remove, rename


def dedupe_granules(stream: DataFrame, keys: tuple[str, ...] = ("granule_id", "scanline", "ground_pixel"), ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each pixel of a granule once within the watermark, however often its file arrives."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


LEDGER = "granule_id {id}, status string, file string, n_pixels long, n_bad long, batch string"
TABLES = ("pixels", "quarantine", "coverage", "ledger")


def _ledger(spark: SparkSession, out: str, own: str, kind: str) -> DataFrame:
    """Granules that other batches brought to an end; a batch that runs again doesn't see its own entries."""
    schema = LEDGER.format(id=kind)
    if not exists(spark, f"{out}/ledger"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/ledger").where(F.col("batch") != own)


def _named(paths: list[str]) -> dict[str, str]:
    """Paths by the name of their batch."""
    return {m[1]: p for p in paths if (m := re.search(r"/batch=([^/]+)(?:/_SUCCESS)?$", p))}


def _merged(spark: SparkSession, out: str) -> DataFrame:
    """(name, into) of batches whose ledger entries stand in a merged one."""
    if not glob(spark, f"{out}/ledger/_merged/*/_SUCCESS"):
        return spark.createDataFrame([], "name string, into string")
    return spark.read.schema("name string, into string").parquet(f"{out}/ledger/_merged/*")


def sweep(spark: SparkSession, out: str) -> list[str]:
    """Delete what batches left that were killed before their ledger was complete, and name them; and ledgers of batches that were merged.
    For the time before a stream starts."""
    done = set(_named(glob(spark, f"{out}/ledger/batch=*/_SUCCESS")))
    into, merged = _merged(spark, out).collect(), set()  # a row for each batch
    while more := {r["name"] for r in into if r["into"] in done | merged} - merged:  # merged ledgers may have been merged again
        merged |= more
    for name, path in _named(glob(spark, f"{out}/ledger/batch=*")).items():
        if name in merged:
            remove(spark, path)
    left = [(name, p) for t in TABLES for name, p in _named(glob(spark, f"{out}/{t}/batch=*")).items() if name not in done | merged]
    for _, path in left:
        remove(spark, path)
    return sorted({name for name, _ in left})


def compact_ledger(spark: SparkSession, out: str, most: int = 64) -> int:
    """Merge the ledgers of batches into one where they are more than `most`, and tell how many were merged. For the time before a stream starts.

    The last batch of a checkpoint may run again and must not meet its own entries, so it stays by itself. The merged ledger is written
    aside and renamed; what is deleted after that is deleted by the next `sweep` if this one is killed.
    """
    last: dict[str, int] = {}
    found = _named(glob(spark, f"{out}/ledger/batch=*/_SUCCESS"))
    for name in found:
        head, _, epoch = name.rpartition("-")
        if epoch.isdigit():
            last[head] = max(last.get(head, -1), int(epoch))
    old = sorted(n for n in found if n.startswith("merged-") or (n.rpartition("-")[2].isdigit() and int(n.rpartition("-")[2]) < last[n.rpartition("-")[0]]))
    if len(old) <= most:
        return 0
    into = f"merged-{uuid.uuid4().hex}x"
    aside = f"{out}/ledger/_aside/{into}"
    entries = spark.read.parquet(f"{out}/ledger").where(F.col("batch").isin(old)).drop("batch")
    entries.coalesce(max(1, len(old) // 1024)).write.parquet(aside)
    spark.createDataFrame([(n, into) for n in old], "name string, into string").coalesce(1).write.parquet(f"{out}/ledger/_merged/{into}")
    rename(spark, aside, f"{out}/ledger/batch={into}")
    sweep(spark, out)
    return len(old)


def crop_batch(batch: DataFrame, epoch: int | str, out: str, bbox: Bbox = CHILE, file: str = "file", ready: str | None = None) -> None:
    """Crop one micro-batch: pixels, quarantine, coverage and, last, the ledger, each under the batch's own folder, so that a repeated
    batch overwrites itself and one without a complete ledger counts as not run (`sweep`).

    A granule is one file, or with `ready` (a column) the files that were gathered for it: rows where it is false belong to
    a granule that lacked some when its time was over. A granule that the ledger has as done or empty, under whatever file name it comes
    again, is not cropped again but entered as `repeated`; one that comes in several files of a batch, without `ready`, has no index
    box of its own file and goes to the quarantine as `split`, one that isn't ready as `incomplete`. Rows without a granule or a place go
    to the quarantine too, and are counted in the ledger beside their granule (status `bad` where nothing else of it
    is left). Nothing is dropped without an entry.
    """
    batch, own = batch.persist(), str(epoch)
    try:
        rule = F.col("granule_id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
        kind = batch.schema["granule_id"].dataType.simpleString()
        known = _ledger(batch.sparkSession, out, own, kind).where("status in ('done', 'empty')").select("granule_id")
        known = known.join(F.broadcast(batch.select("granule_id").distinct()), "granule_id", "left_semi").distinct().withColumn("_known", F.lit(True))
        many = (F.count_distinct(file) > 1) if ready is None else F.lit(False)
        lacking = F.lit(False) if ready is None else ~F.bool_and(F.coalesce(ready, F.lit(True)))
        state = F.when(F.col("_known"), "repeated").when(F.col("granule_id").isNotNull() & F.col("_split"), "split").when(F.col("n_bad") == F.col("n_pixels"), "bad").when(F.col("_lacking"), "incomplete").otherwise("new")
        files = (
            batch.groupBy("granule_id")
            .agg(many.alias("_split"), lacking.alias("_lacking"), F.min(file).alias("_file"), F.count(F.lit(1)).alias("n_pixels"), F.count_if(~rule).alias("n_bad"))
            .join(known, "granule_id", "left")
            .withColumn("_state", state)
        ).persist()
        marked = batch.join(files.select("granule_id", "_state").where("granule_id is not null"), "granule_id", "left").drop(*([ready] if ready else []))
        good, bad = split_valid(marked.where("_state is null or _state <> 'repeated'"), rule & (F.col("_state") == "new"))
        cropped = crop_index_box(good.drop("_state"), bbox)
        ended = empty_granules(good, bbox).unionByName(cropped.select("granule_id").distinct().withColumn("status", F.lit("done")))
        ledger = files.join(ended, "granule_id", "left").select("granule_id", F.coalesce("status", "_state").alias("status"), F.col("_file").alias("file"), "n_pixels", "n_bad")
        reason = F.when(F.col("_state") == "split", "granule in several files").when(rule & (F.col("_state") == "incomplete"), "granule incomplete").otherwise("no granule or place")
        tables = {"pixels": cropped, "quarantine": bad.withColumn("reason", reason).drop("_state"), "coverage": coverage(cropped), "ledger": ledger}
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={own}")
        files.unpersist()
    finally:
        batch.unpersist()


class Gather(StatefulProcessor):
    """Rows of a granule until its files are all there: state by granule, of the files seen (packed rows), and a timer from the last one.

    A file that comes again replaces itself. With a number of files, a granule is given out once it has so many, complete, or
    incomplete when the time is over; without one it is given out when nothing came for that time.
    """

    def __init__(self, columns: list[str], file: str, parts: str | None, wait_ms: int):
        self.columns, self.file, self.parts, self.wait_ms = columns, file, parts, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file string", "rows binary")
        self.wanted = handle.getValueState("wanted", "parts int, due long")

    def _given(self, ready: bool):
        for _, (packed,) in sorted(self.files.iterator()):
            for row in pickle.loads(zlib.decompress(packed)):
                yield Row(**dict(zip(self.columns, row, strict=True)), ready=ready)

    def _end(self) -> None:
        self.files.clear()
        self.wanted.clear()

    def handleInputRows(self, key, rows, timerValues):
        came: dict = {}
        parts = None
        for row in rows:
            came.setdefault(row[self.file], []).append(tuple(row[c] for c in self.columns))
            if self.parts and row[self.parts] is not None:
                parts = max(parts or 0, row[self.parts])
        for name, held in came.items():
            self.files.updateValue((name or "",), (zlib.compress(pickle.dumps(held), 1),))
        before = self.wanted.get() if self.wanted.exists() else (None, None)
        parts = max(parts or 0, before[0] or 0) or None
        if parts and sum(1 for _ in self.files.keys()) >= parts:
            yield from self._given(True)
            self._end()
        else:
            if before[1]:
                self.handle.deleteTimer(before[1])
            due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(due)
            self.wanted.update((parts, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.wanted.exists() and self.wanted.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            yield from self._given(self.wanted.get()[0] is None)
            self._end()

    def close(self) -> None:
        pass


#: State by granule lives in RocksDB; without batches for no data, a run that takes what is available comes to its end.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def gathered(stream: DataFrame, parts: str | None, wait_ms: int, file: str = "file") -> DataFrame:
    """The stream's rows with `ready`, those of granules in several files held back until all are there.

    Only such rows go through state (all, where no column tells the number of files); those of granules in one file, and
    those without a granule, pass by. A query over it needs the settings STATE, and looks at the time when new files come.
    """
    lone = F.col("granule_id").isNull() | ((F.coalesce(F.col(parts), F.lit(1)) <= 1) if parts else F.lit(False))
    schema = T.StructType([*stream.schema.fields, T.StructField("ready", T.BooleanType())])
    held = stream.where(~lone).groupBy("granule_id").transformWithState(Gather(stream.columns, file, parts, wait_ms), schema, "append", "ProcessingTime")
    return stream.where(lone).withColumn("ready", F.lit(True)).unionByName(held)


def ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, schema, bbox: Bbox = CHILE, files: int = 4, parts: str | None = None, wait_ms: int | None = None) -> StreamingQuery:
    """Process what is new in a landing folder, a few granule files at a time, and stop; safe to start again.

    What was done is known from the ledger in `out`, whatever became of the checkpoint: batches are named by the checkpoint's own
    id and their number, so a new checkpoint, or another landing folder, adds batches of other names and finds granules of
    earlier ones in the ledger. One stream writes to an `out` at a time. With `parts` (a column that tells in how many files a granule
    comes) or `wait_ms` (how long to wait for a file more, by default an hour), granules in several files are gathered over batches.
    """
    sweep(spark, out)
    compact_ledger(spark, out)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing).withColumn("file", F.col("_metadata.file_name"))
    gather = parts is not None or wait_ms is not None
    rows = gathered(source, parts, wait_ms or 3_600_000) if gather else source

    def commit(df: DataFrame, epoch: int) -> None:
        head = "".join(r.value for r in df.sparkSession.read.text(f"{checkpoint}/metadata").collect())  # one line
        crop_batch(df, f"{json.loads(head)['id']}-{epoch}", out, bbox, ready="ready" if gather else None)

    before = {k: spark.conf.get(k) for k in STATE} if gather else {}
    try:
        for k in before:
            spark.conf.set(k, STATE[k])  # the query takes the session's settings when it starts
        return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def comuna_hourly_stream(stream: DataFrame, late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Hourly mean by pollutant and comuna over a stream; rows later than the watermark are dropped."""
    timed = stream.where(F.col("value").isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy("pollutant", "comuna", F.window(ts, "1 hour").alias("w")).agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return grouped.select("pollutant", "comuna", F.col("w.start").alias("hour"), "mean_value", "n")
