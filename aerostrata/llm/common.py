"""Helpers shared by the corpus operators: Arrow column mapping, table access, intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text handled at once inside a task, so that memory does not follow the batch size.
BLOCK_CHARS = 2_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z become a-z, every other character stays."""
    return F.translate(col, UPPER, LOWER)


def clear_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns whose names (in any case) the operator is about to produce."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A column name, like `name`, that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, gone: DataFrame, key: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows of `df` whose key isn't in `gone` (one column `key`, distinct, stored): a broadcast of what was counted to be
    at most `broadcast_rows` keys, so that texts stay where they are, else a merge join."""
    small = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(gone) if small else gone.hint("merge"), key, "left_anti")


def blocks(batch: pa.RecordBatch, weigh: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose columns `weigh` hold about BLOCK_CHARS bytes at most (a longer single row stays whole)."""
    if batch.num_rows == 0:
        return
    size = sum(batch.column(i).nbytes for i in weigh)
    if size <= BLOCK_CHARS:
        yield batch
    elif batch.num_rows == 1:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from blocks(batch.slice(0, half), weigh)
        yield from blocks(batch.slice(half), weigh)


def append_columns(
    df: DataFrame,
    inputs: Sequence[Column],
    fields: Sequence[T.StructField],
    fn: Callable[..., Sequence[Sequence]],
    keep: Sequence[str] | None = None,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Rows of `df` with new columns that `fn` computes from whole columns of values.

    `fn` gets one Python list per input and returns one sequence per field.
    `done` is called when a task ends. Columns of `df` named as a field are replaced. Runs as mapInArrow, without a shuffle.
    """
    names = [f.name for f in fields]
    base = df if keep is None else df.select(*[F.col(f"`{c}`") for c in keep])
    kept = clear_of(base, names).columns
    n = len(kept)
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        try:
            for batch in batches:
                for part in blocks(batch, range(n, batch.num_columns)):
                    got = fn(*[part.column(i).to_pylist() for i in range(n, part.num_columns)])
                    fresh = [x.cast(arrow.field(n + i).type) if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(n + i).type) for i, x in enumerate(got)]
                    held = [part.column(i) if part.column(i).type == arrow.field(i).type else part.column(i).cast(arrow.field(i).type) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([*held, *fresh], schema=arrow)
        finally:
            if done is not None:
                done()

    return source.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, seen by all machines: the one that spark.checkpoint.dir names.

    Where it is unset, a local master (as in tests) gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        configured = context.getConf().get("spark.checkpoint.dir", None)
        if configured is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="aerostrata-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


class Stored:
    """A table written as Parquet into the shared folder: its lineage is cut, and a lost executor only reads it again."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; for tables that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The table after a round through the shared folder."""
    return Stored(df).df


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session, for repartitions that must not be coalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
