"""Mixing sources to target weights by pivotal dependent rounding.

Targets: every source has a weight (5, 2, 1, repeating, by code point, a null source last) and the sources share `share` times all
words; a source is read at most `most` times, and what it can't give is shared again by weight among the others. So a
document of a source is due target / source_size times, a whole number and a fraction.

Fractions become zero or one in pairs. A pair moves words (fraction times size) from one document to the other until
one of both is whole; which way is drawn so that both keep their expectation. The pair's words stay what they were, and so
do the source's. A document left over meets the next one; the last one of a source is rounded to the nearer side.

How it spreads: a source is dealt into blocks of about `block` rows by a hash of id and size, however large it is. A task walks
through its blocks in order of falling size, one row at a time, and no block is held; the one document that a block leaves
over is a small one. Leftovers go up a reduction tree, `fan` blocks a node, until a source has one. So the words of a source
miss its target by half of that one document at most: a small one as a rule, from the end of the size order.
Draws are hashes of seed, source, node and place, so reruns agree whatever the number of tasks.

Cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own; a source without words has target
0; null or repeated ids stay rows of their own (rows equal in id, source and size can't be told apart, their copies are the
same in sum); no rows give none. Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import Stored, partitions, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 1_000
FAN = 64
#: Share of a document from which its fraction counts as whole: rounding errors of the transfers.
WHOLE = 1e-9


def words_of(text: str | Column) -> Column:
    """Number of words: maximal runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sources_of(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, n, weight) of every source, ranked without a window over all of them: they are sorted by ranges, and a
    row's place is its place within its range behind the rows of earlier ranges."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranged = totals.repartitionByRange(partitions(sized.sparkSession), F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1)
    before, offsets = 0, {}
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each shuffle partition
        offsets[r["part"]] = before
        before += r["count"]
    start = F.element_at(F.array(*[F.lit(offsets.get(i, 0)).cast("long") for i in range(max(offsets, default=0) + 1)]), (part + 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(start + row, F.lit(len(weights))) + 1).cast("int"))
    return placed.select("source", "source_size", "n", weight.alias("weight"))


def with_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target: words are shared by weight; sources above `most` times their size stop there and the rest is shared again
    until none is above. A round is one sum over the sources (a stored table)."""
    every = F.sum("source_size").alias("words")
    words = (sources.agg(every).first()["words"] or 0) * share
    cap, level, stopped = F.col("source_size") * F.lit(most), 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        r = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("source_size"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if r["n"] == stopped or not r["w"]:
            break
        stopped, level = r["n"], (words - most * (r["full"] or 0)) / r["w"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def _pivot(batches: Iterator[pa.RecordBatch], schema: T.StructType, level: int, last: bool, seed: int) -> Iterator[pa.RecordBatch]:
    """Rounds fractions in the order of the rows, which come by source and node.

    Every row leaves with its copies and, where it is a node's leftover, its fraction; in the last round leftovers are rounded.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from xxhash import xxh64_intdigest

    arrow = to_arrow_schema(schema)
    at_source, at_node, at_size, at_copies, at_part = (schema.fieldNames().index(c) for c in ("source", "node", "size", "copies", "part"))
    group, carried, place = None, None, 0

    def draw() -> float:
        return xxh64_intdigest(repr((level, group, place)).encode("utf-8", "surrogatepass"), seed) / 2**64

    def settle(row: list, part: float) -> bool:
        """Whether a row is whole with this fraction."""
        if WHOLE < part < 1 - WHOLE:
            row[at_part] = part
            return False
        row[at_copies] += round(part)
        row[at_part] = 0.0
        return True

    def close(out: list) -> None:
        nonlocal carried
        if carried is not None:
            if last:
                settle(carried, float(carried[at_part] > 0.5 or carried[at_part] == 0.5 and draw() < 0.5))
            out.append(carried)
        carried = None

    def table_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    for batch in batches:
        out: list = []
        for row in map(list, zip(*[c.to_pylist() for c in batch.columns], strict=True)):
            if (row[at_source], row[at_node]) != group:
                close(out)
                group, place = (row[at_source], row[at_node]), 0
            place += 1
            if carried is None:
                carried = row
                continue
            size, other = carried[at_size], row[at_size]
            mine, yours = carried[at_part] * size, row[at_part] * other
            up, down = min(size - mine, yours), min(mine, other - yours)  # words that the carried one can take or give
            moved = up if draw() * (up + down) < down else -down
            done = settle(carried, (mine + moved) / size), settle(row, (yours - moved) / other)
            out += [r for r, d in zip((carried, row), done, strict=True) if d]
            carried = None if all(done) else row if done[0] else carried
        if out:
            yield table_of(out)
    out = []
    close(out)
    if out:
        yield table_of(out)


def round_copies(due: DataFrame, block: int = BLOCK, fan: int = FAN, seed: int = 42) -> DataFrame:
    """Whole copies for rows (doc_id, source, size, n, rate, ...): n is the source's number of rows, rate the copies due. Adds copies."""
    whole = F.floor("rate").cast("long")
    due = due.withColumn("copies", whole).withColumn("part", F.col("rate") - whole)
    due = due.withColumn("copies", F.when(F.col("part") > 1 - WHOLE, whole + 1).otherwise(whole))
    open_ = (F.col("size") > 0) & F.col("part").between(WHOLE, 1 - WHOLE)
    out = due.where(~open_)
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    rest = due.where(open_).withColumn("node", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), blocks))
    most = rest.agg(F.max(blocks).alias("m")).first()["m"] or 0
    level, spark, names = 0, due.sparkSession, due.columns
    while most:
        last = most == 1
        order = ["source", "node", F.desc("size"), F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
        dealt = rest.repartition(partitions(spark), "source", "node").sortWithinPartitions(*order)
        schema = rest.schema
        run = stored(dealt.mapInArrow(lambda batches, schema=schema, level=level, last=last: _pivot(batches, schema, level, last, seed), schema))
        out = out.unionByName(run.where("part = 0").select(*names))
        rest = run.where("part > 0").withColumn("node", F.floor(F.col("node") / fan))
        level, most = level + 1, 0 if last else -(-most // fan)
    return out


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, fan: int = FAN, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row. Texts are read once, to be counted."""
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(text).alias("size")))
    known = stored(with_targets(sources_of(sized, weights), share, most))
    due = sized.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    due = due.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rounded = round_copies(due, block, fan, seed)
    return rounded.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each row of `docs` as often as its copies say, with a column `copy` from 0. Ids must be unique and not null."""
    plan = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    joined = docs.join(plan, F.col(doc_id) == F.col("_id"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
