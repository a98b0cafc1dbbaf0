"""Approximate nearest neighbours by a forest of random-projection trees and exact reranking.

Trees split by the hyperplane between two random members of a node, at the median. They are fitted on a bounded
sample (`sample` vectors with the smallest hashed ids); every vector of the table is then put into one leaf of each tree.
Where the table is much larger than the sample, further levels follow below the fitted leaves, with one random
direction per tree and level and a threshold per leaf, so that leaves keep their size at any number of rows.

A query descends all trees through one priority queue, ordered by the sum of the squared margins to the hyperplanes it is
on the wrong side of, and stops after leaves that hold `visits` * n ** `power` vectors (repetitions over trees included), a
shrinking share of the table: 10 * n ** 0.7: 0.39 of it at 50,000 vectors and 0.02 at a billion. Leaves hold at least
`leaf` vectors, and so many more that a query looks at about `probes` of them.

Neighbouring leaves of a tree form buckets of about BUCKET vectors. A task gets a part of a bucket (at most about
BUCKET members, so a leaf that is hotter than the sample showed is split) and a block of at most about QUERY_BLOCK of the
queries that probe that bucket, takes the exact Euclidean distance in double precision to the members of the probed leaves, and
returns the k + 1 best for each query. No pair is a row of its own. A vector is shuffled once for each tree, and again
for every further QUERY_BLOCK queries of its bucket only; the rest of the shuffle is the probes themselves.

Equal vectors are one entry of the index with its `k + 1` smallest ids (more can't be among the k nearest, as ties go
to smaller ids), found with a map-side limit, so a vector that fills a third of the table costs no more than any other.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and those whose length is not the
most frequent one, take no part, neither as queries nor as candidates, nor do rows without an id; fewer candidates than k give fewer rows; empty
tables give no rows; rows with one id and different vectors are different candidates.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import partitions, stored, table

BUCKET = 4096
QUERY_BLOCK = 4096
#: Queries that a task probes the forest with.
ASKED_AT_ONCE = 256


class Tree:
    """One fitted tree in arrays; leaves are numbered, children of inner nodes are >= 0 and leaves ~number."""

    def __init__(self, x: np.ndarray, leaf_size: int, extra: int, rng: np.random.Generator):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.sizes: list[int] = []
        means: list[np.ndarray] = []
        work = [(np.arange(len(x)), -1, 0)]
        self.root = 0
        while work:
            rows, parent, side = work.pop()
            split = self._split(x, rows, rng) if len(rows) > leaf_size else None
            if split is None:
                me = ~len(self.sizes)
                self.sizes.append(len(rows))
                means.append(x[rows].mean(axis=0))
            else:
                normal, offset, right = split
                me = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append([0, 0])
                work += [(rows[~right], me, 0), (rows[right], me, 1)]
            if parent < 0:
                self.root = me
            else:
                self.children[parent][side] = me
        dims = x.shape[1]
        self.normal = np.array(self.normals, np.float64).reshape(-1, dims)
        self.offset = np.array(self.offsets, np.float64)
        self.child = np.array(self.children, np.int64).reshape(-1, 2)
        self.pairs = [tuple(c) for c in self.children]
        self.extra = rng.standard_normal((extra, dims))
        self.extra /= np.linalg.norm(self.extra, axis=1, keepdims=True) if extra else 1
        self.cuts = np.array(means) @ self.extra.T if extra else np.zeros((len(means), 0))
        del self.normals, self.offsets, self.children

    @staticmethod
    def _split(x, rows, rng):
        for _ in range(4):
            a, b = x[rows[rng.choice(len(rows), 2, replace=False)]]
            normal = b - a
            length = np.linalg.norm(normal)
            if length > 0:
                normal = normal / length
                along = x[rows] @ normal
                offset = float(np.median(along))
                right = along > offset
                if right.any() and not right.all():
                    return normal, offset, right
        return None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        node = np.full(len(x), self.root)
        while True:
            inner = np.flatnonzero(node >= 0)
            if not len(inner):
                break
            at = node[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normal[at]) > self.offset[at]
            node[inner] = self.child[at, right.astype(int)]
        leaf = ~node
        for level in range(len(self.extra)):
            leaf = leaf * 2 + (x @ self.extra[level] > self.cuts[~node, level])
        return leaf


class Forest:
    """Trees over a sample of a table of `rows` vectors, and the search through all of them."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        share = max(1.0, rows / max(1, len(sample)))
        size = max(16, int(leaf / share))
        extra = max(0, int(np.ceil(np.log2(size * share / leaf)))) if share > 1 else 0
        self.trees = [Tree(sample, size, extra, rng) for _ in range(trees)]
        self.share = share / 2**extra
        self.leaves = [len(tree.sizes) << extra for tree in self.trees]

    def probes(self, q: np.ndarray, search: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs, nearest first by the squared margins passed, that hold about `search` vectors together."""
        along = [(tree.normal @ q - tree.offset).tolist() for tree in self.trees]
        below = [tree.extra @ q for tree in self.trees]
        queue = [(0.0, t, tree.root, 0, 0) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        out, got = [], 0.0
        while queue and got < search:
            cost, t, node, level, bits = heapq.heappop(queue)
            tree = self.trees[t]
            if node >= 0:
                margin = along[t][node]
                left, right = tree.pairs[node]
                near, far = (right, left) if margin > 0 else (left, right)
                heapq.heappush(queue, (cost, t, near, 0, 0))
                heapq.heappush(queue, (cost + margin * margin, t, far, 0, 0))
            elif level < len(tree.extra):
                margin = float(below[t][level] - tree.cuts[~node, level])
                side = int(margin > 0)
                heapq.heappush(queue, (cost, t, node, level + 1, bits * 2 + side))
                heapq.heappush(queue, (cost + margin * margin, t, node, level + 1, bits * 2 + 1 - side))
            else:
                out.append((t, (~node << level) + bits))
                got += tree.sizes[~node] * self.share
        return out


def usable(vector: str) -> Column:
    """Whether a vector may take part (its length aside)."""
    return F.expr(f"coalesce(size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vector}, x -> x <> 0), false)")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def visited(n: int, visits: float, power: float) -> float:
    """Vectors that a query looks at in an index of n."""
    return visits * n**power


def nearest(
    df: DataFrame,
    queries: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    trees: int = 16,
    leaf: int = 16,
    probes: int = 2048,
    visits: float = 10.0,
    power: float = 0.7,
    sample: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where `queries` holds, itself left out."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), queries.alias("asks")).where(F.col("id").isNotNull() & usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["d"]
    rows = rows.where(F.size("v") == dims)
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("id").cast("array<long>")).alias("ids")))
    n = entries.count()
    picked = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("v").collect()
    search = visited(n, visits, power)
    forest = Forest(np.array([r["v"] for r in picked], np.float64), n, trees, max(leaf, int(search / probes)))
    del picked
    sent = spark.sparkContext.broadcast(forest)  # bounded by the sample
    buckets = -(-n // BUCKET)
    asking = stored(rows.where("asks").groupBy("v").agg(F.min("id").cast("long").alias("q")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), dims)
            found = np.stack([t.leaves(x) for t in sent.value.trees], axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["v", "ids", "leaves"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q in enumerate(_matrix(b.column(0), dims)):
                by: dict[tuple[int, int], list[int]] = {}
                for t, leaf_ in sent.value.probes(q, search):
                    by.setdefault((t, leaf_ * buckets // sent.value.leaves[t]), []).append(leaf_)
                m = len(by)
                columns = [pa.array([k[0] for k in by], pa.int32()), pa.array([k[1] for k in by], pa.int64()), pa.array(list(by.values()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take([i] * m), b.column(1).take([i] * m), *columns], names=["v", "q", "tree", "bucket", "leaves"])

    def rank(members: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if members.num_rows and wanted.num_rows:
            members = members.sort_by("leaf")
            x, leaf_ = _matrix(members["v"].combine_chunks(), dims), members["leaf"].to_numpy()
            first = members["first"].to_numpy()
            for q, v, leaves in zip(wanted["q"].to_pylist(), _matrix(wanted["v"].combine_chunks(), dims), wanted["leaves"].to_pylist(), strict=True):
                leaves = np.sort(np.array(leaves))
                lo, hi = np.searchsorted(leaf_, leaves), np.searchsorted(leaf_, leaves, side="right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
                if len(at):
                    d = np.sqrt(((x[at] - v) ** 2).sum(axis=1))
                    if len(at) > 4 * k:  # ties of the last place stay in
                        near = np.flatnonzero(d <= np.partition(d, k)[k])
                        at, d = at[near], d[near]
                    best = np.lexsort((first[at], d))[: k + 1]
                    out += [(q, int(at[j]), float(d[j])) for j in best]
            ids = members["ids"].combine_chunks().take(pa.array([o[1] for o in out], pa.int64()))
        else:
            ids = pa.array([], pa.list_(pa.int64()))
        return pa.table({"q": pa.array([o[0] for o in out], pa.int64()), "ids": ids, "score": pa.array([o[2] for o in out], pa.float64())})

    vector_type = T.ArrayType(rows.schema["v"].dataType.elementType)
    long_list = T.ArrayType(T.LongType())
    put_schema = T.StructType([T.StructField("v", vector_type), T.StructField("ids", long_list), T.StructField("leaves", long_list)])
    ask_schema = T.StructType(
        [T.StructField("v", vector_type), T.StructField("q", T.LongType()), T.StructField("tree", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("leaves", long_list)]
    )
    totals = F.array(*[F.lit(m) for m in forest.leaves])
    bucket = F.floor(F.col("leaf") * buckets / totals[F.col("tree")]).cast("long")
    index = stored(entries.mapInArrow(put, put_schema))
    asked = max(1, -(-asking.count() // ASKED_AT_ONCE))
    wants = stored(asking.select("v", "q").repartition(max(asked, partitions(spark)), "q").mapInArrow(ask, ask_schema))
    # members of each bucket in parts, queries of each bucket in blocks
    held = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("members"))
    plan = stored(
        held.join(wants.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("asks")), ["tree", "bucket"]).select(
            "tree", "bucket", F.ceil(F.col("members") / (2 * BUCKET)).cast("int").alias("parts"), F.ceil(F.col("asks") / QUERY_BLOCK).cast("int").alias("blocks")
        )
    )
    keys = ["tree", "bucket", "part", "block"]
    spread = max(partitions(spark), trees * buckets // 4)  # a few buckets a task
    members = (
        index.select("v", "ids", F.col("ids")[0].alias("first"), F.posexplode("leaves").alias("tree", "leaf"))
        .withColumn("bucket", bucket)
        .join(plan, ["tree", "bucket"])
        .withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*keys, "leaf", "v", "ids", "first")
        .repartition(spread, *keys)
    )
    probing = (
        wants.join(plan, ["tree", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long"))))
        .select(*keys, "leaves", "v", "q")
        .repartition(spread, *keys)
    )
    found = members.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInArrow(rank, "q long, ids array<long>, score double")
    best = found.groupBy("q", F.col("ids")[0].alias("first"), "score").agg(F.first("ids").alias("ids")).select("q", "score", F.explode("ids").alias("vec_id"))
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    who = rows.where("asks").select(F.col("id").cast("long").alias("query_id"), "v").join(asking, "v").select("query_id", "q")
    own = top.join(who, "q").where("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
