"""Token ids packed into fixed-length binary rows.

Texts become ids of a byte-level BPE vocabulary, each document ended by an end id. Documents longer than a row are
split into pieces of the row length, without loss. Pieces are packed by best-fit decreasing: longest first, each into
the open row with the least remaining capacity that still holds it, found by a segment tree over capacities.

Packing runs in blocks of about `block_tokens` tokens inside a task, so memory is bounded and nothing is shuffled;
a block fills its rows but for the last few, which costs less than a row in a thousand at the default size.

A row is an id matrix line: `ids` (little-endian uint16, or uint32 for large vocabularies, padded with the end id to
`seq_len`), `cu_seqlens` (cumulative segment lengths from 0), `resets` (offsets at which positions start again at 0),
and the document, its row key and the piece of each segment, from which every document can be put together again, also where ids
are null or repeated. Row keys and pack_ids number the rows of a partition; they, and which documents share a row, depend on
how the input is split, the ids of a document don't.

`save` writes the matrix and a segment table as Parquet, `load` reads the matrix back.

Cases: a null or empty text is its end id alone; equal lengths are taken in the order of doc_id, row and piece; a null doc_id
stays null in `doc_ids`; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import blocks, table

class ByteBpe:
    """Ids of a rank file."""

    def __init__(self, data: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end_id = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end_id < 1 << 16 else "<u4")

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        code = "H" if self.dtype.itemsize == 2 else "I"
        return [np.frombuffer(array(code, [*self.bpe.encode_ordinary(t or ""), self.end_id]), self.dtype) for t in texts]


@lru_cache(maxsize=2)
def _bpe(data: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(data, pattern)


class Capacities:
    """Open rows by remaining capacity; a segment tree of counts finds the least capacity that fits."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) with the least capacity of at least `need`, removed; None if there is none."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return capacity, row


def best_fit_decreasing(lengths: Sequence[int], seq_len: int) -> list[list[int]]:
    """Rows of item indices; lengths are at most seq_len and items of equal length keep their order."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    open_rows, rows = Capacities(seq_len), []
    for i in order.tolist():
        need = int(lengths[i])
        got = open_rows.take(need)
        if got is None:
            got = (seq_len, len(rows))
            rows.append([])
        rows[got[1]].append(i)
        if got[0] > need:
            open_rows.put(got[0] - need, got[1])
    return rows


def pack_block(docs: Sequence[tuple], seq_len: int, end_id: int, dtype: np.dtype) -> Iterator[tuple]:
    """Packed rows of (doc_id, row, ids) triples: ids, n_tokens, cu_seqlens, resets, doc_ids, rows, pieces."""
    segments = [(d, r, k // seq_len, ids[k : k + seq_len]) for d, r, ids in docs for k in range(0, len(ids), seq_len)]
    segments.sort(key=lambda s: (s[0] is None, s[0] if s[0] is not None else 0, s[1], s[2]))
    for row in best_fit_decreasing([len(s[3]) for s in segments], seq_len):
        line = np.full(seq_len, end_id, dtype)
        cu = [0]
        for i in row:
            ids = segments[i][3]
            line[cu[-1] : cu[-1] + len(ids)] = ids
            cu.append(cu[-1] + len(ids))
        yield line.tobytes(), cu[-1], cu, cu[:-1], *[[segments[i][k] for i in row] for k in range(3)]


def pack(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", seq_len: int = 2048, block_tokens: int = 4_000_000, ranks: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Packed rows of all documents: pack_id, ids, n_tokens, cu_seqlens, resets, doc_ids, rows, pieces."""
    if ranks is None or pattern is None:
        import public_tokenizers

        ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(ranks, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast((f.read(), pattern))  # the vocabulary, under 1 MB
    schema = T.StructType(
        [
            T.StructField("pack_id", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("resets", T.ArrayType(T.IntegerType())),
            T.StructField("doc_ids", T.ArrayType(T.LongType())),
            T.StructField("rows", T.ArrayType(T.LongType())),
            T.StructField("pieces", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        bpe = _bpe(*sent.value)
        next_id = next_row = TaskContext.get().partitionId() << 40
        held, tokens = [], 0

        def packed(docs):
            nonlocal next_id
            rows = list(pack_block(docs, seq_len, bpe.end_id, bpe.dtype))
            for k in range(0, len(rows), 512):
                part = list(zip(*rows[k : k + 512], strict=True))
                ids = list(range(next_id, next_id + len(part[0])))
                next_id += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([ids, *part], arrow, strict=True)], schema=arrow)

        for batch in batches:
            for part in blocks(batch, [1]):
                for d, ids in zip(part.column(0).to_pylist(), bpe.encode(part.column(1).to_pylist()), strict=True):
                    held.append((d, next_row, ids))
                    next_row += 1
                    tokens += len(ids)
                    if tokens >= block_tokens:
                        yield from packed(held)
                        held, tokens = [], 0
        if held:
            yield from packed(held)

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)


def segments(packed: DataFrame) -> DataFrame:
    """(pack_id, ids, segment, doc_id, row, piece, start, stop) of every segment."""
    ends = F.expr("slice(cu_seqlens, 2, size(cu_seqlens))").alias("stops")
    each = packed.select("pack_id", "ids", F.posexplode(F.arrays_zip("doc_ids", "rows", "pieces", "resets", ends)).alias("segment", "s"))
    return each.select(
        "pack_id", "ids", "segment", F.col("s.doc_ids").alias("doc_id"), F.col("s.rows").alias("row"), F.col("s.pieces").alias("piece"), F.col("s.resets").alias("start"), F.col("s.stops").alias("stop")
    )


def unpack(packed: DataFrame, bytes_per_id: int = 2) -> DataFrame:
    """(doc_id, row, piece, ids as binary) of every segment: the way back, without the padding."""
    part = F.expr(f"substring(ids, start * {bytes_per_id} + 1, (stop - start) * {bytes_per_id})")
    return segments(packed).select("doc_id", "row", "piece", part.alias("ids"))


def save(packed: DataFrame, path: str) -> None:
    """Write `matrix` (a row for each line, for training) and `segments` (where each piece of a document is, for looking up);
    the second is made from the first, so the documents are packed once."""
    packed.write.mode("overwrite").parquet(f"{path}/matrix")
    segments(load(packed.sparkSession, path)).drop("ids").write.mode("overwrite").parquet(f"{path}/segments")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The packed rows that `save` wrote."""
    return spark.read.parquet(f"{path}/matrix")


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2,048 ids."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
