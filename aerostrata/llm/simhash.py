"""SimHash fingerprints and near-duplicate components.

Fingerprints: 64-bit XXH64 values of word shingles, a bit set where it is set in over half of them.

Links (at most `max_bits` differing bits) come from an inverted index over the byte positions of the fingerprints:
at most `max_bits` of the eight bytes can differ, so linked fingerprints share at least 8 - max_bits positional bytes.
A posting is keyed by the bytes at a set of positions; the position sets cover every choice of that many shared bytes,
so a linked pair meets in at least one posting (single bytes would have postings of N / 256 rows and so quadratic
output). Inside a posting the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum are
dropped and the others verified bit by bit. Keys hold three bytes at every size (20 rows a fingerprint, postings of N / 2^24 rows
by chance), so the tally drops the pairs that share those three only; `width` asks for other keys. Of a posting only the
links that its components need are made, most of them to a pivot, so its output grows with its size, not with its square.

Postings of more than HOT fingerprints aren't held in one task: each of their fingerprints emits itself and its variants
with up to max_bits / 2 flipped bits, and those that share a variant are linked through it. Two fingerprints share such
a variant exactly if they differ in max_bits bits or fewer, so no link is lost and none invented, in linear space.
Tables that are joined come from the shared folder, so that the adaptive plan splits a fingerprint or a hub with a large part
of all rows over tasks.

Equal fingerprints are handled once, by their smallest document. Cases: null and empty texts have the fingerprint zero,
linked like any other; a text shorter than a shingle is one shingle; a null doc_id keeps its row and its fingerprint.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import append_columns, partitions, stored, table
from aerostrata.llm.graph import connected_components

HOT = 4096
WIDTH = 3
BAGS = 3
KIND_AT = 40
_HASHES_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = max(1, len(tokens) - words + 1)
    cuts = list(zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _HASHES_AT_ONCE):
        part = cuts[k : k + _HASHES_AT_ONCE]
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in part], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def word_sets_of(text: str | None, seed: int = 42) -> list[int]:
    """BAGS signed 64-bit fingerprints of the set of words of a text, by as many hashes of a word: a changed word is one
    feature of them, but as many as a shingle has words of the shingles."""
    from xxhash import xxh3_128_digest, xxh64_digest

    words = sorted(set((text or "").encode("utf-8", "replace").lower().split()))
    counts = np.zeros(64 * BAGS, np.int64)
    for k in range(0, len(words), _HASHES_AT_ONCE):
        hashes = b"".join([xxh3_128_digest(w, seed) + xxh64_digest(w, seed) for w in words[k : k + _HASHES_AT_ONCE]])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8 * BAGS), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(words), bitorder="little").view("<i8").tolist()


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, seed: int = 42, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds fp (signed 64-bit). A map over the scan, without a shuffle."""
    return append_columns(df, [F.col(text)], [T.StructField("fp", T.LongType())], lambda texts: [[fingerprint_of(t, words, seed) for t in texts]], keep)


@lru_cache
def position_sets(shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that any `shared` of the eight positions hold one of them."""
    if (shared, width) == (4, 3):
        # in a ring of three groups: three positions of a group, or two of a group and one of the next; the fewest possible
        groups = [{0, 1, 2}, {3, 4, 5}, {6, 7}]
        counts = {s: [len(g & set(s)) for g in groups] for s in combinations(range(8), 3)}
        return [s for s, c in counts.items() if 3 in c or any(c[g] == 2 and c[(g + 1) % 3] == 1 for g in range(3))]
    missing = set(combinations(range(8), shared))
    out = []
    while missing:
        best = max(combinations(range(8), width), key=lambda s: sum(set(s) <= set(m) for m in missing))
        out.append(best)
        missing = {m for m in missing if not set(best) <= set(m)}
    return out


def _byte(i: int) -> str:
    return f"(shiftrightunsigned(fp, {8 * i}) & 255L)"


def postings(nodes: DataFrame, shared: int, width: int) -> DataFrame:
    """(key, fp, id) rows of the inverted index over (kind, fp, id); a key tells the kind, shifted by KIND_AT, the positions and the bytes."""
    sets = enumerate(position_sets(shared, width))
    keys = [" + ".join([f"kind * {2**KIND_AT}L + {n * 2**32}L", *(f"shiftleft({_byte(i)}, {8 * k})" for k, i in enumerate(s))]) for n, s in sets]
    return nodes.select(F.expr(f"explode(array({', '.join(keys)}))").alias("key"), "fp", "id")


def _linked(shared: int, max_bits: int) -> str:
    """SQL of the links of one posting `xs`, an array of (fp, id), that give its components.

    All near a pivot are linked to it; each of the rest to the first of those that it is near to. What is near to none of
    them is linked to all of the rest that it is near to. So a pair within max_bits always ends in one component, without a row a pair.
    """
    same = " + ".join(f"int((shiftrightunsigned({{0}}.fp ^ {{1}}.fp, {8 * i}) & 255L) = 0L)" for i in range(8))

    def near(x: str, y: str) -> str:  # the tally of shared bytes first, then the bits
        return f"(({same.format(x, y)}) >= {shared} AND bit_count({x}.fp ^ {y}.fp) <= {max_bits})"

    def let(name: str, value: str, body: str) -> str:
        return f"get(transform(array({value}), {name} -> {body}), 0)"

    lone = f"flatten(transform(filter(rest, t -> t.a IS NULL), t -> transform(filter(rest, u -> u.r.id <> t.r.id AND {near('u.r', 't.r')}), u -> struct(t.r.id AS a, u.r.id AS b))))"
    parts = f"concat(transform(around, x -> struct(p.id AS a, x.id AS b)), transform(filter(rest, t -> t.a IS NOT NULL), t -> struct(t.a.id AS a, t.r.id AS b)), {lone})"
    rest = f"transform(filter(xs, x -> NOT {near('x', 'p')}), r -> struct(r, get(filter(around, y -> {near('y', 'r')}), 0) AS a))"
    return let("p", "get(xs, size(xs) div 2)", let("around", f"filter(xs, x -> x.id <> p.id AND {near('x', 'p')})", let("rest", rest, parts)))


def links_of(nodes: DataFrame, max_bits: int = 4, width: int | None = None, hot: int = HOT) -> DataFrame:
    """Links (a, b) between ids whose components are those of all pairs of (kind, fp, id) within `max_bits` of one kind."""
    if max_bits not in (2, 4):
        raise ValueError("max_bits must be 2 or 4")
    shared, spark = 8 - max_bits, nodes.sparkSession
    width = min(shared, WIDTH) if width is None else width
    index = postings(nodes.repartition(partitions(spark), "fp"), shared, width)
    sizes = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sized = stored(index.join(sizes.hint("merge"), "key"))
    found = sized.where(F.col("n") <= hot).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("fp", "id"))).alias("xs"))
    near = found.select(F.explode(F.expr(_linked(shared, max_bits))).alias("p")).select("p.a", "p.b").distinct()
    crowded = sized.where(F.col("n") > hot).select(F.shiftright("key", KIND_AT).alias("kind"), "fp", "id").distinct()
    if not crowded.limit(1).count():
        return near
    flips = "flatten(transform(sequence(1, 64), i -> transform(sequence(0, i - 1), j -> fp ^ shiftleft(1L, j) ^ if(i = 64, 0L, shiftleft(1L, i)))))"
    if max_bits == 2:
        flips = "transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))"
    spread = crowded.repartition(partitions(spark), "fp")  # a row becomes two thousand
    variants = spread.select("kind", "id", F.expr(f"explode(concat(array(fp), {flips}))").alias("v"))
    hubs = stored(variants.groupBy("kind", "v").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("kind", "v", "a"))
    through = variants.join(hubs.hint("merge"), ["kind", "v"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    return near.union(through)


def links(fps: DataFrame, max_bits: int = 4, width: int | None = None, hot: int = HOT) -> DataFrame:
    """The same for distinct fingerprints `fp` of one kind, as links between fingerprints."""
    return links_of(fps.select(F.lit(0).alias("kind"), "fp", F.col("fp").alias("id")), max_bits, width, hot)


def _classes(marked: DataFrame, max_bits: int) -> DataFrame:
    """(fp, c) of every distinct fingerprint: the smallest fingerprint reachable over links."""
    nodes = stored(marked.select("fp").distinct())
    found = connected_components(links(nodes, max_bits))
    return stored(nodes.join(found.hint("merge"), nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("c")))


def components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links, itself included."""
    marked = stored(fingerprints(df.select(doc_id, text), text, words, keep=[doc_id]))
    classes = _classes(marked, max_bits)
    firsts = marked.groupBy("fp").agg(F.min(doc_id).alias("first"))
    least = stored(firsts.join(classes.hint("merge"), "fp").groupBy("c").agg(F.min("first").alias("component_id")))
    by_fp = stored(classes.join(least.hint("merge"), "c").select("fp", "component_id"))
    return marked.join(by_fp.hint("merge"), "fp").select(doc_id, "fp", "component_id")


def copies(df: DataFrame, key: str, text: str = "text", words: int = 5, max_bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows that a near-duplicate group can do without, by their distinct `key`: the keys that aren't their group's smallest,
    and the keys among the rest that more than one row has.

    Texts are linked by the fingerprint of their shingles and by each of those of their set of words. Copies with a word in
    fifty changed share 0.8 of their five-word shingles and differ in about ten bits of the first, but in about four of each of
    the others, which are independent of one another.
    """
    fields = [T.StructField("v", T.ArrayType(T.LongType()))]
    marked = stored(append_columns(df, [F.col(text)], fields, lambda texts: [[[fingerprint_of(t, words), *word_sets_of(t)] for t in texts]], [key]))
    nodes = stored(marked.select("v").distinct().withColumn("node", F.monotonically_increasing_id()))  # fixed by being written
    each = nodes.select("node", F.posexplode("v").alias("kind", "fp"))
    firsts = stored(each.groupBy("kind", "fp").agg(F.min("node").alias("id")))
    same = each.join(firsts.hint("merge"), ["kind", "fp"]).where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    found = stored(connected_components(same.union(links_of(firsts, max_bits))))
    groups = stored(nodes.join(found.hint("merge"), "node", "left").select("v", F.coalesce("component", "node").alias("g")))
    rows = stored(marked.groupBy("v", key).agg(F.count(F.lit(1)).alias("n")).join(groups.hint("merge"), "v").select(key, "n", "g"))
    keep = stored(rows.groupBy("g").agg(F.min(key).alias("keep")))
    judged = rows.join(keep.hint("merge"), "g")
    return stored(judged.where(F.col(key) != F.col("keep")).select(key).distinct()), stored(judged.where((F.col(key) == F.col("keep")) & (F.col("n") > 1)).select(key).distinct())


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
