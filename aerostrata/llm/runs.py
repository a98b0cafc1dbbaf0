"""Periodic runs of words: maximal repetitions of whole documents, and the documents without their repeats.

A run is a stretch with smallest period q, of length max(min_length, min_exponent * q) or more, that no neighbouring word
extends keeping the period. Method: Ukkonen suffix trees of the words and of their reversal; an Euler tour over each, and range
minima over its depths, so that the longest common extension of any two places, to the right or to the left, takes constant time; every
run has a Lyndon root, which is the longest Lyndon word at its place for one of the two orders of the alphabet, so the longest
Lyndon words of both orders (up to the next smaller suffix, from the ranks of the tree's leaves) are the candidates, extended to both sides.

Only stretches of words that can hold a run get trees: within a run every place has its next `gram` words again, one period on or
back, so a run lies in a stretch of places whose grams occur twice in the document. Grams are compared by hash; equal hashes
of different grams only lengthen a stretch. The stretches of a document, with a separate mark after each, share one pair of trees.

Cases: null, empty and blank texts have no word and no run, and the digests of empty strings; a null id has no place in the hash that
picks rewritten documents, so its document stays as it is; repeated rows give repeated results; the columns of the
result replace those of the input that have their names; no rows give none. Time grows with the number of words,
memory with the longest stretch (about 1 KB a word of it). Spark deals out documents; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import append_columns, table

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Entries of an Euler tour in one block of the range minima.
BLOCK = 16
_MIX = 0x9E3779B97F4A7C15


class Extensions:
    """Longest common extensions of a sequence of positive ints, to the right, and the ranks of its suffixes."""

    def __init__(self, symbols: Sequence[int]):
        self.n = len(symbols)
        self.wide = max(symbols, default=0) + 1
        self._tour(*self._ukkonen([*symbols, 0]))

    def _ukkonen(self, s: list[int]) -> tuple[dict[int, int], list[int], list[int]]:
        """Edges (node * wide + first symbol: child), and where the label above each node starts and ends. The last symbol, 0, is
        unlike all others; the leaf of a suffix is the one created in its turn."""
        n, wide = len(s), self.wide
        start, end, link, leaves = [0], [0], [0], []
        go: dict[int, int] = {}
        at = edge = length = left = 0  # the active point, and how many suffixes aren't in the tree yet
        for i, c in enumerate(s):
            left += 1
            unlinked = 0
            while left:
                if not length:
                    edge = i
                key = at * wide + s[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = at
                        unlinked = 0
                else:
                    first = start[child]
                    span = (end[child] if end[child] <= i else i + 1) - first
                    if length >= span:
                        edge += span
                        length -= span
                        at = child
                        continue
                    if s[first + length] == c:
                        if unlinked:
                            link[unlinked] = at
                        length += 1
                        break
                    fork = len(start)
                    go[key] = fork
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    leaves.append(fork + 1)
                    start[child] = first + length
                    go[fork * wide + c] = fork + 1
                    go[fork * wide + s[first + length]] = child
                    if unlinked:
                        link[unlinked] = fork
                    unlinked = fork
                left -= 1
                if at:
                    at = link[at]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.leaves = leaves
        return go, start, end

    def _tour(self, go: dict[int, int], start: list[int], end: list[int]) -> None:
        """Euler tour: depths in its order, the first place of every leaf, and the leaves' order under both alphabets."""
        keys = np.fromiter(go.keys(), np.int64, len(go))
        order = np.argsort(keys)
        parents, children = keys[order] // self.wide, np.fromiter(go.values(), np.int64, len(go))[order].tolist()
        cuts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1], True])
        below: list[Sequence[int]] = [()] * len(start)
        for node, a, b in zip(parents[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            below[node] = children[a:b]
        depth = [0] * len(start)
        first = [0] * len(start)
        tour: list[int] = []
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:  # back from a child
                tour.append(depth[~v])
                continue
            first[v] = len(tour)
            d = depth[v]
            tour.append(d)
            for c in reversed(below[v]):
                depth[c] = d + end[c] - start[c]
                stack.append(~v)
                stack.append(c)
        self.first = np.array(first)[np.array(self.leaves)]
        ranks = np.empty(self.n + 1, np.int64)
        ranks[np.argsort(self.first)] = np.arange(self.n + 1)
        self.ranks = ranks
        # the other order of the alphabet; the end of the text stays below all symbols
        place = dict(zip(self.leaves, range(self.n + 1), strict=True))
        other, stack, ends = [0] * (self.n + 1), [0], 0
        while stack:
            v = stack.pop()
            inner = below[v]
            if not inner:
                other[place[v]] = ends
                ends += 1
                continue
            stack += inner  # the last one, of the greatest symbol, comes first
            if start[inner[0]] == self.n:  # the end of the text, below this node
                stack.append(inner[0])
                del stack[-1 - len(inner)]
        self.other_ranks = np.array(other)
        self._minima(np.array(tour, np.int32))

    def _minima(self, depths: np.ndarray) -> None:
        blocks = -(-len(depths) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(depths)] = depths
        by_block = padded.reshape(blocks, BLOCK)
        self.depths = padded
        self.heads = np.minimum.accumulate(by_block, axis=1).ravel()  # from the block's start
        self.tails = np.minimum.accumulate(by_block[:, ::-1], axis=1)[:, ::-1].ravel()  # to the block's end
        self.table = [by_block.min(axis=1)]
        while 2 ** len(self.table) <= blocks:
            last, step = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def _least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least depth between two places of the tour, both included; a <= b."""
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.tails[a], self.heads[b])
        same = np.flatnonzero(x == y)
        if len(same):
            out[same] = self.depths[a[same]]
            for k in range(1, BLOCK):
                at = np.minimum(a[same] + k, b[same])
                out[same] = np.minimum(out[same], self.depths[at])
        far = np.flatnonzero(y - x > 1)
        if len(far):
            lo, hi = x[far] + 1, y[far]
            level = np.frexp(hi - lo)[1] - 1
            for k in np.unique(level).tolist():
                at = far[level == k]
                row = self.table[k]
                out[at] = np.minimum(out[at], np.minimum(row[x[at] + 1], row[y[at] - 2**k]))
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j (different places up to n)."""
        a, b = self.first[i], self.first[j]
        return self._least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def _next_smaller(ranks: np.ndarray) -> np.ndarray:
    """Place of the next smaller suffix of each; that of the empty suffix at the end is the smallest."""
    r = ranks.tolist()
    n = len(r) - 1
    r[n] = -1
    after = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, r[i]
        while r[j] > own:
            j = after[j]
        after[i] = j
    return np.array(after[:n], np.int64)


def all_runs(symbols: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every maximal repetition of exponent 2 or more, by start, then period."""
    n = len(symbols)
    if n < 2:
        return (np.empty(0, np.int64),) * 3
    right, left = Extensions(symbols), Extensions(list(symbols)[::-1])
    here, found = np.arange(n), []
    for ranks in (right.ranks, right.other_ranks):
        period = _next_smaller(ranks) - here
        i = here[here + period < n]
        p = period[i]
        forth = right.of(i, i + p)
        back = np.zeros_like(i)
        inner = np.flatnonzero(i > 0)
        back[inner] = left.of(n - i[inner], n - i[inner] - p[inner])
        start, length = i - back, p + forth + back
        ok = length >= 2 * p
        found.append(np.stack([start[ok], p[ok], length[ok]]))
    start, period, length = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, length, period


def gram_length(min_length: int, min_exponent: float) -> int:
    """Most words that a place of any run finds again one period on or back."""
    return max(1, min(max(min_length, math.ceil(min_exponent * q)) - 2 * q + 1 for q in range(1, math.ceil(min_length / min_exponent) + 2)))


def stretches(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches of words in which all grams occur twice or more."""
    n = len(ids) - gram + 1
    if n < 2:
        return []
    hashed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            hashed = (hashed ^ ids[k : k + n].astype(np.uint64)) * np.uint64(_MIX)
            hashed ^= hashed >> np.uint64(29)
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    again = np.zeros(n + 2, np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    edges = np.diff(again)
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) + gram - 1).tolist(), strict=True))


def runs_of(words: Sequence, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of hashable words, by start, then period."""
    if len(words) < min_length:
        return []
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    parts = [(a, b) for a, b in stretches(ids, gram_length(min_length, min_exponent)) if b - a >= min_length]
    if not parts:
        return []
    symbols, places = [], []
    local, used = np.unique(np.concatenate([ids[a:b] for a, b in parts]), return_inverse=True)
    mark, k = len(local) + 1, 0
    for a, b in parts:
        symbols += (used[k : k + b - a] + 1).tolist()
        symbols.append(mark)
        places += [*range(a, b), b]
        mark, k = mark + 1, k + b - a
    start, length, period = all_runs(symbols)
    ok = (length >= min_length) & (length >= min_exponent * period)
    return sorted({(places[s], n, p) for s, n, p in zip(start[ok].tolist(), length[ok].tolist(), period[ok].tolist(), strict=True)}, key=lambda r: (r[0], r[2]))


def without_repeats(words: Sequence, runs: Sequence[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s + p for s, _, p in runs], 1)
    np.add.at(change, [s + n for s, n, _ in runs], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def rewritten(words: list, doc_id: object) -> list:
    """The words of a document, from a place on a period of them if the hash of its id says so."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


FIELDS = [
    T.StructField("n_runs", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")],
    T.StructField("runs_sha256", T.StringType()),
    T.StructField("collapsed_sha256", T.StringType()),
]


def _summary(words: list[bytes], min_length: int, min_exponent: float) -> tuple:
    runs = runs_of(words, min_length, min_exponent)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(without_repeats(words, runs))).hexdigest()


def with_runs(df: DataFrame, text: str = "text", doc_id: str | None = None, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the number of runs, the run of the greatest exponent and the digests of all runs and of the text without repeats.
    With `doc_id`, texts are first rewritten as `rewritten` says."""
    inputs = [F.col(text), *([F.col(doc_id)] if doc_id else [])]

    def fn(texts, ids=None):
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        made = (rewritten(w, i) for w, i in zip(words, ids, strict=True)) if ids is not None else words
        return list(zip(*[_summary(w, min_length, min_exponent) for w in made], strict=True))

    return append_columns(df, inputs, FIELDS, fn, keep)


def collapse(df: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> DataFrame:
    """Texts without their repeats, words joined by one space, and `runs`, an array of (start, length, period); null stays null."""
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

    def fn(texts):
        out, found = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            runs = runs_of(words, min_length, min_exponent)
            out.append(None if t is None else b" ".join(without_repeats(words, runs)).decode("utf-8", "surrogatepass"))
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
        return out, found

    return append_columns(df, [F.col(text)], [T.StructField(text, T.StringType()), T.StructField("runs", T.ArrayType(run))], fn)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document."""
    return with_runs(table(spark, sf_dir, "documents"), doc_id="doc_id", keep=["doc_id"])


#: DuckDB SQL: words that come again one period on, by three at a time, and their unbroken stretches. The table of the check sum is made from its polynomial.
ORACLE = r"""WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
 coded AS (SELECT doc_id, text, list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: 48 + CAST(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1) AS BIGINT)) AS b FROM documents),
 hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM coded, tab),
 sized AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, h % 10 = 0 AND len(ws) > 0 AS again, CAST(h // 10 AS BIGINT) AS g FROM hashed),
 placed AS (SELECT *, CASE WHEN again THEN g % n ELSE n END AS a FROM sized),
 made AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
 spread AS (SELECT doc_id, n, a, p, ws, unnest(range(n)) AS i FROM made),
 t AS (SELECT doc_id, n, i, CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS word FROM spread),
 grams AS (SELECT doc_id, n, i, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS gram FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
 isles AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
 runs AS (SELECT doc_id, start, length, min(q) AS period FROM isles WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
 best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / CAST(period AS DOUBLE) DESC, start, period) AS k FROM runs),
 listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
 SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(l.s, '')) AS runs_sha256, sha256(coalesce(k.s, '')) AS collapsed_sha256
 FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN kept k ON k.doc_id = d.doc_id"""
