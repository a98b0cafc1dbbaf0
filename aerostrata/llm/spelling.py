"""Spelling variants: words at edit distance one, and for each the frequent word that it is a variant of.

Two words at distance one are alike in the first half of the one, or in its second half, letter by letter. So every word is
searched twice in an FM-index: over the vocabulary, matching the second half exactly and extending to the left with one error, and over
the reversed vocabulary, matching the first half and extending to the right. A pair that both searches find counts in the second.

How it spreads: an index is made of the words that share a half. A word goes to the groups of its own halves, to ask and to be found, and
to those of the halves that words one letter shorter or longer ask with, to be found: at most four groups. A task makes
one index of as many groups as have about `chunk` words and answers its questions at once. A half that more than `hot`
words share is dealt into blocks by a hash; the words that ask go through every block, as a stream. Of a word's near words only
their number and the best one leave the task, so nothing grows with the number of pairs. Forms are followed to the last by pointer
doubling: a form is ten times as frequent as its variant, so chains are short and have no circle.

Cases: a null text has no word, a null id counts as an empty one in the hash that slips letters; repeated rows count again; no word
of the needed length and number gives no rows; the columns of the result are those of the operator alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerostrata.llm.common import Stored, ascii_lower, partitions, stored, table
from aerostrata.llm.fm_index import FmIndex

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
TIMES = 10
SLIP = 31
CHUNK = 40_000
HOT = 100_000
FOUND = "word string, n_near long, best_n long, best string"


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n): maximal runs of letters, A-Z in lower case, of `min_length` letters and `min_count` occurrences at least.

    With `slip`, an occurrence loses the letter at h modulo its length, where h, the crc32 of "<id>:<run>", is divisible by it.
    """
    runs = docs.select(F.col(doc_id).cast("string").alias("_id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(f"[{LETTERS}]{{{min_length},}}"), 0)).alias("_run"))
    word: Column = F.col("_run")
    if slip:
        h = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "_run").cast("binary"))
        word = F.when(h % slip == 0, F.concat(F.expr("left(_run, int(pmod(_h, length(_run))))"), F.expr("substr(_run, int(pmod(_h, length(_run))) + 2)"))).otherwise(word)
        runs = runs.withColumn("_h", h)
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _groups(vocabulary: DataFrame) -> DataFrame:
    """(side, key, token, n, ask): every word in the groups of its halves; side 1 holds reversed words, so that halves are always ends."""
    size = "length(word)"
    halves = {0: [f"int(({size} + {d}) div 2)" for d in (1, 0, 2)], 1: [f"int(({size} + {d}) div 2)" for d in (0, -1, 1)]}
    rows = []
    for side, (own, *others) in halves.items():
        token = "reverse(word)" if side else "word"
        rows.append(f"transform(array_distinct(array({own}, {', '.join(others)})), e -> struct({side} AS side, xxhash64({side}, right({token}, e)) AS key, {token} AS token, e = {own} AS ask))")
    return vocabulary.select("n", F.expr(f"explode(concat({', '.join(rows)}))").alias("r")).select("r.side", "r.key", "r.token", "n", "r.ask")


def _dealt(groups: DataFrame, hot: int) -> DataFrame:
    """Groups with (block, entry): those of more than `hot` words in blocks, words that ask in all of them, as entries of their own block only."""
    sizes = stored(groups.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > hot))
    if not sizes.limit(1).count():
        return groups.withColumn("block", F.lit(-1)).withColumn("entry", F.lit(True))
    marked = groups.join(sizes, "key", "left").withColumn("_blocks", F.ceil(F.coalesce("_m", F.lit(1)) / F.lit(hot)).cast("int"))
    marked = marked.withColumn("_own", F.when(F.col("_m").isNull(), -1).otherwise(F.pmod(F.xxhash64("token"), F.col("_blocks")).cast("int")))
    every = F.when(F.col("ask") & F.col("_m").isNotNull(), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("_own"))
    spread = marked.withColumn("block", F.explode(every))
    return spread.select("side", "key", "token", "n", "ask", "block", (F.col("block") == F.col("_own")).alias("entry"))


def _answers(index: FmIndex, tokens: list[str], counts: np.ndarray, order: np.ndarray, side: int, asked: list[str]) -> pa.RecordBatch | None:
    """For each asked word with a near one: it, their number, and the most frequent one (ties: the first by code points)."""
    size = np.array([len(q) for q in asked], np.int64)
    first = size // 2
    q, k = index.one_error(asked, first if side else size - first)
    if not side and len(q):  # pairs that share the first half are those of the other side
        mine = np.array([not tokens[b].startswith(asked[a][: len(asked[a]) // 2]) for a, b in zip(q.tolist(), k.tolist(), strict=True)])
        q, k = q[mine], k[mine]
    if not len(q):
        return None
    by = np.lexsort((order[k], -counts[k], q))
    q, k = q[by], k[by]
    head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    turned = (lambda w: w[::-1]) if side else (lambda w: w)
    columns = [[turned(asked[i]) for i in q[head].tolist()], np.diff(np.r_[head, len(q)]), counts[k[head]], [turned(tokens[i]) for i in k[head].tolist()]]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows (side, key, block, entry, token, n, ask), those of a side, key and block together and entries first: indexes whole groups, many
    small ones together, and answers their questions; those that come after the entries of a block are answered in parts."""
    entries: dict[str, int] = {}
    asked: dict[str, None] = {}
    made: list = []

    def answer(side: int) -> Iterator[pa.RecordBatch]:
        if not made and asked:
            tokens = sorted(entries)
            turned = [w[::-1] for w in tokens] if side else tokens
            order = np.empty(len(tokens), np.int64)
            order[sorted(range(len(tokens)), key=turned.__getitem__)] = np.arange(len(tokens))
            made.extend((FmIndex(tokens), tokens, np.array([entries[w] for w in tokens], np.int64), order))
        words = list(asked)
        asked.clear()
        for k in range(0, len(words), chunk):
            found = _answers(*made, side, words[k : k + chunk])
            if found is not None:
                yield found

    group, held = (None, None, None), 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("side", "key", "block", "entry", "token", "n", "ask")]
        for side, key, block, entry, token, n, ask in zip(*columns, strict=True):
            if (side, key, block) != group:
                if held >= chunk or side != group[0] or block >= 0 or group[2] >= 0:
                    yield from answer(group[0])
                    entries.clear()
                    made.clear()
                    held = 0
                group = (side, key, block)
            if entry:
                entries[token] = n
            if ask:
                asked[token] = None
            held += 1
            if not entry and len(asked) >= chunk:
                yield from answer(side)
    yield from answer(group[0])


def near_words(vocabulary: DataFrame, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, form_n, form): all words of (word, n), their number of near words and the best of them."""
    groups = _dealt(_groups(vocabulary), hot)
    n = partitions(vocabulary.sparkSession)
    order = ["side", "key", "block", F.desc("entry")]
    dealt = groups.select("side", "key", "block", "entry", "token", "n", "ask").repartition(n, "side", "key", "block").sortWithinPartitions(*order)
    found = dealt.mapInArrow(lambda batches: _search(batches, chunk), FOUND)
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    each = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    rows = each.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best"))
    return rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("b")).select("word", "n", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.w").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form), at most one a word and without a circle, lead from each word. Links double their length each round."""
    at = Stored(links.select("word", F.col("form").alias("root")))
    while True:
        on = at.df.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        longer = Stored(at.df.join(on, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")))
        at.drop()
        if not longer.df.where("moved").limit(1).count():
            return longer.df.select("word", "root")
        at = longer


def variants(vocabulary: DataFrame, times: int = TIMES, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the near word of the largest n is the form where it is `times` as frequent or more."""
    near = near_words(vocabulary, chunk, hot)
    often = F.col("form_n") >= F.lit(times) * F.col("n")
    known = stored(near.withColumn("form", F.when(often, F.col("form"))).withColumn("form_n", F.when(often, F.col("form_n"))))
    led = roots(known.where("form is not null").select("word", "form"))
    return known.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the vocabulary of all documents."""
    return variants(stored(word_counts(table(spark, sf_dir, "documents"))))


#: DuckDB SQL: words near each other share a word less a letter at one place, or are that word themselves. The table of the check sum is made from its polynomial.
ORACLE = """WITH RECURSIVE tab AS (
 SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
 runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
 kinds AS (SELECT run, doc_id, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
 hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM kinds),
 coded AS (SELECT run, n, list_transform(range(length(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS BIGINT), 1)) - 1) + strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS BIGINT), 1)) - 1) AS b FROM hexed),
 hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM coded, tab),
 slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
 v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
 parts AS (SELECT word, n, word AS part, 0 AS i FROM v UNION ALL SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS part, i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
 near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM parts a JOIN parts b ON a.part = b.part WHERE a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
 best AS (SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
 forms AS (SELECT word, other AS form, m AS form_n FROM best WHERE k = 1 AND m >= 10 * n),
 led AS (SELECT word, form AS root FROM forms UNION ALL SELECT led.word, forms.form FROM led JOIN forms ON led.root = forms.word),
 roots AS (SELECT led.word, led.root FROM led LEFT JOIN forms ON led.root = forms.word WHERE forms.word IS NULL)
 SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, f.form, f.form_n, coalesce(r.root, v.word) AS root FROM v LEFT JOIN best b ON b.word = v.word AND b.k = 1 LEFT JOIN forms f ON f.word = v.word LEFT JOIN roots r ON r.word = v.word"""
