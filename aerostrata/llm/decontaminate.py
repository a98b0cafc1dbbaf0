"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Texts become tokens in which numbers, units after numbers and names (capitalised words inside a sentence, not words in capitals) are typed
placeholders that remember their value; names in a row are one placeholder in the template. Windows of `width` tokens are
hashed twice, by their literal tokens in small letters and by their canonical ones; the benchmark's windows are joined by
hash: all by their literal tokens, so that windows of numbers or names and copies in other letters are found, and those
with at least half of their tokens lexical by their template, with names as placeholders and with names as words. A
template window stands for the literal windows of the item inside it.

Matches of a document and an item whose shifts are at most `width` apart are one occurrence, so that a word put in or left out, or a
longer name, doesn't part them. In an occurrence, windows count where they are word for word; of the others, those with a
slot value of the item that they fill in more than one way don't (slot consistency), so re-parameterised questions and
edited copies are found and texts that merely share a frame with changing fillers are not. A pair counts when its
windows cover `coverage` of the item's windows, or `run` tokens of the item in a row in one occurrence.

The benchmark's windows are broadcast when there are at most BROADCAST_ROWS of them. Else a bitmap of their hashes (at most
SIEVE_WORDS words of 64 bits) sorts out nearly all windows of the documents inside the scan, before the rest is
joined by a shuffle. Documents are tokenised once, whatever widths the items have; nothing of a document is shuffled but its matches.

Cases: null and empty texts match nothing; items shorter than `width` tokens are matched as one window of their length, those
of fewer than MIN_WIDTH tokens only by texts that consist of them; equal items each give a row; a null doc_id or item_id
stays null; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerostrata.llm.common import stored, table

BROADCAST_ROWS = 500_000
SIEVE_WORDS = 1 << 20
MIN_WIDTH = 4
ENDS = (".", "!", "?")
UNITS = (
    "mm cm m km in ft mi mg g kg t oz lb lbs ml cl l gal s sec min h hr hrs ms hz khz mhz ghz kb mb gb tb w kw mw kwh j kj v mv a ma pa kpa hpa bar k c f "
    "usd eur gbp percent meters metres kilometers kilometres miles feet inches hours minutes seconds days weeks months years dollars euros pounds grams liters litres degrees"
).split()
TOKEN = r"[\\p{L}\\p{M}]+|\\p{N}+(?:[.,]\\p{N}+)*|[%€$£°.!?]"


def _sql(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def tokens(df: DataFrame, text: str) -> DataFrame:
    """Adds `toks`: lower-cased words and placeholders (#n number, #u unit, #p name) followed by their value."""
    # the first case is the common one: a word in small ASCII letters after a word
    raw = df.withColumn("raw", F.expr(f"regexp_extract_all(coalesce({text}, ''), '{TOKEN}', 0)"))
    typed = F.expr(
        f"""filter(transform(raw, (x, i) -> CASE
            WHEN x >= 'a' AND x < '{{' AND (i = 0 OR get(raw, i - 1) >= 'A' AND get(raw, i - 1) < '{{') THEN lower(x)
            WHEN x IN {_sql(ENDS)} THEN ''
            WHEN x IN ('%', '€', '$', '£', '°') THEN concat('#u', x)
            WHEN x RLIKE '^\\\\p{{N}}' THEN concat('#n', x)
            WHEN i > 0 AND lower(x) IN {_sql(UNITS)} AND get(raw, i - 1) RLIKE '^\\\\p{{N}}' THEN concat('#u', lower(x))
            WHEN i > 0 AND left(x, 1) <> lower(left(x, 1)) AND x <> upper(x) AND get(raw, i - 1) NOT IN {_sql(ENDS)} THEN concat('#p', lower(x))
            ELSE lower(x) END), x -> x <> '')"""
    )
    return raw.withColumn("toks", typed).drop("raw")


_MARKED = "exists(toks, x -> startswith(x, '#'))"
_PLAIN = f"if({_MARKED}, transform(toks, x -> if(startswith(x, '#'), substr(x, 3), x)), toks)"
#: Places of the tokens that begin a template token: all but names after names.
_STARTS = f"if({_MARKED}, filter(sequence(1, size(toks)), i -> NOT (i > 1 AND startswith(get(toks, i - 1), '#p') AND startswith(get(toks, i - 2), '#p'))), array())"


def windows(df: DataFrame, literal: str, template: str, keep: list[str]) -> DataFrame:
    """(keep..., h, pos, stop, slots) of every window of `toks`: by its literal tokens, with no slots, in the widths of the
    array `literal`, and by its template tokens where it has slots, in the widths of `template` (SQL). Template tokens of a kind (#n)
    are no literal ones, so the hashes are of one space. pos and stop are places of tokens, stop exclusive."""
    forms = df.select(*keep, "toks", F.expr(_PLAIN).alias("plain"), F.expr(_STARTS).alias("starts"))
    forms = forms.withColumn("canon", F.expr("transform(starts, s -> if(startswith(get(toks, s - 1), '#'), left(get(toks, s - 1), 2), get(toks, s - 1)))"))
    forms = forms.withColumn(
        "fillers",
        F.expr("transform(starts, (s, j) -> if(startswith(get(toks, s - 1), '#p'), array_join(slice(toks, s, coalesce(get(starts, j + 1), size(toks) + 1) - s), ' '), get(toks, s - 1)))"),
    )
    words = f"""transform({literal}, n -> if(size(toks) < n OR n < {MIN_WIDTH} AND size(toks) <> n, array(), transform(sequence(1, size(toks) - n + 1), i -> struct(
        xxhash64(slice(plain, i, n)) AS h, i AS pos, i + n AS stop, cast(array() AS array<string>) AS slots))))"""
    frames = f"""transform({template}, n -> if(size(starts) < n OR n < {MIN_WIDTH}, array(), transform(
        filter(sequence(1, size(starts) - n + 1), j -> exists(slice(canon, j, n), x -> startswith(x, '#'))), j -> struct(
        xxhash64(slice(canon, j, n)) AS h, get(starts, j - 1) AS pos, coalesce(get(starts, j + n - 1), size(toks) + 1) AS stop, filter(slice(fillers, j, n), x -> startswith(x, '#')) AS slots))))"""
    return forms.select(*keep, F.expr(f"explode(flatten(concat({words}, {frames})))").alias("w")).select(*keep, "w.h", "w.pos", "w.stop", "w.slots")


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, h, width, frame, of, item_pos, covers, item_slots) of the benchmark's windows: `width` of the item's literal windows and
    `frame` of its template's, `of` its literal windows, of which this one stands for `covers` from item_pos on."""
    sized = items.withColumn("width", F.least(F.size("toks"), F.lit(width))).where("width > 0")
    # once more with names as plain words, as texts in small or in capital letters show them
    named = sized.where("exists(toks, x -> startswith(x, '#p'))").withColumn("toks", F.expr("transform(toks, x -> if(startswith(x, '#p'), substr(x, 3), x))"))
    parts = []
    for form, literal in ((sized, "array(width)"), (named, "cast(array() AS array<int>)")):
        framed = form.withColumn("frame", F.expr(f"least(size({_STARTS}), {width})")).withColumn("of", F.size("toks") - F.col("width") + 1)
        parts.append(windows(framed, literal, "array(frame)", ["item_id", "width", "frame", "of", "toks"]))
    found = parts[0].unionByName(parts[1])
    templated = F.size("slots") > 0
    lexical = F.size("slots") * 2 <= F.when(templated, F.col("frame")).otherwise(F.col("width"))
    covers = F.col("stop") - F.col("pos") - F.col("width") + 1
    return found.where(lexical).select(
        "item_id", "h", "width", F.when(templated, F.col("frame")).alias("frame"), "of", F.col("pos").alias("item_pos"), covers.alias("covers"), F.col("slots").alias("item_slots")
    )


def sieve(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Windows whose hash may be one of the benchmark's, by a bitmap of bounded size in one row."""
    words = theirs.select(F.expr(f"int(pmod(shiftright(h, 6), {SIEVE_WORDS}L))").alias("w"), F.expr("shiftleft(1L, int(pmod(h, 64)))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = theirs.sparkSession.range(SIEVE_WORDS).select(F.col("id").cast("int").alias("w")).join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    bits = every.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("s")).select(F.col("s.b").alias("bits"))
    word = F.get(bits.scalar(), F.expr(f"int(pmod(shiftright(h, 6), {SIEVE_WORDS}L))"))
    return mine.where(word.bitwiseAND(F.expr("shiftleft(1L, int(pmod(h, 64)))")) != 0)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    width: int = 8,
    coverage: float = 0.5,
    run: int = 13,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_windows, coverage, reparameterised) of documents that hold a benchmark item."""
    items = tokens(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")), "t").drop("t")
    texts = tokens(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), "t").drop("t")
    theirs = stored(item_windows(items, width))
    facts = theirs.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("width")).alias("literal"), F.array_sort(F.collect_set("frame")).alias("template")).first()
    widths = [f"array({', '.join(map(str, w))})" if w else "cast(array() AS array<int>)" for w in (facts["literal"], facts["template"])]
    mine = windows(texts, *widths, ["doc_id"]).drop("stop")
    if facts["n"] <= BROADCAST_ROWS:
        joined = mine.join(F.broadcast(theirs), "h")
    else:
        joined = sieve(mine, theirs).join(theirs, "h")
    found = joined.select(
        "doc_id", "item_id", "of", "width", (F.col("pos") - F.col("item_pos")).alias("shift"), F.expr("sequence(item_pos, item_pos + covers - 1)").alias("at"), F.expr("arrays_zip(item_slots, slots)").alias("slots")
    ).withColumn("verbatim", F.expr("forall(slots, p -> p.item_slots = p.slots)"))
    pair = ["doc_id", "item_id", "of", "width"]
    shifts = found.groupBy(*pair, "shift").agg(
        F.expr("collect_set(at) FILTER (WHERE verbatim)").alias("same"),
        F.expr("collect_set(struct(at, slots)) FILTER (WHERE NOT verbatim)").alias("other"),
    )
    in_order = Window.partitionBy(*pair).orderBy("shift")
    parted = shifts.withColumn("new", F.coalesce(F.col("shift") - F.lag("shift").over(in_order) > F.col("width"), F.lit(True)).cast("int"))
    occurrences = (
        parted.withColumn("occurrence", F.sum("new").over(in_order))
        .groupBy(*pair, "occurrence")
        .agg(F.array_distinct(F.flatten(F.flatten(F.collect_list("same")))).alias("same"), F.flatten(F.collect_list("other")).alias("other"))
    )
    placed = (
        # values of the item that the re-parameterised windows fill in more than one way
        occurrences.withColumn("pairs", F.expr("array_distinct(flatten(transform(other, o -> o.slots)))"))
        .withColumn("clashing", F.expr("filter(array_distinct(transform(pairs, p -> p.item_slots)), v -> size(filter(pairs, p -> p.item_slots = v)) > 1)"))
        .withColumn("filled", F.expr("flatten(transform(filter(other, o -> NOT exists(o.slots, p -> array_contains(clashing, p.item_slots))), o -> o.at))"))
        .withColumn("changed", F.expr("size(array_except(filled, same)) > 0"))
        .withColumn("at", F.array_sort(F.array_union("same", "filled")))
        .where("size(at) > 0")
        .withColumn(
            "longest",
            F.expr("aggregate(at, struct(-1 AS last, 0 AS now, 0 AS best), (s, x) -> struct(x AS last, if(x = s.last + 1, s.now + 1, 1) AS now, greatest(s.best, if(x = s.last + 1, s.now + 1, 1)) AS best), s -> s.best)"),
        )
    )
    pairs = placed.groupBy(*pair).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"), F.max("longest").alias("longest"), F.min("changed").alias("reparameterised")
    )
    return (
        pairs.withColumn("coverage", F.round(F.col("n_windows") / F.col("of"), 6))
        .where((F.col("coverage") >= coverage) | (F.col("longest") + F.col("width") - 1 >= run))
        .select("doc_id", "item_id", "n_windows", "coverage", "reparameterised")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UNITS_SQL = "(" + ", ".join(f"'{u}'" for u in UNITS) + ")"

#: The same in relational steps: windows as joined strings, occurrences and runs by window functions.
ORACLE = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), raw AS (
  SELECT side, id, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{M}}]+|\p{{N}}+(?:[.,]\p{{N}}+)*|[%€$£°.!?]') AS raw FROM texts
), typed AS (
  SELECT side, id, list_filter(list_transform(raw, lambda x, i: CASE
    WHEN x IN ('.', '!', '?') THEN ''
    WHEN x IN ('%', '€', '$', '£', '°') THEN concat('#u', x)
    WHEN regexp_matches(x, '^\p{{N}}') THEN concat('#n', x)
    WHEN i > 1 AND lower(x) IN {_UNITS_SQL} AND regexp_matches(raw[i - 1], '^\p{{N}}') THEN concat('#u', lower(x))
    WHEN i > 1 AND left(x, 1) <> lower(left(x, 1)) AND x <> upper(x) AND raw[i - 1] NOT IN ('.', '!', '?') THEN concat('#p', lower(x))
    ELSE lower(x) END), lambda x: x <> '') AS toks FROM raw
), forms AS (
  SELECT side, id, toks, true AS whole FROM typed WHERE len(toks) > 0 UNION ALL
  SELECT side, id, list_transform(toks, lambda x: CASE WHEN starts_with(x, '#p') THEN x[3:] ELSE x END), false FROM typed WHERE side = 'b' AND len(list_filter(toks, lambda x: starts_with(x, '#p'))) > 0
), heads AS (
  SELECT *, list_transform(toks, lambda x: CASE WHEN starts_with(x, '#') THEN x[3:] ELSE x END) AS plain,
    list_filter(range(1, len(toks) + 1), lambda i: NOT (i > 1 AND starts_with(toks[i], '#p') AND starts_with(coalesce(toks[greatest(i - 1, 1)], ''), '#p'))) AS starts FROM forms
), merged AS (
  SELECT *, list_transform(starts, lambda s: CASE WHEN starts_with(toks[s], '#') THEN left(toks[s], 2) ELSE toks[s] END) AS canon,
    list_transform(starts, lambda s, j: array_to_string(toks[s:coalesce(starts[j + 1], len(toks) + 1) - 1], ' ')) AS fill FROM heads
), sized AS (
  SELECT *, least(len(toks), 8) AS lw, least(len(starts), 8) AS fw FROM merged
), widths AS (
  SELECT DISTINCT lw AS n, true AS literal FROM sized WHERE side = 'b' AND whole UNION SELECT DISTINCT fw, false FROM sized WHERE side = 'b'
), asked AS (
  SELECT s.*, n, literal FROM sized s JOIN widths ON CASE WHEN side = 'd' THEN true WHEN literal THEN whole AND n = lw ELSE n = fw END
), lit AS (
  SELECT side, id, lw, len(toks) - lw + 1 AS total, 'L' || n || ' ' || array_to_string(plain[p:p + n - 1], ' ') AS k, p AS pos, p + n AS stop, [] :: VARCHAR[] AS slots
  FROM asked, unnest(range(1, len(toks) - n + 2)) AS u(p) WHERE literal AND len(toks) >= n AND (n >= {MIN_WIDTH} OR len(toks) = n)
), fra AS (
  SELECT side, id, lw, len(toks) - lw + 1 AS total, 'F' || n || ' ' || array_to_string(canon[j:j + n - 1], ' ') AS k, starts[j] AS pos, coalesce(starts[j + n], len(toks) + 1) AS stop,
    list_filter(fill[j:j + n - 1], lambda x: starts_with(x, '#')) AS slots, n
  FROM asked, unnest(range(1, len(starts) - n + 2)) AS u(j) WHERE NOT literal AND len(starts) >= n AND n >= {MIN_WIDTH}
), wins AS (
  SELECT side, id, lw, total, k, pos, stop, slots FROM lit UNION ALL
  SELECT side, id, lw, total, k, pos, stop, slots FROM fra WHERE len(slots) > 0 AND (side = 'd' OR len(slots) * 2 <= n)
), hits AS (
  SELECT d.id AS doc_id, b.id AS item_id, b.total, b.lw, d.pos - b.pos AS shift, b.pos AS lo, b.stop - b.lw AS hi, list_zip(b.slots, d.slots) AS slots,
    len(list_filter(list_zip(b.slots, d.slots), lambda p: p[1] <> p[2])) = 0 AS same
  FROM wins d JOIN wins b ON d.k = b.k AND d.side = 'd' AND b.side = 'b'
), jumps AS (
  SELECT *, coalesce(shift - lag(shift) OVER w > lw, true) AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id, item_id, total, lw ORDER BY shift)
), occ AS (
  SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id, total, lw ORDER BY shift, fresh DESC ROWS UNBOUNDED PRECEDING) AS o FROM jumps
), clash AS (
  SELECT doc_id, item_id, total, lw, o, p.v FROM (SELECT DISTINCT doc_id, item_id, total, lw, o, unnest(list_transform(slots, lambda p: {{'v': p[1], 'f': p[2]}})) AS p FROM occ WHERE NOT same)
  GROUP BY ALL HAVING count(DISTINCT p.f) > 1
), bad AS (
  SELECT doc_id, item_id, total, lw, o, list(v) AS vs FROM clash GROUP BY ALL
), good AS (
  SELECT doc_id, item_id, total, lw, o, h.same, unnest(range(lo, hi + 1)) AS place FROM occ h LEFT JOIN bad USING (doc_id, item_id, total, lw, o)
  WHERE h.same OR vs IS NULL OR len(list_intersect(vs, list_transform(slots, lambda p: p[1]))) = 0
), marks AS (
  SELECT doc_id, item_id, total, lw, o, place, NOT bool_or(same) AS filled FROM good GROUP BY ALL
), runs AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, total, lw, o ORDER BY place) AS r FROM marks
), stretches AS (
  SELECT doc_id, item_id, total, lw, o, count(*) AS n FROM runs GROUP BY doc_id, item_id, total, lw, o, r
), longest AS (
  SELECT doc_id, item_id, total, lw, max(n) AS n FROM stretches GROUP BY ALL
), changed AS (
  SELECT doc_id, item_id, total, lw, bool_and(c) AS c FROM (SELECT doc_id, item_id, total, lw, o, bool_or(filled) AS c FROM marks GROUP BY ALL) GROUP BY ALL
), covered AS (
  SELECT doc_id, item_id, total, lw, count(DISTINCT place) AS n FROM marks GROUP BY ALL
)
SELECT doc_id, item_id, CAST(v.n AS BIGINT) AS n_windows, round(v.n / total, 6) AS coverage, c AS reparameterised
FROM covered v JOIN longest l USING (doc_id, item_id, total, lw) JOIN changed USING (doc_id, item_id, total, lw)
WHERE round(v.n / total, 6) >= 0.5 OR l.n + lw - 1 >= 13
"""
