"""License scans by a positional rare-token index, in DataFrame functions only.

A text's words are runs of letters, digits and non-ASCII characters after A-Z became a-z. Base phrases are looked up
word by word. For the method, `license_texts` holds paragraphs, notices, names and identifiers of licences, each with a mandatory key phrase;
the index has a posting (template, position) for each word of a key phrase.

A first pass over the corpus counts in how many files each licence word stands. Of a key phrase the SUPPORT words with the highest
inverse document frequency are looked up, so a file looks up the rarest of its licence words and never those that most files
have ("the", "of"). In the second pass each place of such a word proposes, for each of its postings, a start of the
template; starts that SUPPORT postings agree on by relative position are kept, and verified: the whole key phrase must stand at its
place, so no match is lost whatever the frequencies are, and `coverage` of the template's words must be in place. A word is
in place at its exact position, or, next to its neighbour in the template, off by up to DRIFT words and one more for every
DRIFT_EVERY words between it and the key phrase: words put in or left out move the rest of a notice, but don't hide it.
What a file costs depends on the places of rare words in it and what they point to, not on the number of templates.

Both passes are maps over the scan but for the counting of words; nothing of a text is written or shuffled.

Cases: null and empty texts have no words; overlapping and repeated places all count; a label found by both ways is
listed once; score is 1 with a base label, else the best coverage of an accepted template, else 0; columns of the table
named like a result are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerostrata.llm.common import ascii_lower, table
from aerostrata.llm.license_texts import NAMES, TEXTS

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
COVERAGE = 0.6
SUPPORT = 2
DRIFT = 2
DRIFT_EVERY = 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _as_words(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


#: (label, words, key phrase within them)
TEMPLATES = tuple((label, _as_words(text), phrase) for label, phrase, text in TEXTS) + tuple((label, _as_words(n), _as_words(n)) for label, names in NAMES.items() for n in names)


def words_of(text: Column) -> Column:
    """The words of a text, joined by one space."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def _array(values, quote: bool = True) -> str:
    return "array(" + ", ".join(f"'{v}'" if quote else str(v) for v in values) + ")"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _at(words: list[str], start: str) -> str:
    return " AND ".join(f"get(words, {start} + {k}) = '{w}'" for k, w in enumerate(words))


def key_at(body: str, phrase: str) -> int:
    """Position of the key phrase in a template."""
    words, key = body.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def noted(df: DataFrame, text: str, templates, keep: Sequence[str] | None = None) -> DataFrame:
    """The texts as words: c0, c1, ... (the columns to keep), n_words, words, b0, b1, b2 (places of base phrases), voc (distinct
    licence words)."""
    vocabulary = sorted({w for _, body, _ in templates for w in body.split()})
    docs = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns if keep is None else keep)], words_of(F.col(f"`{text}`")).alias("norm"))
    docs = docs.withColumn("words", F.expr("if(norm = '', array(), split(norm, ' ', -1))"))
    for k, p in enumerate(BASE):
        places = f"if(instr(concat(' ', norm, ' '), ' {p} ') = 0, array(), filter(sequence(0, size(words) - 1), i -> {_at(p.split(), 'i')}))"
        docs = docs.withColumn(f"b{k}", F.expr(f"cast({places} as array<int>)"))
    docs = docs.withColumn("voc", F.expr(f"array_distinct(filter(words, x -> x IN ({', '.join(repr(w) for w in vocabulary)})))"))
    return docs.withColumn("n_words", F.size("words").cast("long")).drop("norm")


def idf_of(notes: DataFrame) -> dict[str, float]:
    """Inverse document frequency of the licence words over all files (at most a row for each word of the templates)."""
    # outer, as the filter that Spark infers from a plain explode would make the words twice
    counts = {r["w"]: r["n"] for r in notes.select(F.explode_outer("voc").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = notes.count()
    return {w: log((total + 1) / (n + 1)) for w, n in counts.items() if w is not None}


def lookup_order(body: str, idf: dict[str, float]) -> list[int]:
    """Positions of a template or phrase, rarest words first (words of no file before all)."""
    words = body.split()
    return sorted(range(len(words)), key=lambda p: (-idf.get(words[p], float("inf")), p))


def index_of(templates, idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) of the SUPPORT rarest words of each key phrase."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, body, phrase) in enumerate(templates):
        at = key_at(body, phrase)
        for k in lookup_order(phrase, idf)[:SUPPORT]:
            index.setdefault(phrase.split()[k], []).append((t, at + k))
    return index


def matches(templates, idf: dict[str, float], coverage: float) -> str:
    """SQL of the accepted templates of a noted file: array of (label, score)."""
    index = index_of(templates, idf)
    postings = [f"array({', '.join(f'named_struct({chr(39)}t{chr(39)}, {t}, {chr(39)}q{chr(39)}, {q})' for t, q in at)})" for at in index.values()]
    parts = []
    for label, body, phrase in templates:
        parts.append(f"named_struct('label', '{label}', 'words', {_array(body.split())}, 'at', {key_at(body, phrase)}, 'key', {len(phrase.split())})")
    word = "get(words, {})"
    proposed = f"""array_sort(flatten(transform(
        filter(sequence(0, size(words) - 1), i -> get(words, i) IN ({", ".join(f"'{w}'" for w in index)})),
        i -> transform(element_at(map_from_arrays({_array(index)}, array({", ".join(postings)})), get(words, i)), p -> struct(p.t AS t, i - p.q AS s)))))"""
    agreed = f"""if(size(tally) < {SUPPORT}, cast(array() AS array<struct<t: int, s: int>>), array_distinct(transform(
        filter(sequence(0, size(tally) - {SUPPORT}), i -> get(tally, i) = get(tally, i + {SUPPORT - 1})), i -> get(tally, i))))"""
    whole_key = f"forall(sequence(0, t.key - 1), k -> coalesce({word.format('m.s + t.at + k')} = get(t.words, t.at + k), false))"
    moved = f"""exists(sequence(-{DRIFT} - greatest(t.at - q, q - t.at - t.key + 1, 0) div {DRIFT_EVERY}, {DRIFT} + greatest(t.at - q, q - t.at - t.key + 1, 0) div {DRIFT_EVERY}),
        d -> {word.format("int(m.s + q + d)")} = get(t.words, q) AND (
            coalesce({word.format("int(m.s + q + d + 1)")} = get(t.words, q + 1), false) OR coalesce({word.format("int(m.s + q + d - 1)")} = get(t.words, q - 1), false)))"""
    placed = f"size(filter(sequence(0, size(t.words) - 1), q -> coalesce({word.format('m.s + q')} = get(t.words, q), false) OR coalesce({moved}, false)))"
    each = _let("t", f"get(array({', '.join(parts)}), m.t)", f"named_struct('label', t.label, 'score', if({whole_key}, {placed} / cast(size(t.words) as double), 0D))")
    return f"filter(transform({_let('tally', 'if(size(words) = 0, array(), ' + proposed + ')', agreed)}, m -> {each}), m -> m.score >= {coverage})"


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, coverage: float = COVERAGE, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to the columns `keep` (all)."""
    names = list(df.columns if keep is None else keep)
    notes = noted(df, text, templates, names)
    found = notes.withColumn("found", F.expr(matches(templates, idf_of(notes), coverage)))
    base = F.array_compact(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())]))
    places = F.concat(*[F.col(f"b{k}") for k in range(len(BASE))])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in RESULTS],
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("found.label"))).alias("labels"),
        F.round(F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.score"), F.lit(0.0))), 6).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def _oracle() -> str:
    rows = []
    for k, (label, body, phrase) in enumerate(TEMPLATES):
        words, key, at = body.split(), phrase.split(), key_at(body, phrase)
        rows += [f"({k}, '{label}', {q}, '{w}', {max(at - q, q - at - len(key) + 1, 0)}, {len(words)}, {len(key)})" for q, w in enumerate(words)]
    base = [(k, label, q, w, len(p.split())) for k, (p, label) in enumerate(BASE.items()) for q, w in enumerate(p.split())]
    return f"""
WITH n AS (
  SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) AS norm FROM documents
), w AS (
  SELECT doc_id, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS words FROM n
), p AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w
), phrases(k, label, q, word, n) AS (
  VALUES {", ".join(f"({k}, '{label}', {q}, '{w}', {n})" for k, label, q, w, n in base)}
), templates(k, label, q, word, away, n, musts) AS (
  VALUES {", ".join(rows)}
), b AS (
  SELECT doc_id, label, i - q AS start FROM p JOIN phrases USING (word) GROUP BY doc_id, k, label, n, i - q HAVING count(*) = n
), a AS (
  SELECT doc_id, k, i - q AS start FROM p JOIN templates USING (word) WHERE away = 0 GROUP BY doc_id, k, musts, i - q HAVING count(*) = musts
), h AS (
  SELECT DISTINCT doc_id, k, start, label, n, q, away, i - q - start AS off FROM a JOIN templates USING (k) JOIN p USING (doc_id, word)
), t AS (
  SELECT doc_id, label, count(DISTINCT h.q) / n AS score FROM h
  WHERE off = 0 OR abs(off) <= {DRIFT} + away // {DRIFT_EVERY} AND (doc_id, k, start, off, q) IN (SELECT (doc_id, k, start, off, q + 1) FROM h UNION ALL SELECT (doc_id, k, start, off, q - 1) FROM h)
  GROUP BY doc_id, k, start, label, n HAVING count(DISTINCT h.q) / n >= {COVERAGE}
), bs AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id
), ls AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM t) GROUP BY doc_id
), ss AS (
  SELECT doc_id, max(score) AS score FROM t GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(ss.score, 0e0) END, 6) AS score
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN ss USING (doc_id)
"""


#: Every template at every place of its key phrase, without an index or frequencies.
ORACLE = _oracle()
