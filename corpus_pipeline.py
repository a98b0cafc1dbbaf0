"""Corpus pipeline: language, near duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
The driver may write a stage's rows as Parquet and read them again as the next one's docs; `run` does the same in the shared
folder. A stage that drops rows decides on (doc_id, text), so a row never goes because another text has its id; ids
may be null or repeated. Rows equal in both are one document. Null and empty texts have no language and go in the first stage;
in any other they are texts like others. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerostrata.llm import decontaminate, langid, secrets, sentencepiece_bpe, simhash
from aerostrata.llm.common import Stored, fresh, stored, table, without

#: Score from which a predicted language replaces a given one.
SURE = 0.9


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key of their id and text, rows without an id last, and its name."""
    key = fresh(docs, "__key")
    return docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))), key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or without a letter go. A missing `lang` is filled in, and one that
    the text contradicts with a score of SURE or more is replaced."""
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.languages:  # nothing to learn from: only the text itself can be rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "__lang"), fresh(docs, "__score")
    marked = langid.predict(docs, model, names=(lang, score)).where(F.col(lang) != "und")
    return marked.withColumn("lang", F.when(F.col("lang").isNull() | (F.col(score) >= SURE), F.col(lang)).otherwise(F.col("lang"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: the one with the smallest id. Texts are shuffled only where more keys
    go than may be broadcast, and those of rows repeated word for word."""
    keyed, key = _keyed(docs)
    gone, repeated = simhash.copies(keyed.select(key, "text"), key)
    left = without(keyed, gone, key)
    if repeated.limit(1).count():
        once = left.join(repeated.hint("merge"), key, "left_semi").dropDuplicates([key])
        left = without(left, repeated, key).unionByName(once)
    return left.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed, key = _keyed(docs)
    leaks = stored(decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), doc_id=key).select(F.col("doc_id").alias(key)).distinct())
    return without(keyed, leaks, key).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text."""
    return secrets.redact(docs, count=None).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digests of ids and decoded text."""
    return sentencepiece_bpe.encode(docs, ids=True, digests=True, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("redact_secrets", redact_secrets),
    ("token_ids", token_ids),
]

#: Fingerprints, recursive decoding and merge rounds are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        kept = Stored(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
