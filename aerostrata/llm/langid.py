"""Language identification in two steps: family first, then one-versus-one linear SVMs among the languages of a family.

Features are hashed character trigrams and 4-grams of the whole lower-cased text (letters kept, everything else read as
a space), as square roots of relative frequencies, so that the vectors have length one. Both steps use squared-hinge
linear SVMs, one for each pair of families or of languages, combined by votes and then margins. Languages that FAMILIES doesn't list
are grouped by their texts: families of at most GROUP, each the first that is left by name with those nearest to it. So the number
of SVMs doesn't grow with the square of the labels.

At most `languages` labels are learned, those of most rows (ties by name; a documented bound, for columns that hold anything but
languages); rows of others take no part in training. Training uses at most `per_language` labelled rows of each language, and `most` in all, shared evenly: those with the smallest
hash of their id and text (a documented bound: the model's quality does not depend on the corpus size, and at most
`most` vectors reach the driver, 200 MB at the default). A first pass over ids and hashes finds how large a hash may be; texts
are read for the chosen rows only, and their feature vectors are made on the executors. Prediction is a map over the
scan; its only input is the text.

Cases: a null text or one without a letter is `und` with score 0; with one learned language every other text gets it;
with none every text is `und`; ties go to the name that sorts first.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import append_columns, table

#: Families of languages by ISO 639-1 code (fixed values); others are grouped by their texts.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb", "fy"),
    "romance": ("fr", "es", "pt", "it", "ca", "ro", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMS = 1 << 13
GROUP = 8
LANGUAGES = 200

# bytes as the features see them: letters of ASCII in lower case, all bytes of other characters, else a space
_SEEN = np.full(256, 32, np.uint8)
_SEEN[128:] = np.arange(128, 256)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_CHUNK = 1 << 22


def counts_of(text: str) -> np.ndarray:
    """Hashed 3-gram and 4-gram counts of a whole text."""
    data = _SEEN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    total = np.zeros(DIMS, np.int64)
    for k in range(0, max(1, len(data) - 3), _CHUNK):
        b = data[k : k + _CHUNK + 3].astype(np.uint32)
        three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        end = min(len(b) - 2, _CHUNK)
        total += np.bincount(three[:end] >> np.uint32(19), minlength=DIMS)
        four = (three[:-1] ^ (three[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + b[3:] * np.uint32(0x165667B1)
        total += np.bincount(four >> np.uint32(19), minlength=DIMS)
    return total


def vector_of(text: str) -> np.ndarray:
    counts = counts_of(text)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 120) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge linear SVM, by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0 / (1.0 / c + 2.0 * 2.0)  # rows have squared length 2 with the bias
    shrink = 1.0 / c / len(x)
    w = v = np.zeros(x.shape[1], np.float32)
    b = u = np.float32(0)
    for t in range(rounds):
        pull = weight * y * np.maximum(0, 1 - y * (x @ v + u))
        w_new, b_new = v - step * (v * shrink - 2 * (pull @ x)), u - step * (u * shrink - 2 * pull.sum())
        ahead = np.float32(t / (t + 3))
        v, u = w_new + ahead * (w_new - w), b_new + ahead * (b_new - b)
        w, b = w_new.astype(np.float32), np.float32(b_new)
        v, u = v.astype(np.float32), np.float32(u)
    return np.append(w, b)


class Duel:
    """One-versus-one linear SVMs over some classes."""

    def __init__(self, names: Sequence[str], x: np.ndarray, labels: np.ndarray):
        self.names = sorted(names)
        self.pairs = list(combinations(range(len(self.names)), 2))
        rows = []
        for i, j in self.pairs:
            mask = np.isin(labels, [self.names[i], self.names[j]])
            rows.append(_svm((x if mask.all() else x[mask]).astype(np.float32, copy=False), np.where(labels[mask] == self.names[i], 1.0, -1.0).astype(np.float32)))
        self.weights = np.array(rows, np.float32)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each row and the chance that a logistic reading of its margins gives it."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums = np.zeros((len(x), n)), np.zeros((len(x), n))
        for (i, j), m in zip(self.pairs, margins.T, strict=True):
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sums[:, i] += np.clip(m, -1, 1)
            sums[:, j] -= np.clip(m, -1, 1)
        rank = votes + sums / (4 * n)
        best = rank.argmax(axis=1)
        return best, 1 / (1 + np.exp(-3 * sums[np.arange(len(x)), best] / (n - 1)))


def families_of(x: np.ndarray, labels: np.ndarray) -> dict[str, str]:
    """Family of each language: the listed one, else a group of at most GROUP unlisted languages with near mean vectors."""
    names = sorted(set(labels.tolist()))
    family = {name: FAMILY_OF[name] for name in names if name in FAMILY_OF}
    left = [name for name in names if name not in family]
    means = {name: x[labels == name].mean(axis=0, dtype=np.float32) for name in left}
    while left:
        first, *rest = left
        near = sorted(rest, key=lambda name: (float(((means[name] - means[first]) ** 2).sum()), name))[: GROUP - 1]
        family |= dict.fromkeys([first, *near], f"other:{first}")
        left = [name for name in rest if name not in near]
    return family


class Model:
    """Family decision and the duels inside each family."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.languages = sorted(set(labels.tolist()))
        family = families_of(x, labels)
        families = np.array([family[name] for name in labels], dtype=object)
        self.top = Duel(sorted(set(families.tolist())), x, families) if self.languages else None
        self.inner = {f: Duel(sorted(set(labels[families == f].tolist())), x[families == f], labels[families == f]) for f in (self.top.names if self.top else [])}

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        read = [i for i, t in enumerate(texts) if has_letter(t)] if self.top else []
        for k in range(0, len(read), 512):
            part = read[k : k + 512]
            x = np.stack([vector_of(texts[i]) for i in part])
            family, sure = self.top.decide(x)
            for f, name in enumerate(self.top.names):
                mine = np.flatnonzero(family == f)
                if len(mine):
                    duel = self.inner[name]
                    best, inner = duel.decide(x[mine])
                    for m, b, s in zip(mine, best, inner, strict=True):
                        names[part[m]], scores[part[m]] = duel.names[b], float(sure[m] * s)
        return names, scores


def sample(labelled: DataFrame, text: str, lang: str, doc_id: str, per_language: int, most: int, languages: int = LANGUAGES) -> DataFrame:
    """(i, l, t) of the rows to learn from: of each of the `languages` most frequent labels those with the smallest hashes, exactly.

    Hashes are spread evenly, so the wanted rows lie, with a margin, in a known share of their range, and only rows of that share
    are ranked; where too few do (rows repeated word for word have one hash), the share is widened."""
    rows = labelled.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null").withColumn("h", F.xxhash64("i", "t"))
    numbers = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["l"]: r["n"] for r in numbers.orderBy(F.desc("n"), "l").limit(languages).collect()}
    each = min(per_language, max(1, most // max(1, len(counts))))
    share = {name: min(1.0, (each + 6 * each**0.5) / n) for name, n in counts.items()}
    while True:
        last = F  # one flat CASE
        for name, part in share.items():
            last = last.when(F.col("l") == name, F.lit(min(2**63 - 1, int(-(2**63) + part * 2**64))))
        near = rows.where(F.col("h") <= last if share else F.lit(False))
        got = {r["l"]: r["n"] for r in near.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [name for name, n in counts.items() if got.get(name, 0) < min(each, n)]
        if not short:
            break
        share |= {name: min(1.0, share[name] * 8) for name in short}
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h", "i")))
    return ranked.where(F.col("k") <= each).select("i", "l", "t")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 600, most: int = 12_000, languages: int = LANGUAGES) -> Model:
    """Train on at most `per_language` rows of each of at most `languages` languages; only their feature vectors reach the driver."""

    def vectors(texts):
        return [[vector_of(t).astype(np.float16).tobytes() if has_letter(t) else None for t in texts]]

    kept = sample(labelled, text, lang, doc_id, per_language, most, languages)
    got = append_columns(kept, [F.col("t")], [T.StructField("v", T.BinaryType())], vectors, keep=["i", "l"]).where("v is not null").collect()
    got.sort(key=lambda r: (r["l"], str(r["i"]), r["v"]))
    labels = np.array([r["l"] for r in got], dtype=object)
    x = np.zeros((len(got), DIMS), np.float16)  # a duel takes single precision of its own rows
    for i in range(len(got)):
        x[i] = np.frombuffer(got[i]["v"], np.float16)
        got[i] = None
    del got
    return Model(x, labels)


def predict(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score under `names`. The model (under 1 MB for a few languages) is sent once to each executor."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return append_columns(df, [F.col(text)], fields, lambda texts: sent.value.predict(texts), keep)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
