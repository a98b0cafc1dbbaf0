"""Mixing, spelling variants and periodic runs against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm import mixing, runs, spelling
from aerostrata.llm.fm_index import FmIndex

DIR = "/root/testdata/sf0.001"


# mixing


def targets_by_hand(sizes: dict, share=1.5, most=2):
    """Water-filling over sources in order of code points, null last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, rest, out = Fraction(share) * sum(sizes.values()), set(names), {}
    while rest:
        total = sum(weight[s] for s in rest)
        full = {s for s in rest if left * weight[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in rest}
        for s in full:
            out[s] = Fraction(most * sizes[s])
        left, rest = left - sum(out[s] for s in full), rest - full
    return out


def word_count(text):
    return len((text or "").encode().split())


def test_mix_of_all_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += word_count(r.text)
    want = targets_by_hand(sizes)
    got = mixing.op11_mix_sources(spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    by_id = {r.doc_id: r for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == word_count(by_id[r.doc_id].text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]))
        assert r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"]
        assert r.copies in (int(want[r.source] / sizes[r.source]), -(-want[r.source] // sizes[r.source]))
        taken[r.source] += r.taken
    largest = {s: max(r["size"] for r in got if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in sizes)


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    """A source with half of all rows, in many blocks of a deep tree, and heavy tails of sizes: half of a document is the most missed."""
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * min(900, int(rng.paretovariate(0.8)) + 1)), "hot" if i % 2 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(docs, block=40, fan=3)
    again = mixing.mix(docs.repartition(7), block=40, fan=3)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    sums = [F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("largest")]
    for r in first.groupBy("source").agg(*sums).collect():
        assert abs(r.t - r.target) <= r.largest / 2, r
    for r in mixing.mix(docs.where("length(text) < 60")).groupBy("source").agg(*sums).collect():
        assert abs(r.t - r.target) <= 15, r
    other = mixing.mix(docs, block=40, fan=3, seed=7)
    assert first.select("doc_id", "copies").exceptAll(other.select("doc_id", "copies")).count() > 0


def test_mix_keeps_expectations():
    """Over many seeds every document is taken as often as it is due; words stay the same in each."""
    kind = T.StructType.fromDDL("doc_id long, source string, node long, size long, copies long, part double")
    rows = [(i, "a", 0, 90 - i, 1, [0.2, 0.45, 0.7][i % 3]) for i in range(60)]
    due = sum(r[3] * (r[4] + r[5]) for r in rows)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=kind.fieldNames())
    draws, total = 600, Counter()
    for seed in range(draws):
        got = [r for part in mixing._pivot(iter([batch.slice(0, 25), batch.slice(25)]), kind, 0, True, seed) for r in part.to_pylist()]
        assert len(got) == 60 and {r["part"] for r in got} == {0.0}
        assert abs(sum(r["size"] * r["copies"] for r in got) - due) <= 45
        total.update({r["doc_id"]: r["copies"] - 1 for r in got})
    assert all(abs(total[r[0]] / draws - r[5]) < 4.5 * (0.25 / draws) ** 0.5 for r in rows[:55])


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 10**rng.randint(1, 6)]) for i in range(200)} | {None: 77, "": 3, "é": 5, "😀": 9}
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(3)
    got = {r.source: r.target for r in mixing.with_targets(mixing.sources_of(sized).cache()).collect()}
    assert got == {s: pytest.approx(float(t)) for s, t in targets_by_hand(sizes).items()}


def test_mix_edge_cases(spark, edge_docs, no_docs):
    got = mixing.mix(edge_docs)
    assert got.count() == edge_docs.count() and got.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    rows = got.collect()
    assert {r.taken for r in rows if r["size"] == 0} == {0}
    assert [r.source_size for r in rows if r.source is None][0] == 3
    assert mixing.mix(no_docs).count() == 0
    blank = edge_docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}
    docs = edge_docs.where("doc_id in (4, 5, 6, 9)").withColumn("copy", F.lit("clash"))
    plan = mixing.mix(docs)
    out = mixing.repeated(docs, plan)
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert dict(out.dtypes)["copy"] == "bigint"


# spelling variants


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] if len(x) == len(y) else x[1:] == y or x == y[1:]


def variants_by_hand(vocabulary: dict[str, int], times=10) -> dict:
    form, count = {}, {}
    for w, n in vocabulary.items():
        around = [(-vocabulary[v], v) for v in vocabulary if near(w, v)]
        count[w] = len(around)
        if around and -min(around)[0] >= times * n:
            form[w] = min(around)[1]

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n, count[w], form.get(w), vocabulary.get(form.get(w)), root(w)) for w, n in vocabulary.items()}


def collected(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_fm_index_finds_all_and_only_one_error():
    rng = random.Random(3)
    for t in range(300):
        letters = "abcdefé😀z"[: rng.choice([2, 3, 6])]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([6, 14, 40])))) for _ in range(rng.randint(1, 120))})
        asked = words if t % 2 else ["".join(rng.choice(letters + "q") for _ in range(rng.randint(0, 8))) for _ in range(20)]
        exact = np.array([rng.randint(0, len(q)) for q in asked])
        got = list(zip(*(a.tolist() for a in FmIndex(words).one_error(asked, exact)), strict=True))
        want = set()
        for i, (q, e) in enumerate(zip(asked, exact.tolist(), strict=True)):
            front, end = q[: len(q) - e], q[len(q) - e :]
            want |= {(i, j) for j, w in enumerate(words) if w.endswith(end) and near(front, w[: len(w) - e])}
        assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError, match="delimiter"):
        FmIndex(["a\0b"])


@pytest.mark.parametrize(("chunk", "hot"), [(40_000, 100_000), (5, 100_000), (3, 4)])
def test_variants_are_those_of_brute_force(spark, chunk, hot):
    """Also with indexes of a few words and with halves that are dealt into blocks."""
    rng = random.Random(8)
    vocabulary = {}
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 11)))
        vocabulary[w] = rng.choice([2, 3, 20, 40, 400, 4000])
        for _ in range(3):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]])
            if len(v) >= 7:
                vocabulary[v] = rng.choice([2, 3, 20, 40, 400, 4000])
    want = variants_by_hand(vocabulary)
    assert len({r[4] for r in want.values()}) < len(want) and any(r[2] and r[2] != r[4] for r in want.values())  # chains, too
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert collected(spelling.variants(df, chunk=chunk, hot=hot)) == want


def test_op12_on_a_table(spark):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect():
        for m in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = m.translate(low)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    vocabulary = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    by_size = defaultdict(dict)
    for w, n in vocabulary.items():
        by_size[len(w)][w] = n
    got = collected(spelling.op12_spelling_variants(spark, DIR))
    assert {w: r[0] for w, r in got.items()} == vocabulary
    for w in sorted(vocabulary)[::7]:  # brute force over all words for every seventh
        around = [(-n, v) for s in (len(w) - 1, len(w), len(w) + 1) for v, n in by_size[s].items() if near(w, v)]
        best = min(around, default=(0, None))
        form = best[1] if -best[0] >= 10 * vocabulary[w] else None
        assert got[w][1:4] == (len(around), form, vocabulary.get(form)), w


def test_words_and_their_edge_cases(spark, edge_docs, no_docs):
    text = "Spelling SPELLING spelling-Élèves élèves straße×÷ über12345678 speling " + "x" * 9000
    df = spark.createDataFrame([(1, text), (2, text), (2, text), (None, "spelling"), (3, None)], "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(df, slip=None).collect()}
    assert got == {"spelling": 10, "speling": 3, "straße×÷": 3, "x" * 9000: 3}
    slipped = spelling.word_counts(df, slip=1)  # every run loses a letter
    assert {len(r.word) for r in slipped.collect()} == {7, 8999}
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
    assert spelling.variants(spelling.word_counts(edge_docs, min_count=1)).columns == ["word", "n", "n_near", "form", "form_n", "root"]
    long = spelling.variants(spark.createDataFrame([("x" * 9000, 50), ("x" * 8999, 2), ("y" * 7, 2)], "word string, n long"))
    assert {(len(r.word), r.n_near, r.form_n, len(r.root)) for r in long.collect()} == {(9000, 1, None, 9000), (8999, 1, 50, 9000), (7, 0, None, 7)}


# periodic runs


def runs_by_hand(words, min_length=6, min_exponent=4):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            part = words[s : s + size]
            if size >= max(min_length, min_exponent * q) and all(any(part[k] != part[k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    for t in range(1500):
        n = rng.randint(0, 40)
        words = [rng.randint(0, rng.choice([1, 2, 3, 5])) for _ in range(n)]
        if rng.random() < 0.5 and n > 4:
            a, p = rng.randrange(n), rng.randint(1, 6)
            words = words[:a] + [words[a + (i - a) % p] if a + (i - a) % p < n else words[i] for i in range(a, n)]
        least, times = [(2, 2), (6, 4), (rng.randint(2, 10), rng.randint(2, 5))][t % 3]
        got, want = runs.runs_of(words, least, times), runs_by_hand(words, least, times)
        assert got == want, (words, least, times)
        dropped = {i for s, size, q in want for i in range(s + q, s + size)}
        assert runs.without_repeats(words, got) == [w for i, w in enumerate(words) if i not in dropped]


def test_extensions_take_the_longest_common_prefix():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randint(1, 3) for _ in range(rng.randint(2, 120))]
        i, j = np.triu_indices(len(s) + 1, 1)
        want = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            k = 0
            while b + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            want.append(k)
        ext = runs.Extensions(s)
        assert ext.of(i, j).tolist() == want
        assert np.argsort(ext.ranks).tolist() == sorted(range(len(s) + 1), key=lambda k: s[k:])
        assert np.argsort(ext.other_ranks).tolist() == sorted(range(len(s) + 1), key=lambda k: [-x for x in s[k:]])


def test_op13_on_a_table(spark):
    got = {r.doc_id: r for r in runs.op13_periodic_runs(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue
        want = runs_by_hand(words)
        r = got[d.doc_id]
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert r.n_runs == len(want)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in want).encode()).hexdigest()
        dropped = {i for s, size, q in want for i in range(s + q, s + size)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
        some += bool(want)
    assert some > 10


def test_runs_edge_cases(spark, edge_docs, no_docs):
    got = runs.with_runs(edge_docs.withColumn("start", F.lit("clash")), doc_id="doc_id")
    rows = got.collect()
    assert got.columns[-7:] == [f.name for f in runs.FIELDS] and len(rows) == edge_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) == (0, None, empty, empty) for r in rows if not (r.text or "").strip(" \n\t"))
    assert runs.with_runs(no_docs).count() == 0
    long = ["a b c d e "[2 * (i % 5)] for i in range(50_000)]
    df = spark.createDataFrame([(1, " ".join(long)), (2, None), (3, "to be or not " + "la " * 6)], "doc_id long, text string")
    out = {r.doc_id: r for r in runs.collapse(df).collect()}
    assert out[1].text == "a b c d e" and [tuple(x) for x in out[1].runs] == [(0, 50_000, 5)]
    assert out[2].text is None and out[2].runs == []
    assert out[3].text == "to be or not la" and [tuple(x) for x in out[3].runs] == [(3, 6, 1)]
