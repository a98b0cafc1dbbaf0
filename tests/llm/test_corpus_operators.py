"""Near duplicates, decontamination, nearest vectors and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerostrata.llm import ann, decontaminate, graph, simhash

DIR = "/root/testdata/sf0.001"


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


# SimHash


def fingerprint_by_hand(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_by_hand(spark, edge_docs):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(60).unionByName(edge_docs.where("doc_id <> 6").select("doc_id", "text"))
    for r in simhash.fingerprints(docs).collect():
        assert r.fp % 2**64 == fingerprint_by_hand(r.text)
    # Spark's own hash of a shingle is the one of the contract
    import xxhash

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("shared,width", [(4, 3), (4, 4), (4, 2), (6, 3)])
def test_position_sets_cover(shared, width):
    from itertools import combinations

    sets = simhash.position_sets(shared, width)
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), shared))


@pytest.mark.parametrize("hot,width,bits", [(64, 3, 4), (3, 3, 4), (2, 4, 4), (3, 3, 2)])
def test_links_have_all_components(spark, hot, width, bits):
    rnd = random.Random(hot * 10 + width)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(14):
            y = x
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                y ^= 1 << b
            fps.add(y)
            if rnd.random() < 0.3:
                x = y
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.links(df, bits, width, hot)
    comps = {r.node % 2**64: r.component for r in graph.connected_components(links).collect()}
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits])
    got = [comps.get(f, f"own {f}") for f in fps]
    groups = {}
    for i, (a, b) in enumerate(zip(want, got, strict=True)):
        groups.setdefault(a, set()).add(b)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_edges(spark, edge_docs, no_docs):
    got = simhash.components(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert by[1] == [1] and by[2] == [1] and by[3] == [1]  # no words: fingerprint zero, one group
    assert by[7] == [7, 7] and by[8] == [7]
    assert simhash.components(no_docs).count() == 0


def test_components_of_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 5), (7, 6)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(links).collect()}
    assert got == {i: 0 for i in range(301)}
    assert graph.connected_components(links.limit(0)).count() == 0


# decontamination


ITEM = "A train leaves the station at 9 in the morning and travels 120 km to Madrid before it turns back for 45 minutes of rest"


def contaminated(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}


def test_decontamination_cases(spark):
    changed = ITEM.replace("120", "300").replace("Madrid", "Lisbon").replace("9", "7")
    got = contaminated(
        spark,
        [
            f"Intro text here. {ITEM}. And more of it.",  # verbatim
            f"Intro. {changed}.",  # new numbers and names
            ITEM.upper(),  # in capitals
            "A train leaves the station in the evening and nobody knows why it does",  # a shared start only
            ITEM.replace(" ", "\n\t"),
            "",
            None,
            "Something else entirely, with 9 trains and 120 km and 45 minutes.",
        ],
    )
    assert {d for d, _ in got} >= {0, 1, 4} and not {d for d, _ in got} & {3, 5, 6, 7}
    assert not got[0, 0].reparameterised and got[0, 0].coverage == 1.0
    assert got[1, 0].reparameterised


def test_slots_must_agree(spark):
    item = "if you have 5 apples and give away some of the 5 apples then how many apples are left of them"
    steady = item.replace("5", "8")
    mixed = item.replace("5", "8", 1).replace("5", "11")
    got = contaminated(spark, [steady, mixed], [item])
    assert (0, 0) in got and got[0, 0].reparameterised
    assert (1, 0) not in got


def test_decontamination_short_items_and_empty(spark, edge_docs, no_docs):
    assert set(contaminated(spark, ["well one two three four five six", "one two three"], ["one two three four five", "one two", None])) == {(0, 0)}
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.contaminated(edge_docs, bench).count() == 0
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(edge_docs, bench.limit(0)).count() == 0


def test_copies_of_numbers_and_names_are_found(spark):
    sums = "12 + 30 = 42, 17 + 25 = 42, 3 + 9 = 12, 8 + 14 = 22, 60 + 7 = 67"
    names = "the winners were Ada Lovelace, Alan Turing, Grace Hopper, Edsger Dijkstra, Barbara Liskov and Donald Knuth"
    frame = "on a fine day Anna Schmidt walked with Peter to see 7 old boats near the quiet harbour of Hamburg"
    texts = [f"Sums: {sums}.", f"List: {names}.", names.lower(), names.upper(), frame.lower().replace("7", "31"), sums.replace("42", "43").replace("12", "11").replace("7", "5")]
    got = contaminated(spark, texts, [sums, names, frame])
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 2)}
    assert all(got[k].coverage == 1.0 for k in got)
    assert [k for k in got if got[k].reparameterised] == [(4, 2)]


def test_one_edit_does_not_void_a_copy(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    item = " ".join([*words[:20], "5", *words[20:40], "5", *words[40:60], "5", *words[60:]])
    early = " ".join([*words[:20], "7", *words[20:40], "5", *words[40:60], "5", *words[60:]])
    two = " ".join([*words[:20], "7", *words[20:40], "8", *words[40:60], "5", *words[60:]])
    got = contaminated(spark, [item, early, two], [item])
    assert set(got) == {(0, 0), (1, 0), (2, 0)}
    assert [got[d, 0].n_windows for d in range(3)] == [76, 76, 60]  # the eight windows of each clashing filler don't count
    assert [got[d, 0].reparameterised for d in range(3)] == [False, True, False]


def test_runs_are_consecutive(spark):
    """Every ninth word changed: never more than eight words in a row, so neither coverage nor a run is reached."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    ninth = [f"x{w}" if i % 9 == 8 else w for i, w in enumerate(words)]
    one_run = [w if 10 <= i < 23 else f"x{w}" for i, w in enumerate(words)]
    short = [w if 10 <= i < 22 else f"x{w}" for i, w in enumerate(words)]
    assert set(contaminated(spark, [" ".join(t) for t in (words, ninth, one_run, short)], [" ".join(words)])) == {(0, 0), (2, 0)}


def test_slots_agree_across_an_inserted_word(spark):
    item = "every day after lunch in the school yard you have 5 apples and give away some of the 5 apples then how many apples are left of them"
    steady = item.replace("5", "8").replace("give away", "then give away")
    mixed = item.replace("5", "8", 1).replace("5", "11").replace("give away", "then give away")
    got = contaminated(spark, [steady, mixed], [item])
    assert (1, 0) not in got and (0, 0) in got and got[0, 0].reparameterised


def test_names_of_other_lengths(spark):
    item = "on the way home my friend Tom saw that the bridge to Madrid was closed and had to walk around it again"
    other = item.replace("Tom", "Mary Jane Watson").replace("Madrid", "San Juan")
    got = contaminated(spark, [other, other.replace("San Juan", "Rome")], [item])
    assert {d for d, _ in got} == {0, 1} and got[0, 0].reparameterised and got[0, 0].coverage == 1.0


def test_items_of_numbers_word_for_word(spark):
    item = "Sort 12 7 9 31 4 18 22 6 40 3 ascending now"
    got = contaminated(spark, [f"Task. {item}.", "Sort 1 2 3 4 5 6 7 8 9 10 ascending now"], [item, "yes no"])
    assert set(got) == {(0, 0)} and got[0, 0].coverage == 1.0 and not got[0, 0].reparameterised
    assert set(contaminated(spark, ["Yes, no!", "yes no maybe", "Well yes no"], ["yes no"])) == {(0, 0)}  # tiny items: whole texts only


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == want


# nearest vectors


def brute(rows, k):
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), j) for j, w in rows if j != i)[:k]
            out[i] = near
    return out


def test_nearest_small_table_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(40)]  # one vector many times
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] + [1.0] * 7), (904, [1.0, 2.0]), (905, []), (1000, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, rank int, q string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 10)
    assert set(got) == set(want)
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[1] for m in mine] == [j for _, j in near]
        assert np.allclose([m[2] for m in mine], [d for d, _ in near], atol=1e-12)


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(df, F.col("vec_id") == 77).count() == 0


def test_nearest_recall_with_pruning(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 6
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=16)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BUCKET", 500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, trees=8, sample=1500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 10)
    assert sum(len(found[q] & {j for _, j in near}) for q, near in want.items()) >= 0.9 * 10 * len(want)


def test_nearest_recall_and_share_at_defaults(spark):
    """All queries of a table against brute force, and how much of the index they look at."""
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    found = {}
    for r in ann.op4_nearest_vectors(spark, d).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 10)
    recall = sum(len(found[q] & {j for _, j in near}) for q, near in want.items()) / (10 * len(want))
    x = np.array([v for _, v in rows], float)
    search = ann.visited(len(x), 10.0, 0.7)
    forest = ann.Forest(x, len(x), 16, 16)
    leaves = np.stack([t.leaves(x) for t in forest.trees], axis=1)
    shares = []
    for q in want:
        seen = np.zeros(len(x), bool)
        for t, leaf in forest.probes(x[[i for i, _ in rows].index(q)], search):
            seen |= leaves[:, t] == leaf
        shares.append(seen.mean())
    print(f"recall {recall:.3f}, distinct share {np.mean(shares):.3f}")
    assert recall >= 0.9 and np.mean(shares) < 0.75
    # what a query looks at grows slower than the table
    assert ann.visited(10**9, 10.0, 0.7) / 10**9 < 0.05 < ann.visited(50_000, 10.0, 0.7) / 50_000 < 0.4


def test_nearest_hot_bucket_and_blocks(spark, monkeypatch):
    """Buckets above their size are dealt out in parts, and queries in blocks, with the same rows."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 10 == 0, leaf=64).collect()))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "BUCKET", 100)
    assert sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 10 == 0, leaf=64).collect())) == want


# pipeline


def near_copies(spark, pairs):
    """Which of two texts go together in the near-duplicate stage."""
    import corpus_pipeline

    docs = spark.createDataFrame([(2 * i + k, t, "en", "s", len(t)) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    return [2 * i + 1 not in kept for i in range(len(pairs))]


def test_near_duplicates_of_changed_words(spark):
    rnd = random.Random(4)

    def words(n):
        return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n)]

    pairs = []
    for _ in range(20):  # one word in fifty changed: 0.8 of the five-word shingles stay
        a = words(300)
        b = list(a)
        for k in range(25, 300, 50):
            b[k] = words(1)[0] + "zz"
        pairs.append((" ".join(a), " ".join(b)))
    assert sum(near_copies(spark, pairs)) >= 16
    assert not any(near_copies(spark, [(" ".join(words(200)), " ".join(words(200))) for _ in range(20)]))


def test_near_duplicates_against_brute_force(spark):
    """What the stage keeps of a table with copies of all kinds, from fingerprints and pairs by hand."""
    import re

    import corpus_pipeline
    import xxhash

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    def bits(hashes, n):
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)

    def marks(text):
        w = words(text)
        if not w:
            return [0] * 4
        shingles = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        bag = sorted(set(w))
        halves = [xxhash.xxh3_128_digest(x.encode(), 42) for x in bag]
        kinds = [[xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]]
        kinds += [[int.from_bytes(h[k : k + 8], "little") for h in halves] for k in (0, 8)]
        kinds.append([int.from_bytes(xxhash.xxh64_digest(x.encode(), 42), "little") for x in bag])
        return [bits(k, len(k)) for k in kinds]

    found = [marks(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if any((a ^ b).bit_count() <= 4 for a, b in zip(found[i], found[j], strict=True))]
    groups = {}
    for (doc, _), g in zip(rows, union_find(len(rows), near), strict=True):
        groups.setdefault(g, []).append(doc)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()}
    assert got == {min(g) for g in groups.values()} and len(got) < len(rows)


def test_near_duplicates_with_repeated_ids(spark):
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [
        (1, long, "a"),
        (2, long, "b"),  # a copy
        (2, other, "c"),  # another text under the copy's id stays
        (3, "alone in here with a few words", "d"),
        (3, "alone in here with a few words", "d"),  # the same row twice: one stays
        (3, "alone in here with a few words", "e"),
        (None, other + " and", "f"),
        (None, "no id at all for this one", "g"),
        (None, "no id at all for this one", "g"),
        (9, None, "h"),
        (10, "", "i"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect())
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, long), (2, other), (3, "alone in here with a few words")]
    assert (0, "no id at all for this one") in got and got.count((0, "no id at all for this one")) == 1
    assert (9, "") in got and (10, "") not in got  # texts without words are one group
    assert len(got) in (5, 6)  # other and "other and" may or may not be near enough


def test_leaks_with_repeated_ids(spark):
    import corpus_pipeline

    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    rows = [(1, f"so {item} it is"), (1, "a clean text under the same id"), (None, item), (None, "clean and without an id"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __key string")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.benchmark_leaks(spark, docs, DIR).collect()}
    assert got == {(1, "a clean text under the same id"), (None, "clean and without an id"), (4, None)}


def test_language_replaces_what_the_text_contradicts(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = docs.withColumn("given", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 40 == 3, F.lit("en")).otherwise(F.col("lang")))
    got = corpus_pipeline.language(spark, wrong, DIR)
    assert got.where("lang = given").count() >= 0.97 * got.count()


def test_missing_shared_folder_is_an_error_on_a_cluster(spark):
    from types import SimpleNamespace

    from aerostrata.llm import common

    jvm = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    fake = SimpleNamespace(sparkContext=SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: jvm), getConf=lambda: {}, master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_folder(fake)


def test_pipeline_stages(spark, edge_docs, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    wide = docs.withColumn("n_secrets", F.lit("x")).withColumn("lang_pred", F.lit("y"))
    kept = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, DIR)
        assert out.columns == wide.columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert {r[0] for r in kept.select("n_secrets").distinct().collect()} == {"x"}
    ids = {r.doc_id for r in kept.collect()}
    comps = simhash.components(docs).collect()
    leaks = {r.doc_id for r in decontaminate.op3_decontaminate(spark, DIR).collect()}
    firsts = {r.component_id for r in comps}
    assert ids <= {r.doc_id for r in comps} - leaks and len(ids) >= 0.9 * len(firsts - leaks)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DIR)
    assert last.count() == len(ids)
    assert corpus_pipeline.run(spark, DIR).count() == len(ids)


def test_pipeline_edges(spark, edge_docs, no_docs):
    import corpus_pipeline

    docs = edge_docs.where("doc_id is null or doc_id <> 6")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert {r.doc_id for r in docs.collect()} == {5, 7, 9, None}
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DIR)
    assert empty.count() == 0


def test_language_without_labels_keeps_documents(spark):
    import corpus_pipeline

    rows = [(1, "a clean text", None), (2, "ещё один текст", None), (3, "12 !", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language(spark, docs, DIR)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2] and got.columns == docs.columns
