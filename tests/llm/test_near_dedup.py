import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import near_dedup as nd

DOC = "doc_id bigint, text string, lang string"


def sets(text, width):
    w = text.encode().lower().split() if text else []
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, width, percent):
    s = {i: sets(t, width) for i, t in docs}
    up = {i: i for i in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(s)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    out = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([1, 3, 6, 40, 120]))]
        if k % 4 == 0:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 7])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t) if rng.random() < 0.5 else "\n".join(t).upper())
    out += ["", None, "   \n", "A", "a", "x y", "X  Y\t"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("width", [4, 5])
def test_matches_brute_force(spark, width):
    docs = corpus(width)
    df = spark.createDataFrame([(i, t, None) for i, t in docs], DOC)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df, width).collect()}
    want = brute(docs, width, 80)
    assert got == want


def test_large_group_goes_through_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(70)]
    docs = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            t[rng.randrange(70)] = f"v{rng.randrange(10**6)}"
        docs.append((i, " ".join(t)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 4).collect()}
    assert got == brute(docs, 4, 80)


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, "a b c d e f", 9), (1, "a b c d e f", 9), (2, "A B C d e f", 8), (None, "a b c d e f", 1), (3, None, 2), (4, "\u00c4 x", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rep int")
    got = sorted((tuple(r) for r in nd.near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True), (3, 0, 3, True), (4, 1, 4, True)], key=str)
    kept = nd.deduplicated(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4"]
    assert nd.near_duplicates(df.where("doc_id > 99"), 4).count() == 0


def brute_rows(rows, width, percent):
    """Like brute, of rows (doc_id, text) whose doc_ids may be repeated: texts link, and so do the texts of one doc_id."""
    of = brute(list(enumerate(t for _, t in rows)), width, percent)
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    groups = {}
    for k, (i, _) in enumerate(rows):
        if of[k][0]:
            groups.setdefault(of[k][1], []).append(i)
    for g in groups.values():
        for i in g:
            a, b = root(i), root(g[0])
            up[max(a, b)] = min(a, b)
    return sorted((i, of[k][0], root(i) if of[k][0] else i) for k, (i, _) in enumerate(rows))


def test_one_doc_id_with_several_texts(spark):
    one, two = "a b c d e f g h", "p q r s t u v w x y"
    rows = [(1, one), (5, two), (5, one), (7, two)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_gone", F.lit(3)).repartition(2)
    assert [r["component_id"] for r in nd.near_duplicates(df, 4).collect()] == [1, 1, 1, 1]
    kept = nd.deduplicated(df, 4)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, one), (5, two)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, rng.randrange(200)]), t) for i, t in corpus(seed)] + [(-7, t) for _, t in corpus(9)[:25]]
    rows += rng.sample(rows, 30)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df, 4).collect())
    assert got == brute_rows(rows, 4, 80)
    of = brute(list(enumerate(t for _, t in rows)), 4, 80)
    left = [(r["doc_id"], r["text"]) for r in nd.deduplicated(df, 4).collect()]
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(of[k][1] if of[k][0] else ("", r[0]), []).append(r)
    assert sorted(i for i, _ in left) == sorted(min(i for i, _ in g) for g in groups.values())
    assert all(any(x in g for x in left) for g in groups.values())


def test_tables_are_removed(spark, sf):
    from tessella.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = common.shared_dir(spark).removeprefix("file://") + f"/tessella/{spark.sparkContext.applicationId}"
    with common.scratch(spark):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        out = nd.near_duplicates(docs, 4)
        assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} <= {"sigs", "labels"}
        out.count()
    assert set(os.listdir(folder)) <= before


def shingles(text, width):
    return {hash(x) for x in sets(text, width)}


def test_recall_of_links(spark, sf):
    """Every document whose id is divisible by 20 against all rows of the larger table: all its links are inside its component."""
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet")
    s = {r["doc_id"]: shingles(r["text"], 4) for r in docs.select("doc_id", "text").collect()}
    holders = {}
    for i, x in s.items():
        for h in x:
            holders.setdefault(h, []).append(i)
    label = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs, 4).collect()}
    found = missed = 0
    for q in s:
        if q % 20 == 0:
            common = Counter(i for h in s[q] for i in holders[h] if i != q)
            for i, both in common.items():
                if 100 * both >= 80 * (len(s[q]) + len(s[i]) - both):
                    found, missed = found + 1, missed + (label[i] != label[q])
    assert found > 200 and missed == 0


def test_signatures_are_unbiased_and_corrected():
    rng = np.random.default_rng(0)
    for n in (4, 40, 900):
        share = []
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = a.copy()
            b[: n // 4] = rng.integers(0, 2**63, n // 4, dtype=np.uint64)
            share.append((nd.registers(a) == nd.registers(np.unique(b))).mean())
        want = (n - n // 4) / (n + n // 4)
        assert abs(np.mean(share) - want) < 0.03
    assert 0 < nd.accidental(np.array([500.0]), np.array([500.0]))[0] < 0.01
    assert not nd.registers(np.empty(0, np.uint64)).any()


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (20, 1)] + [(100 + i, 101 + i) for i in range(60)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in nd.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(61)}


def test_pipeline_stage_goes_by_rows(spark, sf):
    """Repeated rows, rows without a doc_id and different texts under one doc_id."""
    import corpus_pipeline

    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one, "x"), (1, one, "x"), (1, one, "y"), (2, two, "x"), (2, one + " z", "x"), (3, two, "x"), (3, " ".join(f"c{i}" for i in range(9)), "x"), (None, one, "x"), (None, "p q r s t u", "x"), (None, "p q r s t u", "x"), (4, "", "x"), (4, None, "x"), (5, "", "x"), (None, "", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, sf)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"] or None) for r in out.collect()), key=str)
    assert got == sorted([(1, one), (2, two), (3, rows[6][1]), (None, rows[8][1]), (4, None), (5, None), (None, None), (None, None)], key=str)
