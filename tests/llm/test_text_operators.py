import hashlib
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import fingerprints, language_id, license_scan, mixing, quality_classifier, quality_rules, url_filter

LONG = "word " * 30_000
ODD = [(1, None, "en", "s"), (2, "", None, None), (3, LONG, "en", "s"), (4, "\u00e9 \U0001f926", "fr", "s"), (4, "\u00e9 \U0001f926", "fr", "s"), (None, "x y", None, "t")]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("n", F.lit(7)).withColumn("score", F.lit("clash")).withColumn("hash", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 101])
def test_ranges(spark, n):
    from tessella.llm.common import block_of, block_starts

    d = spark.range(0, 3000, 7).select((F.col("id") - 500).alias("k"))
    starts = block_starts(d, "k", n)
    got = [tuple(r) for r in d.select("k", block_of(F.col("k"), starts)).collect()]
    assert all(b == sum(s <= k for s in starts[1:]) for k, b in got) and len(starts) <= n + 1
    assert d.limit(1).select(block_of(F.lit(None).cast("bigint"), starts)).first()[0] == 0
    assert block_starts(d.where("k > 9999"), "k", n) == []


# Fingerprints -----------------------------------------------------------------------------------------------------------
def test_edited_texts(docs):
    rows = texts(docs)
    out = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        e = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
    by = {}
    for i, t in rows:
        by.setdefault(t, set()).add(out[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len({f for v in by.values() for f in v}) <= len(by)


def canonical(t):
    import regex

    compose = lambda x: unicodedata.normalize("NFKC", x)
    return regex.sub(r"\s+", " ", compose(compose(t or "").casefold())).strip(" ")


def test_fingerprints_match_brute_force(docs, spark):
    """All columns, over the table with repeated and missing ids that fill many ranges."""
    rows = [(i, t) for i, t in texts(docs)]
    rows += [(7, f"copy {k % 40}" + " X" * (k % 3)) for k in range(400)] + [(None, f"none {k % 300}") for k in range(350)] + [(-5, None), (2**62 + 1, "end"), (2**62 + 3, "END")]
    xx = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").distinct().select("t", F.shiftright(F.xxhash64("t"), 11).alias("h")).collect()}
    order = sorted(((i is not None, i or 0, xx[t or ""], (t or "").encode()) for i, t in rows))
    want, forms = [], {}
    for k, (has, i, _, t) in enumerate(order):
        t, after = t.decode(), order[(k + 1) % len(order)][3].decode()
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        want.append((str(i if has else None), len(t), hashlib.sha256(e.encode()).hexdigest(), canonical(t), canonical(e), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(after))))
    out = fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in out]
    pick = lambda r: (*r[:3], *r[5:])
    assert sorted(map(pick, got)) == sorted(map(pick, want))
    by = {}
    for r in got:
        by.setdefault((r[0], r[1], r[2]), set()).add((r[3], r[4]))
    for r in want:  # the same canonical forms, and only they, have the same fingerprint
        found = by[(r[0], r[1], r[2])]
        if len(found) == 1:  # different texts may be edited into the same
            forms.setdefault(r[3], set()).add(next(iter(found))[0])
            forms.setdefault(r[4], set()).add(next(iter(found))[1])
    assert all(len(v) == 1 for v in forms.values()) and len({next(iter(v)) for v in forms.values()}) == len(forms)
    assert len({x for r in got for x in r[3:5]}) == len({x for r in want for x in r[3:5]})


def test_collisions_are_told_apart(docs, monkeypatch):
    """With a hash that meets all the time, the bytes decide, those of edited texts too."""
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.hex(F.octet_length(canon) % 5))
    rows = {i: t for i, t in texts(docs)}
    out = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    forms = {}
    ids = sorted(rows)
    for k, i in enumerate(ids):
        t, half = rows[i], len(rows[i]) // 2
        forms.setdefault(canonical(t), set()).add(out[i]["fingerprint"])
        forms.setdefault(canonical(t[: len(t) - half] + rows[ids[(k + 1) % len(ids)]][:half]), set()).add(out[i]["edited_fingerprint"])
    assert all(len(v) == 1 for v in forms.values()) and len({next(iter(v)) for v in forms.values()}) == len(forms)


def test_canonical_forms_meet(spark):
    d = spark.createDataFrame([(1, "Stra\u00dfe  \u00c9t\u00e9"), (2, "STRASSE E\u0301TE\u0301 \n"), (3, "\ufb01n"), (4, "FIN"), (5, "other")], "doc_id bigint, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprinted(d).collect()}
    assert f[1] == f[2] and f[3] == f[4] and len(set(f.values())) == 3


def test_fingerprints_of_odd_rows(spark, odd):
    out = fingerprints.edited_likeness(odd)
    assert out.count() == len(ODD) and out.where("doc_id = 4").select("fingerprint").distinct().count() == 1
    assert out.where("doc_id = 4 and near_next = 1").count() == 1
    one = spark.createDataFrame([(7, "abcd")], "doc_id bigint, text string")
    r = fingerprints.edited_likeness(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0 and r["near_edited"] == 0.0
    assert fingerprints.edited_likeness(one.limit(0)).count() == 0


def test_collisions_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.lit("same"))
    f = fingerprints.fingerprinted(docs.limit(20))
    assert f.select("fingerprint").distinct().count() == docs.limit(20).select(fingerprints.canonical(F.col("text"))).distinct().count()


def test_no_python_in_native_plans(docs):
    for df in (fingerprints.edited_likeness(docs), mixing.mixed(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Language ---------------------------------------------------------------------------------------------------------------
def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.prototypes(d.where(~language_id.held_out()))
    p = language_id.identified(d, model).join(d.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in p]) > 0.98 and all(0 <= r["score"] <= 1 for r in p)


def test_language_folds(spark):
    d = spark.range(50).select(F.col("id").alias("doc_id"), language_id.held_out("id").alias("h"), quality_classifier.held_out("id").alias("q"))
    for r in d.collect():
        c = zlib.crc32(str(r["doc_id"]).encode())
        assert r["h"] == (c % 3 == 1) and r["q"] == (c % 5 == 0)


def test_language_query_against_one_process(spark, sf):
    """The whole query against prototypes and cosines of one loop over the texts."""
    from tessella.llm import queries

    d = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    store, sums = language_id.Store(), {}
    for i, t, lang in zip(d["doc_id"], d["text"], d["lang"]):
        codes = language_id.letter_codes(t)
        if lang is not None and not fold(i) and len(codes):
            sums[lang] = sums.get(lang, 0) + store.bundle(*language_id.ngram_counts(codes)).astype(float) * len(codes)
    model = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    out = {r["doc_id"]: r for r in queries.op4(spark, sf).collect()}
    assert len(out) == len(d)
    close = 0
    for i, t in zip(d["doc_id"], d["text"]):
        v = language_id.text_vector(t, store)
        cos = {k: float(p @ v) / float(np.linalg.norm(v)) for k, p in model.items()} if v is not None else {"und": 0.0}
        best = sorted(cos.values())[-2:]
        close += len(best) == 2 and best[1] - best[0] < 0.02
        assert out[i]["held_out"] == fold(i) and abs(out[i]["score"] - max(0.0, best[-1])) < 0.03
        assert out[i]["lang_pred"] == max(cos, key=cos.get) or best[-1] - best[0] < 0.02, t
    assert close < len(d) / 20


def test_language_odd_rows(odd):
    model = language_id.prototypes(odd)
    out = language_id.identified(odd, model).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert by[1] == ("und", 0.0) == by[2] and by[3][0] == "en" and by[4][0] == "fr"
    assert {r["lang_pred"] for r in language_id.identified(odd, {}).collect()} == {"und"}
    assert language_id.filtered(odd, 0.2).columns == odd.columns


def test_bundles_add_up():
    """A text's vector is the weighted sum of its n-grams' bound and rotated letter vectors."""
    codes = language_id.letter_codes("Ab, ab")
    keys, weights = language_id.ngram_counts(codes)
    want = np.zeros(language_id.DIMENSIONS)
    g, a, b = language_id.GAP, ord("a"), ord("b")
    assert codes.tolist() == [g, a, b, g, a, b, g]
    grams = {1: [(a,), (b,)] * 2, 2: [(g, a), (a, b), (b, g)] * 2, 3: [(g, a, b), (a, b, g), (b, g, a), (g, a, b), (a, b, g)]}
    for n, gs in grams.items():
        for x in gs:
            v = np.ones(language_id.DIMENSIONS)
            for i, c in enumerate(reversed(x)):
                v = v * np.roll(language_id.letter_vector(c), i)
            want += v / len(gs)
    got = language_id.Store().bundle(keys, weights)
    assert np.allclose(got, want, atol=1e-4)


# Mixing -----------------------------------------------------------------------------------------------------------------
def fill(sizes, weights, share, most):
    total, cap = sum(sizes) * share, [most * s for s in sizes]
    out, left = [0.0] * len(sizes), set(range(len(sizes)))
    while left:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in left)
        w = sum(weights[i] for i in left)
        over = {i for i in left if rest * weights[i] / w > cap[i]}
        if not over:
            for i in left:
                out[i] = rest * weights[i] / w
            break
        for i in over:
            out[i] = cap[i]
        left -= over
    return out


def test_mix_meets_targets(docs):
    out = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    per = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), big=("size", "max")).sort_index()
    want = fill(per["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(per))], 1.5, 2)
    assert np.allclose(per["target"], want) and (abs(per["taken"] - per["target"]) <= per["big"]).all()
    assert (out["taken"] <= 2 * out["size"]).all() and set((out["taken"] % out["size"].clip(lower=1)).tolist()) == {0}
    again = mixing.mixed(docs.repartition(7)).toPandas()
    assert sorted(zip(out["doc_id"], out["taken"])) == sorted(zip(again["doc_id"], again["taken"]))
    rep = mixing.repeated(docs).groupBy("doc_id").count().toPandas()
    assert sorted(zip(rep["doc_id"], rep["count"])) == sorted((i, c) for i, c in zip(out["doc_id"], out["copies"]) if c)


def test_rounding_keeps_words_and_odds(spark):
    rng = np.random.default_rng(1)
    rows = [("s", int(i), int(rng.integers(1, 400)), 0.3, 3000) for i in range(3000)]
    t = {r["id"]: r["taken"] for r in mixing.rounded(spark.createDataFrame(rows, "source string, id bigint, size bigint, p double, n bigint")).collect()}
    assert len(t) == 3000 and set(t.values()) == {0, 1}
    words = sum(s * t[i] for _, i, s, _, _ in rows)
    assert abs(words - 0.3 * sum(r[2] for r in rows)) <= 400 and abs(np.mean(list(t.values())) - 0.3) < 0.03


def test_mix_odd_rows(spark, odd):
    out = mixing.mixed(odd).collect()
    assert len(out) == len(ODD) and all(r["taken"] == 0 for r in out if r["size"] == 0)
    clash = odd
    for c in ("copies", "_n", "_k", "_id", "_size", "_source", "c0"):
        clash = clash.withColumn(c, F.lit(77))
    rep = mixing.repeated(clash)
    assert rep.columns == clash.columns and all(r["_n"] == r["_k"] == r["copies"] == r["c0"] == 77 for r in rep.collect())
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0


# Quality ----------------------------------------------------------------------------------------------------------------
def slow_stats(t):
    w = (t or "").encode().split()
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    seen, hit = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for v in seen.values():
        if len(v) > 1:
            hit |= {i + k for i in v for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(lines)


@pytest.mark.parametrize("text", [None, "", "a", "a b c", "a b c a b c", "x\n\nx\nx ", "\u00e9#\u00e9 $ | <a>\tq\x0bz", "a a a a a", "l1\nl1\n \nl2\x85\n", LONG])
def test_stats(text):
    assert quality_rules.text_stats(text)[:6] == slow_stats(text)


def test_rules_judge_all(docs, odd, spark):
    out = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    for i, t in texts(docs):
        n, c, s, d, r, _ = slow_stats(t)
        o = out[i]
        assert (o["n_words"], o["word_chars"], o["n_symbols"], o["n_dup_lines"], o["n_repeat_words"]) == (n, c, s, d, r)
        assert o["base_failed"] == (n < 50 or 100 * r > 50 * n) and not (o["base_failed"] and o["kept"])
    kept = sorted(i for i, o in out.items() if o["kept"])
    assert sorted(r["doc_id"] for r in quality_rules.filtered(docs).select("doc_id").collect()) == kept
    assert quality_rules.judged(odd).count() == len(ODD) and quality_rules.filtered(odd).columns == odd.columns
    assert quality_rules.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_thresholds_follow_the_group(spark):
    """Symbols that are usual in one source are an outlier in another; sketches of small groups borrow from their language."""
    text = lambda k: " ".join(["word"] * 0 + [f"w{i}" + ("#" if i < k else "") for i in range(100)])
    rows = [(i, text(30 + i % 9), "en", "code") for i in range(150)] + [(1000 + i, text(0), "en", "news") for i in range(150)]
    rows += [(5000, text(35), "en", "news"), (5001, text(35), "en", "code"), (5002, " ".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(100)).replace("a", ""), "en", "news")]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out[5000] and out[5001] and out[0] and out[1000] and not out[5002]


def brute_rules(rows):
    """{doc_id: kept} and the share of rejections that hang on one bound alone, from sorted lists of bucketed values."""
    cut = lambda v: v >> max(v.bit_length() - quality_rules.BITS, 0) << max(v.bit_length() - quality_rules.BITS, 0)
    stats = {i: dict(zip(quality_rules.STATS, quality_rules.text_stats(t))) for i, t, _, _ in rows}
    base = {i for i, s in stats.items() if s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]}
    value = lambda i, m: quality_rules.MEASURES[m][2] * stats[i][quality_rules.MEASURES[m][0]] // max(stats[i][quality_rules.MEASURES[m][1]], 1) if m in quality_rules.MEASURES else stats[i][m]
    groups = {}
    for i, _, lang, source in rows:
        if i not in base:
            for key in ((lang, source), (lang,), ()):
                groups.setdefault(key, []).append(i)
    limits, kept, alone = {}, {}, {}
    for i, _, lang, source in rows:
        if i in base:
            kept[i] = False
            continue
        key = next((k for k in ((lang, source), (lang,)) if len(groups[k]) >= quality_rules.LEAST_GROUP), ())
        if key not in limits:
            n = len(groups[key])
            q = {m: [sorted(cut(value(j, m)) for j in groups[key])[-(-n * k // 4) - 1] for k in (1, 2, 3)] for m in [*quality_rules.MEASURES, *quality_rules.SIZES]}
            up = {f"hi_{m}": q[m][2] + quality_rules.REACH * (q[m][2] - q[m][1]) + f * slack // max(q[d][0], 1) for m, (_, d, f, slack, _) in quality_rules.MEASURES.items()}
            limits[key] = up | {"lo_word_length": q["word_length"][0] - quality_rules.REACH * (q["word_length"][1] - q["word_length"][0])}
        broken = [b for b, v in limits[key].items() if (value(i, b[3:]) > v if b[:2] == "hi" else value(i, b[3:]) < v)]
        kept[i] = not broken
        if len(broken) == 1:
            alone[broken[0]] = alone.get(broken[0], 0) + 1
    return kept, alone, limits


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_rules_match_brute_force(spark, sf, size):
    """All verdicts, and that the groups' own sketches decide: thresholds differ and no bound stands in for the others."""
    d = spark.read.parquet(sf.replace("sf0.001", size) + "/documents.parquet")
    want, alone, limits = brute_rules([tuple(r) for r in d.select("doc_id", "text", "lang", "source").collect()])
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judged(d).collect()} == want
    if size == "sf0.1":
        for m in quality_rules.MEASURES:
            assert len({v[f"hi_{m}"] for v in limits.values()}) > 1, m
        assert {"hi_symbols", "hi_repeats", "hi_upper", "hi_word_length"} <= set(alone), alone


def test_sketch_buckets(spark):
    for v, b in ((0, 0), (511, 511), (512, 512), (1023, 1022), (1025, 1024), (10**6, 999424)):
        assert spark.range(1).select(quality_rules.bucket(F.lit(v).cast("bigint"))).first()[0] == b


def test_classifier_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.scored(d, lab).join(lab, "doc_id").where(quality_classifier.held_out()).collect()
    good, bad = [r["score"] for r in out if r["quality"] == 1], [r["score"] for r in out if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and all(r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_classifier_query_against_one_process(spark, sf):
    """The whole query against the same model fitted from all features at once."""
    from tessella.llm import queries

    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    x = {i: quality_classifier.features(t) for i, t in zip(d["doc_id"], d["text"])}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    z = {c: np.array([x[i] for i, q in zip(lab["doc_id"], lab["quality"]) if q == c and i in x and not fold(i)]) for c in (0, 1)}
    m = quality_classifier.model_of({c: np.concatenate(([len(v)], v.sum(axis=0), (v.T @ v).ravel())) for c, v in z.items()})
    want = dict(zip(x, m.scores(np.array(list(x.values())))))
    out = queries.op9(spark, sf).collect()
    assert len(out) == len(d)
    for r in out:
        s = want[r["doc_id"]]
        assert r["held_out"] == fold(r["doc_id"]) and abs(r["score"] - s) < 1e-3 and (r["predicted"] == (s >= 0.3) or abs(s - 0.3) < 1e-3)


def test_classifier_against_plain_formula():
    rng = np.random.default_rng(0)
    k = len(quality_classifier.FEATURES)
    x = {0: rng.normal(0, 1, (50, k)), 1: rng.normal(0.5, 2, (80, k))}
    m = quality_classifier.model_of({c: np.concatenate(([len(v)], v.sum(axis=0), (v.T @ v).ravel())) for c, v in x.items()})
    sd = np.sqrt(sum(len(v) * v.var(axis=0) for v in x.values()) / 130)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 130 / np.outer(sd, sd)
    pooled = 0.9 * pooled + 0.1 * np.eye(k)
    q, logs = rng.normal(0, 1, k), []
    for v in x.values():
        s = 0.8 * np.cov(v.T, bias=True) / np.outer(sd, sd) + 0.2 * pooled
        d = (q - v.mean(axis=0)) / sd
        logs.append(-0.5 * d @ np.linalg.solve(s, d) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(80 / 50)) / quality_classifier.TEMPERATURE))
    assert abs(m.scores(q[None])[0] - want) < 1e-6


def test_classifier_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality_classifier.scored(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    assert quality_classifier.scored(odd, one).count() == len(ODD)
    assert quality_classifier.scored(odd.limit(0), one).count() == 0


# URLs and licences ------------------------------------------------------------------------------------------------------
def test_urls_against_loop(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("a.org", "", "allow"), (None, "/", "block")]
    urls = ["http://x.Example.NET/en/1?q", "http://net/", "http://net", "http://b.net/x#y", "http://notnet/", "https://example.com/de/", "https://example.com/DE/", "//no", None, "", "a://b.a.org/fr/x", "x://example.net:80/en/", "ftp://\u00c4.org/fr/1", "http://q.org?u=http://net/"] * 2
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    import re

    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (host, path, best and best[2], best[3] if best else "allow"), u
    assert url_filter.judged(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    n = 8
    b = url_filter.bloom(keys, n)
    q = keys.select("key", url_filter._block(F.col("key"), n).alias("block"), *[x.alias(f"b{i}") for i, x in enumerate(url_filter._bits(F.col("key")))]).join(b, "block")
    for i in range(4):
        q = q.where(F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) == F.col(f"b{i}"))
    assert q.count() == 500


def brute_licence(text, templates, least):
    ws, out = license_scan.words(text), {}
    grams = lambda w: set(zip(w, w[1:]))
    for name, many in templates.items():
        for t in many:
            tw = license_scan.words(t)
            tg = grams(tw)
            spots = [ws] + [ws[i : i + len(tw)] for i in range(max(0, len(ws) - len(tw)) + 1)]
            if tg:
                best = max((2 * len(grams(s) & tg) / max(1, len(grams(s)) + len(tg)) for s in spots), default=0)
                if best >= least:
                    out[name] = max(out.get(name, 0), best)
    return out


def test_edited_licences():
    """Copies with words changed, dropped and repeated, in other text: every window's coefficient counts."""
    rng = np.random.default_rng(3)
    t = license_scan.TEMPLATES
    s = license_scan.Scanner(t, 0.8)
    all_ = [x for texts in t.values() for x in texts]
    seen = 0
    for _ in range(400):
        ws = list(rng.choice(all_).split())
        for _ in range(int(rng.integers(0, 1 + len(ws) // 6))):
            at = int(rng.integers(len(ws)))
            ws[at : at + int(rng.integers(0, 2))] = list(rng.choice([*ws, "other", "words"], int(rng.integers(0, 3))))
        cut = list(rng.choice(all_).split())[: int(rng.integers(0, 30))]
        text = " ".join([*cut, *(["x", "y", "license", "the"] * int(rng.integers(0, 5))), *ws, *cut])
        want = brute_licence(text, t, 0.8)
        assert {k: round(v[0], 9) for k, v in s.scan(text).items()} == {k: round(v, 9) for k, v in want.items()}, text
        seen += bool(want)
    assert seen > 100


def test_licences(docs, odd):
    t = license_scan.TEMPLATES
    s = license_scan.Scanner(t, 0.8)
    cases = [t["MIT"][1], "x " * 50 + t["ISC"][0].upper() + " y" * 9, t["BSD-2-Clause"][0].replace("source", "sauce"), "Released under the\nMIT  License! All rights reserved.", "no", "", None, "license " * 20]
    for text in [*cases, *(x for _, x in texts(docs))]:
        got = s.scan(text)
        want = brute_licence(text, t, 0.8)
        assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert license_scan.scanned(odd).count() == len(ODD)
