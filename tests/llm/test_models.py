"""Language identification, neighbours and mixing: held-out accuracy, recall and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomwell.llm import language, mixing, neighbours

SF = "/root/testdata/sf0.001"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs.filter("not held_out"))
    out = language.identify(docs, model).filter("held_out and lang is not null").select("lang", "lang_pred", "lang_score", "lang_rejected").collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    assert sum(r["lang_rejected"] for r in out) / len(out) < 0.05 and all(0 <= r["lang_score"] <= 1 for r in out)


def test_backed_off_probabilities_sum_to_one():
    rng = random.Random(0)
    text = "".join(rng.choices("abcde ", k=3000))
    codes, counts = np.unique(language.grams([text])[0], return_counts=True)
    m = language.KneserNey(codes, counts)
    for context in ("abc", "a b", "zzz", "ezz"):
        base = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        p = m.prob(np.array([base | ord(c) for c in "abcde "], np.uint64))
        assert p.sum() <= 1 + 1e-9 and p.sum() > 0.8
    model = language.LanguageModel(["x"], [m], np.array([np.inf]))
    fresh = language.grams(["abz cde qq"])[0]
    assert np.allclose(model.entropies(["abz cde qq"])[0][0, 0], -np.log(m.prob(fresh)).mean(), atol=1e-5)


def brute_kneser_ney(text, order):
    """Interpolated Kneser-Ney by its definition, from plain counters; a function of a context and a character."""
    padded = "\1" * (order - 1) + text
    top = Counter(padded[i : i + order] for i in range(len(text)))
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    alphabet = len({g[-1] for g in top}) + 1

    def discount(c):
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))

    def prob(context, char, n=order):
        if n == 0:
            return 1 / alphabet
        ctx, c = context[len(context) - n + 1 :], levels[n]
        lower = prob(context, char, n - 1)
        total = sum(v for g, v in c.items() if g[:-1] == ctx)
        if not total:
            return lower
        types = sum(g[:-1] == ctx for g in c)
        return (max(c[ctx + char] - discount(c), 0) + discount(c) * types * lower) / total

    return prob


def test_kneser_ney_against_brute_force():
    rng = random.Random(4)
    text = re.sub(" +", " ", "".join(rng.choices("abc ", k=400))).strip()
    codes, counts = np.unique(language.grams([text])[0], return_counts=True)
    m, prob = language.KneserNey(codes, counts), brute_kneser_ney(text, language.ORDER)
    for context in ("abc", "a b", "zza", "ccc", "\1\1a"):
        base = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        got = m.prob(np.array([base | ord(c) for c in "abc z"], np.uint64))
        assert np.allclose(got, [prob(context, c) for c in "abc z"], atol=1e-12)


def test_letters_beyond_the_first_plane():
    letters = language.letters()
    gothic = [letters[i] for i in range(0x10330, 0x10340)]
    assert len(set(gothic)) == 16 and letters[0x10400] == letters[0x10428] and not set(gothic) & {letters[ord(c)] for c in "abcdefgé日"}
    assert letters[ord("Ä")] == letters[ord("ä")] == ord("ä") and letters[ord("1")] == language.BLANK


def test_rejection_and_unknown(spark, twice, nothing):
    rows = [(i, " ".join(random.Random(i).choices("the of and to in is that for with as on by this".split(), k=60)), "en") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, score, out = model.predict(["the of and that is in", "", "12 !", "zqxj kvwq zzxq qqkj xzvj " * 20])
    assert lang == ["en", "und", "und", "en"] and out.tolist() == [False, True, True, True] and score[1] == 0
    got = language.identify(twice, model)
    assert got.count() == twice.count() and got.columns == [*twice.columns, "lang_pred", "lang_score", "lang_rejected"]
    none = language.fit(nothing)
    assert {r["lang_pred"] for r in language.identify(twice, none).collect()} == {"und"}
    assert language.identify(nothing, model).count() == 0


def vectors(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dims)).astype(np.float32)


def brute_nearest(v, ids, q, k):
    d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]


def test_neighbour_recall(spark):
    v = vectors(3000)
    v[5], v[300] = v[100], v[100]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 3000, 100)) and all(len(x) == 10 for x in by.values())
    ids = np.arange(3000)
    hits = 0
    for q, found in by.items():
        want = brute_nearest(v, ids, q, 10)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        exact = dict(brute_nearest(v, ids, q, 3000))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in found) and found == sorted(found, key=lambda x: (x[1], x[0]))
    assert hits / (10 * len(by)) >= 0.9
    assert [i for i, _ in by[100][:2]] == [5, 300]


def test_neighbours_across_blocks(spark, monkeypatch):
    """Several blocks of vectors and of queries, with ties and repeated ids in different ones."""
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "QUERIES", 6)
    v = vectors(2400, seed=3)
    v[[7, 1100, 1900]] = v[200]
    ids = [*range(2400), 900, 900]
    v = np.concatenate([v, v[[900, 901]]])  # the id 900 again, with its own vector and another
    got = neighbours.nearest(spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, v)], "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 2400, 100)) and all(len(x) == 10 for x in by.values())
    assert [i for i, _ in by[200][:3]] == [7, 1100, 1900] and all(i != q for q, x in by.items() for i, _ in x)
    hits = 0
    for q in set(by) - {900}:
        want = {i for i, _ in brute_nearest(v, np.array(ids), q, 10)}
        hits += len(want & {i for i, _ in by[q]})
    assert hits / (10 * (len(by) - 1)) >= 0.9


def test_neighbours_in_rounds(spark, monkeypatch):
    """Many blocks of queries and of vectors: the plan has no task for each pair of them, and rounds give what one round gives."""
    v = vectors(2400, seed=4)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    whole = sorted(map(tuple, neighbours.nearest(df).collect()))
    monkeypatch.setattr(neighbours, "QUERIES", 2)
    monkeypatch.setattr(neighbours, "ROUND", 16 * 2 * 5)
    out = neighbours.nearest(df)
    parts = out.select("query_id").distinct().count(), out.rdd.getNumPartitions()
    assert parts[0] == 24 and parts[1] <= 24 and sorted(map(tuple, out.collect())) == whole
    plan = out._jdf.queryExecution().toString()
    assert "Repartition" not in plan and "Generate" not in plan


def test_share_of_entries_read():
    """Well under half of the projections' entries, on vectors without structure and on clustered ones, at a recall of 0.9."""
    rng = np.random.default_rng(0)
    for v in (rng.normal(size=(8192, 64)), rng.normal(size=(20, 64))[rng.integers(0, 20, 8192)] + 0.2 * rng.normal(size=(8192, 64))):
        a = neighbours.directions(64)
        block, hits = neighbours.Block(np.arange(8192), v, a), 0
        for q in range(0, 8192, 400):
            found = {i for i, _ in block.search(q, v[q], v[q] @ a, 10)}
            hits += len(found & {i for i, _ in brute_nearest(v, np.arange(8192), q, 10)})
        share = block.read / (21 * 8192 * neighbours.PROJECTIONS)
        print("share read", share, "recall", hits / 210)
        assert share < 0.4 and hits / 210 >= 0.9


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [1.0, 0.5]), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (7, [float("inf"), 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = [tuple(r) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 6)]
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 1")).count() == 0


def brute_base(rows):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(small)) for _, t in rows]
    out_ = [zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2 for d, _ in rows]
    c = Counter(w for x, o in zip(tokens, out_) if not o for w in x)
    ends = sum(not o for o in out_)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    unit = math.log10(n + v + 1)
    return sorted((str(d), o, len(x) + 1, sum(c[w] > 0 for w in x) + (ends > 0), n, round(sum(math.log10(c[w] + 1) - unit for w in x) + math.log10(ends + 1) - unit, 6)) for (d, _), x, o in zip(rows, tokens, out_))


def test_frequent_values():
    """Keys that lose their slots in both tables are found too, and no other key is; words' values are not rounded."""
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(1, 2**63, 5000).astype(np.uint64))
    values = rng.random(len(keys))
    few = mixing.Frequent(keys, values, 1 << 10, np.float64)
    asked = np.concatenate([keys[::-1], rng.integers(1, 2**63, 5000).astype(np.uint64)])
    got, there = few.of(asked)
    assert len(few.lost) > 1000 and there.tolist() == np.isin(asked, keys).tolist()
    assert got.tolist() == [dict(zip(keys.tolist(), values.tolist())).get(k, 0.0) for k in asked[:50].tolist()] + np.where(there, values[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)], 0)[50:].tolist()
    assert len(mixing.Frequent(keys[:0], values[:0], 1 << 10, np.float64).of(keys)[0]) == len(keys)


def test_base_scores(twice):
    rows = [(r["doc_id"], r["text"]) for r in twice.collect()]
    got = mixing.score_texts(twice).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_nothing_to_score(nothing, spark):
    assert mixing.score_texts(nothing).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    r = mixing.score_texts(one).first()
    assert (r["n_tokens"], r["held_out"]) == (1, False)
