import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loomwell.operators import aggregates, design, graph, joins, lifecycle, sets, stats, windows
from loomwell.plans import catalogue


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_diversity_drops_null_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "g string")
    r = aggregates.diversity(df, "g").first()
    assert (r["n_unique"], r["singletons"]) == (2, 1)
    assert r["shannon"] == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))


def test_mode_and_top(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("j", None)], "k string, v string")
    assert rows(aggregates.mode_of(df, "k", "v")) == [("k", "a")]
    assert rows(aggregates.top_values(df, "k", "v", 1).select("k", "v", "n")) == [("k", "a", 2)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (-5.0,), (float("nan"),), (None,)], "v double")
    assert dict(rows(aggregates.histogram(df, "v", 0.0, 1.0, 10))) == {0: 2, 9: 1, 10: 3}
    assert dict(rows(aggregates.histogram(df.filter("v is not null and not isnan(v)"), "v", 0.0, 1.0, 10, overflow=False))) == {0: 2, 9: 2}


def test_shards_merge_to_one_pass(spark):
    df = spark.range(1000).select(F.col("id"), (F.sqrt("id") * 7).alias("v"))
    whole = df.agg(*aggregates.moments("v")).first()
    parts = df.groupBy((F.col("id") % 7).alias("s")).agg(*aggregates.moments("v"))
    got = aggregates.merged_moments(parts).first()
    assert all(got[c] == pytest.approx(whole[c]) for c in ("n", "mean", "m2", "min", "max"))
    with pytest.raises(ValueError):
        aggregates.merge_shards([df, parts], ["s"], ["n"])


def test_mean_of_means(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 3), ("b", None, 0)], "k string, m double, n int")
    assert rows(aggregates.mean_of_means(df, "k", "m", "n").select("k", "m")) == [("a", 3.25), ("b", None)]
    assert rows(aggregates.mean_of_means(df, "k", "m", "n", weighted=False).select("k", "m"))[0] == ("a", 2.5)


def test_trend(spark):
    df = spark.createDataFrame([(1, 2), (2, 4), (3, 0), (4, 3)], "y int, n int")
    got = rows(windows.trend(df, "y", "n"))
    assert [r[2] for r in got] == [None, 2.0, pytest.approx(7 / 3), None]
    assert [r[3] for r in got] == [None, 100.0, -100.0, None]
    assert [r[4] for r in got] == [2, 6, 6, 9]


def test_intervals(spark):
    random.seed(1)
    data = [(k, s, s + random.randint(1, 9)) for k in range(5) for s in random.sample(range(90), 12)]
    df = spark.createDataFrame(data, "k int, s long, e long")
    lengths = spark.createDataFrame([(k, 80) for k in range(6)], "k int, n long")
    covered = {k: {i for kk, s, e in data if kk == k for i in range(s, e)} for k in range(6)}
    got = rows(windows.islands(df, ["k"], "s", "e"))
    for k in range(5):
        spans = [(s, e) for kk, s, e in got if kk == k]
        assert {i for s, e in spans for i in range(s, e)} == covered[k]
        assert all(b[0] > a[1] for a, b in zip(spans, spans[1:]))
    gaps = rows(windows.complement(df, lengths, ["k"], "s", "e", "n"))
    for k in range(6):
        assert {i for kk, s, e in gaps if kk == k for i in range(s, e)} == set(range(80)) - covered[k]


def test_contiguous_shards_partition_the_rows(spark):
    df = spark.range(0, 103).select((F.col("id") * 7 % 103).alias("x"))
    got = rows(windows.contiguous_shard(df, ["x"], 4), "x")
    assert len(got) == 103 and [r[1] for r in got] == sorted(r[1] for r in got)
    edges = [round(i * 103 / 4) for i in range(1, 5)]
    assert [sum(r[1] == s for r in got) for s in range(4)] == [b - a for a, b in zip([0, *edges], edges)]


def test_longest_run(spark):
    df = spark.createDataFrame([("a", i, g) for i, g in enumerate([1, 1, 0, 1, 1, 0, 1], 1)], "k string, p int, g int")
    assert rows(windows.longest_run(df, ["k"], "p", F.col("g") == 1)) == [("a", 1, 2, 2)]


def test_chains_and_flags(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, "z"), (2, "w")], "k int, v string")
    got = rows(joins.fallback_chain(wanted, [("a", a), ("b", b)], "k"))
    assert got == [(1, "x", "a"), (1, "y", "a"), (2, "w", "b")]
    assert {r[0]: r[1] for r in rows(joins.audited(wanted, a, "k"), "status") if r[0]} == {1: "duplicate", 2: "missing", 3: "missing"}
    assert rows(joins.with_flag(wanted, a, "k", "f"), F.col("k").asc_nulls_first()) == [(None, False), (1, True), (2, False), (3, False)]


def test_lineage_ends(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("d", None)], "n string, p string")
    got = rows(joins.lineage(tree, "n", "p"), "node", "distance")
    assert [(x, y) for x, y, _ in got] == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c"), ("d", "d")]


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b")], "k string, t int, v string")
    assert rows(joins.as_of(left, right, "k", "t", ["v"])) == [("j", 9, None), ("k", 1, None), ("k", 5, "b")]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert tuple(sets.compare(a, b, "k").first()) == (1, 1, 1, pytest.approx(1 / 3))
    s = spark.range(100)
    assert rows(sets.sample_rows(s, "id", 10, 4)) == rows(sets.sample_rows(s.repartition(7), "id", 10, 4))
    d = spark.createDataFrame([(i, "a" if i < 60 else "b") for i in range(70)], "i int, s string")
    assert {r["s"]: r["n"] for r in sets.stratified(d, "s", "i", 20, 30).groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 30}


def test_rank_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 4.0), ("b", 5.0)], "g string, v double")
    r = stats.mann_whitney(df, "g", "v", "a", "b").first()
    assert (r["n_a"], r["n_b"], r["u"]) == (2, 3, 0.5)
    same = spark.createDataFrame([(i, i * i) for i in range(9)], "a int, b int")
    assert stats.spearman(same, "a", "b").first()["rho"] == pytest.approx(1.0)
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,)], "p double")
    assert [round(x[1], 4) for x in rows(stats.benjamini_hochberg(p, "p"))] == [0.02, 0.02, 0.04, 0.04]
    t = spark.createDataFrame([(8, 2, 1, 5)], "a int, b int, c int, d int")
    f = stats.fisher_exact(t, "a", "b", "c", "d").first()
    assert f["odds_ratio"] == 20.0 and f["p"] == pytest.approx(0.03497, abs=1e-4)


def test_kabsch_finds_the_turn(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    to = lambda m: [dict(zip("xyz", map(float, r))) for r in m]
    df = spark.createDataFrame([(to(x), to(x @ turn + 3)), (to(x), to(x[:5]))], "a array<struct<x: double, y: double, z: double>>, b array<struct<x: double, y: double, z: double>>")
    got = df.select(stats.kabsch(F.col("a"), F.col("b")).alias("k")).collect()
    assert got[0]["k"]["rmsd"] == pytest.approx(0, abs=1e-6) and got[0]["k"]["tm"] == pytest.approx(1)


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a int, b int")
    assert tuple(graph.density(e, "a", "b").first()) == (4, 4, pytest.approx(8 / 12))
    assert {r["node"]: r["triangles"] for r in graph.triangles(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 0}
    m = {r["node"]: (r["betweenness"], r["community"]) for r in graph.small_measures(e).collect()}
    assert m[3][0] == pytest.approx(2 * 2 / 6) and m[1][0] == 0


def test_codons():
    assert design.cheapest(frozenset("M"))[:3] == (0, 1, "ATG")
    assert design.cheapest(frozenset("KN"))[0] == 1 and design.cheapest(frozenset("KN"))[3] >= frozenset("KN")
    assert all("*" not in c[3] for c in design.degenerate_codons())


def subsets(n):
    return (set(c) for k in range(n + 1) for c in itertools.combinations(range(n), k))


def best_cover(seqs, weights, most):
    """By trying every set of sequences."""
    best = 0.0
    for s in subsets(len(seqs)):
        codons = [min((c for c in design.degenerate_codons() if c[3] >= {seqs[i][j] for i in s}), default=None) for j in range(len(seqs[0]))] if s else []
        if s and None not in codons and sum(c[0] for c in codons) <= most:
            best = max(best, sum(w for x, w in zip(seqs, weights) if all(a in c[3] for a, c in zip(x, codons))))
    return best


def best_choice(pieces, weights, budget, most_share=None):
    best = 0.0
    for s in subsets(len(pieces)):
        present = [{pieces[i][k] for i in s} for k in range(len(pieces[0]))]
        size = math.prod(map(len, present))
        if s and size <= budget:
            inside = [i for i, p in enumerate(pieces) if all(x in have for x, have in zip(p, present))]
            if most_share is None or (size - len({pieces[i] for i in inside})) / size <= most_share:
                best = max(best, sum(weights[i] for i in inside))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_designs_against_all_subsets(seed):
    rng = random.Random(seed)
    seqs = sorted({"".join(rng.choices("MKNAW", k=4)) for _ in range(9)})
    weights = [float(rng.randint(1, 9)) for _ in seqs]
    got = design.cover(seqs, weights, 3)
    assert got["proved"] and got["weight"] == best_cover(seqs, weights, 3) and got["ambiguous"] <= 3 and len(got["oligo"]) == 12
    pieces = design.pieces_of(seqs, [1, 2])
    for budget in (1, 4, 9, 20):
        found = design.under_budget(pieces, weights, budget)
        assert found["proved"] and found["weight"] == best_choice(pieces, weights, budget) and found["library"] <= budget
    junk = design.under_junk(pieces, weights, 0.5)
    assert junk["junk_share"] <= 0.5 and max(weights) <= junk["weight"] <= best_choice(pieces, weights, 10**9, 0.5)


def test_search_says_when_it_stopped():
    seqs = ["".join(p) for p in itertools.product("MKNW", repeat=3)]
    assert not design.cover(seqs, [1.0] * len(seqs), 2, most_steps=3)["proved"]
    assert design.cover(seqs[:4], [1.0] * 4, 0)["proved"]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_against_all_places(seed):
    rng = random.Random(seed)
    seqs = ["".join(rng.choices("ACG-", k=8)) for _ in range(5)]
    cost = lambda cuts: math.prod(len(set(x)) for x in zip(*design.pieces_of(seqs, list(cuts))))
    room = lambda cuts: all(b - a >= 2 for a, b in zip([0, *cuts], [*cuts, 8]))
    assert cost(design.place_cuts(seqs, 3, 2)) == min(cost(c) for c in itertools.combinations(range(1, 8), 2) if room(c))
    assert design.place_cuts(seqs, 5, 2) is None
    junctions = {p: ["".join(rng.choices("ACGT", k=4)) for _ in range(2)] for p in rng.sample(range(2, 7), 4)}
    ways = [(cost(c), c, j) for c in itertools.combinations(sorted(junctions), 2) if room(c) for j in itertools.product(*(junctions[p] for p in c)) if not design.conflict(j[0], j[1], 3)]
    got = design.place_cuts_apart(seqs, junctions, 3, 2, differ=3)
    assert (got is None) == (not ways)
    if got:
        assert cost(got[0]) == min(w[0] for w in ways) and (tuple(got[0]), tuple(got[1])) in [w[1:] for w in ways]


def test_cuts_need_other_junctions():
    assert design.place_cuts_apart(["AAAAAA", "AATTAA"], {2: ["ACCA"], 4: ["ACCA", "GGTC"]}, 3, 1) == ([2, 4], ["ACCA", "GGTC"])
    assert design.place_cuts_apart(["AAAAAA", "AATTAA"], {2: ["ACCA"], 4: ["ACCA"]}, 3, 1) is None


def test_combined_design():
    seqs = ["MKMK", "MNMK", "MKMN", "WWWW"]
    got = design.combined(seqs, [3.0, 2.0, 2.0, 1.0], 2, 2, 4, 1)
    assert [(r["part"], r["pieces"]) for r in got] == [(0, ["MK", "MN"]), (1, ["MK", "MN"])]
    assert all(len(r["oligo"]) == 6 for r in got)


def test_resume_adds_nothing(spark):
    work = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    ledger = spark.createDataFrame([(1, "ok"), (2, "failed")], "k int, status string")
    assert rows(lifecycle.to_do(work, ledger, "k")) == [(2,), (3,)]
    assert lifecycle.to_do(work, work.withColumn("status", F.lit("ok")), "k").isEmpty()
    assert rows(lifecycle.retryable(ledger, "k")) == [(2, 1)]
    with pytest.raises(ValueError, match="small"):
        lifecycle.require(work, {"small": "k < 3"})


def test_axes_and_merges(spark):
    from loomwell.operators import projection

    rows = [(i, [float(i), 2.0 * i + (i % 2) * 0.1, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    got = projection.principal_axes(df, "k", "v").orderBy("k").collect()
    assert all(b["x"] > a["x"] for a, b in zip(got, got[1:])) and len(got) == 20
    four = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [10.0]), (3, [12.0])], "k int, v array<double>")
    m = projection.ward_merges(four, "k", "v").orderBy("step").collect()
    assert [(r["a"], r["b"], r["size"]) for r in m] == [(0, 1, 2), (2, 3, 2), (4, 5, 4)] and m[0]["distance"] == pytest.approx(1.0)


def test_tail_probabilities():
    from loomwell.functions import probability as P

    for x in (0.1, 1.0, 3.0, 40.0):
        assert P.upper_gamma(1.0, x) == pytest.approx(math.exp(-x), rel=1e-12)
        assert P.upper_gamma(0.5, x) == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-10)
        assert P.upper_gamma(2.0, x) == pytest.approx(math.exp(-x) * (1 + x), rel=1e-12)
    for x in (0.01, 0.3, 0.7, 0.999):
        assert P.beta_share(x, 1, 3) == pytest.approx(1 - (1 - x) ** 3, rel=1e-12)
        assert P.beta_share(x, 0.5, 0.5) == pytest.approx(2 / math.pi * math.asin(math.sqrt(x)), rel=1e-10)
        assert P.beta_share(x, 4, 2) == pytest.approx(1 - P.beta_share(1 - x, 2, 4), rel=1e-12)


def test_running_total_over_bands(spark):
    rng = random.Random(2)
    data = [(rng.choice([None, *range(400)]), i, rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "a int, b int, v long").repartition(7)
    got = {(r["a"], r["b"]): r["t"] for r in windows.running_total(df, ["a", "b"], "v", "t").collect()}
    total = 0
    for a, b, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total += v
        assert got[a, b] == total
    assert windows.running_total(df.limit(0), ["a"], "v", "t").count() == 0


def test_moments_of_large_means(spark):
    df = spark.createDataFrame([(i % 3, 1e9 + i % 7) for i in range(2100)], "g int, v double")
    parts = df.groupBy("g").agg(*aggregates.moments("v"))
    r = aggregates.merged_moments(parts).first()
    assert r["n"] == 2100 and r["m2"] == pytest.approx(2100 * 4.0, rel=1e-9)


def test_lineage_of_a_circle(spark):
    with pytest.raises(ValueError, match="circle"):
        joins.lineage(spark.createDataFrame([("a", "b"), ("b", "a")], "n string, p string"), "n", "p", depth=5)


def test_batch_report_and_ledger(spark, tmp_path):
    from loomwell.streaming import events

    df = spark.createDataFrame([("a", True, 3), ("a", False, 4), ("b", True, 5)], "batch string, hit boolean, size int")
    assert rows(lifecycle.batch_report(df, "batch", F.col("hit"), F.col("size"))) == [("a", 1, 1, 7), ("b", 1, 0, 5)]
    spark.createDataFrame([(0, 5, 2), (1, 7, 3)], "batch long, n_rows long, n_keys long").write.partitionBy("batch").parquet(f"{tmp_path}/ledger")
    r = events.rebuilt(spark, f"{tmp_path}/ledger").first()
    assert (r["batches"], r["n_rows"], r["last_batch"]) == (2, 12, 1)


def test_broadcast_only_what_is_small(spark, monkeypatch):
    a, b = spark.range(50).withColumnRenamed("id", "k"), spark.range(20).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(joins.joined_by("broadcast", a, b, ["k"]))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    assert "SortMergeJoin" in plan(joins.joined_by("broadcast", a, b, ["k"]))


def test_range_join_of_equal_values(spark, tmp_path):
    """Repeated values give all their pairs, and these take little room."""
    x = spark.range(4000).select("id", (F.col("id") % 2).cast("double").alias("x")).unionByName(spark.createDataFrame([(-1, None), (-2, -0.0), (-3, 9.0)], "id long, x double"))
    y = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") % 3 - 1.0).alias("low"), (F.col("id") % 3 + 0.5).alias("high")).unionByName(spark.createDataFrame([(-1, None, 1.0)], "k long, low double, high double"))
    out = joins.range_join(x, y, "x", "low", "high", 1.5).select("id", "k")
    want = x.join(y, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("id", "k")
    assert out.count() == want.count() == 4_001_000 and out.distinct().count() == 4_001_000 and out.exceptAll(want).isEmpty()
    out.write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * 4_001_000


def test_range_join_holds_few_rows_at_once(spark):
    """What writes pairs out is a stage of generated code apart from the join, on short lists: it keeps the rows of one pair of lists, not all matches of a row."""
    x = spark.range(5000).select("id", F.lit(1.0).alias("x"))
    y = spark.range(70).select(F.col("id").alias("k"), F.lit(0.5).alias("low"), F.lit(1.5).alias("high"))
    lists = joins.by_value(x, ["x"], "_p")
    assert lists.agg(F.max(F.size("_p"))).first()[0] <= 64 and lists.agg(F.sum(F.size("_p"))).first()[0] == 5000
    out = joins.range_join(x, y, "x", "low", "high", 1.0).select("id", "k")
    plan = out._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert plan.count("Generate") == 2 and "Coalesce" in plan.split("Generate")[2]
    assert out.count() == out.distinct().count() == 350_000


def test_interval_queries_equal_their_sql_on_odd_rows(spark, tmp_path):
    """Nulls, fractions, keys without a supplier and suppliers that repeat give what DuckDB gives."""
    items = [(1, 10, 5.0), (1, 10, 5.0), (1, 10, None), (1, 30, 2.5), (1, 32, 3.0), (1, None, 4.0), (1, 99990, 200.0), (2, None, 1.0), (2, 7, None), (2, 7, 3.5), (7, 20, 5.0), (7, 40, 1.5), (None, 3, 2.0), (None, 9, 2.0), (4, None, None)]
    spark.createDataFrame(items, "l_suppkey long, l_orderkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    db = pytest.importorskip("duckdb").connect()
    for t in ("lineitem", "supplier"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for q in ("q22_merged_intervals", "q22_gaps"):
        got = sorted(map(repr, map(tuple, catalogue.QUERIES[q](spark, str(tmp_path)).select("k", "s", "e").collect())))
        assert got == sorted(map(repr, db.execute(catalogue.ORACLE_SQL[q]).fetchall()))
