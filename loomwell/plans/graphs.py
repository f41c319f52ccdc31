"""Rank statistics, graphs and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.operators import design, graph, stats
from loomwell.plans.registry import query, table

_RANKED = "select *, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0::double as r, count(*) over (partition by l_quantity) as t from d"


@query(f"""
    with d as (select l_returnflag as g, l_quantity from lineitem where l_returnflag in ('A', 'R')), x as ({_RANKED}), s as (select count(*) filter (where g = 'A')::double as na, count(*) filter (where g = 'R')::double as nb, sum(r) filter (where g = 'A') as ra, sum(t * t - 1)::double as ties from x)
    select na::bigint as n_a, nb::bigint as n_b, round(ra - na * (na + 1) / 2, 2) as u, round((ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 5) as z from s
""")
def q35_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    out = stats.mann_whitney(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "A", "R")
    return out.select("n_a", "n_b", F.round("u", 2).alias("u"), F.round("z", 5).alias("z"))


@query(f"""
    with d as (select l_returnflag as g, l_quantity from lineitem), x as ({_RANKED}), g as (select g, count(*)::double as n, sum(r) as s from x group by 1), t as (select sum(t * t - 1)::double as t from x), a as (select count(*) as groups, sum(n) as n, sum(s * s / n) as q from g)
    select groups, n::bigint as n, round(h, 4) as h, round(exp(-h / 2), 8) as p from (select *, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) as h from a, t)
""")
def q35_kruskal(spark: SparkSession, d: str) -> DataFrame:
    return stats.kruskal_wallis(table(spark, d, "lineitem"), "l_returnflag", "l_quantity").withColumns({"h": F.round("h", 4), "p": F.round("p", 8)})


@query("""
    with x as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0::double as ra, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0::double as rb from lineitem)
    select count(*) as n, round(corr(ra, rb), 6) as rho, corr(ra, rb) between -1 and 1 as p_known from x
""")
def q35_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("n", F.round("rho", 6).alias("rho"), F.col("p").between(0, 1).alias("p_known"))


@query("""
    with p as (select s_suppkey, (s_suppkey % 37 + 1) / 500.0::double as p from supplier), r as (select *, row_number() over (order by p) as r, count(*) over () as m from p)
    select s_suppkey, round(least(1, min(p * m / r) over (order by r desc rows unbounded preceding)), 6) as p_adjusted from (select s_suppkey, p, m, max(r) over (partition by p) as r from r)
""")
def q35_fdr(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 37 + 1) / 500.0).alias("p"))
    return stats.benjamini_hochberg(p, "p").select("s_suppkey", F.round("p_adjusted", 6).alias("p_adjusted"))


@query("""
    with o as (select l_returnflag as a, l_linestatus as b, count(*)::double as o from lineitem group by 1, 2), t as (select *, sum(o) over (partition by a) as ra, sum(o) over (partition by b) as rb, sum(o) over () as n from o)
    select round(sum(o * o / (ra * rb)) * any_value(n) - any_value(n), 4) as chi2, (count(distinct a) - 1) * (count(distinct b) - 1) as dof, round(exp(-(sum(o * o / (ra * rb)) * any_value(n) - any_value(n)) / 2), 8) as p from t
""")
def chi_square(spark: SparkSession, d: str) -> DataFrame:
    return stats.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumns({"chi2": F.round("chi2", 4), "p": F.round("p", 8)})


@query("""
    select l_returnflag, count(*) filter (where l_quantity > 25) as a, count(*) filter (where l_quantity <= 25) as b, round((count(*) filter (where l_quantity > 25) * 7.0::double) / (count(*) filter (where l_quantity <= 25) * 5.0::double), 6) as odds_ratio from lineitem group by 1
""")
def odds_ratios(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("a"), F.count_if(F.col("l_quantity") <= 25).alias("b"))
    out = stats.fisher_exact(g.withColumns({"c": F.lit(5).cast("long"), "d": F.lit(7).cast("long")}), "a", "b", "c", "d")
    return out.select("l_returnflag", "a", "b", F.round("odds_ratio", 6).alias("odds_ratio"))


@query("select count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def regression(spark: SparkSession, d: str) -> DataFrame:
    out = stats.regression(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r", 6).alias("r"))


_EDGES = "select distinct l_suppkey as s, l_partkey as p from lineitem"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.bipartite(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), "s", "p")


@query(f"with e as ({_EDGES}) select s, count(*) as degree from e group by 1")
def q36_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(_edges(spark, d), "s")


@query(f"with e as ({_EDGES}) select x.s as a, y.s as b, count(*) as weight from e x join e y on y.p = x.p and x.s < y.s group by 1, 2")
def q36_projection(spark: SparkSession, d: str) -> DataFrame:
    return graph.projection(_edges(spark, d), "s", "p")


@query(f"""
    with e as ({_EDGES}), w as (select x.s as a, y.s as b, count(*) as n from e x join e y on y.p = x.p and x.s < y.s group by 1, 2 having count(*) >= 80), n as (select count(distinct v) as n from (select a as v from w union all select b from w))
    select n as nodes, (select count(*) from w) as edges, round(2.0 * (select count(*) from w) / nullif(n * (n - 1), 0), 6)::double as density from n
""")
def q36_density(spark: SparkSession, d: str) -> DataFrame:
    w = graph.projection(_edges(spark, d), "s", "p").filter("weight >= 80").select("a", "b")
    return graph.density(w, "a", "b").withColumn("density", F.round("density", 6))


def _one_space(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").filter("l_suppkey <> l_partkey")
    return pairs.select(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).distinct()


@query("""
    with e as (select distinct least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b from lineitem where l_suppkey <> l_partkey), b as (select a, b from e union all select b, a from e), d as (select a as node, count(*) as d from b group by 1),
    t as (select x.a as node, count(*) / 2 as t from b x join b y on y.a = x.b join e z on (z.a = least(x.a, y.b) and z.b = greatest(x.a, y.b)) group by 1)
    select d.node, coalesce(t, 0)::bigint as triangles from d left join t on t.node = d.node
""")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts as nodes of one space of numbers."""
    return graph.triangles(_one_space(spark, d)).select("node", "triangles")


@query()
def small_graph(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness and communities of the hundred nodes of most degree."""
    return graph.small_measures(_one_space(spark, d))


@query("""
    with r as (select o_orderkey as source, o_custkey as target from orders where o_orderkey <> o_custkey), c as (select l_partkey as target, l_suppkey as source from lineitem where l_partkey <> l_suppkey), e as (select source, target from r union select target, source from c)
    select source, target from e where source in (select c_custkey from customer where c_acctbal > 0) and target in (select c_custkey from customer where c_acctbal > 0)
""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    cited = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return graph.citations(refs, cited, table(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey")


@query("select '(' || string_agg(t, ',' order by t) || ');' as newick from (select '(' || string_agg(n_name, ',' order by n_name) || ')' || replace(any_value(r_name), ' ', '_') as t from nation join region on r_regionkey = n_regionkey group by r_regionkey)")
def newick(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey").join(table(spark, d, "region"), "r_regionkey")
    return graph.newick(n, "r_name", "n_name")


@query("""
    with u as (select vec_id, label, embedding::double[] as e from embeddings), p as (select x.vec_id, x.label, y.label as other, x.vec_id = y.vec_id as self, 1 - list_cosine_similarity(x.e, y.e) as d from u x, u y),
    m as (select vec_id, label, other, case when label = other then sum(case when self then 0 else d end) / nullif(count(*) - 1, 0) else avg(d) end as d from p group by 1, 2, 3),
    ab as (select vec_id, label, max(case when label = other then d end) as a, min(case when label <> other then d end) as b from m group by 1, 2)
    select label, count(*) as n, round(avg(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end), 4) as mean from ab group by 1
""")
def q37_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return stats.silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("mean", F.round("mean", 4))


def _cores(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of 40 made cores of six residues each; a cluster's size does not depend on the table's."""
    letters = F.translate(F.lpad(F.conv(F.col("p_partkey").cast("string"), 10, 5), 6, "0"), "01234", "AGSTV")
    return table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("cluster"), letters.alias("core"), F.col("p_size").cast("double").alias("w"))


@query()
def covering_oligos(spark: SparkSession, d: str) -> DataFrame:
    return design.cover_clusters(_cores(spark, d), "cluster", "core", "w", most=6)


@query()
def split_designs(spark: SparkSession, d: str) -> DataFrame:
    """A sweep over the number of parts, and the recommended one."""
    c = _cores(spark, d)
    sweep = design.split_clusters(c, "cluster", "core", "w", 2, 2).unionByName(design.split_clusters(c, "cluster", "core", "w", 3, 2))
    return design.recommended(sweep, "cluster")


@query()
def budget_designs(spark: SparkSession, d: str) -> DataFrame:
    return design.split_clusters(_cores(spark, d), "cluster", "core", "w", 3, 1, budget=40).drop("cuts")


@query()
def combined_designs(spark: SparkSession, d: str) -> DataFrame:
    return design.combined_clusters(_cores(spark, d), "cluster", "core", "w", 2, 2, budget=60, most=4)


@query("select n_nationkey, case n_nationkey % 3 when 0 then 0 when 1 then 1 else 1 end as ambiguous from nation")
def cheapest_codons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    acids = F.when(k % 3 == 0, F.array(F.lit("M"))).when(k % 3 == 1, F.array(F.lit("K"), F.lit("N"))).otherwise(F.array(F.lit("A"), F.lit("G")))
    return design.cheapest_codons(table(spark, d, "nation").select(k, acids.alias("acids")), "n_nationkey", "acids").select("n_nationkey", "ambiguous")


@query("""
    select o_orderpriority, round(0.426::double * ln(1 + a) + 0.33::double * ln(1 + greatest(0, b - 1)) + 0.25::double * ln(1 + greatest(0, 100 - c - 2)) + 0.5, 6) as score
    from (select o_orderpriority, avg(o_orderkey % 40)::double as a, avg(o_orderkey % 7)::double as b, avg(90 + o_orderkey % 9)::double as c from orders group by 1)
""")
def geometry_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(k % 40).alias("a"), F.avg(k % 7).alias("b"), F.avg(90 + k % 9).alias("c"))
    return o.select("o_orderpriority", F.round(stats.geometry_score(F.col("a"), F.col("b"), F.col("c")), 6).alias("score"))
