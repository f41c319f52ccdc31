"""Group-by reports, histograms, trends and funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import scalars
from loomwell.operators import aggregates, windows
from loomwell.plans.registry import query, table


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey", "o_orderpriority", (F.col("o_totalprice") > 200000).alias("large"))
    return o.groupBy("year").agg(F.count("o_custkey").alias("n_entries"), F.count_distinct("o_custkey").alias("n_species"), F.count_distinct("o_orderpriority").alias("n_plastics"), F.sum(F.col("large").cast("int")).alias("n_large"))


@query("""
    with y as (select year(o_orderdate)::int as year, count(o_custkey) as n_entries, count(distinct o_custkey) as n_species, count(distinct o_orderpriority) as n_plastics,
        sum((o_totalprice > 200000)::int)::bigint as n_large from orders group by 1),
    f as (select year, count(*) as new from (select o_custkey, min(year(o_orderdate)::int) as year from orders group by 1) group by 1)
    select y.*, case when count(n_entries) over w = 3 then round(avg(n_entries) over w, 6) end as rolling_3,
      round((n_entries - lag(n_entries) over o)::double / lag(n_entries) over o * 100, 6) as growth_pct,
      sum(n_entries) over (order by y.year rows unbounded preceding)::bigint as cumulative,
      sum(coalesce(f.new, 0)) over (order by y.year rows unbounded preceding)::bigint as cumulative_distinct
    from y left join f on f.year = y.year window w as (order by y.year rows between 1 preceding and 1 following), o as (order by y.year)
""")
def q08_yearly_trend(spark: SparkSession, d: str) -> DataFrame:
    t = windows.trend(_yearly(spark, d), "year", "n_entries")
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey")
    out = t.join(windows.cumulative_distinct(o, "year", "o_custkey"), "year")
    return out.withColumns({"rolling_3": F.round("rolling_3", 6), "growth_pct": F.round("growth_pct", 6)})


@query("""
    with d as (select n.n_name as place, o.o_custkey, o.o_orderpriority as plastic, year(o_orderdate) as y from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey),
    m as (select place, plastic from (select place, plastic, row_number() over (partition by place order by count(*) desc, plastic) as r from d group by 1, 2) where r = 1)
    select d.place, count(*) as n_entries, count(distinct o_custkey) as n_species, count(distinct d.plastic) as n_plastics,
      string_agg(distinct y::varchar, '; ' order by y::varchar) as years, any_value(m.plastic) as most_common from d join m on m.place = d.place group by d.place
""")
def q09_geographic_profile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("most_common"), F.year("o_orderdate").alias("y")).join(c, "o_custkey").join(n, "n_nationkey")
    g = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("o_custkey").alias("n_species"), F.count_distinct("most_common").alias("n_plastics"), aggregates.distinct_text("y").alias("years"))
    return g.join(aggregates.mode_of(rows, "place", "most_common"), "place")


@query("""
    with c as (select p_brand, count(*) as n from part where p_brand is not null group by 1), t as (select sum(n) as t from c)
    select count(*) as n_unique, round(-sum(n / t * ln(n / t)), 6) as shannon, count(*) filter (where n = 1) as singletons, round(avg((n = 1)::int) * 100, 4) as pct_singletons from c, t
""")
def q10_diversity(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.diversity(table(spark, d, "part"), "p_brand")
    return out.withColumns({"shannon": F.round("shannon", 6), "pct_singletons": F.round("pct_singletons", 4)})


@query("""
    with b as (select d.doc_id, n_chars > 1000 as seq, l.quality is not null as gen, lang is not null as enz, l.quality = 1 as ana, l.toxic = 1 as ext from documents d left join labels l on l.doc_id = d.doc_id),
    s as (select doc_id, 30 * seq::int + 20 * gen::int + 20 * enz::int + 15 * coalesce(ana, false)::int + 15 * (not coalesce(ext, true))::int as score from b)
    select score, case when score <= 20 then 'Low' when score <= 50 then 'Medium' when score <= 80 then 'High' else 'Excellent' end as tier, count(*) as n from s group by 1, 2
""")
def q11_evidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    score = scalars.evidence_score(F.col("n_chars") > 1000, F.col("quality").isNotNull(), F.col("lang").isNotNull(), F.col("quality") == 1, F.col("toxic") == 1)
    return docs.select(score.alias("score")).withColumn("tier", scalars.evidence_tier(F.col("score"))).groupBy("score", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("""
    with g as (select p.p_brand as plastic, count(distinct l.l_suppkey) as n_org, avg((l.l_quantity > 25)::int) as ps, avg((l.l_discount > 0.05)::int) as pe from lineitem l join part p on p.p_partkey = l.l_partkey group by 1)
    select plastic, n_org, round(40 / ln(1 + n_org) + (1 - ps) * 35 + coalesce(pe, 0) * 25, 5) as gap_score from g
""")
def q12_gap_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("plastic"))
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount").join(p, "l_partkey")
    g = rows.groupBy("plastic").agg(F.count_distinct("l_suppkey").alias("n_org"), F.avg((F.col("l_quantity") > 25).cast("int")).alias("ps"), F.avg((F.col("l_discount") > 0.05).cast("int")).alias("pe"))
    return g.select("plastic", "n_org", F.round(scalars.gap_score(F.col("n_org"), F.col("ps"), F.col("pe")), 5).alias("gap_score"))


@query("""
    with o as (select s.s_suppkey, s.s_nationkey as genus, count(distinct p.p_brand) as n_plastics, max(year(l.l_shipdate)) as last_year, bool_or(l.l_quantity > 49) as seq, bool_or(l.l_tax > 0.08) as enz
        from supplier s join lineitem l on l.l_suppkey = s.s_suppkey join part p on p.p_partkey = l.l_partkey group by 1, 2),
    g as (select s_nationkey as genus, count(*) as freq from supplier group by 1),
    m as (select (select max(n_plastics) from o) as mp, (select count(*) from supplier) as total, (select max(last_year) from o) as my),
    x as (select o.s_suppkey, n_plastics::double / mp * 100 as b, greatest(0, 100 - g.freq::double / total * 1000) as r, greatest(0, 100 - (my - last_year) * 5)::double as rec, seq, enz from o join g on g.genus = o.genus, m),
    e as (select *, case when b > 30 then 100 - (50 * seq::int + 50 * enz::int) else 0 end as gap from x)
    select s_suppkey, round(b, 4) as breadth_score, round(r, 4) as rarity_score, rec as recency_score, gap::double as evidence_gap_score, round(b * 0.30 + r * 0.25 + rec * 0.20 + gap * 0.25, 4) as novelty_potential from e
""")
def q12_novelty(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate").join(p, "l_partkey")
    o = items.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("p_brand").alias("n_plastics"), F.max(F.year("l_shipdate")).alias("last_year"), F.bool_or(F.col("l_quantity") > 49).alias("seq"), F.bool_or(F.col("l_tax") > 0.08).alias("enz"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    freq = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("freq"))
    x = o.join(s, "s_suppkey").join(freq, "s_nationkey")
    m = o.agg(F.max("n_plastics").alias("mp"), F.max("last_year").alias("my")).join(s.agg(F.count(F.lit(1)).alias("total")), F.lit(True))
    parts = scalars.novelty_parts(F.col("n_plastics"), F.col("mp"), F.col("freq"), F.col("total"), F.col("last_year"), F.col("my"), F.col("seq"), F.col("enz"))
    return x.join(m, F.lit(True)).select("s_suppkey", *[F.round(c, 4).alias(n) for n, c in parts.items()])


BRANDS = [f"Brand#{i}" for i in (11, 12, 13, 14, 15)]


@query("""
    select o_custkey, max((p_brand = 'Brand#11')::int) as b11, max((p_brand = 'Brand#12')::int) as b12, max((p_brand = 'Brand#13')::int) as b13
    from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where p_brand in ('Brand#11', 'Brand#12', 'Brand#13') group by 1
""")
def q13_coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = aggregates.binary_matrix(_brands(spark, d).filter(F.col("p_brand").isin(BRANDS[:3])), "o_custkey", "p_brand", BRANDS[:3])
    return m.select("o_custkey", *[F.col(f"`{b}`").alias(f"b{b[-2:]}") for b in BRANDS[:3]])


def _brands(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey").join(p, "l_partkey").select("o_custkey", "p_brand").distinct()


@query("""
    with x as (select distinct o_custkey, p_brand from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey)
    select a.p_brand as a, b.p_brand as b, count(*) as n from x a join x b on b.o_custkey = a.o_custkey group by 1, 2
""")
def q13_co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.co_occurrence(_brands(spark, d), "o_custkey", "p_brand")


@query("""
    select case when l_extendedprice is null or l_extendedprice >= 100000 then 20 else greatest(0, least(19, floor(l_extendedprice / 5000)))::int end as bin, count(*) as n from lineitem group by 1
""")
def q16_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(table(spark, d, "lineitem"), "l_extendedprice", 0.0, 5000.0, 20)


@query("select least(9, floor(l_quantity / 5))::int as qbin, least(19, floor(l_extendedprice / 5000))::int as pbin, count(*) as n from lineitem group by 1, 2")
def q16_joint_histogram(spark: SparkSession, d: str) -> DataFrame:
    q = aggregates.bin_of(F.col("l_quantity"), 0.0, 5.0, 10, overflow=False).alias("qbin")
    p = aggregates.bin_of(F.col("l_extendedprice"), 0.0, 5000.0, 20, overflow=False).alias("pbin")
    return table(spark, d, "lineitem").groupBy(q, p).agg(F.count(F.lit(1)).alias("n"))


@query("""select count(*) filter (where l_quantity >= 10) as ge_10, count(*) filter (where l_quantity >= 25) as ge_25, count(*) filter (where l_quantity < 10) as lt_10,
    count(*) filter (where l_quantity <= 10 and l_discount >= 0.05) as joint from lineitem""")
def q16_thresholds(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.count_if(q >= 10).alias("ge_10"), F.count_if(q >= 25).alias("ge_25"), F.count_if(q < 10).alias("lt_10"), F.count_if((q <= 10) & (F.col("l_discount") >= 0.05)).alias("joint"))


@query("select count(l_quantity) as n, round(avg(l_quantity), 6) as mean, round(var_pop(l_quantity) * count(l_quantity), 2) as m2, min(l_quantity) as min, max(l_quantity) as max from lineitem")
def q17_shard_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments of shards, merged, are those of one pass."""
    parts = table(spark, d, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(7)).alias("shard")).agg(*aggregates.moments("l_quantity"))
    return aggregates.merged_moments(parts).withColumns({"mean": F.round("mean", 6), "m2": F.round("m2", 2)})


@query("select least(49, floor(l_quantity))::int as bin, count(*) as n from lineitem group by 1")
def q17_shard_histogram(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    shards = [aggregates.histogram(items.filter(F.pmod("l_orderkey", F.lit(3)) == i), "l_quantity", 0.0, 1.0, 50, overflow=False) for i in range(3)]
    return aggregates.merge_shards(shards, ["bin"], ["n"])


@query("""
    with h as (select least(49, floor(l_quantity))::int as bin, count(*) as n from lineitem group by 1), c as (select bin, sum(n) over (order by bin) as cum, sum(n) over () as t from h)
    select q, min(bin)::double as value from c, (values (0.05::double), (0.5::double), (0.95::double)) v(q) where cum >= q * t group by q
""")
def q18_histogram_quantiles(spark: SparkSession, d: str) -> DataFrame:
    h = aggregates.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 1.0, 50, overflow=False)
    return aggregates.histogram_quantiles(h, 0.0, 1.0, [0.05, 0.5, 0.95])


@query("""
    select 'event_id' as "column", count(*) - count(event_id) as null_count, (count(*) - count(event_id)) * 100.0::double / count(*) as null_pct from events union all
    select 'ts', count(*) - count(ts), (count(*) - count(ts)) * 100.0::double / count(*) from events union all
    select 'user_id', count(*) - count(user_id), (count(*) - count(user_id)) * 100.0::double / count(*) from events union all
    select 'event_type', count(*) - count(event_type), (count(*) - count(event_type)) * 100.0::double / count(*) from events union all
    select 'value', count(*) - count(value), (count(*) - count(value)) * 100.0::double / count(*) from events union all
    select 'props', count(*) - count(props), (count(*) - count(props)) * 100.0::double / count(*) from events
""")
def q21_null_profile(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.null_profile(table(spark, d, "events"))


@query("select event_type, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6)::double as pct from events group by 1")
def q25_share_of_total(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(windows.share_of_total("n").cast("double"), 6))


@query("""
    with g as (select n_chars between 200 and 5000 as a, length(regexp_replace(text, '[A-Za-z .]', '', 'g'))::double / greatest(length(text), 1) <= 0.05 as b, lang = 'en' as c from documents),
    s as (select 0 as stage, count(*) as n from g union all select 1, count(*) from g where a union all select 2, count(*) from g where a and b union all select 3, count(*) from g where a and b and c)
    select stage, n, round(n * 100.0 / lag(n) over (order by stage), 4)::double as pct_of_previous, round(n * 100.0 / first_value(n) over (order by stage), 4)::double as pct_of_first from s
""")
def q23_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Stage counts in one pass, then retention."""
    t = F.col("text")
    gates = [F.lit(True), F.col("n_chars").between(200, 5000), F.length(F.regexp_replace(t, "[A-Za-z .]", "")) / F.greatest(F.length(t), F.lit(1)) <= 0.05, F.col("lang") == "en"]
    counts, passed = [], F.lit(True)
    for i, g in enumerate(gates):
        passed = passed & g
        counts.append(F.struct(F.lit(i).alias("stage"), F.count_if(passed).alias("n")))
    s = table(spark, d, "documents").agg(F.array(*counts).alias("s")).select(F.inline("s"))
    out = windows.retention(s, "stage", "n")
    return out.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("pct_of_previous", "pct_of_first")})


@query("""
    select c_mktsegment, round(sum(m * n) / sum(n), 4) as mean, sum(n)::bigint as n from (select c_mktsegment, c_nationkey, avg(c_acctbal) as m, count(*) as n from customer group by 1, 2) group by 1
""")
def weighted_remerge(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.count(F.lit(1)).alias("n"))
    return aggregates.mean_of_means(parts, "c_mktsegment", "mean", "n").withColumn("mean", F.round("mean", 4))


@query("""
    select c_mktsegment, round(avg(m), 4) as mean, sum(n)::bigint as n from (select c_mktsegment, c_nationkey, avg(c_acctbal) as m, count(*) as n from customer group by 1, 2) group by 1
""")
def unweighted_remerge(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.count(F.lit(1)).alias("n"))
    return aggregates.mean_of_means(parts, "c_mktsegment", "mean", "n", weighted=False).withColumn("mean", F.round("mean", 4))


@query("""
    with d as (select l_suppkey as k, l_discount as v, sum(l_quantity) as w from lineitem group by 1, 2), c as (select *, sum(w) over (partition by k order by v) as cum, sum(w) over (partition by k) as t from d),
    q as (select k, min(case when cum >= 0.25::double * t then v end) as q25, min(case when cum >= 0.75::double * t then v end) as q75 from c group by k)
    select d.k, round(sum(v * w) / sum(w), 6) as weighted_mean, any_value(q25) as q25, any_value(q75) as q75, round(1 / (1 + any_value(q75) - any_value(q25)), 6) as confidence from d join q on q.k = d.k group by d.k
""")
def weighted_traits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_discount", "l_quantity")
    out = aggregates.weighted_traits(rows, "k", "l_discount", "l_quantity")
    return out.withColumns({c: F.round(c, 6) for c in ("weighted_mean", "confidence")})


@query("""
    select s_nationkey, string_agg(v, '; ' order by r) as firsts from (select s_nationkey, s_name as v, row_number() over (partition by s_nationkey order by min(s_suppkey)) as r from supplier group by 1, 2) where r <= 3 group by 1
""")
def first_three(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.first_distinct(table(spark, d, "supplier"), "s_nationkey", "s_name", "s_suppkey").withColumnRenamed("s_name", "firsts")


@query("""
    select c_mktsegment, count(*) as n, round(avg(c_acctbal), 4) as mean, round(median(c_acctbal), 4) as median, round(stddev_samp(c_acctbal), 4) as std, min(c_acctbal) as min, max(c_acctbal) as max from customer where c_acctbal > 0 group by 1
""")
def positive_stats(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("c_acctbal")
    return table(spark, d, "customer").filter(v > 0).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


@query("""
    select n_regionkey, c_mktsegment, grouping(n_regionkey) as g1, grouping(c_mktsegment) as g2, count(*) as n from customer join nation on n_nationkey = c_nationkey group by rollup (n_regionkey, c_mktsegment)
""")
def two_level_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").join(n, "c_nationkey")
    return c.rollup("n_regionkey", "c_mktsegment").agg(F.grouping("n_regionkey").cast("long").alias("g1"), F.grouping("c_mktsegment").cast("long").alias("g2"), F.count(F.lit(1)).alias("n"))


@query("select event_type, y, count(*) as n from (select event_type, year(ts)::int as y from events) group by cube (event_type, y)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", F.year("ts").alias("y")).cube("event_type", "y").agg(F.count(F.lit(1)).alias("n"))


@query("""select l_returnflag, count(*) filter (where l_linestatus = 'F') as "F", count(*) filter (where l_linestatus = 'O') as "O" from lineitem group by 1""")
def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
