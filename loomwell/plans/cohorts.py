"""Samples, traits, cohorts and matches: the join pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.operators import joins, sets
from loomwell.plans.registry import query, table


@query("""
    select o.o_custkey as custkey, round(avg(p.p_retailprice), 8) as mean_trait, count(p.p_retailprice) as n_traits, round(sum(l.l_quantity), 2) as quantity
    from orders o join lineitem l on l.l_orderkey = o.o_orderkey join customer c on c.c_custkey = o.o_custkey
    left join (select p_partkey, p_retailprice from part where p_size <= 25) p on p.p_partkey = l.l_partkey
    where o.o_orderpriority like '1-%' group by o.o_custkey
""")
def q01_sample_trait_means(spark: SparkSession, d: str) -> DataFrame:
    """Three-way inner join with a prefix predicate, a left join to traits, and a two-phase mean."""
    orders = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1-")).select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    traits = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = orders.join(items, "o_orderkey").join(known, "o_custkey", "left_semi").join(traits, "l_partkey", "left")
    return rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.round(F.avg("p_retailprice"), 8).alias("mean_trait"), F.count("p_retailprice").alias("n_traits"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
    with runs as (select o_orderkey, o_custkey, 'F' as part from orders where o_orderstatus = 'F' union all
                  select o_orderkey, o_custkey, 'O' from orders where o_orderstatus = 'O' union all
                  select o_orderkey, o_custkey, 'P' from orders where o_orderstatus = 'P')
    select r.part, n.n_name as country, count(*) as n from runs r join customer c on c.c_custkey = r.o_custkey
    left join (select * from nation where n_nationkey < 20) n on n.n_nationkey = c.c_nationkey group by r.part, n.n_name
""")
def q02_run_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Union of three run tables, inner join, left join."""
    o = table(spark, d, "orders")
    parts = [o.filter(F.col("o_orderstatus") == s).select("o_custkey", F.lit(s).alias("part")) for s in ("F", "O", "P")]
    runs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").filter("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("country"))
    return runs.join(c, "o_custkey").join(n, "n_nationkey", "left").groupBy("part", "country").agg(F.count(F.lit(1)).alias("n"))


@query("""
    select user_id, event_id, event_type, value from (
      select *, row_number() over (partition by user_id order by value desc nulls last, event_id) as rn from events) where rn = 1
""")
def q03_best_row(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each key, nulls last."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return joins.first_row(e, ["user_id"], [F.desc_nulls_last("value"), F.col("event_id")])


@query("""
    with total as (select source, count(*) as n_total from documents where source is not null group by source),
    good as (select d.source, count(*) as n_good from documents d join labels l on l.doc_id = d.doc_id where l.quality = 1 group by d.source)
    select t.source, n_total, coalesce(n_good, 0) as n_good, round(coalesce(n_good, 0)::double / n_total, 6) as purity,
           coalesce(n_good, 0)::double / n_total >= 0.2 as in_cohort from total t left join good g on g.source = t.source
""")
def q04_purity_cohort(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source").filter("source is not null")
    good_ids = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_total"))
    good = docs.join(good_ids, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_good"))
    p = F.coalesce("n_good", F.lit(0)) / F.col("n_total")
    return total.join(good, "source", "left").select("source", "n_total", F.coalesce("n_good", F.lit(0)).alias("n_good"), F.round(p, 6).alias("purity"), (p >= 0.2).alias("in_cohort"))


@query("select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)")
def q05_incomplete(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""
    select p_brand, p_name, p_partkey from (select *, row_number() over (partition by p_brand order by length(p_name), p_name, p_partkey) as rn
      from part where p_partkey in (select l_partkey from lineitem where l_quantity > 40)) where rn = 1
""")
def q06_shortest_key(spark: SparkSession, d: str) -> DataFrame:
    """Semi-join to the wanted keys, then the shortest name of each group."""
    wanted = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    p = table(spark, d, "part").select("p_brand", "p_name", "p_partkey").join(wanted, "p_partkey", "left_semi")
    return joins.first_row(p, ["p_brand"], [F.length("p_name"), F.col("p_name"), F.col("p_partkey")]).select("p_brand", "p_name", "p_partkey")


@query("select l_suppkey, count(distinct l_partkey) as n_parts from lineitem group by l_suppkey having count(distinct l_partkey) between 100 and 580")
def q07_family_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts")).filter(F.col("n_parts").between(100, 580))


@query("""
    select a.user_id, a.event_type, c.n as n_click, p.n as n_purchase, c.n > p.n as agrees from (select distinct user_id, 'pair' as event_type from events) a
    join (select user_id, count(*) as n from events where event_type = 'click' group by user_id) c on c.user_id = a.user_id
    join (select user_id, count(*) as n from events where event_type = 'purchase' group by user_id) p on p.user_id = a.user_id
""")
def q20_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Pairing join of two runs on one key, each side's columns kept."""
    e = table(spark, d, "events")
    run = lambda t: e.filter(F.col("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    both = joins.compare_runs(run("click"), run("purchase"), "user_id", ["n"], ("click", "purchase"))
    return both.select("user_id", F.lit("pair").alias("event_type"), "n_click", "n_purchase", (F.col("n_click") > F.col("n_purchase")).alias("agrees"))


@query("""
    with best as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount,
        row_number() over (partition by l_orderkey order by l_discount, l_extendedprice desc, l_linenumber, l_partkey) as re,
        row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as rt from lineitem where l_quantity > 30)
    select o.o_orderkey, e.l_partkey as part_by_discount, coalesce(t.l_extendedprice, 0) as best_price, t.l_orderkey is null as no_hit
    from orders o left join (select * from best where re = 1) e on e.l_orderkey = o.o_orderkey left join (select * from best where rt = 1) t on t.l_orderkey = o.o_orderkey
""")
def q19_best_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best hit by two orders in one aggregation; queries without a hit stay, at 0."""
    hits = table(spark, d, "lineitem").filter("l_quantity > 30")
    best = hits.groupBy("l_orderkey").agg(
        F.min_by("l_partkey", F.struct(F.col("l_discount"), -F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"))).alias("part_by_discount"),
        F.max("l_extendedprice").alias("best"),
    )
    o = table(spark, d, "orders").select("o_orderkey").join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", "part_by_discount", F.coalesce("best", F.lit(0.0)).alias("best_price"), F.col("l_orderkey").isNull().alias("no_hit"))


@query("""
    select c.c_custkey, c.c_custkey in (select o_custkey from orders where o_totalprice > 400000) as was_large from customer c
""")
def match_flag(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_flag(table(spark, d, "customer").select("c_custkey"), large, "c_custkey", "was_large")


@query("""
    select event_id from events where user_id in (select c_custkey from customer where c_acctbal > 9000) or event_id in (select s_suppkey from supplier)
""")
def disjunctive_match(spark: SparkSession, d: str) -> DataFrame:
    """Either of two keys, as a union of semi-joins."""
    users = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("user_id"))
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("event_id"))
    return joins.any_key(table(spark, d, "events").select("event_id", "user_id"), {"user_id": users, "event_id": ids}, "event_id").select("event_id")


@query("""
    select event_id from events where user_id not in (select c_custkey from customer where c_acctbal > 9000) and event_id not in (select s_suppkey from supplier)
""")
def two_key_anti(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("user_id"))
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("event_id"))
    return joins.no_key(table(spark, d, "events").select("event_id", "user_id"), {"user_id": users, "event_id": ids}).select("event_id")


@query("""
    select p_partkey, case when l.l_partkey is not null then 'large' else 'any' end as source from part p
    left join (select distinct l_partkey from lineitem where l_quantity >= 49) l on l.l_partkey = p.p_partkey
    where p_partkey in (select l_partkey from lineitem)
""")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each key from the first source that has it."""
    items = table(spark, d, "lineitem")
    large = items.filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    every = items.select(F.col("l_partkey").alias("p_partkey")).distinct()
    return joins.fallback_chain(table(spark, d, "part"), [("large", large), ("any", every)], "p_partkey")


@query("""
    with r as (select r_name, n_name, n_nationkey from region left join nation on n_regionkey = r_regionkey)
    select r_name, count(n_name) as n_children, coalesce(string_agg(n_name, ',' order by n_name), '') as children from r group by r_name
""")
def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name", "n_nationkey")
    out = joins.children(table(spark, d, "region"), n, "r_regionkey", ["n_name", "n_nationkey"])
    return out.select("r_name", F.size("children").cast("long").alias("n_children"), F.array_join(F.col("children.n_name"), ",").alias("children"))


@query("""
    with recursive tree as (select 'r' || r_regionkey as node, 'world' as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all
      select 'world', cast(null as varchar)), walk(node, ancestor, distance) as (select node, node, 0 from tree union all
      select w.node, t.parent, w.distance + 1 from walk w join tree t on t.node = w.ancestor where t.parent is not null) select * from walk
""")
def q39_lineage(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    root = spark.createDataFrame([("world", None)], "node string, parent string")
    return joins.lineage(r.unionByName(n).unionByName(root), "node", "parent")


@query("""
    select e.event_id, o.o_orderkey from events e
    join orders o on e.value * 100 >= o.o_totalprice / 100 and e.value * 100 < o.o_totalprice / 100 + 5
""")
def range_match(spark: SparkSession, d: str) -> DataFrame:
    """Points in ranges, by buckets as an equi-join."""
    points = table(spark, d, "events").select("event_id", (F.col("value") * 100).alias("x"))
    ranges = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("low"), (F.col("o_totalprice") / 100 + 5).alias("high"))
    return joins.range_join(points, ranges, "x", "low", "high", 5.0).select("event_id", "o_orderkey")


@query("""
    select p.event_id, (select max_by(c.event_id, (c.ts, c.event_id)) from events c where c.user_id = p.user_id and c.event_type = 'click' and c.ts <= p.ts) as last_click
    from events p where p.event_type = 'purchase'
""")
def as_of_match(spark: SparkSession, d: str) -> DataFrame:
    """The last click of the user at or before each purchase."""
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_click"))
    return joins.as_of(left, right, "user_id", "ts", ["last_click"]).select("event_id", "last_click")


@query("""
    with wanted as (select distinct o_custkey as k from orders), n as (select user_id as k, count(*) as n from events group by user_id)
    select status, count(*) as n from (select case when n.n is null then 'missing' when n.n > 1 then 'duplicate' else 'found' end as status from wanted w left join n on n.k = w.k) group by status
""")
def audit(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    found = table(spark, d, "events").select(F.col("user_id").alias("k"))
    return joins.audited(wanted, found, "k").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
    select coalesce(c.k, e.k) as k, c.k is not null as in_orders, e.k is not null as in_events
    from (select distinct o_custkey as k from orders) c full join (select distinct user_id as k from events) e on e.k = c.k
""")
def full_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("c", F.lit(True))
    e = table(spark, d, "events").select(F.col("user_id").alias("k")).distinct().withColumn("e", F.lit(True))
    return c.join(e, "k", "full").select("k", F.col("c").isNotNull().alias("in_orders"), F.col("e").isNotNull().alias("in_events"))


@query("""
    select n_shared, n_left_only, n_right_only, round(n_shared::double / (n_shared + n_left_only + n_right_only), 6) as jaccard from (
      select count(*) filter (where a and b) as n_shared, count(*) filter (where a and not b) as n_left_only, count(*) filter (where b and not a) as n_right_only from (
        select text, bool_or(source = 'src0') as a, bool_or(source = 'src1') as b from documents where text is not null and source in ('src0', 'src1') group by text))
""")
def q14_set_comparison(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("text", "source")
    out = sets.compare(docs.filter("source = 'src0'"), docs.filter("source = 'src1'"), "text")
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query("""
    select b.item_id, (select count(*) from part p where p.p_size = b.item_id) as n_parts, x.n_name from benchmark b
    left join nation x on x.n_nationkey = b.item_id
""")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary lookups: a count with a default, and a name that may be missing."""
    b = table(spark, d, "benchmark").select("item_id")
    n = table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("item_id")).agg(F.count(F.lit(1)).alias("n_parts"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("item_id"), "n_name")
    return joins.lookup(joins.lookup(b, n, "item_id", "n_parts", 0), names, "item_id", "n_name").select("item_id", "n_parts", "n_name")


@query("""
    with t as (select p_partkey, case when p_partkey % 3 = 0 then 'own' else 'other' end as kind, 'K' || p_partkey || '.' || (p_partkey % 4) as acc from part),
    m as (select 'K' || p_partkey || '.' || (p_partkey % 2) as acc, 'M' || p_partkey as target from part where p_partkey % 5 <> 0),
    loose as (select regexp_replace(acc, '\\.\\d+$', '') as bare, min(target) as target from m group by 1)
    select t.p_partkey, coalesce(e.target, l.target) as target from t left join (select acc, min(target) as target from m group by acc) e on e.acc = t.acc
    left join loose l on l.bare = regexp_replace(t.acc, '\\.\\d+$', '')
""")
def versionless_match(spark: SparkSession, d: str) -> DataFrame:
    """By the exact accession, else by the one without its version."""
    p = table(spark, d, "part")
    t = p.select("p_partkey", F.concat(F.lit("K"), "p_partkey", F.lit("."), F.col("p_partkey") % 4).alias("acc"))
    m = p.filter("p_partkey % 5 <> 0").select(F.concat(F.lit("K"), "p_partkey", F.lit("."), F.col("p_partkey") % 2).alias("acc"), F.concat(F.lit("M"), "p_partkey").alias("target"))
    return joins.versionless(t, m, "acc", "target").select("p_partkey", "target")


@query("""
    select p_partkey, case when p_partkey % 3 = 0 then 'A' || p_partkey else 'U' || p_partkey end as uniprot from part where p_partkey % 3 = 0 or p_partkey % 2 = 0
""")
def identity_or_mapped(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("A"), "p_partkey").alias("acc"), F.when(F.col("p_partkey") % 3 == 0, "uniprot").otherwise("refseq").alias("kind"))
    m = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("A"), "p_partkey").alias("acc"), F.concat(F.lit("U"), "p_partkey").alias("uniprot"))
    return joins.identity_or(p, m, "kind", "uniprot", "acc", "uniprot").select("p_partkey", "uniprot")


@query("select n_name, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1")
def chosen_joins(spark: SparkSession, d: str) -> DataFrame:
    """One join in its three physical forms; a row that any of them lacks would lower its count."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    parts = [joins.joined_by(s, c, n, ["k"]).select("c_custkey", "n_name") for s in ("hash", "merge", "broadcast")]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return all_.groupBy("c_custkey", "n_name").agg(F.count(F.lit(1)).alias("m")).filter("m = 3").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, l_linenumber, p_brand, p_size from lineitem left join (select p_partkey, p_brand, p_size from part where p_size > 10) on p_partkey = l_partkey and p_size = l_quantity::int")
def lookup_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("q"), "p_brand", "p_size")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    return joins.lookup_by(li, p, ["l_partkey", "q"], ["p_brand", "p_size"]).select("l_orderkey", "l_linenumber", "p_brand", "p_size")
