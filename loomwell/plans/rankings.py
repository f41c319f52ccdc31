"""Windows, intervals, ranks, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.functions import nulls, scalars, sequences
from loomwell.operators import aggregates, joins, sets, windows
from loomwell.plans.registry import query, table


@query("""
    with g as (select p_brand, s_suppkey, count(*) as n, bool_or(l_quantity > 49) as seq, bool_or(l_tax > 0.07) as enz, max(year(l_shipdate)) as ly from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where p_brand in ('Brand#11', 'Brand#12') group by 1, 2),
    s as (select *, (not seq)::int * 40 + (not enz)::int * 30 - greatest(0, max(ly) over (partition by p_brand) - ly) * 2 + case when n = 1 then 20 when n < 5 then 10 else 0 end as score from g)
    select p_brand, s_suppkey, score::int as score, rank from (select *, row_number() over (partition by p_brand order by score desc, s_suppkey) as rank from s) where rank <= 10
""")
def q15_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12")).select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate").join(p, "l_partkey")
    g = items.groupBy("p_brand", F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_quantity") > 49).alias("seq"), F.bool_or(F.col("l_tax") > 0.07).alias("enz"), F.max(F.year("l_shipdate")).alias("ly"))
    g = g.withColumn("my", F.max("ly").over(Window.partitionBy("p_brand"))).withColumn("score", scalars.candidate_score(F.col("seq"), F.col("enz"), F.col("ly"), F.col("my"), F.col("n")))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "s_suppkey"))
    return g.withColumn("rank", rank).filter("rank <= 10").select("p_brand", "s_suppkey", F.col("score").cast("int").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
    select p_brand, l_suppkey, n, rank from (select p_brand, l_suppkey, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, l_suppkey) as rank from lineitem join part on p_partkey = l_partkey group by 1, 2) where rank <= 3
""")
def q15_top_values(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return aggregates.top_values(table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(p, "l_partkey"), "p_brand", "l_suppkey", 3).withColumn("rank", F.col("rank").cast("long"))


_INTERVALS = "select l_suppkey as k, (l_orderkey % 99991) as s, (l_orderkey % 99991) + l_quantity::bigint as e from lineitem"


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    return i.select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") % 99991).alias("s"), (F.col("l_orderkey") % 99991 + F.rint("l_quantity").cast("long")).alias("e"))


@query(f"""
    with i as ({_INTERVALS}), r as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
    g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as g from r)
    select k, min(s) as s, max(e) as e from g group by k, g
""")
def q22_merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    return windows.islands(_intervals(spark, d), ["k"], "s", "e")


@query(f"""
    with i as ({_INTERVALS}), r as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
    g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as g from r),
    m as (select k, min(s) as s, max(e) as e from g group by k, g), x as (select s_suppkey as k, -1 as s, 0 as e from supplier union all select k, s, e from m),
    l as (select k, e as s, least(coalesce(lead(s) over (partition by k order by s), 100100), 100100) as e from x) select k, greatest(s, 0) as s, e from l where greatest(s, 0) < e
""")
def q22_gaps(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(100100).cast("long").alias("n"))
    return windows.complement(_intervals(spark, d), lengths, ["k"], "s", "e", "n", default=100100)


@query("""
    with t as (select user_id, event_id as p, value > 20 as good from events), h as (select user_id, p, p - row_number() over (partition by user_id order by p) as g from (select user_id, row_number() over (partition by user_id order by p) as p, good from t) where good),
    r as (select user_id, min(p) as start, max(p) as "end", count(*) as n from h group by user_id, g)
    select user_id, start, "end", n from (select *, row_number() over (partition by user_id order by n desc, start) as x from r) where x = 1
""")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return windows.longest_run(e, ["user_id"], "p", F.col("value") > 20)


@query("""
    select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as last_purchase from events
""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("event_id", "user_id", windows.forward_fill("v", ["user_id"], "event_id").alias("last_purchase"))


@query("""
    with n as (select c_custkey, row_number() over (order by c_nationkey, c_custkey) as p, count(*) over () as t from customer)
    select shard, count(*) as n, min(c_custkey) as low, max(c_custkey) as high from (select c_custkey, (p > round_even(t / 4.0, 0))::int + (p > round_even(2 * t / 4.0, 0))::int + (p > round_even(3 * t / 4.0, 0))::int as shard from n) group by shard
""")
def contiguous_shards(spark: SparkSession, d: str) -> DataFrame:
    c = windows.contiguous_shard(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], 4)
    return c.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


@query("select floor((row_number() over (order by s_suppkey) - 1) / 16)::bigint as chunk, s_suppkey from supplier")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return windows.fixed_chunks(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 16)


@query("select p_partkey, p_name from (select *, md5(p_partkey::varchar || ':7') as h from part order by h, p_partkey limit 50)")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sets.sample_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 50, seed=7)


@query("""
    select lang, doc_id from (select lang, doc_id, count(*) over (partition by lang) as n, row_number() over (partition by lang order by md5(doc_id::varchar || ':1'), doc_id) as r from documents where lang is not null) where n >= 20 and r <= 50
""")
def q38_stratified(spark: SparkSession, d: str) -> DataFrame:
    return sets.stratified(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 20, 50, seed=1)


@query("""
    select vec_id, label, row_number() over (partition by label order by md5(vec_id::varchar || ':3'), vec_id) <= floor(count(*) over (partition by label) * 0.8) as is_train from embeddings
""")
def class_split(spark: SparkSession, d: str) -> DataFrame:
    return sets.split_by_class(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.8, seed=3)


@query("select year, n from (select year(o_orderdate)::int as year, count(*) as n from orders group by 1) order by n desc, year limit 1")
def peak_year(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return y.orderBy(F.desc("n"), "year").limit(1)


@query("select s_suppkey, s_acctbal from supplier order by abs(s_acctbal) desc, s_suppkey limit 15")
def largest_by_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc(F.abs("s_acctbal")), "s_suppkey").limit(15)


@query("select k from (select c_custkey as k from customer where c_acctbal > 5000 union select user_id from events where value > 50)")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return sets.work_list(a, table(spark, d, "events").filter("value > 50").select(F.col("user_id").alias("k")), "k", intersect=False)


@query("select k from (select c_custkey as k from customer where c_acctbal > 5000 intersect select user_id from events where value > 50)")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return sets.work_list(a, table(spark, d, "events").filter("value > 50").select(F.col("user_id").alias("k")), "k", intersect=True)


@query("select k from (select c_custkey as k from customer where c_acctbal > 5000 except select user_id from events where value > 50)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return a.subtract(table(spark, d, "events").filter("value > 50").select(F.col("user_id").alias("k")))


@query("select event_type, user_id from events where value < 40 except all select event_type, user_id from events where event_id % 3 = 0")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter("value < 40").select("event_type", "user_id").exceptAll(e.filter("event_id % 3 = 0").select("event_type", "user_id"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) where r = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return sets.last_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""
    with t as (select p_partkey, case when p_partkey % 3 = 0 then '' else p_brand end as doi, p_name as title from part), k as (select *, coalesce(nullif(trim(lower(doi)), ''), nullif(trim(lower(title)), '')) as key from t)
    select p_partkey from (select p_partkey, row_number() over (partition by key order by p_partkey) as r from k where key is not null) where r = 1
""")
def first_by_doi_or_title(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("doi"), F.col("p_name").alias("title"))
    return sets.first_by_either(p, "doi", "title", "p_partkey").select("p_partkey")


@query("""
    select l_suppkey, dense_rank() over (order by n desc) as dr, ntile(4) over (order by n desc, l_suppkey) as quarter, n, lead(n) over (order by n desc, l_suppkey) as next_n from (select l_suppkey, count(*) as n from lineitem group by 1)
""")
def ranked_suppliers(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    w, v = Window.orderBy(F.desc("n")), Window.orderBy(F.desc("n"), "l_suppkey")
    return g.select("l_suppkey", F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(v).cast("long").alias("quarter"), "n", F.lead("n").over(v).alias("next_n"))


@query("select event_id, count(*) over (partition by user_id order by event_id range between 200 preceding and current row) as recent from events")
def range_frame(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-200, 0)
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("recent"))


@query("""
    with t as (select o_orderkey, o_custkey, o_orderpriority = '1-URGENT' as direct from orders)
    select o_custkey, o_orderkey, direct from (select *, row_number() over (partition by o_custkey order by direct desc, o_orderkey) as r from t) where r = 1
""")
def prefer_direct(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("direct"))
    return joins.first_row(o, ["o_custkey"], [F.desc("direct"), F.col("o_orderkey")])


@query("select event_type, user_id from events where value < 40 intersect all select event_type, user_id from events where value > 20")
def multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter("value < 40").select("event_type", "user_id").intersectAll(e.filter("value > 20").select("event_type", "user_id"))


@query("select r_name, n_name, r_regionkey = n_regionkey as own from region cross join nation")
def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A cross join of two tables of fixed size."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("own"))


@query("select c_custkey, count(o_orderkey) as n from orders right join customer on c_custkey = o_custkey group by 1")
def customers_and_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_orderkey")
    return o.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("select l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::int as level, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_set_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return t.groupingSets([[flag, status], [flag], []], flag, status).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n")).select("l_returnflag", "l_linestatus", "level", "n")


@query("select l_suppkey % 10 as k, round(exp(avg(ln(l_extendedprice))), 2) as middle from lineitem where l_extendedprice > 0 group by 1")
def geometric_means(spark: SparkSession, d: str) -> DataFrame:
    """A user-defined aggregate on the built-in ones' partial sums."""
    t = table(spark, d, "lineitem").filter("l_extendedprice > 0")
    return t.groupBy((F.col("l_suppkey") % 10).alias("k")).agg(F.round(aggregates.geometric_mean("l_extendedprice"), 2).alias("middle"))


@query("select p_partkey, unnest(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''))) as word from part")
def words_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Delimited lists to rows: split, normalised, without repeats."""
    return scalars.exploded(table(spark, d, "part"), "p_name", " ", "word").select("p_partkey", "word")


@query("select s_suppkey, i::int as place, substr(s_name, i::int, 1) as letter from supplier, range(1, 100) r(i) where i <= length(s_name)")
def letters_by_udtf(spark: SparkSession, d: str) -> DataFrame:
    """A user-defined table function, joined laterally."""

    class Letters:
        def eval(self, text: str):  # noqa: ANN201
            for i, c in enumerate(text or "", 1):
                yield i, c

    spark.udtf.register("letters_of", F.udtf(Letters, returnType="place int, letter string"))
    table(spark, d, "supplier").select("s_suppkey", "s_name").createOrReplaceTempView("suppliers_for_letters")
    return spark.sql("select s_suppkey, place, letter from suppliers_for_letters, lateral letters_of(s_name)")


@query("select l_returnflag, true as near from lineitem group by 1")
def approximate_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's median has a true rank within a hundredth of the middle."""
    t = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    m = t.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("m"))
    share = F.avg((F.col("l_extendedprice") <= F.col("m")).cast("double"))
    return t.join(m, "l_returnflag").groupBy("l_returnflag").agg((F.abs(share - 0.5) < 0.01).alias("near"))


@query("select (year(o_orderdate) // 10 * 10)::int as decade, count(*) as n from orders group by 1")
def decades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(scalars.decade(F.year("o_orderdate")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    select c_nationkey, round(count(distinct c_mktsegment) * 10 + ln(1 + count(*)) * 30 + (count(*) < 10)::int * 20, 4) as score from customer group by 1
""")
def exploration_scores(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("m"))
    plain = scalars.exploration_score(F.col("n"), F.lit(1.0), F.lit(1.0), F.col("n"))
    return g.select("c_nationkey", F.round(F.col("m") * 10 + plain, 4).alias("score"))


@query("""
    select p_partkey, round((p_size = 1)::int * 40 + (p_size % 2 = 0)::int * 35 + ln(1 + p_size) * 10, 4) as score from part
""")
def discovery_priorities(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(scalars.discovery_priority(s == 1, s % 2 == 1, s), 4).alias("score"))


@query("select event_type, round(avg(case when isnan(v) then null else v end), 4) as mean from (select event_type, case when event_id % 7 = 0 then 'nan'::double else value::double end as v from events) group by 1")
def nan_safe_means(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value").cast("double")))
    return e.groupBy("event_type").agg(F.round(F.avg(nulls.nan_to_null(F.col("v"))), 4).alias("mean"))


@query("select vec_id, round((embedding[1]::double + embedding[3]::double) / 2, 5) + 0.0::double as mean from embeddings where embedding is not null and len(embedding) >= 3")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the token vectors that the mask keeps; here of three tokens of one component each."""
    e = table(spark, d, "embeddings").filter("embedding is not null and size(embedding) >= 3")
    tokens = F.array(*[F.array(F.col("embedding")[i].cast("double")) for i in range(3)])
    return e.select("vec_id", (F.round(scalars.mean_pool(tokens, F.array(F.lit(1), F.lit(0), F.lit(1)))[0], 5) + F.lit(0.0)).alias("mean"))


@query("""
    select p_partkey, case when n between 40 and 1000 then '' when n < 40 then 'too_short' else 'too_long' end || case when p_size > 30 then case when n between 40 and 1000 then '' else ';' end || 'low_complexity' else '' end as reasons from (select p_partkey, p_size, p_size * 2 as n from part)
""")
def fragment_gates(spark: SparkSession, d: str) -> DataFrame:
    s = F.repeat(F.lit("AC"), F.col("p_size"))
    gates = sequences.quality_gates(s, F.col("p_size") / 100.0, F.lit(0.1))
    return table(spark, d, "part").select("p_partkey", gates["reasons"].alias("reasons"))


@query("select p_partkey, case when strpos(p_name, 'r') > 0 then substr(p_name, greatest(strpos(p_name, 'r') - 3, 1)::int, (strpos(p_name, 'r') + 3 - greatest(strpos(p_name, 'r') - 3, 1) + 1)::int) end as context from part")
def first_motif_contexts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.get(sequences.motif_contexts(F.col("p_name"), "r", 3), F.lit(0)).alias("context"))
