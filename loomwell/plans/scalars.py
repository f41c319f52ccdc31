"""Parsers, classifiers and scalar functions over columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import scalars as S
from loomwell.plans.registry import query, table


@query("""
    with t as (select event_id, case event_id % 4 when 0 then 'Yes' when 1 then 'no' when 2 then 'maybe' end as b, case when event_id % 5 = 0 then 'n/a' else value::varchar end as v, event_type from events)
    select event_id, case when b in ('Yes', 'yes') then true when b in ('No', 'no') then false end as flag, try_cast(v as double) as number, coalesce(length(event_type) > 4, false) as long_type, coalesce(b <> '', false) as filled from t
""")
def coercions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    t = table(spark, d, "events").select(i, F.when(i % 4 == 0, "Yes").when(i % 4 == 1, "no").when(i % 4 == 2, "maybe").alias("b"), F.when(i % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("v"), "event_type")
    return t.select("event_id", S.yes_no(F.col("b")).alias("flag"), S.number(F.col("v")).alias("number"), S.longer_than(F.col("event_type"), 4).alias("long_type"), S.filled(F.col("b")).alias("filled"))


@query("select p_partkey from part where p_type >= 'E' and p_type < 'M' and p_size between 5 and 30 and p_name not ilike '%RED%' and p_brand in ('Brand#11', 'Brand#21', 'Brand#17')")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, d, "part").filter((t >= "E") & (t < "M") & F.col("p_size").between(5, 30) & ~F.col("p_name").ilike("%RED%") & F.col("p_brand").isin("Brand#11", "Brand#21", "Brand#17")).select("p_partkey")


CATEGORIES = {"fast": ["1-URGENT", "2-HIGH"], "slow": ["5-LOW", "1-URGENT"]}


@query("""
    select o_orderkey, case when o_orderpriority is null then 'Unknown' when o_orderpriority in ('1-URGENT', '2-HIGH') then 'fast' when o_orderpriority in ('5-LOW', '1-URGENT') then 'slow' else 'Other' end as category,
      (floor(year(o_orderdate) / 10) * 10)::int as decade, case o_orderstatus when 'F' then 'Finished' when 'O' then 'Open' else o_orderstatus end as status from orders
""")
def categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.first_match(F.col("o_orderpriority"), CATEGORIES).alias("category"), S.decade(F.year("o_orderdate")).alias("decade"), S.looked_up(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("status"))


@query("""
    with t as (select p_partkey, case p_partkey % 5 when 0 then p_size || '-' || (p_size + 10) || '; ' || (p_size + 2) when 1 then p_size::varchar when 2 then p_size || ' - ' || (p_size + 4) || '.5' when 3 then 'mesophilic' else p_size || '; x; ' || (p_size + 1) || '.25' end as v, p_size as s from part)
    select p_partkey, case p_partkey % 5 when 0 then s + 2 when 1 then s when 2 then s + 2.25 when 4 then s end::double as optimum, case when p_partkey % 5 <> 3 then s end::double as low,
      case p_partkey % 5 when 0 then s + 10 when 1 then s when 2 then s + 4.5 when 4 then s + 1.25 end::double as high from t
""")
def q29_ranges(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("p_partkey") % 5, F.col("p_size")
    v = F.when(i == 0, F.concat(s, F.lit("-"), s + 10, F.lit("; "), s + 2)).when(i == 1, s.cast("string")).when(i == 2, F.concat(s, F.lit(" - "), s + 4, F.lit(".5"))).when(i == 3, "mesophilic").otherwise(F.concat(s, F.lit("; x; "), s + 1, F.lit(".25")))
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in S.range_or_value(v).items()])


_ACC = "case p_partkey % 6 when 0 then 'WP_' || (1000000 + p_partkey) || '.1' when 1 then 'P' || (10000 + p_partkey % 89999) when 2 then 'ABC' || (10000 + p_partkey) || '.2' when 3 then (p_partkey % 9 + 1) || 'abc_A' when 4 then 'CA' || (100000 + p_partkey) else 'x-' || p_partkey end"


@query(f"""
    with a as (select p_partkey, regexp_replace(regexp_replace(trim({_ACC}), '\\.\\d+$', ''), '_[A-Za-z]$', '') as clean from part)
    select p_partkey, clean, case when regexp_matches(clean, '^([A-N_R-Z][0-9][A-Z0-9]{{3}}[0-9]|[O,P,Q][0-9][A-Z0-9]{{4}})([A-Z0-9]{{4}})?$') then 'uniprot' when regexp_matches(clean, '^(WP|NP|XP|YP|AP|ZP)_\\d+$') then 'refseq'
      when regexp_matches(clean, '^([A-Z]{{3}}\\d{{5,7}}|[A-Z]{{2}}\\d{{5,6}})$') then 'genbank' when regexp_matches(clean, '^[0-9][A-Za-z0-9]{{3}}$') then 'pdb' else 'other' end as kind from a
""")
def q30_accessions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    acc = F.when(k % 6 == 0, F.concat(F.lit("WP_"), 1000000 + k, F.lit(".1"))).when(k % 6 == 1, F.concat(F.lit("P"), 10000 + k % 89999)).when(k % 6 == 2, F.concat(F.lit("ABC"), 10000 + k, F.lit(".2")))
    acc = acc.when(k % 6 == 3, F.concat(k % 9 + 1, F.lit("abc_A"))).when(k % 6 == 4, F.concat(F.lit("CA"), 100000 + k)).otherwise(F.concat(F.lit("x-"), k))
    return table(spark, d, "part").select(k, S.clean_accession(acc).alias("clean")).withColumn("kind", S.accession_kind(F.col("clean")))


@query("""
    select l_orderkey, l_linenumber, l_partkey, l_orderkey as orf_id, 'G' || l_partkey as genbank_accession, l_quantity::bigint as orf_end, case when l_linenumber % 2 = 0 then 'G' || l_partkey else 'zz' end as picked from lineitem where l_linenumber <= 2
""")
def headers(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").filter("l_linenumber <= 2")
    h = F.concat_ws("|", F.concat(F.lit(">"), "l_orderkey"), F.concat(F.lit("G"), "l_partkey"), F.lit("lib"), F.lit("c1"), F.lit("1"), F.col("l_quantity").cast("long"), F.lit("complete"))
    f = S.bar_header(h)
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("zz|G"), "l_partkey")).otherwise("zz")
    return i.select("l_orderkey", "l_linenumber", "l_partkey", f["orf_id"].alias("orf_id"), f["genbank_accession"].alias("genbank_accession"), f["orf_end"].alias("orf_end"), S.pick_accession(raw, r"G\d+").alias("picked"))


@query("""
    with b as (select user_id, bit_or(case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 4 when 'signup' then 8 else 16 end) as mask from events group by 1)
    select mask::int as mask, count(*) as n, count(*) filter (where (mask & 4) <> 0) as n_purchase from b group by 1
""")
def q24_masks(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    bit = F.when(e == "click", 1).when(e == "view", 2).when(e == "purchase", 4).when(e == "signup", 8).otherwise(16)
    m = table(spark, d, "events").groupBy("user_id").agg(F.bit_or(bit).alias("mask"))
    return m.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.count_if(S.has_bit(F.col("mask"), 4)).alias("n_purchase"))


@query("""
    select n_nationkey, case n_nationkey % 4 when 0 then 3 when 1 then 32 when 2 then 256 | 1 else 0 end as localization, case when n_nationkey % 2 = 0 then 'TATLIPO' else 'SP' end as signal from nation
""")
def label_masks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    labels = F.when(k % 4 == 0, "Cytoplasm;Nucleus").when(k % 4 == 1, "ER").when(k % 4 == 2, "Lysosome/Vacuole, Nucleus").otherwise("")
    return table(spark, d, "nation").select(k, S.label_mask(labels, S.LOCALIZATION).alias("localization"), S.signal_label(F.when(k % 2 == 0, "TATLIPO_x").otherwise("sp(Sec/SPI)")).alias("signal"))


@query("""select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') as slug, translate(lower(trim(url)), '/:', '_-') as file_name from pages""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.slug(F.col("url")).alias("slug"), S.doi_file_name(F.col("url")).alias("file_name"))


@query("""
    select p_partkey, case when p_partkey % 2 = 0 then p_size * 100 else p_size end::bigint as count, p_partkey % 3 = 0 as doi_missing, (2010 + p_size)::varchar || '-05-01' > '2021-09-30' as is_later, 'p' || p_size as variant, case when p_partkey % 2 = 0 then '1abc:B' else '1abc' end as joined,
      md5(upper(p_name)) as content_key from part
""")
def small_parsers(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 2 == 0, F.concat((s / 10).cast("decimal(10,1)"), F.lit("k"))).otherwise(s.cast("string"))
    pdb, chain = S.pdb_chain(F.when(k % 2 == 0, "1ABC:B").otherwise("1ABC"))
    return table(spark, d, "part").select(
        k,
        S.short_count(text).alias("count"),
        S.doi_missing(F.when(k % 3 == 0, " Unsure ").otherwise("10.1/x")).alias("doi_missing"),
        S.later_than(F.concat(2010 + s, F.lit("-05-01")), "2021-09-30").alias("is_later"),
        S.variant_label(F.concat(F.lit("p"), s, F.lit("_tok__"), k)).alias("variant"),
        S.joined_chain(pdb, chain).alias("joined"),
        S.content_key(F.concat("p_name", F.lit("**"))).alias("content_key"),
    )


@query("""
    select event_id, case event_id % 5 when 0 then null when 1 then 'unparseable' when 2 then 'base differs' when 3 then 'outside base' else null end as reason, case event_id % 5 when 0 then 'sub' when 2 then 'sub' when 3 then 'del' when 4 then 'ins' end as kind from events
""")
def mutations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    token = F.when(i % 5 == 0, "A2N").when(i % 5 == 1, "foo").when(i % 5 == 2, "C2N").when(i % 5 == 3, "G99-").otherwise("-4r")
    m = S.mutation(token, F.lit("MACD"))
    return table(spark, d, "events").select("event_id", m["reason"].alias("reason"), F.when(i % 5 != 1, m["kind"]).alias("kind"))


@query("select e.event_id, json_extract(props, '$.k')::int as k, (json_extract(props, '$.k')::int) % 10 as last_digit from events e where props is not null")
def q31_json_cells(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k int")
    return table(spark, d, "events").filter("props is not null").select("event_id", p["k"].alias("k"), (p["k"] % 10).alias("last_digit"))


@query("select doc_id, md5(text) as key from (select min(doc_id) as doc_id, text from documents where text is not null group by text having count(*) > 1)")
def q28_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "key")


@query("""
    with v as (select a.vec_id as a, b.vec_id as b, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select a, b, round(list_cosine_similarity(x::double[], y::double[]), 5) as cosine from v
""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "a").select("a", "b", F.round(S.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query("select n_nationkey, n_nationkey * 1.5::double as lon, -n_nationkey::double as lat from nation")
def geo_points(spark: SparkSession, d: str) -> DataFrame:
    """WKB points, made by a small UDF and decoded again."""
    @F.pandas_udf("binary")
    def point(k: pd.Series) -> pd.Series:
        import struct

        return k.map(lambda i: struct.pack("<BIdd", 1, 1, i * 1.5, -float(i)))

    lon, lat = S.wkb_point(point("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey", lon.alias("lon"), lat.alias("lat"))


@query("select conv_id, turn, ceil(length(regexp_split_to_array(trim(text), '\\s+')) * 1.3)::bigint as tokens from conversations where text <> '' and trim(text) <> ''")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("text <> '' and trim(text) <> ''")
    return c.select("conv_id", "turn", S.token_estimate(F.col("text")).alias("tokens"))
