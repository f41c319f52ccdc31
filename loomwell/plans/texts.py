"""Evidence, sections, markup and tables from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import texts as T
from loomwell.plans.registry import query, table


@query(r"""
    with p as (select d.doc_id, lower(regexp_replace(d.text, '[^\w\s]', '', 'g')) as s, b.item_id, lower(regexp_replace(b.text, '[^\w\s]', '', 'g')) as e from documents d join benchmark b on b.item_id = d.doc_id % 40 where d.lang = 'en'),
    w as (select doc_id, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') as s, list_distinct(list_filter(regexp_split_to_array(e, '\s+'), lambda x: x <> '')) as e from p),
    h as (select doc_id, len(s) as n, max(len(list_intersect(e, s[i:i+59]))::double / len(e)) as best from w, range(1, 30000) r(i) where i <= greatest(len(s) - 59, 1) group by doc_id, s, e)
    select doc_id, case when n >= 60 and best >= 0.75 then 'LEXICAL_MATCH' else 'NO_MATCH_FOUND' end as status from h
""")
def q32_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.col("text").alias("source"), (F.col("doc_id") % 40).alias("item_id"))
    both = docs.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("evidence")), "item_id")
    return both.select("doc_id", T.evidence_status(F.col("evidence"), F.col("source")).alias("status"))


@query("select page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) as n, len(regexp_extract_all(html, '<a ')) as links from pages")
def q33_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length(T.strip_tags(F.col("html"))).cast("long").alias("n"), F.size(F.regexp_extract_all("html", F.lit("(<a )"), 1)).cast("long").alias("links"))


@query()
def links_near_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Links near a mention of supplementary material, in texts made of a page's address."""
    t = F.concat(F.lit("See the Supplementary material at "), "url", F.lit(". Other text."))
    return table(spark, d, "pages").select("page_id", F.array_join(T.links_near(t), " ").alias("links"))


@query("""
    with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as rn from (select conv_id, turn, case when turn % 3 = 2 then 'assistant' else role end as role, text from conversations where text is not null and turn is not null and conv_id is not null)),
    n as (select *, case when lag(role) over (partition by conv_id order by turn, text) is not distinct from role and rn > 1 then 0 else 1 end as new from t),
    b as (select *, sum(new) over (partition by conv_id order by turn, text rows unbounded preceding) as block from n)
    select conv_id, block::bigint as block, role, count(*) as n_blocks, sum(length(text))::bigint + count(*) - 1 as n_chars from b group by 1, 2, 3
""")
def q34_merged_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("text is not null and turn is not null and conv_id is not null")
    c = c.withColumn("role", F.when(F.col("turn") % 3 == 2, "assistant").otherwise(F.col("role"))).withColumn("o", F.struct("turn", "text"))
    m = T.merge_adjacent(c, "conv_id", "o", "role", "text")
    return m.select("conv_id", "block", "role", "n_blocks", F.length("text").cast("long").alias("n_chars"))


@query("""
    select item_id, item_id % 7 = 0 or contains(lower(text), lower(substr(text, 3, 10))) as found from benchmark
""")
def value_checks(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("item_id") % 7 == 0, "NOT_FOUND").otherwise(F.substring("text", 3, 10))
    return table(spark, d, "benchmark").select("item_id", T.value_in_evidence(value, F.col("text")).alias("found"))


@query(r"""
    with t as (select conv_id, turn, text, length(text) as n, lower(trim(text)) as low from conversations where text is not null)
    select conv_id, turn, case when turn < 5 and n < 200 then case when regexp_matches(low, 'volume|journal|received|available at') then 'Journal_Metadata' else 'Title_or_Authors' end
      when n >= 150 then 'Body_Text' else 'short' end as section from t where n >= 150 or turn < 5
""")
def section_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("text is not null and (length(text) >= 150 or turn < 5)")
    s = T.section_of(F.col("text"), F.col("turn"))
    return c.select("conv_id", "turn", F.when((F.col("turn") < 5) | (F.length("text") >= 150), s).otherwise("short").alias("section"))


@query()
def fuzzy_labels(spark: SparkSession, d: str) -> DataFrame:
    """Greedy matching of a conversation's turns to labelled ones, each used once."""
    c = table(spark, d, "conversations").filter("text is not null and turn is not null").select(F.col("conv_id"), F.col("turn").alias("place"), "text", F.col("role").alias("section"))
    return T.fuzzy_sections(c.select("conv_id", "place", "text"), c.select("conv_id", "place", "section", "text"), "conv_id")


@query("select event_id as source_record_id, json_extract(props, '$.k')::int as k, 'assay' as kind from events where props is not null union all select event_id, null, 'protein' from events where event_id % 2 = 0 and props is not null")
def json_to_tables(spark: SparkSession, d: str) -> DataFrame:
    """Lists of one document to tables, stacked over the union of their columns."""
    e = table(spark, d, "events").filter("props is not null")
    proteins = F.when(F.col("event_id") % 2 == 0, '[{"kind": "protein"}]').otherwise("[]")
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('```json\n{"assays": [{"kind": "assay", "k": '), k, F.lit('}], "proteins": '), proteins, F.lit("}\n```"))
    t = T.json_tables(e.withColumn("doc", doc), "event_id", "doc", {"assays": "k: int, kind: string", "proteins": "kind: string"})
    return T.stacked([t["assays"], t["proteins"]])


@query("select item_id, regexp_replace(trim(text), '\\s+', ' ', 'g') as text from benchmark where text is not null")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Texts to maps from word to places, and back."""
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("place", "word"))
    lists = w.groupBy("item_id", "word").agg(F.sort_array(F.collect_list("place")).alias("places"))
    maps = lists.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return T.from_inverted_index(maps, "item_id", "index")


@query("select case event_id % 4 when 0 then 'api_error' when 1 then 'truncated' when 2 then 'parse_error' else 'ok' end as status, count(*) as n from events group by 1")
def answer_statuses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, d, "events").select(F.when(i % 4 == 0, "timeout").alias("error"), F.when(i % 4 == 1, "max_tokens").otherwise("end").alias("stop"), F.when(i % 4 == 2, "{oops").otherwise('```json\n{"a": 1}\n```').alias("text"))
    return T.answer_status(e, "error", "stop", "text").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
