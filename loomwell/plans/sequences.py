"""Sequence functions over the texts, whose capitals stand for residues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import sequences as Q
from loomwell.operators import aggregates
from loomwell.plans.registry import query, table

_CLEAN = "regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", Q.clean(F.col("text")).alias("s"))


@query(f"""
    with h as (select doc_id, {_CLEAN} as s from documents)
    select doc_id, length(s) as n, round((length(s) - length(replace(s, 'A', '')))::double / nullif(length(s), 0), 6) as share_a, round((length(s) - length(regexp_replace(s, '[FWY]', '', 'g')))::double / nullif(length(s), 0), 6) as aromaticity,
      regexp_matches(s, 'G[ACDEFGHIKLMNPQRSTVWY]S[ACDEFGHIKLMNPQRSTVWY]G') as motif,
      (length(s) - length(regexp_replace(s, '[KRH]', '', 'g'))) - (length(s) - length(regexp_replace(s, '[DE]', '', 'g'))) as charge from h
""")
def q26_composition(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return _whole(spark, d).select("doc_id", F.length(s).cast("long").alias("n"), F.round(Q.composition(s)["A"], 6).alias("share_a"), F.round(Q.share_of(s, "FWY"), 6).alias("aromaticity"), Q.has_motif(s).alias("motif"), (Q.count_of(s, "KRH") - Q.count_of(s, "DE")).cast("long").alias("charge"))


def _sum_sql(values: dict[str, float]) -> str:
    return " + ".join(f"(length(s) - length(replace(s, '{a}', ''))) * ({v})::double" for a, v in values.items())


@query(f"""
    with h as (select doc_id, {_CLEAN} as s from documents) select doc_id, round(({_sum_sql(Q.HYDROPATHY)}) / length(s), 4)::double as gravy, round(({_sum_sql(Q.MASS)} - (length(s) - 1) * 18.0153) / 1000, 2)::double as molecular_weight_kda from h where length(s) >= 10
""")
def protein_properties(spark: SparkSession, d: str) -> DataFrame:
    p = Q.properties(F.col("s"))
    return _whole(spark, d).filter(F.length("s") >= 10).select("doc_id", p["gravy"].alias("gravy"), p["molecular_weight_kda"].alias("molecular_weight_kda"))


@query()
def isoelectric_points(spark: SparkSession, d: str) -> DataFrame:
    """By bisection, in an Arrow UDF on counts."""
    return _whole(spark, d).filter(F.length("s") >= 10).select("doc_id", F.round(Q.isoelectric_point(F.col("s")), 3).alias("pi"))


@query(f"""
    with h as (select doc_id, {_CLEAN} as s from documents), k as (select doc_id, list_distinct(list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5))) as k from h where length(s) >= 5)
    select x.doc_id as a, y.doc_id as b, round(len(list_intersect(x.k, y.k))::double / (len(x.k) + len(y.k) - len(list_intersect(x.k, y.k))), 6) as jaccard from k x join k y on y.doc_id = x.doc_id + 1
""")
def q27_kmer_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """K-mer similarity of each sequence and the next one."""
    k = _whole(spark, d).filter(F.length("s") >= 5).select("doc_id", Q.kmers(F.col("s"), 5).alias("k"))
    pairs = k.select(F.col("doc_id").alias("a"), F.col("k").alias("ka")).join(k.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("k").alias("kb")), "a")
    return pairs.select("a", "b", F.round(Q.kmer_jaccard(F.col("ka"), F.col("kb")), 6).alias("jaccard"))


_CASE = " ".join(f"when '{a}' then {v}" for a, v in Q.HYDROPATHY.items())


@query(f"""
    with h as (select doc_id, {_CLEAN} as s from documents), c as (select doc_id, unnest(range(1, length(s) + 1)) as i, s from h where length(s) > 0), v as (select doc_id, i, case substr(s, i, 1) {_CASE} end::double as v from c),
    p as (select doc_id, avg(v) over (partition by doc_id order by i rows between 4 preceding and 4 following) as m from v)
    select doc_id, count(*) as n, round(max(m), 5) + 0.0::double as highest, round(min(m), 5) + 0.0::double as lowest, count(*) filter (where m > 1.60001) as above from p group by 1
""")
def q42_window_profile(spark: SparkSession, d: str) -> DataFrame:
    """What the profile of each whole sequence reaches, and at how many residues it is above 1.6."""
    p = _whole(spark, d).filter(F.length("s") > 0).select("doc_id", Q.window_profile(F.col("s")).alias("m"))
    return p.select("doc_id", F.size("m").cast("long").alias("n"), *[(F.round(x, 5) + F.lit(0.0)).alias(c) for x, c in ((F.array_max("m"), "highest"), (F.array_min("m"), "lowest"))], F.size(F.filter("m", lambda x: x > 1.60001)).cast("long").alias("above"))


@query(f"""
    with h as (select doc_id, substr({_CLEAN}, 1, 30) as s from documents), c as (select doc_id, i, length(s) as n, case substr(s, i::int, 1) {_CASE} end::double as v from h, range(1, 31) r(i) where i <= length(s)),
    w as (select doc_id, i, n, avg(v) over (partition by doc_id order by i rows between current row and 7 following) as m from c) select doc_id, round(max(m), 5) + 0.0::double as best from w where i <= n - 7 group by doc_id
""")
def best_start_window(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).select("doc_id", (F.round(Q.best_window(F.col("s"), 30, 8), 5) + F.lit(0.0)).alias("best")).filter("best is not null")


@query("""
    select doc_id, case when n_chars % 40 > 0 and n_chars % 40 < length(text) then substr(text, (n_chars % 40)::int + 1) else text end as mature, n_chars % 40 > 0 and n_chars % 40 < length(text) as is_mature from documents where text is not null
""")
def mature_slices(spark: SparkSession, d: str) -> DataFrame:
    m = Q.mature_slice(F.col("text"), (F.col("n_chars") % 40).cast("int"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", m["mature"].alias("mature"), m["is_mature"].alias("is_mature"))


@query("""
    with r as (select i as pos, s_nationkey as k, substr(s, i::int, 1) as ch, w from (select s_nationkey, rpad(left(s_name, 1) || s_suppkey || '--', 6, '-') as s, s_nationkey + 1 as w from supplier), range(1, 7) r(i))
    select k, pos::int as pos, ch, occupancy from (select k, pos, ch, w, row_number() over (partition by k, pos order by w desc, ch desc) as r, round(sum(case when ch <> '-' then w else 0 end) over (partition by k, pos)::double / sum(w) over (partition by k, pos), 6) as occupancy from (select k, pos, ch, sum(w) as w from r group by 1, 2, 3)) where r = 1
""")
def consensus_columns(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.rpad(F.concat(F.substring("s_name", 1, 1), "s_suppkey", F.lit("--")), 6, "-").alias("s"), (F.col("s_nationkey") + 1).alias("w"))
    w = aggregates.column_weights(s, "k", "s", "w")
    return aggregates.consensus(w, "k").join(aggregates.occupancy(w, "k"), ["k", "pos"]).select("k", "pos", "ch", F.round("occupancy", 6).alias("occupancy"))


@query("""
    with h as (select lpad(p_partkey::varchar, 8, '-') as s, p_size as w, p_partkey from part), c as (select p_partkey, i, substr(s, i::int, 1) as ch, w from h, range(1, 9) r(i)),
    j as (select x.i, y.i as j, x.ch as a, y.ch as b, sum(x.w) as w from c x join c y on y.p_partkey = x.p_partkey and x.i < y.i group by 1, 2, 3, 4),
    p as (select *, sum(w) over (partition by i, j, a) as pa, sum(w) over (partition by i, j, b) as pb, sum(w) over (partition by i, j) as n from j)
    select i::int as i, j::int as j, round(sum(w / n * log2(w * n / (pa * pb)))::double, 5) + 0.0::double as mi from (select i, j, w::double as w, pa::double as pa, pb::double as pb, n::double as n from p) group by 1, 2
""")
def q41_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of columns of an alignment: the keys of parts, aligned on the right."""
    s = table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "-").alias("s"), F.col("p_size").cast("double").alias("w"))
    return aggregates.mutual_information(s, "s", "w", 8).select("i", "j", (F.round("mi", 5) + F.lit(0.0)).alias("mi"))


@query("""
    select p_partkey, case when contains(lower(p_name), 'red') then 'x' else 'y' end as family from part
""")
def enzyme_families(spark: SparkSession, d: str) -> DataFrame:
    """Family by the words of a made name: parts named red are petases, the others unknown."""
    name = F.when(F.lower("p_name").contains("red"), "PETase 2").otherwise("hydrolase")
    f = Q.enzyme_family(name, F.lit("PET"))
    return table(spark, d, "part").select("p_partkey", F.when(f == "PETase / Cutinase", "x").when(f == "Unknown", "y").alias("family"))


@query()
def control_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled residues, and a fragment, for each document; the same for the same seed."""
    return _whole(spark, d).select("doc_id", Q.shuffled(F.col("s"), F.col("doc_id"), 1).alias("shuffled"), Q.fragment(F.col("s"), F.col("doc_id"), 0.3).alias("fragment"))


@query(f"""
    select md5(s) as key, length(s) as length, count(*) as n, min(doc_id) as doc_id from (select doc_id, {_CLEAN} as s from documents) group by s having count(*) > 1
""")
def weighted_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = _whole(spark, d).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n > 1")
    return found.select(F.md5(F.col("s").cast("binary")).alias("key"), F.length("s").cast("long").alias("length"), "n", "doc_id")
