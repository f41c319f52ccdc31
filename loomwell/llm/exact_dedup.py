"""Exact dedup: groups by a 128-bit content hash, compares bytes inside the groups, keeps one stable row each.

Built of DataFrame functions only. The grouping key holds the hash and the normalised text itself, so two
texts with one hash land in two groups; map-side partial aggregation shrinks a hot group to one row a task before
the shuffle. Rows then find their group by the hash. Hashes that belong to several texts are looked for once, in the
saved group table; only if there are any, their rows are matched by text as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.columns import BLANKS, text_or_empty
from loomwell.llm.scratch import saved


def content_hash(normalised: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(normalised.cast("binary")))


def normalised_text(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def groups_of(df: DataFrame, doc_id: str, text: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """One row for each distinct normalised text: dup_hash, dup_text, keep_id, group_size."""
    t = text_or_empty(df, text)
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.length(t).alias("n"), normalised_text(t).alias("dup_text"))
    rows = rows.select("*", hashed(F.col("dup_text")).alias("dup_hash"))
    # the largest struct has the most code points, then the smallest id (its bits turned over, which no id overflows); a null id comes last
    best = F.max(F.struct(F.col("n"), F.col("id").isNotNull().alias("has_id"), F.bitwise_not("id").alias("turned")))
    g = rows.groupBy("dup_hash", "dup_text").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return g.select("dup_hash", "dup_text", F.bitwise_not("best.turned").alias("keep_id"), "group_size")


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """All rows and columns of df, and ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their characters besides blanks are. Of equal texts the row with the most code points stays,
    then the smallest id. Null texts count as empty, and all empty texts are one group. A null id comes after all
    others. Rows that repeat an id and a text count one by one in ``group_size`` and share the decision. Columns of df
    with these four names are replaced. An empty table gives an empty table. Ids are long, the least one too, or text that holds
    whole numbers; another text as an id is an error, as Spark's cast has it.
    """
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    full = groups_of(df, doc_id, text, hashed)
    groups = saved(full.select("dup_hash", "keep_id", "group_size", F.sha2("dup_text", 256).alias("text_sha256")), "exact-groups")
    clash = groups.groupBy("dup_hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("dup_hash")
    # df's own columns travel as one struct, so that no name of theirs meets the ones in use here
    normal = normalised_text(text_or_empty(df, text))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), hashed(normal).alias("dup_hash"))
    if clash.isEmpty():
        out = rows.join(groups, "dup_hash")
    else:
        sure = rows.join(groups.join(clash, "dup_hash", "left_anti"), "dup_hash")
        exact = groups_of(df, doc_id, text, hashed).join(clash, "dup_hash", "left_semi").withColumn("text_sha256", F.sha2("dup_text", 256))
        unsure = rows.withColumn("dup_text", normalised_text(F.coalesce(F.col("row")[text].cast("string"), F.lit("")))).join(exact, ["dup_hash", "dup_text"]).drop("dup_text")
        out = sure.unionByName(unsure)
    own = [F.col("row")[c].alias(c) for c in df.columns]
    return out.select(*own, "keep_id", "group_size", F.col("row")[doc_id].cast("long").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
