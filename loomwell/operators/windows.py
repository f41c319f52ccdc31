"""Ordered windows: trends, islands, intervals, ranks and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def trend(df: DataFrame, order: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Adds rolling_3 (null at both ends), growth_pct, cumulative. df: one row for each period, some thousand a key."""
    w = _over(keys or [], order)
    near = w.rowsBetween(-1, 1)
    v, before = F.col(value), F.lag(value).over(w)
    return df.withColumns(
        {
            "rolling_3": F.when(F.count(value).over(near) == 3, F.avg(value).over(near)),
            "growth_pct": F.try_divide((v - before).cast("double"), before.cast("double")) * 100,
            "cumulative": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


def cumulative_distinct(df: DataFrame, period: str, member: str) -> DataFrame:
    """period, cumulative_distinct for each period with a row; periods without a new member keep the last number."""
    d = df.filter(F.col(period).isNotNull())
    firsts = d.filter(F.col(member).isNotNull()).groupBy(member).agg(F.min(period).alias(period)).groupBy(period).agg(F.count(F.lit(1)).alias("new"))
    every = d.select(period).distinct().join(firsts, period, "left").fillna(0, ["new"])
    return running_total(every, [period], "new", "cumulative_distinct").select(period, "cumulative_distinct")


def forward_fill(c: str, keys: list[str], order: str) -> Column:
    return F.last(c, ignorenulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def share_of_total(n: str, keys: list[str] | None = None) -> Column:
    return F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy(*(keys or [])))


def retention(df: DataFrame, order: str, n: str) -> DataFrame:
    """Adds pct_of_previous and pct_of_first for the stages of a funnel."""
    w = Window.orderBy(order)
    first = F.first(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"pct_of_previous": F.try_divide(F.col(n) * 100.0, F.lag(n).over(w)), "pct_of_first": F.try_divide(F.col(n) * 100.0, first)})


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Merged half-open intervals: those that overlap, touch, or are at most `gap` apart. Nulls come last, so one without a start joins the last interval of its key."""
    w = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def complement(df: DataFrame, lengths: DataFrame, keys: list[str], start: str, end: str, length: str, default: int | None = None) -> DataFrame:
    """Gaps of the merged intervals inside [0, length); a key without intervals is one gap.

    A key that lengths lacks is left out; with a default it has that length, and its gaps begin after its first interval.
    """
    known = lengths.groupBy(*keys).agg(F.max(length).alias(length))
    marks = islands(df, keys, start, end).select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")).join(known, keys, "left")
    marks = marks.select(*keys, F.coalesce(length, F.lit(default)).alias(length), F.lit(1).alias("_place"), "_s", "_e").filter(F.col(length).isNotNull())
    rows = known.select(*keys, length, F.lit(0).alias("_place"), F.lit(None).cast("long").alias("_s"), F.lit(0).cast("long").alias("_e")).unionByName(marks)
    w = Window.partitionBy(*keys).orderBy("_place", F.col("_s").asc_nulls_last(), F.col("_e").asc_nulls_last())
    gaps = rows.select(*keys, F.greatest(F.lit(0), F.col("_e")).alias(start), F.least(F.coalesce(F.lead("_s").over(w), F.col(length)), F.col(length)).cast("long").alias(end))
    return gaps.filter(F.col(start) < F.col(end))


def longest_run(df: DataFrame, keys: list[str], pos: str, good: Column) -> DataFrame:
    """keys, start, end, n: the longest run of places in a row that are good, the first of equals."""
    hits = df.filter(good).withColumn("_g", F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))
    runs = hits.groupBy(*keys, "_g").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.min_by(F.struct("start", "end", "n"), F.struct(-F.col("n"), F.col("start"))).alias("r")).select(*keys, "r.*")


def contiguous_shard(df: DataFrame, order: list[str], shards: int, shard: str = "shard") -> DataFrame:
    """Adds the shard of each row: bands of the order whose edges are rounded half to even.

    Global places come from counts by range partition, so no task holds all rows.
    """
    numbered = global_place(df, order, "_place")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    edges = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.bround(k * F.col("_total") / F.lit(float(shards)), 0))
    out = numbered.join(total, F.lit(True)).withColumn(shard, F.size(F.filter(edges, lambda e: e < F.col("_place"))))
    return out.drop("_place", "_total")


#: Bands of an order, and rows that their edges are taken from.
BANDS, EDGE_ROWS = 64, 2000


def band(df: DataFrame, order: list[str]) -> Column:
    """The band of each row in the order, from 0, by edges that are read from a sample once and then are part of the plan.

    Any edges give right results, so no place depends on how tasks were dealt or run again.
    """
    d = df.select(*order)
    share = min(1.0, EDGE_ROWS / max(1, d.count()))
    rows = d.sample(share, 1).orderBy(*order).limit(2 * EDGE_ROWS).collect()
    edges = [rows[len(rows) * k // BANDS] for k in range(1, BANDS)] if len(rows) >= BANDS else []
    kind = f"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in d.schema)}>"
    listed = [F.struct(*[F.lit(x).alias(c) for c, x in zip(order, e)]).cast(kind) for e in dict.fromkeys(map(tuple, edges))]
    own = F.struct(*[F.col(c) for c in order])
    return F.size(F.filter(F.array(*listed), lambda e: e <= own)) if listed else F.lit(0)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of a value over all rows up to each one in the order: its sum inside its band, and the sums of the bands before it."""
    banded = df.withColumn("_p", band(df, order))
    own = banded.withColumn(name, F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = banded.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))
    return own.join(before, "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def global_place(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place from 1."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one")


def fixed_chunks(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Adds the chunk, from 0, of so many rows each."""
    return global_place(df, order, "_i").withColumn(name, F.floor((F.col("_i") - 1) / size).cast("long")).drop("_i")
