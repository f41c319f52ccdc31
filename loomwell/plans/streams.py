"""Event-time windows over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.plans.registry import query, table
from loomwell.streaming import events


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def q40_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 2))


@query("""
    select time_bucket(interval '30 minutes', ts) - to_minutes(30 * o) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events, (values (0), (1)) s(o) group by 1, 2
""")
def q40_sliding(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value", slide="30 minutes").withColumn("total", F.round("total", 2))


@query("""
    with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events where ts is not null), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
    select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, s
""")
def q40_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


@query("select count(distinct user_id) as exact, count(distinct user_id) > 0 as near from events")
def approximate_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's estimate is within a tenth of the exact count."""
    e = table(spark, d, "events").agg(F.count_distinct("user_id").alias("exact"), F.approx_count_distinct("user_id", 0.03).alias("sketch"))
    return e.select("exact", (F.abs(F.col("sketch") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))
