"""Resume, ledgers and checks of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_do(work: DataFrame, ledger: DataFrame, key: str, status: str = "status", ok: str = "ok") -> DataFrame:
    """What the ledger has not as done well; failed rows come again."""
    return work.join(ledger.filter(F.col(status) == ok).select(key).distinct(), key, "left_anti")


def retryable(ledger: DataFrame, key: str, status: str = "status", ok: str = "ok", most: int = 3) -> DataFrame:
    """Keys that failed fewer than `most` times and never ended well."""
    g = ledger.groupBy(key).agg(F.count_if(F.col(status) == ok).alias("good"), F.count(F.lit(1)).alias("attempts"))
    return g.filter((F.col("good") == 0) & (F.col("attempts") < most)).select(key, "attempts")


def batch_report(df: DataFrame, batch: str, hit: Column, size: Column) -> DataFrame:
    return df.groupBy(batch).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.sum(size).alias("bytes"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, place, n."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.lit(name).alias("stage"), F.lit(i).alias("place"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def violations(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """rule, n: rows that break each rule (a column or SQL), in one pass; a rule that is null is not broken."""
    rules = {n: F.expr(c) if isinstance(c, str) else c for n, c in rules.items()}
    r = df.agg(*[F.count_if(F.coalesce(~c, F.lit(False))).alias(n) for n, c in rules.items()], F.lit(1).alias("_one"))
    return r.unpivot("_one", list(rules), "rule", "n").select("rule", "n")


def require(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """df, if no row breaks a rule; else an error that names the rules."""
    broken = [f"{r['rule']} ({r['n']} rows)" for r in violations(df, rules).collect() if r["n"]]
    if broken:
        raise ValueError("broken: " + ", ".join(broken))
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty if the sets are equal."""
    sides = a.select(key).distinct().withColumn("side", F.lit("left")).unionByName(b.select(key).distinct().withColumn("side", F.lit("right")))
    return sides.groupBy(key).agg(F.min("side").alias("side"), F.count(F.lit(1)).alias("n")).filter("n = 1").select(key, "side")
