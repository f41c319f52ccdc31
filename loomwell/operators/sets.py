"""Set operations and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators.joins import first_row


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n_shared, n_left_only, n_right_only, jaccard of the distinct keys."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).unionByName(b.select(key).distinct().withColumn("_a", F.lit(2))).filter(F.col(key).isNotNull())
    sides = both.groupBy(key).agg(F.sum("_a").alias("s"))
    n = lambda v: F.count_if(F.col("s") == v)
    return sides.agg(n(3).alias("n_shared"), n(1).alias("n_left_only"), n(2).alias("n_right_only"), F.try_divide(n(3).cast("double"), F.count(F.lit(1)).cast("double")).alias("jaccard"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_row(df, keys, [F.desc(order)])


def first_by_either(df: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """The first row for each value of `first`, or of `second` where that is empty; rows without both are left out."""
    key = F.coalesce(F.nullif(F.trim(F.lower(first)), F.lit("")), F.nullif(F.trim(F.lower(second)), F.lit("")))
    return first_row(df.withColumn("_key", key).filter(F.col("_key").isNotNull()), ["_key"], [F.col(order)]).drop("_key")


def work_list(a: DataFrame, b: DataFrame, key: str, intersect: bool) -> DataFrame:
    x, y = a.select(key), b.select(key)
    return x.intersect(y) if intersect else x.union(y).distinct()


def hash_order(key: str, seed: int) -> Column:
    """An order that follows from key and seed alone, and is the same in other engines."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same for the same seed; partial samples merge."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def stratified(df: DataFrame, stratum: str, key: str, least: int, most: int, seed: int = 0) -> DataFrame:
    """Strata under `least` rows are left out; of others at most `most` rows stay."""
    w = Window.partitionBy(stratum)
    d = df.filter(F.col(stratum).isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(hash_order(key, seed), key))})
    return d.filter((F.col("_n") >= least) & (F.col("_r") <= most)).drop("_n", "_r")


def split_by_class(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Adds is_train: the share of each class, by hash order."""
    w = Window.partitionBy(label)
    place = F.row_number().over(w.orderBy(hash_order(key, seed), key))
    return df.withColumn("is_train", place <= F.floor(F.count(F.lit(1)).over(w) * share))
