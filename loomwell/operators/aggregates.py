"""Grouped aggregates, histograms and mergeable moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_text(c: str, sep: str = "; ") -> Column:
    """Distinct values in order, joined."""
    return F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), sep)


def first_distinct(df: DataFrame, key: str, value: str, order: str, n: int = 3, sep: str = "; ") -> DataFrame:
    """key, value: the first n distinct values in row order, joined. Values are made unique before they are collected."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("o"))
    top = firsts.withColumn("r", rank).filter(F.col("r") <= n)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda s: s["v"]), sep).alias(value))


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the most frequent value, the smallest of equals."""
    n = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def top_values(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """key, value, n, rank: the k most frequent values of each key, ties by value."""
    n = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).filter(F.col("rank") <= k)


def diversity(df: DataFrame, value: str) -> DataFrame:
    """One row: n_unique, shannon, singletons, pct_singletons of the values' counts."""
    n = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    # -sum(p ln p) = ln N - sum(n ln n) / N, which needs no second pass
    return n.agg(
        F.count(F.lit(1)).alias("n_unique"),
        (F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("shannon"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        (F.avg((F.col("n") == 1).cast("double")) * 100).alias("pct_singletons"),
    )


def geometric_mean(c: str) -> Column:
    """Of positive values."""
    return F.exp(F.avg(F.ln(F.col(c).cast("double"))))


def mean_of_means(df: DataFrame, key: str, mean: str, count: str, weighted: bool = True) -> DataFrame:
    """Merges partial means: by their counts, or, as an option, as a mean of means."""
    m = F.try_divide(F.sum(F.col(mean) * F.col(count)), F.sum(F.when(F.col(mean).isNotNull(), F.col(count)))) if weighted else F.avg(mean)
    return df.groupBy(key).agg(m.alias(mean), F.sum(count).alias(count))


def weighted_quantiles(df: DataFrame, key: str, value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """key, one column q<percent> each: the first value whose running weight reaches the share."""
    d = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(key, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(key).orderBy(value)
    d = d.withColumn("cum", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(Window.partitionBy(key)))
    return d.groupBy(key).agg(*[F.min(F.when(F.col("cum") >= F.lit(q) * F.col("total"), F.col(value))).alias(f"q{round(q * 100)}") for q in quantiles])


def weighted_traits(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """key, weighted_mean, q25, q75, confidence: the known share of the weight over 1 + the quartile range."""
    known = F.col(value).isNotNull()
    m = df.groupBy(key).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(known, F.col(weight)))).alias("weighted_mean"), F.try_divide(F.sum(F.when(known, F.col(weight)).otherwise(0.0)), F.sum(weight)).alias("known"))
    out = m.join(weighted_quantiles(df, key, value, weight, [0.25, 0.75]), key, "left")
    return out.select(key, "weighted_mean", "q25", "q75", (F.col("known") / (1 + F.col("q75") - F.col("q25"))).alias("confidence"))


def binary_matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """One column for each value: 1 if the row has it, else 0. The values are given, so the plan has one pass."""
    return df.groupBy(row).pivot(column, values).agg(F.lit(1)).fillna(0, values)


def co_occurrence(df: DataFrame, row: str, column: str) -> DataFrame:
    """a, b, n: rows that have both values; a = b gives a value's own rows."""
    d = df.select(row, column).filter(F.col(row).isNotNull() & F.col(column).isNotNull()).distinct()
    return d.withColumnRenamed(column, "a").join(d.withColumnRenamed(column, "b"), row).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def bin_of(c: Column, low: float, width: float, bins: int, overflow: bool = True) -> Column:
    """Index of a fixed bin; missing values and those past the end are bin `bins`, or without overflow the last one."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((c - low) / width))).cast("int")
    if not overflow:
        return F.when(c.isNull() | F.isnan(c), None).otherwise(at)
    return F.when(c.isNull() | F.isnan(c) | (c >= low + width * bins), bins).otherwise(at)


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int, overflow: bool = True) -> DataFrame:
    return df.groupBy(bin_of(F.col(value), low, width, bins, overflow).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_shards(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Adds shards of one layout."""
    if any(p.columns != parts[0].columns for p in parts):
        raise ValueError("shards of different layouts")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def histogram_quantiles(hist: DataFrame, low: float, width: float, quantiles: list[float]) -> DataFrame:
    """q, value: left edge of the first bin whose running count reaches the share. hist: bin, n, some hundred rows."""
    total = hist.agg(F.sum("n").alias("total"))
    cum = hist.withColumn("cum", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    qs = hist.sparkSession.createDataFrame([(float(q),) for q in quantiles], "q double")
    met = cum.join(total, F.lit(True)).join(qs, F.col("cum") >= F.col("q") * F.col("total"))
    return met.groupBy("q").agg((F.min("bin") * width + low).alias("value"))


def moments(c: str) -> list[Column]:
    """n, mean, sum of squared deviations, min, max: Spark merges partial ones as needed."""
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"), F.min(c).alias("min"), F.max(c).alias("max")]


def merged_moments(parts: DataFrame) -> DataFrame:
    """One row from rows of n, mean, m2, min, max.

    Deviations are added up about the whole mean (Chan's rule for many parts), so large means do not cancel small deviations.
    """
    whole = parts.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("whole"))
    between = F.col("n") * (F.col("mean") - F.col("whole")) * (F.col("mean") - F.col("whole"))
    return parts.join(whole, F.lit(True)).agg(F.sum("n").alias("n"), F.first("whole").alias("mean"), F.sum(F.col("m2") + F.coalesce(between, F.lit(0.0))).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))


def null_profile(df: DataFrame) -> DataFrame:
    """column, null_count, null_pct in one pass."""
    r = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return r.unpivot("_n", df.columns, "column", "null_count").select("column", "null_count", (F.col("null_count") * 100.0 / F.col("_n")).alias("null_pct"))


def column_weights(df: DataFrame, key: str, sequence: str, weight: str) -> DataFrame:
    """key, pos (from 1), ch, w: weight of each character in each column of aligned texts."""
    e = df.select(key, weight, F.posexplode(F.filter(F.split(sequence, ""), lambda x: x != "")).alias("p", "ch"))
    return e.groupBy(key, (F.col("p") + 1).alias("pos"), "ch").agg(F.sum(weight).alias("w"))


def consensus(weights: DataFrame, key: str) -> DataFrame:
    """key, pos, ch: the heaviest character of each column, the largest of equals."""
    return weights.groupBy(key, "pos").agg(F.max_by("ch", F.struct("w", "ch")).alias("ch"))


def occupancy(weights: DataFrame, key: str) -> DataFrame:
    """key, pos, occupancy: weight of columns other than gaps."""
    return weights.groupBy(key, "pos").agg((F.sum(F.when(F.col("ch") != "-", F.col("w")).otherwise(0)) / F.sum("w")).alias("occupancy"))


def mutual_information(df: DataFrame, sequence: str, weight: str, columns: int) -> DataFrame:
    """i, j, mi, apc: weighted mutual information of all column pairs in bits, and less the average product."""
    chars = F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda i: F.struct(i.alias("i"), F.substring(F.col(sequence), i, F.lit(1)).alias("a")))
    rows = df.select(F.col(weight).alias("w"), chars.alias("c"))
    pairs = rows.select("w", F.explode("c").alias("x"), "c").select("w", "x", F.explode(F.filter("c", lambda y: y["i"] > F.col("x.i"))).alias("y"))
    joint = pairs.groupBy(F.col("x.i").alias("i"), F.col("y.i").alias("j"), F.col("x.a").alias("a"), F.col("y.a").alias("b")).agg(F.sum("w").alias("w"))
    by = lambda *c: Window.partitionBy("i", "j", *c)
    joint = joint.withColumns({"pa": F.sum("w").over(by("a")), "pb": F.sum("w").over(by("b")), "n": F.sum("w").over(by())})
    mi = joint.groupBy("i", "j").agg(F.sum(F.col("w") / F.col("n") * F.log2(F.col("w") * F.col("n") / (F.col("pa") * F.col("pb")))).alias("mi"))
    both = mi.select("i", "mi").unionByName(mi.select(F.col("j").alias("i"), "mi"))
    mean = both.groupBy("i").agg(F.avg("mi").alias("m"))
    whole = mi.agg(F.avg("mi").alias("all"))
    out = mi.join(mean.withColumnRenamed("m", "mi_i"), "i").join(mean.select(F.col("i").alias("j"), F.col("m").alias("mi_j")), "j").join(whole, F.lit(True))
    return out.select("i", "j", "mi", (F.col("mi") - F.coalesce(F.try_divide(F.col("mi_i") * F.col("mi_j"), F.col("all")), F.lit(0.0))).alias("apc"))
