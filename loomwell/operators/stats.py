"""Rank and contingency statistics, regression and silhouette as DataFrames."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions.probability import chi_square_p, correlation_p
from loomwell.operators.windows import running_total


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a normal deviate: the complementary error function by the rational form 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def average_ranks(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Adds the mean rank of equal values. Values are counted first, so the ranking sees distinct values only."""
    keys = keys or []
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        n = n.withColumn("_cum", F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        n = running_total(n, [value], "_n", "_cum")
    ranks = n.withColumn(name, F.col("_cum") - (F.col("_n") - 1) / 2).drop("_cum").withColumnRenamed("_n", f"{name}_ties")
    return df.join(ranks, [*keys, value])


def mann_whitney(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """One row: n_a, n_b, u (of a), z, p, with ties corrected."""
    d = average_ranks(df.filter(F.col(group).isin(a, b)), value, "r")
    ties = d.select(value, "r_ties").distinct().agg(F.sum(F.pow(F.col("r_ties"), 3) - F.col("r_ties")).alias("t"))
    s = d.agg(F.count_if(F.col(group) == a).cast("double").alias("n_a"), F.count_if(F.col(group) == b).cast("double").alias("n_b"), F.sum(F.when(F.col(group) == a, F.col("r"))).alias("ra")).join(ties, F.lit(True))
    n = F.col("n_a") + F.col("n_b")
    u = F.col("ra") - F.col("n_a") * (F.col("n_a") + 1) / 2
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * (n + 1 - F.try_divide(F.col("t"), n * (n - 1))))
    z = F.try_divide(u - F.col("n_a") * F.col("n_b") / 2, sd)
    return s.select(F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), u.alias("u"), z.alias("z"), normal_two_sided(z).alias("p"))


def kruskal_wallis(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """One row: groups, n, h with ties corrected, p; groups under `least` rows are left out."""
    big = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= least).select(group)
    d = average_ranks(df.join(big, group), value, "r")
    ties = d.select(value, "r_ties").distinct().agg(F.sum(F.pow(F.col("r_ties"), 3) - F.col("r_ties")).alias("t"))
    g = d.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("r").alias("s"))
    t = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).join(ties, F.lit(True))
    h = (12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)) / (1 - F.col("t") / (F.pow("n", F.lit(3)) - F.col("n")))
    return t.select("groups", F.col("n").cast("long").alias("n"), h.alias("h")).withColumn("p", chi_square_p(F.col("h"), F.col("groups") - 1))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, rho, two-sided p by Student's t."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_ranks(average_ranks(d, a, "ra"), b, "rb").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho")).withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, dof, p of the contingency table; empty cells count."""
    n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    t = n.withColumns({"ra": F.sum("o").over(Window.partitionBy(a)), "rb": F.sum("o").over(Window.partitionBy(b))})
    # the sum over all cells of (o - e)^2 / e is the sum over filled cells of o^2 / e, less n
    total = n.agg(F.sum("o").alias("n"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    s = t.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s")).join(total, F.lit(True))
    return s.select((F.col("s") * F.col("n") - F.col("n")).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof")).withColumn("p", chi_square_p(F.col("chi2"), F.col("dof")))


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Adds odds_ratio (null without a divisor) and the two-sided p of each row's 2 x 2 table, by log-gamma sums."""
    @F.pandas_udf("double")
    def p(a_: pd.Series, b_: pd.Series, c_: pd.Series, d_: pd.Series) -> pd.Series:
        from math import exp, lgamma

        log = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
        out = []
        for w, x, y, z in zip(a_, b_, c_, d_):
            rows, column, n = w + x, w + y, w + x + y + z
            low, high = max(0, column - (y + z)), min(rows, column)
            logs = [log(rows, k) + log(n - rows, column - k) - log(n, column) for k in range(int(low), int(high) + 1)]
            own = logs[int(w - low)]
            out.append(min(1.0, sum(exp(v) for v in logs if v <= own + 1e-7)))
        return pd.Series(out)

    odds = F.try_divide((F.col(a) * F.col(d)).cast("double"), (F.col(b) * F.col(c)).cast("double"))
    return df.withColumns({"odds_ratio": odds, "p": p(F.col(a), F.col(b), F.col(c), F.col(d))})


def benjamini_hochberg(df: DataFrame, p: str, name: str = "p_adjusted") -> DataFrame:
    """Adds adjusted p values. Tests are some thousand, so one window holds them."""
    total = df.filter(F.col(p).isNotNull()).agg(F.count(F.lit(1)).alias("_m"))
    rank = F.row_number().over(Window.orderBy(F.col(p)))
    d = df.filter(F.col(p).isNotNull()).withColumn("_r", rank).join(total, F.lit(True))
    least = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, F.least(F.lit(1.0), least)).drop("_r", "_m")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, r, and the two-sided p of a slope other than 0."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r")).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def geometry_score(clashes: Column, rotamer_outliers: Column, favoured: Column) -> Column:
    """One number for a structure's geometry, on the scale of resolution, from clashes per 1000 atoms and percentages of residues.

    Fixed values: the published weights and offsets of the score (Chen et al. 2010).
    """
    part = lambda weight, c, free: weight * F.log1p(F.greatest(F.lit(0.0), c - free))
    return part(0.426, clashes, 0.0) + part(0.33, rotamer_outliers, 1.0) + part(0.25, 100 - favoured, 2.0) + 0.5


def silhouette(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """label, n, mean, by squared-free cosine distance: 1 - cosine.

    For cosine distance the mean distance of a row to a label is 1 less the dot product of the row with the label's mean unit vector, so
    labels' sums are enough and no pairs are formed. Rows alone in their label have 0.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, label, norm.alias("_n"), vector).filter("_n > 0")
    unit = unit.select(key, label, F.transform(vector, lambda x: x.cast("double") / F.col("_n")).alias("u"))
    sums = unit.select(label, F.posexplode("u").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x"))
    means = sums.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).join(unit.groupBy(label).agg(F.count(F.lit(1)).alias("m")), label)
    centres = means.select(F.col(label).alias("_l"), F.col("s.x").alias("c"), "m")
    dot = F.aggregate(F.zip_with("u", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.col(label) == F.col("_l")
    far = unit.join(centres, F.lit(True)).select(key, label, own.alias("own"), F.when(own, F.try_divide(F.col("m") - dot, F.col("m") - 1)).otherwise(1 - dot / F.col("m")).alias("d"))
    ab = far.groupBy(key, label).agg(F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.withColumn("s", s).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"))


def kabsch(a: Column, b: Column) -> Column:
    """rmsd and tm of two arrays of x, y, z structs of one length, by the optimal rotation; null for other lengths or under 3 places."""
    @F.pandas_udf("struct<rmsd: double, tm: double>")
    def fit(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for x, y in zip(p, q):
            if x is None or y is None or len(x) != len(y) or len(x) < 3:
                out.append((None, None))
                continue
            u, v = (np.array([[r["x"], r["y"], r["z"]] for r in s]) for s in (x, y))
            u, v = u - u.mean(axis=0), v - v.mean(axis=0)
            w, _, z = np.linalg.svd(u.T @ v)
            turn = w @ np.diag([1, 1, np.sign(np.linalg.det(w @ z))]) @ z
            far = ((u @ turn - v) ** 2).sum(axis=1)
            n = len(u)
            d0 = max(0.5, 1.24 * np.cbrt(n - 15) - 1.8)
            out.append((float(np.sqrt(far.mean())), float((1 / (1 + far / d0**2)).mean())))
        return pd.DataFrame(out, columns=["rmsd", "tm"], dtype=float)

    return fit(a, b)
