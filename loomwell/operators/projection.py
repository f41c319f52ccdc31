"""Two-dimensional views and small hierarchies of vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a hierarchy at most; a larger input is an error, not a sample.
MOST = 500


def principal_axes(df: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    """key, x, y (and label): the first two principal components, in place of a neighbour embedding, which no seed makes repeatable.

    Each axis points to where its largest loading is positive. Null vectors take no part.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(d)
    signs = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in model.pc.toArray().T]
    p = model.transform(d).withColumn("_p", vector_to_array("_p"))
    return p.select(key, *([label] if label else []), *[(F.col("_p")[i] * signs[i]).alias(n) for i, n in enumerate(("x", "y"))])


def ward_merges(df: DataFrame, key: str, vector: str) -> DataFrame:
    """step, a, b, distance, size: merges of least growth in variance, in one task; clusters are numbered after the rows, by key."""
    def merge(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        f = f.sort_values(key)
        at = {i: (np.array(v, float), 1) for i, v in enumerate(f[vector])}
        out = []
        while len(at) > 1:
            names = sorted(at)
            best = min((np.sqrt(2 * at[a][1] * at[b][1] / (at[a][1] + at[b][1])) * np.linalg.norm(at[a][0] - at[b][0]), a, b) for i, a in enumerate(names) for b in names[i + 1 :])
            (x, m), (y, n) = at.pop(best[1]), at.pop(best[2])
            at[len(f) + len(out)] = ((m * x + n * y) / (m + n), m + n)
            out.append((len(out), best[1], best[2], float(best[0]), m + n))
        return pd.DataFrame(out, columns=["step", "a", "b", "distance", "size"])

    rows = df.filter(F.col(vector).isNotNull()).select(key, vector).withColumn("_all", F.lit(1))
    if rows.limit(MOST + 1).count() > MOST:
        raise ValueError(f"a hierarchy takes {MOST} rows")
    return rows.groupBy("_all").applyInPandas(lambda k, f: merge(k, f), "step int, a int, b int, distance double, size int")
