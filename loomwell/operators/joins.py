"""Joins of the sample, cohort and accession pipelines. The optimizer picks the physical join; nothing is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Rows of a side that may be sent to all tasks.
BROADCAST_ROWS = 1_000_000


def joined_by(strategy: str, left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose physical form is chosen: `hash`, `merge` or `broadcast` of the right side, whose size is looked at first.

    A right side that is too large to be sent is merged instead. AQE still splits skewed partitions of merge joins.
    """
    if strategy == "broadcast" and right.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        strategy = "merge"
    return left.join(right.hint({"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}[strategy]), keys, how)


def lookup_by(df: DataFrame, dim: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Adds several values by several keys; of rows of dim with equal keys the first by its values is taken."""
    one = dim.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_v"))
    return df.join(one, keys, "left").select(*df.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: object = None) -> DataFrame:
    """Adds a value by key; rows without one get the default. dim is made unique by key first."""
    out = df.join(dim.groupBy(key).agg(F.min(value).alias(value)), key, "left")
    return out.withColumn(value, F.coalesce(value, F.lit(default))) if default is not None else out


def with_flag(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds whether the key is among the members, without multiplying rows."""
    m = members.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(m, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def any_key(df: DataFrame, targets: dict[str, DataFrame], row_id: str) -> DataFrame:
    """Rows of which some key is among its targets: a union of semi-joins, not a join by OR."""
    parts = [df.join(t.select(k).distinct(), k, "left_semi").select(*df.columns) for k, t in targets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_row(out, [row_id], [F.col(row_id)])


def no_key(df: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Rows of which no key is among those found."""
    for k, t in found.items():
        df = df.join(t.select(k).distinct(), k, "left_anti")
    return df


def fallback_chain(wanted: DataFrame, sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Each wanted key with its row of the first source that has it, and the source's name; keys without a row are left out."""
    out, rest = None, wanted.select(key).distinct()
    for name, s in sources:
        hit = rest.join(s, key).withColumn("source", F.lit(name))
        out = hit if out is None else out.unionByName(hit, allowMissingColumns=True)
        rest = rest.join(s.select(key).distinct(), key, "left_anti")
    return out


def compare_runs(a: DataFrame, b: DataFrame, key: str, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """Rows of both runs by key, each column once for each run."""
    left = a.select(key, *[F.col(c).alias(f"{c}_{names[0]}") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"{c}_{names[1]}") for c in columns])
    return left.join(right, key)


def identity_or(df: DataFrame, mapping: DataFrame, kind: str, same: str, source: str, target: str) -> DataFrame:
    """The source itself where its kind is `same`, else its target by the mapping; rows without one are left out."""
    m = df.join(mapping, source, "left").withColumn(target, F.when(F.col(kind) == same, F.col(source)).otherwise(F.col(target)))
    return m.filter(F.col(target).isNotNull())


def versionless(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """By the exact key, else by the key without its version."""
    exact = dim.groupBy(key).agg(F.min(value).alias("_exact"))
    bare = dim.groupBy(F.regexp_replace(key, r"\.\d+$", "").alias("_bare")).agg(F.min(value).alias("_loose"))
    out = df.withColumn("_bare", F.regexp_replace(key, r"\.\d+$", "")).join(exact, key, "left").join(bare, "_bare", "left")
    return out.withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "_bare")


def audited(wanted: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """key, status: found, missing or duplicate."""
    n = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return wanted.select(key).distinct().join(n, key, "left").select(key, F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("found").alias("status"))


def children(parents: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each parent with the ordered list of its rows; [] if it has none."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("children"))
    kind = lists.schema["children"].dataType.simpleString()
    return parents.join(lists, key, "left").withColumn("children", F.coalesce("children", F.array().cast(kind)))


def lineage(tree: DataFrame, node: str, parent: str, depth: int = 100) -> DataFrame:
    """node, ancestor, distance (0 for itself), by one join a level until no new row comes; a tree over `depth` deep, or a circle, is an error."""
    step = tree.select(F.col(node).alias("ancestor"), F.col(parent).alias("_up")).filter("_up is not null and _up <> ancestor")
    level = tree.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("distance"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(step, "ancestor").select("node", F.col("_up").alias("ancestor"), F.lit(d).alias("distance"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise ValueError(f"the tree is over {depth} levels deep, or runs in a circle")
    return out


def by_value(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The distinct values of `by` with a list of their rows; a list has 64 rows at most, so values of many rows have several. Null values are left out."""
    own = df.filter(" and ".join(f"`{c}` is not null" for c in by)).repartition(*by).sortWithinPartitions(*by)
    own = own.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 6))
    return own.groupBy(*by, "_part").agg(F.collect_list(F.struct(*df.columns)).alias(name)).drop("_part")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the half-open ranges they fall into, by equal buckets of `width` and then the exact test.

    Distinct values are joined, and their rows written out after that: equal values are tested once, and rows that repeat come side by
    side, so that they take little room in a file. The tasks are set by number, as Spark would merge small partitions of lists that write
    out many rows. Generated code keeps all rows that one row of its input gives: `coalesce`, which merges nothing here, ends the code of
    the join, so a task holds the rows of one pair of lists (4,096 at most), not those of a value with all its matches.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = by_value(points, [at], "_p").withColumn("_b", F.floor(F.col(at) / width)).repartition(n, "_b")
    r = by_value(ranges, [low, high], "_r").withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).repartition(n, "_b")
    pairs = p.join(r, "_b").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).select("_p", "_r").coalesce(n)
    return pairs.select(F.explode("_p").alias("_p"), "_r").select("_p", F.explode("_r").alias("_r")).select("_p.*", "_r.*")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it: one union and one window."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(f"struct<{', '.join(f'{v}: {right.schema[v].dataType.simpleString()}' for v in values)}>"))
    b = right.select(key, at, F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])
