"""Record files as DataFrames: FASTA, RIS, BibTeX, tables with comments, hits, structures, JSON heads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings_table(spark: SparkSession, path: str, names: list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """All columns as text, named by place; rows of another width are dropped. The schema is given, so nothing is scanned twice."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, sep=sep, header=header, enforceSchema=True, mode="DROPMALFORMED")


def commented_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A table without a header whose lines with # are comments."""
    return spark.read.csv(path, schema=schema, sep=sep, header=False, comment="#")


def zipped_table(spark: SparkSession, path: str, places: dict[int, str], width: int, sep: str = "\t") -> DataFrame:
    """Some columns of a wide table by place. A gzip file is one split, so it is dealt out right after the scan."""
    schema = T.StructType([T.StructField(places.get(i, f"_{i}"), T.StringType()) for i in range(width)])
    df = spark.read.csv(path, schema=schema, sep=sep, header=False).select(*places.values())
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if path.endswith((".gz", ".zst")) else df


def large_files(spark: SparkSession, path: str, schema: str, least: int = 100) -> DataFrame:
    """A folder of CSV files, without those under so many bytes."""
    df = spark.read.csv(path, schema=schema, header=True)
    names = df.columns
    return df.select("*", "_metadata.file_size").filter(F.col("file_size") >= least).select(*names)


def glob_union(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    return spark.read.csv(pattern, schema=schema, header=True)


def jdbc_table(spark: SparkSession, table: str, prefix: str = "LOOMWELL_DB", **options: str) -> DataFrame:
    """A database table or query; address and credentials come from <prefix>_URL, _USER and _PASSWORD."""
    import os

    reader = spark.read.format("jdbc").option("url", os.environ[f"{prefix}_URL"]).option("dbtable", table)
    for key, name in (("user", "USER"), ("password", "PASSWORD")):
        if value := os.environ.get(f"{prefix}_{name}"):
            reader = reader.option(key, value)
    return reader.options(**options).load()


def by_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted: one semi-join instead of batches of lookups."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, sequence, length. Plain, gzip and zstd files by their ending; the sequence's lines are joined."""
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).filter("trim(r) <> ''")
    header = F.trim(F.regexp_extract("r", r"^([^\n]*)", 1))
    sequence = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s+", "")
    out = raw.select(F.regexp_extract(header, r"^(\S*)", 1).alias("id"), header.alias("description"), sequence.alias("sequence"))
    return out.withColumn("length", F.length("sequence"))


def fasta_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header lines only, without the sequences."""
    return spark.read.text(path).filter(F.col("value").startswith(">")).select(F.substring("value", 2, 1 << 30).alias("description"))


def tagged_records(lines: Column) -> Column:
    """Map from tag to values of one RIS record."""
    rows = F.filter(F.split(lines, "\r?\n"), lambda x: x.rlike(r"^[A-Z][A-Z0-9]  - "))
    pairs = F.transform(rows, lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), F.trim(F.substring(x, 7, 1 << 30)).alias("value")))
    tags = F.array_distinct(F.transform(pairs, lambda p: p["tag"]))
    return F.map_from_arrays(tags, F.transform(tags, lambda t: F.transform(F.filter(pairs, lambda p: p["tag"] == t), lambda p: p["value"])))


def ris(spark: SparkSession, path: str) -> DataFrame:
    """doi, title, authors (array), year, journal, abstract of each record."""
    raw = spark.read.text(path, lineSep="ER  -").filter(F.col("value").rlike(r"(?m)^[A-Z][A-Z0-9]  - "))
    t = raw.select(tagged_records(F.col("value")).alias("t"))
    one = lambda *tags: F.coalesce(*[F.get(F.try_element_at("t", F.lit(x)), F.lit(0)) for x in tags])
    return t.select(one("DO").alias("doi"), one("TI", "T1").alias("title"), F.coalesce(F.try_element_at("t", F.lit("AU")), F.array().cast("array<string>")).alias("authors"), F.substring(one("PY", "Y1"), 1, 4).alias("year"), one("JO", "T2", "JF").alias("journal"), one("AB").alias("abstract"))


def bibtex_field(c: Column, name: str, default: str = "N/A") -> Column:
    """The field's first value, in braces or quotes."""
    value = F.regexp_extract(c, rf'(?is)\b{name}\s*=\s*[{{"](.*?)[}}"]\s*(?:,|\n|$)', 1)
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def domain_hits(spark: SparkSession, path: str) -> DataFrame:
    """target, query, start, end (half-open) of a whitespace table whose 18th and 19th columns are places from 1."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(f.alias("f")).filter(F.size("f") >= 19)
    return rows.select(F.col("f")[0].alias("target"), F.col("f")[3].alias("query"), (F.col("f")[17].try_cast("long") - 1).alias("start"), F.col("f")[18].try_cast("long").alias("end"))


def scan_hits(spark: SparkSession, path: str, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """Hits (id, analysis, start half-open, end) of a tab table, and the lines of too few fields."""
    rows = spark.read.text(path).select("value", F.split("value", "\t").alias("f"))
    good = rows.filter(F.size("f") >= least)
    hits = good.select(F.col("f")[0].alias("id"), F.col("f")[3].alias("analysis"), (F.col("f")[6].try_cast("long") - 1).alias("start"), F.col("f")[7].try_cast("long").alias("end"))
    return hits, rows.filter(F.size("f") < least).select("value")


def alpha_carbons(c: Column) -> Column:
    """The CA atoms of an mmCIF text by residue number, as structs of x, y, z; columns are found by their names."""

    @F.pandas_udf("array<struct<x: double, y: double, z: double>>")
    def atoms(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            names, found = [], []
            for line in (text or "").splitlines():
                if line.startswith("_atom_site."):
                    names.append(line.split(".", 1)[1].strip())
                elif names and line.startswith(("ATOM", "HETATM")):
                    row = dict(zip(names, line.split()))
                    if row.get("label_atom_id", "").strip('"') == "CA":
                        found.append((int(row["label_seq_id"]), {k.lower()[-1]: float(row[k]) for k in ("Cartn_x", "Cartn_y", "Cartn_z")}))
                elif found and line.startswith("#"):
                    break
            out.append([p for _, p in sorted(found, key=lambda r: r[0])])
        return pd.Series(out, dtype=object)

    return atoms(c)


def head_number(c: Column, name: str, head: int = 4096) -> Column:
    """A number of a JSON text, from its first characters, else from all of it."""
    pattern = rf'"{name}"\s*:\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)'
    find = lambda x: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    return F.coalesce(find(F.substring(c, 1, head)), find(c)).try_cast("double")


def html_table(c: Column) -> Column:
    """Rows, as arrays of cells, of the first table of a page."""
    first = F.regexp_extract(c, r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(first, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))))


def xml_values(c: Column, attribute: str) -> Column:
    """Distinct values of an attribute, in order."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(rf'{attribute}="([^"]*)"'), 1)))


def vectors_to_table(spark: SparkSession, ids: list, matrix) -> DataFrame:
    """Two aligned arrays as one table of 32-bit vectors, joined once by place, never again."""
    import pyarrow as pa

    flat = matrix.astype("float32")
    column = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"id": ids, "embedding": column}))
