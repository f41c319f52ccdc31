"""Writers. Spark's committer makes each of them whole or absent; a rerun overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, sep: str = ",", append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True, sep=sep)


def to_part_files(df: DataFrame, path: str, rows: int, null: str = "\\N") -> None:
    """Gzip part files of so many rows at most, with a null token."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).csv(path, sep="\t", compression="gzip", nullValue=null, emptyValue="")


def to_keyed_parquet(df: DataFrame, path: str, key: str) -> None:
    """One folder for each key; rows are dealt by key and a salt, so a large key has several files and a small one few."""
    salted = df.repartition(F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    salted.write.mode("overwrite").partitionBy(key).parquet(path)


def wrapped(c: Column, width: int = 80) -> Column:
    """Lines of so many characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / width).cast("int") - 1, F.lit(0)))
    return F.array_join(F.transform(starts, lambda i: F.substring(c, i * width + 1, F.lit(width))), "\n")


def to_fasta(df: DataFrame, path: str, header: str, sequence: str, width: int = 80) -> None:
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrapped(F.col(sequence), width)).alias("value")).write.mode("overwrite").text(path)


def ris_record(title: Column, authors: Column, year: Column, doi: Column) -> Column:
    lines = F.concat(F.array(F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), title)), F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)), F.array(F.concat(F.lit("PY  - "), year), F.concat(F.lit("DO  - "), doi), F.lit("ER  - ")))
    return F.array_join(lines, "\n")


def to_ris(df: DataFrame, path: str, record: Column, rows: int = 1000) -> None:
    """Files of so many records at most."""
    df.select(record.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows).text(path)


def graph_xml(nodes: DataFrame, edges: DataFrame) -> str:
    """A directed graph as GEXF text, put together on the driver: for graphs that a viewer can show (10,000 edges at most)."""
    from xml.sax.saxutils import quoteattr

    n, e = nodes.limit(10_001).collect(), edges.limit(10_001).collect()
    if max(len(n), len(e)) > 10_000:
        raise ValueError("too large for a viewer; write nodes and edges as Parquet")
    rows = [f"<node id={quoteattr(str(r[0]))} label={quoteattr(str(r[-1]))}/>" for r in n]
    links = [f'<edge id="{i}" source={quoteattr(str(r[0]))} target={quoteattr(str(r[1]))}/>' for i, r in enumerate(e)]
    return f'<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>{"".join(rows)}</nodes><edges>{"".join(links)}</edges></graph></gexf>'


def upsert_batches(df: DataFrame, send, size: int = 256) -> None:
    """Hands rows, in batches, to a function that writes to another store. It may be called again with the same rows, so it must upsert."""
    def each(rows) -> None:
        held = []
        for r in rows:
            held.append(r.asDict())
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(each)
