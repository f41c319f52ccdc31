import gzip

import numpy as np
from pyspark.sql import functions as F

from loomwell.sources import records, sinks


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACDE" * 45), ("b", "")], "id string, s string")
    sinks.to_fasta(df, f"{tmp_path}/f", "id", "s")
    text = "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*")))
    assert max(map(len, text.splitlines())) == 80
    got = {r["id"]: r["sequence"] for r in records.fasta(spark, f"{tmp_path}/f").collect()}
    assert got == {"a": "ACDE" * 45, "b": ""}
    assert records.fasta_headers(spark, f"{tmp_path}/f").count() == 2


def test_gzip_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(">q1 some text\nAC\nDE\n>q2\nGG\n")
    got = [tuple(r) for r in records.fasta(spark, f"{tmp_path}/x.fa.gz").orderBy("id").collect()]
    assert got == [("q1", "q1 some text", "ACDE", 4), ("q2", "q2", "GG", 2)]


def test_ris_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("T one", ["A", "B"], "2020", "10.1/x"), ("T two", [], "1999", "10.1/y")], "t string, a array<string>, y string, d string")
    sinks.to_ris(df, f"{tmp_path}/r", sinks.ris_record(F.col("t"), F.col("a"), F.col("y"), F.col("d")))
    got = {r["doi"]: (r["title"], r["authors"], r["year"]) for r in records.ris(spark, f"{tmp_path}/r").collect()}
    assert got == {"10.1/x": ("T one", ["A", "B"], "2020"), "10.1/y": ("T two", [], "1999")}


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("h1\th2\n1\tx\n2\ty\n")
    assert [tuple(r) for r in records.strings_table(spark, f"{tmp_path}/t.tsv", ["a", "b"]).collect()] == [("1", "x"), ("2", "y")]
    (tmp_path / "c.tsv").write_text("# note\n1\t0.5\n")
    assert [tuple(r) for r in records.commented_table(spark, f"{tmp_path}/c.tsv", "a int, b double").collect()] == [(1, 0.5)]
    d = tmp_path / "many"
    d.mkdir()
    (d / "small.csv").write_text("a\n1\n")
    (d / "large.csv").write_text("a\n" + "2\n" * 80)
    assert {r["a"] for r in records.large_files(spark, str(d), "a int").collect()} == {2}


def test_hits(spark, tmp_path):
    line = " ".join(["t", "-", "9", "q", *["0"] * 13, "3", "7", "x"])
    (tmp_path / "d.txt").write_text(f"# c\n{line}\nshort line\n")
    assert [tuple(r) for r in records.domain_hits(spark, f"{tmp_path}/d.txt").collect()] == [("t", "q", 2, 7)]
    (tmp_path / "i.tsv").write_text("p\tm\t9\tPfam\tPF1\td\t5\t9\t0.1\nbad\n")
    hits, bad = records.scan_hits(spark, f"{tmp_path}/i.tsv")
    assert [tuple(r) for r in hits.collect()] == [("p", "Pfam", 4, 9)] and bad.count() == 1


CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM CA 2 1.0 2.0 3.0
ATOM N 2 9.0 9.0 9.0
ATOM CA 1 0.0 0.5 1.0
#
"""


def test_cells(spark):
    df = spark.createDataFrame([(CIF, '{"ptm": 0.75, "pae": [1', "<table><tr><td>a</td><th><b>c</b></th></tr></table>", '@article{k, title = {A b}, year = "2020",\n}')], "cif string, j string, h string, b string")
    r = df.select(records.alpha_carbons(F.col("cif")).alias("ca"), records.head_number(F.col("j"), "ptm").alias("ptm"), records.html_table(F.col("h")).alias("t"), records.bibtex_field(F.col("b"), "title").alias("title"), records.bibtex_field(F.col("b"), "doi").alias("doi")).first()
    assert [(p["x"], p["z"]) for p in r["ca"]] == [(0.0, 1.0), (1.0, 3.0)]
    assert r["ptm"] == 0.75 and r["t"] == [["a", "c"]] and r["title"] == "A b" and r["doi"] == "N/A"


def test_part_files_and_keys(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") % 2 == 0, F.lit("x")).alias("v"))
    sinks.to_part_files(df.coalesce(1), f"{tmp_path}/p", 10)
    files = sorted((tmp_path / "p").glob("part-*.gz"))
    assert len(files) == 3 and "\\N" in gzip.open(files[0], "rt").read()
    sinks.to_keyed_parquet(df.withColumn("k", F.col("id") % 3), f"{tmp_path}/k", "k")
    assert spark.read.parquet(f"{tmp_path}/k/k=1").count() == 8


def test_vectors(spark):
    got = records.vectors_to_table(spark, [3, 4], np.arange(6, dtype=np.float16).reshape(2, 3)).orderBy("id").collect()
    assert [list(r["embedding"]) for r in got] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]


def test_graph_text(spark):
    x = sinks.graph_xml(spark.createDataFrame([("a", "A & b")], "id string, l string"), spark.createDataFrame([("a", "a")], "s string, t string"))
    assert 'label="A &amp; b"' in x and 'source="a"' in x


def test_zipped_and_globbed_tables(spark, tmp_path):
    with gzip.open(tmp_path / "w.tsv.gz", "wt") as f:
        f.write("a\tb\tc\td\n1\t2\t3\t4\n")
    got = records.zipped_table(spark, f"{tmp_path}/w.tsv.gz", {0: "first", 2: "third"}, 4)
    assert got.columns == ["first", "third"] and sorted(tuple(r) for r in got.collect()) == [("1", "3"), ("a", "c")]
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text(f"x,y\n{k},{k * k}\n")
    assert sorted(tuple(r) for r in records.glob_union(spark, f"{tmp_path}/part*.csv", "x int, y int").collect()) == [(0, 0), (1, 1), (2, 4)]


def test_rows_by_keys(spark):
    t = spark.createDataFrame([(i, i * 2) for i in range(9)], "k int, v int")
    assert sorted(r["v"] for r in records.by_keys(t, spark.createDataFrame([(1,), (1,), (7,), (40,)], "k int"), "k").collect()) == [2, 14]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, None)], "i int, s string")
    sinks.to_csv(df, f"{tmp_path}/c", ";")
    sinks.to_csv(df, f"{tmp_path}/c", ";", append=True)
    got = spark.read.csv(f"{tmp_path}/c", header=True, sep=";", schema="i int, s string")
    assert sorted((r["i"], r["s"]) for r in got.fillna("", ["s"]).collect()) == [(1, "a;b"), (1, "a;b"), (2, ""), (2, "")]


def test_attributes(spark):
    r = spark.createDataFrame([('<a run="S2"/><b run="S1" x="9"/><a run="S2"/>',)], "x string").select(records.xml_values(F.col("x"), "run").alias("v")).first()
    assert r["v"] == ["S1", "S2"]


def test_upserts_come_in_batches(spark, tmp_path):
    folder = str(tmp_path)

    def send(rows):
        import json
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            json.dump(rows, f)

    sinks.upsert_batches(spark.range(10).coalesce(1), send, 4)
    import json

    sizes = sorted(len(json.loads(p.read_text())) for p in tmp_path.iterdir())
    assert sizes == [2, 4, 4]


def test_database_needs_an_address(spark, monkeypatch):
    import pytest

    monkeypatch.delenv("LOOMWELL_DB_URL", raising=False)
    with pytest.raises(KeyError, match="LOOMWELL_DB_URL"):
        records.jdbc_table(spark, "t")
