"""Queries over sequences take the whole text."""

from pyspark.sql import functions as F

from loomwell.functions import sequences as Q
from loomwell.plans import sequences


def test_no_prefix(spark, tmp_path):
    texts = [(1, "ACDEFGHIKL" * 25), (2, "A" * 250 + "D" * 40), (3, "A" * 250 + "K" * 40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in sequences.control_sequences(spark, str(tmp_path)).collect()}
    assert all(sorted(got[i]["shuffled"]) == sorted(t) and len(got[i]["fragment"]) == int(len(t) * 0.3) for i, t in texts)
    pi = {r["doc_id"]: r["pi"] for r in sequences.isoelectric_points(spark, str(tmp_path)).collect()}
    assert pi[2] < 4.5 and pi[3] > 9
    assert spark.createDataFrame(texts, "doc_id long, text string").select(F.max(F.length(Q.clean(F.col("text"))))).first()[0] == 290
