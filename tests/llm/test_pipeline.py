"""The stages, one after another, on the smallest tables."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_dedup import brute_exact, brute_join
from test_passages import brute_kept
from test_tokens import library

from loomwell.llm import chunk_dedup, queries
from loomwell.llm.scratch import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.documents(spark, SF)
    before, columns = docs.count(), docs.columns
    ids = [{r[0] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "stage")
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() == len(ids[-1])
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[1]) >= 0.95 * before
    assert len(ids[2]) < len(ids[1]) and len(ids[3]) < len(ids[2]) and ids[4] == ids[3] == ids[5]


def test_run_against_brute_force(spark):
    """What language ID keeps, through brute-force versions of the stages after it, is what run() packs."""
    docs = queries.documents(spark, SF)
    rows = [(r["doc_id"], r["text"]) for r in corpus_pipeline.language_id(spark, docs, SF).orderBy("doc_id").collect()]
    keep = {i for i, _, _, kept, _ in brute_exact(rows) if kept}
    rows = [r for r in rows if r[0] in keep]
    keep = {i for i, _, c in brute_join(rows) if i == c}
    rows = [r for r in rows if r[0] in keep]
    kept = [x[2].decode() for x in brute_kept([t or "" for _, t in rows], chunk_dedup.LEAST_RUN)]
    want = {i: x + [2] for (i, _), x in zip(rows, library(kept))}
    got, places = defaultdict(list), defaultdict(int)
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places[r["sequence_id"]]
        places[r["sequence_id"]] += r["length"]
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert max(places.values()) <= 1024 and got.keys() == want.keys()
    for i, pieces in got.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(want[i][at : at + length], "<u4").tobytes())
            at += length
        assert at == len(want[i])


def test_awkward_documents(spark, twice):
    docs = twice.select("doc_id", "text", "lang", "source", "n_chars")
    for stages in (corpus_pipeline.STAGES, corpus_pipeline.STAGES[1:]):
        now = docs
        for _, stage in stages:
            now = saved(stage(spark, now, SF), "stage")
        assert now.count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(name):
    import __spark_entry__

    assert __spark_entry__.queries()[name] is queries.QUERIES[name]
