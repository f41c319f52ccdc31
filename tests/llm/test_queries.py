"""Every registered query of this package over its whole table of sf0.001, against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_dedup import brute_exact, brute_join, brute_links, brute_suffix
from test_models import brute_base, brute_nearest
from test_passages import brute as brute_passages
from test_tokens import library

from loomwell.llm import chunk_dedup, language, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in queries.documents(spark, SF).orderBy("doc_id").collect()]


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, rows):
    want = {d: x + [2] for (d, _), x in zip(rows, library([t or "" for _, t in rows]))}
    got, at, seen = run(spark, "op1_packing"), defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and len(ids) == r["length"] <= 1024 and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["piece"] == 0 or r["length"] == 1024 or len(want[r["doc_id"]]) <= 1024
        seen[r["doc_id"]] += r["length"]
    assert {d: len(x) for d, x in want.items()} == seen
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 1024 and len(at) <= -(-sum(map(len, want.values())) // 1024) + 1


def test_op2(spark, rows):
    want = [(d, *x) for (d, _), x in zip(rows, brute_suffix([t for _, t in rows]))]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op2_suffix_dedup")) == want


def test_op3(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for d, x in ((d, sp.encode(t or "")) for d, t in rows)]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op3_sentencepiece")) == want


def test_op4(spark, rows):
    want, start = [], 0
    for (d, _), x in zip(rows, library([t or "" for _, t in rows])):
        want.append((d, start, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())))
        start += len(x) + 1
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op4_token_shards")) == want


def test_op5(spark):
    t = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    t = [(i, v) for i, v in t if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, v = np.array([i for i, _ in t]), np.array([x for _, x in t], float)
    by = defaultdict(list)
    for r in sorted(run(spark, "op5_neighbours"), key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert sorted(by) == sorted(i for i in ids.tolist() if i % 100 == 0)
    hits = 0
    for q, found in by.items():
        at = int(np.flatnonzero(ids == q)[0])
        exact = dict(brute_nearest(v, ids, at, len(ids)))
        assert [x[2] for x in found] == list(range(1, 11)) and all(abs(exact[i] - s) < 1e-12 for i, s, _ in found)
        assert [x[:2] for x in found] == sorted((x[:2] for x in found), key=lambda x: (x[1], x[0]))
        hits += len({i for i, _ in brute_nearest(v, ids, at, 10)} & {x[0] for x in found})
    assert hits >= 0.9 * 10 * len(by)


def test_op6(spark, rows):
    docs = {r["doc_id"]: r for r in queries.documents(spark, SF).collect()}
    got = {r["doc_id"]: r for r in run(spark, "op6_language")}
    assert got.keys() == docs.keys() and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for d, r in got.items())
    known = {r["lang"] for r in docs.values() if r["lang"] is not None}
    for d, r in got.items():
        letters = any(map(str.isalpha, docs[d]["text"] or ""))
        assert (r["lang_pred"] in known) == letters and (r["lang_pred"] == "und") == (not letters)
    asked = [d for d, r in got.items() if r["held_out"] and docs[d]["lang"] is not None and r["lang_pred"] != "und"]
    assert sum(got[d]["lang_pred"] == docs[d]["lang"] for d in asked) >= 0.95 * len(asked) > 10
    assert language.FIT_DOCS == 1000


def test_op7(spark, rows):
    want = [(d, *x) for (d, _), x in zip(rows, brute_passages([t or "" for _, t in rows], chunk_dedup.LEAST_RUN))]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in run(spark, "op7_chunk_dedup")) == want


def test_op8(spark, rows):
    got = run(spark, "op8_shingle_join")
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute_join(rows)
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == brute_links(rows)


def test_op9(spark, rows):
    assert sorted((tuple(r) for r in run(spark, "op9_exact_dedup")), key=str) == brute_exact(rows)


def test_op10(spark, rows):
    got = run(spark, "op10_mixing")
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    bits = -sum(r["score"] for r in got if r["held_out"]) / np.log10(2) / sum(len((t or "").encode()) + 1 for d, t in rows if zlib.crc32(str(d).encode()) % 7 == 2)
    print("bits a byte, held out", bits)
    assert all(r["score"] < 0 for r in got) and bits < 3
