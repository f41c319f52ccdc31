"""Tokenizers, shards and packing against the libraries, and by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from loomwell.llm import byte_tokens, packing, pieces, token_shards
from loomwell.llm.chunk_table import ChunkTable
from loomwell.llm.id_table import IdTable
from loomwell.llm.queries import tokenizer
from loomwell.llm.scratch import shared_path

ODD = list("ab cd  \n\t\r\x0b\x0c\x85 　 ​ \x1c﻿é▁ß日本😀'sltd019.,!\x00ﬁ़<|>")


def odd_texts():
    rng = random.Random(1)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> a <|endoftext|>", "a<|endoftext|>b", "x <|endoftext|>", "<|endoftext", "|>", "endoftext|> <|", "a<|endoftext|><|endoftext|> \n b", "wort é über ’quote’ “x” ° 日本 語 😀 q\u00a0 r\u3000 s\u2028 t\x1c u\x85 v", "<s> </s> <unk>", " ", "▁", "a  ", "\n\n x"]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library(texts):
    c = pieces.PieceCoder(tokenizer("piece_bpe_32k.model"))
    assert c.by_chunk
    every = odd_texts() + [t or "" for t in texts]
    for t, (ids, back), want in zip(every, c.texts(every), c.sp.encode(every)):
        assert ids == ",".join(map(str, want)) and back == c.sp.decode(want), t


def test_byte_ids_equal_the_library(texts):
    every = odd_texts() + [t or "" for t in texts]
    c = byte_tokens.ByteCoder(tokenizer("byte_bpe_50k.json"))
    for t, raw, want in zip(every, c.texts(every), library(every)):
        assert np.frombuffer(raw, "<u4").tolist() == want, t


class Counted:
    """The library, with the number of strings it was given."""

    def __init__(self, library):
        self.library, self.strings = library, 0

    def encode_batch_fast(self, strings, **how):
        self.strings += len(strings)
        return self.library.encode_batch_fast(strings, **how)

    @property
    def model(self):
        return self.library.model


def test_plain_words_need_no_strings_in_the_library():
    rng = random.Random(3)
    plain, any_kind = "abcdeßÖéñяж12.,;*", "ab'é×÷Ωяſ12.,(ª日\x1c"
    texts = [" ".join("".join(rng.choices(plain, k=rng.randint(2, 6))) for _ in range(500)) + rng.choice([".", " ", "\n"]) for _ in range(40)]
    c = byte_tokens.ByteCoder(tokenizer("byte_bpe_50k.json"))
    c.library = Counted(c.library)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in c.texts(texts)] == library(texts)
    assert c.library.strings == 0  # 20,000 words; 16 went in a string before
    texts = ["".join(rng.choice(["", " ", " ", "\n", "\t", "\x0b", "  "]) + "".join(rng.choices(any_kind, k=rng.randint(1, 5))) for _ in range(500)) for _ in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.texts(texts)] == library(texts)


def test_byte_ids_when_the_table_is_cleared(texts):
    """Slots for few chunks, so that calls are many, slots taken and chunks met again or forgotten."""
    every = odd_texts() + [t or "" for t in texts] + [f" {i:b} {i} {i % 7}" for i in range(2000)]
    c = byte_tokens.ByteCoder(tokenizer("byte_bpe_50k.json"))
    c.table = IdTable(slots=256)
    for i in range(0, len(every), 700):
        for t, raw, want in zip(every[i:], c.texts(every[i : i + 700]), library(every[i : i + 700])):
            assert np.frombuffer(raw, "<u4").tolist() == want, t
        assert c.table.held <= 128 and len(np.flatnonzero(c.table.high)) == c.table.held


def test_table_bounds():
    t = ChunkTable(lambda x: [c.upper() for c in x], most=6, longest=3)
    for _ in range(3):
        assert t.lookup([["a", "bb"], ["cccc", "a"]]) == [["A", "BB"], ["CCCC", "A"]]
        assert t.lookup([[chr(100 + i) for i in range(9)]]) == [[chr(68 + i) for i in range(9)]]
    assert "cccc" not in t.held and len(t.held) <= 3 + 9


def test_encode_pieces(twice, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    out = pieces.encode_pieces(twice, tokenizer("piece_bpe_32k.model")).collect()
    assert len(out) == twice.count()
    texts = {r["doc_id"]: r["text"] or "" for r in twice.collect() if r["doc_id"] is not None}
    for r in out:
        if r["doc_id"] is not None:
            ids = sp.encode(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(nothing, tokenizer("piece_bpe_32k.model")).count() == 0


def test_shards_round_trip(spark, twice, nothing):
    folder = shared_path(spark, "test-shards")
    manifest = token_shards.write_shards(twice, tokenizer("byte_bpe_50k.json"), folder, 0)
    got = token_shards.read_shards(spark, manifest).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"] or "") for r in twice.collect()]
    ids = [x + [0] for x in library([t for _, t in rows])]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["n_tokens"] * 4 == len(r["ids"])
        start += r["n_tokens"]
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted((d or -1, x) for (d, _), x in zip(rows, ids))
    assert token_shards.shards_round_trip(nothing, tokenizer("byte_bpe_50k.json")).count() == 0
    files = [r["path"] for r in manifest.orderBy("shard").collect()]
    fs, at = token_shards.open_fs(files[-1])
    one = [r for r in got if r["doc_id"] == max(d for d, _ in rows if d is not None)]
    found = [token_shards.ShardReader(*token_shards.open_fs(p)).get(one[0]["doc_id"]) for p in files]
    assert [x.tolist() for f in found for x in f] == [np.frombuffer(one[0]["ids"], "<u4").tolist()]


def test_shard_lookup(tmp_path):
    fs, _ = token_shards.open_fs(str(tmp_path))
    rng = random.Random(2)
    keys = sorted([None, *rng.sample(range(-(10**12), 10**12), 3000), 7, 7], key=lambda k: (k is not None, k or 0))
    w = token_shards.ShardWriter(fs, f"{tmp_path}/x.sst", 2)
    want = {}
    for k in keys:
        ids = np.array([rng.randrange(60_000) for _ in range(rng.randrange(60))], "<u2")
        want.setdefault(k, []).append(ids.tolist())
        w.add(token_shards.key_of(k), ids.tobytes(), len(ids))
    assert w.close()["n_docs"] == len(keys)
    r = token_shards.ShardReader(fs, f"{tmp_path}/x.sst")
    assert len(r.blocks) > 1
    for k in rng.sample(list(want), 200) + [None, 7]:
        assert [x.tolist() for x in r.get(k)] == want[k]
    assert all(r.get(k) == [] for k in range(10**13, 10**13 + 50))
    assert [token_shards.id_of(k) for k, _ in r] == keys


def test_best_fit_and_crossover():
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    make = lambda order: packing.Packing(*packing.best_fit(order, lengths, 100), 100)
    a, b = make(sorted(range(400), key=lambda i: -lengths[i])), make(list(range(400)))
    for p in (a, b, packing.crossover(a, b, lengths, 100, rng), packing.evolve(lengths, 100, 1, [])[0]):
        assert sorted(i for x in p.bins for i in x) == list(range(400))
        assert [sum(lengths[i] for i in x) for x in p.bins] == p.fills and max(p.fills) <= 100
        assert packing.from_bytes(packing.to_bytes(p.bins, 400)) == [sorted(x) for x in p.bins]
    assert len(packing.evolve(lengths, 100, 1, [])[0].bins) <= len(a.bins)


@pytest.mark.parametrize("capacity", [1024, 50])
def test_packing(twice, capacity):
    rows = [(r["doc_id"], r["text"] or "") for r in twice.collect()]
    out = packing.pack_documents(twice, tokenizer("byte_bpe_50k.json"), 2, capacity, keep_ids=True).toPandas()
    ids = sorted((-1 if d is None else d, x + [2]) for (d, _), x in zip(rows, library([t for _, t in rows])))
    assert out["length"].sum() == sum(len(x) for _, x in ids)
    for r in out.itertuples():
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
    by_doc = {d: x for d, x in ids}
    for d, g in out[out["doc_id"].notna()].drop_duplicates(["doc_id", "piece"]).groupby("doc_id"):
        g = g.sort_values("piece")
        assert np.frombuffer(b"".join(g["ids"]), "<u4").tolist() == by_doc[int(d)]
        assert g["piece"].tolist() == list(range(len(g))) and g["start"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
        assert (g["length"].iloc[1:] == capacity).all()
    s = out.sort_values(["sequence_id", "offset"])
    assert (s["offset"] == s.groupby("sequence_id")["length"].cumsum() - s["length"]).all()
    fills = s.groupby("sequence_id")["length"].sum()
    assert fills.max() <= capacity and len(fills) <= -(-out["length"].sum() // capacity) * 1.25 + 1


def test_pack_nothing(nothing):
    assert packing.pack_documents(nothing, tokenizer("byte_bpe_50k.json")).count() == 0


def test_lengths_cover_extremes(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([10] * 5 + [1] * 7 + [9, 3])], "i int, length long")
    out = packing.pack(df, 10).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 10 and out["sequence_id"].nunique() == 7


@pytest.mark.parametrize("seed", range(4))
def test_evolution_beats_best_fit(seed):
    """Fewer bins than best fit in decreasing order, on lengths of three to five a bin and on lengths like those of texts."""
    rng = random.Random(seed)
    for lengths in ([rng.randint(200, 500) for _ in range(1500)], [min(1023, max(3, int(rng.lognormvariate(5.8, 0.8)))) for _ in range(6000)]):
        plain = len(packing.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, 1024)[0])
        first = packing.evolve(lengths, 1024, seed, [])
        best = packing.evolve(lengths, 1024, seed + 100, [x.bins for x in first])[0]
        assert -(-sum(lengths) // 1024) <= len(best.bins) < plain
        assert sorted(i for b in best.bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) == f <= 1024 for b, f in zip(best.bins, best.fills))


def test_crossover_keeps_every_item():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 120))]
        a, b = (packing.Packing(*packing.filled(list(range(len(lengths))), lengths, 64, rng), 64) for _ in range(2))
        child = packing.crossover(a, b, lengths, 64, rng)
        assert sorted(i for x in child.bins for i in x) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in x) == f <= 64 for x, f in zip(child.bins, child.fills))


def test_packing_of_several_shards(spark):
    rng = random.Random(7)
    lengths = [min(1024, max(1, int(rng.lognormvariate(5.8, 0.9)))) for _ in range(2 * packing.SHARD_ITEMS + 500)]
    out = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "id long, length long"), 1024).collect()
    assert sorted((r["id"], r["length"]) for r in out) == list(enumerate(lengths))
    at = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024 and len(at) < 1.01 * sum(lengths) / 1024
