"""Exact, substring and shingle dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.llm import chunk_dedup, shingle_join, suffix_dedup
from loomwell.llm.components import components
from loomwell.llm.exact_dedup import exact_dedup

BLANKS = re.compile(r"[\x20\x09-\x0D]")


def brute_exact(rows):
    norm = [BLANKS.sub("", t or "") for _, t in rows]
    best, size = {}, Counter(norm)
    for (i, t), n in zip(rows, norm):
        rank = (-len(t or ""), i is None, i or 0)
        if n not in best or rank < best[n][0]:
            best[n] = (rank, i)
    return sorted(((i, best[n][1], size[n], i == best[n][1], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm)), key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(twice, weak):
    rows = [(r["doc_id"], r["text"]) for r in twice.collect()]
    how = {"hashed": lambda c: (F.crc32(c.cast("binary")) % 3).cast("string").cast("binary")} if weak else {}
    got = exact_dedup(twice, **how)
    assert got.columns == [c for c in twice.columns if c != "kept"] + ["keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute_exact(rows)


def test_exact_clashing_names_and_extreme_ids(spark):
    rows = [(-(2**63), "a b", "x", "h"), (2**63 - 1, "ab", "y", "h"), (None, "a  b", "z", "h"), (0, None, "w", "h"), (-(2**63), "c", "x", "h"), (5, "c", "v", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dup_hash string, dup_text string").withColumns({c: F.lit(1) for c in ("row", "id", "n", "best", "texts")})
    got = exact_dedup(df)
    assert got.columns == [*df.columns, "keep_id", "group_size", "kept", "text_sha256"]
    found = {r["dup_hash"] + str(r["text"]): (r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()}
    assert found == {"xa b": (None, 3, False), "yab": (None, 3, False), "za  b": (None, 3, True), "wNone": (0, 1, True), "xc": (-(2**63), 2, True), "vc": (-(2**63), 2, False)}


def brute_suffix(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 5_000])
def test_suffix(twice, hot):
    rows = [(r["doc_id"], r["text"]) for r in twice.collect()]
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute_suffix([t for _, t in rows]))), key=str)
    got = suffix_dedup.suffix_dedup(twice, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_suffix_random_edges(spark):
    rng = random.Random(8)
    for _ in range(3):
        pool = ["".join(rng.choices("ab", k=rng.randint(150, 420))) for _ in range(6)]
        texts = ["".join(p[rng.randrange(60) :][: rng.randint(100, 400)] for p in rng.choices(pool, k=3)) for _ in range(14)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(df).drop("kept").collect())
        assert [r[1:] for r in got] == brute_suffix(texts)


@pytest.mark.parametrize("hot", [3, 6, 30])
def test_suffix_crowded(spark, hot):
    """Passages of 60 to 400 bytes in many documents: runs that are dealt by longer keys, and by single windows."""
    rng = random.Random(hot)
    passages = ["".join(rng.choices("abcdefgh ", k=n)) for n in (60, 130, 180, 199, 200, 230, 400)]
    texts = []
    for _ in range(40):
        some = ["".join(rng.choices("abcdefgh ", k=rng.choice([3, 40, 160])))]
        for p in rng.sample(passages, 3):
            some += [p, "".join(rng.choices("xyz", k=rng.choice([1, 2, 30])))]
        texts.append("".join(some))
    texts += ["ab" * 300, "ab" * 150, "a" * 450]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(df, hot=hot).drop("kept").collect())
    assert [r[1:] for r in got] == brute_suffix(texts)


def test_windows_with_one_hash_are_told_apart():
    """Digits are compared, not hashes: windows that differ in the last byte alone, or in one digit, are not equal."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 200).astype(np.uint8)
    rows = [base.copy() for _ in range(12)]
    for i, at in enumerate([199, 0, 7, 8, 100, 192]):
        rows[i][at] = 200 + i % 2
    rows[6][199] = 200  # as row 0
    data = np.concatenate([*rows, np.zeros(8, np.uint8)])
    group = np.array([5] * 11 + [6])
    got = suffix_dedup.equal_windows(group, data, np.arange(12) * 200)
    assert got.tolist() == [True, False, False, False, False, False, True, True, True, True, True, False]


def test_argmin():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 6, 400).astype(np.uint64)
    assert suffix_dedup.sliding_argmin(v, 151).tolist() == [i + int(v[i : i + 151].argmin()) for i in range(250)]


def brute_join(rows, t=75):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(small))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
                of[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), name[find(i)] if name[find(i)] is not None else d) for i, (d, _) in enumerate(rows)), key=str)


def brute_links(rows, t=75):
    """id and number of other rows whose sets link, of each row."""
    small, sets = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(small))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= t * len(a | b):
                links[i] += 1
                links[j] += 1
    return sorted(((d, n) for (d, _), n in zip(rows, links)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.mark.parametrize("sets", [512, 5])
def test_link_numbers(spark, twice, monkeypatch, sets):
    """Each link counts, those inside a class too, where near copies of one text link with some of the others only."""
    monkeypatch.setattr(shingle_join, "CLASS_SETS", sets)
    rng, base = random.Random(7), [f"b{k}" for k in range(60)]
    rows = [(r["doc_id"], r["text"]) for r in twice.collect()]
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(60), rng.randint(0, 3)):
            w[at] = f"e{i}x{at}"
        rows.append((10_000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["n_links"]) for r in shingle_join.with_links(df).collect()), key=key) == sorted(brute_links(rows), key=key)


def test_shingle_join(twice):
    rows = [(r["doc_id"], r["text"]) for r in twice.collect()]
    out, links = shingle_join.shingle_join(twice)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute_join(rows)
    assert links.count() > 0


def test_shingle_join_crowded(spark, monkeypatch):
    """One passage in all documents, and groups of near copies around it."""
    rng = random.Random(3)
    line = " ".join(f"common{i}" for i in range(12))
    texts = []
    for g in range(40):
        base = [f"g{g}w{rng.randrange(99)}" for _ in range(40)]
        for _ in range(3):
            w = list(base)
            w[rng.randrange(40)] = f"e{rng.randrange(10**6)}"
            texts.append(line + " " + " ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = shingle_join.shingle_join(df)[0].select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(list(enumerate(texts)))


@pytest.mark.parametrize("block", [4096, 7])
def test_shingle_join_without_links(spark, monkeypatch, block):
    """Texts of 24 common words and 8 to 10 of their own do not link, and make few pairs; near ones in long lists do."""
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(24))
    texts = [common + " " + " ".join(f"o{i}x{k}" for k in range(rng.randint(8, 10))) for i in range(150)]
    base = [f"b{k}" for k in range(60)]
    for i in range(90):  # from one base, with one to five edits: some pairs link and some do not
        w = list(base)
        for at in rng.sample(range(60), rng.randint(1, 5)):
            w[at] = f"e{i}x{at}"
        texts.append(" ".join(w))
    rows, made, whole = list(enumerate(texts)), [], shingle_join.verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(shingle_join, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingle_join.shingle_join(df)[0].select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(rows)
    assert max(made[1:], default=0) < 3 * len(texts)


def test_one_of_each_class(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(d for d, _, c in brute_join(rows) if d == c)
    got = shingle_join.one_of_each_class(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want


def test_sketch_bounds():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 900, 2)
        common = rng.integers(0, 2**63, rng.integers(0, min(n, m) + 1)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, k - len(common)).astype(np.uint64)])) for k in (n, m))
        assert shingle_join.Sketches([shingle_join.sketch(a), shingle_join.sketch(b)]).most_common(np.array([0]), np.array([1]), np.array([len(a)]), np.array([len(b)]))[0] >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    of = {}
    for a, b in edges:
        of.setdefault(a, {a}), of.setdefault(b, {b})
        s = of[a] | of[b]
        for x in s:
            of[x] = s
    assert got == {x: min(s) for x, s in of.items() if len(s) > 1}


def test_chunks_resist_insertions():
    rng = random.Random(4)
    data = bytes(rng.choices(range(97, 123), k=6000))
    moved = data[:1000] + b"INSERTED" + data[1000:]
    pieces = lambda d: [d[a:b] for a, b in zip([0, *chunk_dedup.chunks([d])[0]], chunk_dedup.chunks([d])[0])]
    a, b = pieces(data), pieces(moved)
    assert b"".join(a) == data and b"".join(b) == moved
    assert sum(x in set(b) for x in a) / len(a) > 0.9
    assert all(len(x) <= chunk_dedup.MOST + 3 for x in a)


def test_chunks_keep_characters():
    text = "日本語テキスト ß é 😀" * 80
    raw = text.encode()
    ends = chunk_dedup.chunks([b"", raw, b"short"])
    assert ends[0] == [] and ends[2] == [5]
    assert "".join(raw[a:b].decode() for a, b in zip([0, *ends[1]], ends[1])) == text


def test_chunk_dedup(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(55))
    clean = [" ".join(word() for _ in range(90)) for _ in range(30)]
    mixed = [" ".join(word() for _ in range(20)) + " " + passage + " " + " ".join(word() for _ in range(20)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(clean + mixed)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunk_dedup.chunk_dedup(df).collect()}
    assert all(got[i]["n_removed"] == 0 for i in range(30)) and got[30]["n_removed"] == 0
    assert all(got[i]["n_removed"] >= 96 for i in range(31, 42))
    whole = {r["doc_id"]: r["text"] for r in chunk_dedup.without_repeats(df).collect()}
    assert all(hashlib.sha256(whole[i].encode()).hexdigest() == got[i]["kept_sha256"] for i in whole)


def test_chunk_dedup_awkward(twice):
    got = chunk_dedup.chunk_dedup(twice)
    rows = got.collect()
    assert len(rows) == twice.count() and all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) for r in rows)
    assert chunk_dedup.without_repeats(twice).columns == twice.columns
    for r in rows:
        bytes(r["kept"]).decode()


def test_empty_tables(nothing):
    assert exact_dedup(nothing).count() == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    assert chunk_dedup.chunk_dedup(nothing).count() == 0 and chunk_dedup.without_repeats(nothing).columns == nothing.columns
    out, links = shingle_join.shingle_join(nothing)
    assert out.count() == 0 and links.count() == 0
