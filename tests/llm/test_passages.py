"""Passages that two documents share are cut whole."""

import random
import re

from loomwell.llm import chunk_dedup


def pairs(n, words, rng):
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    some = lambda k: " ".join(word() for _ in range(k))
    for _ in range(n):
        passage = some(words)
        yield passage, f"{some(25)} {passage} {some(25)}", f"{some(31)} {passage} {some(19)}"


def test_passages_go_whole(spark):
    found = list(pairs(300, 51, random.Random(3)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(x for _, *both in found for x in both)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunk_dedup.chunk_dedup(df).collect()}
    assert all(got[i]["n_removed"] == 0 for i in range(0, 600, 2))
    whole = sum(got[2 * i + 1]["n_removed"] >= len(p) for i, (p, _, _) in enumerate(found))
    print("cut whole", whole, "of", len(found))
    assert whole >= 0.98 * len(found)


def match(a, b, at):
    return {"a": a, "b": b, "f1": 0, "f2": 0, "at": at}


def test_extension_keeps_characters():
    t = "xé日本語テキスト".encode()
    edges = [{"place": 6, "after": False, "piece": "yê日".encode()}, {"place": 12, "after": True, "piece": "テキスト".encode()}]
    (a, b), = chunk_dedup.extended(t, [match(6, 9, 6), match(9, 12, 9)], edges)
    assert t[a:b].decode() == "日本語テキスト"
    assert list(chunk_dedup.extended(b"abcabcabcabc", [match(6, 9, 0)], [{"place": 9, "after": True, "piece": b"abcabcabc"}])) == [(6, 12)]


def brute(texts, least):
    return [x[:2] for x in brute_kept(texts, least)]


def brute_kept(texts, least):
    """Bytes, bytes removed, and what is left of each text. First-owner rule by dictionaries: matched chunks, extended against the whole text of the first owner, up to REACH bytes."""
    raw = [t.encode() for t in texts]
    ends = chunk_dedup.chunks(raw)
    first = {}
    for i, (t, e) in enumerate(zip(raw, ends)):
        for a, b in zip([0, *e], e):
            if b - a >= chunk_dedup.LEAST:
                first.setdefault(t[a:b], (i, a))
    out = []
    for i, (t, e) in enumerate(zip(raw, ends)):
        gone, runs = bytearray(len(t)), []
        for a, b in zip([0, *e], e):
            owner = first.get(t[a:b])
            if owner in (None, (i, a)):
                continue
            if runs and runs[-1][1] == a and runs[-1][2] == owner[0] and runs[-1][3] == owner[1] - (a - runs[-1][0]):
                runs[-1][1] = b
            else:
                runs.append([a, b, *owner])
        for a, b, source, at in runs:
            s, begin, end = raw[source], a, b
            while begin > max(0, a - chunk_dedup.REACH) and at - (a - begin) > 0 and t[begin - 1] == s[at - (a - begin) - 1]:
                begin -= 1
            while end < min(len(t), b + chunk_dedup.REACH) and at + end - a < len(s) and t[end] == s[at + end - a]:
                end += 1
            gone[begin:end] = b"x" * (end - begin)
        for m in re.finditer(rb"x+", bytes(gone)):
            if len(m[0]) < least:
                gone[m.start() : m.end()] = bytes(len(m[0]))
        out.append((len(t), sum(map(bool, gone)), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_first_owner_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    some = lambda k: " ".join(word() for _ in range(k))
    shared = [some(rng.randint(20, 90)) for _ in range(12)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.5 else some(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    got = sorted(tuple(r) for r in chunk_dedup.chunk_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed").collect())
    assert [r[1:] for r in got] == brute(texts, chunk_dedup.LEAST_RUN)
