"""Context counts against brute force: nothing is capped, and every training document has part in counts and weights."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwell.llm import cases, mixing
from loomwell.llm.columns import order_of

rng = random.Random(11)
ROWS = [(i, " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(60))) for i in range(40)]
ROWS.append((1001, " ".join("".join(rng.choices("qrstuvwxyz", k=6)) for _ in range(4000))))  # 28 kB


def in_training(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame([(t, not in_training(i)) for i, t in ROWS], "t string, held_out boolean").repartition(3)
    counts = mixing.count_table(rows, 32, 32)
    return cases.case_table(counts.filter(f"family = {mixing.CASES}").select("block", *cases.COLUMNS))


def brute():
    """How often the last n bytes, or the word so far, were seen, and how often each next byte followed."""
    seen, pairs, all_cases = Counter(), Counter(), set()
    for i, t in ROWS:
        data = bytes(4) + t.encode() + b"\0"
        for at in range(4, len(data)):
            start = min(at - 3, max(data.rfind(b" ", 0, at), data.rfind(b"\0", 0, at)) + 1)
            contexts = [data[at - 3 : at], data[at - 4 : at], (b"word", data[start:at])]
            all_cases.add((data[at - 4 : at], data[start:at], data[at]))
            for c in contexts if in_training(i) else ():
                seen[c] += 1
                pairs[c, data[at]] += 1
    return seen, pairs, all_cases


def test_counts_are_whole(table):
    seen, pairs, all_cases = brute()
    got = [x for x in cases.stored(table.toPandas(), False)]
    assert sum(len(x[0]) for x in got) == len(all_cases)
    word_totals = Counter()
    for _, codes, byte, _, paths in got:
        p = paths.reshape(3, 9, -1)
        for j, (code, b) in enumerate(zip(codes.tolist(), byte.tolist())):
            last = code.to_bytes(4, "little")[::-1]
            for f, c in enumerate((last[1:], last)):
                assert (p[f, 0, j], p[f, 8, j]) == (seen[c], pairs[c, b])
            word_totals[float(p[2, 0, j])] += 1
    want = Counter(float(seen[b"word", w]) for _, w, _ in all_cases)
    assert word_totals == want


def test_all_training_bits_teach(spark, table):
    model = cases.Model(*cases.near_table(table))
    bits = 8 * sum(len(t) + 1 for i, t in ROWS if in_training(i))
    assert in_training(1001) and bits > 8 * 20_000
    seen, ones = model.seen(cases.stored(table.toPandas(), True))
    assert seen.sum() == bits and (ones <= seen).all()
    before = model.weights.copy()
    cases.rounds(table, model, 2)
    assert np.isfinite(model.weights).all() and not np.allclose(before, model.weights)


def test_rare_cases_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in mixing.score_texts(df).collect()}
    monkeypatch.setattr(mixing, "MOST_CASES", 20)
    joined = {r["doc_id"]: r["score"] for r in mixing.score_texts(df).collect()}
    assert whole.keys() == joined.keys() and all(abs(whole[i] - joined[i]) < 1e-6 * abs(whole[i]) for i in whole)


def test_scores_do_not_depend_on_tasks(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    few, many = ({r["doc_id"]: r["score"] for r in mixing.score_texts(df.repartition(n)).collect()} for n in (2, 300))
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-6 * abs(few[i]) for i in few)


def test_bytes_are_a_distribution(spark, table):
    """The 256 next bytes of a context sum to one, whatever was counted."""
    model = cases.Model(*cases.near_table(table))
    cases.rounds(table, model, 2)
    codes, byte, _, paths = next(cases.stored(table.toPandas(), True))
    for j in (0, 5, 77):
        mine = np.repeat(codes[j : j + 1], 256)
        every = np.arange(256, dtype=np.uint8)
        seen, total = np.zeros((3, 9, 256), np.float32), paths.reshape(3, 9, -1)[:, 0, j]
        same = np.flatnonzero(codes == codes[j])
        for f in range(3):  # the paths of all bytes after this context, from those of the cases there
            whole = np.zeros(256)
            for i in same:
                if f < 2 or paths.reshape(3, 9, -1)[2, 0, i] == total[2]:
                    whole[byte[i]] = paths.reshape(3, 9, -1)[f, 8, i]
            for k in range(9):
                sums = np.bincount(every >> (8 - k), whole)
                seen[f, k] = sums[every >> (8 - k)]
        pairs = np.searchsorted(model.pairs, cases.pairs_of(mine, every, 2))
        near = [np.zeros((9, 256), np.float32) for _ in range(2)]
        for f in range(2):
            got = {int(p): model.near[f][8, i] for i, p in enumerate(model.pairs)}
            whole = np.array([got.get(int(p), 0) for p in cases.pairs_of(mine, every, 2)], float)
            for k in range(9):
                sums = np.bincount(every >> (8 - k), whole)
                near[f][k] = sums[every >> (8 - k)]
        own = cases.Model(cases.pairs_of(mine, every, 2), near, model.weights, model.refined)
        assert abs((2.0 ** -own.cost(mine, every, seen.reshape(27, 256))).sum() - 1) < 1e-6
        assert len(pairs) == 256


def test_weights_help_on_held_out_texts(spark):
    """Bits a byte of held-out texts, against mixing with weights and refinement as they are at the start."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(300)], k=80))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t) + 1 for i, t in rows if not in_training(i))
    learned = -sum(r["score"] for r in mixing.score_texts(df).collect() if r["held_out"]) / np.log10(2) / size
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "rounds", lambda *_: None)
        fresh = -sum(r["score"] for r in mixing.score_texts(df).collect() if r["held_out"]) / np.log10(2) / size
    print("bits a byte", learned, "untrained", fresh)
    assert learned < fresh < 8 and learned < 2.5


def test_order_of():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64) & ~np.uint64(0xFFF) | rng.integers(0, 3, n).astype(np.uint64)
        keys = np.concatenate([keys, keys[: n // 2], keys[: n // 3] ^ np.uint64(1)])
        assert (keys[order_of(keys)] == np.sort(keys)).all()


def test_mixed_in_parts():
    """Hashes are those of the formula at every length, and little is held besides them."""
    import tracemalloc

    from loomwell.llm.suffix_dedup import MIXED, mix

    def one(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    for n in (0, 1, MIXED - 1, MIXED, MIXED + 1, 2 * MIXED + 3):
        x = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
        before = x.copy()
        assert mix(x).tolist() == [one(v) for v in before.tolist()] and (x == before).all()
    x = np.arange(1 << 20, dtype=np.uint64)
    tracemalloc.start()
    out = mix(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.2 * out.nbytes


def test_slices_stay_in_cache():
    """What is held besides a slice's texts is a few MB, however many texts a batch has."""
    import tracemalloc

    import pyarrow as pa

    from loomwell.llm.columns import slices

    batch = pa.record_batch([pa.array([t for _, t in ROWS[:-1]] * 100)], names=["t"])
    cases.cases_of(mixing.Contexts([b"tables of powers are made once"]))
    tracemalloc.start()
    for some in slices(batch, "t", mixing.SLICE_BYTES):
        cases.keys_of(*cases.cases_of(mixing.Contexts(some.column(0).cast(pa.binary()).to_pylist())))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 1 << 20 and most < 6 << 20


def test_split_and_logs():
    """Rows come by block and code, in the order they had; logarithms of looked-up and of other counts are the same."""
    rng = np.random.default_rng(4)
    for n, blocks in ((0, 32), (1, 32), (5000, 1), (5000, 32), (70_000, 6000)):
        codes = rng.choice(rng.integers(0, 2**32, 300, dtype=np.uint32), n)
        words, counts = rng.integers(0, 2**64, n, dtype=np.uint64), np.arange(n)
        block = cases.spread(codes & np.uint32(0xFFFFFF), blocks)
        want = np.lexsort((codes, block))
        got = list(cases.split((codes, words, counts), blocks))
        assert [i for i, _ in got] == np.unique(block).tolist()
        assert np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(x[2], np.uint32) for _, x in got)]).tolist() == counts[want].tolist()
    counts = np.array([[0, 1, len(cases.LOGS) - 1], [0, 3, len(cases.LOGS)], [7, 2**24, 2**40]], float)
    assert np.allclose(cases.logs(counts), np.log(counts + 0.1), rtol=1e-15)


def test_most_frequent_have_the_first_slots():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(1, 2**64, 200_000, dtype=np.uint64))
    rng.shuffle(keys)
    values = np.arange(len(keys)) / 8
    found = mixing.Frequent(keys, values, 1 << 17, np.float64)
    got, there = found.of(keys)
    assert there.all() and (got == values).all()
    _, front, _ = found.tables[0]
    assert len(front) == mixing.NEAR and np.isin(keys[-1000:], front).mean() > 0.9
    assert not found.of(keys ^ np.uint64(1))[1].any()
