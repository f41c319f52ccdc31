"""Counts of all contexts of a corpus, and costs of bytes from them.

A case is all that a byte's cost depends on: its last four bytes, its word so far and the byte itself. The distinct cases of all
documents are a keyed table with their number in training documents. Nothing is capped: the table's blocks grow with the input.
A word so far of under three bytes is taken with the bytes before it up to three, so it tells the last three bytes as the order-4
context does; cases are dealt by these, and all that a block's contexts of order 3, 4 and of words were followed by is in the block.
So a block's paths (how often a context was seen in training, and how often the first 1 to 8 bits of the byte followed) are
counted from its cases whenever it is read, and the table holds cases alone. Orders 1 and 2 have at
most 2^24 pairs of a context and a byte, whatever the input, and are added up on the driver.

Weights are learned on every training document's bits, each weighed by its number, its own occurrence left out of the counts. Each
block is an online pass of Newton steps; after each round the blocks' weights are averaged by their curvature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.columns import order_of
from loomwell.llm.scratch import saved
from loomwell.llm.suffix_dedup import mix

CLIP, CONTEXTS, GATES, GRID = 8.0, 5, 8 * 16, 33
#: Cases whose bits make one online step, and the weight of the weights at hand in the first one.
STEP_CASES, PRIOR = 8192, 50.0
#: Of 0.1, 1.1 and so on.
LOGS = np.log(np.arange(1 << 15) + 0.1)
#: Slots of a task's table of cases met often, and how many others it gathers before it merges them.
FRONT, GATHERED = 1 << 20, 1 << 18
#: A word's value is the hash of the word so far, without its low 8 bits, and the byte there.
COLUMNS = {"codes": np.uint32, "words": np.uint64, "counts": np.uint32}
TABLE = "block long, codes binary, words binary, counts binary"


def keys_of(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One hash for each case, never 0."""
    keys = codes.astype(np.uint64)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    keys ^= words
    keys = mix(keys)
    keys |= np.uint64(1)
    return keys


def cases_of(contexts) -> tuple[np.ndarray, np.ndarray]:
    """The last four bytes, and the word so far with the byte, at each scored byte."""
    data, sums = contexts.data, contexts.rolling.sums
    n, scored = len(data), contexts.scored[4:]
    blank = (data == 0) | (data == 32) | ((data > 8) & (data < 14))
    places = np.arange(n)
    begin = np.maximum.accumulate(np.where(blank, places, 0))[3:-1] + 1  # where the word that a byte continues or ends begins
    np.minimum(begin, places[1:-3], out=begin)
    word = sums[4:n] - sums[begin]
    word *= contexts.rolling.inverse[begin]
    word += (places[4:] - begin).view(np.uint64)
    word = mix(word[scored])
    word &= ~np.uint64(255)
    word |= data[4:][scored]
    codes = np.ndarray(n - 4, ">u4", data, strides=(1,))[scored].astype(np.uint32)  # the nearest byte lowest
    return codes, word


def byte_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(255)).astype(np.uint8)


def merged_cases(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row a case, in order of their hashes: hashes, codes, words, and the counts added up."""
    keys, codes, words, n = (np.concatenate(x) for x in zip(*parts))
    order = order_of(keys)
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    at = order[head]
    return keys[head], codes[at], words[at], np.add.reduceat(n[order], head) if len(head) else n


class Cases:
    """Distinct cases in one task. Most are found in a table with one slot a hash, the others are merged by sorting."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.gathered: list[tuple[np.ndarray, ...]] = []
        self.met: list[np.ndarray] = []
        self.size = self.waiting = self.met_size = 0
        self.keys = None

    def add(self, contexts, in_training: np.ndarray) -> None:
        """in_training: for each text, whether its bytes count; the others' cases are held with the count 0."""
        if self.keys is None:
            self.keys, self.counts, self.codes, self.words = np.zeros(FRONT, np.uint64), np.zeros(FRONT, np.int64), np.zeros(FRONT, np.uint32), np.zeros(FRONT, np.uint64)
        (codes, words), n = cases_of(contexts), np.repeat(in_training, contexts.sizes)
        keys = keys_of(codes, words)
        spot = (keys >> np.uint64(44)).view(np.int64)
        there = self.keys[spot]
        hit = there == keys
        new = np.flatnonzero(there == 0)
        if len(new):
            # of several new cases of one slot the last one is held, in all arrays alike
            own = spot[new]
            self.keys[own], self.codes[own], self.words[own] = keys[new], codes[new], words[new]
            hit[new] = self.keys[own] == keys[new]
        self.met.append(spot[hit & n])
        self.met_size += len(self.met[-1])
        if self.met_size >= FRONT:
            self.count()
        rest = np.flatnonzero(~hit)
        self.gathered.append((keys[rest], codes[rest], words[rest], n[rest].astype(np.int64)))
        self.waiting += len(rest)
        if self.waiting >= GATHERED:
            self.merge()

    def count(self) -> None:
        """Adds up those met in the table."""
        if self.met:
            self.counts += np.bincount(np.concatenate(self.met), minlength=FRONT)
        self.met, self.met_size = [], 0

    def merge(self) -> None:
        if self.waiting:
            self.held.append(merged_cases(self.gathered))
            self.size += len(self.held[-1][0])
        self.gathered, self.waiting = [], 0
        if len(self.held) >= 8:
            self.held = [merged_cases(self.held)]
            self.size = len(self.held[0][0])

    def rows(self, blocks: int) -> Iterator[tuple[int, list[bytes]]]:
        """The cases by block of their last three bytes; nothing is held after that."""
        self.count()
        self.merge()
        if self.keys is not None:
            used = np.flatnonzero(self.keys)
            self.held.append((self.keys[used], self.codes[used], self.words[used], self.counts[used]))
        if self.held:
            yield from split(merged_cases(self.held)[1:], blocks)
        self.__init__()


def spread(x: np.ndarray, blocks: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % blocks


def split(columns: tuple[np.ndarray, ...], blocks: int) -> Iterator[tuple[int, list[bytes]]]:
    """Rows by block of their last three bytes, in order of their last four, each column's part as bytes."""
    block = spread(columns[0] & np.uint32(0xFFFFFF), blocks)
    order = order_of((block.astype(np.uint64) << np.uint64(32) | columns[0]) << np.uint64(32 - blocks.bit_length()))
    block = block[order]
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() if len(block) else []
    columns = [x[order] for x in columns]
    for a, b in zip(at, [*at[1:], len(order)]):
        yield int(block[a]), [np.ascontiguousarray(x[a:b]).astype(t).tobytes() for x, t in zip(columns, COLUMNS.values())]


def read(row) -> tuple[np.ndarray, ...]:
    codes, words, n = (np.frombuffer(getattr(row, c), t) for c, t in COLUMNS.items())
    return codes, words, n.astype(np.int64)


def path_counts(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each pair (a context, and the byte in the low 8 bits): how often its context was seen, and its first 1 to 8 bits followed."""
    order = np.argsort(pairs)
    found, n = pairs[order], n[order]
    out = np.empty((9, len(pairs)), np.float32)
    for k in range(9 if len(pairs) else 0):
        prefix = found >> np.uint64(8 - k)
        head = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        out[k, order] = np.repeat(np.add.reduceat(n, head), np.diff(np.append(head, len(n))))
    return out


def pairs_of(codes: np.ndarray, byte: np.ndarray, order: int) -> np.ndarray:
    return (codes.astype(np.uint64) & np.uint64((1 << 8 * order) - 1)) << np.uint64(8) | byte.astype(np.uint64)


def paths_of(codes: np.ndarray, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The paths of orders 3, 4 and the word of a whole block's cases."""
    return np.concatenate([*(path_counts(pairs_of(codes, byte_of(words), k), n) for k in (3, 4)), path_counts(words, n)])


def case_table(counted: DataFrame) -> DataFrame:
    """Every distinct case with its count, a row a block. counted: block and COLUMNS."""

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        merged = merged_cases([(keys_of(codes, words), codes, words, n) for codes, words, n in map(read, rows.itertuples())])
        return pd.DataFrame([(key[0], *c) for _, c in split(merged[1:], 1)], columns=["block", *COLUMNS])

    return saved(counted.groupBy("block").applyInPandas(whole, TABLE), "cases")


def near_table(cases: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """All pairs of two bytes and a next one, in order, and the paths of orders 1 and 2 of each."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for rows in batches:
            for codes, word, c in zip(rows["codes"], rows["words"], rows["counts"]):
                new = pairs_of(np.frombuffer(codes, np.uint32), byte_of(np.frombuffer(word, np.uint64)), 2)
                k, back = np.unique(np.concatenate([k, new]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, np.frombuffer(c, np.uint32)]), len(k)).astype(np.int64)
        if len(k):
            yield pd.DataFrame({"k": k.astype(np.int64), "n": n})

    found = cases.select("codes", "words", "counts").mapInPandas(add, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = found["k"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(k)
    k, n = k[order].astype(np.uint64), n[order]
    return k, [path_counts(k & np.uint64(0xFFFF), n).astype(np.float32), path_counts(k, n).astype(np.float32)]


def logs(counts: np.ndarray) -> np.ndarray:
    """The logarithm of each count, a whole number, and a tenth; rows of small counts are looked up."""
    out = np.empty(counts.shape)
    for own, c in zip(out, counts):
        if len(c) and c.max() < len(LOGS):
            LOGS.take(c.astype(np.int64), out=own, mode="clip")
        else:
            np.log(c + 0.1, out=own)
    return out


def steps(n: int) -> Iterator[slice]:
    return (slice(a, a + STEP_CASES) for a in range(0, n, STEP_CASES))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """The paths of the nearest contexts, the gated weights and the refinement."""

    pairs: np.ndarray
    near: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, CONTEXTS + 1), 0.35))
    refined: np.ndarray = field(default_factory=lambda: np.tile(squash(np.linspace(-CLIP, CLIP, GRID)), (256, 1)))

    def inputs(self, codes: np.ndarray, byte: np.ndarray, paths: np.ndarray, left_out: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """For each bit of the bytes: predictions with a constant (a row each), gate, known bits, bit. left_out: one occurrence is not counted."""
        at = np.searchsorted(self.pairs, pairs_of(codes, byte, 2))
        all_paths = [*(c.take(at, axis=1) for c in self.near), *paths.reshape(3, 9, -1)]

        def counted(k: int) -> np.ndarray:
            c = np.array([c[k] for c in all_paths], float)
            return np.maximum(c - 1, 0, out=c) if left_out else c

        same = counted(0)
        for k in range(8):
            bit, node = (byte >> np.uint8(7 - k) & np.uint8(1)).astype(np.int64), (1 << k) + (byte.astype(np.int64) >> (8 - k))
            seen, same = same, counted(k + 1)
            x = np.full((CONTEXTS + 1, len(byte)), 0.3)
            ratio = x[:CONTEXTS]
            np.subtract(logs(same), logs(seen - same), out=ratio)
            np.clip(ratio, -CLIP, CLIP, out=ratio)
            ratio *= 2.0 * bit - 1
            ratio *= seen > 0
            sure = [(c > 0).view(np.int8) + (c > 3) + (c > 40) for c in seen[3:]]
            yield x, k * 16 + sure[0].astype(np.int64) * 4 + sure[1], node, bit

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ji,ji->i", np.ascontiguousarray(self.weights.T).take(gate, axis=1), x)

    def learned(self, blocks: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """From the weights at hand an online pass over each block: the blocks' curvatures, added up, and these times the weights learned."""
        start, curves, pulls = self.weights, np.zeros((GATES, 6, 6)), np.zeros((GATES, 6))
        for codes, byte, n, paths in blocks:
            here = np.zeros((GATES, 6, 6))
            self.weights = start.copy()
            for s in steps(len(n)):
                slope = np.zeros((GATES, 6))
                for x, gate, _, bit in self.inputs(codes[s], byte[s], paths[:, s], True):
                    p = squash(self.mixed(x, gate))
                    error = bit - p
                    curve = n[s] * np.maximum(p * (1 - p), error * error)
                    order = np.argsort(gate.astype(np.uint8), kind="stable")
                    ends = np.cumsum(np.bincount(gate, minlength=GATES)).tolist()
                    x, pull, curve = x.take(order, axis=1), (n[s] * error)[order], curve[order]
                    for g in np.unique(gate).tolist():
                        own = slice(ends[g - 1] if g else 0, ends[g])
                        slope[g] += x[:, own] @ pull[own]
                        here[g] += (x[:, own] * curve[own]) @ x[:, own].T
                self.weights = self.weights + np.linalg.solve(here + PRIOR * np.eye(6), slope[..., None])[..., 0]
            curves += here
            pulls += np.einsum("gij,gj->gi", here, self.weights)
        self.weights = start
        return curves, pulls

    def averaged(self, curves: np.ndarray, pulls: np.ndarray) -> None:
        self.weights = np.linalg.solve(curves + PRIOR * np.eye(6), (pulls + PRIOR * self.weights)[..., None])[..., 0]

    def seen(self, blocks: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """How often each known bits and mixed probability were seen, and how often a 1 followed."""
        out = np.zeros((2, 256 * GRID))
        for codes, byte, n, paths in blocks:
            for s in steps(len(n)):
                for x, gate, node, bit in self.inputs(codes[s], byte[s], paths[:, s], True):
                    at = node * GRID + np.rint((np.clip(self.mixed(x, gate), -CLIP, CLIP) + CLIP) * 2).astype(np.int64)
                    out[0] += np.bincount(at, n[s], 256 * GRID)
                    out[1] += np.bincount(at, n[s] * bit, 256 * GRID)
        return out[0].reshape(256, GRID), out[1].reshape(256, GRID)

    def cost(self, codes: np.ndarray, byte: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """Bits of each case's byte."""
        out, refined = np.zeros(len(byte)), self.refined.ravel()
        for s in steps(len(byte)):
            for x, gate, node, bit in self.inputs(codes[s], byte[s], paths[:, s], False):
                mixed = self.mixed(x, gate)
                place = (np.clip(mixed, -CLIP, CLIP - 1e-6) + CLIP) * 2
                low = place.astype(np.int64)
                at, high = node * GRID + low, place - low
                own = (1 - high) * refined[at] + high * refined[at + 1]
                p = np.clip((squash(mixed) + own) / 2, 1e-7, 1 - 1e-7)
                out[s] -= np.log2(np.where(bit == 1, p, 1 - p))
        return out


def stored(rows: pd.DataFrame, trained: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """codes, bytes, counts and paths of each block; of trained cases alone, in the order of their keys' hashes."""
    for r in rows.itertuples():
        codes, words, n = read(r)
        keys, byte, paths = keys_of(codes, words), byte_of(words), paths_of(codes, words, n)
        if trained:
            which = np.flatnonzero(n > 0)
            which = which[order_of(keys[which])]
            yield codes[which], byte[which], n[which].astype(float), paths[:, which]
        else:
            yield keys, codes, byte, n, paths


def rounds(cases: DataFrame, model: Model, passes: int) -> None:
    """Learns weights in so many rounds, then the refinement, over all training cases."""
    spark, kept = cases.sparkSession, cases.select(*COLUMNS)
    for turn in range(passes + 1):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], sent=sent, turn=turn) -> Iterator[pd.DataFrame]:
            m, blocks = sent.value, (x for rows in batches for i in range(len(rows)) for x in stored(rows.iloc[i : i + 1], True))
            a, b = m.learned(blocks) if turn < passes else m.seen(blocks)
            yield pd.DataFrame([(a.tobytes(), b.tobytes())], columns=["a", "b"])

        shapes = ((GATES, 6, 6), (GATES, 6)) if turn < passes else ((256, GRID),) * 2
        sums = [np.zeros(s) for s in shapes]
        for r in kept.mapInPandas(run, "a binary, b binary").collect():
            for x, raw, s in zip(sums, (r.a, r.b), shapes):
                x += np.frombuffer(raw).reshape(s)
        if turn < passes:
            model.averaged(*sums)
        else:
            model.refined = (sums[1] + 20 * model.refined) / (sums[0] + 20)
        sent.unpersist()


def case_costs(cases: DataFrame, model: Model) -> DataFrame:
    """h, c, cost: each case's key, count in training and bits."""
    sent = cases.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for keys, codes, byte, n, paths in stored(rows, False):
                for a in range(0, len(keys), 1 << 16):
                    s = slice(a, a + (1 << 16))
                    yield pd.DataFrame({"h": keys[s].view(np.int64), "c": n[s], "cost": sent.value.cost(codes[s], byte[s], paths[:, s]).astype(np.float32)})

    return saved(cases.select(*COLUMNS).mapInPandas(run, "h long, c long, cost float"), "costs")
