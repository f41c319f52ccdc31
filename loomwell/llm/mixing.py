"""Language-model scoring by logistic context mixing over bits.

Texts are bytes, in lower case, each with a zero byte as its end. Every bit of a byte is predicted by several contexts: the last one to four bytes,
and the current word so far. How often a 0 and a 1 followed each context and the bits of the byte already known is counted in all
training documents, in a table that grows with them (cases.py). The predictions are mixed in the logistic domain by weights that
are gated by the bit's place and the confidence of the longest contexts, learned on all training documents; then a second table maps
the mixed probability and the known bits to what was seen there. A text's score is the sum of its bits.

A byte's cost depends on its last four bytes and its word so far alone, so costs are computed once for each such
case. Those of the most frequent cases are sent to all tasks, the others are joined by the case's 64-bit hash.

The base score needs the count of every word; the most frequent ones are sent to all tasks, and
the others are joined by the word's 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.cases import COLUMNS, Cases, Model, case_costs, case_table, cases_of, keys_of, near_table, rounds
from loomwell.llm.columns import id_text_crc32, slices, text_or_empty
from loomwell.llm.scratch import drop_saved, forget, reread, saved, shared_path, shuffles_dropped
from loomwell.llm.shingle_join import word_bounds
from loomwell.llm.suffix_dedup import Rolling

#: Bytes of text that are worked on at once: few enough that all arrays of a slice stay in the processor's cache.
SLICE_BYTES = 1 << 16
PAD = 4
#: Families of counts: words, and cases.
WORDS, CASES = 0, 1
PASSES = 2
MOST_TOP = 500_000
#: Most frequent cases whose costs are sent to all tasks (others are joined), and cases and words that a task holds before it hands them on.
MOST_CASES, MOST_HELD = 1 << 21, 1_000_000
#: Slots of the tables of frequent cases, and words, and of the one before each, that holds the most frequent of them and stays in cache.
FRONT, FRONT_WORDS, NEAR = 1 << 22, 1 << 20, 1 << 15
#: Words that a task gathers before it counts them.
GATHERED = 1 << 18


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts in lower case, each between PAD zero bytes and its end; begins and ends (the end byte included) of each."""
    data = np.frombuffer(bytes(PAD) + bytes(PAD + 1).join(texts) + b"\0", np.uint8)
    data = data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)
    sizes = np.array([len(x) + PAD + 1 for x in texts], np.int64)
    ends = np.cumsum(sizes)
    return data, ends - sizes + PAD, ends


class Contexts:
    """Some texts laid out, and the hash of any part of them."""

    def __init__(self, texts: list[bytes]):
        self.data, self.begins, ends = lay_out(texts)
        self.sizes = ends - self.begins
        self.first = np.cumsum(self.sizes) - self.sizes
        self.scored = np.ones(len(self.data), bool)
        for k in range(1, PAD + 1):
            self.scored[self.begins - k] = False
        self.rolling = Rolling(self.data)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and its text."""
        starts, ends = word_bounds(np.where(self.data == 0, np.uint8(32), self.data)) if not self.zeros() else self._words_with_zeros()
        doc = np.searchsorted(self.begins, starts, side="right") - 1
        return self.rolling.of(starts, ends), doc

    def zeros(self) -> bool:
        return int((self.data == 0).sum()) != (PAD + 1) * len(self.sizes)

    def _words_with_zeros(self) -> tuple[np.ndarray, np.ndarray]:
        """As a zero byte inside a text is a character of a word, only the zeros around texts are taken for blanks."""
        inside = self.scored.copy()
        inside[self.begins + self.sizes - 1] = False
        return word_bounds(np.where(inside, np.where(self.data == 0, np.uint8(1), self.data), np.uint8(32)))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


class Counts:
    """Counts of words in one task."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.gathered: list[np.ndarray] = []
        self.size = self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.gathered.append(keys)
        self.waiting += len(keys)
        if self.waiting >= GATHERED:
            self.count()

    def count(self) -> None:
        keys, n = np.unique(np.concatenate(self.gathered), return_counts=True)
        self.keys.append(keys), self.counts.append(n)
        self.gathered, self.waiting = [], 0
        self.size += len(keys)
        if len(self.keys) >= 8:
            keys, n = summed(self.keys, self.counts)
            self.size, self.keys, self.counts = len(keys), [keys], [n]

    def rows(self, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Block, words (u64) and counts (u32); nothing is held after that."""
        if self.waiting:
            self.count()
        if self.keys:
            keys, n = summed(self.keys, self.counts)
            block = (keys >> np.uint64(32)).astype(np.int64) % ranges
            order = np.argsort(block, kind="stable")
            ids, at = np.unique(block[order], return_index=True)
            for i, own in zip(ids.tolist(), np.split(order, at[1:])):
                yield i, keys[own].tobytes(), n[own].astype(np.uint32).tobytes()
        self.__init__()


COUNTS = "family int, block long, " + ", ".join(f"{c} binary" for c in COLUMNS)


def count_table(rows: DataFrame, blocks: int, ranges: int) -> DataFrame:
    """Words of training documents, and cases of all documents with their number in training ones. rows: t, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cases = Counts(), Cases()

        def out() -> Iterator[pa.RecordBatch]:
            found = [(WORDS, i, b"", w, n) for i, w, n in words.rows(ranges)] + [(CASES, i, *c) for i, c in cases.rows(blocks)]
            if found:
                yield pa.record_batch([pa.array(x, y) for x, y in zip(zip(*found), (pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=names)

        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                c, training = Contexts(some.column(0).cast(pa.binary()).to_pylist()), ~np.array(some.column(1).to_pylist(), bool)
                h, doc = c.words()
                words.add(h[training[doc]])
                cases.add(c, training)
                if words.size + cases.size > MOST_HELD:
                    yield from out()
        yield from out()

    names = ["family", "block", *COLUMNS]
    return rows.select("t", "held_out").mapInArrow(run, COUNTS)


def word_counts(counts: DataFrame) -> DataFrame:
    """h, c: how often each word is in the training documents."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = summed([np.frombuffer(x, np.uint64) for x in rows["words"]], [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["counts"]])
        return pd.DataFrame({"h": keys.view(np.int64), "c": n})

    return saved(counts.filter(F.col("family") == WORDS).select("block", "words", "counts").groupBy("block").applyInPandas(add, "h long, c long"), "word-counts")


def most_frequent(words: DataFrame, most: int = MOST_TOP, value: str = "c") -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts (or another column) of at most so many rows of h and c: all from some power of two on, those of the highest power last."""
    power = F.floor(F.log2("c")).cast("byte").alias("p")
    powers = words.filter("c > 0").groupBy(power).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 0, 0
    for p, n in sorted(((r["p"], r["n"]) for r in powers), reverse=True):
        if total + n > most:
            least = p + 1
            break
        total += n
    top = words.filter(F.col("c") >= 1 << least).select("h", value, power).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top[value].to_numpy()
    order = np.lexsort((h, top["p"].to_numpy()))
    return h[order], c[order]


class Frequent:
    """Values of frequent keys, the more frequent last; most are found in tables with one slot a key, which each worker makes anew.

    The first table is small, and the most frequent keys have its slots. A key that lost its slot there to another has one in the
    next table, or the one after that, and those that lost all are searched for.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, slots: int, kind: type):
        self.keys, self.values, self.slots, self.kind, self.tables = keys, values, slots, kind, None

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where it is none of the frequent ones, and whether it is one."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        if self.tables is None:
            self.make()
        front, *others = self.tables
        out, there = self.look(keys, *front)
        rest = np.flatnonzero(~there)
        for table in others:
            found, hit = self.look(keys[rest], *table)
            out[rest], there[rest] = found, hit
            rest = rest[~hit]
        if len(self.lost):
            own = keys[rest]
            at = np.minimum(np.searchsorted(self.lost, own), len(self.lost) - 1)
            same = self.lost[at] == own
            out[rest[same]], there[rest[same]] = self.lost_values[at[same]], True
        return out, there

    def look(self, keys: np.ndarray, shift: int, front: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = self.spot(keys, shift, len(front))
        there = front[spot] == keys
        return values[spot].astype(np.float64) * there, there

    def make(self) -> None:
        left, values, self.tables = self.keys, self.values, []
        for shift, slots in ((4, min(NEAR, self.slots)), (20, self.slots), (42, self.slots // 2)):
            front, own = np.zeros(slots, np.uint64), np.zeros(slots)
            spot = self.spot(left, shift, slots)
            front[spot] = left
            held = front[spot] == left
            own[spot[held]] = values[held]
            self.tables.append((shift, front, own.astype(self.kind)))
            left, values = left[~held], values[~held]
        order = np.argsort(left)
        self.lost, self.lost_values = left[order], values[order]

    def spot(self, keys: np.ndarray, shift: int, slots: int) -> np.ndarray:
        return ((keys >> np.uint64(shift)) & np.uint64(slots - 1)).view(np.int64)

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values, "slots": self.slots, "kind": self.kind, "tables": None}


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of df.

    Held out are rows whose crc32 of the id as text is 2 modulo 7; nothing is learned from them. Null texts count as empty: they
    have the end token alone. A null id counts as the empty text. Without training documents all counts are 0 and the mixer is
    untrained. Rows that repeat an id count and are scored one by one.
    """
    spark = df.sparkSession
    rows = df.select(df[doc_id].alias("id"), text_or_empty(df, text).alias("t"), (id_text_crc32(df[doc_id]) % 7 == 2).alias("held_out"))
    train = rows.filter("not held_out")
    ends, size = train.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    ranges, blocks = max(32, (size or 0) // (16 << 20)), max(32, (size or 0) // (8 << 20))
    path = shared_path(spark, "context-counts")
    counted = count_table(rows, blocks, ranges)
    with shuffles_dropped(spark):
        counted.write.option("compression", "zstd").parquet(path)
    counts = reread(counted, path)
    words = word_counts(counts)
    cases = case_table(counts.filter(F.col("family") == CASES).select("block", *COLUMNS))
    model = Model(*near_table(cases))
    forget(spark, path)
    rounds(cases, model, PASSES)
    costs = case_costs(cases, model)
    drop_saved(cases)
    known = words.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    total, distinct = (known["n"] or 0) + ends, known["v"] + (ends > 0)
    unit, end_log = math.log10(total + distinct + 1), math.log10(ends + 1)
    top, top_counts = most_frequent(words)
    often, bits = most_frequent(costs, MOST_CASES, "cost")
    sent = spark.sparkContext.broadcast((Frequent(often, bits, FRONT, np.float32), Frequent(top, np.log10(top_counts + 1.0), FRONT_WORDS, np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frequent, tops = sent.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                n = some.num_rows
                c = Contexts(some.column(1).cast(pa.binary()).to_pylist())
                key = keys_of(*cases_of(c))
                cost, there = frequent.of(key)
                score = -np.add.reduceat(cost, c.first) * math.log10(2)
                seldom = np.flatnonzero(~there)
                breaks = np.searchsorted(seldom, c.first[1:])
                h, doc = c.words()
                logs, hit = tops.of(h)
                base = np.bincount(doc[hit], logs[hit], n)
                there = np.bincount(doc[hit], minlength=n)
                rare, of = h[~hit], doc[~hit]
                split = np.searchsorted(of, np.arange(1, n))
                columns = [some.column(0), some.column(2), pa.array(np.arange(uid, uid + n)), pa.array(np.bincount(doc, minlength=n) + 1), pa.array(there + int(ends > 0)), pa.array(base + end_log), pa.array(score)]
                lists = [pa.array([x.tobytes() for x in np.split(*y)], pa.binary()) for y in ((rare, split), (key[seldom], breaks))]
                yield pa.record_batch([*columns, *lists], names=names)
                uid += n

    names = ["doc_id", "held_out", "uid", "n_tokens", "known", "logs", "score", "rare", "rare_cases"]
    kind = df.schema[doc_id].dataType.simpleString()
    scored = saved(rows.select("id", "t", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, uid long, n_tokens long, known long, logs double, score double, rare binary, rare_cases binary"), "scored")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in raw], np.int64)
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["uid", "h"])

    rare = scored.select("uid", "rare").mapInArrow(each, "uid long, h long").join(words, "h")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more_logs"), F.count(F.lit(1)).alias("more_known"))
    more = scored.select("uid", "rare_cases").filter(F.length("rare_cases") > 0).mapInArrow(each, "uid long, h long")
    more = more.join(costs.select("h", "cost"), "h").groupBy("uid").agg((F.sum("cost") * F.lit(-math.log10(2))).alias("more_score"))
    out = scored.drop("rare", "rare_cases").join(rare, "uid", "left").join(more, "uid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
