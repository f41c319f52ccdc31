"""Removal of repeated byte strings of a threshold length, by a depth-limited radix sort of suffixes.

Only the first `WIDTH` bytes of a suffix (its window) matter. Suffixes are dealt into ever smaller groups, and a group of one
is dropped at once:

1. A first pass deals them by the smallest hashed `GRAM`-byte string in their window (the minimizer). Equal windows have equal
   ones, and suffixes that follow each other share one occurrence of it, so a run of them is one row: some 1/76 of all suffixes,
   which is what can be shuffled at all. Runs equal as a whole (128 bits) are repeated in all their windows; a task looks for
   such runs among its own first and deals out one of each kind.
2. The windows of the other runs, one run of each kind, are ordered inside their group by most-significant-digit passes of
   `DIGIT` bytes down to the threshold (`equal_windows`). Groups left then are exactly the repeated windows, by their bytes.
3. Groups of over `HOT` runs are dealt anew first, by the 163 bytes around the minimizer that windows with it at about one
   distance share. What is crowded still is dealt by whole windows, by aggregation, with 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.columns import slices
from loomwell.llm.scratch import drop_saved, saved
from loomwell.llm.spans import KEYS, SLICE_BYTES, aligned, cut_spans, keyed

WIDTH, GRAM = 200, 50
#: Bytes of a digit, and ranges of a crowded minimizer's distance.
DIGIT, RANGES = 8, 4
#: Runs that a task compares before they are dealt out.
HELD = 400_000
#: Rows of one key that a task sorts at once.
HOT = 5_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Hashes that are mixed at once.
MIXED = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix, a part at a time, so that what is between the steps stays in the processor's cache."""
    out, spare = np.empty(len(x), np.uint64), np.empty(min(len(x), MIXED), np.uint64)
    for a in range(0, len(x), MIXED):
        own, to = x[a : a + MIXED], out[a : a + MIXED]
        high = spare[: len(own)]
        np.bitwise_xor(own, np.right_shift(own, np.uint64(30), out=high), out=to)
        to *= np.uint64(0xBF58476D1CE4E5B9)
        to ^= np.right_shift(to, np.uint64(27), out=high)
        to *= np.uint64(0x94D049BB133111EB)
        to ^= np.right_shift(to, np.uint64(31), out=high)
    return out


@lru_cache(4)
def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def room(n: int) -> int:
    return max(SLICE_BYTES * 2, 1 << n.bit_length())


class Rolling:
    """Hashes of any part of some bytes, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = powers(INVERSE, room(n + 1))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, room(n + 1))[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of each `width` in a row."""
    at, low, have = np.arange(len(values), dtype=np.int32), values, 1
    while have < width:
        step = min(have, width - have)
        left, right = low[:-step], low[step:]
        take = left <= right
        at, low = np.where(take, at[:-step], at[step:]), np.where(take, left, right)
        have += step
    return at


def runs(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each run of windows: index of its text, start, number of windows, minimizer, hash of the whole run."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    rolling = Rolling(data)
    grams = rolling.all(gram)
    at = sliding_argmin(grams, width - gram + 1)
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - width + 1, 0))  # of each window inside a text
    firsts = np.cumsum(np.maximum(sizes - width + 1, 0)) - np.maximum(sizes - width + 1, 0)
    window = np.arange(len(doc)) - firsts[doc] + begins[doc]
    at = at[window]
    new = np.ones(len(doc), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(doc)))
    start = window[head]
    return doc[head], start - begins[doc[head]], count, grams[at[head]], rolling.of(start, start + count + width - 1)


RUN = "key1 long, key2 int, start int, count int, k long, x long, whole boolean"
KINDS = pa.schema([("key1", pa.int64()), ("key2", pa.int32()), ("start", pa.int32()), ("count", pa.int32()), ("k", pa.int64()), ("x", pa.int64()), ("whole", pa.bool_()), ("first", pa.bool_())])


def run_table(docs: DataFrame) -> DataFrame:
    """The runs of all documents: RUN, and first. A task looks for equal ones among those it holds, marks these as whole, and one of each as first."""

    def marked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        k, x = (rows.column(c).to_numpy() for c in ("k", "x"))
        order = np.lexsort((x, k))
        k, x = k[order], x[order]
        fresh = np.append(True, (k[1:] != k[:-1]) | (x[1:] != x[:-1]))
        whole, first = np.empty(len(k), bool), np.empty(len(k), bool)
        whole[order], first[order] = ~(fresh & np.append(fresh[1:], True)), fresh
        return rows.append_column("whole", pa.array(whole)).append_column("first", pa.array(first)).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                doc, start, count, k, x = runs([t.encode() for t in some.column(2).to_pylist()])
                at = pa.array(doc)
                columns = [some.column(0).take(at), some.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(k.view(np.int64)), pa.array(x.view(np.int64))]
                held.append(pa.record_batch(columns, names=KINDS.names[:6]))
                size += len(doc)
                if size > HELD:
                    yield marked(held)
                    held, size = [], 0
        if size:
            yield marked(held)

    return docs.select(*KEYS, "t").mapInArrow(run, f"{RUN}, first boolean")


def sorted_groups(rows: DataFrame, fn, schema: str) -> DataFrame:
    """fn over tables that hold whole groups of k."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in aligned(batches, "k", 100_000):
            yield from fn(table)

    return rows.repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, schema)


def run_kinds(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs that are repeated as a whole, and one run of each kind where a minimizer has several kinds."""
    k, x = (table.column(c).to_numpy() for c in ("k", "x"))
    order = np.lexsort((x, k))
    k, x = k[order], x[order]
    new_k = np.append(True, k[1:] != k[:-1])
    new_x = new_k | np.append(True, x[1:] != x[:-1])
    kind = np.cumsum(new_x) - 1
    group = np.cumsum(new_k) - 1
    whole = np.bincount(kind)[kind] > 1
    open_ = new_x & (np.bincount(group, new_x)[group] > 1)
    keep = whole | open_
    out = table.drop_columns(["x", "whole"]).take(pa.array(order[keep])).combine_chunks()
    for b in out.append_column("whole", pa.array(whole[keep])).append_column("open", pa.array(open_[keep])).to_batches():
        yield b


def spans_of(flags: np.ndarray, run_of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, first and last place of each row of flagged windows in one run."""
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit, hit
    new = np.append(True, (hit[1:] != hit[:-1] + 1) | (run_of[hit[1:]] != run_of[hit[:-1]]))
    first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    return run_of[first], place[first], place[last]


def flatten(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the rows' parts, and of every window: where it begins there, its row, and its place in the document."""
    count, start = table.column("count").to_numpy().astype(np.int64), table.column("start").to_numpy().astype(np.int64)
    parts = table.column("part").to_pylist()
    sizes = np.array([len(p) for p in parts], np.int64)
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    return np.frombuffer(b"".join(parts) + bytes(DIGIT), np.uint8), (np.cumsum(sizes) - sizes)[row] + inside, row, start[row] + inside


def equal_windows(group: np.ndarray, data: np.ndarray, begin: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which windows are equal to another one of their group, by most-significant-digit passes over their bytes.

    A digit is `DIGIT` bytes. Each pass orders the members of every group by the next digit, parts the groups where it differs, and
    drops groups of one; what is left after the last digit is equal in all bytes. Groups that agree in a digit are not sorted.
    """
    digits = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, DIGIT)).view(">u8").ravel()
    alive = np.argsort(group, kind="stable")
    part = group[alive]
    for depth in range(0, width, DIGIT):
        fresh = np.append(True, part[1:] != part[:-1])
        single = fresh & np.append(fresh[1:], True)
        if single.any():
            alive, fresh = alive[~single], fresh[~single]
        if not len(alive):
            break
        digit = digits[begin[alive] + min(depth, width - DIGIT)].astype(np.uint64)
        part = np.cumsum(fresh)
        differs = np.append(False, digit[1:] != digit[:-1]) & ~fresh
        mixed = np.zeros(part[-1] + 1, bool)
        mixed[part[differs]] = True
        some = np.flatnonzero(mixed[part])
        if len(some):
            order = some[np.lexsort((digit[some], part[some]))]
            alive[some], digit[some] = alive[order], digit[order]
            part = np.cumsum(fresh | np.append(False, digit[1:] != digit[:-1]))
    fresh = np.append(True, part[1:] != part[:-1]) if len(alive) else np.empty(0, bool)
    out = np.zeros(len(group), bool)
    out[alive[~(fresh & np.append(fresh[1:], True))] if len(alive) else alive] = True
    return out


def repeated_windows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    data, begin, row, place = flatten(table)
    group = np.unique(table.column("k").to_numpy(), return_inverse=True)[1]
    run, first, last = spans_of(equal_windows(group[row], data, begin), row, place)
    at = pa.array(run)
    key1, key2 = (table.column(c).combine_chunks().take(at) for c in KEYS)
    yield pa.record_batch([key1, key2, pa.array(first.astype(np.int32)), pa.array((last + WIDTH).astype(np.int32))], names=[*KEYS, "a", "b"])


SPAN = "key1 long, key2 int, a int, b int"


PARTS = "key1 long, key2 int, start int, count int, k long, hot boolean, part binary"


def by_offset(count: int, k: int, part: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """A crowded run as up to `RANGES` shorter ones, by how far the minimizer is from a window's start: first window, windows, key, bytes.

    The key is the bytes around the minimizer that all windows of the range hold. Equal windows have the minimizer at one
    distance, so they are in one range and have one key.
    """
    rolling = Rolling(np.frombuffer(part, np.uint8))
    at = int(np.flatnonzero(rolling.all(GRAM)[: WIDTH - GRAM + 1].view(np.int64) == k)[0])
    step = -(-(WIDTH - GRAM + 1) // RANGES)
    for r in range(RANGES):
        near, far = r * step, min((r + 1) * step - 1, WIDTH - GRAM)
        low, high = max(near, at - count + 1), min(far, at)
        if low <= high:
            longer = mix(rolling.of(np.array([at - near]), np.array([at - far + WIDTH])) + np.uint64(r))
            yield at - high, high - low + 1, int(longer.view(np.int64)[0]), part[at - high : at - low + WIDTH]


def parts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of each wanted run; crowded ones (`hot`) by ranges, with their longer keys."""
    lists = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "count", "k", "hot")).alias("r"))
    lists = lists.select(*KEYS, *[F.col(f"r.{c}").alias(c) for c in ("start", "count", "k", "hot")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                key1, key2, _, t, *lists_ = (some.column(i) for i in range(some.num_columns))
                row, out = [], []
                for i in range(some.num_rows):
                    data = t[i].as_py().encode()
                    for s, n, k, hot in zip(*(x[i].as_py() for x in lists_)):
                        part = data[s : s + n + WIDTH - 1]
                        for x in by_offset(n, k, part) if hot else ((0, n, k, part),):
                            row.append(i), out.append((s + x[0], x[1], x[2], hot, x[3]))
                at = pa.array(row, pa.int32())
                if out:
                    rest = [pa.array(x, y) for x, y in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))]
                    yield pa.record_batch([key1.take(at), key2.take(at), *rest], names=[*KEYS, "start", "count", "k", "hot", "part"])

    return docs.join(lists, KEYS).mapInArrow(run, PARTS)


def window_spans(rows: DataFrame) -> DataFrame:
    """Repeated windows of parts whose longer key is crowded too: one row a window, grouped by aggregation, so none meet in one task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin, row, place = flatten(pa.Table.from_batches([batch]))
            hashes = Rolling(data).of(begin, begin + WIDTH)
            at = pa.array(row)
            yield pa.record_batch([*(batch.column(i).take(at) for i in (0, 1)), batch.column(4).take(at), pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64))], names=[*KEYS, "k", "a", "h"])

    each = rows.mapInArrow(windows, "key1 long, key2 int, k long, a int, h long")
    twice = each.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", "h")
    return each.join(twice, ["k", "h"]).select(*KEYS, "a", (F.col("a") + WIDTH).alias("b"))


def crowded_keys(rows: DataFrame, hot: int) -> DataFrame:
    return saved(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("k"), "crowded")


def suffix_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row of df.

    Each byte covered by a 200-byte string that starts at two places or more goes, in all of them. Null texts count as
    empty; texts under 200 bytes lose nothing. Rows that repeat an id and a text count as places of their own and lose the
    same bytes. Ids are long, or text that holds whole numbers; another id is
    an error, as Spark's cast has it.
    """
    docs = keyed(df, doc_id, text)
    table = saved(run_table(docs), "runs")
    firsts = table.filter("first").drop("first")
    crowded = crowded_keys(firsts, hot)
    some_hot = not crowded.isEmpty()
    usual = (firsts.join(crowded, "k", "left_anti") if some_hot else firsts).select(*firsts.columns)
    kinds = saved(sorted_groups(usual, run_kinds, "key1 long, key2 int, start int, count int, k long, whole boolean, open boolean"), "run-kinds")
    whole = table.filter("whole").unionByName(kinds.filter("whole"), allowMissingColumns=True).select(*KEYS, "start", "count")
    wanted = kinds.filter("open").select(*KEYS, "start", "count", "k", F.lit(False).alias("hot"))
    if some_hot:
        runs_ = firsts.join(crowded, "k", "left_semi")
        kinds_hot = saved(runs_.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEYS, "start", "count")).alias("one")), "hot-kinds")
        whole = whole.unionByName(runs_.join(kinds_hot.filter("n > 1").select("k", "x"), ["k", "x"]).select(*KEYS, "start", "count"))
        wanted = wanted.unionByName(kinds_hot.select("one.*", "k", F.lit(True).alias("hot")))
    opened = saved(parts(docs, wanted), "parts")
    groups, deep = opened, None
    if some_hot:
        # groups of one go at once, and groups that are crowded still are taken apart to single windows
        known = opened.filter("hot").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        known = saved(known.filter("n > 1"), "longer-keys")
        groups = opened.filter("not hot").unionByName(opened.filter("hot").join(known.filter(F.col("n") <= hot).select("k"), "k", "left_semi").select(*opened.columns))
        deep = opened.filter("hot").join(known.filter(F.col("n") > hot).select("k"), "k", "left_semi").select(*opened.columns)
    spans = whole.select(*KEYS, F.col("start").alias("a"), (F.col("start") + F.col("count") + WIDTH - 1).alias("b"))
    spans = spans.unionByName(sorted_groups(groups.drop("hot"), repeated_windows, SPAN))
    if deep:
        spans = spans.unionByName(window_spans(deep.select(*KEYS, "start", "count", "k", "part")))
    found = saved(spans, "spans")
    drop_saved(table, kinds, opened)
    return cut_spans(docs, found).withColumnRenamed("id", doc_id)
