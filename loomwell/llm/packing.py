"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most `capacity` ids. Pieces are dealt evenly, by turns, into shards of at most
`SHARD_ITEMS`; full pieces are sequences of their own. Each shard is packed by a few islands, rows of a DataFrame that evolve on any
executor. A member of an island is a whole packing. Crossover injects well-filled bins of one parent into the
other, drops the bins that then hold an item twice, and best-fits the displaced items, longest first. An island's first members are one
best-fit packing and several that fill bin after bin with some chance. Between epochs the best
packing of every island migrates to the next one in a ring; the best over all islands is taken.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import byte_tokens
from loomwell.llm.columns import slices, text_or_empty
from loomwell.llm.scratch import saved
from loomwell.llm.workers import lean

#: Items that are packed together; also what a task of the packing holds at once.
SHARD_ITEMS = 8192
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 3, 2, 6, 16
#: Lengths that are tried for a place in a bin that is being filled.
TRIED = 24
#: A bin this full may be injected.
WELL_FILLED = 0.995

Bins = list[list[int]]


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: Bins | None = None, fills: list[int] | None = None) -> tuple[Bins, list[int]]:
    """Puts each item, in the given order, into the fullest bin that takes it, else into a new one. bins and their fills are added to."""
    bins, fills = [] if bins is None else bins, [] if fills is None else fills
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room for exactly r
    for b, fill in enumerate(fills):
        by_room[capacity - fill].append(b)
        rooms |= 1 << (capacity - fill)
    for i in order:
        n = lengths[i]
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
            bins[b].append(i)
            fills[b] += n
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            fills.append(n)
        by_room[r - n].append(b)
        rooms |= 1 << (r - n)
    return bins, fills


class ByLength:
    """Items that wait for a place, by length. present: bit n is set while an item of length n waits."""

    def __init__(self, items: list[int], lengths: list[int], capacity: int):
        self.lists: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present, self.lengths = 0, lengths
        for i in items:
            self.add(i)

    def add(self, i: int) -> None:
        self.lists[self.lengths[i]].append(i)
        self.present |= 1 << self.lengths[i]

    def take(self, n: int) -> int:
        i = self.lists[n].pop()
        if not self.lists[n]:
            self.present &= ~(1 << n)
        return i

    def largest(self, most: int) -> int:
        """The largest waiting length of at most `most`, or 0."""
        return max(0, (self.present & ((1 << most + 1) - 1)).bit_length() - 1)

    def rest(self) -> list[int]:
        """All items, longest first."""
        return [i for own in reversed(self.lists) for i in own]


def filled(items: list[int], lengths: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """Fills one bin after another: the longest item, then as long as there is room the one that best leaves room for another one.

    Of the longest that fit, some are tried, others are passed over by chance, so that each call gives another packing.
    """
    waiting, bins, fills = ByLength(items, lengths, capacity), [], []
    while waiting.present:
        n = waiting.largest(capacity)
        own, room = [waiting.take(n)], capacity - n
        while room and (fit := waiting.present & ((1 << room + 1) - 1)) > 1:
            best = (0, 0)
            if fit >> room & 1:
                best = (room, room)
            tried = 0
            while fit > 1 and tried < TRIED and best[0] < room:
                x = fit.bit_length() - 1
                fit ^= 1 << x
                if rng.random() < 0.3 and fit > 1:
                    continue
                tried += 1
                y = waiting.largest(room - x)
                if y == x and len(waiting.lists[x]) < 2:
                    y = 0
                best = max(best, (x + y, x))
            own.append(waiting.take(best[1]))
            room -= best[1]
        bins.append(own)
        fills.append(capacity - room)
    return bins, fills


class Packing:
    """A member of an island: its bins, how full they are, and its fitness (fewer bins first, then fuller ones; the smallest is best)."""

    def __init__(self, bins: Bins, fills: list[int], capacity: int):
        self.bins, self.fills = bins, fills
        self.fitness = len(bins), -sum(f * f for f in fills) / capacity**2


def crossover(a: Packing, b: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Injects whole well-filled bins of b into a, removes duplicates and best-fits the displaced items.

    Before that, bins that are not full give items back for longer waiting ones that fill them better. Displaced items go into the bins
    there are and new ones by best fit, longest first, or fill new ones first where that leaves fewer bins.
    """
    enough, share = WELL_FILLED * capacity, 0.2 + 0.6 * rng.random()
    bins, fills = [], []
    for x, f in zip(b.bins, b.fills):
        if f >= enough and rng.random() < share:
            bins.append(list(x))
            fills.append(f)
    inside = set().union(*bins)
    displaced: list[int] = []
    poor = 0.1 + 0.4 * rng.random()
    for x, f in zip(a.bins, a.fills):
        if not inside.isdisjoint(x):
            displaced += [i for i in x if i not in inside]
        elif f < enough and rng.random() < poor:
            displaced += x  # mutation: some poorly filled bins are taken apart too
        else:
            bins.append(list(x))
            fills.append(f)
    waiting = ByLength(displaced, lengths, capacity)
    for k, own in enumerate(bins):
        room = capacity - fills[k]
        for at in range(len(own) if room else 0):
            n = lengths[own[at]]
            longer = waiting.largest(n + room)
            if longer > n:
                i = waiting.take(longer)
                waiting.add(own[at])
                own[at] = i
                room -= longer - n
        fills[k] = capacity - room
    rest = waiting.rest()
    if rng.random() < 0.5:
        return Packing(*best_fit(rest, lengths, capacity, bins, fills), capacity)
    fresh, full = filled(rest, lengths, capacity, rng)
    return Packing(bins + fresh, fills + full, capacity)


def evolve(lengths: list[int], capacity: int, seed: int, given: list[Bins]) -> list[Packing]:
    """The population after one epoch, best first. Ends early at the lower bound of the number of bins."""
    rng, n = random.Random(seed), len(lengths)
    fitness = lambda x: x.fitness
    population = [Packing(x, [sum(lengths[i] for i in b) for b in x], capacity) for x in given]
    if len(population) < POPULATION:
        order = sorted(range(n), key=lambda i: -lengths[i])
        population.append(Packing(*best_fit(order, lengths, capacity), capacity))
    while len(population) < POPULATION:
        population.append(Packing(*filled(list(range(n)), lengths, capacity, rng), capacity))
    population.sort(key=fitness)
    least = -(-sum(lengths) // capacity)
    for _ in range(OFFSPRING):
        if len(population[0].bins) <= least:
            break
        a, b = rng.sample(population, 2)
        child = crossover(a, b, lengths, capacity, rng)
        if all(child.fitness != x.fitness for x in population):  # twins would make the parents alike
            population = sorted([*population, child], key=fitness)[:POPULATION]
    return population


def to_bytes(bins: Bins, n: int) -> bytes:
    """The bin of every item."""
    out = np.zeros(n, "<i4")
    for b, items in enumerate(bins):
        out[items] = b
    return out.tobytes()


def from_bytes(raw: bytes) -> Bins:
    of = np.frombuffer(raw, "<i4")
    bins: Bins = [[] for _ in range(of.max() + 1 if len(of) else 0)]
    for i, b in enumerate(of.tolist()):
        bins[b].append(i)
    return bins


def token_pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if kept, ids. The first piece of a long document may be shorter, all others are full."""
    name = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = byte_tokens.coder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for some in slices(batch, "t", byte_tokens.SLICE_BYTES):
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, raw in enumerate(coder.texts(some.column(1).to_pylist())):
                    raw += end
                    n, a, k = len(raw) // 4, 0, 0
                    b = n if n <= capacity else n % capacity or capacity
                    while a < n:
                        part = raw[4 * a : 4 * b]
                        at.append(row), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                        a, b, k = b, b + capacity, k + 1
                columns = [some.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.record_batch([*columns, pa.array(ids, pa.binary())] if keep_ids else columns, names=names)

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    rows = df.select(df[doc_id].alias("id"), text_or_empty(df, text).alias("t"))
    return rows.mapInArrow(lean(run, uses_kept=True), f"id {name}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids).withColumnRenamed("id", doc_id)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """All rows and columns of pieces (with a column `length` from 1 to capacity), and sequence_id and offset.

    Every row gets a place, repeated ones too. The rows of a sequence follow each other from offset 0 without gaps and are
    capacity ids at most. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = saved(pieces.drop("sequence_id", "offset", "shard", "pos"), "pieces")
    count = pieces.count()
    shards = max(1, -(-count // SHARD_ITEMS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, pos = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.record_batch([*b.columns, pa.array(np.full(n, shard, "i8")), pa.array(np.arange(pos, pos + n, dtype="i4"))], names=[*b.schema.names, "shard", "pos"])
            pos += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = saved(pieces.repartition(shards).mapInArrow(place, f"{fields}, shard long, pos int"), "placed")

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        return pd.DataFrame([(key[0], rows["length"].to_numpy("<u4").tobytes())], columns=["shard", "lengths"])

    lists = placed.filter(F.col("length") < capacity).select("shard", "pos", "length").groupBy("shard").applyInPandas(gather, "shard long, lengths binary")
    state = lists.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.array().cast("array<binary>").alias("members"))
    tasks = max(1, min(shards * ISLANDS, 4 * spark.sparkContext.defaultParallelism))
    for epoch in range(EPOCHS):

        def epoch_of(frames: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    lengths = np.frombuffer(r.lengths, "<u4").tolist()
                    found = evolve(lengths, capacity, (r.shard * ISLANDS + r.island) * EPOCHS + epoch, [from_bytes(x) for x in r.members])
                    yield pd.DataFrame([(r.shard, r.lengths, r.island, [to_bytes(x.bins, len(lengths)) for x in found], *found[0].fitness)], columns=["shard", "lengths", "island", "members", "bins", "fill"])

        evolved = saved(state.repartition(tasks).mapInPandas(epoch_of, "shard long, lengths binary, island int, members array<binary>, bins int, fill double"), "islands")
        elite = evolved.select("shard", F.expr(f"(island + 1) % {ISLANDS}").alias("island"), F.expr("members[0]").alias("elite"))
        state = evolved.join(elite, ["shard", "island"]).select("shard", "lengths", "island", F.expr(f"concat(slice(members, 1, {POPULATION - 1}), array(elite))").alias("members"))
    best = evolved.groupBy("shard").agg(F.min_by(F.expr("members[0]"), F.struct("bins", "fill", "island")).alias("best"))

    def settle(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        bins, short = np.empty(len(rows), "i8"), (rows["length"] < capacity).to_numpy()
        bins[short] = np.frombuffer(found["best"].iloc[0], "<i4") if len(found) else 0
        used = bins[short].max() + 1 if short.any() else 0
        bins[~short] = used + np.arange((~short).sum())
        rows["sequence_id"] = rows["shard"] * (1 << 32) + bins
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns=["shard", "pos"])

    return placed.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(settle, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with their place in sequences of at most capacity ids.

    Null and empty texts are the end id alone. Other columns are not read. Rows that repeat an id are packed one by one.
    """
    return pack(token_pieces(df, tokenizer_path, end_id, capacity, doc_id, text, keep_ids), capacity)
