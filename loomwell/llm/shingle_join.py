"""N-gram Jaccard join of whole texts, and its classes, with set-relation skipping.

A text's set is the hashes of its distinct five-word shingles. Equal sets are one node. Any global order of shingles and the
prefix rule (a set's first n - ceil(t n) + 1 shingles) finds all pairs; the order here is: the lowest hashes (`LOW` of all) before the
rest, and inside both the rarer ones first, by levels. Lists of one shingle are ordered by set size, so a
set skips all blocks of the list whose sizes or places in the prefix can't reach the threshold.

Answers are derived from similar sets: a first round joins each set with its neighbour in the lists of its smallest hashes only, and
the pairs that hold form classes. In the second round, over all prefixes, pairs inside one class are skipped, as
their class is known from the first set's answers; only pairs between classes are compared, on whole sets. So a
large group of near copies costs about its size, and no link between classes is lost.

`with_links` also gives each document's number of links. All links are inside a class then, so whole sets of a class are
compared with one another, block by block, and only their numbers leave a task: no list or sketch decides there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.columns import slices, text_or_empty
from loomwell.llm.components import components
from loomwell.llm.scratch import drop_saved, forget, reread, saved, shared_path, shuffles_dropped
from loomwell.llm.suffix_dedup import Rolling, mix
from loomwell.llm.workers import lean

WORDS = 5
SLICE_BYTES = 1 << 20
#: Share of the hash range of which shingles are kept and counted.
LOW = 0.35
LOW_END = np.uint64(int(LOW * 2**64))
#: Smallest hashes of a set whose lists are chained in the first round.
FIRST = 8
#: A shingle in so many sets is frequent. How frequent is sent to all tasks as a level for each of so many slots; two shingles of one
#: slot get the higher level, which changes the order of work alone.
HOT, SLOTS = 32, 1 << 23
#: Shingles that a task counts at once, about, and prefix entries that a task joins at once, about.
COUNTED, JOINED = 4_000_000, 250_000
#: Sets of a list that meet in one task; longer lists are dealt out as pairs of blocks.
BLOCK = 4096
#: Shingles, and sets, of a class that are a block when links are counted, and shingles that a task counts links of at once, about.
CLASS_ENTRIES, CLASS_SETS, CLASS_JOINED = 1 << 19, 512, 2_000_000
#: Cells of a matrix of sets and shingles.
CELLS = 1 << 22
#: Rounds in which lists of frequent shingles join neighbours only.
JOIN_ROUNDS = 2
#: Bits of the filter of document ids whose sets are made again for comparison (8 MB), and of a piece of it.
FILTER, PIECE = 1 << 26, 1 << 16


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than space and U+0009 to U+000D."""
    word = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, text by text, and where each text's begin (one more at the end)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    starts, ends = word_bounds(data)
    words = Rolling(data).of(starts, ends)
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    # a shingle at each word that has enough words after it in its text, or at the first word of a short text
    at = np.arange(len(words))
    have = np.minimum(count[doc], WORDS)
    left = first[doc] + count[doc] - at
    begin = np.flatnonzero(left >= have)
    h, n = np.zeros(len(begin), np.uint64), have[begin]
    for k in range(WORDS):
        part = words[np.minimum(begin + k, len(words) - 1)] if len(words) else words
        h = np.where(k < n, h * np.uint64(0xD6E8FEB86659FD93) + mix(part + np.uint64(k)), h)
    h = mix(h + n.astype(np.uint64))
    of = doc[begin]
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint16) if len(texts) < 1 << 16 else of[order], kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.append(np.searchsorted(of, np.arange(len(texts))), len(h))


def needed(n: np.ndarray, m: np.ndarray, t: int) -> np.ndarray:
    """Smallest intersection of sets of n and m with 100 * intersection >= t * union."""
    return -(-t * (n + m) // (100 + t))


def prefix(n: int, t: int) -> int:
    return n - -(-t * n // 100) + 1


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sketch(h: np.ndarray) -> bytes:
    """A bitmap of 8 to 16 bits for each hash: the bits that the hashes fall on."""
    bits = 1 << max(6, (8 * len(h) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


class Sketches:
    """Sketches of some sets, by size as matrices that also hold the folded ones of twice the size."""

    def __init__(self, raw: list[bytes]):
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.sizes).tolist():
            parts, at = [], np.full(len(raw), -1, np.int32)
            for fold in (1, 2):
                used = np.flatnonzero(self.sizes == fold * size)
                m = np.frombuffer(b"".join([raw[k] for k in used.tolist()]), np.uint64).reshape(-1, fold, size // 8)
                at[used] = sum(map(len, parts)) + np.arange(len(used))
                parts.append(np.bitwise_or.reduce(m, axis=1))
            self.by_size[size] = np.concatenate(parts), at

    def most_common(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """For each pair of places, of sets of n and m, the largest intersection that their sketches allow.

        Each bit that only one of two sketches has stands for a hash at least that the other set lacks. Sketches that differ in
        size by more than a half set no bound but the smaller set.
        """
        out = np.minimum(n, m)
        least = np.minimum(self.sizes[i], self.sizes[j])
        for size in np.unique(least).tolist():
            matrix, at = self.by_size[size]
            pairs = np.flatnonzero(least == size)
            pairs = pairs[(at[i[pairs]] >= 0) & (at[j[pairs]] >= 0)]
            for a in range(0, len(pairs), 20_000):
                some = pairs[a : a + 20_000]
                x, y = matrix[at[i[some]]], matrix[at[j[some]]]
                lacks = [np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64) for u, v in ((x, y), (y, x))]
                out[some] = np.minimum(n[some] - lacks[0], m[some] - lacks[1])
        return out


def set_table(df: DataFrame, doc_id: str, text: str, t: int) -> DataFrame:
    """doc_id, th (hash of the text), n, node (hash of the set; null if empty), low (the kept hashes, in order), sketch."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                h, at = shingle_sets(some.column(1).to_pylist())
                node, n, low, sketches = [], [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = h[a:b]
                    n.append(b - a)
                    node.append(node_of(xxhash.xxh3_128_digest(own.tobytes())) if b > a else None)
                    keep = int(np.searchsorted(own, LOW_END))
                    keep = keep if keep >= prefix(b - a, t) else b - a
                    low.append(own[:keep].tobytes())
                    sketches.append(sketch(own))
                columns = [some.column(0), some.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(low, pa.binary()), pa.array(sketches, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "th", "n", "node", "low", "sketch"])

    t_ = text_or_empty(df, text)
    rows = df.select(df[doc_id].alias("id"), t_.alias("t"), F.xxhash64(t_).alias("th"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, th long, n long, node long, low binary, sketch binary")


def distinct_nodes(batches: Iterator[pa.RecordBatch], more: str = "n") -> Iterator[tuple[int, int, np.ndarray, int]]:
    """node, n, kept hashes and another column of each node that this task meets, once."""
    seen: set[int] = set()
    for batch in batches:
        nodes, n, low, other = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "n", "low", more))
        for i, node in enumerate(nodes.to_pylist()):
            if node is not None and node not in seen:
                seen.add(node)
                yield node, n[i].as_py(), np.frombuffer(low[i].as_buffer(), np.uint64), other[i].as_py()


def entry_batch(token: list, node: list, n: list, pos: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(token).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (node, n, pos))], names=["token", "node", "n", "pos"])


ENTRY = "token long, node long, n long, pos long"
PAIR = "a long, b long"


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def first_round(sets: DataFrame, t: int) -> DataFrame:
    """Neighbours, by size, in the lists of each set's smallest hashes."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int]] = []
        for node, n, low, _ in distinct_nodes(batches):
            rows += [(x, node, n) for x in low[:FIRST].view(np.int64).tolist()]
            if len(rows) > 50_000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["token", "node", "n"])
                rows = []
        if rows:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["token", "node", "n"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row of the batch before
        for batch in batches:
            token, node, n = (batch.column(i).to_numpy() for i in range(3))
            if before is not None:
                token, node, n = (np.append(x, y) for x, y in zip(before, (token, node, n)))
            if not len(token):
                continue
            same = (token[1:] == token[:-1]) & (node[1:] != node[:-1]) & (100 * n[:-1] >= t * n[1:])
            before = token[-1:], node[-1:], n[-1:]
            if same.any():
                yield pair_batch(node[:-1][same], node[1:][same])

    rows = sets.select("node", "n", "low").mapInArrow(entries, "token long, node long, n long")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "token").sortWithinPartitions("token", "n", "node").mapInArrow(chain, PAIR).distinct()


def levels_of(sets: DataFrame, kept: int) -> tuple[np.ndarray, np.uint64]:
    """How frequent the kept shingles are, as a level for each slot (0: in fewer than HOT sets), and which bits of a hash name the slot.

    All kept shingles of all sets are counted. The levels have one size whatever the input, and order the work only; pairs are the same.
    """
    bits = max(6, int(np.ceil(np.log2(max(1, kept) / COUNTED))) + 1)
    shift = np.uint64(32 - bits)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) >> shift
            bucket = keys >> np.uint64(32)
            ids, at = np.unique(bucket, return_index=True)
            blobs = [x.astype(np.uint32).tobytes() for x in np.split(keys, at[1:])]
            return pa.record_batch([pa.array(ids.astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "keys"])

        for _, _, low, _ in distinct_nodes(batches):
            held.append(low)
            size += len(low)
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows["keys"]]), return_counts=True)
        keys, n = keys[n >= HOT], n[n >= HOT]
        level = np.log2(n // HOT).astype(np.int32) + 1
        slot = keys.astype(np.int64) % SLOTS
        order = np.lexsort((-level, slot))
        first = order[np.append(True, np.diff(slot[order]) > 0)] if len(order) else order
        return pd.DataFrame({"slot": slot[first], "level": level[first]})

    def dense(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(PIECE, np.uint8)
        own[rows["slot"].to_numpy() % PIECE] = rows["level"].to_numpy()
        return pd.DataFrame([(key[0], own.tobytes())], columns=["piece", "levels"])

    counts = sets.select("node", "n", "low").mapInArrow(split, "bucket long, keys binary").groupBy("bucket").applyInPandas(count, "slot long, level int")
    pieces = counts.groupBy("slot").agg(F.max("level").alias("level")).withColumn("piece", F.floor(F.col("slot") / PIECE))
    levels = np.zeros(SLOTS, np.uint8)
    for r in saved(pieces.groupBy("piece").applyInPandas(dense, "piece long, levels binary"), "levels").toLocalIterator():
        levels[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["levels"], np.uint8)
    return levels, shift


def in_order(low: np.ndarray, levels: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes in the global order, and which of them are frequent."""
    level = levels[((low >> shift) & np.uint64(SLOTS - 1)).astype(np.int64)]
    order = np.argsort((low >= LOW_END) * 64 + level.astype(np.int64), kind="stable")
    return low[order], level[order] > 0


def list_pairs(token: np.ndarray, n: np.ndarray, pos: np.ndarray, group: np.ndarray, t: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one list that can reach the threshold. Rows in order of token, n; pairs of one group are skipped.

    A pair that holds is found in the list of its first common shingle, and has no more in common than what follows there
    in both; pairs whose places leave too little are skipped. side: of two blocks of a list that meet, pairs of one block are skipped.
    """
    new = np.append(True, token[1:] != token[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(token)))
    end = np.repeat(begin + size, size)
    # the list is in order of size: the block of partners that are not too large follows the row itself
    i, step = np.arange(len(token)), 0
    while len(i):
        step += 1
        i = i[i + step < end[i]]
        i = i[t * n[i + step] <= 100 * n[i]]
        j = i + step
        good = (group[i] != group[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j], t))
        if side is not None:
            good &= (side[i] != side[j]) | (side[i] < 0)
        if good.any():
            yield i[good], j[good]


class Prefixes:
    """The sets' prefixes in the global order, as lists of rare and of frequent shingles."""

    def __init__(self, sets: DataFrame, t: int, kept: int, entries: int):
        self.sets, self.t, self.buckets = sets.select("node", "n", "low"), t, max(32, -(-entries // (4 * JOINED)))
        levels, self.shift = levels_of(sets, kept)
        self.any_often = bool(levels.any())
        self.sent = sets.sparkSession.sparkContext.broadcast(levels)
        self.often = self.long = None
        if self.any_often:
            self.often = saved(self.sets.mapInArrow(self.entries(True), ENTRY).distinct(), "frequent-lists")
            lists = self.often.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > BLOCK)
            self.long = saved(lists.select("token", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")), "long-lists")

    def drop(self) -> None:
        """Gives up what was sent and saved; no pairs can be made after that."""
        self.sent.destroy()
        drop_saved(*(x for x in (self.often, self.long) if x))

    def entries(self, often_too: bool):
        sent, shift, t, buckets = self.sent, self.shift, self.t, self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            token, node, n, pos, group, size = [], [], [], [], [], 0
            for one, count, low, own in distinct_nodes(batches, "n" if often_too else "class"):
                ordered, often = in_order(low, sent.value, shift)
                p = prefix(count, t)
                take = np.flatnonzero(often[:p] == often_too)
                if not len(take):
                    continue
                token.append(ordered[take]), pos.append(take.astype(np.int64))
                node.append(np.full(len(take), one, np.int64)), n.append(np.full(len(take), count, np.int64)), group.append(np.full(len(take), own, np.int64))
                size += len(take)
                if size > 500_000:
                    yield from pack(token, node, n, pos, group)
                    token, node, n, pos, group, size = [], [], [], [], [], 0
            if size:
                yield from pack(token, node, n, pos, group)

        def pack(token: list, node: list, n: list, pos: list, group: list) -> Iterator[pa.RecordBatch]:
            if often_too:
                yield entry_batch(token, node, n, pos)
                return
            columns = [np.concatenate(x) for x in (token, node, n, pos, group)]
            bucket = (mix(columns[0]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ids, at = np.unique(bucket[order], return_index=True)
            rows = []
            for i, own in zip(ids.tolist(), np.split(order, at[1:])):
                t_, node_, n_, pos_, group_ = (c[own] for c in columns)
                head = np.flatnonzero(np.append(True, node_[1:] != node_[:-1]))
                short = np.uint16 if pos_.max() < 1 << 16 else np.uint32
                rows.append((i, (t_ >> np.uint64(16)).astype(np.uint32).tobytes(), pos_.astype(short).tobytes(), node_[head].tobytes(), n_[head].astype(np.uint32).tobytes(), np.diff(np.append(head, len(own))).astype(short).tobytes(), group_[head].tobytes()))
            yield pa.record_batch([pa.array(x, y) for x, y in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 6))], names=["bucket", "token", "pos", "node", "n", "times", "class"])

        return run

    def rare_pairs(self, classes: DataFrame) -> DataFrame:
        """Pairs of different classes that share a rare shingle and can reach the threshold."""
        t = self.t

        def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return joined(rows, t)

        kinds = "bucket long, token binary, pos binary, node binary, n binary, times binary, class binary"
        named = self.sets.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        return named.mapInArrow(self.entries(False), kinds).groupBy("bucket").applyInPandas(join, PAIR).distinct()

    def often_pairs(self, nodes: DataFrame, classes: DataFrame, every: bool) -> DataFrame:
        """Pairs of different classes that share a frequent shingle and that their sketches allow.

        Without `every`, each row of a list meets only the next one, in an order of that list's own, so there are no more
        pairs than rows: that joins most classes before all pairs between the classes left are made. A list of over
        `BLOCK` sets is dealt out in blocks, and every pair of blocks is a task's work, so no list meets in one task.
        """
        t, many = self.t, self.often.count()

        def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return often_joined(rows, t, every)

        named = self.often.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")).join(nodes.select("node", "sketch"), "node")
        named = named.withColumns({"side": F.lit(-1), "list": F.col("token")})
        if not self.long.isEmpty():
            own = F.pmod(F.xxhash64("node", "token"), F.col("blocks")).cast("int")
            crowded = named.join(self.long, "token").withColumn("own", own)
            if every:
                crowded = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                crowded = crowded.withColumns({"side": F.when(F.col("own") != F.col("other"), F.col("own")).otherwise(-1), "list": F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))})
            else:
                crowded = crowded.withColumn("list", F.xxhash64("token", "own"))
            named = named.join(self.long.select("token"), "token", "left_anti").select(*named.columns).unionByName(crowded.select(*named.columns))
        bucket = F.pmod(F.xxhash64("list"), F.lit(max(16, -(-many // JOINED)))).alias("bucket")
        return named.select(bucket, F.col("list").alias("token"), "node", "n", "pos", "class", "sketch", "side").groupBy("bucket").applyInPandas(join, PAIR).distinct()


def joined(rows: pd.DataFrame, t: int) -> pd.DataFrame:
    # 32 bits of a shingle are enough inside a bucket: where two are taken for one, the sets are compared in vain
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for token_, pos_, node_, n_, times_, class_ in zip(*(rows[c] for c in ("token", "pos", "node", "n", "times", "class"))):
        short = np.uint16 if len(pos_) < len(token_) else np.uint32
        times = np.frombuffer(times_, short)
        own = np.frombuffer(token_, np.uint32), *(np.repeat(np.frombuffer(x, k), times) for x, k in ((node_, np.int64), (n_, np.uint32))), np.frombuffer(pos_, short).astype(np.uint32), np.repeat(np.frombuffer(class_, np.int64), times)
        for part, x in zip(parts, own):
            part.append(x)
    columns = [np.concatenate(x) for x in parts]
    # most shingles are in one set only
    order = np.argsort(columns[0])
    token = columns[0][order]
    same = token[1:] == token[:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    token, node, n, pos, group = (x[order] for x in columns)
    order = np.lexsort((pos, node, n, token))  # of two places under one code the first one stays, which allows more
    token, node, n, pos, group = (x[order] for x in (token, node, n.astype(np.int64), pos.astype(np.int64), group))
    fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])) if len(token) else np.empty(0, bool)
    token, node, n, pos, group = (x[fresh] for x in (token, node, n, pos, group))
    found = [np.stack([node[i], node[j]], axis=1) for i, j in list_pairs(token, n, pos, group, t)]
    both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    both = np.unique(np.sort(both, axis=1), axis=0)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def often_joined(rows: pd.DataFrame, t: int, every: bool) -> pd.DataFrame:
    """Pairs of lists of frequent shingles."""
    columns = [rows[c].to_numpy() for c in ("token", "node", "n", "pos", "class", "side")]
    token, node, n = columns[:3]
    order = np.lexsort((node, n, token) if every else (mix(node.view(np.uint64) ^ mix(token.view(np.uint64))), token))
    columns = [x[order] for x in columns]
    token, group = columns[0], columns[4]
    heads = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    lists = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(token))))
    varied = np.flatnonzero((np.minimum.reduceat(group, heads) != np.maximum.reduceat(group, heads))[lists])
    token, node, n, pos, group, side = (x[varied] for x in columns)
    sketches = Sketches(rows["sketch"].to_numpy()[order[varied]].tolist())
    ids, of = np.unique(node, return_inverse=True)
    made, held = [np.empty(0, np.int64)], 0
    for i, j in list_pairs(token, n, pos, group, t, side) if every else neighbours(token, n, group, t):
        good = sketches.most_common(i, j, n[i], n[j]) >= needed(n[i], n[j], t)
        made.append(np.minimum(of[i[good]], of[j[good]]) * len(ids) + np.maximum(of[i[good]], of[j[good]]))
        held += len(made[-1])
        if held > 2_000_000:
            made, held = [np.unique(np.concatenate(made))], 0
    pairs = np.unique(np.concatenate(made))
    a, b = ids[pairs // max(1, len(ids))], ids[pairs % max(1, len(ids))]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def neighbours(token: np.ndarray, n: np.ndarray, group: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    i = np.flatnonzero((token[1:] == token[:-1]) & (group[1:] != group[:-1])) if len(token) else np.empty(0, np.int64)
    fits = t * np.maximum(n[i], n[i + 1]) <= 100 * np.minimum(n[i], n[i + 1]) if len(i) else np.empty(0, bool)
    yield i[fits], i[fits] + 1


def bounded(pairs: DataFrame, nodes: DataFrame, t: int) -> DataFrame:
    """a, b, rep_a, rep_b of the pairs whose sketches allow the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.withColumnsRenamed({"node": side, "rep": f"rep_{side}", "n": f"n_{side}", "sketch": f"sketch_{side}"}), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["a", "b", "rep_a", "rep_b"]
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            k = batch.num_rows
            n, m = get("n_a").to_numpy(), get("n_b").to_numpy()
            most = Sketches(get("sketch_a").to_pylist() + get("sketch_b").to_pylist()).most_common(np.arange(k), np.arange(k, 2 * k), n, m)
            keep = pa.array(most >= needed(n, m, t))
            yield pa.record_batch([get(c).filter(keep) for c in columns], names=columns)

    return saved(pairs.mapInArrow(lean(run), "a long, b long, rep_a long, rep_b long"), "near-pairs")


def whole_sets(reps: DataFrame, df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """node, rep, set (all hashes) of the rows of df whose id is one of reps, and the path where they are kept.

    The sets are made again from the texts; which documents these are is sent as a filter of fixed size, and others that pass
    it are for a join to leave out.
    """
    spark = df.sparkSession

    def bits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(PIECE, bool)
        own[rows["spot"].to_numpy() % PIECE] = True
        return pd.DataFrame([(key[0], np.packbits(own).tobytes())], columns=["piece", "bits"])

    spots = reps.select(F.pmod(F.xxhash64("rep"), F.lit(FILTER)).alias("spot")).distinct()
    wanted = np.zeros(FILTER // 8, np.uint8)
    for r in spots.withColumn("piece", F.floor(F.col("spot") / PIECE)).groupBy("piece").applyInPandas(bits, "piece long, bits binary").collect():
        wanted[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = sent.value
        for batch in batches:
            spot = batch.column(0).to_numpy(zero_copy_only=False)
            own = batch.filter(pa.array((there[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)))
            for some in slices(own, "t", SLICE_BYTES):
                h, at = shingle_sets(some.column(2).to_pylist())
                raw = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([pa.array([node_of(xxhash.xxh3_128_digest(x)) for x in raw], pa.int64()), some.column(1), pa.array(raw, pa.binary())], names=["node", "rep", "set"])

    id_ = df[doc_id].cast("long")
    rows = df.select(F.pmod(F.xxhash64(id_), F.lit(FILTER)).alias("spot"), id_.alias("rep"), text_or_empty(df, text).alias("t"))
    made, path = rows.mapInArrow(lean(sets), "node long, rep long, set binary"), shared_path(spark, "sets")
    with shuffles_dropped(spark):
        made.write.option("compression", "none").parquet(path)
    sent.destroy()
    return reread(made, path), path


def verified(pairs: DataFrame, df: DataFrame, nodes: DataFrame, doc_id: str, text: str, t: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold. pairs: a saved table, which is dropped.

    Sketches, which bound the intersection, are compared first, so whole sets meet for few pairs besides those that
    hold. The sets are those of the nodes' smallest ids.
    """
    spark, near = df.sparkSession, bounded(pairs, nodes, t)
    drop_saved(pairs)
    pairs = near

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "x", "y"))
            keep = []
            for i in range(batch.num_rows):
                u, v = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                small, large = (u, v) if len(u) <= len(v) else (v, u)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                inside = int((large[at] == small).sum())
                keep.append(100 * inside >= t * (len(u) + len(v) - inside))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([a.filter(mask), b.filter(mask)], names=["a", "b"])

    made, path = whole_sets(pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")), df, doc_id, text)
    for side, name in (("a", "x"), ("b", "y")):
        right = made.select(F.col("node").alias(f"_{side}"), F.col("rep").alias(f"_rep_{side}"), F.col("set").alias(name))
        pairs = pairs.join(right, (F.col(side) == F.col(f"_{side}")) & F.col(f"rep_{side}").eqNullSafe(F.col(f"_rep_{side}"))).drop(f"_{side}", f"_rep_{side}")
    out = saved(pairs.mapInArrow(compare, PAIR).distinct(), "links")
    forget(spark, path)
    drop_saved(near)
    return out


def shingle_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th (hash of the text), n_shingles, node, component_id) of every row of df, and the links (a, b) between nodes that the classes rest on.

    A node is a distinct set. Links are enough for the classes and all hold; pairs inside a class may be left out. Null and
    empty texts have no shingle and are a class of their own. component_id is the smallest id of the class; a null id is never it,
    and a row is its own class id if its class has no other. Rows that repeat an id count one by one. Ids are long, or text that holds whole numbers; another id is
    an error, as Spark's cast has it.
    """
    sets = saved(set_table(df, doc_id, text, threshold), "shingles")
    totals = sets.agg(F.sum(F.octet_length("low") / 8).alias("kept"), F.sum("n").alias("n")).first()
    kept, entries = int(totals["kept"] or 0), int((totals["n"] or 0) * (100 - threshold) // 100)
    members = sets.select("doc_id", "th", "n", "node")
    nodes = saved(sets.filter("node is not null").groupBy("node").agg(F.min(F.col("doc_id").cast("long")).alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "nodes")
    links = verified(saved(first_round(sets, threshold), "pairs"), df, nodes, doc_id, text, threshold)
    classes = components(links)
    prefixes = Prefixes(sets, threshold, kept, entries)
    for _ in range(JOIN_ROUNDS if prefixes.any_often else 0):
        more = verified(saved(prefixes.often_pairs(nodes, classes, every=False), "pairs"), df, nodes, doc_id, text, threshold)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        classes = components(links)
    pairs = prefixes.rare_pairs(classes)
    if prefixes.any_often:
        pairs = pairs.unionByName(prefixes.often_pairs(nodes, classes, every=True)).distinct()
    more = verified(saved(pairs, "pairs"), df, nodes, doc_id, text, threshold)
    if not more.isEmpty():
        links = links.unionByName(more)
        classes = components(links)
    prefixes.drop()
    named = nodes.select("node", "rep").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    by_node = named.select("node", "class").join(least, "class").select("node", "component_id")
    out = members.join(by_node, "node", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", F.col("doc_id").cast("long")).alias("component_id")), links


def one_of_each_class(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """The rows and columns of df without those whose class has a smaller id. Rows with a null id go if their class has an id."""
    out = shingle_join(df, doc_id, text, threshold)[0]
    go = out.filter(~F.col("doc_id").cast("long").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("go_id"), F.col("th").alias("go_th")).distinct()
    return df.join(go, df[doc_id].eqNullSafe(go["go_id"]) & (F.xxhash64(text_or_empty(df, text)) == go["go_th"]), "left_anti")


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones (places in sets)."""
    codes, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    column = np.cumsum(count > 1) - 1  # most shingles of unlike sets are in one only
    owner, used = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), count[codes] > 1
    owner, codes = owner[used], column[codes[used]]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    out, wide = np.zeros((len(left), len(right)), np.int64), max(1, CELLS // len(sets))
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, wide):
        a, b = np.searchsorted(codes, (low, low + wide))
        m = np.zeros((len(sets), min(wide, int(codes[-1]) + 1 - low)), np.float32)
        m[owner[a:b], codes[a:b] - low] = 1
        out += (m[left] @ m[right].T).astype(np.int64)
    return out


def counted(rows: pd.DataFrame, t: int) -> pd.DataFrame:
    """node, links: documents that each node links with, for the pairs of blocks in rows."""
    rows = rows.drop_duplicates(["job", "side", "node"]).sort_values("job", kind="stable")  # rows that repeat an id and a text made a set each
    nodes, links = [], []
    for _, own in rows.groupby("job", sort=False):
        sets, side = [np.frombuffer(x, np.uint64) for x in own["set"]], own["side"].to_numpy()
        node, copies, n = own["node"].to_numpy(), own["copies"].to_numpy(), np.array([len(x) for x in sets], np.int64)
        one = bool((side < 0).all())
        left, right = (np.arange(len(sets)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        both = common(sets, left, right)
        holds = 100 * both >= t * (n[left][:, None] + n[right] - both)
        if one:
            np.fill_diagonal(holds, False)
        else:
            nodes.append(node[right]), links.append(copies[left] @ holds)
        nodes.append(node[left]), links.append(holds @ copies[right])
    return pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(links)})


def with_links(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """shingle_join's rows with n_links: how many other rows of df each one links with, copies of its own text among them.

    Every link is inside a class, so the sets of a class are compared all with all; a large class is dealt out as pairs of blocks. Only
    numbers are kept: a class of g near copies costs g * g comparisons, but g rows a block.
    """
    docs = shingle_join(df, doc_id, text, threshold)[0]
    nodes = docs.filter("node is not null").groupBy("node").agg(F.min("component_id").alias("class"), F.min(F.col("doc_id").cast("long")).alias("rep"), F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    nodes = saved(nodes.fillna(-(2**63), ["class"]), "class-nodes")  # without any id all are one group, which leaves out nothing
    blocks = F.greatest(F.ceil(F.sum("n") / CLASS_ENTRIES), F.ceil(F.count(F.lit(1)) / CLASS_SETS)).cast("int")
    crowded = nodes.groupBy("class").agg(F.count(F.lit(1)).alias("many"), blocks.alias("blocks")).filter("many > 1").drop("many")
    near = saved(nodes.join(crowded, "class").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "crowded-nodes")
    entries = near.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    made, path = whole_sets(near.select("rep"), df, doc_id, text)
    made = made.withColumnsRenamed({"node": "_node", "rep": "_rep"})
    rows = near.join(made, (F.col("node") == F.col("_node")) & F.col("rep").eqNullSafe(F.col("_rep")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    rows = rows.select(F.xxhash64("class", F.least("own", "other"), F.greatest("own", "other")).alias("job"), side.alias("side"), "node", "copies", "set")
    bucket = F.pmod("job", F.lit(max(32, -(-entries // CLASS_JOINED)))).alias("bucket")
    links = rows.select(bucket, "*").groupBy("bucket").applyInPandas(lambda rows: counted(rows, threshold), "node long, links long")
    links = saved(links.groupBy("node").agg(F.sum("links").alias("links")), "link-numbers")
    forget(df.sparkSession, path)
    drop_saved(near)
    numbers = nodes.join(links, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return docs.join(numbers, "node", "left").select(*docs.columns, F.coalesce("n_links", F.lit(0)).alias("n_links"))
