"""Substring dedup by content-defined chunks.

A gear hash of the last 32 bytes rolls over each text, vectorised by doubling; a chunk ends where its top bits are zero, after
`LEAST` bytes and before `MOST`, and never inside a character. Boundaries depend on near content alone, so they fall in the same
places after an insertion. Chunks are compared by a 128-bit digest. Of equal chunks the first stays, by document id and
place. The others are anchors: neighbouring matches with one copy are a run, each run is extended byte by byte to both sides, up to
`REACH` bytes, and cut out where it reaches `LEAST_RUN` bytes, so that common short phrases stay. Only the copy's `REACH` bytes
beside a run travel to the other document, not its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.columns import slices
from loomwell.llm.scratch import drop_saved, saved
from loomwell.llm.spans import KEYS, SLICE_BYTES, cut_found, keyed
from loomwell.llm.workers import lean

LEAST, MOST, ZERO_BITS = 32, 160, 5
#: Bytes of an extended match that are cut out at least.
LEAST_RUN = 96
WINDOW = 32
#: Bytes by which a run is extended to a side at most: two of the longest chunks, as after these a whole one would have matched.
REACH = 2 * MOST


def gear_table() -> np.ndarray:
    """256 random 32-bit values, by a rule (splitmix of the byte)."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of it and the 31 bytes before it (fewer at the start)."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, width * 2
    return h


def boundaries(size: int, may_end: np.ndarray, whole: np.ndarray) -> list[int]:
    """Ends of a text's chunks. may_end: places where the hash ends a chunk; whole: whether a character starts at each byte."""
    out, at, i, places = [], 0, 0, may_end.tolist()
    while size - at > MOST:
        while i < len(places) and places[i] < at + LEAST:
            i += 1
        end = places[i] if i < len(places) and places[i] <= at + MOST else at + MOST
        while end < size and not whole[end]:
            end += 1
        out.append(end)
        at = end
    rest = [p for p in places[i:] if at + LEAST <= p < size]
    for p in rest:
        if p >= at + LEAST and size - p >= 1:
            out.append(p)
            at = p
    if at < size:
        out.append(size)
    return out


def chunks(texts: list[bytes]) -> list[list[int]]:
    """For each text, the ends of its chunks."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts_char = (data & 0xC0) != 0x80
    ends = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - ZERO_BITS) == 0) + 1
    ends = ends[(ends >= len(data)) | starts_char[np.minimum(ends, len(data) - 1)]] if len(data) else ends
    out, at = [], 0
    for t in texts:
        lo, hi = np.searchsorted(ends, [at + WINDOW, at + len(t)])
        out.append(boundaries(len(t), ends[lo:hi] - at, starts_char[at : at + len(t)]))
        at += len(t)
    return out


def chunk_table(docs: DataFrame) -> DataFrame:
    """key1, key2, a, b, d1, d2: every chunk of at least LEAST bytes of the keyed documents, and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                texts = [x.encode() for x in some.column(2).to_pylist()]
                row, a, b, digest = [], [], [], []
                for i, (t, ends) in enumerate(zip(texts, chunks(texts))):
                    at = 0
                    for end in ends:
                        if end - at >= LEAST:
                            row.append(i), a.append(at), b.append(end), digest.append(xxhash.xxh3_128_digest(t[at:end]))
                        at = end
                d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                at = pa.array(row, pa.int32())
                columns = [some.column(0).take(at), some.column(1).take(at), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())]
                yield pa.record_batch(columns, names=[*KEYS, "a", "b", "d1", "d2"])

    return docs.select(*KEYS, "t").mapInArrow(lean(run), "key1 long, key2 int, a int, b int, d1 long, d2 long")


def matched_chunks(table: DataFrame) -> DataFrame:
    """For each document its chunks that are not the first of their digest: key1, key2, m (begin, end, keys and begin of the first one)."""
    first = table.groupBy("d1", "d2").agg(F.min(F.struct("key1", "key2", "a")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = saved(first.select("d1", "d2", "first"), "first-chunks")
    found = table.join(first, ["d1", "d2"]).filter(F.struct("key1", "key2", "a") != F.col("first"))
    one = F.struct("a", "b", F.col("first.key1").alias("f1"), F.col("first.key2").alias("f2"), F.col("first.a").alias("at"))
    out = saved(found.groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("m")), "matches")
    drop_saved(first)
    return out


Run = tuple[int, int, int, int, int]


def runs_of(m: list[dict]) -> list[Run]:
    """Neighbouring matches with neighbouring chunks of one document as one: begin, end, the copy's keys and begin."""
    out: list[Run] = []
    for x in m:
        if out:
            a, b, f1, f2, at = out[-1]
            if b == x["a"] and (f1, f2, at + b - a) == (x["f1"], x["f2"], x["at"]):
                out[-1] = a, x["b"], f1, f2, at
                continue
        out.append((x["a"], x["b"], x["f1"], x["f2"], x["at"]))
    return out


EDGE = "key1 long, key2 int, place int, after boolean, f1 long, f2 int, pos int"


def run_edges(matches: DataFrame) -> DataFrame:
    """Both ends of each run, and where they are in the copy. One row a document and place, as the copy of a chunk is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key1, key2, m in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b, f1, f2, at in runs_of(m):
                    rows += [(key1, key2, a, False, f1, f2, at), (key1, key2, b, True, f1, f2, at + b - a)]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(x, y) for x, y in zip(zip(*rows), kinds)], names=[f.split()[0] for f in EDGE.split(", ")])

    return matches.select(*KEYS, "m").mapInArrow(run, EDGE)


def beside(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """f1, f2, pos, after, piece: the copies' bytes before or after each place that is asked for, once."""
    asked = edges.select("f1", "f2", "pos", "after").distinct().groupBy("f1", "f2").agg(F.collect_list(F.struct("pos", "after")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                row, out = [], []
                for i in range(some.num_rows):
                    data = some.column(2)[i].as_py().encode()
                    for x in some.column(3)[i].as_py():
                        at = x["pos"]
                        row.append(i), out.append((at, x["after"], data[at : at + REACH] if x["after"] else data[max(0, at - REACH) : at]))
                if out:
                    at = pa.array(row, pa.int32())
                    rest = [pa.array(x, y) for x, y in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary()))]
                    yield pa.record_batch([some.column(0).take(at), some.column(1).take(at), *rest], names=["f1", "f2", "pos", "after", "piece"])

    named = docs.select(F.col("key1").alias("f1"), F.col("key2").alias("f2"), "t").join(asked, ["f1", "f2"])
    return named.mapInArrow(lean(run), "f1 long, f2 int, pos int, after boolean, piece binary").dropDuplicates(["f1", "f2", "pos", "after"])


def agree(x: bytes, y: bytes) -> int:
    """How many bytes x and y have in common from their starts on."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


def extended(t: bytes, m: list[dict], edges: list[dict] | None) -> Iterator[tuple[int, int]]:
    """The spans of t that its matches cover, with what agrees beside them; whole characters."""
    pieces = {(e["place"], e["after"]): e["piece"] for e in edges or ()}
    for a, b, *_ in runs_of(m):
        before, after = pieces.get((a, False), b""), pieces.get((b, True), b"")
        begin, end = a - agree(t[max(0, a - REACH) : a][::-1], before[::-1]), b + agree(t[b : b + REACH], after)
        while begin < a and t[begin] & 0xC0 == 0x80:
            begin += 1
        while b < end < len(t) and t[end] & 0xC0 == 0x80:
            end -= 1
        yield begin, end


def without_spans(docs: DataFrame, least: int) -> DataFrame:
    """The keyed documents without the spans that an earlier place holds. Bytes cut out have a copy earlier in the order, so a first copy stays."""
    table = saved(chunk_table(docs), "chunks")
    matches = matched_chunks(table)
    drop_saved(table)
    edges = run_edges(matches)
    pieces = saved(beside(docs, edges), "pieces-beside")
    ends = edges.join(pieces, ["f1", "f2", "pos", "after"]).groupBy(*KEYS).agg(F.collect_list(F.struct("place", "after", "piece")).alias("e"))
    lists = saved(matches.join(ends, KEYS, "left").select(*KEYS, "m", "e"), "match-lists")
    drop_saved(matches, pieces)
    return cut_found(docs, lists, ["m", "e"], extended, least)


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """All rows and columns of df, the repeated passages cut out of its texts; null texts become empty."""
    out = without_spans(keyed(df, doc_id, text, carry=True), least_run)
    return out.select(*[F.col("kept").cast("string").alias(c) if c == text else F.col("rest")[c].alias(c) for c in df.columns])


def chunk_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row of df.

    Null texts count as empty. Rows that repeat an id and a text are one document. A null id is ordered by a hash of its
    text. Chunks shorter than 32 bytes, at the ends of texts, are no anchors. Ids are long, or text that holds whole numbers; another id is
    an error, as Spark's cast has it.
    """
    return without_spans(keyed(df, doc_id, text), least_run).withColumnRenamed("id", doc_id)
