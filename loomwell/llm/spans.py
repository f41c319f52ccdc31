"""Byte spans of documents: their keys, and cutting them out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.columns import slices, text_or_empty
from loomwell.llm.workers import lean

KEYS = ["key1", "key2"]
SLICE_BYTES = 1 << 20


def keyed(df: DataFrame, doc_id: str, text: str, carry: bool = False) -> DataFrame:
    """key1, key2, id, t and, to carry, all of df's columns but the text as one struct `rest`.

    Rows that repeat an id and a text have one key; a null id has a key by its text.
    """
    t = text_or_empty(df, text)
    rest = [F.struct(*[df[c] for c in df.columns if c != text]).alias("rest")] if carry else []
    return df.select(*rest, F.coalesce(df[doc_id].cast("long"), F.xxhash64(t)).alias("key1"), F.hash(t, df[doc_id].isNull()).alias("key2"), df[doc_id].alias("id"), t.alias("t"))


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, sorted; those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """As cut_found, of spans given as key1, key2, a, b (half-open, in bytes). Spans that touch are one."""
    s = spans.distinct().groupBy(*KEYS).agg(F.collect_list(F.struct("a", "b")).alias("s"))
    return cut_found(docs, s.select(*KEYS, F.col("s.a").alias("a"), F.col("s.b").alias("b")), ["a", "b"], lambda _, a, b: zip(a, b))


def cut_found(docs: DataFrame, lists: DataFrame, columns: list[str], found: Callable[..., Iterable[tuple[int, int]]], least: int = 1) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row of `docs`, as keyed() gives it, and rest if there is one.

    lists: one row for each document that may have spans, with its keys and the columns that found() gets after the
    document's bytes; the first of them is never null. Spans shorter than `least` are left in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                rows = []
                t, *rest = (some.column(some.schema.get_field_index(x)) for x in ("t", *columns))
                for i in range(some.num_rows):
                    data = t[i].as_py().encode()
                    spans = [x for x in merged(list(found(data, *(c[i].as_py() for c in rest)))) if x[1] - x[0] >= least] if rest[0][i].is_valid else []
                    kept = cut(data, spans) if spans else data
                    rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                out = [pa.array(x, y) for x, y in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.record_batch([*(some.column(some.schema.get_field_index(c)) for c in first), *out], names=[*first, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    first = [c for c in ("rest", "id") if c in docs.columns]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in first)
    both = docs.join(lists, KEYS, "left")
    return both.mapInArrow(lean(run), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def aligned(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches that come in order of `key`, as tables of about `rows` rows in which no key is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            at = int(np.argmax(k == k[-1]))  # keys are in order, so this is where the last one starts
            if at:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, at)])
                held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)
