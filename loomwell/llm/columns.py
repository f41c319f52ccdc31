"""Input handling that all operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whitespace removed or split on by the contracts: space and U+0009 to U+000D. Fixed values.
BLANKS = " \t\n\x0b\x0c\r"


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def id_text_crc32(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def order_of(keys: np.ndarray) -> np.ndarray:
    """An order of 64-bit hashes in which equal ones are neighbours.

    Sorting values is much faster than sorting places, so places are put into the low bits; the few keys that differ in
    these alone are put in order after that.
    """
    mask = np.uint64((1 << len(keys).bit_length()) - 1)
    packed = keys & ~mask
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & mask).astype(np.int64)
    high, own = packed & ~mask, keys[order]
    alike = np.append(False, high[1:] == high[:-1])
    if (alike[1:] & (own[1:] != own[:-1])).any():
        alike |= np.append(alike[1:], False)
        some = np.flatnonzero(alike)
        order[some] = order[some][np.argsort(own[some], kind="stable")]
    return order


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most_bytes of text, a row at least, so that memory is bounded by the longest text."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.schema.get_field_index(text))] if batch.num_rows < 64 else None
    if sizes is None:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
