"""SentencePiece encoding and decoding by a table of distinct chunks.

For a model whose pieces hold whitespace markers only at their start, no merge crosses from one chunk (a run of markers
and the characters up to the next marker) to the next. Each distinct chunk is encoded and decoded once and its ids are
joined back by position. Models without that property, or with another normalisation than marking spaces, are
encoded text by text with the library instead; `chunkable` decides from the model alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomwell.llm.chunk_table import ChunkTable
from loomwell.llm.columns import slices, text_or_empty
from loomwell.llm.workers import kept, lean

MARK = "▁"
CHUNK = re.compile("[ ]+[^ \\n]*|\\n[^ \\n]*")
#: Bytes of text that a worker holds at once, unless one text is longer.
SLICE_BYTES = 4 << 20


def chunkable(sp) -> bool:
    """True if no piece crosses a marker or a line end, and the model keeps all blanks and adds one in front."""
    inside = re.compile(f"[^{MARK}]{MARK}|\\n")
    if any(inside.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        return False
    probe = ["a  b", " a", "a ", "ﬁ　x y", "\t\n", "é"]
    return all(sp.decode(sp.encode(x)) == x for x in probe) and sp.encode(f"a {MARK}a") == sp.encode("a  a") and sp.encode("a a") == sp.encode("a") * 2 and sp.piece_to_id(MARK) != sp.unk_id()


def chunks_of(text: str) -> list[str]:
    """The text after a first blank, cut before each run of blanks and each line end; markers are blanks."""
    text = " " + text.replace(MARK, " ")
    if "\0" in text or "  " in text:
        return CHUNK.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]


class PieceCoder:
    """Encodes and decodes whole texts; ids are given as decimal text, joined by commas."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.by_chunk = chunkable(self.sp)
        self.table = ChunkTable(self._chunks)

    def _chunks(self, chunks: list[str]) -> Iterator[tuple[str, str]]:
        """The model adds a blank in front of a text, and takes one away in decoding."""
        marks, rests = [c[0] == " " for c in chunks], [c[c[0] == " " :] for c in chunks]
        found = [ids if rest else [self.sp.piece_to_id(MARK)] for rest, ids in zip(rests, self.sp.encode(rests, num_threads=1))]
        found = [ids if mark else ids[1:] for mark, ids in zip(marks, found)]
        for mark, ids, decoded in zip(marks, found, self.sp.decode(found)):
            yield str(ids)[1:-1].replace(" ", ""), " " + decoded if mark else decoded

    def texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids and decoded text of each text."""
        if not self.by_chunk:
            return [(",".join(map(str, ids)), self.sp.decode(ids)) for ids in self.sp.encode(texts, num_threads=1)]
        found = self.table.lookup([chunks_of(t) if t else [] for t in texts])
        return [(",".join([x[0] for x in chunks]), "".join([x[1] for x in chunks])[1:]) for chunks in found]


@kept
def coder(model_path: str) -> PieceCoder:
    return PieceCoder(model_path)


def encode_pieces(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, ids (decimal, joined by commas), n_tokens, ids_sha256, decoded, decoded_sha256; `keep`=False leaves out ids and decoded.

    Null and empty texts have no ids. No begin or end ids. One row for each row of df, repeated rows too; other columns are
    not read. The model's path must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                got = c.texts(part.column(1).to_pylist())
                columns = [part.column(0), [x.count(",") + 1 if x else 0 for x, _ in got], [sha(x) for x, _ in got], [sha(x) for _, x in got]]
                if keep:
                    columns += [[x for x, _ in got], [x for _, x in got]]
                yield pa.record_batch([pa.array(x) if isinstance(x, list) else x for x in columns], names=names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    types = f"id {df.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep
    return df.select(df[doc_id].alias("id"), text_or_empty(df, text).alias("t")).mapInArrow(lean(run, uses_kept=True), types).withColumnRenamed("id", doc_id)
