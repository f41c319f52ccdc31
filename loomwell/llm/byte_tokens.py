"""Byte-level BPE ids of whole texts by a table of distinct chunks.

The tokenizer cuts a text into words before it merges, and always before a blank that follows a character other than a blank. So
texts are cut there, all texts of a slice at once; each distinct chunk is encoded once a worker by the tokenizers library, and ids are
joined back by position. Of chunks that begin with one blank at most and go on with plain letters, digits and marks it is certain where the
tokenizer cuts, so their words go straight to the library's model. Texts that hold one of the tokenizer's added tokens, and all texts of a tokenizer that cuts
otherwise, are encoded whole by the library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from loomwell.llm.chunk_table import ChunkTable
from loomwell.llm.id_table import LONGEST, PADDING, IdTable, keys_of, ragged
from loomwell.llm.workers import kept

SLICE_BYTES = 4 << 20
#: Chunks in one call of the library.
GROUP = 16
LETTER, DIGIT, MARK, BLANK = 1, 2, 3, 4


def _kinds() -> np.ndarray:
    """The kind of each ASCII character, 0 for those that are not plain, as the apostrophe, which begins endings such as 's."""
    out = np.zeros(256, np.uint8)
    for c in map(chr, range(33, 127)):
        out[ord(c)] = LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK
    out[ord("'")] = 0
    return out


KINDS = _kinds()


def _byte_names() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


BYTE_NAMES = _byte_names()


def words_of(b: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each chunk, of which b has the bytes and heads tells the first ones, is plain, and where words of plain chunks begin.

    Plain are an ASCII blank or none and then ASCII letters, digits and marks and letters of U+00C0 to U+027F and U+0400 to U+047F. A word is a run
    of one kind, with the space before it; another blank is a word of its own.
    """
    kind = KINDS[b]
    two = np.flatnonzero(((b >= 0xC3) & (b <= 0xC9)) | (b == 0xD0) | (b == 0xD1))
    two = two[(b[two] != 0xC3) | ((b[two + 1] != 0x97) & (b[two + 1] != 0xB7))]
    kind[two] = kind[two + 1] = LETTER
    first = b[heads]
    kind[heads[(first == 32) | ((first >= 9) & (first <= 13))]] = BLANK
    plain = np.minimum.reduceat(kind, heads) > 0
    spaces = heads[(first == 32) & (np.append(heads[1:], len(b)) - heads > 1)]
    kind[spaces] = kind[spaces + 1]
    new = np.append(True, kind[1:] != kind[:-1])
    new[heads] = True
    return plain, np.flatnonzero(new & np.repeat(plain, np.diff(heads, append=len(b))))


def chunk_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, and at each ASCII blank after a character that is certainly none.

    Besides ASCII these are the characters of two bytes from U+00C0 on, of three but for the rows that hold Unicode's blanks, and of four.
    """
    n = len(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    at = np.flatnonzero(blank[1:]) + 1
    one, two, three, four = (data[np.maximum(at - k, 0)] for k in (1, 2, 3, 4))
    tail = (one & 0xC0) == 0x80
    sure = (one > 32) & (one < 127)
    sure |= tail & (two >= 0xC3) & (two <= 0xDF)
    tail &= (two & 0xC0) == 0x80
    sure |= tail & (three >= 0xE0) & (three <= 0xEF) & ~((three >= 0xE1) & (three <= 0xE3))
    sure |= tail & ((three & 0xC0) == 0x80) & (four >= 0xF0)
    new = np.zeros(n + 1, bool)
    new[at[sure]] = True
    new[text_starts] = True
    return np.flatnonzero(new[:n])


class ByteCoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's without its own begin and end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_chunk = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not any(spec.get(x) for x in ("normalizer", "truncation", "padding"))
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        fences = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.fence = fences[0] if fences else None
        self.table, self.longer = IdTable(), ChunkTable(self._chunks, most=200_000)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks go to the library a few at a time, with a special token as a fence between them."""
        texts = [c.decode() for c in chunks]
        if not self.fence:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        fence_id, fence = self.fence
        out: list[bytes] = []
        for i in range(0, len(texts), 4096):
            some = texts[i : i + 4096]
            odd = {j for j, c in enumerate(some) if fence[0] in c or fence[-1] in c}
            usual = [c for j, c in enumerate(some) if j not in odd]
            joined = [fence.join(usual[j : j + GROUP]) for j in range(0, len(usual), GROUP)]
            flat: list[int] = []
            for e in self.library.encode_batch_fast(joined, add_special_tokens=False):
                flat += e.ids
                flat.append(fence_id)
            ids = np.array(flat, "<u4")
            ends = np.flatnonzero(ids == fence_id)
            got, raw = iter(zip([0, *((ends[:-1] + 1) * 4).tolist()], (ends * 4).tolist())), ids.tobytes()
            for j, c in enumerate(some):
                if j in odd:
                    out.append(self._whole(c))
                else:
                    a, b = next(got)
                    out.append(raw[a:b])
        return out

    def _new(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some chunks one after another, and how many each has."""
        b, heads = data[ragged(starts, sizes)], np.cumsum(sizes) - sizes
        plain, begins = words_of(b, heads)
        of = np.searchsorted(heads, begins, "right") - 1
        upto = np.minimum(np.append(begins[1:], len(b)), (heads + sizes)[of])
        names, tokens = b.tobytes().decode("latin-1").translate(BYTE_NAMES), self.library.model.tokenize
        known: dict[str, list[int]] = {}
        flat: list[int] = []
        n = []
        for i, j in zip(begins.tolist(), upto.tolist()):
            word = names[i:j]
            if (ids := known.get(word)) is None:
                ids = known[word] = [t.id for t in tokens(word)]
            flat += ids
            n.append(len(ids))
        counts = np.bincount(of, n, len(starts)).astype(np.int64)
        odd = np.flatnonzero(~plain)
        found = self._chunks([data[i : i + k].tobytes() for i, k in zip(starts[odd].tolist(), sizes[odd].tolist())])
        counts[odd] = [len(x) // 4 for x in found]
        order = np.concatenate([np.flatnonzero(plain), odd])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([np.array(flat, "<u4"), np.frombuffer(b"".join(found), "<u4")])[ragged(at, counts)], counts

    def _ids(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and how many each has."""
        data, sizes = np.frombuffer(joined, np.uint8), ends - starts
        at, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        own, n = starts[short], sizes[short]
        at[short], counts[short] = self.table.places(*keys_of(joined, own, n), lambda new: self._new(data, own[new], n[new]))
        long = np.flatnonzero(sizes > LONGEST)
        if len(long):
            chunks = [joined[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            wanted = list(dict.fromkeys(chunks))
            found = dict(zip(wanted, self.longer.values(wanted)))
            of = [found[c] for c in chunks]
            counts[long] = [len(x) // 4 for x in of]
            at[long] = self.table.add(np.frombuffer(b"".join(of), "<u4"), keep=False) + np.cumsum(counts[long]) - counts[long]
        return self.table.ids[ragged(at, counts)], counts

    def texts(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if not self.by_chunk or any(x in t for x in self.added)}
        raw = [b"" if i in whole else t.encode() for i, t in enumerate(texts)]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        begins, n = ends - [len(x) for x in raw], int(ends[-1]) if raw else 0
        out, edges = b"", np.zeros(len(texts) + 1, np.int64)
        if n:
            joined = b"".join([*raw, bytes(PADDING)])
            starts = chunk_starts(np.frombuffer(joined, np.uint8)[:n], begins[begins < n])
            upto, most = np.append(starts[1:], n), self.table.most
            parts, counts = zip(*(self._ids(joined, starts[i : i + most], upto[i : i + most]) for i in range(0, len(starts), most)))
            out = b"".join(x.tobytes() for x in parts)
            edges = 4 * np.concatenate([[0], np.cumsum(np.concatenate(counts))])[np.searchsorted(starts, np.append(begins, n))]
        return [self._whole(t) if i in whole else out[edges[i] : edges[i + 1]] for i, t in enumerate(texts)]


@kept
def coder(path: str) -> ByteCoder:
    return ByteCoder(path)
