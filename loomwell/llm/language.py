"""Language identification by interpolated Kneser-Ney character models.

A text is letters in lower case; every run of other characters is one blank. Each language has a model of `ORDER` characters whose
lower orders count in how many contexts an ending was seen. All n-grams of all languages are kept in one sorted array
of hashes with their interpolated log-probabilities by language; n-grams that it lacks are backed off exactly. The language with the
lowest cross-entropy per character is chosen. A text whose cross-entropy is above what that language's own held-aside documents
reach, with a margin, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.columns import slices
from loomwell.llm.workers import lean

ORDER = 4
#: Labelled documents that a language's model is fitted on, about; each is read whole. Chosen by a hash of id and text.
FIT_DOCS = 1000
BLANK, PAD = 32, 1
SLICE_BYTES = 512 << 10
#: Nats per character over the calibrated bound, and more for short texts, before a text is rejected.
MARGIN, SHORT = 0.7, 3.0
#: A text counts as so many characters at most in its score.
SHARPNESS = 60


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point: its small letter as 16 bits, or a blank.

    Letters above U+FFFF get the codes that no letter has, in order; there are more of them than codes, so the last ones, which
    are rare ideographs, share one code.
    """
    small = np.full(0x110000, BLANK, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            small[i] = ord(low if len(low) == 1 else c)
    used = np.unique(small)
    free = np.setdiff1d(np.arange(2, 0xFFFF), used[used <= 0xFFFF])
    high = used[used > 0xFFFF]
    code = np.arange(0x110000, dtype=np.int32)
    code[high] = np.append(free, np.full(max(0, len(high) - len(free)), 0xFFFF))[: len(high)]
    out = code[small].astype(np.uint16)
    out[PAD] = PAD
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character of the texts, and the index of its text."""
    pad = chr(PAD) * (ORDER - 1)
    chars = letters()[np.frombuffer((pad + pad.join(t.replace(chr(PAD), " ") for t in texts)).encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) + ORDER - 1 for t in texts])
    before = np.concatenate([[PAD], chars[:-1]])
    keep = (chars != BLANK) | ((before != BLANK) & (before != PAD))
    chars, doc = chars[keep], doc[keep]
    code = chars.copy()
    for k in range(1, ORDER):
        code[k:] |= chars[:-k] << np.uint64(16 * k)
    real = chars != PAD
    return code[real], doc[real]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix that maps different codes to different hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def tail(codes: np.ndarray, n: int) -> np.ndarray:
    return codes & np.uint64((1 << 16 * n) - 1) if n < 4 else codes


def find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


class KneserNey:
    """One language's model, from its n-grams of ORDER characters and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels, self.alphabet = {}, len(np.unique(tail(codes, 1))) + 1
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(float)
        for n in range(ORDER, 0, -1):
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
            contexts, of, types = np.unique(codes >> np.uint64(16), return_inverse=True, return_counts=True)
            self.levels[n] = (codes, counts, contexts, np.bincount(of, counts), types, discount)
            if n > 1:  # below, an n-gram counts as often as different characters stand before it
                codes, counts = np.unique(tail(codes, n - 1), return_counts=True)
                counts = counts.astype(float)

    def prob(self, wanted: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.full(len(wanted), 1 / self.alphabet)
        lower = self.prob(wanted, n - 1)
        own = tail(wanted, n)
        codes, counts, contexts, totals, types, discount = self.levels[n]
        at, hit = find(codes, own)
        near, known = find(contexts, own >> np.uint64(16))
        seen = np.where(hit, counts[at] - discount, 0)
        return np.where(known, (seen + discount * types[near] * lower) / totals[near], lower)


@dataclass
class LanguageModel:
    languages: list[str]
    models: list[KneserNey]
    bounds: np.ndarray

    def __post_init__(self) -> None:
        codes = np.unique(np.concatenate([m.levels[ORDER][0] for m in self.models])) if self.models else np.empty(0, np.uint64)
        hashes = mixed(codes)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.logs = self.exact(codes[order])

    def exact(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([np.log(m.prob(codes)) for m in self.models], axis=1).astype(np.float32) if self.models else np.empty((len(codes), 0), np.float32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character by text and language, and the number of characters; texts must hold a letter."""
        codes, doc = grams(texts)
        at, hit = find(self.hashes, mixed(codes))
        logs = self.logs[at]
        if not hit.all():
            new, back = np.unique(codes[~hit], return_inverse=True)
            logs[~hit] = self.exact(new)[back]
        n = np.bincount(doc, minlength=len(texts))
        total = np.add.reduceat(logs, np.searchsorted(doc, np.arange(len(texts))), axis=0, dtype=np.float64)
        return -total / n[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, and whether it is rejected, of each text."""
        lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        good = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if self.models else []
        if good:
            h, n = self.entropies([texts[i] for i in good])
            best = h.argmin(axis=1)
            lead = np.minimum(n, SHARPNESS)[:, None] * (h.min(axis=1, keepdims=True) - h)
            score[good] = 1 / np.exp(lead).sum(axis=1)
            out[good] = h.min(axis=1) > self.bounds[best] + MARGIN + SHORT / np.sqrt(n)
            for i, b in zip(good, best):
                lang[i] = self.languages[b]
        return lang, score, out


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = FIT_DOCS) -> LanguageModel:
    """Learns the models from a hash sample of about `docs` documents a language, every fifth of them for calibration.

    Rows without a text or label are left out. Without any labelled row the model knows no language and predicts `und`.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), F.lit(1 << 40)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([], [], np.empty(0))
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, docs / n))).otherwise(share)
    picked = rows.filter(F.col("h") < share * (1 << 40)).withColumn("aside", F.col("h") % 5 == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "t", SLICE_BYTES):
                texts, names = some.column(1).to_pylist(), some.column(0).to_pylist()
                for name in set(names):
                    codes, n = np.unique(grams([t for t, x in zip(texts, names) if x == name])[0], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    learn = picked.filter("not aside").select("lang", "t").mapInArrow(lean(count), "lang string, code long, n long")
    found = learn.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values(["lang", "code"])
    names, models = [], []
    for name, own in found.groupby("lang"):
        names.append(name)
        models.append(KneserNey(own["code"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy()))
    model = LanguageModel(names, models, np.full(len(names), np.inf))
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def calibrate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[np.array([any(map(str.isalpha, t)) for t in f["t"]], bool) & f["lang"].isin(sent.value.languages)]
            if len(f):
                h, n = sent.value.entropies(f["t"].tolist())
                of = [sent.value.languages.index(x) for x in f["lang"]]
                yield pd.DataFrame({"lang": f["lang"].to_numpy(), "h": h[np.arange(len(f)), of] - SHORT / np.sqrt(n)})

    aside = picked.filter("aside").select("lang", "t").mapInPandas(lean(calibrate), "lang string, h double").toPandas()
    high = aside.groupby("lang")["h"].quantile(0.999)
    model.bounds = np.array([high.get(x, np.inf) for x in names])
    return model


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All rows and columns of df, and lang_pred, lang_score, lang_rejected; columns of these names are replaced.

    Texts that are null, or have no letter, are `und` with score 0 and are rejected. Whole texts are read.
    """
    df = df.drop("lang_pred", "lang_score", "lang_rejected")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text, SLICE_BYTES):
                texts = [x or "" for x in some.column(some.schema.get_field_index(text)).to_pylist()]
                lang, score, out = sent.value.predict(texts)
                yield pa.record_batch([*some.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(out)], names=[*some.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(lean(run), f"{fields}, lang_pred string, lang_score double, lang_rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from."""
    from loomwell.llm.columns import id_text_crc32

    return id_text_crc32(doc_id) % 5 == 0
