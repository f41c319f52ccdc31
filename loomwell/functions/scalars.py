"""Scalar expressions: coercion, predicates, parsers, scores. All are JVM-side."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions.nulls import not_or_true


def yes_no(c: Column) -> Column:
    """True for Yes and yes, false for No and no, else null."""
    return F.when(c.isin("Yes", "yes"), True).when(c.isin("No", "no"), False)


def number(c: Column) -> Column:
    """The value as double; null if it is none."""
    return c.try_cast("double")


def longer_than(c: Column, n: int) -> Column:
    """Whether there is a text of more than n characters; never null."""
    return F.coalesce(F.length(c) > n, F.lit(False))


def filled(c: Column) -> Column:
    """Whether there is a value other than the empty text; never null."""
    return F.coalesce(c != "", F.lit(False))


def first_match(c: Column, categories: Mapping[str, Sequence[str]], missing: str = "Unknown", other: str = "Other") -> Column:
    """The first category, in order, that has the value as a member."""
    out = F.when(c.isNull(), missing)
    for name, members in categories.items():
        out = out.when(c.isin(*members), name)
    return out.otherwise(other)


def looked_up(c: Column, names: Mapping[str, str]) -> Column:
    """The value's name, else the value."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), c)


def exploded(df: DataFrame, column: str, separator: str, name: str) -> DataFrame:
    """A row for each part of a delimited list: trimmed, in small letters, not empty, once a row. Rows without a part go."""
    parts = F.filter(F.transform(F.split(F.lower(column), re.escape(separator)), F.trim), lambda x: x != "")
    return df.withColumn(name, F.explode(F.array_distinct(parts)))


def genus_species(c: Column) -> tuple[Column, Column]:
    """First two words, of letters of any script; null if there are not two."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"(?U)^(\w+)\s+(\w+)", i), F.lit(""))
    return part(1), part(2)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def evidence_score(sequence: Column, genbank: Column, enzyme: Column, analytical: Column, extrapolated: Column) -> Column:
    """0 to 100: 30, 20, 20, 15 for what is known to be there, 15 if known not to be extrapolated."""
    points = lambda c, n: F.coalesce(c, F.lit(False)).cast("int") * n
    return points(sequence, 30) + points(genbank, 20) + points(enzyme, 20) + points(analytical, 15) + not_or_true(extrapolated).cast("int") * 15


def evidence_tier(score: Column) -> Column:
    """Right-closed bins: to 20, 50, 80, 100."""
    return F.when((score > -1) & (score <= 20), "Low").when((score > 20) & (score <= 50), "Medium").when((score > 50) & (score <= 80), "High").when((score > 80) & (score <= 100), "Excellent")


def gap_score(n_organisms: Column, share_sequence: Column, share_extrapolated: Column) -> Column:
    """Null for a group without organisms."""
    return F.try_divide(F.lit(40.0), F.log1p(n_organisms)) + (1 - share_sequence) * 35 + F.coalesce(share_extrapolated, F.lit(0.0)) * 25


def novelty_parts(n_plastics: Column, most_plastics: Column, genus_entries: Column, entries: Column, last_year: Column, max_year: Column, sequence: Column, enzyme: Column) -> dict[str, Column]:
    """Breadth, rarity, recency, evidence gap, and their weighted sum."""
    breadth = n_plastics / most_plastics * 100
    rarity = F.greatest(F.lit(0.0), 100 - F.coalesce(genus_entries, F.lit(1)) / entries * 1000)
    recency = F.greatest(F.lit(0.0), (100 - (max_year - F.coalesce(last_year, F.lit(2000))) * 5).cast("double"))
    gap = F.when(breadth > 30, (100 - (sequence.cast("int") * 50 + enzyme.cast("int") * 50)).cast("double")).otherwise(0.0)
    return {"breadth_score": breadth, "rarity_score": rarity, "recency_score": recency, "evidence_gap_score": gap, "novelty_potential": breadth * 0.30 + rarity * 0.25 + recency * 0.20 + gap * 0.25}


def discovery_priority(singleton: Column, known: Column, n_plastics: Column) -> Column:
    return singleton.cast("int") * 40 + (~known).cast("int") * 35 + F.log1p(n_plastics) * 10


def exploration_score(n_species: Column, share_sequence: Column, share_enzyme: Column, n_entries: Column) -> Column:
    return F.log1p(n_species) * 30 + (1 - (share_sequence + share_enzyme) / 2) * 50 + (n_entries < 10).cast("int") * 20


def candidate_score(sequence: Column, enzyme: Column, last_year: Column, max_year: Column, n_entries: Column) -> Column:
    """A group without a year counts as five years old."""
    age = F.greatest(F.lit(0), max_year - F.coalesce(last_year, max_year - 5))
    return (~sequence).cast("int") * 40 + (~enzyme).cast("int") * 30 - age * 2 + F.when(n_entries == 1, 20).when(n_entries < 5, 10).otherwise(0)


def range_or_value(c: Column) -> dict[str, Column]:
    """Optimum, min and max of a list of values and ranges, split by semicolons; parts of another form are left out.

    The optimum is the first single value, else the middle of the first range.
    """
    parts = F.transform(F.split(c, ";"), lambda x: F.trim(x))
    singles = F.transform(F.filter(parts, lambda x: x.rlike(r"^\d+\.?\d*$")), lambda x: x.cast("double"))
    spans = F.filter(parts, lambda x: x.rlike(r"^\d+\.?\d*\s*-\s*\d+\.?\d*$"))
    ends = F.transform(spans, lambda x: F.transform(F.split(x, r"\s*-\s*"), lambda y: y.cast("double")))
    every = F.concat(singles, F.flatten(ends))
    first = F.get(ends, F.lit(0))
    return {"optimum": F.coalesce(F.get(singles, F.lit(0)), (F.get(first, F.lit(0)) + F.get(first, F.lit(1))) / 2), "low": F.array_min(every), "high": F.array_max(every)}


def clean_accession(c: Column) -> Column:
    """Without a version of digits, then without a chain of one letter."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\.\d+$", ""), r"_[A-Za-z]$", "")


#: Patterns of accessions by kind, in order of preference.
ACCESSIONS = {
    "uniprot": r"^([A-N_R-Z][0-9][A-Z0-9]{3}[0-9]|[O,P,Q][0-9][A-Z0-9]{4})(?:[A-Z0-9]{4})?$",
    "refseq": r"^(WP|NP|XP|YP|AP|ZP)_\d+$",
    "genbank": r"^([A-Z]{3}\d{5,7}|[A-Z]{2}\d{5,6})$",
    "pdb": r"^[0-9][A-Za-z0-9]{3}$",
}


def accession_kind(c: Column) -> Column:
    out = F
    for kind, pattern in ACCESSIONS.items():
        out = out.when(c.rlike(pattern), kind)
    return out.otherwise("other")


def pick_accession(c: Column, pattern: str) -> Column:
    """The first field, between bars, that matches the whole pattern, else the value."""
    return F.coalesce(F.get(F.filter(F.split(c, "[|]"), lambda x: x.rlike(f"^(?:{pattern})$")), F.lit(0)), c)


def bar_header(c: Column) -> dict[str, Column]:
    """The seven fields of a header; missing ones are null, and so is an id that is no number."""
    fields = F.split(F.regexp_replace(c, "^>", ""), "[|]")
    names = ["orf_id", "genbank_accession", "library_id", "contig_id", "orf_start", "orf_end", "orf_type"]
    out = {n: F.get(fields, F.lit(i)) for i, n in enumerate(names)}
    return out | {n: out[n].try_cast("long") for n in ("orf_id", "orf_start", "orf_end")}


def signal_label(c: Column) -> Column:
    """Longer prefixes first."""
    u = F.upper(F.trim(c))
    return F.when(u.startswith("TATLIPO"), "TATLIPO").when(u.startswith("TAT"), "TAT").when(u.startswith("LIPO"), "LIPO").when(u.startswith("PILIN"), "PILIN").when(u.startswith("SP"), "SP").otherwise("OTHER")


#: Bits of localisation and membrane labels, and other names of them.
LOCALIZATION = {"nucleus": 1, "cytoplasm": 2, "extracellular": 4, "mitochondrion": 8, "cell_membrane": 16, "endoplasmic_reticulum": 32, "chloroplast": 64, "golgi_apparatus": 128, "lysosome_vacuole": 256, "peroxisome": 512}
MEMBRANE = {"peripheral": 1, "transmembrane": 2, "lipid_anchor": 4, "soluble": 8}
LABEL_ALIASES = {"golgi": "golgi_apparatus", "golgi_body": "golgi_apparatus", "er": "endoplasmic_reticulum", "lipid_anchored": "lipid_anchor", "peripheral_membrane": "peripheral", "transmembrane_protein": "transmembrane", "soluble_non_membrane": "soluble"}


def label_mask(c: Column, bits: Mapping[str, int], strict: bool = True) -> Column:
    """Bits of the labels, split by comma, semicolon or bar. An unknown label raises an error, or is left out if not strict."""
    labels = F.filter(F.transform(F.split(c, "[,;|]+"), lambda x: F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_")), lambda x: x != "")
    known = F.create_map(*[F.lit(x) for k, v in {**bits, **{a: bits[b] for a, b in LABEL_ALIASES.items() if b in bits}}.items() for x in (k, v)])
    other = F.raise_error(F.concat(F.lit("unknown label in: "), c)).cast("int") if strict else F.lit(0)
    return F.aggregate(labels, F.lit(0), lambda a, x: a.bitwiseOR(F.coalesce(F.try_element_at(known, x), other)))


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(bit) != 0


def slug(c: Column) -> Column:
    """Small letters; each run of characters other than ASCII letters and digits is one underline. Marked letters lose their marks."""
    plain = F.translate(c, "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ", "aaaaaaceeeeiiiinooooouuuuyyAAAACEEEEIIIINOOOOUUUU")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), F.lit("_"))


def doi_file_name(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "/:", "_-")


def doi_missing(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("", "unsure", "not specified", "null", "none", "n/a"), F.lit(True))


def short_count(c: Column) -> Column:
    """`1.1k` as 1100; null if it is no number."""
    t = F.lower(F.trim(c))
    return F.when(t.endswith("k"), F.rtrim(t, F.lit("k")).try_cast("double") * 1000).otherwise(t.try_cast("double")).cast("long")


def later_than(c: Column, day: str) -> Column:
    """ISO dates as text: an empty text is not later."""
    return F.coalesce(c > day, F.lit(False))


def token_estimate(c: Column) -> Column:
    """Words by 1.3, rounded up; an empty text has none."""
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.ceil(F.size(words) * 1.3)


def pdb_chain(c: Column) -> tuple[Column, Column]:
    """`1abc:A` as id and chain; the chain may be missing."""
    parts = F.split(F.trim(c), ":")
    return F.lower(parts[0]), F.nullif(F.get(parts, F.lit(1)), F.lit(""))


def joined_chain(pdb: Column, chain: Column) -> Column:
    return F.when(chain.isNotNull(), F.concat(pdb, F.lit(":"), chain)).otherwise(pdb)


def variant_label(c: Column) -> Column:
    """The id without a number after two underlines, then without `_tok`."""
    return F.regexp_replace(F.regexp_replace(c, r"__\d+$", ""), "_tok$", "")


def content_key(c: Column) -> Column:
    """md5 of the sequence in capitals without stops at its end."""
    return F.md5(F.rtrim(F.upper(c), F.lit("*")).cast("binary"))


def mutation(c: Column, base: Column) -> dict[str, Column]:
    """Kind, position from 0, both sides, and why a token such as A2N, -4R or G5- is dropped (null if it is not)."""
    t, pattern = F.upper(F.trim(c)), r"^([A-Z*-])(\d+)([A-Z*-])$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    ref, alt, pos = part(1), part(3), part(2).try_cast("int") - 1
    kind = F.when(ref == "-", "ins").when(alt == "-", "del").otherwise("sub")
    limit = F.length(base) - F.when(ref == "-", 0).otherwise(1)
    amino = alt.rlike("^[ACDEFGHIKLMNPQRSTVWY]$")
    reason = (
        F.when(~t.rlike(pattern), "unparseable")
        .when((ref == "-") & (alt == "-"), "both sides are gaps")
        .when((pos < 0) | (pos > limit), "outside base")
        .when((ref != "-") & (F.substring(base, pos + 1, F.lit(1)) != ref), "base differs")
        .when((alt != "-") & ~amino, "not encodable")
    )
    return {"kind": kind, "pos": pos, "ref": ref, "alt": alt, "reason": reason}


def wkb_point(c: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a WKB or EWKB point, by an Arrow UDF; null for anything else."""
    @F.pandas_udf("struct<lon: double, lat: double>")
    def decode(raw: pd.Series) -> pd.DataFrame:
        import struct

        out = []
        for b in raw:
            lon = lat = None
            if b is not None and len(b) >= 21:
                order = "<" if b[0] == 1 else ">"
                kind = struct.unpack_from(f"{order}I", b, 1)[0]
                at = 9 if kind & 0x20000000 else 5
                if kind & 0xFF == 1 and len(b) >= at + 16:
                    lon, lat = struct.unpack_from(f"{order}dd", b, at)
            out.append((lon, lat))
        return pd.DataFrame(out, columns=["lon", "lat"])

    point = decode(c)
    return point["lon"], point["lat"]


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, by component."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    return F.transform(F.sequence(F.lit(0), F.size(kept[0]) - 1), lambda i: F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i)), F.size(kept).cast("double")))
