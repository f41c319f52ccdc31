"""Amino-acid sequence expressions, JVM-side but for the isoelectric point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: Kyte-Doolittle hydropathy (1982).
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
#: Average masses of free amino acids, and of water.
MASS = {"A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885}
WATER = 18.0153
#: pK of charged groups (Bjellqvist), of the ends in general, and of some first residues.
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_START, PK_END = 7.5, 3.55
PK_FIRST = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_LAST = {"D": 4.55, "E": 4.75}


def clean(c: Column) -> Column:
    """Capitals, the 20 letters only; a null sequence is empty."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), f"[^{AMINO}]", "")


def count_of(c: Column, letters: str) -> Column:
    """How many of the letters there are; without a pattern, by what the text is shorter without them."""
    return F.length(c) - F.length(F.translate(c, letters, "") if len(letters) > 1 else F.replace(c, F.lit(letters), F.lit("")))


def share_of(c: Column, letters: str) -> Column:
    return F.try_divide(count_of(c, letters).cast("double"), F.length(c).cast("double"))


def invalid_share(c: Column, alphabet: str = AMINO) -> Column:
    """Share of characters outside the alphabet; 1 for an empty text."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, f"[{alphabet}]", "")) / F.length(c)).otherwise(1.0)


def composition(c: Column) -> Column:
    """Map from each of the 20 letters to its share; null for an empty sequence."""
    return F.when(F.length(c) > 0, F.create_map(*[x for a in AMINO for x in (F.lit(a), share_of(c, a))]))


def weighted(c: Column, values: dict[str, float]) -> Column:
    """Sum of the residues' values."""
    out = F.lit(0.0)
    for a, v in values.items():
        out = out + count_of(c, a) * F.lit(v)
    return out


def gravy(c: Column) -> Column:
    return F.try_divide(weighted(c, HYDROPATHY), F.length(c).cast("double"))


def molecular_weight(c: Column) -> Column:
    return weighted(c, MASS) - (F.length(c) - 1) * WATER


def structure_shares(c: Column) -> dict[str, Column]:
    """Residues that favour helix, turn and sheet."""
    return {"helix_fraction": share_of(c, "VIYFWL"), "turn_fraction": share_of(c, "NPGS"), "sheet_fraction": share_of(c, "EMAL")}


def isoelectric_point(c: Column) -> Column:
    """Bisection of the net charge, on the counts of the charged residues."""
    letters = [*PK_POSITIVE, *PK_NEGATIVE]

    @F.pandas_udf("double")
    def solve(counts: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        n = np.stack(counts.to_list()).astype(float) if len(counts) else np.empty((0, len(letters)))
        start, end = first.map(PK_FIRST).fillna(PK_START).to_numpy(), last.map(PK_LAST).fillna(PK_END).to_numpy()
        low, high = np.zeros(len(n)), np.full(len(n), 14.0)
        for _ in range(60):
            ph = (low + high) / 2
            charge = 1 / (1 + 10 ** (ph - start)) - 1 / (1 + 10 ** (end - ph))
            for i, a in enumerate(letters):
                charge += n[:, i] / (1 + 10 ** (ph - PK_POSITIVE[a])) if a in PK_POSITIVE else -n[:, i] / (1 + 10 ** (PK_NEGATIVE[a] - ph))
            low, high = np.where(charge > 0, ph, low), np.where(charge > 0, high, ph)
        return pd.Series((low + high) / 2)

    return solve(F.array(*[count_of(c, a) for a in letters]), F.substring(c, 1, 1), F.substring(c, -1, 1))


def properties(s: Column) -> dict[str, Column]:
    """Length, weight, hydropathy, aromaticity, structure and charge of a clean sequence; null under ten residues."""
    long = lambda x: F.when(F.length(s) >= 10, x)
    out = {
        "length": F.length(s),
        "molecular_weight_kda": F.round(molecular_weight(s) / 1000, 2),
        "gravy": F.round(gravy(s), 4),
        "is_hydrophobic": gravy(s) > 0,
        "aromaticity": F.round(share_of(s, "FWY"), 4),
        **{k: F.round(v, 4) for k, v in structure_shares(s).items()},
        "n_positive_residues": count_of(s, "KRH"),
        "n_negative_residues": count_of(s, "DE"),
        "charge_balance": count_of(s, "KRH") - count_of(s, "DE"),
    }
    return {k: long(v) for k, v in out.items()}


def has_motif(c: Column) -> Column:
    """G x S x G of the 20 letters, in a clean sequence."""
    return c.rlike(f"G[{AMINO}]S[{AMINO}]G")


def motif_contexts(c: Column, pattern: str, flank: int = 5) -> Column:
    """All matches that do not overlap, with so many characters on either side where there are; contexts may overlap.

    A mark that no text holds is put around each match, so that places are known without taking neighbours up.
    """
    parts = F.split(F.regexp_replace(c, f"({pattern})", "\u0001$1\u0001"), "\u0001")
    plain = lambda x: F.array_join(x, "")
    before = lambda i: F.substring(plain(F.slice(parts, 1, i)), -flank, flank)
    after = lambda i: F.substring(plain(F.slice(parts, i + 2, F.greatest(F.size(parts) - i - 1, F.lit(0)))), 1, flank)
    at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
    return F.transform(at, lambda i: F.concat(before(i), F.get(parts, i), after(i)))


#: What a fragment must keep to.
GATES = {"length": (40, 1000), "invalid": 0.0, "low_complexity": 0.30, "disorder": 0.50}


def quality_gates(c: Column, low_complexity: Column, disorder: Column) -> dict[str, Column]:
    """Whether a fragment passes all gates, and the reasons why not, joined by semicolons.

    The share of low complexity is that of small letters in a masked sequence (see masked_share); that of disorder comes from a
    predictor. A share that is missing fails its gate.
    """
    short, long = GATES["length"]
    failed = {
        "too_short": F.length(c) < short,
        "too_long": F.length(c) > long,
        "invalid_residues": invalid_share(c) > GATES["invalid"],
        "low_complexity": F.coalesce(low_complexity, F.lit(1.0)) > GATES["low_complexity"],
        "disorder": F.coalesce(disorder, F.lit(1.0)) > GATES["disorder"],
    }
    reasons = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in failed.items()])), ";")
    return {"passes": reasons == "", "reasons": reasons}


def masked_share(c: Column) -> Column:
    """Share of small letters, by which maskers mark low complexity; 1 for an empty sequence."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, "[^a-z]", "")) / F.length(c)).otherwise(1.0)


def instability_index(c: Column, weights: dict[str, float]) -> Column:
    """Ten times the mean weight of neighbouring residues. The table of the 400 pairs' weights is given; other pairs count 0."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    pairs = F.regexp_extract_all(c, F.lit("(?s)(?=(..))"), 1)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(table, x), F.lit(0.0)))
    return F.when(F.length(c) > 0, total * 10 / F.length(c))


def kmers(c: Column, k: int) -> Column:
    """Distinct k-mers; none for a shorter text."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)), F.array().cast("array<string>"))


def kmer_jaccard(a: Column, b: Column) -> Column:
    """Of two k-mer arrays; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def residue_values(c: Column, values: dict[str, float], other: float = 0.0) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x: F.coalesce(F.try_element_at(table, x), F.lit(other)))


def window_profile(c: Column, window: int = 9, values: dict[str, float] = HYDROPATHY) -> Column:
    """Centred mean at each residue; windows are shorter at the edges."""
    half = window // 2
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)
    at = lambda v, i: F.slice(v, F.greatest(i - half, F.lit(1)), F.least(i + half, F.size(v)) - F.greatest(i - half, F.lit(1)) + 1)
    # as the one element of an array the values are made once, not anew for each residue
    whole = F.transform(F.array(residue_values(c, values)), lambda v: F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: mean(at(v, i))))
    return F.when(F.length(c) > 0, F.get(whole, F.lit(0)))


def best_window(c: Column, within: int = 30, window: int = 8, values: dict[str, float] = HYDROPATHY) -> Column:
    """Largest mean of so many residues in a row, at the start; null for a shorter sequence."""
    mean = lambda v, i: F.aggregate(F.slice(v, i, window), F.lit(0.0), lambda s, y: s + y) / window
    start = F.substring(c, 1, within)
    means = F.transform(F.array(residue_values(start, values)), lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - window + 1, F.lit(1))), lambda i: mean(v, i)))
    return F.when(F.length(start) >= window, F.array_max(F.get(means, F.lit(0))))


def mature_slice(c: Column, cleavage: Column) -> dict[str, Column]:
    """The part behind the cleavage if it is inside the sequence, else all of it, and whether the place was no use."""
    good = (cleavage > 0) & (cleavage < F.length(c))
    return {"mature": F.when(good, F.substring(c, cleavage + 1, F.length(c))).otherwise(c), "is_mature": F.coalesce(good, F.lit(False)), "degenerate": cleavage.isNotNull() & ~F.coalesce(good, F.lit(False))}


def random_sequence(n: Column, key: Column, seed: int = 0, letters: str = AMINO) -> Column:
    """So many letters, each as likely as another, that follow from the key: a control of the same length."""
    pick = lambda i: F.substring(F.lit(letters), F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(len(letters))).cast("int") + 1, F.lit(1))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), pick), "")).otherwise("")


def reversed_sequence(c: Column) -> Column:
    """The residues backwards: a control of the same composition."""
    return F.reverse(c)


def resampled(c: Column, key: Column, seed: int = 0) -> Column:
    """As many residues, drawn from the sequence's own with replacement: a control of about the same composition."""
    pick = lambda i: F.substring(c, F.pmod(F.xxhash64(key, i, F.lit(seed)), F.length(c)).cast("int") + 1, F.lit(1))
    return F.when(F.length(c) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), pick), "")).otherwise("")


def fragment(c: Column, key: Column, share: float, seed: int = 0) -> Column:
    """A part of that share of the length; its place follows from the key."""
    n = F.greatest(F.floor(F.length(c) * share), F.lit(1)).cast("int")
    start = F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.length(c) - n + 1, F.lit(1))).cast("int") + 1
    return F.substring(c, start, n)


def shuffled(c: Column, key: Column, seed: int = 0) -> Column:
    """The residues in an order that follows from the key."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    keyed = F.transform(chars, lambda x, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), "")


#: Enzyme families in order, with words of their names (3 points each) and substrates (1 point).
FAMILIES = {
    "PETase / Cutinase": (["petase", "cutinase", "cut", "phl"], ["PET", "PES", "PBSA", "PBAT", "PEF"]),
    "Lipase": (["lipase", "lip", "pue", "pfl", "pla"], ["PU", "PCL", "PLA", "PBSA", "PES"]),
    "PHB Depolymerase": (["phb", "pha", "depolymerase", "phaz", "poly"], ["PHB", "PHA", "PHO", "PHBV", "PCL"]),
    "Laccase / Oxidase": (["laccase", "oxidase", "lac", "mnp", "lmco"], ["PE", "PS", "PVC", "LDPE", "HDPE"]),
    "Protease": (["protease", "serine protease", "subtilisin", "alkaline protease"], ["Nylon", "PU"]),
    "Esterase": (["esterase", "est", "arylesterase", "carboxylesterase"], ["PET", "PCL", "PBS", "PBSA", "PLA"]),
    "Amidase / Nylonase": (["nylonase", "nyl", "amidase", "aminopeptidase"], ["Nylon"]),
    "Peroxidase / MnP": (["peroxidase", "mnp", "manganese", "ligninase", "ldp"], ["PE", "PS", "PVC", "Nylon", "LDPE"]),
}


def enzyme_family(name: Column, substrate: Column) -> Column:
    """The family with most points, the first of equals; Unknown if none of its words is in the name."""
    n, s = F.lower(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(substrate, F.lit("")))
    scores = []
    for i, (family, (words, substrates)) in enumerate(FAMILIES.items()):
        hits = sum((F.when(n.contains(w), 3).otherwise(0) for w in words), F.lit(0))
        near = F.lit(False)
        for x in substrates:
            near = near | s.contains(x)
        scores.append(F.struct((hits + near.cast("int")).alias("score"), F.lit(-i).alias("order"), hits.alias("hits"), F.lit(family).alias("family")))
    best = F.array_max(F.array(*scores))
    return F.when(best["hits"] > 0, best["family"]).otherwise("Unknown")
