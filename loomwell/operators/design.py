"""Oligo design for clusters of aligned cores.

A cluster holds tens to a few hundred cores, so a group is bounded by the problem, and clusters run in parallel. Every choice of cores
here is one problem, `heaviest`: cores are taken in as long as what they need together stays allowed, and needs only grow. It is
solved by branch and bound; `proved` says whether the search ended before its limit, so that the result is the best there is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import product
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The standard genetic code in the order TCAG, and the ambiguity codes of bases.
CODE = dict(zip(("".join(p) for p in product("TCAG", repeat=3)), "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"))
BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
ACIDS = sorted(set(CODE.values()) - {"*"})
#: Steps of a search before it gives what it has found, unproved.
MOST_STEPS = 5_000


@lru_cache(1)
def degenerate_codons() -> list[tuple[int, int, str, frozenset[str]]]:
    """Ambiguous bases, triplets, codon and amino acids of every degenerate codon that never reads as a stop."""
    out = []
    for bases in product(BASES, repeat=3):
        read = [CODE["".join(t)] for t in product(*(BASES[b] for b in bases))]
        if "*" not in read:
            out.append((sum(len(BASES[b]) > 1 for b in bases), len(read), "".join(bases), frozenset(read)))
    return out


def codons(spark: SparkSession) -> DataFrame:
    """codon, amino_acids (in order), ambiguous, triplets."""
    return spark.createDataFrame([(c, sorted(a), n, t) for n, t, c, a in degenerate_codons()], "codon string, amino_acids array<string>, ambiguous int, triplets int")


def cheapest_codons(wanted: DataFrame, key: str, acids: str) -> DataFrame:
    """key, codon, ambiguous, triplets: the cheapest codon that covers all the wanted amino acids; keys without one are left out.

    The table of codons has some 2,500 rows, whatever the input.
    """
    table = F.broadcast(codons(wanted.sparkSession))
    fit = wanted.select(key, acids).join(table, F.size(F.array_except(F.col(acids), F.col("amino_acids"))) == 0)
    return fit.groupBy(key).agg(F.min(F.struct("ambiguous", "triplets", "codon")).alias("b")).select(key, "b.codon", "b.ambiguous", "b.triplets")


@lru_cache(100_000)
def cheapest(acids: frozenset[str]) -> tuple[int, int, str, frozenset[str]] | None:
    """The codon for these acids with the fewest ambiguous bases, then triplets, then by name; None if every one may stop."""
    return min((c for c in degenerate_codons() if acids <= c[3]), default=None)


def heaviest(weights: list[float], start: Any, widen: Callable[[Any, int], Any], holds: Callable[[Any], Iterable[int]], cost: Callable[[Any], Any], most_steps: int = MOST_STEPS) -> tuple[list[int], Any, bool]:
    """The items of most weight that one allowed state holds, that state, and whether this is proved; of equals the least cost.

    widen(state, i) is the state that holds i too, or None if it is not allowed; what is not allowed stays so when a state widens.
    holds(state) may give items that were not asked for. Items that no longer fit are left out of all that follows, and a branch is
    given up when all that could still be added does not reach the best weight found.
    """
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    best: list = [0.0, None, [], start]
    steps = 0
    stack = [(start, frozenset(), order)]
    while stack:
        if steps >= most_steps:
            return best[2], best[3], False
        steps += 1
        state, inside, open_ = stack.pop()
        weight = sum(weights[i] for i in inside)
        if inside and (best[1] is None or weight > best[0] or weight == best[0] and cost(state) < best[1]):
            best = [weight, cost(state), sorted(inside), state]
        fits = [(i, wider) for i in open_ if i not in inside and (wider := widen(state, i)) is not None]
        left = sum(weights[i] for i, _ in fits)
        branches = []
        for k, (i, wider) in enumerate(fits):
            if weight + left < best[0]:
                break
            branches.append((wider, frozenset(holds(wider)), [j for j, _ in fits[k + 1 :]]))
            left -= weights[i]
        stack += reversed(branches)  # the heaviest item is tried first
    return best[2], best[3], True


def cover(seqs: list[str], weights: list[float], most: int, most_steps: int = MOST_STEPS) -> dict:
    """One oligo with at most so many ambiguous bases for most weight of whole sequences."""
    width = len(seqs[0])

    def widen(state: tuple, i: int) -> tuple | None:
        out = tuple(have if a in have[3] else cheapest(have[3] | {a}) for have, a in zip(state, seqs[i])) if state else tuple(cheapest(frozenset(a)) for a in seqs[i])
        return out if None not in out and sum(c[0] for c in out) <= most else None

    def holds(state: tuple) -> list[int]:
        return [i for i, s in enumerate(seqs) if all(a in c[3] for a, c in zip(s, state))]

    inside, state, proved = heaviest(weights, (), widen, holds, lambda s: (sum(c[0] for c in s), math.prod(c[1] for c in s), [c[2] for c in s]), most_steps)
    if not inside:
        return {"oligo": None, "ambiguous": 0, "n_covered": 0, "weight": 0.0, "library": 0.0, "proved": proved}
    assert len(state) == width
    return {"oligo": "".join(c[2] for c in state), "ambiguous": sum(c[0] for c in state), "n_covered": len(inside), "weight": float(sum(weights[i] for i in inside)), "library": float(math.prod(c[1] for c in state)), "proved": proved}


def pieces_of(seqs: list[str], cuts: list[int]) -> list[tuple[str, ...]]:
    edges = [0, *cuts, len(seqs[0])]
    return [tuple(s[a:b].replace("-", "") for a, b in zip(edges, edges[1:])) for s in seqs]


def variety(seqs: list[str]) -> Callable[[int, int], float]:
    """The logarithm of the number of distinct pieces between two columns, each counted once."""
    return lru_cache(None)(lambda a, b: math.log(len({s[a:b].replace("-", "") for s in seqs})))


def place_cuts(seqs: list[str], parts: int, least: int) -> list[int] | None:
    """Cuts into so many parts of at least so many columns whose product of distinct pieces is smallest; None if there is no room."""
    width, cost = len(seqs[0]), variety(seqs)
    # upto[b]: the best way to make of the first b columns as many parts as there were rounds
    upto = {b: (cost(0, b), ()) for b in range(least, width + 1)}
    for _ in range(parts - 1):
        ways = {b: [(c + cost(a, b), (*cuts, a)) for a, (c, cuts) in upto.items() if b - a >= least] for b in range(least, width + 1)}
        upto = {b: min(w) for b, w in ways.items() if w}
    return list(upto[width][1]) if width in upto else None


def conflict(a: str, b: str, differ: int) -> bool:
    """Junctions that may be mistaken: too alike, directly or as the other strand."""
    other = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return any(sum(p != q for p, q in zip(a, x)) < differ for x in (b, other))


def place_cuts_apart(seqs: list[str], junctions: dict[int, list[str]], parts: int, least: int, differ: int = 2, most_states: int = 1_000_000) -> tuple[list[int], list[str]] | None:
    """As place_cuts, at the given places only, each with a junction that conflicts with none of the others.

    Best first: a state's cost with the least that its remaining columns can cost if junctions never conflicted, so the first whole
    state that comes up is the best one. None if there is none; over so many states it raises.
    """
    width, cost = len(seqs[0]), variety(seqs)
    rest: list[dict[int, float]] = [{a: cost(a, width) for a in [0, *junctions] if width - a >= least}]
    for _ in range(parts - 1):
        rest.append({a: min(ways) for a in [0, *junctions] if (ways := [cost(a, p) + rest[-1][p] for p in junctions if p - a >= least and p in rest[-1]])})
    heap = [(rest[parts - 1][0], 0.0, (), ())] if 0 in rest[parts - 1] else []
    states = 0
    while heap:
        _, spent, cuts, chosen = heapq.heappop(heap)
        last, left = (cuts[-1] if cuts else 0), parts - 1 - len(cuts)
        if left < 0:
            return list(cuts[:-1]), list(chosen)
        states += 1
        if states > most_states:
            raise RuntimeError(f"no placement was proved best within {most_states} states")
        if not left:
            heapq.heappush(heap, (spent + cost(last, width), spent, (*cuts, width), chosen))
        for p in junctions if left else ():
            if p - last >= least and p in rest[left - 1]:
                now = spent + cost(last, p)
                for j in junctions[p]:
                    if not any(conflict(j, k, differ) for k in chosen):
                        heapq.heappush(heap, (now + rest[left - 1][p], now, (*cuts, p), (*chosen, j)))
    return None


def library(present: tuple[frozenset, ...]) -> int:
    """How many cores the present pieces make together."""
    return math.prod(map(len, present))


def under_budget(pieces: list[tuple], weights: list[float], budget: int, most_steps: int = MOST_STEPS) -> dict:
    """Whole cores of most weight whose pieces make a library within the budget."""

    def widen(state: tuple, i: int) -> tuple | None:
        out = tuple(have | {p} for have, p in zip(state, pieces[i]))
        return out if library(out) <= budget else None

    def holds(state: tuple) -> list[int]:
        return [i for i, own in enumerate(pieces) if all(p in have for p, have in zip(own, state))]

    inside, state, proved = heaviest(weights, tuple(frozenset() for _ in pieces[0]), widen, holds, lambda s: (library(s), sum(map(len, s)), [sorted(x) for x in s]), most_steps)
    size = library(state) if inside else 0
    distinct = len({pieces[i] for i in inside})
    return {"n_covered": len(inside), "weight": float(sum(weights[i] for i in inside)), "library": size, "n_oligos": sum(map(len, state)), "junk_share": (size - distinct) / size if size else 0.0, "proved": proved, "present": state, "inside": inside}


def under_junk(pieces: list[tuple], weights: list[float], most_share: float, most: int = 10**9, most_steps: int = MOST_STEPS // 10) -> dict:
    """Cores of most weight whose library holds at most that share of cores that were not asked for.

    With c distinct cores inside, the library may have c / (1 - share) cores. So for each c there is a budget, and the heaviest choice within
    it is taken if its own share is small enough; of all these the heaviest. `proved` holds for each budget's choice alone.
    """
    distinct = len(set(pieces))
    best = None
    budgets = {min(most, int(c / (1 - most_share) + 1e-9)) if most_share < 1 else most for c in range(1, distinct + 1)}
    for budget in sorted(budgets, reverse=True)[:: max(1, len(budgets) // 12)] + [min(budgets)]:
        found = under_budget(pieces, weights, budget, most_steps)
        if found["inside"] and found["junk_share"] <= most_share + 1e-12:
            rank = (found["weight"], -found["library"])
            if best is None or rank > best[0]:
                best = rank, found
        if best and found["weight"] < best[0][0]:
            break  # smaller budgets hold no more
    return best[1]


def combined(seqs: list[str], weights: list[float], parts: int, least: int, budget: int, most: int) -> list[dict]:
    """Both together: cuts, the cores under the budget, and for each part the degenerate oligos that make its pieces.

    part, oligo, pieces: pieces of one length are covered by as few oligos of at most so many ambiguous bases as taking the one for
    most of them, over and over, gives. No oligo for a piece without a codon: these have the oligo null.
    """
    cuts = place_cuts(seqs, parts, least)
    if cuts is None:
        return []
    chosen, out = under_budget(pieces_of(seqs, cuts), weights, budget), []
    for part, present in enumerate(chosen["present"]):
        left = sorted(p for p in present if p)
        while left:
            same = [p for p in left if len(p) == len(left[0])]
            oligo = cover(same, [1.0] * len(same), most)["oligo"]
            made = {p for p in same if oligo and all(a in next(c[3] for c in degenerate_codons() if c[2] == oligo[3 * j : 3 * j + 3]) for j, a in enumerate(p))} or set(same)
            out.append({"part": part, "oligo": oligo, "pieces": sorted(made)})
            left = [p for p in left if p not in made]
    return out


def _cluster(f: pd.DataFrame, sequence: str, weight: str) -> tuple[list[str], list[float]]:
    f = f.sort_values(sequence)
    return f[sequence].tolist(), f[weight].astype(float).tolist()


def cover_clusters(df: DataFrame, cluster: str, sequence: str, weight: str, most: int = 10) -> DataFrame:
    """cluster, oligo, ambiguous, n_covered, weight, library, proved."""

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{cluster: k[0], **cover(*_cluster(f, sequence, weight), most)}])

    kind = df.schema[cluster].dataType.simpleString()
    return df.groupBy(cluster).applyInPandas(run, f"{cluster} {kind}, oligo string, ambiguous int, n_covered int, weight double, library double, proved boolean")


def split_clusters(df: DataFrame, cluster: str, sequence: str, weight: str, parts: int, least: int, budget: int | None = None, most_junk: float = 0.8) -> DataFrame:
    """cluster, parts, cuts, n_covered, weight, library, n_oligos, proved: cut placement, then the choice of cores under a budget or a share of junk."""

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        seqs, weights = _cluster(f, sequence, weight)
        cuts = place_cuts(seqs, parts, least)
        if cuts is None:
            return pd.DataFrame(columns=names)
        p = pieces_of(seqs, cuts)
        r = under_budget(p, weights, budget) if budget else under_junk(p, weights, most_junk)
        return pd.DataFrame([{cluster: k[0], "parts": parts, "cuts": cuts, **{x: r[x] for x in names[3:]}}])

    names = [cluster, "parts", "cuts", "n_covered", "weight", "library", "n_oligos", "proved"]
    kind = df.schema[cluster].dataType.simpleString()
    return df.groupBy(cluster).applyInPandas(run, f"{cluster} {kind}, parts int, cuts array<int>, n_covered int, weight double, library long, n_oligos int, proved boolean")


def combined_clusters(df: DataFrame, cluster: str, sequence: str, weight: str, parts: int, least: int, budget: int, most: int) -> DataFrame:
    """cluster, part, oligo, pieces: the degenerate oligos that make the cores chosen under the budget."""

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{cluster: k[0], **r} for r in combined(*_cluster(f, sequence, weight), parts, least, budget, most)], columns=[cluster, "part", "oligo", "pieces"])

    kind = df.schema[cluster].dataType.simpleString()
    return df.groupBy(cluster).applyInPandas(run, f"{cluster} {kind}, part int, oligo string, pieces array<string>")


def recommended(sweep: DataFrame, cluster: str) -> DataFrame:
    """For each cluster the number of parts with most weight for each oligo, the fewest oligos of equals."""
    per = F.try_divide(F.col("weight"), F.col("n_oligos").cast("double"))
    return sweep.groupBy(cluster).agg(F.max_by(F.struct("parts", "weight", "n_oligos"), F.struct(per, -F.col("n_oligos"))).alias("r")).select(cluster, "r.*")
