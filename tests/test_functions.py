import random
import time

import pytest
from pyspark.sql import functions as F

from loomwell.functions import nulls, schemas, texts
from loomwell.functions import scalars as S
from loomwell.functions import sequences as Q
from loomwell.operators import lifecycle


def values(spark, kind, rows, *columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {kind}")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_coercion(spark):
    c = F.col("c")
    assert values(spark, "c string", ["Yes", "no", "YES", None], S.yes_no(c)) == [True, False, None, None]
    assert values(spark, "c string", ["1.5", "x", None], S.number(c)) == [1.5, None, None]
    assert values(spark, "c string", ["12345678901", "", None], S.longer_than(c, 10)) == [True, False, False]
    assert values(spark, "c string", ["a", "", None], S.filled(c)) == [True, False, False]
    assert values(spark, "c boolean", [True, False, None], nulls.not_or_true(c)) == [False, True, False]


def test_scores(six):
    score = S.evidence_score(*[F.col(c) for c in ("has_sequence", "has_genbank", "has_enzyme", "analytical_grade", "extrapolated_from_enzyme")])
    rows = six.select(score.alias("s")).withColumn("t", S.evidence_tier(F.col("s"))).collect()
    assert [r["s"] for r in rows] == [100, 100, 0, 100, 0, 100]
    assert [r["t"] for r in rows] == ["Excellent", "Excellent", "Low", "Excellent", "Low", "Excellent"]


def test_tier_edges(spark):
    assert values(spark, "c int", [0, 20, 21, 50, 80, 81], S.evidence_tier(F.col("c"))) == ["Low", "Low", "Medium", "Medium", "High", "Excellent"]


def test_gap_score_without_organisms(spark):
    assert values(spark, "c int", [0], S.gap_score(F.col("c"), F.lit(0.5), F.lit(None).cast("double"))) == [None]


def test_words_and_categories(spark):
    g, s = S.genus_species(F.col("c"))
    assert values(spark, "c string", ["Ideonella sakaiensis 201", "Éscherichia coli", "one", None], g, s) == [("Ideonella", "sakaiensis"), ("Éscherichia", "coli"), (None, None), (None, None)]
    groups = {"a": ["PET", "PE"], "b": ["PET", "PU"]}
    assert values(spark, "c string", ["PET", "PU", "x", None], S.first_match(F.col("c"), groups)) == ["a", "b", "Other", "Unknown"]


def test_ranges(spark):
    r = S.range_or_value(F.col("c"))
    got = values(spark, "c string", ["10-45; 30", "4.5 - 5", "x; 7", "x", "", None], r["optimum"], r["low"], r["high"])
    assert got == [(30.0, 10.0, 45.0), (4.75, 4.5, 5.0), (7.0, 7.0, 7.0), (None, None, None), (None, None, None), (None, None, None)]


def test_accessions(spark):
    clean = S.clean_accession(F.col("c"))
    got = values(spark, "c string", ["WP_305403363.1", "P12345", "AVI23960.2", "CAA12345", "1abc_A", "?"], clean, S.accession_kind(clean))
    assert [k for _, k in got] == ["refseq", "uniprot", "genbank", "genbank", "pdb", "other"]
    assert got[4][0] == "1abc"
    h = S.bar_header(F.col("c"))
    assert values(spark, "c string", ["7|ADK1.1|||/77"], h["orf_id"], h["genbank_accession"], h["orf_start"], h["orf_type"]) == [(7, "ADK1.1", None, None)]


def test_masks(spark):
    m = S.label_mask(F.col("c"), S.LOCALIZATION)
    assert values(spark, "c string", ["Cytoplasm;Nucleus", "ER|Golgi body", "", "Peroxisome"], m) == [3, 160, 0, 512]


def test_mutations(spark):
    m = S.mutation(F.col("c"), F.lit("MACD"))
    got = values(spark, "c string", ["A2N", "C2N", "-5R", "G9-", "x", "---", "M1B", "-3-"], m["kind"], m["reason"])
    assert [r for _, r in got] == [None, "base differs", None, "outside base", "unparseable", "unparseable", "not encodable", "both sides are gaps"]
    assert got[2][0] == "ins"


def test_small_parsers(spark):
    assert values(spark, "c string", ["1.1k", "12", "n"], S.short_count(F.col("c"))) == [1100, 12, None]
    assert values(spark, "c string", [" Unsure ", None, "10.1/x"], S.doi_missing(F.col("c"))) == [True, True, False]
    assert values(spark, "c string", ["prot_tok__12", "a__x"], S.variant_label(F.col("c"))) == ["prot", "a__x"]
    assert values(spark, "c string", ["", "2021-10-01"], S.later_than(F.col("c"), "2021-09-30")) == [False, True]
    assert values(spark, "c string", ["Crème brûlée!"], S.slug(F.col("c"))) == ["creme_brulee"]


def test_sequences(spark):
    c = F.col("c")
    assert values(spark, "c string", ["acx*D", None], Q.clean(c)) == ["ACD", ""]
    assert values(spark, "c string", ["AAXX", ""], Q.invalid_share(c)) == [0.5, 1.0]
    assert values(spark, "c string", ["xxGASGGyy", "GXSXG"], Q.has_motif(c)) == [True, False]
    assert values(spark, "c string", ["GASA"], Q.has_motif(c)) == [False]
    assert values(spark, "c string", ["ABCABC", "AB", "AAA"], Q.kmers(c, 3)) == [["ABC", "BCA", "CAB"], [], ["AAA"]]
    assert abs(values(spark, "c string", ["GGGGGGGGGG"], Q.molecular_weight(c))[0] - (10 * 75.0666 - 9 * 18.0153)) < 1e-6
    p = Q.window_profile(c, 3)
    assert [round(x, 4) for x in values(spark, "c string", ["IIR"], p)[0]] == [4.5, 1.5, 0.0]
    assert values(spark, "c string", ["IIIIIIIIR", "II"], Q.best_window(c)) == [4.5, None]
    got = values(spark, "c string", ["KKKKKKKKKK", "DDDDDDDDDD"], Q.isoelectric_point(c))
    assert got[0] > 10 and got[1] < 4


def test_families(spark):
    f = Q.enzyme_family(F.col("n"), F.col("p"))
    assert values(spark, "n string, p string", [("IsPETase", "PET"), ("laccase", "PE"), ("thing", "PET"), (None, None)], f) == ["PETase / Cutinase", "Laccase / Oxidase", "Unknown", "Unknown"]


def test_permutation_keeps_residues(spark):
    got = values(spark, "c string", ["ACDEFGHIK", ""], Q.shuffled(F.col("c"), F.col("i"), 3))
    assert sorted(got[0]) == list("ACDEFGHIK") and got[1] == ""


def test_mature_slice(spark):
    m = Q.mature_slice(F.col("c"), F.col("p"))
    got = values(spark, "c string, p int", [("ABCDE", 2), ("ABCDE", 5), ("ABCDE", None)], m["mature"], m["is_mature"], m["degenerate"])
    assert got == [("CDE", True, False), ("ABCDE", False, True), ("ABCDE", False, False)]


def test_evidence_of_a_long_text(spark):
    """The work grows with the text, not with the window: windows taken one by one would split its 20,000 words anew for each."""
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    wanted = " ".join(f"w{i}" for i in range(0, 5000, 10))
    began = time.perf_counter()
    assert values(spark, "e string, t string", [(wanted, long)], texts.evidence_status(F.col("e"), F.col("t"))) == ["NO_MATCH_FOUND"]
    assert time.perf_counter() - began < 30


def test_evidence(spark):
    long = " ".join(f"w{i}" for i in range(80))
    s = texts.evidence_status(F.col("e"), F.col("t"))
    got = values(spark, "e string, t string", [("w3 w4 w5 zz", long), ("w1 w2", "w1 w2"), ("NOT_FOUND", long), (None, long), ("...", long), ("a b c", long)], s)
    assert got == ["LEXICAL_MATCH", "NO_MATCH_FOUND", "NO_EVIDENCE_PROVIDED", "NO_EVIDENCE_PROVIDED", "EMPTY_TEXT", "NO_MATCH_FOUND"]
    assert values(spark, "e string, t string", [("w1 w2", "w1 w2")], texts.evidence_status(F.col("e"), F.col("t"), clip=True)) == ["LEXICAL_MATCH"]
    rng = random.Random(4)
    for window in (1, 3, 60):
        for _ in range(60):
            text, wanted = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(150))], [f"w{i}" for i in rng.sample(range(14), 5)]
            assert texts._most(wanted, text, window) == max((len(set(wanted) & set(text[i : i + window])) for i in range(len(text))), default=0)
    v = texts.value_in_evidence(F.col("v"), F.col("e"))
    assert values(spark, "v string, e string", [(None, "x"), ("not_found", "x"), ("37 C", "at 37 c"), ("5", None)], v) == [True, True, True, False]


def test_sections(spark):
    s = texts.section_of(F.col("c"), F.col("i") + 10)
    assert values(spark, "c string", ["1. Introduction", "12", "Copyright 2020", "x" * 300, "short one"], s) == ["Introduction", "Page_Number", "Journal_Metadata", "Body_Text", "Footer_or_Artifact"]


def test_links(spark):
    got = values(spark, "c string", ["Supplementary data: https://ex.org/data.zip. More", "https://ex.org/data.zip"], texts.links_near(F.col("c")))
    assert got == [["https://ex.org/data.zip"], []]


def test_rules(spark):
    df = spark.createDataFrame([(1, 0, 0.5, None), (2, 3, 1.5, 7), (3, 0, 0.1, 4)], "orf_id int, top_signal int, signal_prob double, cleavage_pos int")
    got = {r["rule"]: r["n"] for r in lifecycle.violations(df, schemas.SIGNAL_RULES).collect()}
    assert got == {"signal in 0 to 5": 0, "probability": 1, "no signal, no cleavage": 1}


def test_gates_and_indices(spark):
    from loomwell.functions import sequences as S

    df = spark.createDataFrame([("A" * 50, 0.1, 0.1), ("AB" * 30, 0.5, 0.1), ("ACD", None, 0.9)], "c string, low double, dis double")
    g = S.quality_gates(F.col("c"), F.col("low"), F.col("dis"))
    assert [tuple(r) for r in df.select(g["passes"], g["reasons"]).collect()] == [(True, ""), (False, "invalid_residues;low_complexity"), (False, "too_short;low_complexity;disorder")]
    one = spark.createDataFrame([("AACAA",)], "c string")
    r = one.select(S.instability_index(F.col("c"), {"AA": 2.0, "AC": 5.0}).alias("i"), S.masked_share(F.lit("aaCC")).alias("m"), S.motif_contexts(F.col("c"), "A", 1).alias("x"), S.random_sequence(F.lit(9), F.lit("k")).alias("r"), S.resampled(F.col("c"), F.lit("k")).alias("s")).first()
    assert r["i"] == pytest.approx(10 / 5 * 9.0) and r["m"] == 0.5 and r["x"] == ["AA", "AAC", "CAA", "AA"]
    assert len(r["r"]) == 9 and set(r["r"]) <= set(S.AMINO) and len(r["s"]) == 5 and set(r["s"]) <= set("AC")
