import hashlib

import pytest
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators import audit as A
from amrspark.operators import decide as D
from amrspark.operators import features as FE

CALL = (
    "genome_id string, gene string, is_amr boolean, is_point boolean, is_disrupt boolean, "
    "hit_count long, method string, drug_class string, drug_subclass string, "
    "partial_end boolean, unmapped boolean"
)


def calls_df(spark, rows):
    full = []
    for genome, gene, kind, *sub in rows:
        amr, point, dis = kind == "gene", kind in ("point", "disrupt"), kind == "disrupt"
        s = sub[0] if sub else None
        full.append((genome, gene, amr, point, dis, int(amr), "EXACTX" if amr else None, s, s, False, amr and s is None))
    return spark.createDataFrame(full, CALL)


def genomes_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "genome_id string")


def gates(spark, genome_rows, *ids):
    calls = calls_df(spark, genome_rows)
    gated = D.gate(FE.mechanism_hits(calls, genomes_of(spark, *ids)), (*fixed.PANEL, "colistin"))
    return {(r["genome_id"], r["antibiotic"]): r for r in gated.collect()}


def test_gate_rules(spark):
    got = gates(
        spark,
        [
            ("kpc", "blaKPC-2", "gene", "CARBAPENEM"), ("kpc", "ompK36_fs", "disrupt"),
            ("esbl", "blaCTX-M-15", "gene", "CEPHALOSPORIN"),
            ("narrow", "blaSHV-11", "gene", "BETA-LACTAM"),
            ("mixed", "blaSHV-12", "gene", "CEFIDEROCOL/CEPHALOSPORIN"),
            ("two", "parC_S80I", "point"), ("two", "gyrA-D87N", "point"), ("two", "qnrB1", "gene"),
            ("one", "gyrA_S83Y", "point"),
            ("pair", "gyrA_S83Y", "point"), ("pair", "oqxB", "gene"), ("pair", "aac(6')-Ib-cr5", "gene"),
            ("pmqr", "qnrS1", "gene"),
            ("rmt", "armA", "gene", "GENTAMICIN"), ("ame", "aac(3)-IIa", "gene", "GENTAMICIN"),
            ("porin", "ompK35_fs", "disrupt"),
            ("folate", "sul1", "gene"), ("folate", "dfrA12", "gene"),
        ],
        "kpc", "esbl", "narrow", "mixed", "two", "one", "pair", "pmqr", "rmt", "ame", "porin", "folate", "none",
    )
    fired = {k: r["rule"] for k, r in got.items() if r["gate_fired"]}
    assert fired == {
        ("kpc", "meropenem"): "carbapenemase_present",
        ("kpc", "ceftriaxone"): "esbl_ampc_or_carbapenemase_present",
        ("esbl", "ceftriaxone"): "esbl_ampc_or_carbapenemase_present",
        ("two", "ciprofloxacin"): "qrdr_double_mutation",
        ("pair", "ciprofloxacin"): "qrdr_plus_pmqr",
        ("rmt", "gentamicin"): "16s_rmtase_present",
        ("folate", "trimethoprim-sulfamethoxazole"): "sul_or_dfr_present",
    }
    assert got[("pair", "ciprofloxacin")]["matched_genes"] == ["gyrA_S83Y", "aac(6')-Ib-cr5", "oqxB"]
    assert got[("folate", "trimethoprim-sulfamethoxazole")]["matched_genes"] == ["sul1", "dfrA12"]
    assert got[("kpc", "meropenem")]["subclass_citations"] == ["blaKPC-2 (AMRFinderPlus Subclass=CARBAPENEM)"]
    assert got[("none", "colistin")]["target_present"] is None
    assert got[("none", "meropenem")]["target_present"] is True
    assert all(r["forced_verdict"] in (None, "likely_to_fail") for r in got.values())


def test_engineered_and_vocabulary(spark):
    rows = [
        ("a", "blaKPC-2", "gene", "CARBAPENEM"), ("a", "qnrB1", "gene"), ("a", "armA", "gene"),
        ("a", "sul1", "gene"), ("a", "gyrA_S83Y", "point"), ("a", "parC_S80I", "point"),
        ("a", "ompK36_fs", "disrupt"), ("b", "qnrB1", "gene"), ("b", "sul1", "point"),
    ]
    calls, genomes = calls_df(spark, rows), genomes_of(spark, "a", "b", "c")
    wide = FE.engineered(calls, genomes)
    a = wide.where("genome_id = 'a'").first()
    assert [a[n] for n in fixed.ENGINEERED] == [2.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0]
    assert [wide.where("genome_id = 'c'").first()[n] for n in fixed.ENGINEERED] == [0.0] * 9
    vocab = FE.vocabulary(calls)
    names = FE.feature_names(vocab)
    assert names == ["armA", "blaKPC-2", "qnrB1", "sul1", "gyrA_S83Y", "ompK36_fs", "parC_S80I", *fixed.ENGINEERED]
    assert [(r["idx"], r["feature"]) for r in vocab.orderBy("idx").collect()] == list(enumerate(names))
    assert [r["kind"] for r in vocab.orderBy("idx").collect()] == ["gene"] * 4 + ["mutation"] * 3 + ["engineered"] * 9
    digest = FE.vocabulary_digest(vocab).first()
    assert (digest["n_features"], digest["sha256"]) == (16, hashlib.sha256("\n".join(names).encode()).hexdigest())
    assert FE.feature_names(FE.vocabulary(calls.limit(0))) == list(fixed.ENGINEERED)
    with pytest.raises(ValueError, match="at most 3"):
        FE.feature_names(vocab, 3)
    vectors = {r["genome_id"]: r["features"].toArray().tolist() for r in FE.matrix_vectors(calls, wide, names).collect()}
    assert vectors["b"] == [0, 0, 1, 1, 0, 0, 0] + [0, 1, 0, 0, 0, 0, 0 + 0, 0, 0]
    assert vectors["c"] == [0.0] * 16
    small = FE.vocabulary(calls.where("genome_id = 'b'"))
    oov = {r["genome_id"]: r["oov"] for r in FE.unknown_counts(calls, genomes, small).collect()}
    assert oov == {"a": 5, "b": 0, "c": 0}


@pytest.fixture
def world(spark):
    """One driver (+3), one protector (-2); a genome per wanted probability."""
    ids = ("hi", "lo", "mid", "bare")
    rows = [(g, "driverGene", "gene") for g in ("hi", "mid")] + [("lo", "protectiveGene", "gene")]
    mech = FE.mechanism_hits(calls_df(spark, rows), genomes_of(spark, *ids))
    coefs = spark.createDataFrame(
        [("gentamicin", "driverGene", 3.0), ("gentamicin", "protectiveGene", -2.0)],
        "antibiotic string, feature string, coefficient double",
    )
    present = spark.createDataFrame([(g, f, 1.0) for g, f, _ in rows], "genome_id string, feature string, value double")
    scores = spark.createDataFrame(
        [("hi", "gentamicin", 0.95), ("lo", "gentamicin", 0.05), ("mid", "gentamicin", 0.5), ("bare", "gentamicin", 0.04)],
        "genome_id string, antibiotic string, p double",
    )
    return mech, scores, D.top_contributions(D.contributions(present, coefs, ("gentamicin",)))


def model_rows(spark, tau, guarantee=True):
    return spark.createDataFrame(
        [("gentamicin", "v3", 0.1, tau, tau, guarantee)],
        "antibiotic string, version string, alpha double, tau_s double, tau_r double, guarantee boolean",
    )


def run(spark, world, tau, guarantee=True):
    mech, scores, tops = world
    out = D.verdicts(D.gate(mech), model_rows(spark, tau, guarantee), scores, tops)
    assert D.violations(out).count() == 0
    return {(r["genome_id"], r["antibiotic"]): r for r in out.collect()}


def test_model_verdicts(spark, world):
    got = run(spark, world, 0.6)
    hi, lo, mid, bare = (got[(g, "gentamicin")] for g in ("hi", "lo", "mid", "bare"))
    assert (hi["verdict"], hi["confidence"], hi["category"]) == ("likely_to_fail", 0.95, "statistical_association")
    assert hi["supporting_features"][0] == "driverGene (LR weight +3.00 toward resistance)"
    assert hi["evidence"][0]["source"] == "per-drug L2 logistic regression (v3); calibrated p(resistant)=0.950"
    assert (lo["verdict"], lo["confidence"]) == ("likely_to_work", 0.95)
    assert lo["supporting_features"][:2] == [
        "protectiveGene (LR weight -2.00 toward susceptibility)",
        "no known gentamicin-resistance determinants detected",
    ]
    assert (mid["verdict"], mid["set_labels"], mid["category"]) == ("no_call", ["S", "R"], "statistical_association")
    assert "ambiguous at alpha=0.1" in mid["supporting_features"][-1]
    assert bare["supporting_features"][0].startswith("no known gentamicin")
    other = got[("hi", "meropenem")]
    assert (other["verdict"], other["category"], other["confidence"], other["set_labels"]) == ("no_call", "no_signal", 0.0, None)
    assert "no trained model for 'meropenem'" in other["evidence"][0]["description"]


def test_empty_set_and_caveat(spark, world):
    mid = run(spark, world, 0.3)[("mid", "gentamicin")]
    assert (mid["verdict"], mid["category"], mid["set_labels"], mid["supporting_features"]) == ("no_call", "no_signal", [], [])
    hi = run(spark, world, 0.6, guarantee=False)[("hi", "gentamicin")]
    assert "UNAVAILABLE for gentamicin" in hi["supporting_features"][0]


def report(spark, world, tau=0.6):
    mech, scores, tops = world
    return D.report_rows(D.gate(mech), D.known_evidence(mech), model_rows(spark, tau), scores, tops)


def test_paths_agree_and_disagreement_is_seen(spark, world):
    mech, scores, tops = world
    rows = D.verdicts(D.gate(mech), model_rows(spark, 0.6), scores, tops)
    rep = report(spark, world)
    assert D.reconcile(rows, rep).count() == 0
    changed = rep.withColumn("verdict", F.when(F.col("genome_id") == "hi", "no_call").otherwise(F.col("verdict")))
    assert D.reconcile(rows, changed).count() > 0


def test_known_evidence_wording_and_priority(spark):
    calls = calls_df(
        spark,
        [("g", "aac(3)-IIa", "gene", "GENTAMICIN"), ("g", "ompK36_fs", "disrupt"), ("g", "aac(6')-Ib-cr", "gene", None)],
    )
    mech = FE.mechanism_hits(calls, genomes_of(spark, "g"))
    known = {r["antibiotic"]: r for r in D.known_evidence(mech).collect()}
    assert known["gentamicin"]["known_names"] == ["aac(3)-IIa", "aac(6')-Ib-cr"]
    assert known["meropenem"]["known_items"][0]["source"] == "ompK36_fs (AMRFinderPlus point mutation)"
    assert known["ciprofloxacin"]["known_items"][0]["source"].endswith("Subclass=unknown)")
    gated = {r["antibiotic"]: r["gate_fired"] for r in D.gate(mech).collect()}
    assert not any(gated.values())


def test_violations_named(spark, world):
    rep = report(spark, world)
    bad = rep.withColumns(
        {
            "verdict": F.when(F.col("genome_id") == "hi", "likely_to_work").otherwise(F.col("verdict")),
            "disclaimer": F.when(F.col("genome_id") == "lo", "trust me").otherwise(fixed.DISCLAIMER),
        }
    )
    broken = {r["broken"] for r in D.violations(bad).collect()}
    assert broken == {"verdict_of_set", "disclaimer_text"}


def test_narrative_and_badges(spark, world):
    rep = report(spark, world)
    text = {r["genome_id"]: r["narrative"] for r in D.narratives(rep).collect()}
    lines = text["hi"].split("\n")
    assert lines[0] == "Genome hi — per-antibiotic decision support."
    assert lines[-1] == fixed.DISCLAIMER
    assert [ln.split(":")[0] for ln in lines[1:-1]] == list(fixed.PANEL)
    assert lines[4].startswith(
        "gentamicin: LIKELY TO FAIL (confidence 95%, statistical association (not a confirmed mechanism))."
    )
    assert lines[1] == "meropenem: NO CALL (confidence 0%, no resistance signal detected)."
    b = D.badges(rep).where("genome_id = 'hi' and antibiotic = 'gentamicin'").first()
    assert (b["label"], b["color"], b["confidence_pct"], b["badge"]) == ("BLOCK", "red", 95.0, "STATISTICAL SIGNAL")


def test_compatibility(spark):
    vectors = spark.createDataFrame(
        [("a", "db1", "1.0.0"), ("b", "db0", "1.0.0"), ("c", "db1", "0.9"), ("d", None, "1.0.0")],
        "genome_id string, db_version string, schema_version string",
    )

    def registry(*v):
        return spark.createDataFrame([v], "db_version string, schema_version string, engineered_version string")

    ok, bad = D.compatible(vectors, registry("db1", "1.0.0", "1"))
    assert [r["genome_id"] for r in ok.collect()] == ["a"]
    assert {r["genome_id"]: r["mismatch"] for r in bad.collect()} == {"b": "db_version", "c": "schema_version", "d": "db_version"}
    ok, _ = D.compatible(vectors, registry(None, None, None))
    assert ok.count() == 4
    _, bad = D.compatible(vectors, registry(None, None, "2"))
    assert bad.count() == 4
    with pytest.raises(D.CompatibilityError):
        D.require_compatible(vectors, registry("db1", None, None))


NARR = (
    "genome_id string, summary string, "
    "per_antibiotic array<struct<antibiotic:string,narrative:string,citations:array<string>>>, "
    "caveats array<string>"
)


@pytest.mark.parametrize(
    "summary, drug, told, caveats, rule",
    [
        ("Overview.", "gentamicin", "Likely to fail with confidence 95%.", [], None),
        ("Overview.", "gentamicin", "Confidence 94%.", [], "percent_not_of_drug"),
        ("Overview.", "gentamicin", "Seen 1234 times.", [], "number_not_of_drug"),
        ("Overview.", "gentamicin", "95\n% of cases", [], None),
        ("About 77%.", "gentamicin", "Fails.", [], "percent_not_in_report"),
        ("About 77.", "gentamicin", "Fails.", [], "number_not_in_report"),
        ("Overview.", "colistin", "Fails.", [], "drug_not_evaluated"),
        ("Overview.", "gentamicin", "Unlike meropenem it fails.", [], "names_other_drug"),
        ("Overview.", "gentamicin", "It is likely to work.", [], "other_verdict"),
        ("Overview.", "gentamicin", "No callback needed.", [], None),
        ("Overview.", "gentamicin", "The gene confers resistance.", [], "causal_without_mechanism"),
        ("All are likely to fail.", "gentamicin", "Fails.", [], "verdict_in_free_text"),
        ("This causes resistance.", "gentamicin", "Fails.", [], "causal_in_free_text"),
        ("Overview.", "gentamicin", "Fails.", ["A no call remains."], "verdict_in_free_text"),
    ],
)
def test_grounding(spark, world, summary, drug, told, caveats, rule):
    df = spark.createDataFrame([("hi", summary, [(drug, told, [])], caveats)], NARR)
    got = A.grounding(df, report(spark, world)).first()
    assert (got["rule"], got["passed"]) == (rule, rule is None)


def test_cited_chunks_allow_their_numbers(spark, world):
    df = spark.createDataFrame([("hi", "Overview.", [("gentamicin", "See type 48.", [])], [])], NARR)
    chunks = spark.createDataFrame([("hi", "gentamicin", "type 48 enzyme")], "genome_id string, antibiotic string, text string")
    assert A.grounding(df, report(spark, world)).first()["rule"] == "number_not_of_drug"
    assert A.grounding(df, report(spark, world), chunks).first()["passed"]


def test_narrative_of_an_unreported_genome_fails(spark, world):
    df = spark.createDataFrame([("nobody", "All fine, 12%.", [("gentamicin", "Works.", [])], [])], NARR)
    got = A.grounding(df, report(spark, world)).collect()
    assert [(r["rule"], r["passed"]) for r in got] == [("genome_not_reported", False)]
    assert A.ungrounded_percents(A.flatten(df), report(spark, world)).first()["percents"] == ["12"]


def test_published_text(spark, world):
    caveats = [
        "Confirm every result with laboratory testing.",
        "The allele could not be confirmed -- laboratory re-testing advised.",
    ]
    df = spark.createDataFrame([("hi", "Sum.", [("gentamicin", "Fails 95%.", [])], caveats)], NARR)
    out = A.flatten(df)
    assert out.first()["published"] == "\n".join(["Sum.", "gentamicin: Fails 95%.", caveats[1], fixed.DISCLAIMER])
    assert A.ungrounded_percents(out, report(spark, world)).count() == 0
    wrong = A.flatten(df.withColumn("summary", F.lit("Sum 12%.")))
    assert A.ungrounded_percents(wrong, report(spark, world)).first()["percents"] == ["12"]


def test_scores_do_not_depend_on_the_order_of_features(spark):
    """Weights that cancel give exactly one half; beyond the range of decimals the sum stays a double."""
    from itertools import permutations

    weights = {"a": 100.1, "b": 200.2, "c": -300.3, "d": 1e30, "e": float("inf")}
    coefficients = spark.createDataFrame([("x", f, w) for f, w in weights.items()], "antibiotic string, feature string, coefficient double")
    models = spark.createDataFrame([("x", 0.0, 1.0, 0.0)], "antibiotic string, intercept double, platt_a double, platt_b double")
    orders = list(permutations("abc")) + [("a", "d"), ("a", "e")]
    rows = [("-".join(o), f, 1.0) for o in orders for f in o]
    present = spark.createDataFrame(rows, "genome_id string, feature string, value double").coalesce(1)
    out = D.linear_scores(present, coefficients, models, present.select("genome_id"), ("x",))
    got = {r["genome_id"]: r["p"] for r in out.collect()}
    assert got == {"-".join(o): 0.5 for o in permutations("abc")} | {"a-d": 1.0, "a-e": 1.0}
