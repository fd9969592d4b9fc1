import pytest
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators import labels as L
from amrspark.sources import tables

LAB, COMP, PANEL = "Laboratory Method", "Computational Method", "AMR Panel"
BASE = {
    "genome_name": "isolate", "taxon_id": "573", "evidence": LAB, "laboratory_typing_method": "MIC",
    "measurement": "<=0.25", "measurement_value": "0.25", "measurement_unit": "mg/L",
    "testing_standard": "CLSI", "testing_standard_year": "2015",
}


def raw_rows(spark, rows):
    full = []
    for genome, drug, phenotype, *extra in rows:
        row = {**BASE, "genome_id": genome, "antibiotic": drug, "resistant_phenotype": phenotype}
        row.update(extra[0] if extra else {})
        full.append(tuple(row[c] for c in fixed.TEST_COLUMNS))
    schema = ", ".join(f"{c} string" for c in fixed.TEST_COLUMNS)
    return spark.createDataFrame(full, schema)


def resolve(spark, phenotypes):
    df = L.with_canonical(raw_rows(spark, [("g", "meropenem", p) for p in phenotypes]))
    resolved, dropped = L.majority_vote(df)
    return resolved.collect(), dropped.count()


@pytest.mark.parametrize(
    "phenotypes, winner, dropped",
    [
        (["R", "Resistant", "I"], ("Resistant", 3, 2), 0),
        (["R", "S"], None, 2),
        (["R", "R", "S", "I"], None, 4),
        (["I", "SDD"], None, 2),
        (["S", "S", "NS"], None, 3),
        (["R", "SDD"], None, 2),
        (["R", "NS", "NS"], ("Nonsusceptible", 3, 2), 0),
        (["S", "SDD", "Sensitive"], ("Susceptible", 3, 2), 0),
        ([None, "what", "R"], ("Resistant", 1, 1), 0),
        ([None], None, 0),
    ],
)
def test_vote(spark, phenotypes, winner, dropped):
    rows, lost = resolve(spark, phenotypes)
    assert lost == dropped
    if winner is None:
        assert rows == []
    else:
        r = rows[0]
        assert (r["sir"], r["sir_source_rows"], r["sir_n_agree"]) == winner
        assert r["sir_majority_fraction"] == winner[2] / winner[1]


def test_canonical_terms(spark):
    spellings = {
        "Sensitive": "Susceptible", " s ": "Susceptible", "I": "Intermediate",
        "Non-susceptible": "Nonsusceptible", "sdd": "Susceptible-dose dependent", "": None,
        "nan": None, "None": None, "odd": None, "R": "Resistant",
    }
    df = spark.createDataFrame([(k, v) for k, v in spellings.items()], "raw string, want string")
    for r in df.select("want", text.canonical_sir("raw").alias("got")).collect():
        assert r["got"] == r["want"]
    drugs = {
        "SXT": "trimethoprim-sulfamethoxazole", " TMP/SMX": "trimethoprim-sulfamethoxazole",
        "Meropenem ": "meropenem", None: "nan", "New Drug": "new drug",
    }
    df = spark.createDataFrame([(k, v) for k, v in drugs.items()], "raw string, want string")
    for r in df.select("want", text.canonical_drug("raw").alias("got")).collect():
        assert r["got"] == r["want"]


def test_numbers_and_signs(spark):
    df = spark.createDataFrame(
        [("<=0.25", "0.25"), (" >8", "8"), ("==2", " 1e2 "), ("0.5", "1d"), (None, ""), ("≥1", "0x1")],
        "m string, v string",
    )
    rows = df.select(text.mic_sign("m").alias("s"), text.number("v").alias("n")).collect()
    assert [r["s"] for r in rows] == ["<=", ">", "=", None, None, None]
    assert [r["n"] for r in rows] == [0.25, 8.0, 100.0, None, None, None]


def test_lab_filter(spark):
    df = raw_rows(
        spark,
        [
            ("a", "x", "R"),
            ("b", "x", "R", {"evidence": COMP}),
            ("c", "x", "R", {"evidence": PANEL}),
            ("d", "x", "R", {"laboratory_typing_method": "  "}),
            ("e", "x", "R", {"laboratory_typing_method": None}),
            ("f", "x", "R", {"evidence": None}),
        ],
    )
    assert [r["genome_id"] for r in L.lab_rows(df).collect()] == ["a"]
    assert L.lab_rows(df, require_typing_method=False).count() == 3
    assert L.lab_rows(df, (LAB, PANEL)).count() == 2
    counts = {r["value"]: r["n"] for r in L.value_counts(df, "evidence").collect()}
    assert counts == {LAB: 3, COMP: 1, PANEL: 1, "<blank>": 1}


def test_dominant_unit_median(spark):
    """The exact state and the spread path give the same medians."""
    rows = [
        ("g1", "m", "mg/L", 0.5, "<="), ("g1", "m", "mg/L", 1.0, "="), ("g1", "m", "mm", 20.0, None),
        ("g2", "m", "mm", 3.0, None), ("g2", "m", "mg/L", 1.0, ">"),
        ("g3", "m", "mg/L", None, ">"), ("g4", "m", None, 5.0, None),
        *[("g5", "m", "mg/L", float(v), None) for v in (4, 1, 2, 2, 8)],
    ]
    df = spark.createDataFrame(
        rows, "genome_id string, antibiotic string, unit string, value double, sign string"
    )
    got = {
        r["genome_id"]: (r["value"], r["sign"], r["unit"])
        for r in L.dominant_unit_median(df).collect()
    }
    assert got == {
        "g1": (0.75, "<=", "mg/L"),
        "g2": (1.0, ">", "mg/L"),
        "g3": (None, ">", "mg/L"),
        "g5": (2.0, None, "mg/L"),
    }


def test_label_table_and_reports(spark):
    df = raw_rows(
        spark,
        [
            ("1", "meropenem", "R"), ("1", "Meropenem", "R", {"measurement_value": "0.75"}),
            ("1", "meropenem", "I", {"testing_standard": "EUCAST", "testing_standard_year": "2019"}),
            ("2", "meropenem", "R"), ("2", "meropenem", "S"),
            ("3", "SXT", "S", {"testing_standard": None, "laboratory_typing_method": " Disk "}),
            ("3", "Trimethoprim/Sulfamethoxazole", "S", {"testing_standard_year": None}),
            ("4", "gentamicin", None),
            (None, "gentamicin", "R"),
        ],
    )
    working = L.with_canonical(L.lab_rows(df))
    labels = {(r["genome_id"], r["antibiotic"]): r for r in L.label_table(working).collect()}
    assert set(labels) == {("1", "meropenem"), ("3", "trimethoprim-sulfamethoxazole")}
    one = labels[("1", "meropenem")]
    assert (one["sir"], one["mic_value"], one["mic_sign"], one["mic_unit"]) == (
        "Resistant", 0.25, "<=", "mg/L",
    )
    assert (one["dominant_testing_standard"], one["testing_standard_year_min"], one["testing_standard_year_max"]) == ("CLSI", 2015, 2019)
    assert labels[("3", "trimethoprim-sulfamethoxazole")]["lab_typing_methods"] == "Disk;MIC"
    drugs = {r["antibiotic"]: r for r in L.drug_counts(working).collect()}
    assert (drugs["meropenem"]["resistant"], drugs["meropenem"]["total"]) == (3, 5)
    assert drugs["gentamicin"]["total"] == 2
    _, dropped = L.majority_vote(working)
    per = {r["antibiotic"]: r for r in L.manifest_per_drug(working, dropped).collect()}
    assert per["meropenem"]["dropped_conflict"] == 2
    assert per["trimethoprim-sulfamethoxazole"]["other_or_blank"] == 1
    counts = {
        r["metric"]: r["value"]
        for r in L.manifest_counts(df, L.lab_rows(df), working, L.label_table(working), dropped).collect()
    }
    assert counts["raw_rows"] == 9 and counts["dropped_uncanonical_sir"] == 1
    assert counts["labels_after_collapse"] == 2 and counts["unique_genomes"] == 2


def test_contract(spark):
    columns = ", ".join(f"{c} string" for c in fixed.LABEL_COLUMNS)
    good = spark.createDataFrame([tuple("x" if c != "sir" else "Resistant" for c in fixed.LABEL_COLUMNS)], columns)
    assert L.contract_violations(good).count() == 0
    assert L.contract_violations(good.withColumn("sir", F.lit("Maybe"))).count() == 1
    with pytest.raises(ValueError):
        L.contract_violations(good.drop("mic_value"))


def test_eligible_and_selected(spark):
    labels = spark.createDataFrame(
        [("a", "m"), ("b", "m"), ("a", "g"), (None, "m")], "genome_id string, antibiotic string"
    )
    assert sorted(r[0] for r in L.eligible_ids(labels, None, 2).collect()) == ["a", "b"]
    assert L.eligible_ids(labels, None, 3).count() == 0
    ids = L.selected_ids(labels.where("genome_id = 'b'"), labels.where("genome_id = 'a'"), 1)
    assert [r[0] for r in ids.collect()] == ["a"]


def test_read_tests_file(spark, tmp_path):
    head = "\t".join(c.replace("_", " ").title() if c == "genome_id" else c for c in fixed.TEST_COLUMNS)
    rows = [
        ["573.1", "K p", "573", "SXT", "R", LAB, "MIC", "<=1", "1", "mg/L", "CLSI", "2015"],
        ["573.2", "K p", "562", "SXT", "NA", LAB, "", "N/A", "1", "mg/L", "CLSI", "2015"],
    ]
    (tmp_path / "t.tsv").write_text("\n".join([head, *["\t".join(r) for r in rows]]) + "\n")
    df = tables.read_tests(spark, str(tmp_path / "t.tsv"), taxon_id=None)
    assert set(df.columns) == set(fixed.TEST_COLUMNS)
    second = df.where("genome_id = '573.2'").first()
    assert second["resistant_phenotype"] is None and second["measurement"] is None
    assert second["laboratory_typing_method"] is None
    assert tables.read_tests(spark, str(tmp_path / "t.tsv")).count() == 1
    (tmp_path / "bad.tsv").write_text("genome_id\tx\n1\t2\n")
    with pytest.raises(tables.TableFormatError):
        tables.read_tests(spark, str(tmp_path / "bad.tsv"))


def test_large_pairs_are_spread_with_the_same_result(spark):
    rows = [
        (f"g{k % 7}", "meropenem" if k % 3 else "SXT", "RRSI"[k % 4 if k % 7 < 2 else 0], {
            "measurement_value": None if k % 11 == 0 else str(k % 13 / 4),
            "measurement": ("<=", ">", "")[k % 5 % 3] + "1",
            "measurement_unit": ("mg/L", "mm", None)[k % 6 % 3],
            "testing_standard": ("CLSI", "EUCAST", None)[k % 8 % 3],
            "testing_standard_year": str(2000 + k % 9), "laboratory_typing_method": f"m{k % 4}",
        })
        for k in [*range(60), *range(0, 700, 7)]
    ]
    working = L.with_canonical(raw_rows(spark, rows))
    want = sorted(map(tuple, L.label_table(working).collect()), key=str)
    assert len(want) > 5 and len({r[:2] for r in want}) == len(want)
    small, large = L.by_size(working, L.KEYS, 20)
    assert small.count() and large.count() and small.count() + large.count() == working.count()
    for limit in (20, 0):
        assert sorted(map(tuple, L.label_table(working, rows_in_task=limit).collect()), key=str) == want
    tests = working.selectExpr("genome_id", "antibiotic", "measurement_unit unit", "cast(measurement_value as double) value", "measurement sign")
    want = sorted(map(tuple, L.dominant_unit_median(tests).collect()), key=str)
    assert sorted(map(tuple, L.dominant_unit_median(tests, rows_in_task=20).collect()), key=str) == want
