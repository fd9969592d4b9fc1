import random

import pytest
from pyspark.sql import functions as F

from amrspark.operators import groups as G
from amrspark.operators import subset as S


def cohort(spark, rows):
    return spark.createDataFrame(rows, "drug string, genome_id string, y string, grp string")


def test_split_is_a_group_disjoint_partition(spark):
    rows = [("d", f"g{i:03d}", "R" if i % 5 % 2 == 0 else "S", f"st{i // 5:02d}") for i in range(80)]
    df = cohort(spark, rows)
    split, status = G.make_split(df, ["drug"])
    got = split.collect()
    assert sorted(r["genome_id"] for r in got) == sorted(r[1] for r in rows)
    assert {r["split"] for r in got} == {"train", "calibration", "test", "holdout"}
    owner = {}
    for r in got:
        assert owner.setdefault(r["grp"], r["split"]) == r["split"]
    assert status.first()["reason"] is None
    assert G.leaking_groups(split, ["drug"]).count() == 0
    G.require_no_leakage(split, ["drug"])
    again, _ = G.make_split(df, ["drug"])
    assert {r["genome_id"]: r["split"] for r in again.collect()} == {r["genome_id"]: r["split"] for r in got}


def test_leakage_raises(spark):
    df = spark.createDataFrame([("d", "a", "train"), ("d", "a", "test")], "drug string, grp string, split string")
    with pytest.raises(G.LeakageError):
        G.require_no_leakage(df, ["drug"])


def test_too_few_and_too_clonal(spark):
    few = [("few", f"g{i}", "R" if i < 25 else "S", f"s{i}") for i in range(30)]
    clonal = [("clonal", f"c{i}", "R" if i < 20 else "S", f"t{i % 2}") for i in range(40)]
    split, status = G.make_split(cohort(spark, few + clonal), ["drug"])
    reasons = {r["drug"]: r["reason"] for r in status.collect()}
    assert reasons["few"].startswith("insufficient data: need >=20 R and >=20 S, have 25 R / 5 S")
    assert "2 distinct group(s) < 4" in reasons["clonal"]
    assert split.count() == 0


def test_holdout_choice(spark):
    rows = [("d", f"a{i}", "R", "big") for i in range(9)]
    rows += [("d", f"b{i}", "RS"[i % 2], "mixed2") for i in range(4)]
    rows += [("d", f"c{i}", "RS"[i % 2], "mixed1") for i in range(4)]
    got = G.holdout_group(cohort(spark, rows), ["drug"]).first()
    assert (got["holdout_group"], got["n"]) == ("mixed1", 4)


def test_folds_are_even_and_degraded_folds_reported(spark):
    rows = [("d", f"g{i}", "RS"[i % 2], f"s{i // 4}") for i in range(400)]
    # A dominant clone holding a third of all rows.
    rows += [("d", f"h{i}", "RS"[i % 2], "clone") for i in range(200)]
    folds = G.grouped_folds(cohort(spark, rows), ["drug"])
    balance = G.fold_balance(folds, ["drug"]).collect()
    assert len(balance) == 5 and not any(b["degraded"] for b in balance)
    assert sum(b["n_test"] for b in balance) == 600
    rest = sorted(b["n_test"] for b in balance)[:-1]
    assert max(rest) - min(rest) <= 60
    one = [("e", f"g{i}", "S", f"s{i}") for i in range(40)] + [("e", f"r{i}", "R", "clone") for i in range(30)]
    balance = G.fold_balance(G.grouped_folds(cohort(spark, one), ["drug"]), ["drug"]).collect()
    assert any(b["degraded"] for b in balance)


def test_fold_count_follows_rarer_class(spark):
    rows = [("d", f"g{i}", "R" if i < 3 else "S", f"s{i}") for i in range(30)]
    folds = G.grouped_folds(cohort(spark, rows), ["drug"])
    assert folds.agg(F.max("fold")).first()[0] <= 2


def brute_subset(cells, group, cap, target, group_cap):
    """The greedy rule over all candidates, without pruning."""
    filled, used, taken = {}, {}, []

    def take(g):
        taken.append(g)
        used[group[g]] = used.get(group[g], 0) + 1
        for c in cells[g]:
            filled[c] = filled.get(c, 0) + 1

    while len(taken) < cap:
        best, top = None, 0
        for g in sorted(cells):
            if g in taken or used.get(group[g], 0) >= group_cap:
                continue
            score = sum(filled.get(c, 0) < target for c in cells[g])
            if score > top:
                best, top = g, score
        if best is None:
            break
        take(best)
    order = sorted((g for g in cells if g not in taken), key=lambda g: (used.get(group[g], 0), g))
    for g in order:
        if len(taken) < cap and used.get(group[g], 0) < group_cap:
            take(g)
    return sorted(taken)


@pytest.mark.parametrize("seed", range(6))
def test_subset_equals_unpruned_greedy(spark, seed):
    rng = random.Random(seed)
    cap, target = rng.choice([5, 9, 14]), rng.choice([1, 2, 4])
    drugs = ("m", "g")
    group_of = {f"g{i:02d}": f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}" for i in range(40)}
    cells = {
        g: {f"{d}|{rng.choice('RS')}" for d in rng.sample(drugs, rng.choice([1, 1, 2]))} for g in group_of
    }
    binary = spark.createDataFrame(
        [(g, *c.split("|")) for g, cs in cells.items() for c in cs],
        "genome_id string, antibiotic string, sir_binary string",
    )
    groups = spark.createDataFrame(list(group_of.items()), "genome_id string, grp string")
    out = S.capped_subset(binary, groups, cap=cap, drugs=drugs, per_drug_target=target, max_group_fraction=0.3)
    got = sorted(r["genome_id"] for r in out.genomes.collect())
    assert got == brute_subset(cells, group_of, cap, target, max(1, int(0.3 * cap)))
    counts = {r["cell"]: r["n"] for r in out.cells.collect()}
    assert counts == {c: sum(c in cells[g] for g in got) for cs in cells.values() for c in cs}
    for r in out.drugs.collect():
        sides = [counts.get(f"{r['antibiotic']}|{s}", 0) for s in "RS"]
        assert r["met"] == (min(sides) >= target)


def test_subset_rejects_bad_cap(spark):
    empty = spark.createDataFrame([], "genome_id string, antibiotic string, sir_binary string")
    with pytest.raises(ValueError):
        S.capped_subset(empty, empty.selectExpr("genome_id", "antibiotic AS grp"), cap=0, drugs=("m",))
