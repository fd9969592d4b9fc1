import random

import pytest

from amrspark.llm import near_dedup
from amrspark.llm.near_dedup import group_chunks


def brute(rows, n, percent=80):
    """n_shingles and least id per row, by comparing all pairs of ids (smallest text of an id)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and None not in (rows[i][0], rows[j][0]):
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    least[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    return [(len(sets[i]), min(groups[root(i)]) if rows[i][0] is not None else None) for i in range(len(rows))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def cohort():
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 30, 150, 400]))]
        for _ in range(8):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, max(1, len(base) // 30) + 1))))
    passage = [f"p{i}" for i in range(60)]
    for _ in range(40):  # a passage in many otherwise different texts
        rows.append(" ".join([f"w{rng.randrange(4000)}" for _ in range(90)] + passage))
    rows += ["", None, "One", "one", "a b c", "A  B\tc", "x\u00a0y z", "x y z"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows), (None, "one"), (None, "one")]


@pytest.mark.parametrize("words", [4, 5])
def test_against_all_pairs(spark, words):
    rows = cohort()
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "chunk_id int, text string, signature string, n int")
    got = group_chunks(df.repartition(3), words=words).collect()
    want = sorted((str(k), n, str(c), k is None or k == c) for (k, _), (n, c) in zip(rows, brute(rows, words)))
    assert sorted((str(r.chunk_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want


def test_blocks_find_what_pivots_miss(spark, monkeypatch):
    """A chain of links in one large bucket, compared in several blocks."""
    monkeypatch.setattr(near_dedup, "_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 4))) for i in range(90)]
    df = spark.createDataFrame(rows, "chunk_id int, text string")
    got = {r.chunk_id: r.component_id for r in group_chunks(df, words=4).collect()}
    assert got == {k: c for (k, _), (_, c) in zip(rows, brute(rows, 4))}


def test_string_ids_repeats_and_empty_table(spark):
    rows = [("b", "w " * 9 + "x"), ("a", "w " * 9 + "x"), ("a", "w " * 9 + "x"), ("c", "other words here now")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = sorted((r.chunk_id, r.component_id, r.kept) for r in group_chunks(df).collect())
    assert got == [("a", "a", True), ("a", "a", True), ("b", "a", False), ("c", "c", True)]
    assert group_chunks(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "w0 w1 w2 w3 w4 w5")], "chunk_id int, text string")
    assert sorted((r.chunk_id, r.component_id) for r in group_chunks(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_blocks_emit_few_pairs_of_texts_that_are_similar_but_not_linked(spark, monkeypatch):
    """Texts of one base that are mostly 0.72 to 0.79 alike: all pairs once went to confirmation."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in range(6 + i % 3, 400, 50):
            words[at] = f"x{i}.{rng.random()}"
        rows.append((i, " ".join(words)))
    sent, confirmed = [], near_dedup._confirmed

    def counted(texts, pairs, *rest):
        sent.append(pairs.count())
        return confirmed(texts, pairs, *rest)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    df = spark.createDataFrame(rows, "chunk_id int, text string")
    got = {r.chunk_id: r.component_id for r in group_chunks(df, words=4, percent=88).collect()}
    assert got == {k: c for (k, _), (_, c) in zip(rows, brute(rows, 4, 88))}
    assert sum(sent[near_dedup.STAR_ROUNDS :]) < 60


def test_least_hashes_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, common in ((5, 5), (9, 8), (1500, 1334), (2048, 1821), (6000, 5340), (2300, 2045)):
        a = rng.integers(0, 1 << 32, 2 * n - common, np.uint32)
        x, y = np.unique(a[:n])[: near_dedup.LEAST], np.unique(a[n - common :])[: near_dedup.LEAST]
        assert near_dedup._may_link(x, n, y, n, 80)
    far = rng.integers(0, 1 << 32, (2, 5000), np.uint32)
    assert not near_dedup._may_link(np.unique(far[0])[:2048], 5000, np.unique(far[1])[:2048], 5000, 80)
    # Two shingles of one hash in a set still count as common.
    same = np.arange(8, dtype=np.uint32)
    assert near_dedup._may_link(same[:7], 8, same, 9, 80)
