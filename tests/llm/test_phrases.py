import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from amrspark.llm import phrases

LAYOUT = "chunk_id long, text string, source string"


def brute(rows, max_words=3, min_count=10, percent=50, top=2000):
    """All phrases counted in one table per group."""
    counts, totals = {}, Counter()
    for _, text, group in rows:
        group = "und" if group is None else group
        own = counts.setdefault(group, Counter())
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[group] += len(words)
            for m in range(1, max_words + 1):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for group, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows_of = []
        for p, a in held.items():
            s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in held.items()
                if len(q) > len(p)
            )
            if not inside:
                rows_of.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((group, rank, p.decode(), -a, left, right, totals[group], -s))
    return sorted(out)


def found(spark, rows, **settings):
    got = phrases.mine_phrases(spark.createDataFrame(rows, LAYOUT), **settings)
    assert got.columns == ["source", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed, rows=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["blaKPC", "carbapenem", "é", "β-Lactam", "Porin"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = []
    for i in range(rows):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 30))
        if rng.random() < 0.2:
            words[3:3] = ["Outer", "membrane", "porin", "loss"]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". "]) for w in words)
        out.append((i, text, rng.choice(["card", "card", "card", None, "lab"])))
    return out


@pytest.mark.parametrize("settings", [{}, {"max_words": 3, "min_count": 5}, {"max_words": 2, "sample_in": 3, "top": 20}, {"sample_in": 1}])
def test_equals_brute(spark, settings):
    rows = corpus(1)
    own = {k: v for k, v in settings.items() if k != "sample_in"}
    want = brute(rows, **own)
    assert found(spark, rows, **settings) == want and len(want) > 20


def test_failures_of_the_border_reach_a_fixed_point(spark):
    """With a sample of nothing, words, pairs and triples are found by expansion passes alone."""
    rows = corpus(2)
    assert found(spark, rows, sample_in=1 << 30) == brute(rows)


def test_crowded_bit_tables_count_more_never_less(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_BITS", 64)
    rows = corpus(3, 120)
    assert found(spark, rows) == brute(rows)


def test_slices_and_tables_of_bounded_size(spark, monkeypatch):
    for name in ("_SLICE_BYTES", "_WORDS", "_HELD", "_PHRASES"):
        monkeypatch.setattr(phrases, name, 50)
    rows = corpus(4, 120)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c " * 20, "x"), (1, None, "x"), (1, "", "x"), (2, "a b", None), (3, " \t . ", "y"), (1, "a b c " * 20, "x")]
    rows += [(4, "q\x01r s\x01t " * 12, "z"), (5, "one two " * 40_000, "z"), (7, ("k" * 300 + " " + "k" * 299 + "j ") * 12, "z"), (6, "a b a b " * 3, "")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    clash = spark.createDataFrame(rows, LAYOUT).selectExpr("*", "1 AS g", "2 AS n", "3 AS phrase", "4 AS part")
    assert phrases.mine_phrases(clash).count() == len(brute(rows))


def test_words_of_one_hash_are_told_apart():
    text = b"abcdefgh1 abcdefgh2 x " + b"y" * 300 + b" " + b"y" * 299 + b"z x"
    part = next(phrases._slices(iter([pa.RecordBatch.from_pydict({"g": ["s"], "text": [text.decode()]})])))
    known = phrases._Words()
    assert len(np.unique(part.hashes())) == 5
    same = part.numbers(known, np.zeros(6, np.uint64), np.arange(6))
    assert [known.names[i] for i in same] == text.split()


def test_words_of_a_phrase(spark):
    with pytest.raises(ValueError):
        found(spark, [], max_words=4)


def test_products_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 4_000_000_009, 5_000_000_021
    counts = [("g", "", 10**12), ("g", "u", left), ("g", "v", right), ("g", "u v", a)]
    got = phrases._scored(spark.createDataFrame(counts, "g string, phrase string, n long"), 3, 50, 10).collect()
    assert [r.score for r in got] == [1000000 * a * a // (left * right)]
