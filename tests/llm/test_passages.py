import difflib
import random
import time

from amrspark.llm.passages import (
    _common, _near, _surrounder, align_chain, best_chains, join_matches, passages_of, shared_passages, winnow,
)

import numpy as np
import pyarrow as pa


def corpus():
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [text(51), text(70), text(200)]
    docs = []
    for k in range(40):
        words = text(rng.randrange(20, 300))
        if k % 2:
            p = list(passages[k % 3])
            if k % 5 == 1:  # small edits
                for _ in range(len(p) // 25):
                    p[rng.randrange(len(p))] = "edit"
                del p[len(p) // 2]
            at = rng.randrange(len(words))
            words[at:at] = p
        docs.append((k, " ".join(words)))
    for k in range(4):  # a word pair, again and again
        docs.append((60 + k, " ".join(text(30) + ["is", "of"] * (40 + k) + text(30))))
    line = text(12)
    docs += [(100 + k, " ".join(text(40) + line + text(40))) for k in range(30)]
    docs += [(200, docs[1][1].upper()), (201, docs[1][1]), (300, None), (301, ""), (302, "short text"), (None, docs[1][1])]
    return docs


def test_every_shared_window_is_covered(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 5) for d in docs], "chunk_id int, text string, start int")
    got = shared_passages(df.repartition(4)).collect()
    words = {k: (t or "").encode().lower().split() for k, t in docs if k is not None}
    seen = {}
    for k, w in words.items():
        for i in range(len(w) - 50):
            seen.setdefault(tuple(w[i : i + 51]), set()).add(k)
    covered = {}
    for r in got:
        covered.setdefault(r.chunk_id, set()).update(range(r.start, r.end))
        a = words[r.chunk_id][r.start : r.end]
        b = words[r.other_id][r.other_start : r.other_end]
        assert r.chunk_id != r.other_id and min(len(a), len(b)) >= 50
        assert r.n_equal >= 0.8 * max(len(a), len(b))
        match = difflib.SequenceMatcher(None, a, b, False).get_matching_blocks()
        assert r.n_equal >= sum(m.size for m in match) - 2
    for k, w in words.items():
        shared = [i for i in range(len(w) - 50) if len(seen[tuple(w[i : i + 51])]) > 1]
        missing = {j for i in shared for j in range(i, i + 51)} - covered.get(k, set())
        # A repetition is aligned from its start: the end of a longer one may stand over.
        assert not missing or (60 <= k < 64 and len(missing) <= 6)
    # Edited copies are found too; chunks with only a common line, or nothing, are not.
    # An edited copy of the 51 words may fall below 50.
    assert {k for k in range(40) if k % 2 and (k % 3 or k % 5 != 1)} <= set(covered)
    assert not any(k in covered for k in [*range(0, 40, 2), *range(100, 130), 300, 301, 302])
    assert {(r.chunk_id, r.other_id) for r in got} == {(r.other_id, r.chunk_id) for r in got}


def test_chains_keep_order():
    runs = join_matches([(x, y, 8) for x, y in ((0, 10), (4, 14), (30, 42), (60, 5), (9, 19))])
    assert runs == [(0, 10, 17), (30, 42, 8), (60, 5, 8)]
    chains = best_chains(runs)
    assert chains[0] == [(0, 10, 17), (30, 42, 8)] and chains[1] == [(60, 5, 8)]


def test_chains_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        runs = sorted((rng.randrange(80), rng.randrange(80), rng.randrange(8, 20)) for _ in range(8))
        best = 0.0
        score = []
        for i, (a, b, n) in enumerate(runs):
            before = [
                score[j] - 0.25 * (a - runs[j][0] - runs[j][2] + b - runs[j][1] - runs[j][2])
                for j in range(i)
                if runs[j][0] + runs[j][2] <= a + 7 and runs[j][1] + runs[j][2] <= b + 7
            ]
            score.append(n + max([0.0, *before]))
            best = max(best, score[-1])
        top = best_chains(runs)[0]
        total = top[0][2]
        for (a, b, n), (x, y, m) in zip(top, top[1:]):
            total += m - 0.25 * (x - a - n + y - b - n)
        assert abs(total - best) < 1e-9


def test_winnow_and_empty_table(spark):
    h = np.random.default_rng(1).integers(0, 2**63, 500, np.uint64)
    at = set(winnow(h, 16).tolist())
    assert all(any(i <= p < i + 16 for p in at) for i in range(485))
    assert winnow(h[:0], 16).tolist() == [] and winnow(h[:3], 16).tolist() == [int(h[:3].argmin())]
    df = spark.createDataFrame([], "chunk_id int, text string")
    assert shared_passages(df).count() == 0


def test_every_copy_inside_a_chunk(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    passage = text(60)
    twice = text(20) + passage + text(300) + passage + text(20)
    # Sentences of the passage that stand elsewhere before it, in another order.
    moved = passage[40:] + text(90) + passage[:30] + text(90) + passage
    docs = {1: twice, 2: text(30) + passage + text(30), 3: moved}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "chunk_id int, text string")
    covered = {}
    for r in shared_passages(df).collect():
        covered.setdefault(r.chunk_id, set()).update(range(r.start, r.end))
    assert covered[1] == {*range(20, 80), *range(380, 440)}
    assert covered[2] == set(range(30, 90))
    assert covered[3] == set(range(230, 290))


def test_common_lines_in_a_row(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    lines = [text(25) for _ in range(3)]
    docs = {k: text(30) + lines[k % 3] + text(30) for k in range(2000)}
    for k in (700, 1400):
        docs[k] = text(30 + k // 100) + sum(lines, []) + text(30)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "chunk_id int, text string")
    got = {(r.chunk_id, r.start, r.end, r.other_id) for r in shared_passages(df).collect()}
    assert got == {(700, 37, 112, 1400), (1400, 44, 119, 700)}


def test_common_words_of_two_gaps():
    def plain(one, two):
        row = [0] * (len(two) + 1)
        for w in one:
            last = row
            row = [0]
            for j, v in enumerate(two):
                row.append(last[j] + 1 if v == w else max(last[j + 1], row[j]))
        return row[-1]

    rng = random.Random(11)
    for _ in range(300):
        one, two = ([b"%d" % rng.randrange(9) for _ in range(rng.randrange(90))] for _ in range(2))
        if len(one) != len(two):
            assert _common(one, two) == plain(one, two)
    # Gaps of many words: 0.05 s, where a row of numbers per word took 1.4 s.
    one, two = ([b"%d" % rng.randrange(500) for _ in range(n)] for n in (60000, 4000))
    began = time.process_time()
    assert 0 < _common(one, two) < 4000
    assert time.process_time() - began < 0.5


def test_open_places_are_linked_not_paired():
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    passage = text(60)
    docs = [" ".join(text(60) + passage + text(60)) for _ in range(70)]
    # 40 open places, 30 in passages, then ten whose words around are others.
    docs += [" ".join(text(80) + passage[20:28] + text(80)) for _ in range(10)]
    asked = [[{"seed": 5, "pos": 80, "reach": 80, "open": not 40 <= k < 70}] for k in range(80)]
    batch = pa.RecordBatch.from_pydict(
        {"a": list(range(80)), "text": docs, "w": asked, "s": [[{"pos": 80, "reach": 80, "seed": 5}]] * 80}
    )
    places = pa.Table.from_batches(list(_surrounder(8, 50)([batch])))
    sides = [
        t.append_column("left", pa.array([v] * len(t)))
        for t, v in ((places.filter(places["open"]), True), (places, False))
    ]
    got = _near(8, 50, 0.8)(pa.concat_tables(sides)).to_pylist()
    linked = {k: k for k in range(40)}

    def top(k):
        return k if linked[k] == k else top(linked[k])

    for r in got:
        if r["b"] < 40:
            linked[top(r["a"])] = top(r["b"])
    assert len({top(k) for k in linked}) == 1
    # All pairs are 1,980.
    assert len(got) <= 2 * 40 and sum(40 <= r["b"] < 70 for r in got) >= 1
    assert not any(70 <= r["a"] or 70 <= r["b"] for r in got)
    spans = [align_chain(docs[r["a"]].split(), docs[r["b"]].split(), [tuple(r["chains"][0])]) for r in got]
    assert set(spans) == {(60, 120, 60, 120, 60)}


def test_repetitions_meet_the_longest(spark):
    rng = random.Random(22)
    text = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    sizes = {1: 90, 2: 500, 3: 400, 4: 60, 5: 70}
    docs = {k: text(30) + ["the"] * n + text(30) for k, n in sizes.items()}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "chunk_id int, text string")
    covered = {}
    for r in shared_passages(df).collect():
        covered.setdefault(r.chunk_id, set()).update(range(r.start, r.end))
    assert {k: len(v) for k, v in covered.items()} == {1: 90, 2: 400, 3: 400, 4: 60, 5: 70}


def test_an_unequal_chain_is_cut():
    rng = random.Random(23)
    text = lambda n: [b"w%d" % rng.randrange(50000) for _ in range(n)]
    one, two = text(60), text(70)
    words, others = one + text(30) + two, one + text(90) + two
    runs = [(0, 0, 60), (90, 150, 70)]
    found = list(passages_of(words, others, runs, 50, 0.8))
    assert found == [([runs[0]], (0, 60, 0, 60, 60)), ([runs[1]], (90, 160, 150, 220, 70))]
    assert not list(passages_of(words, others, [(0, 0, 20), (90, 150, 20)], 100, 0.8))
