import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from amrspark.operators import packed
from amrspark.operators import retrieval as R

WORDS = "alpha beta gamma carbapenemase porin the of gene drug mutation 16s".split()


def tokenize(t):
    return re.findall("[a-z0-9]+", t.lower())


def brute_bm25(docs, query):
    toks = [tokenize(t) for _, t in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in idf.items()}
    out = []
    for t in toks:
        s = 0.0
        for w in tokenize(query):
            tf = t.count(w)
            s += idf.get(w, 0.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        out.append(round(s, 9))
    return out


def brute_dense(docs, query):
    def vec(t):
        v = np.zeros(256)
        for w in tokenize(t):
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 256] += 1
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    q = vec(query)
    return [round(float(vec(t) @ q), 9) for _, t in docs]


def brute_fuse(docs, legs, k):
    ids = [d for d, _ in docs]
    fused = dict.fromkeys(ids, 0.0)
    for scores in legs:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
        for rank, i in enumerate(order):
            fused[ids[i]] += 1 / (60 + rank + 1)
    fused = {d: round(s, 12) for d, s in fused.items()}
    return sorted(fused.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize(
    "seed, lexical, dense, block",
    [(1, True, False, 1024), (2, True, True, 1024), (1, True, True, 1), (3, False, True, 2), (4, True, False, 2)],
)
def test_fusion_equals_full_ranking(spark, monkeypatch, seed, lexical, dense, block):
    """Any legs, any number of blocks, slices of few documents, many equal scores."""
    monkeypatch.setattr(R, "BLOCK_QUERIES", block)
    rng = random.Random(seed)
    docs = [(f"d{i:02d}", " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(40)]
    asked = [("q1", "alpha carbapenemase"), ("q2", "the the of"), ("q3", "nothing known"), ("q4", "")]
    corpus = spark.createDataFrame(docs, "doc_id string, text string")
    queries = spark.createDataFrame(asked, "query_id string, text string")
    index = R.build_index(corpus)
    found = {}
    for r in R.retrieve(index, queries, 7, lexical=lexical, dense=dense).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for q, t in asked:
        legs = [brute_bm25(docs, t)] * lexical + [brute_dense(docs, t)] * dense
        want = brute_fuse(docs, legs, 7)
        assert [d for d, _ in found[q]] == [d for d, _ in want]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want], abs=1e-11)


def test_pairs_left_out(spark):
    """With bounds most pairs are never scored in full, and the best stay the same."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(400)])
    weights = 1 / np.arange(1, 401)
    text = [" ".join(rng.choice(words, rng.integers(20, 60), p=weights / weights.sum())) for _ in range(3000)]
    docs = [(i, t) for i, t in enumerate(text)]
    asked = [(i, text[i * 60] + " w0 w1 w2 w3") for i in range(40)]
    index = R.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), vectors=False)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    pairs, scored = R.scored_pairs(index, queries)
    assert pairs == 120_000 and scored < pairs / 5
    got = {}
    for r in R.retrieve(index, queries, dense=False).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    for q, t in asked[::8]:
        assert got[q] == [d for d, _ in brute_fuse(docs, [brute_bm25(docs, t)], 5)]


def test_light_words_of_few_pairs():
    """Both ways of adding the light words give the same scores where the bound is reached."""
    rng = np.random.default_rng(9)
    n, q, t = 50, 6, 12
    tokens = [sorted(rng.choice(t, rng.integers(1, t), replace=False)) for _ in range(n)]
    table = pa.table(
        {
            "doc_id": list(range(n)), "dl": [3 * len(x) for x in tokens],
            "tokens": [[f"w{i}" for i in x] for x in tokens],
            "tf": [rng.integers(1, 5, len(x)).tolist() for x in tokens],
        }
    )
    word, query = (x.ravel() for x in np.meshgrid(np.arange(t), np.arange(q), indexing="ij"))
    weight = rng.exponential(size=t)[word] ** 3 * np.where(word == 4, -0.1, 1.0)
    block = packed.Block(pa.array(range(q)), pa.array([f"w{i}" for i in range(t)]), word, query, weight, np.zeros((q, 1)), 1.5, 0.75, 20.0, 1e9)
    docs = packed.Documents(table, block)
    full, _ = packed.bm25(docs, block)
    for part in (0.0, 0.5, 0.98):
        least = np.quantile(full, part, axis=0).astype(np.int64)
        some, scored = packed.bm25(docs, block, least)
        assert ((full < least) | (abs(some - full) <= 1)).all()
        assert scored >= (full >= least).sum() and (part < 0.9 or scored < full.size / 4)


def test_rrf_bounds(spark):
    docs = [("alpha", "alpha carbapenemase enzyme"), ("beta", "beta porin loss"), ("gamma", "gamma pump")]
    corpus = spark.createDataFrame(docs, "doc_id string, text string")
    queries = spark.createDataFrame([("q", "alpha carbapenemase")], "query_id string, text string")
    index = R.build_index(corpus)
    one = R.retrieve(index, queries, 2, dense=False).orderBy("rank").collect()
    assert one[0]["doc_id"] == "alpha" and one[0]["score"] <= 1 / 61 + 1e-12 and len(one) == 2
    two = R.retrieve(index, queries, 5).orderBy("rank").collect()
    assert two[0]["doc_id"] == "alpha" and 1 / 61 < two[0]["score"] <= 2 / 61 + 1e-12
    assert len(two) == 3


def test_gene_evidence(spark):
    chunks = spark.createDataFrame(
        [
            ("k1", "blaKPC", "meropenem carbapenemase"),
            ("k2", "sul", "folate bypass"),
            ("k3", "qnr", "gyrase protection"),
        ],
        "chunk_id string, gene_family string, text string",
    )
    rows = spark.createDataFrame(
        [("g1", "meropenem", ["blaKPC"]), ("g2", "meropenem", ["blaKPC"]), ("g1", "x", ["sul"])],
        "genome_id string, antibiotic string, supporting_features array<string>",
    )
    got = {(r["genome_id"], r["antibiotic"]): r["chunk_id"] for r in R.evidence_for_genes(rows, chunks, 1).collect()}
    assert got == {("g1", "meropenem"): "k1", ("g2", "meropenem"): "k1", ("g1", "x"): "k2"}


def test_reach_holds_every_fused_top():
    """No ranks outside the bound can reach the top k, and the bound is the least such one."""
    for legs, k, c in ((1, 5, 60), (2, 5, 60), (2, 1, 60), (3, 7, 10)):
        limit = R.reach(legs, k, c)
        assert legs / (c + limit + 1) < 1 / (c + k) <= legs / (c + limit)


def _shuffles(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_pair_scores_and_text_vectors_shuffle_no_words(spark):
    """One row per text at most is shuffled; repeated keys and null ids give what the joins gave."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(40)))) for i in range(60)]
    docs = spark.createDataFrame(rows + [(99, None)], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "the gene drug"), (None, "porin"), ("q", "alpha")], "query_id string, text string")
    pairs = R.bm25_scores(R.build_index(docs, vectors=False), asked)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in pairs.collect()}
    for name, words in (("q", "the gene drug alpha"), (None, "porin")):
        want = dict(zip(range(60), brute_bm25(rows + [(99, "")], words)))
        assert {d: s for (q, d), s in got.items() if q == name} == pytest.approx({d: s for d, s in want.items() if s})
    assert _shuffles(pairs) == 0

    twice = docs.unionAll(spark.createDataFrame([(3, "porin porin"), (None, "drug")], docs.schema))
    own, joined = R.text_vectors(twice), R.hashed_vectors(R.term_counts(twice))
    vectors = [{(r["doc_id"], r["bucket"]): r["weight"] for r in df.collect()} for df in (own, joined)]
    assert vectors[0] == pytest.approx(vectors[1])
    assert _shuffles(own) == 1 < _shuffles(joined)


def test_documents_are_packed_in_bounded_pieces(monkeypatch):
    rng = random.Random(6)
    words = pa.array([rng.choices(WORDS, k=rng.randrange(9)) for _ in range(1200)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), words], ["doc_id", "words"])
    pieces = list(R._packed(iter([batch])))
    assert max(p.num_rows for p in pieces) <= 512
    rows = [r for p in pieces for r in p.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(1200))
    for r, own in zip(rows, words.to_pylist()):
        assert r["dl"] == len(own) and dict(zip(r["tokens"], r["tf"])) == {w: own.count(w) for w in own}
