import random

from amrspark.llm.decontaminate import cut_spans, scan_chunks
from amrspark.llm.words import WORD

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, tests, n=13):
    own, hit, found = words(text), set(), set()
    for genome, summary in tests:
        w = words(summary)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(genome))
    return len(own), len(hit), sorted(found)


def case():
    rng = random.Random(1)
    vocabulary = ["bla", "KPC", "é", "gene", "x1", "of", "the"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    tests = [(i, text(rng.choice([0, 3, 12, 13, 30]))) for i in range(12)] + [(77, None), (3, text(20))]
    chunks = [(i, text(rng.choice([0, 2, 40, 200]))) for i in range(25)]
    for i in range(8):
        chunks.append((100 + i, text(20) + "; " + (tests[i][1] or "").upper() + "! " + text(300)))
    return [*chunks, (None, None), (5, "x"), (5, "x"), (6, "")], tests


def test_against_brute_force(spark):
    chunks, tests = case()
    df = spark.createDataFrame([(*c, 9) for c in chunks], "chunk_id int, text string, n_hit int")
    held = spark.createDataFrame(tests, "genome_id int, summary string")
    for slice_words in (200_000, 40):
        got = scan_chunks(df, held, slice_words=slice_words).collect()
        want = sorted((str(i), *map(str, brute(t, tests))) for i, t in chunks)
        assert sorted((str(r.chunk_id), str(r.n_words), str(r.n_hit), str(r.genomes)) for r in got) == want
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_cut_and_empty(spark):
    df = spark.createDataFrame([(1, "Keep; Bad WORDS here! tail"), (2, None)], "chunk_id int, text string")
    held = spark.createDataFrame([("g", "bad words here")], "genome_id string, summary string")
    got = {r.chunk_id: r.clean_text for r in cut_spans(scan_chunks(df, held)).collect()}
    assert got == {1: "Keep; ! tail", 2: None}
    assert scan_chunks(df.limit(0), held).count() == 0
    assert {r.n_hit for r in scan_chunks(df, held.limit(0)).collect()} == {0}


def test_carried_columns(spark):
    df = spark.createDataFrame([(1, "a", ("a", 2))], "chunk_id int, text string, row struct<text:string,hits:int>")
    held = spark.createDataFrame([("g", "a")], "genome_id string, summary string")
    row = scan_chunks(df, held, carry=["row"]).first()
    assert row.row == ("a", 2) and row.contaminated
