import hashlib
import re

import pytest
from amrspark.llm import fill_middle
from amrspark.session import work_folder
from pyspark.sql import functions as F


def brute(key, text, seed="1"):
    """Units by pattern, output as one string."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.S)
    hexed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "a", "<", "<P", "ab<S>c", "P> <P <", "blaKPC-2 β-lactamase\n\n", "é" * 7, "\U0001f9ec" * 5 + "gene",
    "x" * 30_000, "one two " * 9_000, "ü1 " * 5_000, "<M", "a" * 8192, "- " * 4096,
]


@pytest.mark.parametrize("frame_units", [1, 3, 8192])
def test_equals_brute(spark, frame_units):
    texts = TEXTS if frame_units > 3 else [t for t in TEXTS if t is None or len(t) < 40]
    given = [(i * 7 + j, t) for i, t in enumerate(texts) for j in range(5)] + [(None, "no id"), (1, "again"), (1, "again")]
    chunks = spark.createDataFrame(given, "chunk_id long, text string").withColumn("n_units", F.lit("own"))
    path = work_folder(spark, "frames")
    fill_middle.write_frames(chunks, path, frame_units=frame_units)
    got = fill_middle.fill_in_middle(spark, path).collect()
    want = sorted((repr(k), *map(repr, brute(k, t)), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in given)
    assert want == sorted(
        (repr(r.chunk_id), *map(repr, (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output)), r.restored_sha256)
        for r in got
    )
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_frames_are_independent(spark):
    text = "word " * 10_000
    path = work_folder(spark, "frames")
    fill_middle.write_frames(spark.createDataFrame([("k", text)], "chunk_id string, text string"), path)
    row = spark.read.parquet(path).first()
    framed = fill_middle.Framed(row.units, row.chars, row.ends, bytes(row.frames))
    assert len(row.ends) == 3 and row.n_units == 20_000 and row.n_chars == len(text)
    assert framed.frame(1).decode() == text[5 * 4096 : 5 * 8192]
    assert framed.place(8192)[:2] == (1, 0) and framed.place(20_000) == (3, 0, len(text))
    assert fill_middle.fill_in_middle(spark, path, outputs=False).columns[-1] == "restored_sha256"


def test_marks_across_pieces():
    pieces = [b"<", b"P>a<", b"<S", b">b", b"<M", b">", b"c<"]
    joined = {}
    for mark, part in fill_middle.sections(pieces):
        joined[mark] = joined.get(mark, b"") + part
    assert joined == {b"": b"", b"<P>": b"a<", b"<S>": b"b", b"<M>": b"c<"}
    assert b"".join(fill_middle.restore(lambda: iter(pieces), "psm")) == b"a<c<b"


def test_empty_table(spark):
    path = work_folder(spark, "frames")
    fill_middle.write_frames(spark.createDataFrame([], "chunk_id long, text string"), path)
    assert fill_middle.fill_in_middle(spark, path).count() == 0
