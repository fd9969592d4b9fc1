import re

import pytest

from amrspark.llm.private_data import KINDS, find_private, fit_kinds, listed, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f x", "1.2.3.4.5 999.1.1.1 0255.001.1.1", "é😀 +1 (234) 555-1234 x " + "1 2 " * 2000, "@" * 3000,
    "a" * 9000 + "@b", "a@b" + ".c" * 3000, None, "", "+1+2+3", "4111 1111 1111 1111-4111-1111-1111-1111",
    "4111111111111111 and 4111-1111-1111-1112", "x@y.z " * 700, "call 10.0.0.1, mail me@site.org.", "1.2.3 4.5.6.7\n8.9",
]


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in each) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0])]


@pytest.fixture(scope="module")
def models(spark):
    return fit_kinds(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumnRenamed("doc_id", "chunk_id"))


def test_base_spans_and_edges(spark, models):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], ""), (0, TEXTS[0], "")]
    df = spark.createDataFrame(rows, "chunk_id int, text string, base string")
    got = find_private(df, models).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.chunk_id or 0] if r.chunk_id is not None else TEXTS[0]
        base = [tuple(s) for s in r.base]
        assert base == brute(text)
        spans = [tuple(s) for s in r.spans]
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:]))
        for kind, start, end in set(spans) - set(base):
            assert not any(s < end and start < e for k, s, e in spans if (k, s, e) != (kind, start, end))
    assert find_private(df.limit(0), models).count() == 0


def test_method_adds_look_alikes_only(spark, models):
    rows = [(1, "pay 9807915762804491 now"), (2, "version 4.0 of chapter 12, page 3"), (3, "no data at all")]
    got = {r.chunk_id: [tuple(s) for s in r.spans] for r in find_private(spark.createDataFrame(rows, "chunk_id int, text string"), models).collect()}
    assert got == {1: [("card", 4, 20)], 2: [], 3: []}


def test_redact_and_listed(spark, models):
    df = spark.createDataFrame([(1, "Ask é a@b.org or +1 234 555 6789."), (2, None)], "chunk_id int, text string")
    found = redact(find_private(df, models))
    got = {r.chunk_id: (r.clean_text, r.l) for r in found.withColumn("l", listed(found.spans)).collect()}
    assert got == {1: ("Ask é [EMAIL] or [PHONE].", "email:6:13,phone:17:32"), 2: ("", "")}


def test_no_models_and_native_plan(spark):
    df = spark.createDataFrame([(1, "a@b.org")], "chunk_id int, text string")
    assert fit_kinds(df) == {}
    found = find_private(df, {})
    assert [tuple(s) for s in found.first().spans] == [("email", 0, 7)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
