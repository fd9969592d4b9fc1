"""`conversations` seen as narratives about the genomes of `events`: one per conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators import audit as A
from amrspark.operators import decide as D
from amrspark.plans import bindings as B
from amrspark.plans.decide_queries import _BASE, _REPORT, _report

_PANEL = "|".join(fixed.PANEL)
# Every eighth turn carries one kind of flaw; the turn's whole text is kept in front of it.
_TURN = [
    "conv_id",
    "turn",
    "concat(cast(conv_id % 150 as string), '.', cast(conv_id % 12 as string)) AS genome_id",
    f"""case when (conv_id + turn) % 8 = 7 then 'colistin' else
        split_part('{_PANEL}', '|', cast(turn % 5 + 1 as int)) end AS antibiotic""",
    """concat(text, case (conv_id + turn) % 8 when 1 then ' It is likely to work.'
        when 2 then ' It confers resistance.' when 3 then ' Confidence 48 %.'
        when 4 then ' As with meropenem.' when 6 then ' Seen 12345 times.' else '' end)
        AS narrative""",
]
_SUMMARY = """case conv_id % 5 when 1 then 'Overview: no call here.' when 2 then 'Overview 7%'
    when 3 then 'Overview, due to the presence of genes.' else 'Overview.' end"""
_CAVEATS = (
    "Please confirm every result in a laboratory.",
    "The allele could not be confirmed; laboratory re-testing advised.",
)


def _narratives(spark, sf_dir):
    turns = B.table(spark, sf_dir, "conversations").selectExpr(*_TURN)
    entry = F.struct("turn", "antibiotic", "narrative", F.array().cast("array<string>").alias("citations"))
    return turns.groupBy("conv_id", "genome_id").agg(
        F.expr(_SUMMARY).alias("summary"),
        F.array_sort(F.collect_list(entry)).alias("per_antibiotic"),
        F.array(*[F.lit(c) for c in _CAVEATS]).alias("caveats"),
    )


def grounding_audit(spark, sf_dir):
    out = A.grounding(_narratives(spark, sf_dir), _report(spark, sf_dir))
    return out.select("conv_id", "genome_id", "passed", "rule", "drug", "value")


def published_narrative(spark, sf_dir):
    return A.flatten(_narratives(spark, sf_dir)).select("conv_id", "published")


def published_percents(spark, sf_dir):
    flat = A.flatten(_narratives(spark, sf_dir))
    out = A.ungrounded_percents(flat, _report(spark, sf_dir))
    return out.select("conv_id", F.array_join("percents", ",").alias("percents"))


def text_probes(spark, sf_dir):
    """Numbers, percentages, safe ids and slugs in every document."""
    from amrspark.functions import text

    docs = B.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.size(text.numbers_in("text")).cast("bigint").alias("n_numbers"),
        F.size(text.percents_in("text")).cast("bigint").alias("n_percents"),
        F.size(text.tokens("text")).cast("bigint").alias("n_tokens"),
        text.mentions(F.lower("text"), "the").alias("says_the"),
        text.restates_disclaimer("text").alias("restates"),
        text.safe_id(F.concat_ws("-", "source", "lang")).alias("safe"),
        text.slug(F.concat_ws(" / ", F.upper("source"), "lang")).alias("slug"),
    )


QUERIES = {
    f.__name__: f
    for f in (grounding_audit, published_narrative, published_percents, text_probes)
}

_NARR = f"""turns AS (SELECT {', '.join(_TURN)} FROM conversations),
convs AS (SELECT DISTINCT conv_id, genome_id, {_SUMMARY} AS summary FROM turns)"""
_PCT = "'([0-9]+(?:\\.[0-9]+)?)[ \\t]*%', 1"
_NUM = "'[0-9]+(?:\\.[0-9]+)?'"


def _b(col: str, phrase: str) -> str:
    return f"regexp_matches({col}, '\\b{phrase}\\b')"


_OTHER = " ".join(
    f"WHEN {_b('said', p)} AND antibiotic <> '{p}' THEN '{p}'" for p in fixed.PANEL
)
_WRONG = " ".join(
    f"WHEN {_b('said', w)} AND verdict <> '{v}' THEN '{w}'" for v, w in A.PHRASES.items()
)
_CAUSE = " ".join(
    f"WHEN {_b('said', w)} AND category <> 'known_mechanism' THEN '{w}'"
    for w in fixed.CAUSAL_PHRASES
)
_FREE_V = " ".join(f"WHEN {_b('lower(summary)', w)} THEN '{w}'" for w in A.PHRASES.values())
_FREE_C = " ".join(f"WHEN {_b('lower(summary)', w)} THEN '{w}'" for w in fixed.CAUSAL_PHRASES)
_CAV = " || chr(10) || ".join(f"'{c}'" for c in _CAVEATS)
_ALLTEXT = f"lower(summary || chr(10) || {_CAV})"

SQL = {
    "grounding_audit": f"""{_BASE}, {_REPORT}, {_NARR},
      mine AS (SELECT r.genome_id, r.antibiotic, r.verdict, r.category, lower(t.t) AS t
        FROM report r JOIN told t ON t.genome_id = r.genome_id
          AND starts_with(t.t, r.antibiotic || ':')),
      per AS (SELECT u.conv_id, u.genome_id, u.turn, u.antibiotic, lower(u.narrative) AS said,
        m.t, m.verdict, m.category, m.t IS NOT NULL AS known
        FROM turns u JOIN story s USING (genome_id) LEFT JOIN mine m
          ON m.genome_id = u.genome_id AND m.antibiotic = u.antibiotic),
      one AS (SELECT *,
        list_filter(regexp_extract_all(said, {_PCT}), lambda x:
          NOT list_contains(regexp_extract_all(t, {_PCT}), x))[1] AS badp,
        list_filter(regexp_extract_all(said, {_NUM}), lambda x:
          NOT list_contains(regexp_extract_all(t, {_NUM}), x))[1] AS badn,
        CASE {_OTHER} END AS other, CASE {_WRONG} END AS wrong, CASE {_CAUSE} END AS cause
        FROM per),
      free AS (SELECT conv_id, c.genome_id, summary,
        list_filter(regexp_extract_all({_ALLTEXT}, {_PCT}), lambda x:
          NOT list_contains(regexp_extract_all(lower(narrative), {_NUM}), x))[1] AS badp,
        list_filter(regexp_extract_all({_ALLTEXT}, {_NUM}), lambda x:
          NOT list_contains(regexp_extract_all(lower(narrative), {_NUM}), x))[1] AS badn
        FROM convs c JOIN story USING (genome_id)),
      v AS (
        SELECT conv_id, 1 AS stage, turn, 'percent_not_of_drug' AS rule, antibiotic AS drug,
          badp AS value FROM one WHERE known AND badp IS NOT NULL
        UNION ALL SELECT conv_id, 1, turn, 'number_not_of_drug', antibiotic, badn FROM one
          WHERE known AND badp IS NULL AND badn IS NOT NULL
        UNION ALL SELECT conv_id, 2, 0, 'percent_not_in_report', NULL, badp FROM free
          WHERE badp IS NOT NULL
        UNION ALL SELECT conv_id, 3, 0, 'number_not_in_report', NULL, badn FROM free
          WHERE badn IS NOT NULL
        UNION ALL SELECT conv_id, 4, turn, 'drug_not_evaluated', antibiotic, NULL FROM one
          WHERE NOT known
        UNION ALL SELECT conv_id, 6, turn, CASE WHEN other IS NOT NULL THEN 'names_other_drug'
            WHEN wrong IS NOT NULL THEN 'other_verdict' ELSE 'causal_without_mechanism' END,
          antibiotic, coalesce(other, wrong, cause) FROM one
          WHERE known AND coalesce(other, wrong, cause) IS NOT NULL
        UNION ALL SELECT conv_id, 7, 0, 'verdict_in_free_text', NULL, CASE {_FREE_V} END
          FROM free WHERE CASE {_FREE_V} END IS NOT NULL
        UNION ALL SELECT conv_id, 8, 0, 'causal_in_free_text', NULL, CASE {_FREE_C} END
          FROM free WHERE CASE {_FREE_C} END IS NOT NULL),
      w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY stage, turn) = 1)
      SELECT f.conv_id, f.genome_id, w.rule IS NULL AS passed, w.rule, w.drug, w.value
      FROM free f LEFT JOIN w USING (conv_id)
      UNION ALL SELECT conv_id, genome_id, false, 'genome_not_reported', NULL, NULL FROM convs
      WHERE genome_id NOT IN (SELECT genome_id FROM story)""",
    "published_narrative": f"""WITH {_NARR}
      SELECT conv_id, any_value(summary) || chr(10) || string_agg(antibiotic || ': ' || narrative,
        chr(10) ORDER BY turn) || chr(10) || '{_CAVEATS[1]}' || chr(10) || '{fixed.DISCLAIMER}'
        AS published FROM turns JOIN convs USING (conv_id) GROUP BY conv_id""",
    "published_percents": f"""{_BASE}, {_REPORT}, {_NARR},
      flat AS (SELECT conv_id, any_value(c.genome_id) AS genome_id, lower(any_value(summary) ||
        chr(10) || string_agg(antibiotic || ': ' || narrative, chr(10) ORDER BY turn)) AS t
        FROM turns JOIN convs c USING (conv_id) GROUP BY conv_id),
      bad AS (SELECT conv_id, list_filter(regexp_extract_all(t, {_PCT}), lambda x:
        NOT list_contains(regexp_extract_all(lower(coalesce(narrative, '')), {_NUM}), x)) AS p
        FROM flat LEFT JOIN story USING (genome_id)),
      pos AS (SELECT conv_id, x, min(i) AS i FROM (SELECT conv_id, unnest(p) AS x,
        generate_subscripts(p, 1) AS i FROM bad) GROUP BY ALL)
      SELECT conv_id, string_agg(x, ',' ORDER BY i) AS percents FROM pos GROUP BY conv_id""",
    "text_probes": f"""SELECT doc_id, len(regexp_extract_all(text, {_NUM})) AS n_numbers,
      len(regexp_extract_all(text, {_PCT})) AS n_percents,
      len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens,
      regexp_matches(lower(text), '\\bthe\\b') AS says_the,
      regexp_matches(lower(text), '\\bconfirm\\b') AND contains(lower(text), 'result') AND
        (contains(lower(text), 'laborator') OR contains(lower(text), 'susceptibility test'))
        AS restates,
      regexp_matches(source || '-' || lang, '^[A-Za-z0-9._-]+$') AS safe,
      trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug
      FROM documents""",
}
