"""Grounding audit of narrative tables against report rows.

Narratives: genome_id, summary, per_antibiotic array<struct<antibiotic, narrative, citations>>,
caveats array<string>. The first violated rule, in a fixed order, is reported per narrative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text
from amrspark.operators import decide

PHRASES = {"likely_to_work": "likely to work", "likely_to_fail": "likely to fail", "no_call": "no call"}


def _finding(rule: str, drug: Column | None, value: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(rule).alias("rule"),
        (none if drug is None else drug).alias("drug"),
        (none if value is None else value).alias("value"),
    )


def _first(values: list[tuple[Column, Column]]) -> Column:
    """The payload of the first condition that holds."""
    return reduce(lambda acc, cv: acc.when(cv[0], cv[1]), values[1:], F.when(*values[0]))


def _first_in(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def _own_numbers(d: Column) -> Column:
    """Numbers and percentages of one drug's text against its own rendered row and its chunks."""
    row = F.try_element_at("_rows", d["antibiotic"])
    said = F.lower(d["narrative"])
    cited = F.lower(F.coalesce(F.try_element_at("_chunks", d["antibiotic"]), F.lit("")))
    allowed = F.concat(text.numbers_in(row["t"]), text.numbers_in(cited))
    percent = F.get(F.array_except(text.percents_in(said), text.percents_in(row["t"])), F.lit(0))
    number = F.get(F.array_except(text.numbers_in(said), allowed), F.lit(0))
    return _first(
        [
            (row.isNull(), F.lit(None)),
            (percent.isNotNull(), _finding("percent_not_of_drug", d["antibiotic"], percent)),
            (number.isNotNull(), _finding("number_not_of_drug", d["antibiotic"], number)),
        ]
    )


def _own_claims(d: Column) -> Column:
    """Other drugs, other verdicts, or causal wording in one drug's text."""
    row = F.try_element_at("_rows", d["antibiotic"])
    said, drug = F.lower(d["narrative"]), d["antibiotic"]
    rules = [
        (text.mentions(said, p) & (drug != p), _finding("names_other_drug", drug, F.lit(p)))
        for p in fixed.PANEL
    ]
    rules += [
        (text.mentions(said, w) & (row["verdict"] != v), _finding("other_verdict", drug, F.lit(w)))
        for v, w in PHRASES.items()
    ]
    rules += [
        (
            text.mentions(said, w) & (row["category"] != "known_mechanism"),
            _finding("causal_without_mechanism", drug, F.lit(w)),
        )
        for w in fixed.CAUSAL_PHRASES
    ]
    return _first(rules)


def _free_claims(said: Column) -> Column:
    low = F.lower(said)
    rules = [
        (text.mentions(low, w), _finding("verdict_in_free_text", None, F.lit(w)))
        for w in PHRASES.values()
    ]
    rules += [
        (text.mentions(low, w), _finding("causal_in_free_text", None, F.lit(w)))
        for w in fixed.CAUSAL_PHRASES
    ]
    return _first(rules)


def _report_side(rows: DataFrame) -> DataFrame:
    """Per genome: drug to (rendered text, verdict, category), and the whole rendered report."""
    line = F.struct(
        decide.panel_order().alias("o"), "antibiotic", decide.row_text().alias("t"), "verdict", "category"
    )
    lists = rows.groupBy("genome_id").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    by_drug = F.transform(
        "_lines",
        lambda x: F.struct(
            x["antibiotic"].alias("antibiotic"),
            F.struct(F.lower(x["t"]).alias("t"), x["verdict"].alias("verdict"), x["category"].alias("category")).alias("row"),
        ),
    )
    return lists.select(
        "genome_id", F.map_from_entries(by_drug).alias("_rows"), F.lower(decide.story(F.col("_lines"))).alias("_told")
    )


def grounding(narratives: DataFrame, rows: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Add `passed`, `rule`, `drug`, `value`. A narrative of a genome without report rows fails
    with the rule genome_not_reported. `chunks` is (genome_id, antibiotic, text) of the
    passages cited for a drug; their numbers may be repeated."""
    checked = narratives.join(_report_side(rows), "genome_id", "left")
    if chunks is None:
        cited = F.create_map().cast("map<string,string>")
        checked = checked.withColumn("_chunks", cited)
    else:
        joined = chunks.groupBy("genome_id", "antibiotic").agg(
            F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text")
        )
        per = joined.groupBy("genome_id").agg(
            F.map_from_entries(F.collect_list(F.struct("antibiotic", "text"))).alias("_chunks")
        )
        checked = checked.join(per, "genome_id", "left")
    entries = F.col("per_antibiotic")
    evaluated = F.map_keys("_rows")
    free = F.lower(F.array_join(F.concat(F.array("summary"), F.col("caveats")), "\n"))
    told_numbers = text.numbers_in(F.col("_told"))
    chunk_numbers = text.numbers_in(
        F.lower(F.array_join(F.map_values(F.coalesce("_chunks", F.create_map().cast("map<string,string>"))), " "))
    )
    percent = F.get(F.array_except(text.percents_in(free), told_numbers), F.lit(0))
    number = F.get(
        F.array_except(text.numbers_in(free), F.concat(told_numbers, chunk_numbers)), F.lit(0)
    )
    prose = F.lower(
        F.array_join(
            F.concat(
                F.array("summary"), F.col("caveats"), F.transform(entries, lambda d: d["narrative"])
            ),
            "\n",
        )
    )
    invented = F.get(
        F.filter(
            F.transform(entries, lambda d: d["antibiotic"]),
            lambda a: ~F.array_contains(evaluated, a),
        ),
        F.lit(0),
    )
    unasked = [
        (
            text.mentions(prose, p) & ~F.array_contains(evaluated, p),
            _finding("mentions_unevaluated_drug", F.lit(p), None),
        )
        for p in fixed.PANEL
    ]
    found = F.coalesce(
        F.when(F.col("_rows").isNull(), _finding("genome_not_reported", None, None)),
        _first_in(F.transform(entries, _own_numbers)),
        F.when(percent.isNotNull(), _finding("percent_not_in_report", None, percent)),
        F.when(number.isNotNull(), _finding("number_not_in_report", None, number)),
        F.when(invented.isNotNull(), _finding("drug_not_evaluated", invented, None)),
        _first(unasked),
        _first_in(F.transform(entries, _own_claims)),
        _free_claims(F.col("summary")),
        _first_in(F.transform("caveats", _free_claims)),
    )
    return checked.withColumn("_f", found).select(
        *narratives.columns,
        F.col("_f").isNull().alias("passed"),
        F.col("_f.rule").alias("rule"),
        F.col("_f.drug").alias("drug"),
        F.col("_f.value").alias("value"),
    )


def flatten(narratives: DataFrame) -> DataFrame:
    """Published text: summary, drug lines, caveats that add something, the disclaimer once."""
    lines = F.concat(
        F.array("summary"),
        F.transform("per_antibiotic", lambda d: F.concat(d["antibiotic"], F.lit(": "), d["narrative"])),
        F.filter("caveats", lambda c: ~text.restates_disclaimer(c)),
        F.array(F.lit(fixed.DISCLAIMER)),
    )
    return narratives.withColumn("published", F.array_join(lines, "\n"))


def ungrounded_percents(published: DataFrame, rows: DataFrame) -> DataFrame:
    """Published texts holding a percentage that is no number of the report."""
    told = decide.narratives(rows).select("genome_id", F.lower("narrative").alias("_told"))
    extra = F.array_except(
        text.percents_in(F.lower("published")), text.numbers_in(F.coalesce("_told", F.lit("")))
    )
    joined = published.join(told, "genome_id", "left").withColumn("percents", extra)
    return joined.where(F.size("percents") > 0).select(*published.columns, "percents")
