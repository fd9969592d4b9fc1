"""Scalar column expressions. Everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amrspark import fixed

Name = str | Column


def _col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small literal map, null when absent."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(literal, key)


def clean(c: Name) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def null_spellings(c: Name, spellings: tuple[str, ...] = fixed.NULL_SPELLINGS) -> Column:
    c = _col(c)
    return F.when(~c.isin(*spellings), c)


def canonical_sir(c: Name) -> Column:
    return lookup(fixed.SIR_ALIASES, F.lower(F.trim(_col(c))))


def canonical_drug(c: Name) -> Column:
    """A missing name becomes the text `nan`, as a named bucket of its own."""
    key = F.lower(F.trim(F.coalesce(_col(c), F.lit("nan"))))
    return F.coalesce(lookup(fixed.DRUG_ALIASES, key), key)


def binary_side(c: Name) -> Column:
    return lookup(fixed.BINARY_SIDES, _col(c))


def mic_sign(c: Name) -> Column:
    return F.nullif(F.regexp_extract(_col(c), fixed.SIGN_PATTERN, 1), F.lit(""))


def number(c: Name) -> Column:
    """Lenient number: null for anything that is not a plain decimal or exponent form."""
    text = F.trim(_col(c))
    plain = text.rlike(fixed.NUMBER_PATTERN)
    return F.when(plain, text.try_cast("double"))


def mlst(c: Name) -> tuple[Column, Column]:
    """(scheme, sequence type) of `MLST.scheme.123`; both null when malformed."""
    text = F.regexp_replace(F.trim(_col(c)), fixed.MLST_PREFIX, "")
    pattern = fixed.MLST_PATTERN
    st = F.regexp_extract(text, pattern, 2).try_cast("int")
    scheme = F.when(st.isNotNull(), F.regexp_extract(text, pattern, 1))
    return scheme, st


def group_id(scheme: Name, st: Name, genome: Name) -> Column:
    """Homology group: `st:<scheme>:<n>`, or a group of its own for a genome without a type."""
    scheme, st, genome = _col(scheme), _col(st), _col(genome)
    n = number(st.cast("string")).cast("bigint")
    named = clean(scheme).isNotNull() & ~F.lower(F.trim(scheme)).isin("nan", "none")
    return F.when(
        named & n.isNotNull(), F.concat_ws(":", F.lit("st"), F.trim(scheme), n.cast("string"))
    ).otherwise(F.concat(F.lit("singleton:"), genome))


def slug(c: Name) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def tokens(c: Name) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(fixed.WORD_PATTERN), F.lit(0))


def hash32(c: Name) -> Column:
    """First 32 bits of MD5: the same number in every engine."""
    return F.conv(F.substring(F.md5(_col(c).cast("string")), 1, 8), 16, 10).cast("bigint")


def bucket(c: Name, dim: int = fixed.EMBED_DIM) -> Column:
    return F.pmod(hash32(c), F.lit(dim)).cast("int")


def numbers_in(c: Name) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(fixed.DECIMAL_PATTERN), F.lit(0))


def percents_in(c: Name) -> Column:
    """Numbers followed by a percent sign on the same line."""
    return F.regexp_extract_all(_col(c), F.lit(fixed.PERCENT_PATTERN), F.lit(1))


def mentions(c: Name, phrase: str) -> Column:
    return _col(c).rlike(rf"\b{phrase}\b")


def safe_id(c: Name, max_length: int | None = None) -> Column:
    c = _col(c)
    ok = c.rlike(fixed.SAFE_ID_PATTERN)
    if max_length is not None:
        ok = ok & (F.length(c) <= max_length)
    return F.coalesce(ok, F.lit(False))


def restates_disclaimer(c: Name) -> Column:
    low = F.lower(_col(c))
    lab = low.contains("laborator") | low.contains("susceptibility test")
    return low.rlike(fixed.CONFIRM_PATTERN) & low.contains("result") & lab


def confidence(verdict: Name, p: Name) -> Column:
    """How sure the model is in the direction of the verdict."""
    verdict, p = _col(verdict), _col(p)
    return (
        F.when(verdict == "likely_to_fail", p)
        .when(verdict == "likely_to_work", 1 - p)
        .otherwise(F.greatest(p, 1 - p))
    )


def verdict_of_set(in_s: Column, in_r: Column) -> Column:
    return (
        F.when(in_s & ~in_r, "likely_to_work")
        .when(in_r & ~in_s, "likely_to_fail")
        .otherwise("no_call")
    )
