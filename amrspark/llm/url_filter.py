"""Block and allow decisions on source urls, shared by redirect and canonical aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amrspark.llm.components import connected

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_VALUE = r"\s*=\s*(?:\"\s*([^\">]*)|'\s*([^'>]*)|([^\"'\s>]+))"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What two spellings of one address share: scheme and fragment are left out. Null stays."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, null when none fits.

    A rule (verdict, "host/path") fits its host and all subdomains. Of rules of equal length an
    allowing one wins, then the smaller text.
    """
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(order):
        at = rule.index("/")
        own = rule[:at].lower()
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(rule[at:])
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not; empty where it is missing."""
    pattern = rf"(?i)[\s\"'/]{name}{_VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _plain_path(path: Column) -> Column:
    """A path from its root without `.` and `..` segments."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(s))),
    )
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(ended, "/")


def resolved(target: Column, source: Column) -> Column:
    """A link target as a url, seen from the url `source`.

    Targets may be whole urls, start with `//`, `/` or `?`, or be relative to the directory of the
    page, with `.` and `..`. Null for other schemes (`mailto:`), a mere fragment, an empty target,
    or a relative one on a page without a host.
    """
    host, path = host_of(source), path_of(source)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    rest = F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    root = F.when(target.startswith("/"), own).otherwise(F.concat(folder, own))
    here = F.concat(F.lit("http://"), host)
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(_SCHEME + "//"), target)
        .when(target.rlike(_SCHEME), F.lit(None))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(host == "", F.lit(None))
        .when(target.startswith("?"), F.concat(here, path, target))
        .otherwise(F.concat(here, _plain_path(root), rest))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(source, target) from the canonical links and refresh targets in each page's html.

    `pages` has source (a url) and html. Every `link` tag whose rel list holds `canonical` and
    every `meta` refresh tag counts; targets are resolved against the page's url (`base` tags are
    not looked at). Tags without a usable target, null html and null sources give no rows.
    """
    tag = F.col("tag")
    rows = pages.select("source", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = _attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    refresh = F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"
    moved = F.regexp_extract(_attribute(tag, "content"), r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    target = F.when(tag.rlike("(?i)^<link") & canonical, F.trim(_attribute(tag, "href"))).when(
        tag.rlike("(?i)^<meta") & refresh, moved
    )
    found = rows.select("source", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("t")).where(
        F.col("source").isNotNull() & F.col("t").isNotNull()
    )
    return found.select("source", resolved(F.col("t"), F.col("source")).alias("target")).where(
        F.col("target").isNotNull()
    )


def judge_sources(
    chunks: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow"
) -> DataFrame:
    """A verdict for the source url of every chunk.

    Parameters
    ----------
    chunks: chunk_id, source (a url). One result row per row, repeated rows included.
    links: source, target: redirect and canonical edges between urls, in either direction.
    rules: (verdict, "host/path") with verdict allow or block.

    Returns chunk_id, source, host, path, rule, verdict.

    A url with a rule of its own follows it. Any other url follows its aliases, the connected
    component of `links`: an explicitly allowed alias allows it, else a blocked alias blocks it,
    else `default`. A null source, or one without `://`, has an empty host and path, no rule and
    the default. Extra columns are ignored; empty tables give no rows.
    """
    url = F.col("source")
    base = chunks.select(F.col("chunk_id"), url.alias("source")).select(
        "chunk_id", "source", host_of(url).alias("host"), path_of(url).alias("path"),
        alias_key(url).alias("alias"),
    )
    ruled = longest_rule(F.col("host"), F.col("path"), rules)
    judged = base.withColumn("own", ruled)

    ends = links.select(alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b"))
    members = connected(ends)
    at = F.concat(F.lit("http://"), F.col("id"))
    verdict = longest_rule(host_of(at), path_of(at), rules)["verdict"]
    decided = (
        members.select("component", verdict.alias("v"))
        .groupBy("component")
        .agg(F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1)).alias("d"))
        .where(F.col("d").isNotNull())
    )
    shared = members.join(decided, "component").select(F.col("id").alias("alias"), "d")
    told = F.when(F.col("d") == 2, "allow").when(F.col("d") == 1, "block").otherwise(default)
    return judged.join(shared, "alias", "left").select(
        "chunk_id", "source", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), told).alias("verdict"),
    )
