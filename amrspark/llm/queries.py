"""Registered queries: given tables mapped to the operators' fields, and results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amrspark.llm import (
    decontaminate,
    fill_middle,
    html_text,
    near_dedup,
    neighbours,
    packing,
    passages,
    phrases,
    private_data,
    quality,
    token_files,
    top_chunks,
    url_filter,
)
from amrspark.session import work_folder

URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def tokenizer_file(name: str) -> str:
    """Where the installed tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    path = work_folder(spark, "tokens")
    token_files.write_tokens(chunks, tokenizer_file("byte_bpe_50k.json"), 0, path)
    return token_files.read_tokens(spark, path).select(
        F.col("chunk_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    placed = packing.pack_chunks(chunks, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return placed.select(
        F.col("chunk_id").alias("doc_id"), "start", "length", "ids_crc32",
        F.col("chunk_tokens").alias("doc_tokens"), "sequence_id", "offset", "loss_tokens",
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    grouped = near_dedup.group_chunks(chunks, words=4)
    return grouped.withColumnRenamed("chunk_id", "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    scored = quality.score_chunks(chunks, labels)
    return scored.select(F.col("chunk_id").alias("doc_id"), "held_out", "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    chunks = pages.select(F.col("page_id").alias("chunk_id"), F.col("url").alias("source"))
    links = url_filter.alias_links(pages.select(F.col("url").alias("source"), "html"))
    judged = url_filter.judge_sources(chunks, links, URL_RULES)
    return judged.select(F.col("chunk_id").alias("page_id"), "host", "path", "rule", "verdict")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("chunk_id"), F.col("url").alias("source"), "html"
    )
    return html_text.extract_text(pages).select(
        F.col("chunk_id").alias("page_id"), F.col("source").alias("url"), "text",
        F.length("text").cast("long").alias("n_chars"),
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")
    )
    found = neighbours.nearest_chunks(vectors, vectors.where(F.col("chunk_id") % 20 == 0))
    return found.withColumnRenamed("chunk_id", "vec_id").select("query_id", "rank", "vec_id", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    narratives = _table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("genome_id"), F.col("text").alias("summary")
    )
    scanned = decontaminate.scan_chunks(chunks, narratives)
    return scanned.select(
        F.col("chunk_id").alias("doc_id"), "n_words", "n_hit",
        F.size("genomes").cast("long").alias("n_items"),
        F.sha2(F.array_join("genomes", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return passages.shared_passages(chunks).withColumnsRenamed(
        {"chunk_id": "doc_id", "other_id": "other_doc_id"}
    )


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = private_data.find_private(chunks)
    counts = [
        F.size(F.filter("base", private_data.of_kind(k))).cast("long").alias(f"n_{k}")
        for k in private_data.KINDS
    ]
    return found.select(
        F.col("chunk_id").alias("doc_id"), *counts,
        F.sha2(private_data.listed(F.col("base")), 256).alias("base_sha256"),
        private_data.listed(F.col("spans")).alias("spans"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("source")
    )
    return phrases.mine_phrases(chunks).withColumnRenamed("source", "lang")


def op12_top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")
    )
    found = top_chunks.top_chunks(vectors, vectors.where(F.col("chunk_id") % 50 == 0))
    return found.withColumnRenamed("chunk_id", "vec_id")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    path = work_folder(spark, "frames")
    fill_middle.write_frames(chunks, path)
    return fill_middle.fill_in_middle(spark, path, outputs=False).withColumnsRenamed(
        {"chunk_id": "doc_id", "n_units": "n"}
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_neighbours": op2_neighbours,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_passages": op9_passages,
    "op10_private_data": op10_private_data,
    "op11_phrases": op11_phrases,
    "op12_top_chunks": op12_top_chunks,
    "op13_fill_middle": op13_fill_middle,
}

_FITS = """CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
    THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
    THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""

_PLAIN = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""



def _attribute(name: str) -> str:
    """SQL of an attribute's value in `tag`, quoted or not."""
    value = r"""\s*=\s*(?:"\s*([^">]*)|''\s*([^''>]*)|([^"''\s>]+))"""
    return " || ".join(f"""regexp_extract(tag, '(?i)[\\s"''/]{name}{value}', {i})""" for i in (1, 2, 3))


SQL: dict[str, str] = {
    "op3_decontaminate": f"""
WITH docs AS (SELECT doc_id, coalesce({_PLAIN}, []) AS w FROM documents),
items AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
tests AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM tests) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, n FROM windows JOIN tests USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
    FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op6_near_dedup": r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents),
cuts AS (SELECT doc_id, w, least(4, len(w)) AS n, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i
    FROM words WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM cuts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b
    ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM both_ways UNION
    SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_id AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id,
    doc_id = coalesce(c, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON a = doc_id""",
    "op8_url_filter": rf"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag
    FROM pages WHERE url IS NOT NULL),
values_of AS (SELECT url, tag, {_attribute('rel')} AS rel, {_attribute('href')} AS href,
    {_attribute('http-equiv')} AS equiv, {_attribute('content')} AS content FROM tags),
out AS (SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(rel, '(?i)(?:^|\s)canonical(?:\s|$)')
      THEN trim(href)
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim(equiv)) = 'refresh'
      THEN regexp_extract(content, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END, '&amp;', '&') AS t
    FROM values_of),
hosted AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS rest FROM pages),
seen AS (SELECT DISTINCT url, t, host, path, regexp_extract(t, '^[^?#]*', 0) AS own,
    regexp_extract(t, '^[^?#]*(.*)', 1) AS tail FROM out JOIN hosted USING (url)
    WHERE t <> '' AND NOT starts_with(t, '#')),
rooted AS (SELECT *, string_split(CASE WHEN starts_with(t, '/') THEN own WHEN path = '' THEN '/' || own
    ELSE regexp_extract(path, '^(.*/)', 1) || own END, '/') AS parts FROM seen),
plain AS (SELECT *, array_to_string(list_concat(list_reduce(list_transform(parts, lambda s: [s]),
    lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)]
      ELSE list_concat(a, x) END), CASE WHEN parts[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') AS p
    FROM rooted),
targets AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN 'http:' || t WHEN host = '' THEN NULL
    WHEN starts_with(t, '?') THEN 'http://' || host || path || t
    ELSE 'http://' || host || p || tail END AS t FROM plain),
ends AS (SELECT translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS a,
    translate(regexp_extract(t, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '://[^/?#]*([^#]*)', 1) AS b
    FROM targets WHERE t IS NOT NULL),
both_ways AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach(a, b) AS (SELECT a, a FROM both_ways UNION
    SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
split AS (SELECT a, regexp_extract(b, '^([^/?#]*)', 1) AS host,
    regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
shared AS (SELECT a, max(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 2
    WHEN rule IS NOT NULL THEN 1 END) AS d FROM (SELECT a, {_FITS} AS rule FROM split) GROUP BY a)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL OR d = 1 THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, {_FITS} AS rule FROM hosted) h
LEFT JOIN shared s ON h.host <> '' AND s.a = h.host || h.rest""",
    "op11_phrases": r"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) t(m)
    WHERE len(w) >= m)),
f AS (SELECT lang, m, p, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 10),
size AS (SELECT lang, cast(sum(len(w)) AS bigint) AS n FROM pieces GROUP BY lang),
held AS (SELECT lang, p, m, n AS a, string_split(p, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, p, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
    FROM (SELECT *, unnest(range(1, m)) AS k FROM held)),
scored AS (SELECT c.lang, c.p, c.a, k, x.n AS l, y.n AS r,
    cast(1000000::hugeint * a * a // (x.n::hugeint * y.n) AS bigint) AS s FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.p = lp JOIN f y ON y.lang = c.lang AND y.p = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY s, k) = 1),
within AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p, a
    FROM held WHERE m = 3),
gone AS (SELECT DISTINCT lang, p FROM held b JOIN within i USING (lang, p) WHERE 100 * i.a >= 50 * b.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, p) AS rank, p, a, l, r, s
    FROM best ANTI JOIN gone USING (lang, p))
SELECT lang, rank, p AS phrase, a, l, r, size.n AS n, s AS score FROM ranked JOIN size USING (lang)
WHERE rank <= 2000""",
    "op12_top_chunks": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int)
    AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5""",
    "op13_fill_middle": r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || doc_id::varchar) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2,
    ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM units),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
    array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, cast(n AS bigint) AS n, form,
  CASE WHEN form <> 'plain' THEN cast(length(p) AS bigint) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN cast(length(m) AS bigint) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts""",
}
