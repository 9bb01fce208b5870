"""Queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, ann, bpe, fingerprints, html_text, mixing, quality, simhash, token_counts, toxicity, url_filter, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's url."""
    return url_filter.judge(_read(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of the quality rules for every document."""
    return quality.score(_read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The byte-level tokenizer file of the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and words that the mix takes of every document."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, tokenizer_path(), keep=["doc_id"])
    return both.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with its suffix sums."""
    return token_counts.suffix_sums(token_counts.histogram(_read(spark, sf_dir, "documents"), tokenizer_path()))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    records = warc.round_trip(_read(spark, sf_dir, "pages"))
    number = lambda c: F.col(c).try_cast("long").alias("page_id" if c == "record_id" else c)
    return records.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that aren't held out."""
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors, k=20), vectors.where("vec_id % 20 = 0"), k=20)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers for every document, with the documents that share its links."""
    import public_tokenizers

    return alignment.align(_read(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first whitened components of all."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    return fingerprints.neighbours(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_token_alignment": op11_token_alignment,
    "op12_whitening": op12_whitening,
    "op13_fingerprints": op13_fingerprints,
    "op6_ann": op6_ann,
    "op1_toxicity": op1_toxicity,
    "op7_simhash": op7_simhash,
    "op2_warc": op2_warc,
    "op4_html_text": op4_html_text,
    "op3_source_mixing": op3_source_mixing,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op5_url_filter": op5_url_filter,
    "op10_quality_rules": op10_quality_rules,
}

_RULE_ROWS = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)

ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first, sha1(h) AS d FROM p GROUP BY h),
e AS (
  SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(d, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)) AS b FROM f)
SELECT page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, array_to_string(b, '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN e ON p.h = e.h
""",
    "op5_url_filter": rf"""
WITH rules(h, p, v) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT s.host, s.path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM parts) s JOIN rules ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)
  GROUP BY ALL)
SELECT page_id, parts.host, parts.path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i + 4]) AS n FROM pos),
rep AS (SELECT r, sum(least(5, gap)) AS n FROM (SELECT r, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5) AS gap FROM win WHERE n > 1) GROUP BY r),
base AS (
  SELECT w.r, doc_id, source, t, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.r = rep.r),
ln AS (
  SELECT r, source, t, trim(regexp_replace(translate(lower_ascii, '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT r, source, t, translate(unnest(string_split(t, chr(10))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM d)),
counted AS (SELECT source, line, count(DISTINCT t) AS n FROM ln WHERE line <> '' GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT t) AS n_docs FROM d GROUP BY ALL),
above AS (
  SELECT c.source, c.line FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n > {quality.LINE_DOCS} AND c.n > {quality.LINE_SHARE} * h.n_docs),
sums AS (
  SELECT ln.r, sum(n) AS words, sum(CASE WHEN a.line IS NULL THEN n ELSE 0 END) AS left_words, count(a.line) AS removed
  FROM (SELECT r, source, line, length(line) - length(replace(line, ' ', '')) + 1 AS n FROM ln WHERE line <> '') ln
  LEFT JOIN above a ON ln.source IS NOT DISTINCT FROM a.source AND ln.line = a.line GROUP BY ALL),
lost AS (SELECT r FROM sums WHERE removed > 0 AND (left_words < {quality.MIN_WORDS} OR left_words < {quality.KEEP_SHARE} * words))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost.r IS NULL AS kept
FROM base LEFT JOIN lost ON base.r = lost.r
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable of (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return dict(ORACLES)
