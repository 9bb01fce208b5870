"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Each distinct (host, path) is expanded into the host suffixes and path prefixes whose shapes occur among
the rules, the expressions are equi-joined with the rules on the first 32 bits of their SHA-256, the full
digests are confirmed, and the longest rule decides.

Defined results: a null url, or one without `://`, has the empty host and path and gets the method's
verdict (allow); so has one that no rule fits. Repeated rows and null ids keep a row each. An empty table
gives an empty result, an empty rule table lets everything pass. Extra columns are not read. Rules that
are repeated with both verdicts block, rules without a host fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize

#: Hex digits of a SHA-256 that the join is on.
SHORT = 8
#: The verdict where no rule fits.
DEFAULT_VERDICT = "allow"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule like `org/`, verdict) pairs as a table of host, path, verdict."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", v) for r, v in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def expressions(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each (host, path) and each shape (labels of the host, length of the path) of a rule.

    Shapes are a table of at most 127 labels times the lengths of a path, whatever the number of rules, and its size
    is known to Spark; a host's suffixes meet it by their number of labels.
    """
    shapes = materialize(rules.select(_labels(F.col("host")).alias("n"), F.length("path").alias("k")).distinct(), "shapes")
    suffixes = sites.withColumn("n", F.explode(F.sequence(F.lit(1), _labels(F.col("host")))))
    met = suffixes.join(shapes, "n").where(F.col("k") <= F.length("path"))
    return met.select("host", "path", F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("n")), F.substring(F.col("path"), F.lit(1), F.col("k"))).alias("expression"))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of every row of pages."""
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != ''")
    seen = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    listed = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    listed = listed.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    asked = expressions(seen.where("host != ''").select("host", "path").distinct(), rules)
    asked = asked.withColumn("asked_digest", F.sha2("expression", 256)).withColumn("short", F.substring("asked_digest", 1, SHORT))
    fits = asked.join(listed, "short").where(F.col("asked_digest") == F.col("digest"))
    best = F.max(F.struct(F.length("rule").alias("length"), "host_length", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict"))
    judged = fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    #: Rows without a host have no rule and aren't joined; they may be very many.
    with_host = seen.where("host != ''").join(judged, ["host", "path"], "left")
    without = seen.where("host = ''").select("host", "path", "id", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return with_host.unionByName(without).select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))
