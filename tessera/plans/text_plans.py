"""Queries of texts, reports and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import catalog, reports
from tessera.plans import catalog_plans, views
from tessera.plans.signal_plans import _r, _rounded
from tessera.streaming import windows


def hed_tags(spark: SparkSession, d: str) -> DataFrame:
    e = views.read(spark, d, "events").select("event_id", F.concat(F.lit("Sensory-event, ("), "event_type", F.lit(", Item/"), F.col("user_id").cast("string"), F.lit("), Red")).alias("hed"))
    return e.select("event_id", F.array_join(text.hed_tags(F.col("hed")), "|").alias("tags"), F.size(text.hed_tree(F.col("hed"))).alias("n_top"))


def letter_case(spark: SparkSession, d: str) -> DataFrame:
    made = F.regexp_replace(F.initcap(F.lower("p_name")), " ", "")
    p = views.read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("MRI"), made, F.lit("2D"))).otherwise(made).alias("camel"))
    return p.select("p_partkey", text.camel_to_snake(F.col("camel")).alias("snake"), text.snake_to_camel(text.camel_to_snake(F.col("camel"))).alias("camel"))


def grammatical_number(spark: SparkSession, d: str) -> DataFrame:
    words = ["box", "city", "leaf", "child", "series", "key", "bus", "axis", "run"]
    n = views.read(spark, d, "nation").select("n_nationkey", F.get(F.array(*map(F.lit, words)), F.col("n_nationkey") % len(words)).alias("word"))
    return n.select("n_nationkey", "word", text.plural(F.col("word")).alias("plural"), text.singular(text.plural(F.col("word"))).alias("back"))


def version_compat(spark: SparkSession, d: str) -> DataFrame:
    n = views.read(spark, d, "nation").select("n_nationkey", F.format_string("%d.%d.%d", F.col("n_regionkey"), F.col("n_nationkey") % 12, F.col("n_nationkey") % 2).alias("version"))
    return n.select("n_nationkey", "version", text.compatibility(F.col("version"), F.lit("1.10.0")).alias("compatibility"))


def methods_report_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.method_paragraphs(catalog.wide(views.files(spark, d)))


def modality_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary(catalog.wide(views.files(spark, d)))


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.counted(views.read(spark, d, "events"), "1 hour"), "total")


def sliding(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.counted(views.read(spark, d, "events"), "2 hours", "1 hour"), "total")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(views.read(spark, d, "events"), "12 hours")


def triggers(spark: SparkSession, d: str) -> DataFrame:
    s = views.read(spark, d, "events").select(F.col("user_id").alias("rec"), F.col("event_id").alias("idx"), (F.floor(F.col("value")) % 3 + 65536 * (F.col("event_id") % 2)).cast("long").alias("status"))
    return windows.triggers(s)


QUERIES = {f.__name__: f for f in (hed_tags, letter_case, grammatical_number, version_compat, methods_report_rows, modality_summary, tumbling, sliding, sessions, triggers)}

_WORDS = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten']"
ORACLES = {
    "hed_tags": "SELECT event_id, 'Sensory-event|' || event_type || '|Item/' || user_id || '|Red' AS tags, 3 AS n_top FROM events",
    "letter_case": """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mri_' || replace(lower(p_name), ' ', '_') || '2_d' ELSE replace(lower(p_name), ' ', '_') END AS snake FROM part)
      SELECT p_partkey, snake, array_to_string(list_transform(string_split(snake, '_'), lambda x: upper(x[1:1]) || x[2:]), '') AS camel FROM s""",
    "grammatical_number": """WITH w AS (SELECT n_nationkey, ['box', 'city', 'leaf', 'child', 'series', 'key', 'bus', 'axis', 'run'][1 + n_nationkey % 9] AS word FROM nation)
      SELECT n_nationkey, word, CASE word WHEN 'box' THEN 'boxes' WHEN 'city' THEN 'cities' WHEN 'leaf' THEN 'leaves' WHEN 'child' THEN 'children' WHEN 'series' THEN 'series' WHEN 'key' THEN 'keys'
        WHEN 'bus' THEN 'buses' WHEN 'axis' THEN 'axes' WHEN 'run' THEN 'runs' END AS plural, word AS back FROM w""",
    "version_compat": """WITH v AS (SELECT n_nationkey, printf('%d.%d.%d', n_regionkey, n_nationkey % 12, n_nationkey % 2) AS version, n_regionkey AS a, n_nationkey % 12 AS b, n_nationkey % 2 AS c FROM nation)
      SELECT n_nationkey, version, CASE WHEN a <> 1 THEN 'incompatible' WHEN b = 10 AND c = 0 THEN 'exact' WHEN b < 10 THEN 'compatible' ELSE 'newer' END AS compatibility FROM v""",
    "methods_report_rows": f"""WITH {catalog_plans.WIDE_SQL}, g AS (SELECT datatype, suffix, count(DISTINCT subject) AS n, count(*) AS k, list_sort(list(DISTINCT task)) AS t FROM w GROUP BY ALL)
      SELECT datatype, suffix, CASE WHEN k <= 10 THEN upper({_WORDS}[k + 1][1:1]) || {_WORDS}[k + 1][2:] ELSE k::VARCHAR END || CASE k WHEN 1 THEN ' run of ' ELSE ' runs of ' END || upper(datatype) || ' ' || suffix
        || ' data were collected from ' || CASE WHEN n <= 10 THEN {_WORDS}[n + 1] ELSE n::VARCHAR END || CASE n WHEN 1 THEN ' subject' ELSE ' subjects' END || ' (tasks: '
        || CASE WHEN len(t) <= 1 THEN array_to_string(t, '') ELSE array_to_string(t[:-2], ', ') || ' and ' || t[-1] END || ').' AS sentence FROM g""",
    "modality_summary": f"WITH {catalog_plans.WIDE_SQL} SELECT datatype, count(DISTINCT subject) AS n_subjects, count(DISTINCT session) AS n_sessions, count(*) AS n_recordings, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM w GROUP BY datatype",
    "tumbling": f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, {_r('sum(value)')} AS total FROM events GROUP BY ALL",
    "sliding": f"SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, event_type, count(*) AS n, {_r('sum(value)')} AS total FROM events, range(0, 2) x(k) GROUP BY ALL",
    "sessions": """WITH s AS (SELECT user_id, ts, coalesce((ts >= lag(ts) OVER w + INTERVAL 12 HOUR)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""",
    "triggers": """WITH s AS (SELECT user_id AS rec, event_id AS idx, (floor(value)::BIGINT % 3) AS code FROM events), k AS (SELECT *, coalesce(lag(code) OVER (PARTITION BY rec ORDER BY idx), 0) AS before FROM s)
      SELECT rec, idx, code FROM k WHERE code <> before AND code <> 0""",
}
