"""Queries of validation, nodes and mixed collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import schema
from tessera.operators import catalog, models, nodes, validation
from tessera.operators.collections import Collection
from tessera.plans import views
from tessera.plans.catalog_plans import WIDE_SQL
from tessera.plans.signal_plans import _r, _rounded
from tessera.plans.views import EVENTS_SQL, FILES_SQL

#: Datasets that the recordings are dealt to.
DATASETS = 40


def _datasets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files and contents of datasets, some with wrong names, descriptions, sidecars, or without a README."""
    rel = F.regexp_replace("path", "^/ds/", "")
    number = F.regexp_extract("path", r"sub-(\d+)", 1).cast("long")
    f = views.files(spark, d).select(number.alias("sub"), rel.alias("path"))
    wrong = F.when(F.col("sub") % 7 == 0, F.regexp_replace("path", "_run-", "_run:")).when(F.col("sub") % 11 == 0, F.regexp_replace("path", "^sub-0", "sub-X")).when(F.col("sub") % 13 == 0, F.regexp_replace("path", "/ses-", "/ses-9")).otherwise(F.col("path"))
    f = f.select((F.col("sub") % DATASETS).alias("dataset"), wrong.alias("path"))
    some = f.select("dataset").distinct()
    at = F.col("dataset")
    bare = spark.range(DATASETS, DATASETS + 5).select(F.col("id").alias("dataset"))
    every = some.union(bare)
    readme = every.where(at % 3 > 0).select("dataset", F.when(at % 2 == 0, "README").otherwise("README.md").alias("path"))
    said = every.where(at % 5 > 0).select("dataset", F.lit(validation.DESCRIPTION).alias("path"))
    other = every.select("dataset", F.lit("participants.json").alias("path"))
    text = F.when(at % 5 == 1, '{"Name": ').when(at % 5 == 2, '{"BIDSVersion": "1.8.0"}').when(at % 5 == 3, '{"Name": "n", "BIDSVersion": " "}').otherwise('{"Name": "n", "BIDSVersion": "1.8.0"}')
    contents = said.withColumn("text", text).unionByName(other.withColumn("text", F.when(at % 4 == 0, "[1, 2]").otherwise("{}")))
    return f.unionByName(readme).unionByName(said).unionByName(other), contents


def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    return validation.issues(*_datasets(spark, d)).select("dataset", "severity", "code", "path")


def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    files, contents = _datasets(spark, d)
    return validation.counts(files, validation.issues(files, contents))


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """A search for each customer: its subject (a few name none, and no other entity but the task), some with session, task or run."""
    c, k = views.read(spark, d, "customer"), F.col("c_custkey")
    few = k % 701 == 0
    return c.select(
        k.alias("id"), F.when(~few, F.format_string("%05d", k)).alias("subject"), F.when(~few & (k % 3 == 0), F.format_string("%d", 1992 + k % 7)).alias("session"),
        F.when(k % 2 == 0, F.when(k % 4 == 0, "F").otherwise("O")).alias("task"), F.when(~few & (k % 5 == 0), F.format_string("%02d", k % 10)).alias("run"),
    )


def found_nodes(spark: SparkSession, d: str) -> DataFrame:
    tree = nodes.nodes(catalog.wide(views.files(spark, d)))
    return nodes.find_nodes(_searches(spark, d), tree, level="run")


def nearest_nodes(spark: SparkSession, d: str) -> DataFrame:
    tree = nodes.nodes(catalog.wide(views.files(spark, d)))
    return nodes.nearest_node(_searches(spark, d), tree)


def _collection(spark: SparkSession, d: str) -> Collection:
    """Events of a day squeezed to 100 seconds as sparse variables, and an oscillation of eight bins as a dense one."""
    e = views.events(spark, d).select("subject", "run", F.floor(F.col("onset") / 864 * 4).cast("double").alias("q"), "event_id", "amplitude", "trial_type")
    one = F.when(F.col("trial_type") == "click", F.col("amplitude")).otherwise(0.0)
    s = e.select("subject", "run", (F.col("q") / 4).alias("onset"), F.lit(0.5).alias("duration"), "event_id", "amplitude", one.alias("clicks"))
    runs = e.select("subject", "run").distinct()
    dense = runs.select("subject", "run", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: ((i * 3 + F.col("subject")) % 8).cast("double"))).alias("bin", "wave")).withColumn("bin", F.col("bin").cast("long"))
    return Collection(["subject", "run"], s, dense, 4.0)


def mixed_variables(spark: SparkSession, d: str) -> DataFrame:
    steps = [
        {"Name": "Scale", "Input": ["amplitude"], "Rescale": False},
        {"Name": "Threshold", "Input": ["clicks"], "Threshold": 0.5, "Binarize": True},
        {"Name": "ToDense", "Input": ["clicks"]},
        {"Name": "Sum", "Input": ["clicks", "wave"], "Weights": [2.0, 0.5], "Output": "mix"},
        {"Name": "Product", "Input": ["mix", "amplitude"], "Output": "product"},
        {"Name": "Resample", "SamplingRate": 8.0},
    ]
    return _rounded(_collection(spark, d).run(steps).table().where("bin < 60"), "clicks", "wave", "mix", "amplitude", "product")


def two_level_model(spark: SparkSession, d: str) -> DataFrame:
    spec = {
        "Nodes": [
            {"Name": "runs", "Level": "Run", "GroupBy": ["subject", "run"], "Transformations": {"Instructions": [{"Name": "ToDense", "Input": ["clicks", "amplitude"]}, {"Name": "Resample", "SamplingRate": 8.0}]}, "Model": {"X": [1, "clicks", "wave"]}, "Contrasts": [{"Name": "gap", "ConditionList": ["clicks", "wave"], "Weights": [1, -0.5]}]},
            {"Name": "people", "Level": "Subject", "GroupBy": ["subject"], "Transformations": {"Instructions": [{"Name": "Product", "Input": ["gap", "age"], "Output": "aged"}]}, "Model": {"X": [1, "gap", "age", "aged"]}},
        ]
    }
    people = views.events(spark, d).select("subject").distinct().withColumn("age", (20 + F.col("subject") % 50).cast("double"))
    out = models.Graph.from_json(spec).run({"run": _collection(spark, d), "subject": people}, ["subject", "run", "bin"])["people"]
    return _rounded(out.groupBy("subject").agg(F.count("*").alias("n"), F.sum("gap").alias("gap"), F.max("age").alias("age"), F.sum("aged").alias("aged"), F.sum("intercept").alias("ones")), "gap", "aged", "ones")


QUERIES = {f.__name__: f for f in (validation_issues, validation_counts, found_nodes, nearest_nodes, mixed_variables, two_level_model)}

_DATASETS = rf"""WITH {FILES_SQL},
g AS (SELECT regexp_extract(path, 'sub-(\d+)', 1)::BIGINT AS sub, regexp_replace(path, '^/ds/', '') AS path FROM f),
h AS (SELECT sub % {DATASETS} AS dataset, CASE WHEN sub % 7 = 0 THEN replace(path, '_run-', '_run:') WHEN sub % 11 = 0 THEN regexp_replace(path, '^sub-0', 'sub-X') WHEN sub % 13 = 0 THEN replace(path, '/ses-', '/ses-9') ELSE path END AS path FROM g),
every AS (SELECT DISTINCT dataset FROM h UNION SELECT unnest(range({DATASETS}, {DATASETS + 5}))),
x AS (SELECT dataset, path, regexp_extract(path, '^sub-([^/]+)/', 1) AS folder, regexp_extract(path, '([^/]+)$', 1) AS file, regexp_extract(path, '^sub-[^/]+/ses-([^/]+)/', 1) AS ses,
  regexp_extract(path, '/sub-([^/_]+)[^/]*$', 1) AS fsub, regexp_extract(path, '_ses-([^/_]+)[^/]*$', 1) AS fses FROM h),
i AS (
  SELECT dataset, 'error' AS severity, 'MISSING_DATASET_DESCRIPTION' AS code, NULL AS path FROM every WHERE dataset % 5 = 0
  UNION ALL SELECT dataset, 'error', 'INVALID_DATASET_DESCRIPTION', '{validation.DESCRIPTION}' FROM every WHERE dataset % 5 = 1
  UNION ALL SELECT dataset, 'error', 'MISSING_NAME', '{validation.DESCRIPTION}' FROM every WHERE dataset % 5 = 2
  UNION ALL SELECT dataset, 'error', 'MISSING_BIDS_VERSION', '{validation.DESCRIPTION}' FROM every WHERE dataset % 5 = 3
  UNION ALL SELECT dataset, 'warning', 'MISSING_README', NULL FROM every WHERE dataset % 3 = 0
  UNION ALL SELECT dataset, 'error', 'NO_SUBJECTS', NULL FROM every WHERE dataset NOT IN (SELECT dataset FROM h)
  UNION ALL SELECT dataset, 'warning', 'INVALID_FILENAME', path FROM x WHERE NOT regexp_matches(path, '{{pattern}}')
  UNION ALL SELECT dataset, 'error', 'SUBJECT_MISMATCH', path FROM x WHERE fsub <> folder
  UNION ALL SELECT dataset, 'error', 'SESSION_MISMATCH', path FROM x WHERE ses <> '' AND fses <> '' AND ses <> fses
  UNION ALL SELECT dataset, 'error', 'INVALID_JSON', 'participants.json' FROM every WHERE dataset % 4 = 0)""".replace("{pattern}", schema.path_pattern())

_SEARCHES = """q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 701 > 0 THEN printf('%05d', c_custkey) END AS subject, CASE WHEN c_custkey % 701 > 0 AND c_custkey % 3 = 0 THEN (1992 + c_custkey % 7)::VARCHAR END AS session,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'F' ELSE 'O' END END AS task, CASE WHEN c_custkey % 701 > 0 AND c_custkey % 5 = 0 THEN printf('%02d', c_custkey % 10) END AS run FROM customer),
n AS (SELECT 'run' AS level, subject, session, task, run, count(*) AS n_files, min(path) AS image FROM w GROUP BY subject, session, task, run)"""

_MIXED = f"""WITH {EVENTS_SQL},
s AS (SELECT subject, run, floor(onset / 864 * 4)::BIGINT AS q, event_id, amplitude, CASE WHEN trial_type = 'click' THEN amplitude ELSE 0 END AS clicks FROM e),
r AS (SELECT DISTINCT subject, run FROM s),
p AS (SELECT s.*, q + k AS bin, q / 4.0::DOUBLE AS onset FROM s, range(0, 2) g(k)),
d AS (SELECT subject, run, bin, arg_max({{clicks}}, (onset, event_id)) AS clicks, arg_max({{amplitude}}, (onset, event_id)) AS amplitude FROM p GROUP BY subject, run, bin),
wv AS (SELECT subject, run, i::BIGINT AS bin, ((i * 3 + subject) % 8)::DOUBLE AS wave FROM r, range(0, 50) g(i)),
n AS (SELECT subject, run, max(bin) AS n FROM (SELECT subject, run, bin FROM d UNION ALL SELECT subject, run, bin FROM wv) GROUP BY ALL),
grid AS (SELECT subject, run, unnest(range(0, n + 1)) AS bin FROM n),
f AS (SELECT subject, run, bin, coalesce(clicks, 0) AS clicks, coalesce(wave, 0) AS wave, coalesce(amplitude, 0) AS amplitude FROM grid LEFT JOIN d USING (subject, run, bin) LEFT JOIN wv USING (subject, run, bin)),
t AS (SELECT *, 2 * clicks + 0.5 * wave AS mix FROM f), u AS (SELECT *, mix * amplitude AS product FROM t),
z AS (SELECT u.*, k, lead(clicks, 1, clicks) OVER o AS c2, lead(wave, 1, wave) OVER o AS w2, lead(amplitude, 1, amplitude) OVER o AS a2, lead(mix, 1, mix) OVER o AS b2, lead(product, 1, product) OVER o AS p2
  FROM u, range(0, 2) g(k) WINDOW o AS (PARTITION BY subject, run, k ORDER BY bin))"""
_HALF = lambda a, b: f"CASE k WHEN 0 THEN {a} ELSE ({a} + {b}) / 2 END"

ORACLES = {
    "validation_issues": f"{_DATASETS} SELECT dataset, severity, code, path FROM i",
    "validation_counts": f"{_DATASETS}, c AS (SELECT dataset, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY dataset) SELECT dataset, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid FROM every LEFT JOIN c USING (dataset)",
    "found_nodes": f"""WITH {WIDE_SQL}, {_SEARCHES}, m AS (
      SELECT id, n.* FROM q JOIN n ON q.subject = n.subject WHERE (q.session IS NULL OR n.session IS NULL OR q.session = n.session) AND (q.task IS NULL OR n.task IS NULL OR q.task = n.task) AND (q.run IS NULL OR n.run IS NULL OR q.run = n.run)
      UNION ALL SELECT id, n.* FROM q, n WHERE q.subject IS NULL AND (q.task IS NULL OR n.task IS NULL OR q.task = n.task))
      SELECT id, (row_number() OVER (PARTITION BY id ORDER BY subject NULLS FIRST, session NULLS FIRST, task NULLS FIRST, run NULLS FIRST))::INT AS rank, level, subject, session, task, run, n_files, image FROM m""",
    "nearest_nodes": f"""WITH {WIDE_SQL}, {_SEARCHES}, h AS (
      SELECT id, 3 AS depth, n.subject, n.session, n.task, n.run FROM q JOIN n ON q.subject = n.subject AND q.session = n.session AND q.task = n.task AND q.run = n.run
      UNION ALL SELECT id, 2, q.subject, q.session, NULL, NULL FROM q WHERE (q.subject, q.session) IN (SELECT (subject, session) FROM w)
      UNION ALL SELECT id, 1, q.subject, NULL, NULL, NULL FROM q WHERE q.subject IN (SELECT subject FROM w)
      UNION ALL SELECT id, 0, NULL, NULL, NULL, NULL FROM q),
      b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS r FROM h)
      SELECT id, ['dataset', 'subject', 'session', 'run'][depth + 1] AS level, subject, session, task, run FROM b WHERE r = 1""",
    "mixed_variables": _MIXED.format(clicks="CASE WHEN clicks >= 0.5 THEN 1.0 ELSE 0 END::DOUBLE", amplitude="amplitude - m").replace("FROM e),\nr AS", "FROM e),\nmm AS (SELECT subject AS ms, run AS mr, avg(amplitude) AS m FROM s GROUP BY ALL),\nr AS").replace("FROM s, range(0, 2) g(k)),\nd AS", "FROM s, range(0, 2) g(k)),\nd AS").replace("FROM p GROUP BY subject, run, bin)", "FROM p JOIN mm ON subject = ms AND run = mr GROUP BY subject, run, bin)")
    + f" SELECT subject, run, 2 * bin + k AS bin, {_r(_HALF('clicks', 'c2'))} AS clicks, {_r(_HALF('wave', 'w2'))} AS wave, {_r(_HALF('mix', 'b2'))} AS mix, {_r(_HALF('amplitude', 'a2'))} AS amplitude, {_r(_HALF('product', 'p2'))} AS product FROM z WHERE 2 * bin + k < 60",
    "two_level_model": _MIXED.format(clicks="clicks", amplitude="amplitude") + f", y AS (SELECT subject, {_HALF('clicks', 'c2')} - 0.5 * ({_HALF('wave', 'w2')}) AS gap, (20 + subject % 50)::DOUBLE AS age FROM z) SELECT subject, count(*) AS n, {_r('sum(gap)')} AS gap, max(age) AS age, {_r('sum(gap * age)')} AS aged, {_r('count(*)::DOUBLE')} AS ones FROM y GROUP BY subject",
}
