"""The engine's model on the tables of a scale factor, as frames and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the scale factor."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: a recording for each order."""
    o = read(spark, sf_dir, "orders")
    kind = F.substring("o_orderpriority", 1, 1)

    def pick(*x: str):
        return F.element_at(F.create_map(*[F.lit(v) for k, n in enumerate(x, 1) for v in (str(k), n)]), kind)

    sub, ses = F.format_string("sub-%05d", "o_custkey"), F.format_string("ses-%d", F.year("o_orderdate"))
    name = F.concat(sub, F.lit("_"), ses, F.lit("_task-"), "o_orderstatus", F.format_string("_run-%02d_", F.col("o_orderkey") % 10), pick("T1w", "bold", "dwi", "eeg", "meg"), pick(".nii.gz", ".nii.gz", ".nii.gz", ".edf", ".fif"))
    return o.select(F.concat(F.lit("/ds/"), sub, F.lit("/"), ses, F.lit("/"), pick("anat", "func", "dwi", "eeg", "meg"), F.lit("/"), name).alias("path")).distinct()


FILES_SQL = """
f AS (
  SELECT DISTINCT '/ds/' || sub || '/' || ses || '/' || ['anat', 'func', 'dwi', 'eeg', 'meg'][k] || '/' || sub || '_' || ses || '_task-' || o_orderstatus
    || printf('_run-%02d_', o_orderkey % 10) || ['T1w', 'bold', 'dwi', 'eeg', 'meg'][k] || ['.nii.gz', '.nii.gz', '.nii.gz', '.edf', '.fif'][k] AS path
  FROM (SELECT *, printf('sub-%05d', o_custkey) AS sub, printf('ses-%d', year(o_orderdate)) AS ses, substr(o_orderpriority, 1, 1)::INT AS k FROM orders))"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, grp, ch, idx, value: 64 samples of each recording."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("rec"), F.col("label").alias("grp"), (F.col("vec_id") % 8).alias("ch"), F.posexplode("embedding").alias("idx", "value")).withColumn("value", F.col("value").cast("double"))


SIGNAL_SQL = """
s AS (
  SELECT vec_id AS rec, label AS grp, vec_id % 8 AS ch, (i - 1)::INT AS idx, embedding[i]::DOUBLE AS value
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, run (day), onset (seconds in the day), duration, trial_type, amplitude, event_id."""
    e = read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("subject"), F.to_date("ts").alias("run"), ((us % 86_400_000_000) / 1e6).alias("onset"), F.lit(0.5).alias("duration"),
        F.col("event_type").alias("trial_type"), F.col("value").alias("amplitude"), "event_id",
    )


EVENTS_SQL = """
e AS (
  SELECT user_id AS subject, ts::DATE AS run, (epoch_us(ts) % 86400000000) / 1e6 AS onset, 0.5::DOUBLE AS duration, event_type AS trial_type, value AS amplitude, event_id
  FROM events)"""
