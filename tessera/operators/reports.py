"""Summaries of a catalog in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text


def summary(wide: DataFrame) -> DataFrame:
    """datatype, n_subjects, n_sessions, n_recordings and the sorted tasks of a wide catalog."""
    return wide.where("datatype IS NOT NULL").groupBy("datatype").agg(
        F.countDistinct("subject").alias("n_subjects"), F.countDistinct("session").alias("n_sessions"), F.count("*").alias("n_recordings"),
        F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"),
    )


def method_paragraphs(wide: DataFrame) -> DataFrame:
    """datatype, suffix and a sentence on the number of recordings, subjects and tasks."""
    g = wide.where("datatype IS NOT NULL").groupBy("datatype", "suffix").agg(
        F.countDistinct("subject").alias("n"), F.count("*").alias("k"), F.array_sort(F.collect_set("task")).alias("tasks")
    )
    runs = F.when(F.col("k") == 1, F.lit("run")).otherwise("runs")
    who = F.when(F.col("n") == 1, F.lit("subject")).otherwise("subjects")
    sentence = F.concat_ws(" ", F.initcap(text.number_word(F.col("k"))), runs, F.lit("of"), F.upper("datatype"), F.col("suffix"), F.lit("data were collected from"), text.number_word(F.col("n")), who)
    return g.select("datatype", "suffix", F.concat(sentence, F.lit(" (tasks: "), text.joined(F.col("tasks")), F.lit(").")).alias("sentence"))


def issues(wide: DataFrame) -> DataFrame:
    """severity, code, n: files without a subject or datatype are errors, those without a suffix warnings."""
    found = F.array(
        F.when(F.col("subject").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("NO_SUBJECT").alias("code"))),
        F.when(F.col("datatype").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("NO_DATATYPE").alias("code"))),
        F.when(F.col("suffix").isNull(), F.struct(F.lit("warning").alias("severity"), F.lit("NO_SUFFIX").alias("code"))),
    )
    return wide.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).groupBy("i.severity", "i.code").agg(F.count("*").alias("n"))
