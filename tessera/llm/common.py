"""Helpers that the operators share: scratch tables, words and null-safe keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space other than the blank: tab, line feed, vertical tab, form feed, carriage return.
OTHER_SPACE = "\t\n\x0b\x0c\r"
#: All white space, in a pattern.
SPACE = r" \t\n\x0B\f\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local one where that is unset and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame | None) -> None:
    """Deletes the files of a table made by materialize(), once nothing reads it any more."""
    for path in {p.rpartition("/")[0] for p in df.inputFiles()} if df is not None else ():
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def words_of(text: Column) -> Column:
    """array<string> of the runs of `[^\\x20\\x09-\\x0D]+`; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), OTHER_SPACE, " " * len(OTHER_SPACE))
    return F.array_remove(F.split(flat, " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
