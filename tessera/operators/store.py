"""The catalog on disk: files, tags and associations as Parquet, partitioned by what queries filter on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, schema
from tessera.operators import catalog
from tessera.sources import files as listings


def scan(spark: SparkSession, root: str, *, ignore: list[str] = (r"/\.", "/code/", "/sourcedata/", "/stimuli/"), force: list[str] = (), validate: bool = False) -> DataFrame:
    """path, length, modified of a dataset's files; ignored ones go unless forced; a .zarr directory is one file.

    With validate, files whose path under the root isn't one of the standard go too, unless forced.

    The root's own derivatives/ is left to a scan of its own; a root without dataset_description.json is an error.
    """
    found = listings.listing(spark, root)
    top = re.escape(re.sub(r"^file:/+", "/", root).rstrip("/"))
    if found.where(F.col("path").rlike(f"^{top}/dataset_description\\.json$")).isEmpty():
        raise ValueError(f"{root} isn't a dataset: it has no dataset_description.json")
    keep = ~paths.matches_any(F.col("path"), list(ignore))
    if force:
        keep = keep | paths.matches_any(F.col("path"), list(force))
    if validate:
        valid = schema.is_valid(F.regexp_replace("path", f"^{top}/", "")) | F.col("path").rlike(r"\.zarr/")
        keep = keep & (valid | paths.matches_any(F.col("path"), list(force)) if force else valid)
    found = found.where(keep & ~F.col("path").rlike(f"^{top}/derivatives/"))
    plain = found.where(~F.col("path").rlike(r"\.zarr/"))
    stores = found.withColumn("path", F.regexp_extract("path", r"^(.*?\.zarr)/", 1)).where("path != ''").groupBy("path").agg(F.sum("length").alias("length"), F.max("modified").alias("modified"))
    return plain.unionByName(stores)


def save(files: DataFrame, path: str, *, mode: str = "error") -> None:
    """Writes files and tags; tags are partitioned by entity, so a condition reads its entity alone."""
    files.write.mode(mode).parquet(f"{path}/files")
    catalog.tags(files).write.mode(mode).partitionBy("entity").parquet(f"{path}/tags")


def load(spark: SparkSession, path: str) -> catalog.CatalogQuery:
    """A query over a saved catalog."""
    return catalog.CatalogQuery(spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/tags").select("path", "entity", "value"))


def is_stale(saved: DataFrame, current: DataFrame) -> bool:
    """Whether the listing differs from the saved one: one aggregation of each to a count and a fingerprint."""
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length"))).first()
    return mark(saved) != mark(current)


def content_addressed(spark: SparkSession, root: str) -> DataFrame:
    """path, key: contents by SHA-256 and length; equal contents share a key."""
    blob = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return blob.select("path", F.concat_ws("-", F.sha2("content", 256), F.col("length").cast("string")).alias("key"))
