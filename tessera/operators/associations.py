"""Joins of the catalog: inherited metadata, nearest files, companions, intended targets, field maps.

A file's directories are exploded, so inheritance is an equi-join on (directory, suffix); conditions on
entities that the other side may lack are checked after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths


def with_ancestors(files: DataFrame) -> DataFrame:
    """files, a row for each directory above, with depth and dir."""
    return files.withColumn("a", F.explode(paths.ancestors(F.col("path")))).select("*", "a.depth", "a.dir").drop("a")


def inherited(files: DataFrame, sidecars: DataFrame, *, entities: list[str], strict: bool = False) -> DataFrame:
    """path, key, value, origin: each key from the deepest sidecar that applies.

    files: path, suffix and the entities; sidecars: path, dir, suffix, key, value and the entities. A sidecar
    applies if its entities equal the file's; one that the file lacks fits, unless strict. In one directory
    the sidecar with more entities wins, then the later path.
    """
    named = [F.col(e).alias(f"s_{e}") for e in entities]
    s = sidecars.select(F.col("path").alias("origin"), "dir", "suffix", "key", "value", sum((F.col(e).isNotNull().cast("int") for e in entities), F.lit(0)).alias("own"), *named)
    j = with_ancestors(files.select("path", "suffix", *entities)).join(s, ["dir", "suffix"])
    for e in entities:
        fits = F.col(f"s_{e}").isNull() | (F.col(e) == F.col(f"s_{e}"))
        j = j.where(fits if strict else fits | F.col(e).isNull())
    best = F.max(F.struct("depth", "own", "origin", "value"))
    return j.groupBy("path", "key").agg(best.alias("b")).select("path", "key", "b.value", "b.origin")


def metadata_edges(files: DataFrame, sidecars: DataFrame, *, entities: list[str]) -> DataFrame:
    """src, dst, kind: Metadata from a sidecar to its files; Child and Parent between a file's sidecars of neighbouring depth."""
    keys = sidecars.select("path", "dir", "suffix", *entities).distinct().withColumn("key", F.lit("")).withColumn("value", F.lit(""))
    named = [F.col(e).alias(f"s_{e}") for e in entities]
    j = with_ancestors(files.select("path", "suffix", *entities)).join(keys.select(F.col("path").alias("origin"), "dir", "suffix", *named), ["dir", "suffix"])
    for e in entities:
        j = j.where(F.col(f"s_{e}").isNull() | F.col(e).isNull() | (F.col(e) == F.col(f"s_{e}")))
    j = j.withColumn("above", F.lag("origin").over(Window.partitionBy("path").orderBy("depth", "origin")))
    chain = j.where("above IS NOT NULL").select("above", "origin").distinct()
    return (
        j.select(F.col("origin").alias("src"), F.col("path").alias("dst"), F.lit("Metadata").alias("kind"))
        .union(chain.select("origin", "above", F.lit("Child")))
        .union(chain.select("above", "origin", F.lit("Parent")))
        .distinct()
    )


def intended_for(images: DataFrame, root: str) -> DataFrame:
    """src, dst, kind in both directions. images: path, subject, intended array<string>."""
    x = F.col("target")
    dst = (
        F.when(x.startswith("bids::"), F.concat(F.lit(root + "/"), F.substring(x, 7, 1 << 30)))
        .when(x.startswith("bids:"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(root + "/sub-"), F.col("subject"), F.lit("/"), x))
    )
    e = images.select("path", "subject", F.explode("intended").alias("target")).select(F.col("path").alias("src"), dst.alias("dst")).where("dst IS NOT NULL")
    return e.select("src", "dst", F.lit("IntendedFor").alias("kind")).union(e.select("dst", "src", F.lit("InformedBy"))).distinct()


def companions(sources: DataFrame, targets: DataFrame, *, keys: list[str], required: str = "subject") -> DataFrame:
    """src, dst: equal on every key that the source has. required is a key both sides have, on which they are joined."""
    t = targets.select(F.col("path").alias("dst"), *[F.col(k).alias(f"t_{k}") for k in keys])
    j = sources.select(F.col("path").alias("src"), *keys).join(t, F.col(required) == F.col(f"t_{required}"))
    for k in keys:
        j = j.where(F.col(k).isNull() | (F.col(k) == F.col(f"t_{k}")))
    return j.where("src != dst").select("src", "dst")


def nearest(files: DataFrame, candidates: DataFrame, *, entities: list[str]) -> DataFrame:
    """path, nearest: of the candidates in the deepest directory above a file, that with most equal entities, then the smallest path."""
    c = candidates.select(F.col("path").alias("candidate"), paths.dirname(F.col("path")).alias("dir"), *[F.col(e).alias(f"c_{e}") for e in entities])
    j = with_ancestors(files.select("path", *entities)).join(c, "dir").where("candidate != path")
    score = sum((F.coalesce((F.col(e) == F.col(f"c_{e}")).cast("int"), F.lit(0)) for e in entities), F.lit(0))
    order = Window.partitionBy("path").orderBy(F.desc("depth"), F.desc("score"), "candidate")
    return j.withColumn("score", score).withColumn("r", F.row_number().over(order)).where("r = 1").select("path", F.col("candidate").alias("nearest"))


def field_maps(files: DataFrame, maps: DataFrame) -> DataFrame:
    """path, fieldmap: maps one of whose intended targets is the end of the path. maps: path, target.

    The ends of a path at its slashes are exploded, so this is an equi-join too.
    """
    parts = F.split(F.col("path"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    tails = files.select("path", F.explode(F.array_distinct(ends)).alias("target"))
    return tails.join(maps.select(F.col("path").alias("fieldmap"), F.ltrim("target", F.lit("/")).alias("target")), "target").select("path", "fieldmap").distinct()


def expand_missing(rows: DataFrame, key: str) -> DataFrame:
    """Rows without a key stand for every observed value of it; the values are aggregated to one array row.

    The key is an entity with few values, as sessions or runs are: the result has a row for each of them and each row without.
    """
    values = rows.where(F.col(key).isNotNull()).agg(F.array_sort(F.collect_set(key)).alias("_values"))
    filled = rows.crossJoin(values).withColumn(key, F.explode(F.when(F.col(key).isNotNull(), F.array(key)).otherwise(F.col("_values"))))
    return filled.drop("_values")


def lenient_match(a: Column, b: Column) -> Column:
    """Equal, or one side missing."""
    return a.isNull() | b.isNull() | (a == b)
