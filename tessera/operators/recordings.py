"""Operators around recordings: picking channels and rows, joining recordings, counts, names and expanded paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths
from tessera.operators import associations, catalog, signal


def modality_files(query: catalog.CatalogQuery, modality: str) -> catalog.CatalogQuery:
    """The recordings of a modality."""
    suffixes, types = config.MODALITIES[modality]
    return query.one_of("suffix", *suffixes).one_of("datatype", *types)


def node_order(df: DataFrame) -> DataFrame:
    """Rows by subject, session, task and run; runs by number."""
    names = [c for c in ("subject", "session", "task", "run") if c in df.columns]
    return df.orderBy(*[F.col(c).try_cast("bigint").asc_nulls_first() if c == "run" else F.col(c).asc_nulls_first() for c in names], *[c for c in names if c == "run"])


def file_at(files: DataFrame, path: str, root: str = "") -> DataFrame:
    """The file of an absolute path, or of one relative to root."""
    wanted = {path, f"{root.rstrip('/')}/{path.lstrip('/')}"}
    return files.where(F.col("path").isin(*sorted(wanted)))


def associated(edges: DataFrame, files: DataFrame, src: str | DataFrame, kind: str | None = None) -> DataFrame:
    """kind and the files that an association leads to from src: a path, or a table of them (src), which is kept beside."""
    e = edges.where(F.col("kind") == kind) if kind else edges
    if isinstance(src, str):
        return e.where(F.col("src") == src).select(F.col("dst").alias("path"), "kind").join(files, "path")
    return e.join(src.select("src").distinct(), "src").select("src", F.col("dst").alias("path"), "kind").join(files, "path")


def gradient_files(images: DataFrame, candidates: DataFrame, extension: str) -> DataFrame:
    """path, nearest: of each diffusion image the nearest file of the extension (.bval or .bvec) above it."""
    return associations.nearest(images, candidates.where((F.col("extension") == extension) & (F.col("suffix") == "dwi")), entities=["subject", "session", "run", "acquisition"])


def gradient_edges(tables: DataFrame, images: DataFrame) -> DataFrame:
    """src, dst: gradient files to the images with their subject, session, run and acquisition."""
    return associations.companions(tables.where(F.col("extension").isin(".bval", ".bvec")), images.where((F.col("suffix") == "dwi") & F.col("extension").isin(".nii", ".nii.gz")), keys=["subject", "session", "run", "acquisition"])


def select_rows(df: DataFrame, order: list[str], places: list[int], by: list[str] = ()) -> DataFrame:
    """The rows at places (from 0) in an order, within by; without by the first max(places) + 1 rows are ranked."""
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
        return df.withColumn("_place", place).where(F.col("_place").isin(*places)).drop("_place")
    first = df.orderBy(*order).limit(max(places, default=-1) + 1)
    return first.withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("_place").isin(*places)).drop("_place")


def name_pattern(pattern: str, *, regex: bool = False) -> str | None:
    """A glob, or a regular expression, as an expression for rlike; None where it isn't a valid one."""
    if not regex:
        return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def match_names(names: DataFrame, pattern: str, *, regex: bool = False) -> DataFrame:
    """Rows whose name fits; an invalid expression fits nothing."""
    found = name_pattern(pattern, regex=regex)
    return names.where(F.col("name").rlike(found) if found else F.lit(False))


def expand_wildcards(selectors: list[str], pool: list[str]) -> list[str]:
    """Selectors with * or ? as the names of the pool that fit, in its order; others stay. Each name once."""
    out = []
    for s in selectors:
        fits = [p for p in pool if re.fullmatch(name_pattern(s)[1:-1], p)] if re.search(r"[*?]", s) else [s]
        out += [x for x in fits if x not in out]
    return out


def trial_types(events: DataFrame) -> DataFrame:
    """The distinct trial types, sorted."""
    return events.where("trial_type IS NOT NULL").select("trial_type").distinct().orderBy("trial_type")


def of_trial_type(events: DataFrame, *names: str) -> DataFrame:
    """The events of trial types."""
    return events.where(F.col("trial_type").isin(*names))


def channel_counts(channels: DataFrame, by: list[str]) -> DataFrame:
    """by, type, n, n_bad."""
    return channels.groupBy(*by, "type").agg(F.count("*").alias("n"), F.count_if(F.lower("status") == "bad").alias("n_bad"))


def bad_channels(channels: DataFrame) -> DataFrame:
    """Channels marked bad."""
    return channels.where(F.lower("status") == "bad")


def pick_channels(s: DataFrame, *, names: list = (), exclude: list = (), types: list[str] = (), channels: DataFrame | None = None) -> DataFrame:
    """Samples of channels by name (place tells the request's order), without some, or of some types (channels: ch, type)."""
    if names:
        table = F.create_map(*[F.lit(x) for k, n in enumerate(dict.fromkeys(names)) for x in (n, k)])
        s = s.withColumn("place", F.try_element_at(table, F.col("ch"))).where("place IS NOT NULL")
    if exclude:
        s = s.where(~F.col("ch").isin(*exclude))
    if types:
        s = s.join(channels.where(F.col("type").isin(*types)).select("ch").distinct(), "ch", "left_semi")
    return s


def concatenate(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """idx of recordings put one after another: each starts where those before it end. parts: keys, order, ch, idx, value.

    Recordings whose channels differ raise an error.
    """
    sizes = parts.groupBy(*keys, order).agg((F.max("idx") + 1).alias("_n"), F.array_sort(F.collect_set("ch")).alias("_channels"))
    one = Window.partitionBy(*keys)
    same = F.min(F.to_json("_channels")).over(one) == F.max(F.to_json("_channels")).over(one)
    start = F.coalesce(F.sum("_n").over(one.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, order, F.when(same, start).otherwise(F.raise_error(F.lit("the recordings' channels differ")).cast("bigint")).alias("_start"))
    return parts.join(starts, [*keys, order]).withColumn("idx", F.col("idx") + F.col("_start")).drop("_start")


def concatenate_annotations(annotations: DataFrame, lengths: DataFrame, keys: list[str], order: str) -> DataFrame:
    """onset counted from the start of the first recording. lengths: keys, order, seconds."""
    start = F.coalesce(F.sum("seconds").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = lengths.withColumn("_start", start).select(*keys, order, "_start")
    return annotations.join(starts, [*keys, order]).withColumn("onset", F.col("onset") + F.col("_start")).drop("_start")


def temporal_mean(volumes: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over volumes of each voxel. volumes: keys, voxel, value."""
    return volumes.groupBy(*keys, "voxel").agg(F.avg("value").alias("mean"), F.count("*").alias("n_volumes"))


def unique_b_values(table: Column, tolerance: float = 1.0) -> Column:
    """The b values of a gradient table, each that is farther than tolerance from all before it."""
    far = lambda found, g: F.forall(found, lambda x: F.abs(x - g.b) > tolerance)
    return F.aggregate(table, F.array().cast("array<double>"), lambda found, g: F.when(far(found, g), F.array_append(found, g.b)).otherwise(found))


def b0_places(table: Column, threshold: float = 50.0) -> Column:
    """The places (from 0) of volumes without diffusion weighting."""
    return F.filter(F.transform(table, lambda g, k: F.when(g.b <= threshold, k)), lambda k: k.isNotNull())


def kind_counts(points: DataFrame) -> DataFrame:
    """n_fiducial, n_hpi, n_eeg, n_extra of digitised points."""
    return points.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("fiducial", "hpi", "eeg", "extra")])


def expanded_paths(values: DataFrame, pattern: str) -> DataFrame:
    """path of every combination of the values, each column an array; patterns are those of paths.build_path()."""
    df = values
    for c in values.columns:
        df = df.withColumn(c, F.explode(c))
    return df.select(paths.build_path({c: F.col(c) for c in values.columns}, pattern).alias("path")).where("path IS NOT NULL").distinct()


def blood_tables(images: DataFrame, files: DataFrame) -> DataFrame:
    """path, blood: of each image the first file of its directory whose name has `blood` and the image's first ten characters."""
    key = lambda p: [paths.dirname(p).alias("_dir"), F.substring(paths.filename(p), 1, 10).alias("_start")]
    blood = files.where(F.contains(paths.filename(F.col("path")), F.lit("blood"))).select(F.col("path").alias("_blood"), *key(F.col("path")))
    first = blood.groupBy("_dir", "_start").agg(F.min("_blood").alias("blood"))
    return images.select("path", *key(F.col("path"))).join(first, ["_dir", "_start"]).select("path", "blood")


def harmonised_rate(inputs: DataFrame, shift: float = 0.0) -> DataFrame:
    """rate: the lowest of the inputs' rates, and a shift; inputs: input, rate."""
    return inputs.agg((F.min("rate") + shift).alias("rate"))


def availability(channels: DataFrame) -> DataFrame:
    """channel, n_inputs: in how many inputs each channel is. channels: input, channel."""
    return channels.groupBy("channel").agg(F.countDistinct("input").alias("n_inputs"))


def derivatives(datasets: DataFrame) -> DataFrame:
    """pipeline, root of derived datasets; a pipeline of two roots is an error. datasets: root, pipeline (null: its directory's name)."""
    d = datasets.select(F.coalesce("pipeline", paths.filename(F.col("root"))).alias("pipeline"), "root").distinct()
    found = d.groupBy("pipeline").agg(F.min("root").alias("root"), F.count("*").alias("n"))
    return found.select("pipeline", F.when(F.col("n") == 1, F.col("root")).otherwise(F.raise_error(F.concat(F.lit("two datasets of the pipeline "), "pipeline"))).alias("root"))


def harmonised_rates(s: DataFrame, rates: DataFrame, target: float, keys: list[str]) -> DataFrame:
    """Samples at one rate: recordings whose rate differs by over 0.01 are resampled. rates: keys[0], rate.

    All rates together in one pass over channels that fit in a block; longer ones take a pass for each rate, of which there are few.
    """
    if not signal._is_long(s):
        return signal.resample_each(s.join(rates.select(keys[0], "rate"), keys[0]), target, keys)
    out = None
    for r in sorted(x.rate for x in rates.select("rate").distinct().collect()):
        part = s.join(rates.where(F.col("rate") == r).select(keys[0]), keys[0], "left_semi").select(*keys, "idx", "value")
        part = part if abs(r - target) <= 0.01 else signal.resample(part, r, target, keys)
        out = part if out is None else out.unionByName(part)
    return out


def voxel_place(shape: tuple[int, int, int], i: Column, j: Column, k: Column) -> Column:
    """The place of a voxel in a volume whose first axis runs fastest; null outside of it."""
    inside = (i >= 0) & (i < shape[0]) & (j >= 0) & (j < shape[1]) & (k >= 0) & (k < shape[2])
    return F.when(inside, i + shape[0] * (j + shape[1] * k))


def voxel_series(volumes: DataFrame, place: int) -> DataFrame:
    """volume, value of one voxel over time. volumes: volume, voxel, value."""
    return volumes.where(F.col("voxel") == place).select("volume", "value").orderBy("volume")
