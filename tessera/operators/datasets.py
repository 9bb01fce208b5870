"""Operators on collections of datasets: manifests, splits without leakage, evaluation, benchmark results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest(files: DataFrame, dataset: Column) -> DataFrame:
    """dataset and global_subject (unique across datasets) added to a wide catalog."""
    return files.withColumn("dataset", dataset).withColumn("global_subject", F.concat_ws("_", "dataset", "subject"))


def matches(df: DataFrame, *, modality: str | None = None, suffix: str | None = None, subjects: list[str] = (), not_subjects: list[str] = (), task: str | None = None, extension: str | None = None) -> DataFrame:
    """Files that satisfy every given condition; the modality in any case, the extension as an ending."""
    tests = [
        modality and F.lower("datatype") == modality.lower(), suffix and F.col("suffix") == suffix, subjects and F.col("subject").isin(*subjects),
        not_subjects and ~F.col("subject").isin(*not_subjects), task and F.col("task") == task, extension and F.col("path").endswith(extension),
    ]
    for t in tests:
        if t is not None and not isinstance(t, (str, list, tuple)):
            df = df.where(t)
    return df


def fnv_rank(name: Column, seed: int) -> Column:
    """16 hex digits whose order is a subject's: multiply-then-xor over the bytes, unsigned 64-bit."""

    #: 64-bit arithmetic in two halves, since longs overflow: h * (2 ** 40 + 435) mod 2 ** 64.
    low, mask = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0xFFFFFFFF)
    start = 0xCBF29CE484222325 ^ seed
    text = F.hex(F.encode(name.cast("string"), "UTF-8"))
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, at: Column) -> Column:
        byte = F.conv(F.substring(text, at, F.lit(2)), 16, 10).cast("long")
        a = low(h.lo * 435)
        high = F.shiftright(h.lo * 435, 32) + h.hi * 435 + low(F.shiftleft(h.lo, 8))
        return F.struct(high.bitwiseAND(mask).alias("hi"), a.bitwiseXOR(byte).alias("lo"))

    zero = F.struct(F.lit(start >> 32).cast("long").alias("hi"), F.lit(start & 0xFFFFFFFF).cast("long").alias("lo"))
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.when(name.isNotNull(), F.aggregate(places, zero, step, lambda h: F.concat(digits(h.hi), digits(h.lo))))


def md5_rank(name: Column, seed: int) -> Column:
    """A rank that SQL engines agree on."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), name.cast("string")))


#: Leading characters of a rank that tell its ranges.
RANGE = 3


def _placed(units: DataFrame, unit: str, rank: Column, by: list[str]) -> DataFrame:
    """units with _r (the place by rank from 1) and _n (the number of units) within by.

    Without by, ranks are texts of hash digits: ranges of them are counted, and places within a range start where the
    ranges before it end, so no task has all units.
    """
    if by:
        all_ = Window.partitionBy(*by)
        return units.withColumn("_r", F.row_number().over(all_.orderBy(rank, unit))).withColumn("_n", F.count("*").over(all_))
    u = units.withColumn("_rank", rank).withColumn("_range", F.substring("_rank", 1, RANGE))
    #: 16 ** RANGE rows at most.
    ranges = u.groupBy("_range").agg(F.count("*").alias("_c"))
    upto = Window.orderBy("_range")
    ranges = ranges.select("_range", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("_n"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy("_rank", unit))
    return u.withColumn("_i", inner).join(ranges, "_range").withColumn("_r", F.col("_before") + F.col("_i")).drop("_rank", "_range", "_i", "_before")


def ratio_split(units: DataFrame, unit: str, *, train: float, val: float, rank: Column, by: list[str] = ()) -> DataFrame:
    """units and split: round(n * share) of them by rank, within each of by. units: one row for each unit."""
    r, n = F.col("_r"), F.col("_n")
    a = F.round(n * train)
    split = F.when(r <= a, "train").when(r <= F.least(n, a + F.round(n * val)), "val").otherwise("test")
    return _placed(units, unit, rank, list(by)).withColumn("split", split).drop("_r", "_n")


def k_fold(units: DataFrame, unit: str, k: int, *, rank: Column, by: list[str] = ()) -> DataFrame:
    """units and fold, from 0."""
    return _placed(units, unit, rank, list(by)).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r", "_n")


def subject_k_fold(units: DataFrame, subject: str, k: int, *, rank: Column) -> DataFrame:
    """units and fold: all units of a subject share one, so none is in training and test."""
    return units.join(k_fold(units.select(subject).distinct(), subject, k, rank=rank), subject)


def subject_folds(units: DataFrame, subject: str) -> DataFrame:
    """A row for each held-out subject: held_out, n_test (its units) and n_train (all others').

    A unit's role in a fold is test where its subject is held_out, else train; folds aren't spelled out unit by unit.
    """
    held = units.groupBy(F.col(subject).alias("held_out")).agg(F.count("*").alias("n_test"))
    total = units.agg(F.count("*").alias("_all"))
    #: One row, whatever the size of the table.
    return held.crossJoin(F.broadcast(total)).select("held_out", "n_test", (F.col("_all") - F.col("n_test")).alias("n_train"))


def summary(df: DataFrame, dataset: Column) -> DataFrame:
    """dataset, n: the rows of each dataset."""
    return df.groupBy(dataset.alias("dataset")).agg(F.count("*").alias("n"))


def leave_one_out(units: DataFrame, held: str, keys: list[str]) -> DataFrame:
    """A row for each unit and held-out value of its group: held_out, and role (test or train). One value is no split.

    Held-out values are the few sessions or runs within keys (a subject), gathered to an array and exploded. Across a whole
    table that would be all pairs: subject_folds() has its splits without them, k_fold() a bounded number.
    """
    if not keys:
        raise ValueError("leave_one_out() splits within keys; across a table use subject_folds() or k_fold()")
    values = units.groupBy(*keys).agg(F.array_sort(F.collect_set(held)).alias("_v")).where(F.size("_v") > 1)
    j = units.join(values, list(keys))
    return j.withColumn("held_out", F.explode("_v")).drop("_v").withColumn("role", F.when(F.col(held) == F.col("held_out"), "test").otherwise("train"))


def shuffled_positions(units: DataFrame, order: str, seed: int, by: list[str]) -> DataFrame:
    """position: a reproducible Fisher-Yates shuffle of each group by a linear congruential generator."""
    names = units.columns

    def run(group):
        group = group.sort_values(order, ignore_index=True)
        at, state = list(range(len(group))), (seed + 1) & 0xFFFFFFFFFFFFFFFF
        for i in range(len(at) - 1, 0, -1):
            state = (state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
            j = (state >> 33) % (i + 1)
            at[i], at[j] = at[j], at[i]
        place = {row: p for p, row in enumerate(at)}
        return group.assign(position=[place[k] for k in range(len(at))])

    schema = ", ".join(f"`{c}` {units.schema[c].dataType.simpleString()}" for c in names) + ", position long"
    return units.groupBy(*by).applyInPandas(run, schema)


def within_session_folds(units: DataFrame, order: str, k: int, seed: int, by: list[str]) -> DataFrame:
    """fold: contiguous runs of shuffled positions, the last takes the rest; groups under k are left out."""
    n = F.count("*").over(Window.partitionBy(*by))
    s = shuffled_positions(units.withColumn("_n", n).where(F.col("_n") >= k), order, seed, by)
    return s.withColumn("fold", F.least(F.floor(F.col("position") / F.floor(F.col("_n") / k)), F.lit(k - 1)).cast("int")).drop("_n")


def window_samples(entries: DataFrame, duration: str, size: float, stride: float, *, label: Column | None = None, seed: int | None = None) -> DataFrame:
    """sample, start and end of each window of an entry; label (of its columns) and place, a random order's key, if asked for."""
    n = F.floor((F.col(duration) - size) / stride).cast("int")
    e = entries.where(F.col(duration) >= size).withColumn("sample", F.explode(F.sequence(F.lit(0), n)))
    keys = [c for c in e.columns if c != "sample"]
    e = e.withColumn("start", F.col("sample") * stride).withColumn("end", F.col("sample") * stride + size)
    e = e if label is None else e.withColumn("label", label)
    return e if seed is None else e.withColumn("place", F.xxhash64(F.lit(seed), *keys, "sample"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """label, n; a missing label is _unlabeled_."""
    return df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("_unlabeled_")).alias("label")).agg(F.count("*").alias("n"))


def mean_scores(results: DataFrame, by: list[str], score: str) -> DataFrame:
    """by, mean_score, n."""
    return results.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))


def write_split(df: DataFrame, path: str) -> None:
    """One folder of CSV files for each split; values are quoted where they must be."""
    df.write.mode("error").partitionBy("split").option("header", True).option("escape", '"').csv(path)


# Columns of benchmark results.
BENCHMARK = (
    "dataset string, subject string, session string, pipeline string, paradigm string, eval_type string, score double, scoring string, time_seconds double, "
    "n_train long, n_test long, n_channels long, n_classes long, fold long, notes string"
)


def write_results(results: DataFrame, path: str, *, form: str = "csv", mode: str = "append") -> None:
    """Benchmark results as CSV with a header, or as Parquet; texts with commas, quotes or line feeds are quoted."""
    columns = [c.split()[0] for c in BENCHMARK.split(", ")]
    writer = results.select(*columns).write.mode(mode)
    if form == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_results(spark, path: str, *, form: str = "csv") -> DataFrame:
    """The results that write_results() wrote."""
    if form == "parquet":
        return spark.read.schema(BENCHMARK).parquet(path)
    return spark.read.schema(BENCHMARK).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
