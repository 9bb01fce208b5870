"""Mixing sources to target weights by entropy balancing.

Targets: a budget of BUDGET times all words is shared by weight, and a source's target stops at CAP times
its words; what is over is reshared by weight until no target is above (in closed form, over the sources in
the order of cap to weight).

Rates: for each source, the rates closest in entropy to one copy of each document, between 0 and CAP, whose
words sum up to the target: min(CAP, exp(lambda * size / mean size)). The dual in lambda is convex; each
Newton iteration (on the logarithm of the words) is one aggregation over the histogram of (source, size), which holds all that the dual
needs, and a step that leaves the bracket of the solution halves it instead.

Copies: in groups of about GROUP documents of a source, from the largest to the smallest, each document takes
the number of copies that brings the words so far closest to the sum of their rates; so a group ends within
half of a small document of its sum. Rows equal in id, text (by MD5) and source are one kind of document, which
is counted before it is dealt to the groups by a hash of the kind and the row's number among its rows, so many
equal rows are spread like others.

Defined results: a null or empty text has size 0 and takes 0 words; apply() keeps it once. A null source is a
source of its own and comes last. Repeated rows and null ids keep a row each; which of several equal rows takes
more copies is open. An empty table gives an empty result. Other columns, of any name, aren't read by mix() and
are passed on by apply().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, materialize

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input.
BUDGET = 1.5
#: Copies of a document at most.
CAP = 2
#: Documents that are rounded together, equal rows that one row stands for on the way there.
GROUP = 4096
RUN = 4096
#: Newton iterations at most, the part of a target that may be missed before rounding, iterations between two tables.
ITERATIONS, TOLERANCE, STEPS = 96, 1e-9, 4


def size_of(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text (null: 0)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """sid, source, source_size, docs, least, target: one row for each source of sized (source, size, rows).

    The windows go over the sources, not over the documents.
    """
    s = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), F.col("sid") % len(WEIGHTS)).cast("double"))
    s = s.withColumn("cap", CAP * F.col("source_size").cast("double")).withColumn("budget", BUDGET * F.sum("source_size").over(everything))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    target = F.least("cap", F.col("weight") * F.max("level").over(everything))
    return s.select("sid", "source", "source_size", "docs", "least", target.alias("target"))


def rate_of(tilt: Column, size: Column, mean: Column) -> Column:
    """The rate of a document of that size; a null tilt stands for every document at the cap."""
    return F.when(tilt.isNull(), F.lit(float(CAP))).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(tilt * size / mean, F.lit(math.log(CAP) + 1.0)))))


def tilts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """sid, tilt, mean: the solved dual variable of each source (null: the cap everywhere)."""
    h = materialize(sized.where("size > 0").groupBy("sid", "size").agg(F.sum("rows").alias("n")), "sizes")
    g = goals.where("source_size > 0").withColumn("mean", F.col("source_size") / F.col("docs"))
    part, shortest = F.col("target") / F.col("source_size"), F.col("least") / F.col("mean")
    state = g.select(
        "sid",
        "target",
        "mean",
        (F.col("target") >= CAP * F.col("source_size")).alias("full"),
        (F.least(F.log(part), F.lit(0.0)) / shortest).alias("low"),
        (F.log(F.lit(float(CAP))) / shortest).alias("high"),
        F.lit(0.0).alias("tilt"),
        F.lit(float("inf")).alias("missed"),
    )
    for _ in range(0, ITERATIONS, STEPS):
        for _ in range(STEPS):
            state = _newton(state, h)
        state = materialize(state, "tilts")
        if state.where(f"NOT full AND missed > {TOLERANCE}").isEmpty():
            break
    else:
        raise ArithmeticError(f"the dual isn't solved to {TOLERANCE} after {ITERATIONS} iterations")
    #: Rounded, so that the order of floating-point sums can't change a result.
    return state.select("sid", F.when(~F.col("full"), F.round("tilt", 9)).alias("tilt"), "mean")


def _newton(state: DataFrame, h: DataFrame) -> DataFrame:
    """One step of every source that isn't solved, on the logarithm of its words; halves the bracket where a step leaves it."""
    keys = ["sid", "target", "mean", "full", "low", "high", "tilt"]
    rate, z = rate_of(F.col("tilt"), F.col("size"), F.col("mean")), F.col("size") / F.col("mean")
    words = F.col("n") * F.col("size") * rate
    s = h.join(state.select(*keys), "sid").groupBy(*keys).agg(F.sum(words).alias("words"), F.sum(F.when(rate < CAP, words * z).otherwise(0.0)).alias("slope"))
    s = s.withColumn("missed", F.abs(F.col("words") - F.col("target")) / F.col("target"))
    s = s.withColumn("low", F.when(F.col("words") <= F.col("target"), F.greatest("low", "tilt")).otherwise(F.col("low")))
    s = s.withColumn("high", F.when(F.col("words") >= F.col("target"), F.least("high", "tilt")).otherwise(F.col("high")))
    step = F.col("tilt") - F.try_divide(F.col("words") * F.log(F.col("words") / F.col("target")), F.col("slope"))
    halved = (F.col("low") + F.col("high")) / 2
    following = F.when(F.col("full") | (F.col("missed") <= TOLERANCE), F.col("tilt")).when((step > F.col("low")) & (step < F.col("high")), step).otherwise(halved)
    return s.select("sid", "target", "mean", "full", "low", "high", following.alias("tilt"), "missed")


def _kind(docs: DataFrame, *, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """id, raw and source: what tells one kind of document from another."""
    return [F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("raw"), F.col(source_col).alias("source")]


def _rounded_rows(docs: DataFrame, *, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, raw, source, size, source_size, target, rate and copies of every row."""
    d = docs.select(*_kind(docs, id_col=id_col, text_col=text_col, source_col=source_col), size_of(F.col(text_col)).alias("size"))
    d = materialize(d.groupBy("id", "raw", "source", "size").agg(F.count("*").alias("rows")), "sized")
    goals = materialize(targets(d), "targets")
    named = goals.withColumnRenamed("source", "s_source")
    d = d.join(named, d.source.eqNullSafe(F.col("s_source"))).drop("s_source")
    solved = tilts(d.select("sid", "size", "rows"), goals)
    d = d.join(solved, "sid", "left")
    d = d.withColumn("rate", F.when(F.col("size") > 0, rate_of(F.col("tilt"), F.col("size"), F.col("mean"))).otherwise(1.0))
    #: Equal rows become rows again in two steps, with a shuffle between them where there are many.
    runs = d.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(RUN))))
    if not d.where(F.col("rows") > RUN).isEmpty():
        runs = runs.repartition("id", "raw", "source", "run")
    d = runs.withColumn("row", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("rows")) - 1)))
    d = d.withColumn("key", F.xxhash64("id", "raw", "row")).withColumn("salt", F.pmod("key", F.ceil(F.col("docs") / GROUP)))
    small = d.select("id", "raw", "source", "size", "source_size", "target", "rate", "sid", "salt", "key")
    kind = ", ".join(f"{c} {small.schema[c].dataType.simpleString()}" for c in ("id", "raw", "source"))
    #: In Arrow: pandas would turn ids into floats beside a null.
    return small.groupBy("sid", "salt").applyInArrow(_rounded, f"{kind}, size long, source_size long, target double, rate double, copies int")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, rate, copies and taken of every row."""
    out = _rounded_rows(docs, id_col=id_col, text_col=text_col, source_col=source_col).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", "taken")


def _rounded(group):
    """Copies of one group's documents, from the largest to the smallest."""
    import numpy as np
    import pyarrow as pa

    size, rate, key = (group.column(c).to_numpy() for c in ("size", "rate", "key"))
    copies, owed = np.zeros(len(size), "int32"), 0.0
    for k in np.lexsort((key, -size)).tolist():
        n = size[k]
        if not n:
            copies[k] = 1
            continue
        owed += rate[k] * n
        copies[k] = c = min(CAP, max(0, round(owed / n)))
        owed -= c * n
    return group.select(["id", "raw", "source", "size", "source_size", "target", "rate"]).append_column("copies", pa.array(copies))


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it has copies."""
    names, key = docs.columns, ["id", "raw", "source"]
    mixed = _rounded_rows(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    counts = [F.count(F.when(F.col("copies") == n, 1)).alias(f"n{n}") for n in range(CAP)]
    totals = mixed.groupBy(*[F.col(c).alias(f"m_{c}") for c in key]).agg(F.count("*").alias("rows"), F.max("copies").alias("copies"), *counts)
    #: As a table it gives both readers below the same rounding.
    totals = materialize(totals, "mixed")
    d = docs.select(*_kind(docs, id_col=id_col, text_col=text_col, source_col=source_col), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    fits = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("raw") == F.col("m_raw")) & F.col("source").eqNullSafe(F.col("m_source"))
    once = d.join(totals.where("rows = 1 AND copies > 0"), fits)
    columns = [f"c{k}" for k in range(len(names))]
    both = once.select(*columns, "copies")
    if not totals.where("rows > 1 AND copies > 0").isEmpty():
        both = both.unionByName(_numbered(d.join(totals.where("rows > 1 AND copies > 0"), fits)).select(*columns, "copies"))
    out = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of documents that occur several times, each with copies of its own: the first n0 take none, the next n1 one.

    Equal rows are numbered within the partitions of a table, from where the partitions before it end.
    """
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "repeated")
    key = [F.col(c) for c in ("m_id", "m_raw", "m_source")]
    part = F.shiftright("row", 33)
    sizes = rows.groupBy(*key, part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.xxhash64(*key, "part").alias("h"), *[c.alias(f"s_{k}") for k, c in enumerate(key)], F.col("part").alias("s_part"), F.coalesce(before, F.lit(0)).alias("start"))
    #: Only narrow rows are sorted.
    within = rows.select("row", *key).withColumn("part", part)
    within = within.withColumn("place", F.row_number().over(Window.partitionBy(*key, "part").orderBy("row")) - 1).withColumn("h", F.xxhash64(*key, "part"))
    same = [within[c].eqNullSafe(starts[f"s_{k}"]) for k, c in enumerate(("m_id", "m_raw", "m_source"))]
    placed = within.join(starts, (within.h == starts.h) & (F.col("part") == F.col("s_part")) & same[0] & same[1] & same[2]).select("row", (F.col("start") + F.col("place")).alias("place"))
    copies, done = F.lit(CAP), sum((F.col(f"n{n}") for n in range(CAP)), F.lit(0))
    for n in reversed(range(CAP)):
        copies = F.when(F.col("place") < done, F.lit(n)).otherwise(copies)
        done = done - F.col(f"n{n}")
    return rows.join(placed, "row").withColumn("copies", copies).where("copies > 0")
