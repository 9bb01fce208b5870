"""Operators on variables: long rows (name, row, value), event rows and their transformations.

A transformation takes a wide frame of variables and gives one back; the dispatcher applies a list of
instructions in order, with keys in either case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, name, value (text) of every cell that isn't empty."""
    cast = df.select(*keys, *[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")).alias(n) for n in names])
    return cast.unpivot(keys, names, "name", "value").where("value IS NOT NULL AND value != 'n/a'")


def pivot(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A column for each of the names, with the largest value of each key."""
    return df.groupBy(*keys).pivot("name", names).agg(F.max("value"))


def numeric(value: Column) -> Column:
    """A text as a number; null where it isn't one."""
    return F.expr("1") * value.try_cast("double")


def is_numeric(df: DataFrame) -> DataFrame:
    """name, numeric: whether all values of a variable are numbers or empty."""
    return df.groupBy("name").agg(F.bool_and(F.col("value").isNull() | (F.col("value") == "") | F.col("value").try_cast("double").isNotNull()).alias("numeric"))


def _bins(rate: int) -> Column:
    """The bins that an event covers, one at least."""
    first = F.floor(F.round(F.col("onset") * rate, 6)).cast("long")
    last = F.greatest(first, F.ceil(F.round((F.col("onset") + F.col("duration")) * rate, 6)).cast("long") - 1)
    return F.sequence(first, last)


def sparse_to_dense(events: DataFrame, rate: int, keys: list[str]) -> DataFrame:
    """keys, bin, value: each event paints its amplitude on its bins; the later event wins. rate in bins a second."""
    e = events.select(*keys, F.explode(_bins(rate)).alias("bin"), "onset", "event_id", "amplitude")
    return e.groupBy(*keys, "bin").agg(F.max_by("amplitude", F.struct("onset", "event_id")).alias("value"))


#: Milliseconds whose distinct values are put into one array.
RANGE = 65_536


def bin_rate(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin_ms: the greatest common divisor of positive onsets and durations in milliseconds."""
    ms = events.select(*keys, F.explode(F.array(F.round(F.col("onset") * 1000).cast("long"), F.round(F.col("duration") * 1000).cast("long"))).alias("ms")).where("ms > 0").distinct()

    def gcd(a: Column, b: Column) -> Column:
        step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.greatest(s.b, F.lit(1).cast("long"))).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s.a)

    def divisor(d: DataFrame, by: list[str]) -> DataFrame:
        per = d.groupBy(*by).agg(F.array_sort(F.collect_set("ms")).alias("all"))
        return per.select(*by, F.aggregate("all", F.lit(0).cast("long"), lambda a, b: gcd(b, a)).alias("ms"))

    #: No array holds more than RANGE distinct values of a key: the divisor of each range, of salted groups of these, then of those.
    d = ms
    for part in (F.floor(F.col("ms") / RANGE), F.pmod(F.xxhash64("ms"), F.lit(4096))):
        d = divisor(d.withColumn("_part", part), [*keys, "_part"]).drop("_part")
    return divisor(d, keys).withColumnRenamed("ms", "bin_ms")


def lag_zero(df: DataFrame, n: int, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """value of n rows before, 0 where there is none."""
    return df.withColumn(value, F.coalesce(F.lag(value, n).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0)))


def run_offsets(df: DataFrame, keys: list[str], order: list[str], onset: str = "onset") -> DataFrame:
    """run_index: rises where an onset is smaller than the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.coalesce((F.col(onset) < F.lag(onset).over(w)).cast("int"), F.lit(0))
    return df.withColumn("_s", step).withColumn("run_index", F.sum("_s").over(w).cast("int")).drop("_s")


def run_bounds(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """start and end of each run on a common time axis, from the durations before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum("duration").over(w)
    return runs.withColumn("start", F.round(total - F.col("duration"), 6)).withColumn("end", F.round(total, 6))


def boxcar(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, level: the running sum of amplitudes added at onsets and taken off at ends."""
    e = events.select(*keys, F.explode(F.array(F.struct(F.col("onset").alias("t"), F.col("amplitude").alias("d")), F.struct((F.col("onset") + F.col("duration")).alias("t"), (-F.col("amplitude")).alias("d")))).alias("x"))
    steps = e.groupBy(*keys, "x.t").agg(F.sum("x.d").alias("d"))
    return steps.select(*keys, "t", F.sum("d").over(Window.partitionBy(*keys).orderBy("t")).alias("level"))


def lenient_filter(df: DataFrame, conditions: dict[str, str], entities: str = "entities") -> DataFrame:
    """Rows whose map of entities lacks a key, or has it equal."""
    for k, v in conditions.items():
        df = df.where(F.coalesce(F.try_element_at(entities, F.lit(k)) == v, F.lit(True)))
    return df


def common_entities(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entity, value that all rows of a group share. df: keys, row, entity, value."""
    n = df.groupBy(*keys).agg(F.countDistinct("row").alias("_n"))
    c = df.groupBy(*keys, "entity", "value").agg(F.countDistinct("row").alias("_k"))
    return c.join(n, keys).where("_k = _n").drop("_k", "_n")


def group_key(*columns: str) -> Column:
    """The columns joined into one key."""
    return F.concat_ws("@@@", *columns)


# --- transformations of wide frames -------------------------------------------------------------------------------------


def scale(df: DataFrame, names: list[str], *, demean: bool = True, rescale: bool = True, by: list[str] = ()) -> DataFrame:
    """Columns less their mean, in units of their population deviation; a deviation of 0 doesn't divide."""
    w = Window.partitionBy(*by) if by else None
    if w is None:
        stats = df.agg(*[f(F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n))).alias(f"_{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
        df = df.crossJoin(F.broadcast(stats))
        mean, dev = lambda i, n: F.col(f"_m{i}"), lambda i, n: F.col(f"_s{i}")
    else:
        mean, dev = lambda i, n: F.avg(n).over(w), lambda i, n: F.stddev_pop(n).over(w)
    out = {}
    for i, n in enumerate(names):
        x = F.col(n) - mean(i, n) if demean else F.col(n)
        out[n] = F.when(dev(i, n) > 1e-15, x / dev(i, n)).otherwise(x) if rescale else x
    return df.withColumns(out).select(*[c for c in df.columns if not c.startswith(("_m", "_s"))])


def threshold(value: Column, at: float = 0.0, *, above: bool = True, binarize: bool = False) -> Column:
    """Values that pass, or 1; else, and for what isn't a number, 0."""
    passes = (value >= at) if above else (value <= at)
    return F.when(passes & ~F.isnan(value), F.lit(1.0) if binarize else value).otherwise(0.0)


def factor(df: DataFrame, name: str, levels: list[str]) -> DataFrame:
    """A column name.level of 1 or 0 for each level."""
    return df.withColumns({f"{name}.{v}": F.when(F.col(name) == v, 1).otherwise(0) for v in levels})


def levels_of(df: DataFrame, name: str, order: str) -> list[str]:
    """The levels of a factor in the order they first occur; a design has few."""
    return [r[0] for r in df.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.min(order).alias("o")).orderBy("o").collect()]


def orthogonalize(df: DataFrame, name: str, others: list[str]) -> DataFrame:
    """name less its projections on the others, one after the other; each takes one aggregation to a row."""
    for o in others:
        s = df.agg(F.sum(F.col(name) * F.col(o)).alias("_xo"), F.sum(F.col(o) * F.col(o)).alias("_oo"))
        df = df.crossJoin(F.broadcast(s)).withColumn(name, F.when(F.col("_oo") > 1e-15, F.col(name) - F.col(o) * F.col("_xo") / F.col("_oo")).otherwise(F.col(name))).drop("_xo", "_oo")
    return df


def split_by(df: DataFrame, name: str, by: str, keys: list[str]) -> DataFrame:
    """A column name.key for each of the keys, with the values of its rows."""
    return df.withColumns({f"{name}.{k}": F.when(F.col(by) == k, F.col(name)) for k in keys})


def _keyed(instruction: dict, by: list[str]) -> list[str]:
    """The keys within which an instruction looks at other rows; without any all rows would meet in one task."""
    keys = _names(instruction.get("by", list(by)))
    if not keys:
        raise ValueError(f"{instruction['name']} looks at other rows: name the keys of a series in by")
    return keys


def _names(x) -> list[str]:
    return x if isinstance(x, list) else [x]


def densify(events: DataFrame, rate: int, keys: list[str]) -> DataFrame:
    """sparse_to_dense() of the events whose onset, duration and amplitude are finite numbers."""
    finite = F.lit(True)
    for c in ("onset", "duration", "amplitude"):
        finite = finite & (F.abs(F.col(c)) < float("inf"))
    return sparse_to_dense(events.where(finite), rate, keys)


def painted(events: DataFrame, names: list[str], rate: int, keys: list[str]) -> DataFrame:
    """keys, bin and a column for each of the names: densify() of several columns at once, null where a bin has no value."""
    finite = lambda n: F.coalesce(F.abs(F.col(f"`{n}`")) < float("inf"), F.lit(False))
    some = F.lit(False)
    for n in names:
        some = some | finite(n)
    e = events.select(*keys, "onset", "duration", "event_id", *[F.col(f"`{n}`").cast("double").alias(n) for n in names]).where(finite("onset") & finite("duration") & some)
    e = e.select(*keys, F.explode(_bins(rate)).alias("bin"), "onset", "event_id", *[f"`{n}`" for n in names])
    return e.groupBy(*keys, "bin").agg(*[F.max_by(f"`{n}`", F.when(finite(n), F.struct("onset", "event_id"))).alias(n) for n in names])


def sampling_rate(rates: DataFrame, requested: str | float | None) -> float:
    """The rate of a collection: a number as it is, `highest`, or `TR` (one over the only repetition time). rates: rate, tr."""
    if isinstance(requested, (int, float)):
        return float(requested)
    row = rates.agg(F.max("rate").alias("highest"), F.min("tr").alias("low"), F.max("tr").alias("high")).first()
    if requested == "highest":
        return float(row.highest)
    if requested not in (None, "TR") or row.low is None or row.low != row.high:
        raise ValueError(f"no single rate for {requested}: repetition times from {row.low} to {row.high}")
    return 1.0 / row.low


def event_rows(cells: DataFrame) -> DataFrame:
    """path, row, onset, duration, name, value of the columns of event tables; no duration is 0, rows without an onset go.

    cells: path, row, name, value, as text.read_long() gives them.
    """
    when = cells.groupBy("path", "row").agg(*[F.max(F.when(F.col("name") == n, F.col("value").try_cast("double"))).alias(n) for n in ("onset", "duration")])
    when = when.where("onset IS NOT NULL").withColumn("duration", F.coalesce("duration", F.lit(0.0)))
    return when.join(cells.where("name NOT IN ('onset', 'duration')"), ["path", "row"]).select("path", "row", "onset", "duration", "name", "value")


def apply_groups(df: DataFrame, keys: list[str], column: str, f: Callable) -> DataFrame:
    """column with f, a function of a group's values (numpy) as long as they are, put back in the rows; a group is in memory."""

    def run(group):
        return group.assign(**{column: f(group[column].to_numpy())})

    schema = ", ".join(f"`{c}` {'double' if c == column else t}" for c, t in df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, schema)


def merged(frames: list[DataFrame]) -> DataFrame:
    """Variables of the same names from several sources, one below the other."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def transform(df: DataFrame, instructions: list[dict], order: list[str], by: list[str] = ()) -> DataFrame:
    """The instructions in order, within by where they look at other rows; order gives rows their order. Unknown ones raise."""
    quoted = lambda c: F.col(f"`{c}`")
    for raw in instructions:
        i = {k.lower(): v for k, v in raw.items()}
        name, inputs = i["name"].lower(), _names(i.get("input", []))
        outputs = _names(i.get("output", inputs))
        each: Callable | None = None
        if name == "rename":
            df = df.withColumnsRenamed(dict(zip(inputs, outputs, strict=True)))
        elif name in ("copy", "assign"):
            df = df.withColumns({o: quoted(c) for c, o in zip(inputs, outputs, strict=True)})
        elif name == "select":
            df = df.select(*dict.fromkeys([*order, *inputs]))
        elif name == "delete":
            df = df.drop(*inputs)
        elif name == "factor":
            for c in inputs:
                df = factor(df, c, i.get("levels") or levels_of(df, c, order[0]))
        elif name == "replace":
            each = lambda c: F.coalesce(*[F.when(c.cast("string") == k, F.lit(v)) for k, v in i["replace"].items()], c.cast("string"))
        elif name == "scale":
            df = scale(df, inputs, demean=i.get("demean", True), rescale=i.get("rescale", True), by=list(by))
        elif name == "threshold":
            each = lambda c: threshold(c, i.get("threshold", 0.0), above=i.get("above", True), binarize=i.get("binarize", False))
        elif name == "dropna":
            df = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in inputs))
        elif name == "filter":
            df = df.where(i["query"])
        elif name == "split":
            for c in inputs:
                df = split_by(df, c, i["by"], i.get("levels") or levels_of(df, i["by"], order[0]))
        elif name == "concatenate":
            df = df.withColumn(outputs[0], F.explode(F.array(*[quoted(c) for c in inputs])))
        elif name == "orthogonalize":
            for c in inputs:
                df = orthogonalize(df, c, _names(i["other"]))
        elif name == "lag":
            for c in inputs:
                df = lag_zero(df, i.get("n", 1), _keyed(i, by), order, c)
        elif name in ("and", "or"):
            test = [F.coalesce(quoted(c) != 0, F.lit(False)) for c in inputs]
            df = df.withColumn(outputs[0], (F.forall if name == "and" else F.exists)(F.array(*test), lambda x: x).cast("int"))
        elif name == "not":
            each = lambda c: (F.coalesce(c, F.lit(0)) == 0).cast("int")
        elif name in ("sum", "product"):
            weights = i.get("weights", [1.0] * len(inputs))
            terms = [quoted(c) * w for c, w in zip(inputs, weights, strict=True)]
            total = terms[0]
            for t in terms[1:]:
                total = total + t if name == "sum" else total * t
            df = df.withColumn(outputs[0], total)
        elif name == "power":
            each = lambda c: F.pow(c, F.lit(float(i["value"])))
        elif name == "convolve":
            kernel, place = [float(x) for x in i["kernel"]], Window.partitionBy(*_keyed(i, by)).orderBy(*order)
            df = df.withColumns({o: sum((F.coalesce(F.lag(quoted(c), k).over(place), F.lit(0.0)) * x for k, x in enumerate(kernel)), F.lit(0.0)) for c, o in zip(inputs, outputs, strict=True)})
        elif name == "group":
            df = df.withColumn(outputs[0], group_key(*inputs))
        else:
            raise ValueError(f"unknown transformation {raw['name'] if 'name' in raw else raw}")
        if each is not None:
            df = df.withColumns({o: each(quoted(c)) for c, o in zip(inputs, outputs, strict=True)})
    return df
