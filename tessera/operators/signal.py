"""Operators on sampled signals in long form: rec, ch, idx, value.

Statistics are aggregations, normalisations and references are windows, epochs are range joins on sample
numbers. Only recursive filters and the spectrum, which carry state along a channel, run in numpy, on blocks of
channels, many at once: no task holds more of a channel than BLOCK samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.sources import files

KEYS = ["rec", "ch"]
EPSILON = 2.220446049250313e-16


def channel_stats(s: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """mean, std (sample, 0 for one value), log_variance (population), power, rms and peak_to_peak of each channel."""
    v = F.col("value")
    var = F.var_pop(v)
    return s.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.when((F.count(v) >= 2) & (var > 0), F.log(var)).otherwise(F.lit(float("-inf"))).alias("log_variance"),
        F.avg(v * v).alias("power"), F.sqrt(F.avg(v * v)).alias("rms"), (F.max(v) - F.min(v)).alias("peak_to_peak"), F.count(v).alias("n"),
    )


def z_score(s: DataFrame, keys: list[str] = KEYS, *, population: bool = False) -> DataFrame:
    """value as deviations from the channel's mean in units of its deviation; one of 0 counts as 1."""
    w = Window.partitionBy(*keys)
    sd = (F.stddev_pop if population else F.stddev_samp)("value").over(w)
    scale = F.when(F.coalesce(sd, F.lit(0.0)) > EPSILON, sd).otherwise(1.0)
    return s.withColumn("value", (F.col("value") - F.avg("value").over(w)) / scale)


def min_max(s: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """value from 0 to 1 in each channel; a range of 0 counts as 1."""
    w = Window.partitionBy(*keys)
    low, high = F.min("value").over(w), F.max("value").over(w)
    return s.withColumn("value", (F.col("value") - low) / F.when(high - low > EPSILON, high - low).otherwise(1.0))


def time_window(s: DataFrame, start: float, end: float, rate: float) -> DataFrame:
    """Samples from round(start * rate) up to round(end * rate), numbered from 0."""
    a, b = round_half_up(start * rate), round_half_up(end * rate)
    return s.where((F.col("idx") >= a) & (F.col("idx") < b)).withColumn("idx", F.col("idx") - a)


def round_half_up(x: float) -> int:
    """The nearest whole number, halves away from zero."""
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def epochs(s: DataFrame, size: int, stride: int | None = None, keys: list[str] = KEYS) -> DataFrame:
    """epoch and idx (within it) of windows of size samples, stride apart; samples after the last whole window go."""
    stride = stride or size
    n = F.max("idx").over(Window.partitionBy(*keys)) + 1
    last = F.floor((n - size) / F.lit(stride))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / F.lit(stride)))
    through = F.least(F.floor(F.col("idx") / F.lit(stride)), last)
    e = s.withColumn("_first", first.cast("int")).withColumn("_through", through.cast("int")).where("_first <= _through")
    e = e.withColumn("epoch", F.explode(F.sequence("_first", "_through"))).drop("_first", "_through")
    return e.withColumn("idx", (F.col("idx") - F.col("epoch") * stride).cast("int"))


def average_reference(s: DataFrame, by: list[str]) -> DataFrame:
    """value less the mean of the channels at the same sample."""
    return s.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*by, "idx")))


def channel_reference(s: DataFrame, reference, by: list[str]) -> DataFrame:
    """value less the reference channel's, which stays; without that channel nothing changes."""
    at = F.max(F.when(F.col("ch") == reference, F.col("value"))).over(Window.partitionBy(*by, "idx"))
    return s.withColumn("value", F.when(F.col("ch") == reference, F.col("value")).otherwise(F.col("value") - F.coalesce(at, F.lit(0.0))))


def baseline(s: DataFrame, start: int, end: int, keys: list[str]) -> DataFrame:
    """value less the mean of samples [start, end) of the epoch; an empty range changes nothing."""
    mean = F.avg(F.when((F.col("idx") >= max(0, start)) & (F.col("idx") < max(0, end)), F.col("value"))).over(Window.partitionBy(*keys))
    return s.withColumn("value", F.col("value") - F.coalesce(mean, F.lit(0.0)))


def covariance(s: DataFrame, group: str, channel: str, sample: list[str]) -> DataFrame:
    """i, j, covariance (sample) of channels at equal samples, both orders. A row's channels are gathered once, then paired in it."""
    rows = s.groupBy(group, *sample).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), "value"))).alias("v"))
    pairs = rows.select(group, F.explode("v").alias("a"), "v").select(group, "a", F.explode("v").alias("b"))
    return pairs.groupBy(group, F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.covar_samp("a.value", "b.value").alias("covariance"))


def average_epochs(e: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over epochs of each sample."""
    return e.groupBy(*keys, "idx").agg(F.avg("value").alias("value"))


def event_epochs(s: DataFrame, events: DataFrame, start: int, end: int, by: list[str]) -> DataFrame:
    """epoch (the event's id), label and idx of samples [at + start, at + end) of events whose window lies in the recording.

    events: event_id, label, at (sample) and by. Events carry their samples' numbers, so the join is an equi-join.
    """
    length = s.groupBy(*by).agg((F.max("idx") + 1).alias("_n"))
    e = events.join(length, by).where((F.col("at") + start >= 0) & (F.col("at") + end <= F.col("_n"))).drop("_n")
    e = e.select(*by, "event_id", "label", F.posexplode(F.sequence(F.col("at") + start, F.col("at") + end - 1)).alias("_k", "_idx"))
    j = e.join(s.withColumnRenamed("idx", "_idx"), [*by, "_idx"])
    return j.withColumn("idx", F.col("_k")).drop("_idx", "_k")


def reject_annotated(s: DataFrame, annotations: DataFrame, pattern: str, by: list[str]) -> DataFrame:
    """value null at samples inside an annotation whose description has the pattern. annotations: by, start, end, description."""
    bad = annotations.where(F.contains(F.lower("description"), F.lit(pattern.lower()))).select(*by, F.explode(F.sequence("start", F.col("end") - 1)).alias("idx")).distinct()
    return s.join(bad.withColumn("_bad", F.lit(True)), [*by, "idx"], "left").withColumn("value", F.when(F.col("_bad").isNull(), F.col("value"))).drop("_bad")


def convert_units(s: DataFrame, factors: dict) -> DataFrame:
    """value times the factor of its channel, if it has one."""
    out = F
    for c, x in factors.items():
        out = out.when(F.col("ch") == c, F.col("value") * x)
    return s.withColumn("value", out.otherwise(F.col("value"))) if factors else s


def packed(s: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """values: each channel's samples as one array, in order."""
    return s.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x.value).alias("values"))


def linear_resample(values: Column, n: int) -> Column:
    """n values at equal distances from the first to the last of an array."""
    old = F.size(values)
    at = lambda i: i * (old - 1) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)

    def value(i: Column) -> Column:
        low = F.least(F.floor(at(i)).cast("int"), old - 1)
        high = F.least(low + 1, old - 1)
        part = at(i) - low
        return F.get(values, low) * (1 - part) + F.get(values, high) * part

    return F.when(old == 0, F.array().cast("array<double>")).when(old == 1, F.array_repeat(F.get(values, F.lit(0)), n)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))


def convolve(a: Column, b: Column) -> Column:
    """The causal convolution of two arrays, as long as the first."""

    def value(x: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.least(i, F.size(b) - 1)), F.lit(0.0), lambda acc, j: acc + F.get(a, i - j) * F.get(b, j))

    return F.transform(a, value)


#: Samples that a task holds of a channel.
BLOCK = 1 << 16


def _per_channel(s: DataFrame, f: Callable, keys: list[str], *, places: bool = False) -> DataFrame:
    """idx, value (and weight) that f makes of the samples of channels, a row of an array each.

    f gets channels that are equally long, and with places the idx that they all begin at; it returns their values (idx
    then follows from the lengths) or a dictionary of arrays. Rows of one key stand together in a task, in order.
    """
    names = ", ".join(f"{c} {s.schema[c].dataType.simpleString()}" for c in keys)
    whole = s.schema["idx"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pandas as pd

        def done(rows):
            if not len(rows):
                return
            new = np.ones(len(rows), bool)
            new[1:] = (rows[keys].iloc[1:].to_numpy() != rows[keys].iloc[:-1].to_numpy()).any(axis=1)
            starts = np.flatnonzero(new)
            sizes, value = np.diff(np.append(starts, len(rows))), rows["value"].to_numpy()
            firsts = rows["idx"].to_numpy()[starts] if places else np.zeros(len(starts), "i8")
            for first, n in np.unique(np.stack([firsts, sizes], axis=1), axis=0).tolist():
                at = starts[(sizes == n) & (firsts == first)]
                out = value[at[:, None] + np.arange(n)]
                out = f(out, first) if places else f(out)
                out = out if isinstance(out, dict) else {"value": out}
                width = out["value"].shape[1]
                if "idx" not in out:
                    out = {"idx": np.tile(np.arange(width), (len(at), 1)), **out}
                named = {k: np.repeat(rows[k].to_numpy()[at], width) for k in keys}
                yield pd.DataFrame({**named, **{k: out[k].ravel() for k in ("idx", "value", "weight") if k in out}})

        held: list = []
        for batch in batches:
            if not len(batch):
                continue
            same = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut or (held and not (batch[keys].iloc[0] == held[-1][keys].iloc[-1]).all()):
                yield from done(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held = []
            held.append(batch.iloc[cut:])
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    dealt = s.select(*keys, "idx", "value").repartition(*keys).sortWithinPartitions(*keys, "idx")
    weight = ", weight double" if getattr(f, "weighs", False) else ""
    return dealt.mapInPandas(run, f"{names}, idx {whole}, value double{weight}")


def _is_long(s: DataFrame, block: int | None = None) -> bool:
    """Whether a channel may have more samples than a block: one aggregate of the samples' numbers."""
    low, high = s.agg(F.min("idx"), F.max("idx")).first()
    return low is not None and high - low >= (block or BLOCK)


def _kept(s: DataFrame) -> DataFrame:
    """s as a table in the shared folder, where several passes read it."""
    path = files.scratch(s.sparkSession, "signal")
    schema = s.schema
    s.write.parquet(path)
    return s.sparkSession.read.schema(schema).parquet(path)


def _filtered(s: DataFrame, stages: list, keys: list[str], zero_phase: bool = True, block: int | None = None) -> DataFrame:
    """value after filters b, a in turn. Channels longer than a block are filtered block by block, with the same result."""

    def whole(x):
        for b, a in stages:
            x = (filters.filtfilt if zero_phase else filters.lfilter)(b, a, x)
        return x

    if not _is_long(s, block):
        return _per_channel(s, whole, keys)
    for k, (b, a) in enumerate(stages):
        s = _by_blocks(_kept(s) if k else s, b, a, keys, zero_phase, block or BLOCK)
    return s


def _by_blocks(s: DataFrame, b, a, keys: list[str], zero_phase: bool, block: int) -> DataFrame:
    """One filter, forward or forward and backward, with blocks as groups of their own.

    As the filter is linear, a block from rest tells how it changes any state: two small states a block, forward and
    backward, are carried through the channel, from its ends' reflections on; a second pass filters each block from its
    true states.
    """
    import numpy as np

    b, a = filters._even(b, a)
    order, edge = len(a) - 1, 3 * len(a) + 1
    width, prefix = 2 + 2 * order + 2 * edge, 1 + 2 * order
    cut = s.select(*keys, F.floor(F.col("idx") / block).alias("_block"), F.col("idx").cast("long").alias("idx"), "value")

    def states(x):
        """n, both states after it from rest, and the samples at both ends (those at the right from the last on)."""
        rest = np.zeros((len(x), order))
        y, forward = filters.lfilter_from(b, a, x, rest)
        backward = filters.lfilter_from(b, a, y[:, ::-1], rest)[1]
        n = min(edge, x.shape[1])
        ends = np.full((len(x), 2 * edge), np.nan)
        ends[:, :n], ends[:, edge : edge + n] = x[:, :n], x[:, ::-1][:, :n]
        return np.concatenate([np.full((len(x), 1), x.shape[1]), np.zeros((len(x), 1)), forward, backward, ends], axis=1)

    def carried(rows):
        """The samples before each block and its states at both ends, for channels of equally many blocks."""
        blocks = rows.reshape(len(rows), -1, width)
        out, at = np.empty((len(rows), blocks.shape[1], prefix)), np.empty((len(rows), blocks.shape[1]), "i8")
        for c, channel in enumerate(blocks):
            at[c] = channel[:, 1]
            sizes = channel[:, 0].astype(int)
            forward, backward = channel[:, 2 : 2 + order], channel[:, 2 + order : 2 + 2 * order]
            left, right = channel[:, -2 * edge : -edge], channel[::-1, -edge:]
            head, tail = (np.append(v[~np.isnan(v)], np.nan)[:edge] if np.isnan(v).all() else v[~np.isnan(v)][:edge] for v in (left, right))
            pad = min(edge - 1, int(sizes.sum()) - 1) if zero_phase else 0
            state = filters.lfilter_from(b, a, (2 * head[0] - head[1 : pad + 1][::-1])[None], np.zeros((1, order)))[1][0]
            out[c, :, 0] = np.cumsum(sizes) - sizes
            moved = {n: filters.transfer(b, a, n) for n in set(sizes.tolist())}
            for k, n in enumerate(sizes.tolist()):
                out[c, k, 1 : 1 + order] = state
                state = moved[n][0] @ state + forward[k]
            beyond = filters.lfilter_from(b, a, (2 * tail[0] - tail[1 : pad + 1])[None], state[None])[0]
            state = filters.lfilter_from(b, a, beyond[:, ::-1], np.zeros((1, order)))[1][0]
            for k in range(len(sizes) - 1, -1, -1):
                out[c, k, 1 + order :] = state
                power, back = moved[int(sizes[k])]
                state = power @ state + backward[k] + back @ out[c, k, 1 : 1 + order]
        return {"idx": (at[:, :, None] * prefix + np.arange(prefix)).reshape(len(rows), -1), "value": out.reshape(len(rows), -1)}

    def final(x):
        start, forward, backward, x = x[:, 0], x[:, 1 : 1 + order], x[:, 1 + order : prefix], x[:, prefix:]
        y = filters.lfilter_from(b, a, x, forward)[0]
        if zero_phase:
            y = filters.lfilter_from(b, a, y[:, ::-1], backward)[0][:, ::-1]
        return {"idx": start.astype("i8")[:, None] + np.arange(x.shape[1]), "value": y}

    found = _per_channel(cut, states, [*keys, "_block"])
    found = found.select(*keys, (F.col("_block") * width + F.col("idx")).alias("idx"), F.when(F.col("idx") == 1, F.col("_block").cast("double")).otherwise(F.col("value")).alias("value"))
    begun = _per_channel(found, carried, keys)
    begun = begun.select(*keys, F.floor(F.col("idx") / prefix).alias("_block"), (F.pmod("idx", F.lit(prefix)) + (F.floor(F.col("idx") / prefix) * block - prefix)).alias("idx"), "value")
    out = _per_channel(cut.unionByName(begun), final, [*keys, "_block"])
    return out.select(*keys, F.col("idx").cast(s.schema["idx"].dataType).alias("idx"), "value")


def iir(s: DataFrame, b: list[float], a: list[float], keys: list[str] = KEYS, *, zero_phase: bool = True, block: int | None = None) -> DataFrame:
    """value filtered forward, or forward and backward; block: the samples of a channel that a task holds (BLOCK)."""
    return _filtered(s, [(b, a)], keys, zero_phase, block)


def notch(s: DataFrame, hertz: float, rate: float, quality: float = 30.0, keys: list[str] = KEYS) -> DataFrame:
    """value without a frequency and its harmonics below half the rate."""
    harmonics = [hertz * k for k in range(1, int(rate / 2 / hertz) + 2) if hertz * k < rate / 2]
    return _filtered(s, [filters.notch(h, rate, quality) for h in harmonics], keys) if harmonics else s.select(*keys, "idx", "value")


def resample(s: DataFrame, old_rate: float, new_rate: float, keys: list[str] = KEYS, *, block: int | None = None) -> DataFrame:
    """The signal at another rate: low-passed if that is lower, interpolated linearly. Samples are numbered from 0 on."""
    held = block or BLOCK
    if not _is_long(s, held) or old_rate <= 0 or new_rate <= 0 or abs(old_rate - new_rate) < 1e-10:
        return _per_channel(s, lambda x: filters.resample(x, old_rate, new_rate), keys)
    ratio, kind = new_rate / old_rate, s.schema["idx"].dataType
    if ratio < 1:
        s = _kept(_by_blocks(s, *filters.butter_lowpass(8, min(0.99, ratio)), keys, True, held))

    def between(x, first):
        """The new samples from the first sample of a block to the one before the next block's first."""
        import numpy as np

        n = min(x.shape[1], held)
        i = np.arange(max(0, int(first * ratio) - 1), int((first + n) * ratio) + 2)
        at = i / ratio
        own = (at.astype("i8") >= first) & (at.astype("i8") < first + n)
        i, at = i[own], at[own] - first
        low = at.astype("i8")
        high, part = np.minimum(low + 1, x.shape[1] - 1), at - low
        return {"idx": np.tile(i, (len(x), 1)), "value": x[:, low] * (1 - part) + x[:, high] * part}

    own = F.floor(F.col("idx") / held)
    #: A block's first sample is the end of the one before, too.
    shared = F.when((F.col("idx") % held == 0) & (F.col("idx") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    out = _per_channel(s.select(*keys, F.col("idx").cast("long").alias("idx"), "value", F.explode(shared).alias("_block")), between, [*keys, "_block"], places=True).drop("_block")
    n = s.groupBy(*keys).agg(F.floor((F.max("idx") + 1) * ratio + 0.5).alias("_n"))
    return out.join(n, keys).where(F.col("idx") < F.col("_n")).select(*keys, F.col("idx").cast(kind).alias("idx"), "value")


def resample_each(s: DataFrame, new_rate: float, keys: list[str] = KEYS) -> DataFrame:
    """resample() of channels that have rates of their own (column rate), each held whole; those within 0.01 of the new rate stay."""
    kind = s.schema["idx"].dataType
    long = s.select(*keys, F.col("idx").cast("long").alias("idx"), "value", "rate")
    #: A channel's rate stands before its samples, at a number that tells rates apart, so that channels of one rate go together.
    heads = long.groupBy(*keys).agg(F.max("rate").alias("value")).withColumn("idx", -1 - F.pmod(F.xxhash64("value"), F.lit(1 << 62)))

    def one(x, first):
        rate, x = float(x[0, 0]), x[:, 1:]
        return x if abs(rate - new_rate) <= 0.01 else filters.resample(x, rate, new_rate)

    out = _per_channel(long.drop("rate").unionByName(heads.select(*keys, "idx", "value")), one, keys, places=True)
    return out.withColumn("idx", F.col("idx").cast(kind))


def welch(s: DataFrame, n_fft: int, keys: list[str] = KEYS, *, block: int | None = None) -> DataFrame:
    """bin and psd: the mean power of half-overlapping windows of n_fft samples under a symmetric Hann window.

    Blocks hold the windows that begin in them; samples are numbered from 0 on. A channel shorter than a window is one.
    """
    step = max(1, n_fft // 2)
    block = max(3, (block or BLOCK) // step) * step

    def power(x, first):
        import numpy as np

        n = x.shape[1]
        size = min(n_fft, n)
        bins = size // 2 + 1
        if first and n < n_fft:
            return {"value": np.zeros((len(x), 0)), "weight": np.zeros((len(x), 0))}
        win = np.hanning(size) if size > 1 else np.ones(size)
        total, starts = np.zeros((len(x), bins)), range(0, min(n - size + 1, block), max(1, size // 2))
        for k in starts:
            total = total + np.abs(np.fft.rfft(x[:, k : k + size] * win, axis=1)) ** 2
        return {"value": total / (win**2).sum(), "weight": np.full((len(x), bins), float(len(starts)))}

    power.weighs = True
    own = F.floor(F.col("idx") / block)
    held = F.when((F.col("idx") % block < n_fft) & (F.col("idx") >= block), F.array(own, own - 1)).otherwise(F.array(own))
    cut = s.select(*keys, "idx", "value", F.explode(held).alias("_block"))
    sums = _per_channel(cut, power, [*keys, "_block"], places=True)
    return sums.groupBy(*keys, F.col("idx").alias("bin")).agg((F.sum("value") / F.sum("weight")).alias("psd"))


def harmonised_channels(channels: DataFrame, *, union: bool = False, ignore: list[str] = ()) -> DataFrame:
    """channel: those that every input has, or any. channels: input, channel."""
    c = channels.where(~F.col("channel").isin(*ignore)) if ignore else channels
    if union:
        return c.select("channel").distinct()
    n = channels.select(F.countDistinct("input").alias("n"))
    return c.groupBy("channel").agg(F.countDistinct("input").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("channel")


def harmonise(s: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """by, channel, idx, value for every channel of the plan (a few names); missing ones are 0."""
    grid = s.select(*by, "idx").distinct().crossJoin(plan)
    return grid.join(s, [*by, "idx", "channel"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def csp_filters(cov_a, cov_b, n: int):
    """The n first and n last common spatial patterns of two mean covariance matrices: a matrix of the channels' size."""
    import numpy as np

    values, vectors = np.linalg.eigh(cov_a + cov_b)
    keep = values > 1e-10
    white = vectors[:, keep] / np.sqrt(values[keep])
    own, rotation = np.linalg.eigh(white.T @ cov_a @ white)
    w = (white @ rotation[:, np.argsort(-own)]).T
    return np.concatenate([w[:n], w[-n:]])


def csp_fit(s: DataFrame, n: int, *, group: str = "grp", epoch: str = "rec", channel: str = "ch"):
    """Filters from the trace-normalised covariances of two classes' epochs, averaged in Spark (channels squared numbers)."""
    import numpy as np

    cov = covariance(s.withColumn("_e", F.struct(group, epoch)), "_e", channel, ["idx"])
    trace = Window.partitionBy("_e")
    cov = cov.withColumn("c", F.col("covariance") / F.sum(F.when(F.col("i") == F.col("j"), F.col("covariance"))).over(trace))
    rows = cov.groupBy(F.col(f"_e.{group}").alias("g"), "i", "j").agg(F.avg("c").alias("c")).collect()
    names, classes = sorted({r.i for r in rows}), sorted({r.g for r in rows})
    mats = {g: np.zeros((len(names), len(names))) for g in classes}
    for r in rows:
        mats[r.g][names.index(r.i), names.index(r.j)] = r.c
    return names, csp_filters(mats[classes[0]], mats[classes[1]], n)


def csp_transform(s: DataFrame, names: list, weights, *, epoch: str = "rec", channel: str = "ch") -> DataFrame:
    """component and feature: the log sample variance of each projection of an epoch."""
    out = []
    for k, w in enumerate(weights.tolist()):
        table = F.create_map(*[F.lit(x) for c, v in zip(names, w, strict=True) for x in (c, v)])
        out.append(F.sum(F.col("value") * F.coalesce(F.try_element_at(table, F.col(channel)), F.lit(0.0))).alias(f"p{k}"))
    p = s.groupBy(epoch, "idx").agg(*out)
    long = p.select(epoch, F.posexplode(F.array(*[f"p{k}" for k in range(len(out))])).alias("component", "x"))
    return long.groupBy(epoch, "component").agg(F.log(F.var_samp("x")).alias("feature"))
