"""Queries of the signal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.operators import signal
from tessera.plans import views
from tessera.plans.views import EVENTS_SQL, SIGNAL_SQL

_S = f"WITH {SIGNAL_SQL}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Columns to 6 digits, without negative zero."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.channel_stats(views.signal(spark, d)), "mean", "std", "log_variance", "power", "rms", "peak_to_peak")


def zscore(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.z_score(views.signal(spark, d)), "value")


def zscore_pop(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.z_score(views.signal(spark, d), population=True), "value")


def minmax(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.min_max(views.signal(spark, d)), "value")


def time_window(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.time_window(views.signal(spark, d), 0.1, 0.45, 64.0), "value")


def tumbling_epochs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.epochs(views.signal(spark, d), 15).groupBy("rec", "epoch").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


def sliding_epochs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.epochs(views.signal(spark, d), 20, 8).groupBy("rec", "epoch").agg(F.count("*").alias("n"), F.sum(F.col("idx") * F.col("value")).alias("moment")), "moment")


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """Eight consecutive recordings as the channels of one."""
    return views.signal(spark, d).withColumn("set", F.floor(F.col("rec") / 8).cast("long"))


def avg_ref(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.average_reference(_recordings(spark, d), ["set"]), "value")


def chan_ref(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.channel_reference(_recordings(spark, d), 3, ["set"]), "value")


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.baseline(signal.epochs(views.signal(spark, d), 32), 0, 8, ["rec", "epoch"]), "value")


def covariance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.covariance(_recordings(spark, d), "set", "ch", ["idx"]), "covariance")


def evoked(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.average_epochs(views.signal(spark, d), ["grp"]), "value")


def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.convert_units(views.signal(spark, d), {0: 1e3, 5: 0.5}).groupBy("ch").agg(F.sum("value").alias("total")), "total")


def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    p = signal.packed(views.signal(spark, d), ["rec"])
    return _rounded(p.select("rec", F.posexplode(signal.linear_resample(F.col("values"), 25)).alias("idx", "value")), "value")


def convolution(spark: SparkSession, d: str) -> DataFrame:
    p = signal.packed(views.signal(spark, d), ["rec"])
    kernel = F.array(*[F.lit(x) for x in (0.5, 0.25, 0.125)])
    return _rounded(p.select("rec", F.posexplode(signal.convolve(F.col("values"), kernel)).alias("idx", "value")), "value")


def welch_psd(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.welch(views.signal(spark, d), 16, ["rec"]), "psd")


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """Events placed on the samples of the recordings, which are numbered from 0, in turn."""
    n = views.read(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    e = views.events(spark, d).crossJoin(F.broadcast(n))
    return e.select("event_id", (F.col("event_id") % F.col("n")).alias("rec"), F.col("trial_type").alias("label"), F.floor(F.col("onset") % 64).cast("int").alias("at"))


def epoch_extract(spark: SparkSession, d: str) -> DataFrame:
    e = signal.event_epochs(views.signal(spark, d).select("rec", "idx", "value"), _marks(spark, d), -4, 10, ["rec"])
    return _rounded(e.groupBy("event_id", "label").agg(F.count("*").alias("n"), F.sum(F.col("value") * (F.col("idx") + 1)).alias("moment")), "moment")


def annotation_reject(spark: SparkSession, d: str) -> DataFrame:
    a = _marks(spark, d).select("rec", F.col("at").alias("start"), (F.col("at") + 6).alias("end"), F.col("label").alias("description"))
    s = signal.reject_annotated(views.signal(spark, d), a, "ERR", ["rec"])
    return _rounded(s.groupBy("rec").agg(F.count("value").alias("kept"), F.avg("value").alias("mean")), "mean")


def harmonize_intersect(spark: SparkSession, d: str) -> DataFrame:
    return signal.harmonised_channels(views.events(spark, d).select((F.col("subject") % 5).alias("input"), F.col("trial_type").alias("channel")), ignore=["view"])


def harmonize_union(spark: SparkSession, d: str) -> DataFrame:
    s = views.events(spark, d).groupBy("subject", "run", F.col("trial_type").alias("channel"), F.lit(0).alias("idx")).agg(F.sum("amplitude").alias("value"))
    plan = signal.harmonised_channels(s.select(F.col("subject").alias("input"), "channel"), union=True)
    return _rounded(signal.harmonise(s, plan, ["subject", "run"]), "value")


def _long(spark: SparkSession, d: str) -> DataFrame:
    """ch, idx, value: channels of all vectors with the same remainder by 16, one after the other."""
    e = views.read(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 16).alias("ch"), F.expr("vec_id div 16").alias("k"), F.posexplode("embedding").alias("i", "value")).select("ch", (F.col("k") * 64 + F.col("i")).alias("idx"), F.col("value").cast("double").alias("value"))


def long_filter(spark: SparkSession, d: str) -> DataFrame:
    b, a = filters.butter_lowpass(2, 0.2)
    return _rounded(signal.iir(_long(spark, d), b.tolist(), a.tolist(), ["ch"], block=256), "value")


def long_spectra(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.welch(_long(spark, d), 48, ["ch"], block=256), "psd")


def long_resample(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.resample(_long(spark, d), 64.0, 100.0, ["ch"], block=256), "value")


def iir_filter(spark: SparkSession, d: str) -> DataFrame:
    b, a = filters.butter_bandpass(2, 0.1, 0.6)
    return _rounded(signal.iir(views.signal(spark, d), b.tolist(), a.tolist(), ["rec"]), "value")


def notch_filter(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.notch(views.signal(spark, d), 10.0, 64.0, keys=["rec"]), "value")


def resample_signal(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(signal.resample(views.signal(spark, d), 64.0, 24.0, ["rec"]), "value")


def csp_features(spark: SparkSession, d: str) -> DataFrame:
    s = _recordings(spark, d).withColumn("rec", F.col("set")).withColumn("grp", (F.col("set") % 2).cast("int"))
    names, weights = signal.csp_fit(s, 2)
    return _rounded(signal.csp_transform(s, names, weights), "feature")


QUERIES = {f.__name__: f for f in (
    channel_stats, zscore, zscore_pop, minmax, time_window, tumbling_epochs, sliding_epochs, avg_ref, chan_ref, baseline, covariance, evoked, unit_conversion,
    resample_linear, convolution, welch_psd, epoch_extract, annotation_reject, harmonize_intersect, harmonize_union, iir_filter, notch_filter, resample_signal,
    csp_features, long_filter, long_spectra, long_resample,
)}

_SETS = f"{_S}, r AS (SELECT *, rec // 8 AS set FROM s)"
_MARKS = f"""{SIGNAL_SQL}, {EVENTS_SQL.lstrip()},
m AS (SELECT event_id, event_id % (SELECT max(vec_id) + 1 FROM embeddings) AS rec, trial_type AS label, floor(onset % 64)::INT AS pos FROM e)"""
_POWER = " + ".join(
    f"pow({'+'.join(f'w[{j + 1}] * v[{j + 1}] * cos(2 * pi() * b * {j} / 16)' for j in range(16))}, 2) + pow({'+'.join(f'w[{j + 1}] * v[{j + 1}] * sin(2 * pi() * b * {j} / 16)' for j in range(16))}, 2)"
    for _ in range(1)
)

def _lfilter_sql(x: str, b, a) -> str:
    """The recursion over a list: the states stand first in the folded list, the outputs behind them."""
    b, a = [float(v / a[0]) for v in b], [float(v / a[0]) for v in a]
    n, out = len(b), f"({float(b[0])!r} * e[1] + acc[1])"
    states = ", ".join(f"{b[k]!r} * e[1] - {a[k]!r} * {out}" + (f" + acc[{k + 1}]" if k < n - 1 else "") for k in range(1, n))
    zero = ", ".join(["0.0::DOUBLE"] * (n - 1))
    return f"(list_reduce([[{zero}]] || list_transform({x}, lambda v: [v]), lambda acc, e: [{states}] || acc[{n}:] || [{out}]))[{n}:]"


def _filtfilt_sql(source: str, name: str, b, a, size: int) -> str:
    """Tables that filter the lists v of source forward and backward into those of name."""
    pad = min(3 * len(b), size - 1)
    front = f"list_transform(range({pad}, 0, -1), lambda i: 2 * v[1] - v[i + 1])"
    back = f"list_transform(range(1, {pad + 1}), lambda i: 2 * v[{size}] - v[{size} - i])"
    return f"""{name}_a AS (SELECT rec, {front} || v || {back} AS v FROM {source}), {name}_b AS (SELECT rec, list_reverse({_lfilter_sql("v", b, a)}) AS v FROM {name}_a),
      {name} AS (SELECT rec, list_reverse({_lfilter_sql("v", b, a)})[{pad + 1}:{pad + size}] AS v FROM {name}_b)"""


_LISTS = f"{_S}, p AS (SELECT rec, list(value ORDER BY idx) AS v FROM s GROUP BY rec)"
_OUT = f"SELECT rec, (unnest(range(1, len(v) + 1)) - 1)::INT AS idx, {_r('unnest(v)')} AS value FROM"


_LONG = "x AS (SELECT vec_id % 16 AS ch, (vec_id // 16) * 64 + i - 1 AS idx, embedding[i]::DOUBLE AS value FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i))"


def _long_filter_sql() -> str:
    """Both passes as recursions over all channels, on the signals continued at both ends by nine reflected samples."""
    (b0, b1, b2), (_, a1, a2) = ([repr(float(v)) for v in c] for c in filters.butter_lowpass(2, 0.2))

    def steps(source: str, name: str) -> str:
        out = f"{b0}::DOUBLE * v + z1"
        return f"""{name} AS (
          SELECT ch, j, {b0}::DOUBLE * v AS y, {b1}::DOUBLE * v - {a1}::DOUBLE * ({b0}::DOUBLE * v) AS z1, {b2}::DOUBLE * v - {a2}::DOUBLE * ({b0}::DOUBLE * v) AS z2 FROM {source} WHERE j = 0
          UNION ALL SELECT s.ch, s.j, {out}, {b1}::DOUBLE * v - {a1}::DOUBLE * ({out}) + z2, {b2}::DOUBLE * v - {a2}::DOUBLE * ({out}) FROM {name} r JOIN {source} s ON s.ch = r.ch AND s.j = r.j + 1)"""

    return f"""WITH RECURSIVE {_LONG}, n AS (SELECT ch, max(idx) + 1 AS n, arg_min(value, idx) AS f, arg_max(value, idx) AS l FROM x GROUP BY ch),
      e AS MATERIALIZED (SELECT ch, idx + 9 AS j, value AS v FROM x UNION ALL SELECT x.ch, 9 - idx, 2 * f - value FROM x JOIN n ON n.ch = x.ch WHERE idx BETWEEN 1 AND 9
        UNION ALL SELECT x.ch, 9 + n + (n - 2 - idx), 2 * l - value FROM x JOIN n ON n.ch = x.ch WHERE idx BETWEEN n - 10 AND n - 2),
      {steps('e', 'fw')}, back AS MATERIALIZED (SELECT fw.ch, n + 17 - j AS j, y AS v FROM fw JOIN n ON n.ch = fw.ch), {steps('back', 'bw')}
      SELECT bw.ch, n + 17 - j - 9 AS idx, {_r('y')} AS value FROM bw JOIN n ON n.ch = bw.ch WHERE n + 17 - j BETWEEN 9 AND n + 8"""


def _notch_sql() -> str:
    steps = [_filtfilt_sql("p" if k == 1 else f"n{k - 1}", f"n{k}", *filters.notch(10.0 * k, 64.0, 30.0), 64) for k in (1, 2, 3)]
    return f"{_LISTS}, {', '.join(steps)} {_OUT} n3"


def _resample_sql() -> str:
    low = _filtfilt_sql("p", "q", *filters.butter_lowpass(8, 0.375), 64)
    return f"""{_LISTS}, {low}, r AS (SELECT rec, list_transform(range(0, 24), lambda i: v[floor(i / 0.375)::INT + 1] * (1 - (i / 0.375 - floor(i / 0.375))) + v[least(floor(i / 0.375)::INT + 1, 63) + 1] * (i / 0.375 - floor(i / 0.375))) AS v FROM q) {_OUT} r"""


ORACLES = {
    "iir_filter": f"{_LISTS}, {_filtfilt_sql('p', 'q', *filters.butter_bandpass(2, 0.1, 0.6), 64)} {_OUT} q",
    "long_filter": _long_filter_sql(),
    "long_spectra": f"""WITH {_LONG}, n AS (SELECT ch, max(idx) + 1 AS n FROM x GROUP BY ch), k AS (SELECT ch, unnest(range(0, (n - 48) // 24 + 1)) AS k FROM n),
      h AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 47) AS w FROM range(0, 48) g(i)), f AS (SELECT b FROM range(0, 25) g(b)),
      c AS (SELECT ch, k, b, sum(value * w * cos(2 * pi() * b * i / 48)) AS re, sum(value * w * sin(2 * pi() * b * i / 48)) AS im FROM k JOIN h ON true JOIN x USING (ch) JOIN f ON true WHERE x.idx = 24 * k + i GROUP BY ch, k, b)
      SELECT ch, b AS bin, {_r('avg(re * re + im * im) / (SELECT sum(w * w) FROM h)')} AS psd FROM c GROUP BY ch, b""",
    "long_resample": f"""WITH {_LONG}, n AS (SELECT ch, max(idx) + 1 AS n FROM x GROUP BY ch), o AS (SELECT ch, n, unnest(range(0, floor(n * 1.5625 + 0.5)::BIGINT)) AS i FROM n),
      p AS (SELECT ch, i, n, i / 1.5625::DOUBLE AS t FROM o WHERE i / 1.5625::DOUBLE < n)
      SELECT p.ch, i AS idx, {_r('a.value * (1 - (t - floor(t))) + b.value * (t - floor(t))')} AS value
      FROM p JOIN x a ON a.ch = p.ch AND a.idx = floor(t)::BIGINT JOIN x b ON b.ch = p.ch AND b.idx = least(floor(t)::BIGINT + 1, n - 1)""",
    "notch_filter": _notch_sql(),
    "resample_signal": _resample_sql(),
    "channel_stats": f"""{_S} SELECT rec, ch, {_r('avg(value)')} AS mean, {_r('coalesce(stddev_samp(value), 0)')} AS std,
      CASE WHEN count(value) >= 2 AND var_pop(value) > 0 THEN {_r('ln(var_pop(value))')} ELSE '-infinity'::DOUBLE END AS log_variance,
      {_r('avg(value * value)')} AS power, {_r('sqrt(avg(value * value))')} AS rms, {_r('max(value) - min(value)')} AS peak_to_peak, count(value) AS n FROM s GROUP BY rec, ch""",
    "zscore": f"{_S} SELECT rec, grp, ch, idx, {_r('(value - avg(value) OVER w) / stddev_samp(value) OVER w')} AS value FROM s WINDOW w AS (PARTITION BY rec, ch)",
    "zscore_pop": f"{_S} SELECT rec, grp, ch, idx, {_r('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS value FROM s WINDOW w AS (PARTITION BY rec, ch)",
    "minmax": f"{_S} SELECT rec, grp, ch, idx, {_r('(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)')} AS value FROM s WINDOW w AS (PARTITION BY rec, ch)",
    "time_window": f"{_S} SELECT rec, grp, ch, idx - 6 AS idx, {_r('value')} AS value FROM s WHERE idx >= 6 AND idx < 29",
    "tumbling_epochs": f"{_S} SELECT rec, (idx // 15)::INT AS epoch, count(*) AS n, {_r('avg(value)')} AS mean FROM s WHERE idx < 60 GROUP BY ALL",
    "sliding_epochs": f"{_S} SELECT rec, k::INT AS epoch, count(*) AS n, {_r('sum((idx - 8 * k) * value)')} AS moment FROM s, range(0, 6) g(k) WHERE idx >= 8 * k AND idx < 8 * k + 20 GROUP BY ALL",
    "avg_ref": f"{_SETS} SELECT rec, grp, ch, idx, set, {_r('value - avg(value) OVER (PARTITION BY set, idx)')} AS value FROM r",
    "chan_ref": f"{_SETS} SELECT rec, grp, ch, idx, set, {_r('CASE WHEN ch = 3 THEN value ELSE value - coalesce(max(CASE WHEN ch = 3 THEN value END) OVER (PARTITION BY set, idx), 0) END')} AS value FROM r",
    "baseline": f"""{_S} SELECT rec, grp, ch, (idx % 32)::INT AS idx, (idx // 32)::INT AS epoch,
      {_r('value - avg(CASE WHEN idx % 32 < 8 THEN value END) OVER (PARTITION BY rec, idx // 32)')} AS value FROM s""",
    "covariance": f"{_SETS} SELECT a.set, a.ch AS i, b.ch AS j, {_r('covar_samp(a.value, b.value)')} AS covariance FROM r a JOIN r b ON a.set = b.set AND a.idx = b.idx GROUP BY ALL",
    "evoked": f"{_S} SELECT grp, idx, {_r('avg(value)')} AS value FROM s GROUP BY grp, idx",
    "unit_conversion": f"{_S} SELECT ch, {_r('sum(value * CASE ch WHEN 0 THEN 1000 WHEN 5 THEN 0.5 ELSE 1 END)')} AS total FROM s GROUP BY ch",
    "resample_linear": f"""{_S}, p AS (SELECT rec, list(value ORDER BY idx) AS v FROM s GROUP BY rec), g AS (SELECT i, i * 63 / 24.0::DOUBLE AS t FROM range(0, 25) x(i))
      SELECT rec, i::INT AS idx, {_r('v[least(floor(t), 63)::INT + 1] * (1 - (t - floor(t))) + v[least(floor(t) + 1, 63)::INT + 1] * (t - floor(t))')} AS value FROM p, g""",
    "convolution": f"""{_S} SELECT rec, idx, {_r('0.5 * value + 0.25 * coalesce(lag(value, 1) OVER w, 0) + 0.125 * coalesce(lag(value, 2) OVER w, 0)')} AS value FROM s WINDOW w AS (PARTITION BY rec ORDER BY idx)""",
    "welch_psd": f"""{_S}, p AS (SELECT rec, list(value ORDER BY idx) AS a FROM s GROUP BY rec),
      win AS (SELECT list(0.5 - 0.5 * cos(2 * pi() * k / 15) ORDER BY k) AS w FROM range(0, 16) x(k)),
      seg AS (SELECT rec, w, b, a[1 + 8 * q:16 + 8 * q] AS v FROM p, win, range(0, 7) y(q), range(0, 9) z(b))
      SELECT rec, b::INT AS bin, {_r(f'avg(({_POWER}) / list_sum(list_transform(w, lambda x: x * x)))')} AS psd FROM seg GROUP BY rec, b""",
    "epoch_extract": f"""WITH {_MARKS} SELECT event_id, label, count(*) AS n, {_r('sum(value * (idx - pos + 4 + 1))')} AS moment
      FROM m JOIN s ON m.rec = s.rec AND idx >= pos - 4 AND idx < pos + 10 WHERE pos >= 4 AND pos + 10 <= 64 GROUP BY event_id, label""",
    "annotation_reject": f"""WITH {_MARKS}, k AS (SELECT rec, idx, CASE WHEN EXISTS (FROM m WHERE m.rec = s.rec AND label = 'error' AND s.idx >= pos AND s.idx < pos + 6) THEN NULL ELSE value END AS value FROM s)
      SELECT rec, count(value) AS kept, {_r('avg(value)')} AS mean FROM k GROUP BY rec""",
    "harmonize_intersect": f"WITH {EVENTS_SQL} SELECT trial_type AS channel FROM e WHERE trial_type <> 'view' GROUP BY 1 HAVING count(DISTINCT subject % 5) = (SELECT count(DISTINCT subject % 5) FROM e)",
    "harmonize_union": f"""WITH {EVENTS_SQL}, v AS (SELECT subject, run, trial_type AS channel, sum(amplitude) AS value FROM e GROUP BY ALL)
      SELECT g.subject, g.run, 0 AS idx, g.channel, {_r('coalesce(v.value, 0)')} AS value FROM (SELECT * FROM (SELECT DISTINCT subject, run FROM e), (SELECT DISTINCT trial_type AS channel FROM e)) g LEFT JOIN v USING (subject, run, channel)""",
}
