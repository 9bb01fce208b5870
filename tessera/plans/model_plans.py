"""Queries of the variable, model and dataset operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import hrf
from tessera.operators import catalog, datasets, models, variables
from tessera.plans import catalog_plans, views
from tessera.plans.signal_plans import _r, _rounded
from tessera.plans.views import EVENTS_SQL

_E = f"WITH {EVENTS_SQL}"
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_NUM, "l_returnflag", "l_linestatus")


def melt(spark: SparkSession, d: str) -> DataFrame:
    df = views.read(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("nation"))
    return variables.melt(df, ["c_custkey"], ["c_mktsegment", "nation"])


def pivot_events(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).select("subject", F.col("trial_type").alias("name"), F.col("amplitude").alias("value"))
    return _rounded(variables.pivot(e, ["subject"], ["click", "error", "purchase", "signup", "view"]), "click", "error", "purchase", "signup", "view")


def variable_types(spark: SparkSession, d: str) -> DataFrame:
    return variables.is_numeric(melt(spark, d))


def sparse_to_dense(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).withColumn("onset", F.floor(F.col("onset"))).withColumn("duration", F.lit(2.0))
    return _rounded(variables.sparse_to_dense(e, 1, ["subject", "run"]), "value")


def bin_rate(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).withColumn("onset", F.floor(F.col("onset") / 4) * 4)
    return variables.bin_rate(e.where("onset > 0").withColumn("duration", F.lit(2.5)), ["subject"])


def lag_zero(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).select("subject", "event_id", F.col("amplitude").alias("value"), "onset")
    return _rounded(variables.lag_zero(e, 2, ["subject"], ["event_id"]).select("subject", "event_id", "value"), "value")


def run_offset(spark: SparkSession, d: str) -> DataFrame:
    return variables.run_offsets(views.events(spark, d).select("subject", "event_id", "onset"), ["subject"], ["event_id"])


def dense_index(spark: SparkSession, d: str) -> DataFrame:
    runs = views.events(spark, d).groupBy("subject", "run").agg(F.max(F.col("onset") + F.col("duration")).alias("duration"))
    return _rounded(variables.run_bounds(runs, ["subject"], ["run"]), "duration")


def boxcar(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).withColumn("onset", F.floor(F.col("onset") / 60)).withColumn("duration", F.lit(3.0))
    return _rounded(variables.boxcar(e, ["subject", "run"]), "level")


def common_entities(spark: SparkSession, d: str) -> DataFrame:
    w = catalog.tags(views.files(spark, d)).where("entity != 'extension'")
    g = w.where("entity = 'session'").select("path", F.col("value").alias("g"))
    return variables.common_entities(w.join(g, "path").select("g", F.col("path").alias("row"), "entity", "value"), ["g"])


def factor(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag")
    out = variables.transform(df, [{"Name": "Factor", "Input": "l_returnflag", "Levels": ["A", "N", "R"]}], ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[F.col(f"`l_returnflag.{x}`").alias(f"is_{x.lower()}") for x in "ANR"])


def scale(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = variables.transform(df, [{"name": "scale", "input": ["l_quantity"]}, {"name": "scale", "input": ["l_tax"], "rescale": False}], ["l_orderkey", "l_linenumber"])
    #: Differences from the mean of hundredths are ties at seven digits.
    return out.select("l_orderkey", "l_linenumber", *[(F.round(c, 9) + 0.0).alias(c) for c in ("l_quantity", "l_tax")])


def threshold(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = variables.transform(df, [{"Name": "Threshold", "Input": "l_quantity", "Threshold": 25.0, "Binarize": True}, {"Name": "Threshold", "Input": "l_discount", "Threshold": 0.05, "Above": False}], ["l_orderkey"])
    return _rounded(out, "l_quantity", "l_discount")


def replace_values(spark: SparkSession, d: str) -> DataFrame:
    return variables.transform(_lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag"), [{"Name": "Replace", "Input": "l_returnflag", "Output": "flag", "Replace": {"A": "accepted", "R": "returned"}}], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "flag")


def dropna_split(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_linestatus", F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("q"))
    out = variables.transform(df, [{"Name": "DropNA", "Input": "q"}, {"Name": "Split", "Input": "q", "By": "l_linestatus", "Levels": ["F", "O"]}], ["l_orderkey"])
    return out.select("l_orderkey", "l_linenumber", F.col("`q.F`").alias("q_f"), F.col("`q.O`").alias("q_o"))


def concat_filter(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    out = variables.transform(df, [{"Name": "Concatenate", "Input": ["l_discount", "l_tax"], "Output": "both"}, {"Name": "Filter", "Query": "both > 0.04"}], ["l_orderkey"])
    return out.select("l_orderkey", "l_linenumber", F.round("both", 6).alias("both"))


def orthogonalize(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    out = variables.transform(df, [{"Name": "Orthogonalize", "Input": "l_extendedprice", "Other": ["l_quantity"]}], ["l_orderkey"])
    return out.select("l_orderkey", "l_linenumber", (F.round("l_extendedprice", 3) + 0.0).alias("residual"))


def logic_ops(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    steps = [{"Name": "And", "Input": ["l_discount", "l_tax"], "Output": "both"}, {"Name": "Or", "Input": ["l_discount", "l_tax"], "Output": "one"}, {"Name": "Not", "Input": "l_tax", "Output": "untaxed"}]
    return variables.transform(df, steps, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "both", "one", "untaxed")


def product_sum_power(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    steps = [{"Name": "Product", "Input": ["l_quantity", "l_tax"], "Output": "p"}, {"Name": "Sum", "Input": ["l_discount", "l_tax"], "Weights": [2.0, 1.0], "Output": "s"}, {"Name": "Power", "Input": "l_quantity", "Value": 2, "Output": "q"}]
    return _rounded(variables.transform(df, steps, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "p", "s", "q"), "p", "s", "q")


def correlation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.correlations(_lines(spark, d), _NUM), "r")


def vif_approx(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.vif_approx(_lines(spark, d), _NUM), "vif")


def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = models.design_matrix(_lines(spark, d), "y ~ l_quantity*l_discount + l_tax", ["l_orderkey", "l_linenumber"])
    m = models.apply_contrast(m, ["l_quantity", "l_tax"], [1.0, -2.0], "contrast")
    return _rounded(m.withColumnRenamed("l_quantity:l_discount", "interaction"), "l_quantity", "l_discount", "interaction", "l_tax", "contrast")


def auto_model(spark: SparkSession, d: str) -> DataFrame:
    return models.auto_model(views.events(spark, d), "subject", "trial_type")


def _hrf(spark: SparkSession, d: str, params: tuple) -> DataFrame:
    """The response to a unit impulse at the times of events, modulo 40 seconds, and how many events of a subject are at its rise."""
    n, step, dt = hrf.grid(2.0, 16, 32.0)
    total = sum(hrf.kernel_values(params, n, step, dt))
    e = views.events(spark, d).select("event_id", "subject", (F.col("onset") / 7 % 40 - 4).alias("t"))
    return _rounded(e.select("event_id", "t", (hrf.value_column(F.col("t"), params, dt) / total).alias("value")), "t", "value")


def spm_hrf(spark: SparkSession, d: str) -> DataFrame:
    return _hrf(spark, d, hrf.SPM)


def glover_hrf(spark: SparkSession, d: str) -> DataFrame:
    return _hrf(spark, d, hrf.GLOVER)


def regressors(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).withColumn("onset", F.col("onset") / 864).withColumn("duration", F.lit(1.0))
    return _rounded(models.regressors(e, ["subject", "trial_type"], frames=50, tr=2.0, model="spm + derivative", oversampling=16), "regressor_0", "regressor_1")


def model_graph(spark: SparkSession, d: str) -> DataFrame:
    spec = {
        "Nodes": [
            {"Name": "line", "Level": "Run", "GroupBy": ["l_orderkey"], "Transformations": {"Instructions": [{"Name": "Scale", "Input": ["l_quantity"], "Rescale": False}]}, "Model": {"X": [1, "l_quantity", "l_tax"]}, "Contrasts": [{"Name": "net", "ConditionList": ["l_quantity", "l_tax"], "Weights": [1, -1]}]},
            {"Name": "order", "Level": "Subject", "Model": {"X": [1, "net"]}, "DummyContrasts": {"Conditions": ["net"]}},
        ]
    }
    return _rounded(models.Graph.from_json(spec).run(_lines(spark, d), ["l_orderkey", "l_linenumber"])["order"], "net", "dummy_net")


def _users(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).groupBy("subject").agg(F.min("trial_type").alias("label"))


def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    return datasets.ratio_split(_users(spark, d), "subject", train=0.7, val=0.15, rank=datasets.md5_rank(F.col("subject"), 42))


def kfold(spark: SparkSession, d: str) -> DataFrame:
    return datasets.k_fold(_users(spark, d), "subject", 5, rank=datasets.md5_rank(F.col("subject"), 7))


def stratified(spark: SparkSession, d: str) -> DataFrame:
    return datasets.ratio_split(_users(spark, d), "subject", train=0.6, val=0.2, rank=datasets.md5_rank(F.col("subject"), 1), by=["label"])


def fnv_split(spark: SparkSession, d: str) -> DataFrame:
    u = _users(spark, d).withColumn("hash", datasets.fnv_rank(F.col("subject"), 42))
    return datasets.ratio_split(u, "subject", train=0.7, val=0.15, rank=F.col("hash"))


def cross_session(spark: SparkSession, d: str) -> DataFrame:
    s = views.events(spark, d).select("subject", F.weekofyear("run").alias("session")).distinct()
    return datasets.leave_one_out(s, "session", ["subject"])


def cross_subject(spark: SparkSession, d: str) -> DataFrame:
    s = views.events(spark, d).select("subject", F.weekofyear("run").alias("session")).distinct()
    return datasets.subject_folds(s, "subject")


def subject_k_fold(spark: SparkSession, d: str) -> DataFrame:
    s = views.events(spark, d).select("subject", F.weekofyear("run").alias("session")).distinct()
    return datasets.subject_k_fold(s, "subject", 4, rank=datasets.md5_rank(F.col("subject"), 3))


def within_session_folds(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).select("subject", "event_id")
    return datasets.within_session_folds(e, "event_id", 5, 3, ["subject"])


def window_samples(spark: SparkSession, d: str) -> DataFrame:
    p = views.read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("duration"))
    return datasets.window_samples(p, "duration", 10.0, 2.5)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    w = catalog.wide(views.files(spark, d))
    m = datasets.manifest(w, F.concat(F.lit("ds"), F.col("datatype")))
    return datasets.matches(m, not_subjects=["00001", "00002"], task="F").select("dataset", "subject", "session", "task", "run", "datatype", "suffix", "extension", "path", "global_subject")


def label_dist(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = views.read(spark, d, "documents"), views.read(spark, d, "labels")
    return datasets.label_distribution(docs.join(labels, "doc_id", "left"), "quality")


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return datasets.summary(views.read(spark, d, "documents"), F.col("source"))


def pipeline_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(datasets.mean_scores(views.events(spark, d), ["trial_type"], "amplitude"), "mean_score")


QUERIES = {f.__name__: f for f in (
    melt, pivot_events, variable_types, sparse_to_dense, bin_rate, lag_zero, run_offset, dense_index, boxcar, common_entities, factor, scale, threshold,
    replace_values, dropna_split, concat_filter, orthogonalize, logic_ops, product_sum_power, correlation, vif_approx, design_matrix, auto_model, spm_hrf,
    glover_hrf, regressors, model_graph, ratio_split, kfold, stratified, fnv_split, cross_session, cross_subject, subject_k_fold, within_session_folds, window_samples,
    manifest, label_dist, dataset_summary, pipeline_means,
)}

_U = f"{_E}, u AS (SELECT subject, min(trial_type) AS label FROM e GROUP BY subject)"
_SPLIT = """, k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}:' || subject), subject) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM u)
SELECT subject, label, CASE WHEN r <= round(n * {train}) THEN 'train' WHEN r <= least(n, round(n * {train}) + round(n * {val})) THEN 'val' ELSE 'test' END AS split FROM k"""


def _hrf_sql(params: tuple) -> str:
    delay, under, disp, under_disp, ratio = params
    n, step, dt = hrf.grid(2.0, 16, 32.0)
    pdf = lambda a, loc: f"CASE WHEN t > {loc} THEN exp(({a} - 1) * ln(t - {loc}) - (t - {loc}) - lgamma({a})) ELSE 0 END"
    raw = f"CASE WHEN t > 0 THEN {pdf(delay / disp, dt / disp)} - {ratio} * ({pdf(under / under_disp, dt / under_disp)}) ELSE 0 END"
    return f"""{_E}, g AS (SELECT i * {step!r}::DOUBLE AS t FROM range(0, {n}) x(i)), total AS (SELECT sum({raw}) AS s FROM g),
      o AS (SELECT event_id, onset / 7 % 40 - 4 AS t FROM e) SELECT event_id, {_r("t")} AS t, {_r(f"({raw}) / s")} AS value FROM o, total"""


def _regressor_sql() -> str:
    ks = hrf.kernels("spm + derivative", 2.0, 16)
    lists = [f"{k!r}::DOUBLE[]" for k in ks]
    conv = lambda i: _r(f"sum(x * coalesce(list_sum(k{i}[greatest(1, 16 * f - b + 2):greatest(0, 16 * f - a + 1)]), 0))")
    return f"""{_E}, v AS (SELECT subject, trial_type, amplitude AS x, least(round(onset / 864 / 0.125), 799)::INT AS a, least(round((onset / 864 + 1) / 0.125), 799)::INT AS b0 FROM e),
w AS (SELECT subject, trial_type, x, a, greatest(b0, a + 1) AS b FROM v), ker AS (SELECT {lists[0]} AS k0, {lists[1]} AS k1)
SELECT subject, trial_type, f::INT AS frame, {conv(0)} AS regressor_0, {conv(1)} AS regressor_1 FROM w, ker, range(0, 50) y(f) WHERE 16 * f >= a GROUP BY ALL"""


ORACLES = {
    "melt": "SELECT c_custkey, 'c_mktsegment' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer",
    "pivot_events": f"{_E} SELECT subject, " + ", ".join(_r(f"max(CASE WHEN trial_type = '{t}' THEN amplitude END)") + f" AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM e GROUP BY subject",
    "variable_types": "SELECT 'c_mktsegment' AS name, false AS numeric UNION ALL SELECT 'nation', true",
    "sparse_to_dense": f"{_E}, b AS (SELECT subject, run, floor(onset)::BIGINT + k AS bin, floor(onset) AS o, event_id, amplitude FROM e, range(0, 2) x(k)) SELECT subject, run, bin, {_r('arg_max(amplitude, (o, event_id))')} AS value FROM b GROUP BY ALL",
    "bin_rate": f"{_E}, m AS (SELECT DISTINCT subject, (floor(onset / 4) * 4000)::BIGINT AS ms FROM e WHERE floor(onset / 4) > 0 UNION SELECT DISTINCT subject, 2500 FROM e WHERE floor(onset / 4) > 0) SELECT subject, list_reduce(list(ms ORDER BY ms), lambda a, b: gcd(a, b))::BIGINT AS bin_ms FROM m GROUP BY subject",
    "lag_zero": f"{_E} SELECT subject, event_id, {_r('coalesce(lag(amplitude, 2) OVER (PARTITION BY subject ORDER BY event_id), 0)')} AS value FROM e",
    "run_offset": f"{_E}, k AS (SELECT subject, event_id, onset, (onset < lag(onset) OVER (PARTITION BY subject ORDER BY event_id))::INT AS s FROM e) SELECT subject, event_id, onset, coalesce(sum(s) OVER (PARTITION BY subject ORDER BY event_id), 0)::INT AS run_index FROM k",
    "dense_index": f"{_E}, r AS (SELECT subject, run, max(onset + duration) AS duration FROM e GROUP BY ALL), c AS (SELECT *, sum(duration) OVER (PARTITION BY subject ORDER BY run) AS t FROM r) SELECT subject, run, {_r('duration')} AS duration, round(t - duration, 6) AS start, round(t, 6) AS \"end\" FROM c",
    "boxcar": f"{_E}, s AS (SELECT subject, run, floor(onset / 60) AS t, amplitude AS d FROM e UNION ALL SELECT subject, run, floor(onset / 60) + 3, -amplitude FROM e), g AS (SELECT subject, run, t, sum(d) AS d FROM s GROUP BY ALL) SELECT subject, run, t, {_r('sum(d) OVER (PARTITION BY subject, run ORDER BY t)')} AS level FROM g",
    "common_entities": f"WITH {catalog_plans.TAGS_SQL}, g AS (SELECT path, value AS g FROM t WHERE entity = 'session'), j AS (SELECT g, t.path, entity, value FROM t JOIN g ON t.path = g.path WHERE entity <> 'extension'), n AS (SELECT g, count(DISTINCT path) AS n FROM j GROUP BY g), c AS (SELECT g, entity, value, count(DISTINCT path) AS k FROM j GROUP BY g, entity, value) SELECT c.g, entity, value FROM c JOIN n ON c.g = n.g WHERE k = n",
    "factor": "SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS is_a, (l_returnflag = 'N')::INT AS is_n, (l_returnflag = 'R')::INT AS is_r FROM lineitem",
    "scale": "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 9) + 0.0 AS l_quantity, round(l_tax - avg(l_tax) OVER (), 9) + 0.0 AS l_tax FROM lineitem",
    "threshold": f"SELECT l_orderkey, l_linenumber, (l_quantity >= 25)::INT::DOUBLE AS l_quantity, {_r('CASE WHEN l_discount <= 0.05 THEN l_discount ELSE 0 END')} AS l_discount FROM lineitem",
    "replace_values": "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS flag FROM lineitem",
    "dropna_split": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS q_f, CASE WHEN l_linestatus = 'O' THEN l_quantity END AS q_o FROM lineitem WHERE l_tax > 0",
    "concat_filter": "SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS both FROM lineitem WHERE l_discount > 0.04 UNION ALL SELECT l_orderkey, l_linenumber, round(l_tax, 6) FROM lineitem WHERE l_tax > 0.04",
    "orthogonalize": "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity * (sum(l_extendedprice * l_quantity) OVER ()) / (sum(l_quantity * l_quantity) OVER ()), 3) + 0.0 AS residual FROM lineitem",
    "logic_ops": "SELECT l_orderkey, l_linenumber, (l_discount <> 0 AND l_tax <> 0)::INT AS both, (l_discount <> 0 OR l_tax <> 0)::INT AS one, (l_tax = 0)::INT AS untaxed FROM lineitem",
    "product_sum_power": f"SELECT l_orderkey, l_linenumber, {_r('l_quantity * l_tax')} AS p, {_r('l_discount * 2 + l_tax')} AS s, {_r('pow(l_quantity, 2)')} AS q FROM lineitem",
    "correlation": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_r(f'corr({a}, {b})')} AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]),
    "vif_approx": " UNION ALL ".join(f"SELECT '{a}' AS name, {_r('1 / (1 - (' + ' + '.join(f'pow(corr({a}, {b}), 2)' for b in _NUM if b != a) + '))')} AS vif FROM lineitem" for a in _NUM),
    "design_matrix": f"SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS intercept, {_r('l_quantity')} AS l_quantity, {_r('l_discount')} AS l_discount, {_r('l_quantity * l_discount')} AS interaction, {_r('l_tax')} AS l_tax, {_r('l_quantity - 2 * l_tax')} AS contrast FROM lineitem",
    "auto_model": f"{_E} SELECT subject, string_agg(DISTINCT 'trial_type.' || trial_type, ',' ORDER BY 'trial_type.' || trial_type) AS factors FROM e GROUP BY subject",
    "spm_hrf": _hrf_sql(hrf.SPM),
    "glover_hrf": _hrf_sql(hrf.GLOVER),
    "regressors": _regressor_sql(),
    "model_graph": f"WITH m AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey)) - l_tax AS net FROM lineitem) SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS intercept, {_r('net')} AS net, {_r('net')} AS dummy_net FROM m",
    "ratio_split": _U + _SPLIT.format(by="1", seed=42, train=0.7, val=0.15),
    "kfold": _U + " SELECT subject, label, ((row_number() OVER (ORDER BY md5('7:' || subject), subject) - 1) % 5)::INT AS fold FROM u",
    "stratified": _U + _SPLIT.format(by="label", seed=1, train=0.6, val=0.2),
    "fnv_split": f"""{_E}, u AS (SELECT subject, min(trial_type) AS label FROM e GROUP BY subject),
      h AS (SELECT *, list_reduce([xor(14695981039346656037::UBIGINT, 42::UBIGINT)] || list_transform(string_split(subject::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
        lambda a, b: xor(((a::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT, b)) AS h FROM u),
      k AS (SELECT *, row_number() OVER (ORDER BY h, subject) AS r, count(*) OVER () AS n FROM h)
      SELECT subject, label, printf('%016x', h) AS hash, CASE WHEN r <= round(n * 0.7) THEN 'train' WHEN r <= least(n, round(n * 0.7) + round(n * 0.15)) THEN 'val' ELSE 'test' END AS split FROM k""",
    "within_session_folds": f"""WITH RECURSIVE {EVENTS_SQL.lstrip()},
      g AS (SELECT subject, list(event_id ORDER BY event_id) AS ids, count(*) AS n FROM e GROUP BY subject HAVING count(*) >= 5),
      s AS (
        SELECT subject, n - 1 AS i, 4::UBIGINT AS st, range(0, n) AS spots, ids, n FROM g
        UNION ALL
        SELECT subject, i - 1, t, list_transform(spots, lambda x, k: CASE WHEN k - 1 = i THEN spots[j + 1] WHEN k - 1 = j THEN spots[i + 1] ELSE x END), ids, n
        FROM (SELECT *, ((t >> 33) % (i + 1)::UBIGINT)::BIGINT AS j FROM (
          SELECT *, ((st::UHUGEINT * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS t FROM s WHERE i > 0)))
      SELECT subject, ids[spots[pos + 1] + 1] AS event_id, pos::BIGINT AS position, least(pos // (n // 5), 4)::INT AS fold FROM (SELECT subject, ids, n, spots, unnest(range(0, n)) AS pos FROM s WHERE i = 0)""",
    "cross_session": f"{_E}, s AS (SELECT DISTINCT subject, weekofyear(run)::INT AS session FROM e), n AS (SELECT subject FROM s GROUP BY 1 HAVING count(*) > 1) SELECT a.subject, a.session, b.session AS held_out, CASE WHEN a.session = b.session THEN 'test' ELSE 'train' END AS role FROM s a JOIN s b ON a.subject = b.subject JOIN n ON n.subject = a.subject",
    "cross_subject": f"{_E}, s AS (SELECT DISTINCT subject, weekofyear(run) AS session FROM e) SELECT subject AS held_out, count(*) AS n_test, (SELECT count(*) FROM s) - count(*) AS n_train FROM s GROUP BY subject",
    "subject_k_fold": f"{_E}, s AS (SELECT DISTINCT subject, weekofyear(run)::INT AS session FROM e), k AS (SELECT subject, ((row_number() OVER (ORDER BY md5('3:' || subject), subject) - 1) % 4)::INT AS fold FROM (SELECT DISTINCT subject FROM s)) SELECT subject, session, fold FROM s JOIN k USING (subject)",
    "window_samples": "SELECT p_partkey, p_size::DOUBLE AS duration, k::INT AS sample, k * 2.5::DOUBLE AS start, k * 2.5::DOUBLE + 10 AS \"end\" FROM part, range(0, 100) x(k) WHERE p_size >= 10 AND k <= floor((p_size - 10) / 2.5)",
    "manifest": f"WITH {catalog_plans.WIDE_SQL} SELECT 'ds' || datatype AS dataset, subject, session, task, run, datatype, suffix, extension, path, 'ds' || datatype || '_' || subject AS global_subject FROM w WHERE subject NOT IN ('00001', '00002') AND task = 'F'",
    "label_dist": "SELECT coalesce(quality::VARCHAR, '_unlabeled_') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "dataset_summary": "SELECT source AS dataset, count(*) AS n FROM documents GROUP BY source",
    "pipeline_means": f"{_E} SELECT trial_type, {_r('avg(amplitude)')} AS mean_score, count(amplitude) AS n FROM e GROUP BY trial_type",
}
