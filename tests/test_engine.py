"""Numeric kernels, models, splits, streams, and the registered queries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import filters, hrf
from tessera.operators import associations, catalog, datasets, models, signal, variables
from tessera.streaming import windows


def test_butterworth_gains():
    for order in (1, 2, 3, 5, 8):
        for cutoff in (0.1, 0.3, 0.5, 0.8):
            b, a = filters.butter_lowpass(order, cutoff)
            assert b.sum() / a.sum() == pytest.approx(1)
            edge = np.exp(-1j * np.pi * cutoff * np.arange(order + 1))
            assert abs((b * edge).sum() / (a * edge).sum()) == pytest.approx(math.sqrt(0.5))
            b, a = filters.butter_highpass(order, cutoff)
            assert abs(b.sum()) < 1e-9
    assert filters.butter_lowpass(1, 0.5)[0] == pytest.approx([0.5, 0.5])


def test_filters_keep_length_and_constants():
    b, a = filters.butter_lowpass(3, 0.3)
    assert filters.filtfilt(b, a, np.full(50, 2.0))[20:30] == pytest.approx(np.full(10, 2.0), abs=1e-2)
    t = np.arange(512) / 128
    hum = filters.filtfilt(*filters.notch(20, 128, 30), np.sin(2 * np.pi * 20 * t))
    assert np.abs(hum[200:300]).max() < 0.2
    assert len(filters.resample(np.arange(100.0), 100, 50)) == 50 and filters.resample(np.arange(10.0), 10, 20)[:4] == pytest.approx([0, 0.5, 1, 1.5])


def test_hrf_kernels():
    for params, peak in ((hrf.SPM, 126), (hrf.GLOVER, None)):
        k = hrf.kernel(params, 2.0, 50)
        assert len(k) == 800 and sum(k) == pytest.approx(1)
    assert np.argmax(hrf.kernel(hrf.SPM, 2.0, 50)) == 126
    assert len(hrf.kernels("spm + derivative + dispersion", 2.0)) == 3 and hrf.names("x", "fir", [0, 2]) == ["x_delay_0", "x_delay_2"]
    assert hrf.gamma_pdf(0.0, 1.0) == 1.0 and hrf.gamma_pdf(-1, 3) == 0 and hrf.gamma_pdf(2.0, 3.0) == pytest.approx(2 * math.exp(-2))


def test_regressors_match_direct_convolution(spark):
    e = [(2.0, 1.0, 1.0), (6.0, 1.0, 1.0), (12.0, 2.0, 0.5), (14.0, 0.0, 1.0)]
    df = spark.createDataFrame([(1, *x) for x in e], "s int, onset double, duration double, amplitude double")
    got = {r.frame: r.regressor_0 for r in models.regressors(df, ["s"], frames=40, tr=0.5, oversampling=10).collect()}
    fine, k = np.zeros(400), np.array(hrf.kernel(hrf.SPM, 0.5, 10))
    for onset, duration, x in e:
        a, b = round(onset / 0.05), round((onset + duration) / 0.05)
        fine[a : max(b, a + 1)] += x
    want = np.convolve(fine, k)[:400][::10]
    assert all(abs(got.get(i, 0.0) - want[i]) < 1e-12 for i in range(40))


def test_regressors_keep_the_frames_of_events_without_amplitude(spark):
    rows = [(1, 2.0, 1.0, 0.0), (1, 12.0, 1.0, 2.0), (2, 0.0, 1.0, 0.0), (3, 4.0, 1.0, 1e9), (3, 38.0, 1.0, 5.0), (4, -3.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s int, onset double, duration double, amplitude double")
    got = {(r.s, r.frame): r.regressor_0 for r in models.regressors(df, ["s"], frames=80, tr=0.5, oversampling=10).collect()}
    assert sorted(got) == [(s, f) for s, first in ((1, 4), (2, 0), (3, 8), (4, 0)) for f in range(first, 80)]
    assert all(got[2, f] == 0 for f in range(80)) and all(got[1, f] == 0 for f in range(4, 24))
    fine = np.zeros(800)
    fine[760:780] = 5.0
    want = np.convolve(fine, hrf.kernel(hrf.SPM, 0.5, 10))[:800][::10]
    #: Past its response, a large event leaves nothing behind.
    assert all(abs(got[3, f] - want[f]) < 1e-12 for f in range(76, 80))


def test_formula():
    f = models.parse_formula("y ~ a + b*c + d:e - 1")
    assert f == models.Formula("y", (("a",), ("b",), ("c",), ("b", "c"), ("d", "e")), False)
    assert models.contrast_vector(["b"], [2.0], ["a", "b"]) == [0.0, 2.0]


def test_graph_refuses_cycles():
    n = [{"Name": "a"}, {"Name": "b"}]
    assert models.Graph.from_json({"Nodes": n}).order() == ["a", "b"]
    with pytest.raises(ValueError, match="cycle"):
        models.Graph.from_json({"Nodes": n, "Edges": [{"Source": "a", "Destination": "b"}, {"Source": "b", "Destination": "a"}]})
    assert '"a" -> "b"' in models.Graph.from_json({"Nodes": n}).dot()


def test_unknown_transformation(spark):
    with pytest.raises(ValueError, match="unknown"):
        variables.transform(spark.range(1), [{"Name": "Fly", "Input": "id"}], ["id"])


def test_inheritance(spark):
    w = catalog.wide(spark.createDataFrame([("/ds/sub-01/eeg/sub-01_task-rest_eeg.edf",), ("/ds/sub-02/eeg/sub-02_task-rest_eeg.edf",)], "path string"))
    s = [("/ds/task-rest_eeg.json", "/ds", None, "rest", k, v) for k, v in (("Ref", "Cz"), ("Line", "50"))]
    s += [("/ds/sub-01/eeg/sub-01_task-rest_eeg.json", "/ds/sub-01/eeg", "01", "rest", k, v) for k, v in (("Rate", "256"), ("Line", "60"))]
    side = spark.createDataFrame([(p, d, "eeg", k, v, a, b) for p, d, a, b, k, v in s], "path string, dir string, suffix string, key string, value string, subject string, task string")
    got = {(r.path[-23:-18], r.key): r.value for r in associations.inherited(w, side, entities=["subject", "task"]).collect()}
    assert sorted(got.values()) == sorted(["256", "60", "Cz", "50", "Cz"])


def test_suggestions(spark):
    f = spark.createDataFrame([("/ds/sub-01/eeg/sub-01_task-rest_eeg.edf",)], "path string")
    q = catalog.CatalogQuery(f, catalog.tags(f)).equals("subjct", "01")
    assert catalog.unknown_entities(q) == [("subjct", ["subject"])] or catalog.unknown_entities(q)[0][1][0] == "subject"
    assert q.paths().count() == 0


def test_splits_are_disjoint_and_whole(spark):
    u = spark.range(100).select(F.col("id").alias("subject"), (F.col("id") % 3).alias("label"))
    s = datasets.ratio_split(u, "subject", train=0.5, val=0.5, rank=datasets.fnv_rank(F.col("subject"), 1), by=["label"])
    assert s.count() == 100 and s.where("split = 'test'").count() == 0
    w = datasets.within_session_folds(u, "subject", 4, 9, ["label"]).collect()
    assert len(w) == 100 and {r.fold for r in w} == {0, 1, 2, 3} and sorted(r.position for r in w if r.label == 0) == list(range(34))
    assert [(r.position, r.subject) for r in w] == [(r.position, r.subject) for r in datasets.within_session_folds(u, "subject", 4, 9, ["label"]).collect()]


def test_csp_separates_classes(spark):
    draw = np.random.default_rng(0)
    rows = [(e, e % 2, c, i, float(v)) for e in range(20) for c in range(3) for i, v in enumerate(draw.normal(size=60) * (5 if c == e % 2 else 1))]
    s = spark.createDataFrame(rows, "rec long, grp int, ch long, idx int, value double")
    names, w = signal.csp_fit(s, 1)
    f = {(r.rec, r.component): r.feature for r in signal.csp_transform(s, names, w).collect()}
    assert all((f[e, 0] > f[e, 1]) == (e % 2 == 0) for e in range(20))


def test_stream_equals_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    e.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, f in (("tumbling", lambda x: windows.counted(x, "6 hours", late="3650 days")), ("sessions", lambda x: windows.sessions(x, "12 hours", late="3650 days"))):
        q = f(stream).writeStream.outputMode("complete" if name == "tumbling" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        if name == "tumbling":
            shown = lambda df: sorted(str((r.start, r.event_type, r.n, round(r.total, 6))) for r in df.collect())
            assert shown(spark.table(name)) == shown(f(e))
    s = e.select(F.col("user_id").alias("rec"), F.col("event_id").alias("idx"), (F.floor("value") % 3).cast("long").alias("status"))
    s.repartitionByRange(3, "idx").sortWithinPartitions("idx").write.parquet(str(tmp_path / "s"))
    q = windows.triggers(spark.readStream.schema(s.schema).parquet(str(tmp_path / "s"))).writeStream.format("memory").queryName("triggers").option("checkpointLocation", str(tmp_path / "t")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("triggers").collect())) == sorted(map(str, windows.triggers(s).collect()))


def test_every_query_has_a_stable_schema(spark):
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


def test_bin_rate_beyond_a_day(spark):
    rows = [("a", 90_000.25, 0.5), ("a", 90_001.0, 0.5), ("b", 100_000.0, 90_000.0), ("c", 2.0, 4e6), ("c", 3.0, 0.0), ("d", 0.0, 0.0)]
    rows += [("e", 200_000 + k * 0.75, 1.5) for k in range(3000)]
    e = spark.createDataFrame(rows, "g string, onset double, duration double")
    assert {r.g: r.bin_ms for r in variables.bin_rate(e, ["g"]).collect()} == {"a": 250, "b": 10_000_000, "c": 1000, "e": 250}
