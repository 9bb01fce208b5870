"""Steps, recordings, metadata, validity and benchmark tables against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import filters, metadata, phrases, schema
from tessera.operators import catalog, datasets, models, recordings, signal, steps, variables


def test_filters_work_on_blocks_as_on_single_channels():
    x = np.random.default_rng(0).normal(size=(3, 70))
    b, a = filters.butter_bandpass(2, 0.1, 0.6)
    slow = np.zeros(70)
    for n in range(70):
        slow[n] = (sum(b[k] * x[1, n - k] for k in range(len(b)) if n >= k) - sum(a[k] * slow[n - k] for k in range(1, len(a)) if n >= k)) / a[0]
    assert filters.lfilter(b, a, x)[1] == pytest.approx(slow)
    for f in (lambda v: filters.lfilter(b, a, v), lambda v: filters.filtfilt(b, a, v), lambda v: filters.resample(v, 64, 24), lambda v: filters.resample(v, 64, 100)):
        assert np.allclose(f(x), np.stack([f(r) for r in x]))
    assert filters.filtfilt(b, a, np.ones((2, 1))).shape == (2, 1) and filters.filtfilt(b, a, np.ones((2, 0))).shape == (2, 0)


def test_filtered_channels_of_mixed_lengths(spark):
    draw, rows = np.random.default_rng(1), []
    series = {(r, c): draw.normal(size=20 + 5 * (r % 3)) for r in range(7) for c in range(2)}
    rows = [(r, c, k, float(v)) for (r, c), x in series.items() for k, v in enumerate(x)]
    b, a = filters.butter_lowpass(2, 0.4)
    got = {}
    for r in signal.iir(spark.createDataFrame(rows, "rec int, ch int, idx int, value double").repartition(5), b.tolist(), a.tolist()).collect():
        got.setdefault((r.rec, r.ch), {})[r.idx] = r.value
    assert set(got) == set(series)
    for k, x in series.items():
        assert [got[k][i] for i in range(len(x))] == pytest.approx(filters.filtfilt(b, a, x).tolist())


def test_steps(spark):
    plan = steps.Steps("s").then("pick", channels=["b", "a"]).then("lowpass", cutoff=4.0, order=2).then("epoch", label="go", start=0.0, end=1.0).then("baseline", start=0.0, end=0.25).then("z_score").then("resample", rate=8.0)
    assert steps.Steps.from_json(plan.to_json()) == plan
    with pytest.raises(ValueError, match="takes"):
        plan.then("lowpass", hertz=3)
    with pytest.raises(ValueError, match="unknown"):
        plan.then("fly")
    x = {c: np.random.default_rng(k).normal(size=64) for k, c in enumerate("abc")}
    s = spark.createDataFrame([(1, c, k, float(v)) for c, y in x.items() for k, v in enumerate(y)], "rec int, ch string, idx int, value double")
    events = spark.createDataFrame([(1, 5, 0.5, "go"), (1, 6, 1.0, "no"), (1, 7, 3.5, "go")], "rec int, event_id long, onset double, trial_type string")
    e, rate = plan.run(s, 16.0, events)
    got = {}
    for r in e.collect():
        got.setdefault((r.epoch, r.label, r.ch), {})[r.idx] = r.value
    assert rate == 8.0 and set(got) == {(5, "go", "a"), (5, "go", "b")}  # the event at 3.5 s has no room
    for c in "ab":
        y = filters.filtfilt(*filters.butter_lowpass(2, 0.5), x[c])[8:24]
        y = y - y[:4].mean()
        y = filters.resample((y - y.mean()) / y.std(), 16.0, 8.0)
        assert [got[5, "go", c][k] for k in range(8)] == pytest.approx(y.tolist())
    whole, _ = steps.Steps().then("average_reference").then("z_score").run(s, 16.0)
    assert whole.where("label != '_whole_' OR epoch != 0").isEmpty() and whole.count() == 192
    assert [(r.label, r.code) for r in steps.classes(e).collect()] == [("go", 0)]
    assert len(steps.features(e).first()["values"]) == 16
    assert [k for k, _ in steps.paradigm("p300").steps] == ["bandpass", "epoch", "epoch"] and steps.paradigm("resting_state").steps[1] == ("resample", {"rate": 128.0})


def test_metadata_kinds(spark):
    d = spark.createDataFrame([('{"A": 3, "B": "x", "C": [1, 2], "D": true, "E": 2.5, "F": null, "odd \' key": 1}',), ("not json",), (None,)], "d string")
    one = lambda c: [r[0] for r in d.select(c).collect()]
    f = lambda k, t: metadata.field(F.col("d"), k, t)
    assert one(f("A", "whole")) == [3, None, None] and one(f("A", "number")) == [3.0, None, None] and one(f("E", "whole")) == [None] * 3
    assert one(f("B", "text")) == ["x", None, None] and one(f("A", "text")) == [None] * 3 and one(f("D", "flag")) == [True, None, None]
    assert one(f("C", "list")) == [["1", "2"], None, None] and one(f("F", "text")) == [None] * 3
    assert one(metadata.numbers(F.col("d"), "C")) == [[1.0, 2.0], [], []] and one(metadata.numbers(F.col("d"), "E")) == [[2.5], [], []]
    assert one(metadata.snake_keys(F.col("d")))[1:] == [None, None]
    v = spark.createDataFrame([("007",), ("x",), (None,), ("True",)], "v string")
    assert [tuple(r) for r in v.select(metadata.coerced(F.col("v"), "whole"), metadata.coerced(F.col("v"), "flag")).collect()] == [(7, False), (0, False), (0, False), (0, True)]
    assert v.select(metadata.padded(F.col("v")).formatted).first()[0] == "007"
    tr = lambda *x: metadata.repetition_time(spark.createDataFrame([("p", "RepetitionTime", t) for t in x], "path string, key string, value string"))
    assert tr("2.0000001", "2").first().tr == 2.0
    for bad in (("2", "3"), ()):
        with pytest.raises(Exception, match="repetition time"):
            tr(*bad).collect()
    assert spark.range(1).select(*metadata.world([[2, 0, 0, -1], [0, 3, 0, 0], [0, 0, 1, 5]], F.lit(1.0), F.lit(2.0), F.lit(3.0))).first() == (1.0, 6.0, 8.0)


def test_validity(spark):
    good = ["sub-01/anat/sub-01_T1w.nii.gz", "/sub-01/ses-a/eeg/sub-01_ses-a_task-x_run-1_eeg.edf", "participants.tsv", "README.md", "task-x_bold.json", "sub-01/sub-01_sessions.tsv", "sub-01/ses-b/sub-01_ses-b_scans.tsv", "dataset_description.json", "CHANGES"]
    bad = ["sub-01/other/sub-01_T1w.nii.gz", "sub-01/anat/T1w.nii.gz", "notes.txt", "sub-01/sub-01_scans.csv", "anat/sub-01_T1w.nii.gz", ""]
    got = {r.p: r.v for r in spark.createDataFrame([(p,) for p in good + bad], "p string").select("p", schema.is_valid(F.col("p")).alias("v")).collect()}
    assert [p for p, v in got.items() if v] == good
    assert schema.entity_pattern("run") and schema.entity_pattern("nothing") is None


def test_names_and_rows(spark):
    assert recordings.expand_wildcards(["a*", "x", "a1", "?2"], ["a1", "a2", "b2"]) == ["a1", "a2", "x", "b2"]
    assert recordings.name_pattern("(", regex=True) is None
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(6)], "k int, g string")
    assert sorted(r.k for r in recordings.select_rows(df, ["k"], [0, 3]).collect()) == [0, 3]
    s = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "ch string, value int")
    types = spark.createDataFrame([("a", "EEG"), ("c", "EOG")], "ch string, type string")
    assert [(r.ch, r.place) for r in recordings.pick_channels(s, names=["c", "zz", "a"]).orderBy("place").collect()] == [("c", 0), ("a", 2)]
    assert [r.ch for r in recordings.pick_channels(s, exclude=["b"], types=["EEG"], channels=types).collect()] == ["a"]
    files = spark.createDataFrame([("/ds/x/a",), ("/ds/b",)], "path string")
    assert recordings.file_at(files, "x/a", "/ds/").count() == recordings.file_at(files, "/ds/b").count() == 1
    nodes = spark.createDataFrame([("2", "10"), ("2", "9"), ("1", "x")], "subject string, run string")
    assert [tuple(r) for r in recordings.node_order(nodes).collect()] == [("1", "x"), ("2", "9"), ("2", "10")]


def test_recordings_that_differ_in_channels_are_an_error(spark):
    parts = spark.createDataFrame([(1, 0, "a", 0, 1.0), (1, 1, "b", 0, 1.0)], "set int, part int, ch string, idx int, value double")
    with pytest.raises(Exception, match="channels differ"):
        recordings.concatenate(parts, ["set"], "part").collect()
    two = spark.createDataFrame([("/a/x", "p"), ("/b/y", "p")], "root string, pipeline string")
    with pytest.raises(Exception, match="two datasets"):
        recordings.derivatives(two).collect()


def test_queries_check_their_entities(spark):
    q = catalog.CatalogQuery.of_paths(spark.createDataFrame([("/ds/sub-01/eeg/sub-01_task-x_eeg.edf",)], "path string"))
    assert q.any("taks").checked("drop").paths().count() == 1 and q.any("taks").checked("allow").paths().count() == 0
    with pytest.raises(ValueError, match="did you mean task"):
        q.any("taks").checked()
    assert q.task("x").checked().count().first().n == 1 and q.space("y").paths().isEmpty()


def test_benchmark_tables(spark, tmp_path):
    rows = [("d", "1", None, "p", "x", "cv", 0.5, "accuracy", 1.5, 10, 5, 3, 2, 0, 'a, "quoted"\nnote'), ("d", "2", "s", "p", "x", "cv", 0.75, "auc", 0.0, 1, 2, 3, 2, 1, "")]
    df = spark.createDataFrame(rows, datasets.BENCHMARK)
    for form in ("csv", "parquet"):
        datasets.write_results(df, f"{tmp_path}/{form}", form=form)
        datasets.write_results(df, f"{tmp_path}/{form}", form=form)
        got = datasets.read_results(spark, f"{tmp_path}/{form}", form=form)
        assert got.count() == 4 and {r.notes for r in got.collect() if r.notes} == {'a, "quoted"\nnote'}
    assert datasets.mean_scores(df, ["pipeline"], "score").first().mean_score == 0.625


def test_rates_and_models(spark):
    rates = spark.createDataFrame([(10.0, 2.0), (50.0, 2.0), (5.0, None)], "rate double, tr double")
    assert [variables.sampling_rate(rates, x) for x in (7, "highest", "TR", None)] == [7.0, 50.0, 0.5, 0.5]
    with pytest.raises(ValueError, match="no single rate"):
        variables.sampling_rate(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "rate double, tr double"), "TR")
    spec = {"Nodes": [{"Name": n, "GroupBy": ["g"], "Transformations": [{"Name": "Scale", "Input": "x", "Rescale": False}] if n == "a" else [], "Model": {"X": ["x"]}} for n in "abc"], "Edges": [{"Source": "a", "Destination": "c"}, {"Source": "b", "Destination": "c", "Filter": {"g": [1]}}]}
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (3, 2, 10.0)], "k int, g int, x double")
    out = models.Graph.from_json(spec).run(df, ["k"])
    assert sorted((r.k, r.x) for r in out["a"].collect()) == [(1, -1.0), (2, 1.0), (3, 0.0)]
    assert sorted((r.k, r.x) for r in out["c"].collect()) == [(1, -1.0), (1, 2.0), (2, 1.0), (2, 4.0), (3, 0.0)]
    design, settings = models.glm_spec(df, ["x", "y"], ["k"], {"Type": "Meta", "Link": "log"})
    assert design.columns == ["k", "x", "y"] and settings == {"kind": "meta", "family": "gaussian", "link": "log", "formula": None}
    events = spark.createDataFrame([("t", "b"), ("t", "a")], "task string, trial_type string")
    files = spark.createDataFrame([("t", "1", "1", "1"), ("t", "1", "2", "1")], "task string, run string, session string, subject string")
    model = models.auto_models(events, files).first().model
    assert '"X":["trial_type.a","trial_type.b"]' in model and "Session" in model and "Dataset" not in model


def test_phrases(spark):
    full = '{"RepetitionTime": 2, "EchoTime": [0.012, 0.0305], "FlipAngle": 90, "SliceTiming": [0.3, 0.2, 0.1], "MultibandAccelerationFactor": 4, "ParallelReductionFactorInPlane": 2.5, "AcquisitionMatrixPE": [64, 64], "bValues": [0, 1000], "PhaseEncodingDirection": "j-", "IntendedFor": ["a", "b"]}'
    d = spark.createDataFrame([(full,), ("{}",), ('{"EchoTime": 0.03, "SliceTiming": [0, 0.5, 0.1], "PhaseEncodingDirection": "odd", "IntendedFor": "x"}',)], "d string")
    c = F.col("d")
    names = [phrases.repetition_time, phrases.echo_times, phrases.flip_angle, phrases.slice_timing, phrases.multiband, phrases.in_plane, phrases.matrix, phrases.b_values, phrases.encoding_direction, phrases.intended_targets]
    got = [tuple(r) for r in d.select(*[f(c).alias(f.__name__) for f in names]).collect()]
    assert got[0] == ("2.00 s", "12.0/30.5 ms", "90°", "sequential descending", "4", "2.5", "64×64", "0, 1000", "anterior-posterior", "a, b")
    assert got[1] == ("unknown", "unknown", "unknown", "unknown", "n/a", "none", "unknown", "unknown", "unknown", "none")
    assert got[2][1] == "30.0 ms" and got[2][3] == "interleaved" and got[2][8:] == ("odd", "x")
    t = spark.createDataFrame([(150, 2.0), (10, 3.0), (None, 2.0), (151, 2.01)], "n int, tr double")
    assert [r[0] for r in t.select(phrases.duration(F.col("n"), F.col("tr"))).collect()] == ["5:00.00", "30.0 s", "unknown", "5:03.51"]


def test_files_are_written_and_copied(spark, tmp_path):
    from tessera.sources import files

    path = f"{tmp_path}/a/x.tar.gz"
    assert files.write_file(spark, path, b"1") == path and files.write_file(spark, path, b"2", "skip") is None
    with pytest.raises(FileExistsError):
        files.write_file(spark, path, b"2")
    assert files.write_file(spark, path, b"2", "number") == f"{tmp_path}/a/x_1.tar.gz" and files.write_file(spark, path, b"3", "number") == f"{tmp_path}/a/x_2.tar.gz"
    files.write_file(spark, path, b"44", "overwrite")
    pairs = files.copies_to(spark.createDataFrame([(path, "01"), (path, None)], "path string, subject string"), {"subject": F.col("subject")}, f"{tmp_path}/out/sub-{{subject}}/x.gz")
    assert [(r.dst, r.bytes) for r in files.copy_files(pairs).collect()] == [(f"{tmp_path}/out/sub-01/x.gz", 2)]
    assert (tmp_path / "out/sub-01/x.gz").read_bytes() == b"44"


def test_events_groups_and_rates(spark):
    cells = spark.createDataFrame([("p", 0, "onset", "1.5"), ("p", 0, "rt", "0.2"), ("p", 1, "onset", "x"), ("p", 1, "rt", "1"), ("p", 2, "onset", "3"), ("p", 2, "duration", "2"), ("p", 2, "kind", "go")], "path string, row int, name string, value string")
    assert sorted((r.row, r.onset, r.duration, r.name, r.value) for r in variables.event_rows(cells).collect()) == [(0, 1.5, 0.0, "rt", "0.2"), (2, 3.0, 2.0, "kind", "go")]
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "g string, v int")
    assert sorted((r.g, r.v) for r in variables.apply_groups(df, ["g"], "v", lambda x: x - x.mean()).collect()) == [("a", -1.0), ("a", 1.0), ("b", 0.0)]
    s = spark.createDataFrame([(r, "c", k, float(k)) for r in (1, 2) for k in range(8)], "rec int, ch string, idx int, value double")
    out = recordings.harmonised_rates(s, spark.createDataFrame([(1, 4.0), (2, 8.0)], "rec int, rate double"), 8.0, ["rec", "ch"])
    assert {r.rec: r["count"] for r in out.groupBy("rec").count().collect()} == {1: 16, 2: 8}
    assert spark.range(1).select(recordings.voxel_place((2, 3, 4), F.lit(1), F.lit(2), F.lit(3)), recordings.voxel_place((2, 3, 4), F.lit(2), F.lit(0), F.lit(0))).first() == (23, None)
    w = datasets.window_samples(spark.createDataFrame([(1, 10.0)], "k int, d double"), "d", 4.0, 3.0, label=F.col("k") + 1, seed=3)
    assert [(r.sample, r.label) for r in w.orderBy("sample").collect()] == [(0, 2), (1, 2), (2, 2)] and w.select("place").distinct().count() == 3


def test_descriptions_are_checked(spark, tmp_path):
    from tessera.sources import text

    (tmp_path / "d.json").write_text('{"Name": " ", "DatasetType": "derivative"}')
    assert sorted(r.field for r in text.description_issues(text.read_description(spark, str(tmp_path / "d.json"))).collect()) == ["BIDSVersion", "GeneratedBy", "Name"]
    (tmp_path / "e.json").write_text('{"Name": "x", "BIDSVersion": "1.8.0"}')
    assert text.description_issues(text.read_description(spark, str(tmp_path / "e.json"))).isEmpty()
