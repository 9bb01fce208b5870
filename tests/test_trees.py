"""Validation, nodes, mixed collections and models of several levels against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.operators import models, nodes, signal, store, validation, variables
from tessera.operators.collections import Collection


def test_rules_on_small_datasets(spark):
    files = {
        "good": ["README.md", "dataset_description.json", "sub-01/anat/sub-01_T1w.nii.gz", "participants.json"],
        "odd": ["dataset_description.json", "sub-01/ses-1/eeg/sub-01_ses-2_task-x_eeg.edf", "sub-01/eeg/sub-02_task-x_eeg.edf", "sub-01/eeg/.hidden", "sub-01/eeg/any.json", "sub-01/eeg/wrong.txt"],
        "bare": ["notes.txt"],
        "list": ["README", "dataset_description.json", "sub-1/anat/sub-1_T1w.nii"],
    }
    contents = [("good", "dataset_description.json", '{"Name": "a", "BIDSVersion": "1.8"}'), ("good", "participants.json", "{}"), ("odd", "dataset_description.json", '{"Name": " ", "BIDSVersion": 2}'), ("odd", "sub-01/eeg/any.json", "{"), ("list", "dataset_description.json", "[]")]
    f = spark.createDataFrame([(d, p) for d, ps in files.items() for p in ps], "dataset string, path string")
    c = spark.createDataFrame(contents, "dataset string, path string, text string")
    found = validation.issues(f, c)
    got = sorted((r.dataset, r.code, r.path or "") for r in found.collect())
    assert got == sorted([
        ("odd", "MISSING_NAME", "dataset_description.json"), ("odd", "MISSING_README", ""), ("odd", "INVALID_JSON", "sub-01/eeg/any.json"), ("odd", "SESSION_MISMATCH", "sub-01/ses-1/eeg/sub-01_ses-2_task-x_eeg.edf"),
        ("odd", "SUBJECT_MISMATCH", "sub-01/eeg/sub-02_task-x_eeg.edf"), ("odd", "INVALID_FILENAME", "sub-01/eeg/wrong.txt"), ("bare", "MISSING_DATASET_DESCRIPTION", ""), ("bare", "MISSING_README", ""), ("bare", "NO_SUBJECTS", ""),
        ("list", "INVALID_DATASET_DESCRIPTION", "dataset_description.json"),
    ])
    assert {r.dataset: (r.errors, r.warnings, r.valid) for r in validation.counts(f, found).collect()} == {"good": (0, 0, True), "odd": (4, 2, False), "bare": (2, 1, False), "list": (1, 0, False)}
    assert {(r.code, r.n, r.datasets) for r in validation.by_code(found).collect()} >= {("MISSING_README", 2, 2), ("INVALID_JSON", 1, 1)}
    own = validation.Rule("TEXT", "warning", "text files don't belong here", "file", "file LIKE '%.txt'")
    assert sorted(r.path for r in validation.issues(f, c, (own,)).collect()) == ["notes.txt", "sub-01/eeg/wrong.txt"]
    assert validation.issues(f.limit(0), c.limit(0)).isEmpty()


def test_scan_validates_paths(spark, tmp_path):
    for p in ("dataset_description.json", "sub-01/eeg/sub-01_task-x_eeg.edf", "sub-01/eeg/wrong.txt", "extra/keep.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    short = lambda **o: sorted(r.path.rpartition("/")[2] for r in store.scan(spark, str(tmp_path), **o).collect())
    assert short() == ["dataset_description.json", "keep.txt", "sub-01_task-x_eeg.edf", "wrong.txt"]
    assert short(validate=True) == ["dataset_description.json", "sub-01_task-x_eeg.edf"]
    assert short(validate=True, force=["/extra/"]) == ["dataset_description.json", "keep.txt", "sub-01_task-x_eeg.edf"]


ENTITIES = nodes.ENTITIES


@pytest.fixture(scope="module")
def wide(spark):
    rows = [("01", "1", "rest", "1"), ("01", "1", "rest", "2"), ("01", "2", "rest", None), ("01", None, "go", "1"), ("02", None, "rest", None), ("02", None, None, None), ("03", "1", None, None), ("0", "11", "x", "1"), ("01", "1", "rest", "1"), (None, None, None, None)]
    return spark.createDataFrame([(*r, f"/{k}") for k, r in enumerate(rows)], "subject string, session string, task string, run string, path string")


def test_nodes_and_searches(spark, wide):
    tree = nodes.nodes(wide)
    rows = [tuple(r) for r in tree.select("level", *ENTITIES, "n_files", "image").collect()]
    assert len(rows) == len({r[:5] for r in rows}) == 1 + 4 + 4 + 6
    assert ("run", "01", "1", "rest", "1", 2, "/0") in rows and ("dataset", None, None, None, None, 10, None) in rows and ("session", "0", "11", None, None, 1, None) in rows
    values = [(None, "01", "02", "99"), (None, "1", "2"), (None, "rest", "go"), (None, "1")]
    searches = [(k, *v) for k, v in enumerate(itertools.product(*values))]
    wanted = spark.createDataFrame(searches, "id int, subject string, session string, task string, run string").repartition(3)
    fits = lambda s, n: all(a is None or b is None or a == b for a, b in zip(s[1:], n[1:5], strict=True))
    for level in (None, "run", "subject"):
        want = set()
        for s in searches:
            found = sorted((n for n in rows if fits(s, n) and level in (None, n[0])), key=lambda n: ([(x is not None, x or "") for x in n[1:5]], n[0]))
            want |= {(s[0], k, *n) for k, n in enumerate(found, 1)}
        assert {tuple(r) for r in nodes.find_nodes(wanted, tree, level=level).collect()} == want
    depth = list(nodes.LEVELS)
    for at_most in ("run", "session", "dataset"):
        got = {r.id: tuple(r)[1:] for r in nodes.nearest_node(wanted, tree, at_most=at_most).collect()}
        for s in searches:
            named = lambda n: all(b is None or a == b for a, b in zip(s[1:], n[1:5], strict=True)) and depth.index(n[0]) <= depth.index(at_most)
            best = max((n for n in rows if named(n)), key=lambda n: (depth.index(n[0]), sum(x is not None for x in n[1:5]), n[2] is not None))
            assert got[s[0]] == best[:5], s
    assert nodes.nearest_node(wanted, tree.limit(0)).where("level IS NOT NULL").isEmpty()


def test_broad_searches_for_the_same_are_answered_once(spark):
    rows = [("run", f"{s:03}", v, t, r, 1, f"{s}{v}{t}{r}") for s in (*range(8), 123, 124, 999) for v in (None, "1", "2") for t in "ab" for r in (None, "01")] + [("run", None, None, "a", None, 3, "x"), ("run", "", "1", "b", None, 2, "y")]
    tree = spark.createDataFrame(rows, "level string, subject string, session string, task string, run string, n_files long, image string")
    #: Many ids for few searches; an id in several rows is one search of all of them.
    searches = [(k, None, None, (None, "a")[k % 2], None) for k in range(20)] + [(k, "123", (None, "1")[k % 2], None, "01") for k in range(20, 30)] + [(0, None, None, None, None), (21, "002", None, "b", None), (None, "005", None, None, None)]
    wanted = spark.createDataFrame(searches, "id long, subject string, session string, task string, run string")
    out = nodes.find_nodes(wanted, tree, level="run")
    assert "windowspecdefinition(id#" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append((r["rank"], r.image))
    fits = lambda q, n: all(a is None or b is None or a == b for a, b in zip(q, n, strict=True))
    place = lambda n: [(x is not None, x or "") for x in n[1:5]]
    for i in {q[0] for q in searches}:
        found = sorted((n for q in searches if q[0] == i for n in rows if fits(q[1:], n[1:5])), key=place)
        assert sorted(got[i]) == [(k, n[6]) for k, n in enumerate(found, 1)]


def test_planner_follows_kinds(spark):
    sparse = spark.createDataFrame([(1, 0.0, 0.5, 7, 2.0, 3.0)], "run int, onset double, duration double, event_id int, a double, b double")
    dense = spark.createDataFrame([(1, k, float(k)) for k in range(4)], "run int, bin long, w double")
    c = Collection(["run"], sparse, dense, 2.0)
    steps = [{"Name": "Copy", "Input": ["a"], "Output": ["c"]}, {"Name": "Product", "Input": ["c", "w"], "Output": "cw"}, {"Name": "Sum", "Input": ["a", "b"], "Output": "ab"}, {"Name": "Resample", "SamplingRate": 4}, {"Name": "ToDense", "Input": ["ab"]}]
    kinds = [(k, d if k != "convert" else d[0]) for k, d in c.plan(steps)]
    assert kinds == [("sparse", steps[0]), ("convert", ["c"]), ("dense", steps[1]), ("sparse", steps[2]), ("resample", 4.0), ("convert", ["ab"])]
    out = c.run(steps)
    assert out.kinds() == {"a": "sparse", "b": "sparse", "w": "dense", "c": "dense", "cw": "dense", "ab": "dense"} and out.rate == 4.0
    rows = out.dense.orderBy("bin").collect()
    assert [r.bin for r in rows] == list(range(8)) and [r.ab for r in rows] == [5.0, 5.0] + [0.0] * 6
    assert [r.w for r in rows] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0] and [r.c for r in rows][:3] == [2.0, 1.0, 0.0]
    with pytest.raises(ValueError, match="unknown variables"):
        c.run([{"Name": "Scale", "Input": ["nope"]}])
    with pytest.raises(ValueError, match="resample first"):
        c.run([{"Name": "ToDense", "Input": ["a"], "SamplingRate": 8}])
    with pytest.raises(ValueError, match="sparse and dense"):
        Collection(["run"], sparse, dense.withColumnRenamed("w", "a"), 2.0).kinds()
    with pytest.raises(ValueError, match="whole number"):
        Collection(["run"], sparse).run([{"Name": "ToDense"}])
    assert Collection(["run"], sparse).run([{"Name": "ToDense", "SamplingRate": 2}]).dense.columns == ["run", "bin", "a", "b"]


def _leaves(df):
    """The tables that a plan reads, as often as it reads them."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_conversions_read_each_table_once(spark):
    events = [(1, 2.0, 1.0, 7, 2.0, None), (1, 2.0, 0.5, 8, 3.0, 1.0), (1, 3.0, 0.0, 9, None, 5.0), (2, -4.0, 1.0, 1, 1.0, 1.0), (None, 1.0, 0.5, 2, 9.0, 9.0), (3, 0.0, float("nan"), 3, 1.0, 1.0)]
    sparse = spark.createDataFrame(events, "run int, onset double, duration double, event_id int, a double, b double")
    dense = spark.createDataFrame([(1, k, float(k)) for k in range(4)] + [(3, 2, 5.0)], "run int, bin long, w double")
    c = Collection(["run"], sparse.selectExpr("*", "a as a0", "a as a1"), dense, 2.0)
    out = c.run([{"Name": "ToDense", "Input": [x]} for x in ("a", "b", "a0", "a1")])
    assert _leaves(out.table()) <= 1 + 4
    got = {(r.run, r.bin): (r.w, r.a, r.b) for r in out.dense.collect()}
    zero = (0.0, 0.0, 0.0)
    one = {(1, k): (float(k), 0.0, 0.0) for k in range(4)} | {(1, 4): (0.0, 3.0, 1.0), (1, 5): (0.0, 2.0, 0.0), (1, 6): (0.0, 0.0, 5.0)}
    assert got == one | {(3, 0): zero, (3, 1): zero, (3, 2): (5.0, 0.0, 0.0)} | {(None, k): zero for k in range(3)}
    filled = spark.createDataFrame([(*k, *v) for k, v in got.items() if k[0]], "run int, bin long, w double, a double, b double")
    for rate in (3.0, 7.3, 1.5):
        rows = Collection(["run"], None, filled, 2.0).resampled(rate).dense.orderBy("bin").collect()
        for run, n in ((1, 7), (3, 3)):
            mine = [r for r in rows if r.run == run]
            assert [r.bin for r in mine] == list(range(len(mine)))
            for i, v in enumerate("wab"):
                assert [r[v] for r in mine] == pytest.approx(filters.resample([got[run, k][i] for k in range(n)], 2.0, rate).tolist())
    assert _leaves(out.resampled(3.0).table()) <= 1 + 4


def test_models_of_collections_read_each_table_once(spark):
    sparse = spark.createDataFrame([(1, 1, 0.0, 0.5, 7, 2.0, 3.0), (1, 2, 1.0, 0.5, 8, 4.0, 1.0)], "subject int, run int, onset double, duration double, event_id int, a double, b double")
    dense = spark.createDataFrame([(1, r, k, float(k)) for r in (1, 2) for k in range(2)], "subject int, run int, bin long, w double")
    people = spark.createDataFrame([(1, 30.0)], "subject int, age double")
    spec = {
        "Nodes": [
            {"Name": "runs", "Level": "Run", "GroupBy": ["subject", "run"], "Transformations": {"Instructions": [{"Name": "ToDense", "Input": ["a"]}, {"Name": "Sum", "Input": ["b", "w"], "Output": "s"}, {"Name": "Resample", "SamplingRate": 4}]}, "Model": {"X": [1, "a", "s"]}, "Contrasts": [{"Name": "gap", "ConditionList": ["a", "s"], "Weights": [1, -1]}]},
            {"Name": "people", "Level": "Subject", "GroupBy": ["subject"], "Model": {"X": ["gap", "age"]}},
        ]
    }
    out = models.Graph.from_json(spec).run({"run": Collection(["subject", "run"], sparse, dense, 2.0), "subject": people}, ["subject", "run", "bin"])["people"]
    #: The dense variables, the sparse ones for each of two conversions, the people.
    assert _leaves(out) <= 4
    got = {(r.run, r.bin): (r.gap, r.age) for r in out.collect()}
    one = {(1, 0): 2.0 - 3.0, (1, 1): 1.0 - 2.0, (1, 2): -1.0, (1, 3): -1.0}
    two = {(2, 0): 0.0, (2, 1): -0.5, (2, 2): -1.0, (2, 3): 2.0 - 1.0 / 2 - 0.5, (2, 4): 4.0 - 1.0, (2, 5): 4.0 - 1.0}
    assert got == {k: (v, 30.0) for k, v in (one | two).items()}


def test_instructions_that_look_at_other_rows_need_keys(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "s int, k int, x double")
    for name, more in (("Lag", {"n": 1}), ("Convolve", {"Kernel": [1.0, 0.5]})):
        with pytest.raises(ValueError, match="name the keys"):
            variables.transform(df, [{"Name": name, "Input": ["x"], **more}], ["k"])
        assert variables.transform(df, [{"Name": name, "Input": ["x"], **more}], ["k"], ["s"]).count() == 2


def test_levels_read_their_own_variables(spark):
    runs = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 6.0)], "subject string, run int, x double")
    people = spark.createDataFrame([("a", 30.0), ("b", 40.0)], "subject string, age double")
    spec = {"Nodes": [{"Name": "r", "Level": "Run", "GroupBy": ["subject", "run"], "Model": {"X": [1, "x"]}}, {"Name": "s", "Level": "Subject", "GroupBy": ["subject"], "Model": {"X": ["x", "age"]}}]}
    out = models.Graph.from_json(spec).run({"run": runs, "subject": people}, ["subject", "run"])
    assert sorted(map(tuple, out["s"].select("subject", "run", "x", "age").collect())) == [("a", 1, 2.0, 30.0), ("a", 2, 4.0, 30.0), ("b", 1, 6.0, 40.0)]
    with pytest.raises(ValueError, match="no variables of level run"):
        models.Graph.from_json(spec).run({"subject": people}, ["subject", "run"])


def test_spatial_patterns_match_a_plain_solver(spark):
    draw = np.random.default_rng(2)
    mix = draw.normal(size=(2, 4, 4))
    epochs = {(g, e): mix[g] @ draw.normal(size=(4, 50)) for g in range(2) for e in range(6)}
    s = spark.createDataFrame([(g, 10 * g + e, c, k, float(v)) for (g, e), x in epochs.items() for c in range(4) for k, v in enumerate(x[c])], "grp int, rec int, ch int, idx int, value double")
    names, w = signal.csp_fit(s, 1)
    mean = [np.mean([np.cov(epochs[g, e]) / np.trace(np.cov(epochs[g, e])) for e in range(6)], axis=0) for g in range(2)]
    values, vectors = np.linalg.eig(np.linalg.solve(mean[0] + mean[1], mean[0]))
    order = np.argsort(-values.real)
    want = vectors.real[:, order[[0, -1]]]
    want = want / np.sqrt(np.einsum("ij,ik,kj->j", want, mean[0] + mean[1], want))
    assert names == [0, 1, 2, 3] and all(np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8) for a, b in zip(w, want.T, strict=True))
    got = {(r.rec, r.component): r.feature for r in signal.csp_transform(s, names, w).collect()}
    assert all(got[10 * g + e, k] == pytest.approx(np.log(np.var(want[:, k] @ x, ddof=1))) for (g, e), x in epochs.items() for k in range(2))


@pytest.mark.parametrize("derivatives", [False, True])
def test_tags_in_one_pass_are_those_of_each_pattern(spark, derivatives):
    from tessera.functions import paths

    draw = np.random.default_rng(5)
    bits = ["sub-01", "ses-a+", "task-rest", "run-", "run-1a", "run-02", "run-x", "echo-3", "mt-on", "mt-online", "mt-off", "part-mag", "part-magx", "rec-1", "recording-2", "acq-x-y", "dir-AP", "chunk-07", "bold", "desc-x", "hemi-L", "x", "ce-", "T1w.nii.gz", "scans.tsv", "phasediff.nii", "eeg", "func", "-", "."]
    rows = [("".join(str(draw.choice(bits)) + str(draw.choice(["_", "/", "\\", "", "__", "//", "."])) for _ in range(draw.integers(1, 9))),) for _ in range(1500)] + [("",), (None,), ("/",)]
    df = spark.createDataFrame(rows, "path string")
    want = df.select("path", F.explode(F.array(*[F.struct(F.lit(n).alias("entity"), c.alias("value")) for n, c in paths.entities(F.col("path"), derivatives=derivatives).items()])).alias("t")).select("path", "t.*").where("value IS NOT NULL")
    got = df.select("path", F.explode(paths.tags(F.col("path"), derivatives=derivatives)).alias("t")).select("path", "t.*")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
