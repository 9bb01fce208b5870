"""Readers against files written here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.sources import recordings, text


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    recordings.register(spark)


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.channel, r.start)):
        out.setdefault(r.label, []).extend(r["values"])
    return out


@pytest.mark.parametrize("bdf", [False, True])
def test_edf_round_trip(spark, tmp_path, monkeypatch, bdf):
    draw = np.random.default_rng(1)
    x = draw.uniform(-3000, 3000, (4, 16 * 32))
    path = tmp_path / ("a.bdf" if bdf else "a.edf")
    path.write_bytes(recordings.edf_bytes(["Fp1", "Fp2", "Cz", "Oz"], x, 32, bdf=bdf))
    got = joined(spark.read.format("edf").option("path", str(path)).load().collect())
    assert list(got) == ["Fp1", "Fp2", "Cz", "Oz"]
    for k, n in enumerate(got):
        assert np.allclose(got[n], x[k], atol=0.06)
    part = joined(spark.read.format("edf").option("path", str(path)).option("channels", "Cz,Oz").option("exclude", "Oz").option("start", 2.5).option("end", 4.25).load().collect())
    assert list(part) == ["Cz"] and np.allclose(part["Cz"], x[2, 80:136], atol=0.06)


def test_annotation_lists():
    data = b"+0\x14\x14\x00+1.5\x152\x14eyes closed\x14\x00+3\x14a\x14b\x14\x00\x00"
    assert recordings.annotation_lists(data) == [(1.5, 2.0, "eyes closed"), (3.0, 0.0, "a"), (3.0, 0.0, "b")]


def test_brainvision(spark, tmp_path):
    x = np.arange(60, dtype="<i2").reshape(20, 3)
    (tmp_path / "r.eeg").write_bytes(x.tobytes())
    (tmp_path / "r.vhdr").write_text("Header\n[Common Infos]\nDataFile=r.eeg\nDataOrientation=MULTIPLEXED\nSamplingInterval=2000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=A,,0.5,uV\nCh2=B,,1,uV\nCh3=C\\1D,,,uV\n")
    got = joined(spark.read.format("brainvision").option("path", str(tmp_path / "r.vhdr")).load().collect())
    assert got == {"A": (x[:, 0] * 0.5).tolist(), "B": x[:, 1].tolist(), "C,D": x[:, 2].tolist()}
    cut = spark.read.format("brainvision").option("path", str(tmp_path / "r.vhdr")).option("channels", "B").option("start", 0.01).option("end", 0.02).load().collect()
    assert joined(cut) == {"B": x[5:10, 1].tolist()}


def nifti(shape, data, slope=2.0, inter=1.0):
    h = bytearray(352)
    h[:4] = struct.pack("<i", 348)
    h[40:56] = struct.pack("<8h", len(shape), *shape, *[1] * (7 - len(shape)))
    h[70:74] = struct.pack("<2h", 4, 16)
    h[76:108] = struct.pack("<8f", 1, 2, 3, 4, 1.5, 0, 0, 0)
    h[108:120] = struct.pack("<3f", 352, slope, inter)
    return bytes(h) + data.astype("<i2").tobytes()


@pytest.mark.parametrize("ending", [".nii", ".nii.gz"])
def test_nifti(spark, tmp_path, ending):
    import gzip

    data = np.arange(2 * 3 * 4 * 5)
    raw = nifti((2, 3, 4, 5), data)
    path = tmp_path / f"v{ending}"
    path.write_bytes(gzip.compress(raw) if ending.endswith("gz") else raw)
    h = recordings.nifti_header(raw)
    assert h["shape"] == [2, 3, 4, 5] and h["zooms"][:4] == [2, 3, 4, 1.5] and h["affine"][1][1] == 3
    rows = {r.t: r.voxels for r in spark.read.format("nifti").option("path", str(path)).load().collect()}
    assert sorted(rows) == list(range(5)) and rows[3] == (data[72:96] * 2.0 + 1).tolist()
    assert [r.t for r in spark.read.format("nifti").option("path", str(path)).option("volume", 2).load().collect()] == [2]


def test_tables(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("onset\tduration\ttrial_type\tresponse\n1.0\tn/a\tgo\t 0.3\nn/a\t1\tstop\tx\n2.5\t0.5\tn/a\tn/a\n")
    rows = text.read_events(spark, str(tmp_path / "e.tsv")).orderBy("onset").collect()
    assert [(r.onset, r.duration, r.trial_type, r.extra) for r in rows] == [(1.0, 0.0, "go", {"response": "0.3"}), (2.5, 0.5, None, {})]
    out = str(tmp_path / "out")
    text.write_tsv(text.read_tsv(spark, str(tmp_path / "e.tsv")), out)
    assert text.read_tsv(spark, out).count() == 3
    (tmp_path / "p.tsv").write_text("1\t2\n3\tx\n")
    assert [(r.row, r.a, r.b) for r in text.read_headerless_tsv(spark, str(tmp_path / "p.tsv"), ["a", "b"]).orderBy("row").collect()] == [(0, 1.0, 2.0), (1, 3.0, None)]
    (tmp_path / "c.tsv").write_text("name\ttype\nA\teeg\nB\tn/a\n")
    assert [(r.name, r.type, r.units) for r in text.read_channels(spark, str(tmp_path / "c.tsv")).orderBy("name").collect()] == [("A", "EEG", "n/a"), ("B", "MISC", "n/a")]


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"SamplingFrequency": 256, "Ref": "Cz", "none": null}')
    (tmp_path / "bad.json").write_text("{")
    tags = text.sidecar_tags(text.read_sidecars(spark, str(tmp_path)))
    assert sorted((r.key, r.value) for r in tags.collect()) == [("Ref", "Cz"), ("SamplingFrequency", "256")]


def test_gradients_markers_and_shapes(spark):
    df = spark.createDataFrame([("0 1000\n", "0 1\n0 0\n0 0\n")], "v string, d string")
    r = df.select(text.gradients(F.col("v"), F.col("d")).alias("g")).select("g", *text.gradient_summary(F.col("g"))).first()
    assert (r.n_volumes, r.n_b0, r.n_diffusion, r.unit_vectors) == (2, 1, 1, True)
    lines = spark.createDataFrame([("Mk1=New Segment,,1,1,0",), ("Mk2=Stimulus,S 1,101,50,0",), ("; x",), ("Mk3=Odd,T,11,1,0",)], "value string")
    got = [(r.onset, r.duration, r.description) for r in text.markers(lines, 100.0).orderBy("onset").collect()]
    assert got == [(0.0, 0.0, "New Segment"), (0.1, 0.0, "Odd/T"), (1.0, 0.5, "S 1")]
    shapes = spark.createDataFrame([("% c",), ("nasion 1 2 3",), ("1 2 3",), ("EEG1 0 0 1",)], "value string")
    assert sorted(r.kind for r in text.head_shape(shapes).collect()) == ["eeg", "extra", "fiducial"]


def test_scan_save_load(spark, tmp_path):
    root = tmp_path / "ds"
    root.mkdir()
    with pytest.raises(ValueError, match="isn't a dataset"):
        (root / "README").write_text("x")
        store.scan(spark, str(root))
    (root / "README").unlink()
    (root / "dataset_description.json").write_text("{}")
    for p in ("derivatives/prep/sub-01/eeg/sub-01_eeg.edf", "sub-01/eeg/sub-01_task-rest_eeg.edf", "sub-02/eeg/sub-02_task-rest_eeg.edf", "sub-01/eeg/x.zarr/0/0", "code/run.py", "sub-01/eeg/.hidden"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x" * 10)
    found = store.scan(spark, str(root))
    assert sorted(r.path.removeprefix(str(root)) for r in found.collect()) == ["/dataset_description.json", "/sub-01/eeg/sub-01_task-rest_eeg.edf", "/sub-01/eeg/x.zarr", "/sub-02/eeg/sub-02_task-rest_eeg.edf"]
    store.save(found, str(tmp_path / "index"))
    q = store.load(spark, str(tmp_path / "index"))
    assert [r.path[-24:] for r in q.subject("02").suffix("eeg").extension("edf").paths().collect()] == ["/sub-02_task-rest_eeg.edf"[-24:]]
    assert not store.is_stale(spark.read.parquet(str(tmp_path / "index/files")), store.scan(spark, str(root)))
    (root / "new.json").write_text("{}")
    assert store.is_stale(spark.read.parquet(str(tmp_path / "index/files")), store.scan(spark, str(root)))


def test_variables_of_tables_with_different_headers(spark, tmp_path):
    files = {"participants.tsv": "participant_id\tage\tsex\nsub-01\t30\tn/a\nsub-02\t\tF\n", "sub-01/sub-01_sessions.tsv": "session_id\tmood\r\nses-1\tgood\r\n", "sub-01/ses-1/eeg/sub-01_ses-1_events.tsv": "onset\tduration\ttrial_type\n1.5\t0\tgo\n", "sub-01/ses-1/eeg/sub-01_ses-1_channels.tsv": "name\nCz\n"}
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = sorted((r.kind, r.level, r.row, r.name, r.value) for r in text.load_variables(spark, str(tmp_path)).collect())
    assert got == sorted([("participants", "dataset", 0, "participant_id", "sub-01"), ("participants", "dataset", 0, "age", "30"), ("participants", "dataset", 1, "participant_id", "sub-02"), ("participants", "dataset", 1, "sex", "F"), ("sessions", "subject", 0, "session_id", "ses-1"), ("sessions", "subject", 0, "mood", "good"), ("events", "run", 0, "onset", "1.5"), ("events", "run", 0, "duration", "0"), ("events", "run", 0, "trial_type", "go")])
    assert {r.kind for r in text.load_variables(spark, str(tmp_path), level="run").collect()} == {"events"}
    assert text.load_variables(spark, str(tmp_path), kinds=["regressors"]).isEmpty()
    (tmp_path / "sub-01_aslcontext.tsv").write_text("volume_type\ncontrol\nlabel\n")
    assert [(r.volume, r.volume_type) for r in text.read_asl_context(spark, str(tmp_path / "sub-01_aslcontext.tsv")).orderBy("volume").collect()] == [(0, "control"), (1, "label")]
    (tmp_path / "c.json").write_text('{"EEGCoordinateSystem": "CapTrak", "FiducialsCoordinates": {"NAS": [1, 2.5, 3]}}')
    c = text.read_coordsystem(spark, str(tmp_path / "c.json")).first()
    assert c.EEGCoordinateSystem == "CapTrak" and c.FiducialsCoordinates == {"NAS": [1.0, 2.5, 3.0]} and c.IntendedFor is None
    text.write_manifest(spark.createDataFrame([("a,b", 'q"x')], "path string, note string"), str(tmp_path / "m"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "m")).first() == ("a,b", 'q"x')
