"""Binary formats against files written here, and what damaged ones give."""

import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.sources import files, headers, images, matlab, recordings, text


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    recordings.register(spark)
    images.register(spark)


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.channel, r.start)):
        out.setdefault(r.label, []).extend(r["values"])
    return out


def put(folder, made):
    for n, data in made.items():
        (folder / n).write_bytes(data)


X = np.random.default_rng(3).normal(size=(5, 700)).astype("f4")
NAMES = ["Fz", "Cz", "Pz", "O1", "O,2"]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("deflated", [False, True])
def test_elements_of_every_kind(tmp_path, order, deflated):
    values = {"x": np.arange(12.0).reshape(3, 4), "small": np.array([[7]], "u1"), "name": "héllo", "s": [{"a": "p", "b": np.eye(2)}, {"a": "", "b": np.zeros((1, 1))}], "cells": ["a", np.ones((1, 3), "i4")]}
    (tmp_path / "a.mat").write_bytes(matlab.mat_bytes(values, deflated=deflated, order=order))
    with open(tmp_path / "a.mat", "rb") as f:
        got = matlab.variables(f)
    assert list(got) == list(values) and got["name"] == "héllo" and got["small"].tolist() == [[7]]
    assert got["x"].tolist() == values["x"].tolist() and got["s"][0]["a"] == "p" and got["s"][0]["b"].tolist() == [[1, 0], [0, 1]]
    assert got["cells"][0] == "a" and got["cells"][1].tolist() == [[1, 1, 1]]


@pytest.mark.parametrize("how", [{}, {"inside": True}, {"inside": True, "deflated": True}, {"record": False, "order": ">"}, {"inside": True, "record": False, "order": ">", "deflated": True}])
def test_eeglab(spark, tmp_path, monkeypatch, how):
    monkeypatch.setattr(matlab, "HELD", 1000)
    put(tmp_path, recordings.set_files("a", NAMES, 100.0, X, **how))
    path = str(tmp_path / "a.set")
    h = recordings.set_header(path)
    assert h["labels"] == NAMES and h["rate"] == 100 and h["samples"] == 700
    assert isinstance(h.get("inside"), matlab.Place) == bool(how.get("inside"))
    reader = lambda **o: recordings.SetReader({"path": path, **o})
    monkeypatch.setattr(recordings, "PART_BYTES", 4 * 5 * 64)
    parts = reader().partitions()
    assert len(parts) == (1 if how.get("deflated") and how.get("inside") else 11)
    got = {}
    for p in parts:
        for _, _, label, _, start, values in reader().read(p):
            assert start == len(got.setdefault(label, []))
            got[label] += values
    assert all(got[n] == X[k].astype("f8").tolist() for k, n in enumerate(NAMES))
    cut = joined(spark.read.format("eeglab").option("path", path).option("channels", "Cz,O1").option("start", 1.5).option("end", 2.25).load().collect())
    assert cut == {"Cz": X[1, 150:225].astype("f8").tolist(), "O1": X[3, 150:225].astype("f8").tolist()}


def test_eeglab_by_channel_defaults_and_damage(tmp_path):
    made = recordings.set_files("a", NAMES, 100.0, X)
    eeg = {"nbchan": 5.0, "pnts": 350.0, "trials": 2.0, "srate": 100.0, "data": "a.dat"}
    put(tmp_path, {"a.set": matlab.mat_bytes({"EEG": [eeg]}), "a.dat": X.tobytes()})
    got = list(recordings.SetReader({"path": str(tmp_path / "a.set")}).read(recordings.Range(str(tmp_path / "a.set"), 10, 20)))
    assert [r[2] for r in got] == ["EEG001", "EEG002", "EEG003", "EEG004", "EEG005"] and got[4][5] == X[4, 10:20].astype("f8").tolist()
    put(tmp_path, {"b.set": made["a.set"], "a.fdt": made["a.fdt"][:-4], "c.set": b"MATLAB 7.3 MAT-file".ljust(200), "d.set": matlab.mat_bytes({"EEG": [{**eeg, "srate": 0.0}]}), "e.set": made["a.set"][:-300]})
    with pytest.raises(ValueError, match="bytes, but"):
        recordings.SetReader({"path": str(tmp_path / "b.set")}).partitions()
    with pytest.raises(ValueError, match="version 5"):
        recordings.set_header(str(tmp_path / "c.set"))
    with pytest.raises(ValueError, match="must be above 0"):
        recordings.set_header(str(tmp_path / "d.set"))
    with pytest.raises((EOFError, ValueError, struct.error, TypeError)):
        recordings.set_header(str(tmp_path / "e.set"))


@pytest.mark.parametrize("by_channel", [False, True])
@pytest.mark.parametrize("kind", ["IEEE_FLOAT_32", "INT_16", "INT_32"])
def test_brainvision_layouts(tmp_path, monkeypatch, by_channel, kind):
    monkeypatch.setattr(recordings, "PART_BYTES", 700)
    put(tmp_path, recordings.raw_files("r", NAMES, 250.0, X, by_channel=by_channel, kind=kind, resolution=0.01))
    reader = recordings.RawReader({"path": str(tmp_path / "r.vhdr")})
    got = {}
    for p in reader.partitions():
        for _, _, label, rate, _, values in reader.read(p):
            got.setdefault(label, []).extend(values)
            assert rate == 250
    assert list(got) == NAMES and all(np.allclose(got[n], X[k], atol=0.006) for k, n in enumerate(NAMES))


def test_folder_of_mixed_recordings(spark, tmp_path):
    put(tmp_path, recordings.set_files("a", NAMES, 100.0, X) | recordings.raw_files("b", NAMES, 100.0, X, by_channel=True) | {"c.edf": recordings.edf_bytes(NAMES, X.astype("f8"), 100, limit=8.0), "d.txt": b"no recording"})
    listed = files.listing(spark, str(tmp_path))
    got = recordings.read_recordings(listed, channels="Pz", start="2", end="4")
    rows = {r.path.rpartition("/")[2]: r["values"] for r in got.collect()}
    assert sorted(rows) == ["a.set", "b.vhdr", "c.edf"] and all(np.allclose(v, X[2, 200:400], atol=2e-4) for v in rows.values())
    paths = ",".join(str(tmp_path / n) for n in ("a.set", "b.vhdr", "c.edf"))
    whole = spark.read.format("recording").option("path", paths).option("channels", "Pz").option("start", 2).option("end", 4).load()
    assert {r.path.rpartition("/")[2]: r["values"] for r in whole.collect()} == rows
    with pytest.raises(ValueError, match="no reader"):
        recordings.RecordingReader({"path": "x.txt"}).partitions()


def stitched(rows):
    """[row, column, channel] of each page from its blocks."""
    out = {}
    for r in rows:
        v = np.array(r["values"]).reshape(r.height, r.width, r.channels)
        page = out.setdefault(r.page, {})
        page[r.y, r.x] = v
    rows = lambda b: [np.concatenate([b[y, x] for x in sorted({k[1] for k in b})], axis=1) for y in sorted({k[0] for k in b})]
    return {p: np.concatenate(rows(b)) for p, b in out.items()}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", [{}, {"rows": 7}, {"big": True, "rows": 5, "compression": 8}, {"tile": 16, "compression": 8, "predictor": 2}, {"compression": 32773, "rows": 3}, {"planar": True, "rows": 4}, {"planar": True, "tile": 16, "big": True}])
@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
def test_tiff(spark, tmp_path, order, how, kind):
    if how.get("predictor") == 2 and kind == "f4":
        return
    draw = np.random.default_rng(5)
    pages = [(draw.uniform(0, 200, (23, 37, n))).astype(kind) for n in (1, 3)]
    path = tmp_path / "i.tif"
    path.write_bytes(images.tiff_bytes(pages, order=order, **how))
    with open(path, "rb") as f:
        byte_order, found = images.directories(f)
        assert byte_order == order and len(found) == 2
        for page, x in zip(found, pages, strict=True):
            s = images.layout(page, order)
            got = np.full(x.shape, np.nan)
            for k in range(s.across * s.down):
                left, top, v = images.pixels(f, s, k)
                got[top : top + v.shape[0], left : left + v.shape[1]] = v
            assert np.array_equal(got, x / float(np.iinfo(kind).max) if kind[0] == "u" else x)


def test_tiff_tables(spark, tmp_path, monkeypatch):
    xml = '<?xml version="1.0"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="I:0" Name="cells"><Pixels SizeX="37" SizeY="23" SizeZ="1" SizeC="2" SizeT="4" PhysicalSizeX="0.5" PhysicalSizeY="0.25" Type="uint16"><Channel Name="DAPI"/><Channel Name="GFP"></Channel></Pixels></Image></OME>'
    x = [np.arange(23 * 37, dtype="u2").reshape(23, 37) + k for k in range(3)]
    (tmp_path / "a.ome.tif").write_bytes(images.tiff_bytes(x, rows=4, description=xml))
    (tmp_path / "b.tif").write_bytes(images.tiff_bytes(x[:1], description="no xml <at all"))
    listed = files.listing(spark, str(tmp_path))
    pages = images.read_pages(listed).withColumn("name_of", F.regexp_extract("path", "[^/]+$", 0))
    rows = pages.orderBy("name_of", "page").select("name_of", "page", "width", "height", "channels", "bits", "format", "blocks").collect()
    assert [tuple(r) for r in rows] == [("a.ome.tif", k, 37, 23, 1, 16, "uint", 6) for k in range(3)] + [("b.tif", 0, 37, 23, 1, 16, "uint", 1)]
    meta = pages.where("page = 0").orderBy("name_of").select(*images.ome(F.col("description"))).collect()
    assert tuple(meta[0]) == ("cells", 37, 23, 1, 2, 4, 0.5, 0.25, None, "uint16", ["DAPI", "GFP"])
    assert meta[1].name is None and meta[1].size_x is None and meta[1].channel_names is None
    blocks = images.read_blocks(listed.where("path LIKE '%ome%'")).collect()
    again = spark.read.format("tiff").option("path", str(tmp_path / "a.ome.tif")).load().collect()
    assert sorted(map(tuple, blocks), key=str) == sorted(map(tuple, again), key=str)
    assert all(np.allclose(v[:, :, 0] * 65535, x[p]) for p, v in stitched(blocks).items())
    assert {r.page for r in spark.read.format("tiff").option("path", str(tmp_path / "a.ome.tif")).option("page", 1).load().collect()} == {1}


def test_tiff_codes_and_damage(tmp_path):
    def packed(data):
        """Codes by the published rule: one more bit once entry 511, 1023 or 2047 is added, a new table after entry 4093."""
        table, width, held, n, out, word = {bytes([k]): k for k in range(256)}, 9, 0, 0, bytearray(), b""

        def put(code):
            nonlocal held, n
            held, n = held << width | code, n + width
            while n >= 8:
                out.append(held >> (n - 8) & 255)
                n -= 8
                held &= (1 << n) - 1

        put(256)
        for c in data:
            longer = word + bytes([c])
            if longer in table:
                word = longer
                continue
            put(table[word])
            table[longer] = len(table) + 2
            width += len(table) + 2 == 1 << width
            word = bytes([c])
            if len(table) + 2 == 4094:
                put(table[word])
                put(256)
                table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
        if word:
            put(table[word])
        put(257)
        out.append(held << (8 - n) & 255)
        return bytes(out)

    long = bytes(np.random.default_rng(1).choice([1, 2, 3, 200], 60_000).astype("u1"))
    assert images._unpacked_codes(packed(long)) == long
    short = b"aaaaabababab" * 3
    assert images._unpacked_codes(packed(short)) == short
    with pytest.raises(ValueError, match="damaged"):
        images._unpacked_codes(bytes([0x80, 0x7F, 0xFF, 0xFF]))
    (tmp_path / "x.tif").write_bytes(b"II*\0")
    with open(tmp_path / "x.tif", "rb") as f, pytest.raises(struct.error):
        images.directories(f)
    (tmp_path / "y.tif").write_bytes(b"GIF89a")
    with open(tmp_path / "y.tif", "rb") as f, pytest.raises(ValueError, match="not a TIFF"):
        images.directories(f)


def put_frame(spark, folder, made):
    put(folder, made)
    return spark.createDataFrame([(str(folder / n),) for n in made], "path string")


def test_ctf_channels_of_a_nation_fill_several_files(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"copy (select k as c_custkey, (k % 15 // 14)::INT as c_nationkey, k / 4 as c_acctbal, 'm' as c_mktsegment from range(0, 36000) g(k)) to '{tmp_path}/customer.parquet' (format parquet)")
    c.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet')")
    got = registry.queries()["ctf_channels"](spark, str(tmp_path))
    want = c.sql(registry.oracle_sql()["ctf_channels"])
    assert got.columns == want.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert len(rows) == 36000 and rows == sorted(want.fetchall())
    with pytest.raises(ValueError, match="at most, not 32768"):
        headers.ctf_bytes([("a", 5, 1.0)] * 32768, samples=1, trials=1, rate=1.0)


def test_ctf(spark, tmp_path):
    channels = [("MLC11-1706", 5, 1e9), ("STIM", 11, 1.0), ("EEG001", 9, 0.5), ("X" * 32, 77, 2.0)]
    made = {f"{k}.res4": headers.ctf_bytes(channels, samples=1200, trials=3, rate=600.0, run="run of " + "x" * 40 * k, filters=k) for k in range(3)}
    rows = headers.read_ctf(put_frame(spark, tmp_path, made)).orderBy("path", "channel").collect()
    assert len(rows) == 12 and {(r.n_channels, r.n_samples, r.n_trials, r.rate) for r in rows} == {(4, 1200, 3, 600.0)}
    assert [(r.name, r.kind, r.q_gain) for r in rows[8:]] == [("MLC11", "MEG gradiometer", 1e9), ("STIM", "stimulus", 1.0), ("EEG001", "EEG", 0.5), ("X" * 32, "other", 2.0)]
    assert rows[8].run_description == "run of " + "x" * 80
    for bad, why in ((b"nothing", "not a CTF"), (made["0.res4"][:-1400], "cut short"), (headers.ctf_bytes([], samples=1, trials=1, rate=1.0), "0 channels")):
        with pytest.raises(Exception, match=why):
            headers.read_ctf(put_frame(spark, tmp_path, {"bad.res4": bad})).collect()


XML = """<?xml version="1.0"?><CIFTI Version="2"><Matrix>
<MatrixIndicesMap AppliesToMatrixDimension="0" IndicesMapToDataType="CIFTI_INDEX_TYPE_SERIES" NumberOfSeriesPoints="120"/>
<MatrixIndicesMap AppliesToMatrixDimension="1" IndicesMapToDataType="CIFTI_INDEX_TYPE_BRAIN_MODELS">
<BrainModel IndexOffset="0" IndexCount="29696" ModelType="CIFTI_MODEL_TYPE_SURFACE" BrainStructure="CIFTI_STRUCTURE_CORTEX_LEFT" SurfaceNumberOfVertices="32492"><VertexIndices>0 1 2</VertexIndices></BrainModel>
<BrainModel IndexOffset="29696" IndexCount="135" ModelType="CIFTI_MODEL_TYPE_VOXELS" BrainStructure="CIFTI_STRUCTURE_ACCUMBENS_LEFT"><VoxelIndicesIJK>1 2 3</VoxelIndicesIJK></BrainModel>
</MatrixIndicesMap></Matrix></CIFTI>"""


def test_cifti(spark, tmp_path):
    made = {"a.dtseries.nii": headers.cifti_bytes([1, 1, 1, 1, 120, 29831], XML, other=b"a comment"), "b.nii": headers.cifti_bytes([1, 1, 1, 1, 120, 29831], XML, order=">"), "c.nii": nifti_without_extensions()}
    table = put_frame(spark, tmp_path, made)
    assert sorted(r.code for r in headers.read_extensions(table).collect()) == [6, 32, 32]
    c = headers.read_cifti(table)
    rows = [(r.path[-5:], r.map, r.maps_to, r.applies_to, r.points, r.intent_name, r.dimensions) for r in c.orderBy("path", "map").collect()]
    maps = ((0, "CIFTI_INDEX_TYPE_SERIES", "0", 120), (1, "CIFTI_INDEX_TYPE_BRAIN_MODELS", "1", None))
    assert rows == [(p, *m, "ConnDenseSeries", [1, 1, 1, 1, 120, 29831]) for p in ("s.nii", "b.nii") for m in maps]
    models = [tuple(r)[1:] for r in headers.brain_models(c).where("path LIKE '%b.nii'").orderBy("model").collect()]
    assert models == [(0, 0, 29696, "CIFTI_MODEL_TYPE_SURFACE", "CIFTI_STRUCTURE_CORTEX_LEFT", 32492), (1, 29696, 135, "CIFTI_MODEL_TYPE_VOXELS", "CIFTI_STRUCTURE_ACCUMBENS_LEFT", None)]
    with pytest.raises(Exception, match="not a volume image"):
        headers.read_cifti(put_frame(spark, tmp_path, {"bad.nii": b"x" * 600})).collect()


def nifti_without_extensions():
    raw = bytearray(headers.cifti_bytes([2, 2, 2], ""))
    raw[540] = 0
    return bytes(raw)


def test_gifti(spark, tmp_path):
    array = '<DataArray Intent="{}" DataType="{}" Dimensionality="2" Dim0="{}" Dim1="3" Encoding="Base64Binary" Endian="LittleEndian"><MetaData><MD><Name>own</Name><Value>x</Value></MD></MetaData><Data>{}</Data></DataArray>'
    xml = '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE GIFTI SYSTEM "http://gifti.projects.nitrc.org/gifti.dtd"><GIFTI Version="1.0" NumberOfDataArrays="2"><MetaData><MD><Name><![CDATA[Anatomical]]></Name><Value><![CDATA[Cortex & Left]]></Value></MD></MetaData>'
    made = {"a.surf.gii": (xml + array.format("NIFTI_INTENT_POINTSET", "NIFTI_TYPE_FLOAT32", 32492, "A" * 300_000) + array.format(1009, 8, 64980, "AAAA") + "</GIFTI>").encode()}
    r = headers.read_gifti(put_frame(spark, tmp_path, made)).first()
    assert (r.n_arrays, r.n_vertices, r.n_faces, r.metadata) == (2, 32492, 64980, {"Anatomical": "Cortex & Left"})
    assert [(a.intent, a.data_type, a.dims, a.encoding) for a in r.arrays] == [(1008, 16, [32492, 3], "Base64Binary"), (1009, 8, [64980, 3], "Base64Binary")]
    for bad in (b"not a gifti file", b"<html></html>", made["a.surf.gii"][:-8]):
        with pytest.raises(Exception, match="not a GIFTI"):
            headers.read_gifti(put_frame(spark, tmp_path, {"bad.gii": bad})).collect()


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("a.tsv", 3000), ("b.tsv", 7), ("c.tsv", 1)):
        (tmp_path / name).write_text("".join(f"{k}\t{'x' if k % 5 else 'n/a'}\t{k / 2}\n" for k in range(n)))
    (tmp_path / "d.tsv").write_text("1\t2\t3\r\n\r\n4")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        t = text.read_headerless_tsv(spark, str(tmp_path), ["k", "odd", "half"])
        assert spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 6
        rows = {(r.path[-5:], r.row): (r.k, r.odd, r.half) for r in t.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(name, k): (float(k), None, k / 2) for name, n in (("a.tsv", 3000), ("b.tsv", 7), ("c.tsv", 1)) for k in range(n)}
    assert rows == want | {("d.tsv", 0): (1.0, 2.0, 3.0), ("d.tsv", 1): (None, None, None), ("d.tsv", 2): (4.0, None, None)}


def test_header_tables(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 5, dtype="i2").reshape(2, 3, 4, 5)
    made = recordings.nifti_files("a", data, zooms=(1.0, 2.0, 3.0, 1.5)) | recordings.nifti_files("b", data[..., 0], pair=True, packed=True, two=True)
    r = {x.path.rpartition("/")[2]: x for x in headers.read_images(put_frame(spark, tmp_path, {k: v for k, v in made.items() if "img" not in k})).collect()}
    a, b = r["a.nii"], r["b.hdr.gz"]
    assert (a.version, a.n_volumes, a.matrix, a.voxel_size, a.repetition_time, a.data_type) == (1, 5, [2, 3, 4], [1.0, 2.0, 3.0], 1.5, "int16")
    assert (b.version, b.n_volumes, b.matrix, b.repetition_time) == (2, 1, [2, 3, 4], None)
    put(tmp_path, made)
    voxels = {(x.path.rpartition("/")[2], x.t): x.voxels for x in recordings.read_volumes(files.listing(spark, str(tmp_path), "*.{nii,hdr.gz}")).collect()}
    assert voxels["a.nii", 3] == data[..., 3].ravel(order="F").tolist() and voxels["b.hdr.gz", 0] == data[..., 0].ravel(order="F").tolist()
    e = headers.read_edf_headers(put_frame(spark, tmp_path, {"x.edf": recordings.edf_bytes(NAMES, X.astype("f8"), 100, limit=8.0), "y.bdf": recordings.edf_bytes(NAMES[:2], X[:2].astype("f8"), 50, limit=8.0, bdf=True)}))
    assert [(x.n_channels, x.records, x.duration, x.bits, x.labels[-1], x.rates[0]) for x in e.orderBy("path").collect()] == [(5, 7, 7.0, 16, "O,2", 100.0), (2, 14, 14.0, 24, "Cz", 50.0)]
    for bad, read in (({"bad.nii": b"nothing at all here"}, headers.read_images), ({"bad.edf": b"x" * 300}, headers.read_edf_headers), ({"cut.edf": recordings.edf_bytes(NAMES, X.astype("f8"), 100)[:300]}, headers.read_edf_headers)):
        with pytest.raises(Exception, match="not a|cut short"):
            read(put_frame(spark, tmp_path, bad)).collect()


def test_annotations_of_many_files(spark, tmp_path):
    marks = {"a.edf": [(k / 8, f"m{k % 3}") for k in range(50)], "b.edf": [], "c.edf": [(2.5, "é")]}
    listed = put_frame(spark, tmp_path, {n: recordings.edf_annotation_bytes(m, 0.25) for n, m in marks.items()})
    got = sorted((r.path.rpartition("/")[2], r.onset, r.duration, r.description) for r in recordings.read_annotations(listed).collect())
    assert got == sorted((n, o, 0.25, t) for n, m in marks.items() for o, t in m)


def test_written_files_and_splits(spark, tmp_path):
    made = spark.createDataFrame([(f"d{k % 3}/f{k}.bin", bytes([k]) * k) for k in range(20)], "name string, content binary").repartition(4)
    paths = {r.path: r.bytes for r in files.write_files(made, str(tmp_path / "out")).collect()}
    assert len(paths) == 20 and all(open(p, "rb").read() == bytes([n]) * n for p, n in paths.items())
    assert len(list((tmp_path / "out").rglob("*.bin*"))) == 20
    from tessera.operators import datasets

    rows = [("train", 'a "b", c'), ("val", "x,y"), ("train", "plain")]
    datasets.write_split(spark.createDataFrame(rows, "split string, name string"), str(tmp_path / "s"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "s"))
    assert sorted((r.split, r.name) for r in back.collect()) == sorted(rows)


def test_linked_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    pairs = spark.createDataFrame([(str(tmp_path / "a.bin"), str(tmp_path / f"links/{k}/a.bin")) for k in range(3)], "src string, dst string")
    for _ in range(2):
        assert {r.bytes for r in files.copy_files(pairs, link=True).collect()} == {5}
    assert all((tmp_path / f"links/{k}/a.bin").is_symlink() and (tmp_path / f"links/{k}/a.bin").read_bytes() == b"12345" for k in range(3))
    with pytest.raises(Exception, match="no symbolic links"):
        files.copy_files(spark.createDataFrame([("s3a://b/x", "s3a://b/y")], "src string, dst string"), link=True).collect()
