"""Queries that write given tables in the formats of recordings and images, and read them back with the sources."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans import views
from tessera.plans.signal_plans import _r, _rounded
from tessera.plans.views import EVENTS_SQL
from tessera.functions import metadata
from tessera.operators import datasets
from tessera.sources import files, headers, images, recordings, text

#: Vectors that make up a recording, a channel each; samples of a second.
CHANNELS, RATE = 32, 16


def _stored(spark: SparkSession, d: str, name: str, build: Callable) -> str:
    """The folder with the files that build(recording, labels, signals) makes of each recording, by name."""
    root = files.scratch(spark, name)

    def made(key, group):
        import pandas as pd

        group = group.sort_values("vec_id")
        out = build(int(key[0]), [f"C{v % CHANNELS}" for v in group["vec_id"]], np.stack(group["embedding"]).astype("f8"))
        return pd.DataFrame({"name": list(out), "content": list(out.values())})

    e = views.read(spark, d, "embeddings").select("vec_id", "embedding", F.expr(f"vec_id div {CHANNELS}").alias("rec"))
    files.write_files(e.groupBy("rec").applyInPandas(made, "name string, content binary"), root).agg(F.sum("bytes")).collect()
    return root


def _samples(chunks: DataFrame) -> DataFrame:
    """rec, label, idx, value of each sample of chunks."""
    s = chunks.select(F.regexp_extract("path", r"(\d+)[.]\w+$", 1).cast("long").alias("rec"), "label", "start", F.posexplode("values").alias("pos", "value"))
    return _rounded(s.select("rec", "label", (F.col("start") + F.col("pos")).alias("idx"), "value"), "value")


def _edf(rec: int, labels: list[str], x: np.ndarray) -> dict[str, bytes]:
    ending = "bdf" if rec % 2 else "edf"
    return {f"{rec}.{ending}": recordings.edf_bytes(labels, x, RATE, bdf=bool(rec % 2), limit=8.0)}


def _raw(rec: int, labels: list[str], x: np.ndarray) -> dict[str, bytes]:
    if rec % 4 < 2:
        return recordings.raw_files(str(rec), labels, RATE, x, by_channel=bool(rec % 2))
    return recordings.raw_files(str(rec), labels, RATE, x, by_channel=bool(rec % 2), kind="INT_16", resolution=0.001)


def _set(rec: int, labels: list[str], x: np.ndarray) -> dict[str, bytes]:
    return recordings.set_files(str(rec), labels, RATE, x, inside=rec % 4 > 1, record=rec % 3 > 0, deflated=rec % 4 == 3, order="<" if rec % 5 else ">")


def edf_recordings(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "edf", _edf)
    return _samples(recordings.read_recordings(files.listing(spark, root)))


def brainvision_recordings(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "raw", _raw)
    return _samples(recordings.read_recordings(files.listing(spark, root)))


def eeglab_recordings(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "set", _set)
    return _samples(recordings.read_recordings(files.listing(spark, root), start="0.5", end="3.25"))


def mixed_recordings(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "mixed", lambda rec, labels, x: (_edf, _raw, _set)[rec % 3](rec, labels, x))
    return _samples(recordings.read_recordings(files.listing(spark, root), exclude="C3,C30"))


def _volumes(rec: int, labels: list[str], x: np.ndarray) -> dict[str, bytes]:
    """The channels as 4 x 4 x 4 voxels, a volume each."""
    data = x.T.reshape(4, 4, 4, -1, order="F").astype("f4")
    if rec % 5 == 4:
        return recordings.nifti_files(str(rec), np.rint(data * 1000).astype("i2"), slope=0.001, inter=0.5)
    return recordings.nifti_files(str(rec), data, pair=rec % 5 in (1, 2), packed=rec % 5 in (2, 3), two=rec % 2 == 1)


def nifti_volumes(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "nifti", _volumes)
    v = recordings.read_volumes(files.listing(spark, root))
    return _rounded(v.select(F.regexp_extract("path", r"(\d+)[.]\w+([.]gz)?$", 1).cast("long").alias("rec"), "t", F.posexplode("voxels").alias("voxel", "value")), "value")


def image_headers(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "nifti-headers", lambda rec, labels, x: recordings.nifti_files(str(rec), x.T.reshape(4, 4, 4, -1, order="F").astype("f4"), zooms=(1.0, 2.0, 0.5, 0.25 * (rec % 3)), two=rec % 2 == 1, packed=rec % 3 == 0, pair=rec % 4 == 0))
    h = headers.read_images(files.listing(spark, root, "*.{nii,nii.gz,hdr,hdr.gz}"))
    z = metadata.world(F.col("affine"), F.lit(1.0), F.lit(2.0), F.lit(3.0))[2]
    return h.select(F.regexp_extract("path", r"(\d+)[.]\w+([.]gz)?$", 1).cast("long").alias("rec"), "version", "n_volumes", F.array_join("matrix", "x").alias("matrix"), F.get("voxel_size", 1).alias("size_y"), "repetition_time", "data_type", z)


def edf_headers(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "edf-headers", _edf)
    h = headers.read_edf_headers(files.listing(spark, root))
    return h.select(F.regexp_extract("path", r"(\d+)[.]\w+$", 1).cast("long").alias("rec"), "n_channels", "records", "record_s", "duration", "bits", F.size("labels").alias("n_labels"), F.get("labels", 0).alias("first"), F.array_max("rates").alias("rate"), F.get("units", 0).alias("unit"))


def _image(rec: int, labels: list[str], x: np.ndarray) -> dict[str, bytes]:
    """The channels as rows of pixels: floats, or whole numbers of two bytes in strips, tiles or packed."""
    how = ({}, {"rows": 5, "order": ">"}, {"tile": 16, "compression": 8, "predictor": 2}, {"rows": 3, "compression": 32773, "big": True})[rec % 4]
    page = x.astype("f4") if rec % 4 == 0 else np.rint((x + 4) * 8000).astype("u2")
    name = f'<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image Name="rec {rec}"><Pixels SizeX="{page.shape[1]}" SizeY="{page.shape[0]}" SizeC="1" PhysicalSizeX="0.5" Type="{page.dtype}"><Channel Name="{labels[0]}"/></Pixels></Image></OME>'
    return {f"{rec}.ome.tif": images.tiff_bytes([page, page[:1]], description=name if rec % 3 else "", **how)}


def tiff_pixels(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "tiff", _image)
    b = images.read_blocks(files.listing(spark, root)).where("page = 0")
    rec = F.regexp_extract("path", r"(\d+)[.]ome", 1).cast("long").alias("rec")
    p = b.select(rec, "x", "y", "width", F.posexplode("values").alias("pos", "value"))
    return _rounded(p.select("rec", (F.col("y") + F.expr("pos div width")).alias("y"), (F.col("x") + F.col("pos") % F.col("width")).alias("x"), "value"), "value")


def ome_pages(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d, "ome", _image)
    pages = images.read_pages(files.listing(spark, root))
    meta = pages.select(F.regexp_extract("path", r"(\d+)[.]ome", 1).cast("long").alias("rec"), "page", "width", "height", "bits", "format", *images.ome(F.col("description")))
    return meta.select("rec", "page", "width", "height", "bits", "format", "name", "size_x", "size_y", "physical_size_x", "pixel_type", F.get("channel_names", 0).alias("channel"))


#: Keys of customers that are counted together.
RANGE = 65_536


def _dealt(c: DataFrame, limit: int) -> DataFrame:
    """Customers with part, from 0: their nation's, in the order of their keys, by limit in each.

    Ranges of keys are counted, and places within a range start where the ranges before it end, so no task has a whole nation.
    """
    c = c.withColumn("_range", F.coalesce(F.expr(f"c_custkey div {RANGE}"), F.lit(-1)))
    counts = c.groupBy(F.col("c_nationkey").alias("_n"), F.col("_range").alias("_r")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("_n").orderBy("_r")) - F.col("_c"))
    placed = c.withColumn("_i", F.row_number().over(Window.partitionBy("c_nationkey", "_range").orderBy("c_custkey")))
    placed = placed.join(counts, F.col("c_nationkey").eqNullSafe(F.col("_n")) & (F.col("_range") == F.col("_r")))
    return placed.withColumn("part", F.expr(f"(_before + _i - 1) div {limit}")).drop("_range", "_i", "_n", "_r", "_c", "_before")


def _by_nation(spark: SparkSession, d: str, name: str, build: Callable, limit: int | None = None) -> str:
    """The folder with the file that build(nation, customers) makes of each nation's customers; with a limit build(nation, part, customers), for each part of so many."""
    root = files.scratch(spark, name)

    def made(key, group):
        import pandas as pd

        return pd.DataFrame([build(*map(int, key), group.sort_values("c_custkey"))], columns=["name", "content"])

    c = views.read(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")
    grouped = _dealt(c, limit).groupBy("c_nationkey", "part") if limit else c.groupBy("c_nationkey")
    files.write_files(grouped.applyInPandas(made, "name string, content binary"), root).agg(F.sum("bytes")).collect()
    return root


def _nation() -> Column:
    return F.regexp_extract("path", r"(\d+)[.][\w.]+$", 1).cast("long").alias("nation")


def ctf_channels(spark: SparkSession, d: str) -> DataFrame:
    """A nation's channels, in as many files as they need; numbered and counted across them."""

    def build(nation, part, c):
        channels = [(f"M{k}-1706", (5, 9, 11, 0)[k % 4], bal) for k, bal in zip(c["c_custkey"], c["c_acctbal"], strict=True)]
        return f"{nation}.{part}.res4", headers.ctf_bytes(channels, samples=100 + nation, trials=nation + 1, rate=600.0, run="run " * nation, filters=nation % 3)

    h = headers.read_ctf(files.listing(spark, _by_nation(spark, d, "ctf", build, headers.CTF_CHANNELS)))
    h = h.withColumn("nation", _nation()).withColumn("part", F.regexp_extract("path", r"[.](\d+)[.]res4$", 1).cast("int"))
    #: A row for each nation.
    counts = h.where("channel = 0").groupBy("nation").agg(F.sum("n_channels").cast("int").alias("n_channels"))
    channel = (F.col("part") * headers.CTF_CHANNELS + F.col("channel")).alias("channel")
    return h.drop("n_channels").join(counts, "nation").select("nation", "n_channels", "n_samples", "n_trials", "rate", channel, "name", "kind", F.col("q_gain").alias("gain"))


def cifti_models(spark: SparkSession, d: str) -> DataFrame:
    def build(nation, c):
        models, at = [], 0
        for k, segment in zip(c["c_custkey"].tolist(), c["c_mktsegment"], strict=True):
            surface = f' SurfaceNumberOfVertices="{k + 1000}"' if k % 2 else ""
            models.append(f'<BrainModel IndexOffset="{at}" IndexCount="{k}" ModelType="CIFTI_MODEL_TYPE_{"SURFACE" if k % 2 else "VOXELS"}" BrainStructure="CIFTI_STRUCTURE_{segment}"{surface}><VertexIndices>0 1</VertexIndices></BrainModel>')
            at += k
        xml = f'<CIFTI Version="2"><Matrix><MatrixIndicesMap AppliesToMatrixDimension="1" IndicesMapToDataType="CIFTI_INDEX_TYPE_BRAIN_MODELS">{"".join(models)}</MatrixIndicesMap></Matrix></CIFTI>'
        return f"{nation}.dscalar.nii", headers.cifti_bytes([1, 1, 1, 1, 1, at], xml, intent=3006, other=b"x" * nation)

    return headers.brain_models(headers.read_cifti(files.listing(spark, _by_nation(spark, d, "cifti", build)))).select(_nation(), "model", "first", "count", "type", "structure", "surface_vertices")


def gifti_surfaces(spark: SparkSession, d: str) -> DataFrame:
    def build(nation, c):
        array = '<DataArray Intent="{}" DataType="16" Dim0="{}" Dim1="3" Encoding="ASCII" Endian="LittleEndian"><Data>{}</Data></DataArray>'
        data = " ".join(map(str, c["c_acctbal"]))
        own = "".join(f"<MD><Name>s{k}</Name><Value>{s}</Value></MD>" for k, s in enumerate(c["c_mktsegment"][:3]))
        xml = f'<?xml version="1.0"?><GIFTI Version="1.0"><MetaData>{own}</MetaData>{array.format("NIFTI_INTENT_POINTSET", len(c), data)}{array.format(1009, nation, data) if nation % 2 else ""}</GIFTI>'
        return f"{nation}.surf.gii", xml.encode()

    g = headers.read_gifti(files.listing(spark, _by_nation(spark, d, "gifti", build)))
    return g.select(_nation(), "n_arrays", "n_vertices", "n_faces", F.try_element_at("metadata", F.lit("s0")).alias("first_segment"), F.size("metadata").alias("n_metadata"))


def events_tables(spark: SparkSession, d: str) -> DataFrame:
    """Events written as tab-separated text and read back."""
    path = files.scratch(spark, "events-tsv")
    e = views.events(spark, d).withColumn("duration", F.when(F.col("event_id") % 3 > 0, F.col("duration"))).withColumn("trial_type", F.when(F.col("event_id") % 5 > 0, F.col("trial_type")))
    text.write_tsv(e.select("onset", "duration", "trial_type", "event_id", "subject"), path)
    return text.read_events(spark, path).select(F.col("extra.event_id").cast("long").alias("event_id"), F.col("extra.subject").cast("long").alias("subject"), "onset", "duration", "trial_type")


def gradient_files(spark: SparkSession, d: str) -> DataFrame:
    """Values and vectors written as text files, three vectors of each customer, and read back as one table."""
    root = files.scratch(spark, "gradients")
    c = views.read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey"))).alias("a"))
    b = F.array_join(F.transform("a", lambda x: (x.c_custkey % 3 * 1000).cast("string")), " ")
    row = lambda k: F.array_join(F.transform("a", lambda x: F.when(x.c_custkey % 3 == k, "1").otherwise("0")), " ")
    made = c.select(F.inline(F.array(F.struct(F.format_string("sub-%d_dwi.bval", "c_nationkey").alias("name"), b.cast("binary").alias("content")), F.struct(F.format_string("sub-%d_dwi.bvec", "c_nationkey").alias("name"), F.concat_ws("\n", row(0), row(1), row(2)).cast("binary").alias("content")))))
    files.write_files(made, root).agg(F.sum("bytes")).collect()
    lines = spark.read.text(root, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"sub-(\d+)_dwi", 1).cast("long").alias("nation"), F.input_file_name().endswith("bval").alias("is_value"), "value")
    pairs = lines.groupBy("nation").agg(F.max(F.when(F.col("is_value"), F.col("value"))).alias("b"), F.max(F.when(~F.col("is_value"), F.col("value"))).alias("v"))
    g = pairs.select("nation", text.gradients(F.col("b"), F.col("v")).alias("g"))
    return g.select("nation", *text.gradient_summary(F.col("g")))


def sidecar_files(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file for each part, some damaged, read back as tags."""
    root = files.scratch(spark, "sidecars")
    p = views.read(spark, d, "part")
    content = F.when(F.col("p_partkey") % 7 == 0, F.lit("{")).otherwise(F.to_json(F.struct(F.col("p_size").alias("SliceCount"), F.col("p_brand").alias("Manufacturer"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("SeriesDescription"))))
    files.write_files(p.select(F.format_string("p%d.json", "p_partkey").alias("name"), content.cast("binary").alias("content")), root).agg(F.sum("bytes")).collect()
    tags = text.sidecar_tags(text.read_sidecars(spark, root))
    return tags.select(F.regexp_extract("path", r"p(\d+)[.]json$", 1).cast("long").alias("part"), "key", "value")


def results_files(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark results, a row of each order, written as CSV and appended, and as Parquet; read back and compared in one table."""
    o = views.read(spark, d, "orders")
    r = o.select(
        F.lit("d, 1").alias("dataset"), F.col("o_custkey").cast("string").alias("subject"), F.lit(None).cast("string").alias("session"), F.col("o_orderpriority").alias("pipeline"), F.lit('a "b"').alias("paradigm"),
        F.lit("within").alias("eval_type"), F.col("o_totalprice").cast("double").alias("score"), F.lit("accuracy").alias("scoring"), F.lit(0.5).alias("time_seconds"), *[F.col("o_orderkey").alias(c) for c in ("n_train", "n_test", "n_channels", "n_classes", "fold")], F.col("o_orderstatus").alias("notes"),
    )
    csv, parquet = files.scratch(spark, "results-csv"), files.scratch(spark, "results-parquet")
    datasets.write_results(r.where("n_train % 2 = 0"), csv)
    datasets.write_results(r.where("n_train % 2 = 1"), csv)
    datasets.write_results(r, parquet, form="parquet")
    back = datasets.read_results(spark, csv).withColumn("form", F.lit("csv")).unionByName(datasets.read_results(spark, parquet, form="parquet").withColumn("form", F.lit("parquet")))
    return back.groupBy("form", "pipeline", "dataset", "paradigm", "notes").agg(F.count("*").alias("n"), F.count("session").alias("sessions"), F.round(F.sum("score"), 2).alias("score"), F.max("fold").alias("last"))


def head_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Points of suppliers as lines of a head-shape file."""
    s = views.read(spark, d, "supplier")
    label = F.when(F.col("s_suppkey") % 4 == 0, "nasion ").when(F.col("s_suppkey") % 4 == 1, "EEG7 ").when(F.col("s_suppkey") % 4 == 2, "hpi_2 ").otherwise("")
    line = F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("% "), "s_name")).otherwise(F.concat(label, F.col("s_suppkey").cast("string"), F.lit(" "), F.col("s_nationkey").cast("string"), F.lit("\t"), F.col("s_acctbal").cast("string")))
    path = files.scratch(spark, "shapes")
    s.select(line.alias("value")).write.text(path)
    return text.head_shape(spark.read.text(path)).select("label", "x", "y", "z", "kind")


def copied_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of regions' comments copied to other folders by tasks, then listed."""
    root = files.scratch(spark, "copies")
    n = views.read(spark, d, "customer").select(F.format_string("in/c%d.txt", "c_custkey").alias("name"), F.col("c_name").cast("binary").alias("content"), F.format_string(f"{root}/out/n%d/c%d.txt", F.col("c_nationkey"), F.col("c_custkey")).alias("dst"))
    files.write_files(n, root).agg(F.sum("bytes")).collect()
    files.copy_files(n.select(F.concat(F.lit(f"{root}/"), "name").alias("src"), "dst")).agg(F.sum("bytes")).collect()
    listed = files.listing(spark, f"{root}/out")
    return listed.groupBy(F.regexp_extract("path", r"/n(\d+)/", 1).cast("long").alias("nation")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def edf_marks(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user as the annotations of an EDF+ file, read back as timed marks."""
    root = files.scratch(spark, "edf-marks")

    def made(key, group):
        import pandas as pd

        marks = [(float(o), t) for o, t in zip(group["onset"], group["trial_type"], strict=True)]
        return pd.DataFrame([(f"{key[0]}.edf", recordings.edf_annotation_bytes(marks, 0.5))], columns=["name", "content"])

    e = views.events(spark, d).select("subject", (F.col("event_id") / 4).alias("onset"), "trial_type")
    files.write_files(e.groupBy("subject").applyInPandas(made, "name string, content binary"), root).agg(F.sum("bytes")).collect()
    marks = recordings.read_annotations(files.listing(spark, root, "*.edf"))
    return marks.select(F.regexp_extract("path", r"(\d+)[.]edf$", 1).cast("long").alias("subject"), "onset", "duration", "description")


def headerless_tables(spark: SparkSession, d: str) -> DataFrame:
    """A physiological recording without a header for each vector, numbered by lines."""
    root = files.scratch(spark, "physio")
    e = views.read(spark, d, "embeddings")
    line = F.array_join(F.transform("embedding", lambda x, i: F.concat(i.cast("string"), F.lit("\t"), F.when(i % 7 == 3, "n/a").otherwise(F.round(x.cast("double") * 1000).cast("long").cast("string")))), "\n")
    files.write_files(e.select(F.format_string("p%d_physio.tsv", "vec_id").alias("name"), line.cast("binary").alias("content")), root).agg(F.sum("bytes")).collect()
    t = text.read_headerless_tsv(spark, root, ["sample", "cardiac"])
    return t.select(F.regexp_extract("path", r"p(\d+)_physio", 1).cast("long").alias("rec"), "row", "sample", "cardiac")


def channels_tables(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers as channels with types in several spellings."""
    path = files.scratch(spark, "channels")
    k = F.col("c_custkey")
    c = views.read(spark, d, "customer").select(F.col("c_name").alias("name"), F.element_at(F.array(F.lit(" eeg"), F.lit("EKG"), F.lit("stim"), F.lit(None), F.lit("odd"), F.lit("HEOG")), (k % 6 + 1).cast("int")).alias("type"), F.when(k % 4 > 0, "uV").alias("units"), F.col("c_acctbal").cast("string").alias("low_cutoff"), F.when(k % 5 == 0, "bad").otherwise("good").alias("status"))
    text.write_tsv(c, path)
    return text.read_channels(spark, path).select("name", "type", "units", "status", "low_cutoff", "high_cutoff")


def electrode_tables(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "electrodes")
    k = F.col("c_custkey")
    c = views.read(spark, d, "customer").select(F.col("c_name").alias("name"), k.cast("string").alias("x"), F.when(k % 3 > 0, F.col("c_acctbal").cast("string")).alias("y"), F.when(k % 4 == 0, "unknown").otherwise("1e2").alias("z"), F.lit("ring").alias("type"))
    text.write_tsv(c, path)
    return text.read_positions(spark, path)


def blood_readings(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "blood")
    o = views.read(spark, d, "orders")
    text.write_tsv(o.select(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey").cast("string")).alias("time"), F.col("o_totalprice").cast("string").alias("plasma_radioactivity"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("0.25").alias("metabolite_parent_fraction")), path)
    b = text.read_blood(spark, path)
    return b.groupBy("metabolite_parent_fraction").agg(F.count("*").alias("n"), F.sum("time").alias("time"), F.round(F.sum("plasma_radioactivity"), 2).alias("plasma"), F.count("whole_blood_radioactivity").alias("whole"))


def asl_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation as the volumes of a perfusion series."""
    root = files.scratch(spark, "asl")
    kind = F.element_at(F.array(*map(F.lit, ("control", "label", "m0scan"))), (F.length("c_mktsegment") % 3 + 1).cast("int"))
    c = views.read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", kind.alias("kind")))).alias("a"))
    content = F.concat(F.lit("volume_type\n"), F.array_join(F.transform("a", lambda x: x.kind), "\n"), F.lit("\n"))
    files.write_files(c.select(F.format_string("sub-%d_aslcontext.tsv", "c_nationkey").alias("name"), content.cast("binary").alias("content")), root).agg(F.sum("bytes")).collect()
    return text.read_asl_context(spark, root).select(F.regexp_extract("path", r"sub-(\d+)_", 1).cast("long").alias("nation"), "volume", "volume_type")


def description_files(spark: SparkSession, d: str) -> DataFrame:
    """A dataset's description for each supplier, with its issues."""
    root, k = files.scratch(spark, "descriptions"), F.col("s_suppkey")
    made_by = F.when(k % 3 == 0, F.array(F.struct(F.col("s_name").alias("Name"), F.lit("1.0").alias("Version"))))
    content = F.to_json(F.struct(F.when(k % 4 > 0, F.col("s_name")).alias("Name"), F.when(k % 5 > 0, F.lit("1.8.0")).otherwise(" ").alias("BIDSVersion"), F.when(k % 2 == 0, "derivative").otherwise("raw").alias("DatasetType"), F.array(F.lit("a"), F.col("s_name")).alias("Authors"), made_by.alias("GeneratedBy")))
    files.write_files(views.read(spark, d, "supplier").select(F.format_string("d%d/dataset_description.json", "s_suppkey").alias("name"), content.cast("binary").alias("content")), root).agg(F.sum("bytes")).collect()
    return text.description_issues(text.read_description(spark, f"{root}/*")).groupBy("field", "message").agg(F.count("*").alias("n"))


def coordsystem_files(spark: SparkSession, d: str) -> DataFrame:
    root, k = files.scratch(spark, "coordsystems"), F.col("s_suppkey")
    content = F.to_json(F.struct(F.when(k % 2 == 0, "CapTrak").alias("EEGCoordinateSystem"), F.lit("mm").alias("EEGCoordinateUnits"), F.create_map(F.lit("NAS"), F.array(k.cast("double"), F.col("s_acctbal").cast("double"), F.lit(0.5))).alias("FiducialsCoordinates")))
    files.write_files(views.read(spark, d, "supplier").select(F.format_string("s%d_coordsystem.json", "s_suppkey").alias("name"), content.cast("binary").alias("content")), root).agg(F.sum("bytes")).collect()
    c = text.read_coordsystem(spark, root)
    at = F.try_element_at("FiducialsCoordinates", F.lit("NAS"))
    return c.select(F.regexp_extract("path", r"s(\d+)_coordsystem", 1).cast("long").alias("supplier"), F.col("EEGCoordinateSystem").alias("system"), F.col("EEGCoordinateUnits").alias("units"), *[F.get(at, k).alias(n) for k, n in enumerate("xyz")])


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """A manifest as CSV and as Parquet, and splits as folders of CSV, counted together."""
    o = views.read(spark, d, "orders").select(F.format_string("sub-%d", "o_custkey").alias("subject"), F.lit('a "b", c').alias("task"), F.col("o_orderkey").alias("run"), F.lit(".edf").alias("extension"), F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("split"))
    csv, parquet, split = (files.scratch(spark, n) for n in ("manifest-csv", "manifest-parquet", "manifest-split"))
    text.write_manifest(o, csv)
    text.write_manifest(o, parquet, form="parquet")
    datasets.write_split(o, split)
    read = lambda p: spark.read.option("header", True).option("escape", '"').csv(p)
    forms = {"csv": read(csv), "parquet": spark.read.parquet(parquet), "split": read(split)}
    out = None
    for name, df in forms.items():
        part = df.groupBy("split", "task").agg(F.countDistinct("subject").alias("subjects"), F.count("*").alias("n")).withColumn("form", F.lit(name)).withColumn("columns", F.lit(len(df.columns)))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        edf_recordings, brainvision_recordings, eeglab_recordings, mixed_recordings, nifti_volumes, image_headers, edf_headers, tiff_pixels, ome_pages, ctf_channels, cifti_models, gifti_surfaces,
        events_tables, gradient_files, sidecar_files, results_files, head_shapes, copied_files, edf_marks, headerless_tables, channels_tables, electrode_tables, blood_readings,
        asl_contexts, description_files, coordsystem_files, manifest_files,
    )
}

#: A value as a file of each kind holds it.
_EDF_VALUE = "round_even((x + 8) * steps / 16 + low, 0) * (16 / steps) + (-8 - low * (16 / steps))"
_RAW_VALUE = "CASE WHEN rec % 4 < 2 THEN x ELSE round_even(x / 0.001, 0) * 0.001 END"
_X = f"""WITH s AS (
  SELECT vec_id // {CHANNELS} AS rec, 'C' || (vec_id % {CHANNELS}) AS label, (i - 1)::BIGINT AS idx, embedding[i]::DOUBLE AS x
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)),
v AS (SELECT *, CASE WHEN rec % 2 = 1 THEN 16777215 ELSE 65535 END::DOUBLE AS steps, CASE WHEN rec % 2 = 1 THEN -8388608 ELSE -32768 END::DOUBLE AS low FROM s)"""

ORACLES = {
    "edf_recordings": f"{_X} SELECT rec, label, idx, {_r(_EDF_VALUE)} AS value FROM v",
    "brainvision_recordings": f"{_X} SELECT rec, label, idx, {_r(_RAW_VALUE)} AS value FROM v",
    "eeglab_recordings": f"{_X} SELECT rec, label, idx, {_r('x')} AS value FROM v WHERE idx >= 8 AND idx < 52",
    "mixed_recordings": f"{_X} SELECT rec, label, idx, {_r(f'CASE rec % 3 WHEN 0 THEN {_EDF_VALUE} WHEN 1 THEN {_RAW_VALUE} ELSE x END')} AS value FROM v WHERE label NOT IN ('C3', 'C30')",
    "nifti_volumes": f"""{_X} SELECT rec, row_number() OVER (PARTITION BY rec, idx ORDER BY length(label), label)::INT - 1 AS t, idx::INT AS voxel,
      {_r("CASE WHEN rec % 5 = 4 THEN round_even((x::FLOAT * 1000::FLOAT)::DOUBLE, 0) * 0.001::FLOAT::DOUBLE + 0.5 ELSE x END")} AS value FROM v""",
    "image_headers": f"""WITH r AS (SELECT vec_id // {CHANNELS} AS rec, count(*) AS n FROM embeddings GROUP BY ALL)
      SELECT rec, CASE rec % 2 WHEN 1 THEN 2 ELSE 1 END AS version, n::INT AS n_volumes, '4x4x4' AS matrix, 2.0::DOUBLE AS size_y, CASE WHEN rec % 3 > 0 THEN 0.25 * (rec % 3) END::DOUBLE AS repetition_time, 'float32' AS data_type, 1.5::DOUBLE AS z FROM r""",
    "edf_headers": f"""WITH r AS (SELECT vec_id // {CHANNELS} AS rec, count(*) AS n, min(vec_id % {CHANNELS}) AS c FROM embeddings GROUP BY ALL)
      SELECT rec, n::INT AS n_channels, 4::BIGINT AS records, 1.0::DOUBLE AS record_s, 4.0::DOUBLE AS duration, CASE rec % 2 WHEN 1 THEN 24 ELSE 16 END AS bits, n::INT AS n_labels, 'C' || c AS first, {RATE}.0::DOUBLE AS rate, 'uV' AS unit FROM r""",
    "tiff_pixels": f"""{_X} SELECT rec, (row_number() OVER (PARTITION BY rec, idx ORDER BY length(label), label) - 1)::INT AS y, idx::INT AS x,
      {_r("CASE WHEN rec % 4 = 0 THEN x ELSE round_even((x + 4) * 8000, 0) / 65535 END")} AS value FROM v""",
    "ome_pages": f"""WITH r AS (SELECT vec_id // {CHANNELS} AS rec, count(*) AS n, 'C' || min(vec_id % {CHANNELS}) AS c FROM embeddings GROUP BY ALL),
      p AS (SELECT *, rec % 3 > 0 AS named FROM r, range(0, 2) g(page))
      SELECT rec, page::INT AS page, 64 AS width, CASE page WHEN 0 THEN n ELSE 1 END::INT AS height, CASE rec % 4 WHEN 0 THEN 32 ELSE 16 END AS bits, CASE rec % 4 WHEN 0 THEN 'float' ELSE 'uint' END AS format,
      CASE WHEN named THEN 'rec ' || rec END AS name, CASE WHEN named THEN 64 END AS size_x, CASE WHEN named THEN n::INT END AS size_y, CASE WHEN named THEN 0.5::DOUBLE END AS physical_size_x,
      CASE WHEN named THEN CASE rec % 4 WHEN 0 THEN 'float32' ELSE 'uint16' END END AS pixel_type, CASE WHEN named THEN c END AS channel FROM p""",
    "ctf_channels": """SELECT c_nationkey::BIGINT AS nation, (count(*) OVER n)::INT AS n_channels, (100 + c_nationkey)::INT AS n_samples, (c_nationkey + 1)::INT AS n_trials, 600.0::DOUBLE AS rate,
      (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS channel, 'M' || c_custkey AS name,
      CASE c_custkey % 4 WHEN 0 THEN 'MEG gradiometer' WHEN 1 THEN 'EEG' WHEN 2 THEN 'stimulus' ELSE 'reference magnetometer' END AS kind, c_acctbal::DOUBLE AS gain
      FROM customer WINDOW n AS (PARTITION BY c_nationkey)""",
    "cifti_models": """SELECT c_nationkey::BIGINT AS nation, (row_number() OVER w - 1)::INT AS model, (sum(c_custkey) OVER w - c_custkey)::BIGINT AS first, c_custkey::BIGINT AS count,
      'CIFTI_MODEL_TYPE_' || CASE c_custkey % 2 WHEN 1 THEN 'SURFACE' ELSE 'VOXELS' END AS type, 'CIFTI_STRUCTURE_' || c_mktsegment AS structure, CASE c_custkey % 2 WHEN 1 THEN c_custkey + 1000 END::BIGINT AS surface_vertices
      FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""",
    "gifti_surfaces": """SELECT c_nationkey::BIGINT AS nation, CASE c_nationkey % 2 WHEN 1 THEN 2 ELSE 1 END AS n_arrays, count(*)::INT AS n_vertices, CASE c_nationkey % 2 WHEN 1 THEN c_nationkey END::INT AS n_faces,
      arg_min(c_mktsegment, c_custkey) AS first_segment, least(3, count(*))::INT AS n_metadata FROM customer GROUP BY c_nationkey""",
    "events_tables": f"WITH {EVENTS_SQL} SELECT event_id, subject, onset, CASE WHEN event_id % 3 > 0 THEN duration ELSE 0 END::DOUBLE AS duration, CASE WHEN event_id % 5 > 0 THEN trial_type END AS trial_type FROM e",
    "gradient_files": """SELECT c_nationkey::BIGINT AS nation, count(*)::INT AS n_volumes, count(*) FILTER (c_custkey % 3 = 0)::INT AS n_b0, count(*) FILTER (c_custkey % 3 > 0)::INT AS n_diffusion, true AS unit_vectors
      FROM customer GROUP BY c_nationkey""",
    "sidecar_files": """WITH p AS (SELECT * FROM part WHERE p_partkey % 7 > 0)
      SELECT p_partkey::BIGINT AS part, 'SliceCount' AS key, p_size::VARCHAR AS value FROM p UNION ALL SELECT p_partkey, 'Manufacturer', p_brand FROM p UNION ALL SELECT p_partkey, 'SeriesDescription', p_name FROM p WHERE p_size % 2 = 0""",
    "results_files": """SELECT form, o_orderpriority AS pipeline, 'd, 1' AS dataset, 'a "b"' AS paradigm, o_orderstatus AS notes, count(*) AS n, 0::BIGINT AS sessions, round(sum(o_totalprice::DOUBLE), 2) AS score, max(o_orderkey) AS last
      FROM orders, (VALUES ('csv'), ('parquet')) f(form) GROUP BY ALL""",
    "head_shapes": """SELECT CASE s_suppkey % 4 WHEN 0 THEN 'nasion' WHEN 1 THEN 'EEG7' WHEN 2 THEN 'hpi_2' ELSE '' END AS label, s_suppkey::DOUBLE AS x, s_nationkey::DOUBLE AS y, s_acctbal::DOUBLE AS z,
      CASE s_suppkey % 4 WHEN 0 THEN 'fiducial' WHEN 1 THEN 'eeg' WHEN 2 THEN 'hpi' ELSE 'extra' END AS kind FROM supplier WHERE s_suppkey % 9 > 0""",
    "copied_files": "SELECT c_nationkey::BIGINT AS nation, count(*) AS n, sum(length(c_name))::BIGINT AS bytes FROM customer GROUP BY c_nationkey",
    "edf_marks": f"WITH {EVENTS_SQL} SELECT subject, event_id / 4.0::DOUBLE AS onset, 0.5::DOUBLE AS duration, trial_type AS description FROM e",
    "headerless_tables": """SELECT vec_id AS rec, (i - 1)::BIGINT AS row, (i - 1)::DOUBLE AS sample, CASE WHEN (i - 1) % 7 <> 3 THEN round(embedding[i]::DOUBLE * 1000) + 0.0 END AS cardiac
      FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)""",
    "channels_tables": """SELECT c_name AS name, ['EEG', 'ECG', 'TRIG', 'MISC', 'OTHER', 'HEOG'][c_custkey % 6 + 1] AS type, CASE WHEN c_custkey % 4 > 0 THEN 'uV' ELSE 'n/a' END AS units,
      CASE WHEN c_custkey % 5 = 0 THEN 'bad' ELSE 'good' END AS status, c_acctbal::DOUBLE AS low_cutoff, NULL::DOUBLE AS high_cutoff FROM customer""",
    "electrode_tables": "SELECT c_name AS name, c_custkey::DOUBLE AS x, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END::DOUBLE AS y, CASE WHEN c_custkey % 4 > 0 THEN 100 END::DOUBLE AS z FROM customer",
    "blood_readings": """SELECT CASE WHEN o_orderkey % 2 = 1 THEN 0.25 END::DOUBLE AS metabolite_parent_fraction, count(*) AS n, sum(CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey ELSE 0 END)::DOUBLE AS time,
      round(sum(o_totalprice::DOUBLE), 2) AS plasma, 0::BIGINT AS whole FROM orders GROUP BY ALL""",
    "asl_contexts": """SELECT c_nationkey::BIGINT AS nation, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS volume, ['control', 'label', 'm0scan'][length(c_mktsegment) % 3 + 1] AS volume_type FROM customer""",
    "description_files": """SELECT 'Name' AS field, 'Name is missing' AS message, count(*) AS n FROM supplier WHERE s_suppkey % 4 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'BIDSVersion', 'BIDSVersion is missing', count(*) FROM supplier WHERE s_suppkey % 5 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'GeneratedBy', 'a derivative names what made it', count(*) FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 HAVING count(*) > 0""",
    "coordsystem_files": "SELECT s_suppkey::BIGINT AS supplier, CASE WHEN s_suppkey % 2 = 0 THEN 'CapTrak' END AS system, 'mm' AS units, s_suppkey::DOUBLE AS x, s_acctbal::DOUBLE AS y, 0.5::DOUBLE AS z FROM supplier",
    "manifest_files": """SELECT ['train', 'val', 'test'][o_orderkey % 3 + 1] AS split, 'a "b", c' AS task, count(DISTINCT o_custkey) AS subjects, count(*) AS n, form, CASE form WHEN 'parquet' THEN 3 ELSE 5 END AS columns
      FROM orders, (VALUES ('csv'), ('parquet'), ('split')) f(form) GROUP BY ALL""",
}
