"""Headers of imaging and MEG formats as tables: CTF resources, CIFTI brain models, GIFTI arrays.

Each function takes a table of files (column path) and reads their headers in tasks; what follows the headers isn't read.
A file that isn't of its format raises an error that names it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import opened


def _rows_of(files: DataFrame, read: Callable, schema: str) -> DataFrame:
    """The rows that read(file, path) gives of each file."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            rows = []
            for path in b["path"]:
                with opened(path) as f:
                    try:
                        rows += [(path, *r) for r in read(f, path)]
                    except (struct.error, IndexError) as e:
                        raise ValueError(f"{path}: its header is cut short") from e
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path").mapInPandas(run, schema)


# Places in a CTF resource file (big-endian), and what follows the run description.
CTF = {"comment": (8 + 256 * 2, 256), "averages": 776, "time": (778, 255), "date": (1033, 255), "samples": 1288, "channels": 1292, "rate": 1296, "epoch_s": 1304, "trials": 1312, "before_trigger": 1316, "run_text": 1836, "run": 1844}
# Bytes of a channel's name and of its sensor record; the most channels that the header's two bytes can tell; sensor types.
CTF_NAME, CTF_SENSOR, CTF_CHANNELS = 32, 1328, 32_767
CTF_TYPES = {0: "reference magnetometer", 1: "reference gradiometer", 5: "MEG gradiometer", 9: "EEG", 11: "stimulus", 13: "head localisation", 17: "sample time", 18: "trigger", 20: "trigger"}
CTF_SCHEMA = "path string, n_channels int, n_samples int, n_trials int, rate double, before_trigger int, run_description string, channel int, name string, type int, kind string, proper_gain double, q_gain double, io_gain double, io_offset double, coils int, gradient_order int"


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").strip()


def _ctf(f, path: str):
    head = f.read(CTF["run"])
    if not head.startswith(b"MEG4"):
        raise ValueError(f"{path}: not a CTF resource file")
    number = lambda kind, at: struct.unpack_from(">" + kind, head, at)[0]
    samples, n, rate, trials, before = number("i", CTF["samples"]), number("h", CTF["channels"]), number("d", CTF["rate"]), number("h", CTF["trials"]), number("i", CTF["before_trigger"])
    if n <= 0 or not rate > 0:
        raise ValueError(f"{path}: {n} channels at a rate of {rate}")
    run = _text(f.read(number("i", CTF["run_text"])))
    for _ in range(struct.unpack(">h", f.read(2))[0]):
        parameters = struct.unpack(">diih", f.read(18))[3]
        f.seek(8 * parameters, 1)
    #: Names end at the first hyphen, after which the system's own number stands.
    names = [_text(f.read(CTF_NAME)).partition("-")[0] for _ in range(n)]
    for k in range(n):
        kind, _, _, proper, q, io, offset, coils, gradient = struct.unpack(">hhiddddhh", f.read(CTF_SENSOR)[:44])
        yield n, samples, trials, rate, before, run, k, names[k], kind, CTF_TYPES.get(kind, "other"), proper, q, io, offset, coils, gradient


def read_ctf(files: DataFrame) -> DataFrame:
    """A row for each channel of CTF resource files (.res4), with the header's samples, trials and rate."""
    return _rows_of(files, _ctf, CTF_SCHEMA)


def ctf_bytes(channels: list[tuple[str, int, float]], *, samples: int, trials: int, rate: float, run: str = "", filters: int = 0) -> bytes:
    """A resource file of channels: name, sensor type, gain; more than CTF_CHANNELS of them need several files."""
    if len(channels) > CTF_CHANNELS:
        raise ValueError(f"a CTF resource file has {CTF_CHANNELS} channels at most, not {len(channels)}")
    head = bytearray(CTF["run"])
    head[:8] = b"MEG41RS\0"
    for key, kind, value in (("samples", "i", samples), ("channels", "h", len(channels)), ("rate", "d", rate), ("epoch_s", "d", samples / rate), ("trials", "h", trials), ("run_text", "i", len(run) + 1)):
        struct.pack_into(">" + kind, head, CTF[key], value)
    out = bytes(head) + run.encode("latin-1") + b"\0" + struct.pack(">h", filters)
    out += b"".join(struct.pack(">diih", 60.0, 1, 1, k) + b"\0" * 8 * k for k in range(filters))
    out += b"".join(name.encode("latin-1").ljust(CTF_NAME, b"\0") for name, _, _ in channels)
    return out + b"".join(struct.pack(">hhiddddhh", kind, 0, 0, 1.0, gain, 1.0, 0.0, 1, 0).ljust(CTF_SENSOR, b"\0") for _, kind, gain in channels)


# Size of the second version's header of volume images, the code of a CIFTI extension, intents by codes.
IMAGE_HEADER, CIFTI_CODE = 540, 32
CIFTI_INTENTS = {3000: "ConnUnknown", 3001: "ConnDense", 3002: "ConnDenseSeries", 3003: "ConnParcels", 3004: "ConnParcelSries", 3006: "ConnDenseScalar", 3007: "ConnDenseLabel", 3008: "ConnParcelScalr", 3009: "ConnParcelDense", 3010: "ConnDenseParcel"}
CIFTI_SCHEMA = "path string, dimensions array<long>, intent int, intent_name string, code int, content string"


def _extensions(f, path: str):
    """Each extension between the header and the voxels, whose content may be long, as text."""
    head = f.read(IMAGE_HEADER + 4)
    size = struct.unpack_from("<i", head)[0]
    order = "<" if size in (348, IMAGE_HEADER) else ">"
    two = struct.unpack_from(order + "i", head)[0] == IMAGE_HEADER
    if not two and struct.unpack_from(order + "i", head)[0] != 348:
        raise ValueError(f"{path}: not a volume image")
    dims = struct.unpack_from(order + ("8q" if two else "8h"), head, 16 if two else 40)
    end = struct.unpack_from(order + "q", head, 168)[0] if two else int(struct.unpack_from(order + "f", head, 108)[0])
    intent = struct.unpack_from(order + "i", head, 504)[0] if two else struct.unpack_from(order + "h", head, 68)[0]
    at = (IMAGE_HEADER if two else 348) + 4
    if head[at - 4] == 0:
        return
    while at + 8 <= end:
        f.seek(at)
        length, code = struct.unpack(order + "ii", f.read(8))
        if length < 8:
            return
        yield [int(d) for d in dims[1 : max(0, min(7, dims[0])) + 1]], intent, CIFTI_INTENTS.get(intent, "Unknown"), code, f.read(length - 8).rstrip(b"\0").decode("utf-8", "replace")
        at += length


def read_extensions(files: DataFrame) -> DataFrame:
    """A row for each header extension of volume images: dimensions, intent, code, content."""
    return _rows_of(files, _extensions, CIFTI_SCHEMA)


_MODEL = "struct<_IndexOffset: bigint, _IndexCount: bigint, _ModelType: string, _BrainStructure: string, _SurfaceNumberOfVertices: bigint>"
_MATRIX = f"Matrix struct<MatrixIndicesMap: array<struct<_AppliesToMatrixDimension: string, _IndicesMapToDataType: string, _NumberOfSeriesPoints: bigint, BrainModel: array<{_MODEL}>, NamedMap: array<struct<MapName: string>>>>>"


def _matrix(content: Column) -> Column:
    return F.from_xml(content, _MATRIX, {"rowTag": "CIFTI", "attributePrefix": "_"}).Matrix.MatrixIndicesMap


def read_cifti(files: DataFrame) -> DataFrame:
    """A row for each index map of CIFTI files: dimensions, intent, what it maps, the matrix's dimensions it applies to, its models and names."""
    maps = read_extensions(files).where(F.col("code") == CIFTI_CODE).select("path", "dimensions", "intent", "intent_name", F.posexplode(_matrix(F.col("content"))).alias("map", "m"))
    return maps.select("path", "dimensions", "intent", "intent_name", "map", F.col("m._AppliesToMatrixDimension").alias("applies_to"), F.col("m._IndicesMapToDataType").alias("maps_to"), F.col("m._NumberOfSeriesPoints").alias("points"), F.col("m.BrainModel").alias("models"), F.col("m.NamedMap.MapName").alias("names"))


def brain_models(cifti: DataFrame) -> DataFrame:
    """A row for each brain model of read_cifti(): its first index, count, type, structure and surface's vertices."""
    m = cifti.select("path", F.posexplode("models").alias("model", "m"))
    return m.select("path", "model", F.col("m._IndexOffset").alias("first"), F.col("m._IndexCount").alias("count"), F.col("m._ModelType").alias("type"), F.col("m._BrainStructure").alias("structure"), F.col("m._SurfaceNumberOfVertices").alias("surface_vertices"))


def cifti_bytes(dims: list[int], xml: str, *, intent: int = 3002, other: bytes = b"", order: str = "<") -> bytes:
    """A CIFTI file without its matrix: a header of the second version and its extensions, another one before the XML."""
    head = bytearray(IMAGE_HEADER)
    struct.pack_into(order + "i", head, 0, IMAGE_HEADER)
    struct.pack_into(order + "8q", head, 16, len(dims), *dims, *[1] * (7 - len(dims)))
    struct.pack_into(order + "i", head, 504, intent)
    parts = [(6, other)] * bool(other) + [(CIFTI_CODE, xml.encode())]
    body = b"".join(struct.pack(order + "ii", len(d) + 8 + -(len(d) + 8) % 16, c) + d + b"\0" * (-(len(d) + 8) % 16) for c, d in parts)
    struct.pack_into(order + "q", head, 168, IMAGE_HEADER + 4 + len(body))
    return bytes(head) + b"\1\0\0\0" + body


# Intents of point sets and triangles.
POINTS, TRIANGLES = 1008, 1009
GIFTI_SCHEMA = "path string, arrays array<struct<intent:int,data_type:int,dims:array<int>,encoding:string,endian:string>>, metadata map<string,string>"
_CODES = {"NIFTI_INTENT_NONE": 0, "NIFTI_INTENT_TIME_SERIES": 2001, "NIFTI_INTENT_SHAPE": 2005, "NIFTI_INTENT_LABEL": 1002, "NIFTI_INTENT_POINTSET": POINTS, "NIFTI_INTENT_TRIANGLE": TRIANGLES, "NIFTI_TYPE_UINT8": 2, "NIFTI_TYPE_INT32": 8, "NIFTI_TYPE_FLOAT32": 16}


def _gifti(f, path: str):
    """The arrays' attributes and the file's own metadata; XML is parsed as it is read, and the arrays' data is passed over."""
    from xml.parsers import expat

    arrays, metadata, open_tags, text, pair = [], {}, [], [], {}
    code = lambda v: _CODES.get(v, int(v) if v.lstrip("-").isdigit() else 0)

    def start(tag, attributes):
        open_tags.append(tag)
        text.clear()
        if len(open_tags) == 1 and tag != "GIFTI":
            raise ValueError(f"{path}: not a GIFTI file")
        if tag == "DataArray":
            n = int(attributes.get("Dimensionality", 0)) or sum(f"Dim{k}" in attributes for k in range(6))
            arrays.append((code(attributes.get("Intent", "0")), code(attributes.get("DataType", "0")), [int(attributes.get(f"Dim{k}", 0)) for k in range(n)], attributes.get("Encoding"), attributes.get("Endian")))

    def end(tag):
        if open_tags[:2] == ["GIFTI", "MetaData"] and tag in ("Name", "Value"):
            pair[tag] = "".join(text).strip()
        if tag == "MD" and open_tags[:2] == ["GIFTI", "MetaData"]:
            metadata[pair.get("Name", "")] = pair.get("Value", "")
            pair.clear()
        open_tags.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: text.append(s) if open_tags[-1] in ("Name", "Value") else None
    try:
        while chunk := f.read(1 << 16):
            parser.Parse(chunk)
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        raise ValueError(f"{path}: not a GIFTI file: {e}") from e
    yield [dict(zip(("intent", "data_type", "dims", "encoding", "endian"), a, strict=True)) for a in arrays], metadata


def read_gifti(files: DataFrame) -> DataFrame:
    """A row for each GIFTI file: its arrays' attributes, metadata, and numbers of arrays, vertices and faces."""
    rows = _rows_of(files, _gifti, GIFTI_SCHEMA)
    first = lambda intent: F.get(F.transform(F.filter("arrays", lambda a: a.intent == intent), lambda a: F.get(a.dims, 0)), 0)
    return rows.select("path", F.size("arrays").alias("n_arrays"), first(POINTS).alias("n_vertices"), first(TRIANGLES).alias("n_faces"), "arrays", "metadata")


IMAGE_SCHEMA = "path string, version int, shape array<int>, zooms array<double>, data_type string, slope double, inter double, affine array<array<double>>"


def _image(f, path: str):
    import gzip

    import numpy as np

    from tessera.sources.recordings import VOXEL_TYPES, nifti_header

    raw = (gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f).read(IMAGE_HEADER)
    size = struct.unpack("<i", raw[:4])[0]
    if size not in (348, IMAGE_HEADER):
        raise ValueError(f"{path}: not a volume image")
    h = nifti_header(raw)
    kind = VOXEL_TYPES.get(h["code"])
    yield 2 if size == IMAGE_HEADER else 1, h["shape"], h["zooms"], np.dtype(kind).name if kind else "other", h["slope"], h["inter"], h["affine"]


def read_images(files: DataFrame) -> DataFrame:
    """A row for each volume image (.nii, or the .hdr of a pair): its header, with n_volumes, matrix, voxel_size and repetition_time.

    The repetition time is null where the header has none (0).
    """
    h = _rows_of(files, _image, IMAGE_SCHEMA)
    time = F.get("zooms", 3)
    derived = {"n_volumes": F.coalesce(F.get("shape", 3), F.lit(1)), "matrix": F.slice("shape", 1, 3), "voxel_size": F.slice("zooms", 1, 3), "repetition_time": F.when(time > 0, time)}
    return h.withColumns(derived)


EDF_SCHEMA = "path string, n_channels int, records long, record_s double, duration double, bits int, labels array<string>, units array<string>, rates array<double>, patient string, kind string"


def _edf(f, path: str):
    from tessera.sources.recordings import edf_header

    raw = f.read(256)
    if raw[:8].strip() not in (b"0", b"\xffBIOSEMI"):
        raise ValueError(f"{path}: not an EDF or BDF file")
    raw += f.read(256 * int(raw[252:256]))
    f.seek(0, 2)
    h = edf_header(raw, f.tell())
    rates = [n / h["record_s"] if h["record_s"] else 0.0 for n in h["samples"]]
    yield h["channels"], h["records"], h["record_s"], h["records"] * h["record_s"], 8 * h["sample_bytes"], h["label"], h["unit"], rates, h["patient"], h["kind"]


def read_edf_headers(files: DataFrame) -> DataFrame:
    """A row for each EDF or BDF file: channels, records, duration in seconds, bits, labels, units and rates."""
    return _rows_of(files, _edf, EDF_SCHEMA)
