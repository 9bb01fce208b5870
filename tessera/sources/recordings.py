"""Recordings as data sources: EDF and BDF, multiplexed raw files with a text header, volume images.

A partition is a range of records, samples or volumes of one file, so a long recording is read by many tasks,
each of which seeks to its own bytes; channel and time options cut what is read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import matlab
from tessera.sources.files import opened

CHUNK_SCHEMA = "path string, channel int, label string, rate double, start bigint, values array<double>"
#: Bytes that a task reads.
PART_BYTES = 16 << 20


@dataclass
class Range(InputPartition):
    """Records [first, last) of a file."""

    path: str
    first: int
    last: int


def _chosen(labels: list[str], options) -> list[int]:
    """Channels by include and then exclude, comma-separated names."""
    include = [x.strip() for x in options.get("channels", "").split(",") if x.strip()]
    exclude = {x.strip() for x in options.get("exclude", "").split(",") if x.strip()}
    return [k for k, n in enumerate(labels) if (not include or n in include) and n not in exclude]


def planned_ranges(files: DataFrame, reader: Callable[[str], DataSourceReader]) -> DataFrame:
    """path, first, last: the ranges that the reader of each file plans, worked out in tasks and dealt to tasks."""

    def planned(batches):
        import pyarrow as pa

        for b in batches:
            found = [r for p in b.column(0).to_pylist() for r in reader(p).partitions() if r.path]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r.path for r in found], pa.string()), pa.array([r.first for r in found], pa.int64()), pa.array([r.last for r in found], pa.int64())], names=["path", "first", "last"])

    return files.select("path").mapInArrow(planned, "path string, first long, last long").repartition(F.xxhash64("path", "first"))


def _batch(rows: list[tuple], names: list[str], kinds: list):
    """An Arrow batch of rows."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def edf_header(raw: bytes, size: int | None = None) -> dict:
    """The header of an EDF or BDF file from its first bytes; an unknown number of records follows from the size."""
    text = lambda a, n: raw[a : a + n].decode("latin-1").strip()
    n = int(text(252, 4))
    columns, at = {}, 256
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8), ("dig_max", 8), ("filter", 80), ("samples", 8)):
        columns[name] = [text(at + k * width, width) for k in range(n)]
        at += n * width
    width = 3 if raw[:1] == b"\xff" else 2
    h = {"channels": n, "header_bytes": int(text(184, 8)), "records": int(text(236, 8)), "record_s": float(text(244, 8)), "sample_bytes": width, "patient": text(8, 80), "kind": text(192, 44), **columns}
    for c in ("phys_min", "phys_max", "dig_min", "dig_max"):
        h[c] = [float(x) for x in columns[c]]
    h["samples"] = [int(x) for x in columns["samples"]]
    h["record_bytes"] = sum(h["samples"]) * width
    if h["records"] < 0 and size is not None:
        h["records"] = (size - h["header_bytes"]) // max(1, h["record_bytes"])
    return h


def _edf_header(path: str) -> dict:
    with opened(path) as f:
        raw = f.read(256)
        raw += f.read(256 * int(raw[252:256]))
        f.seek(0, 2)
        return edf_header(raw, f.tell())


def edf_blocks(data: bytes, h: dict) -> list[np.ndarray]:
    """Each channel's digital samples in whole records."""
    n = len(data) // max(1, h["record_bytes"])
    if h["sample_bytes"] == 2:
        flat = np.frombuffer(data[: n * h["record_bytes"]], "<i2").reshape(n, -1)
    else:
        b = np.frombuffer(data[: n * h["record_bytes"]], "u1").reshape(n, -1, 3).astype("i4")
        flat = b[..., 0] | b[..., 1] << 8 | b[..., 2] << 16
        flat -= (flat & 0x800000) << 1
    ends = np.cumsum(h["samples"])
    return [flat[:, e - s : e].reshape(-1) for e, s in zip(ends, h["samples"], strict=True)]


def annotation_lists(data: bytes) -> list[tuple[float, float, str]]:
    """onset, duration, text of the timed annotations in a channel's bytes; those without text are the records' own times."""
    out = []
    for entry in data.split(b"\x00"):
        stamp, *texts = entry.split(b"\x14")
        onset, _, duration = stamp.partition(b"\x15")
        try:
            at = float(onset)
        except ValueError:
            continue
        out += [(at, float(duration or 0), t.decode("utf-8", "replace")) for t in texts if t]
    return out


class EdfReader(DataSourceReader):
    """Chunks of channels, or annotations."""

    def __init__(self, options, annotations: bool) -> None:
        self.options, self.annotations = options, annotations
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[Range]:
        out = []
        for p in self.paths:
            h = _edf_header(p)
            a = int(float(self.options.get("start", 0)) / h["record_s"]) if h["record_s"] else 0
            b = min(h["records"], int(-(-float(self.options["end"]) // h["record_s"]))) if "end" in self.options and h["record_s"] else h["records"]
            step = max(1, PART_BYTES // max(1, h["record_bytes"]))
            out += [Range(p, k, min(k + step, b)) for k in range(a, b, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        h = _edf_header(part.path)
        with opened(part.path) as f:
            f.seek(h["header_bytes"] + part.first * h["record_bytes"])
            data = f.read((part.last - part.first) * h["record_bytes"])
        marks = [k for k, n in enumerate(h["label"]) if n in ("EDF Annotations", "BDF Annotations")]
        if self.annotations:
            starts = np.cumsum([0, *h["samples"]]) * h["sample_bytes"]
            for r in range(len(data) // max(1, h["record_bytes"])):
                at = r * h["record_bytes"]
                for k in marks:
                    for onset, duration, text in annotation_lists(data[at + starts[k] : at + starts[k + 1]]):
                        yield part.path, onset, duration, text
            return
        blocks = edf_blocks(data, h)
        for k in _chosen(h["label"], self.options):
            if k in marks:
                continue
            gain = (h["phys_max"][k] - h["phys_min"][k]) / (h["dig_max"][k] - h["dig_min"][k])
            values = blocks[k] * gain + (h["phys_min"][k] - h["dig_min"][k] * gain)
            rate, first = h["samples"][k] / h["record_s"] if h["record_s"] else 0.0, part.first * h["samples"][k]
            low = max(0, int(float(self.options.get("start", 0)) * rate + 0.5) - first)
            high = max(low, min(len(values), int(float(self.options["end"]) * rate + 0.5) - first)) if "end" in self.options else len(values)
            if high > low:
                yield part.path, k, h["label"][k], rate, first + low, values[low:high].tolist()


class EdfSource(DataSource):
    """format("edf"): options path (comma-separated files), channels, exclude, start, end (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options, False)


class EdfAnnotationSource(DataSource):
    """format("edf_annotations"): the timed annotations of EDF+ and BDF+ files."""

    @classmethod
    def name(cls) -> str:
        return "edf_annotations"

    def schema(self) -> str:
        return "path string, onset double, duration double, description string"

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options, True)


def edf_bytes(labels: list[str], signals: np.ndarray, rate: int, *, bdf: bool = False, limit: float = 3200.0) -> bytes:
    """A file of one-second records, for round trips: signals [channel, sample] within +-limit."""
    n, total = signals.shape
    low, high = (-(1 << 23), (1 << 23) - 1) if bdf else (-32768, 32767)
    records = total // rate
    fixed = lambda x, w: str(x).ljust(w)[:w].encode("latin-1")
    head = (b"\xffBIOSEMI" if bdf else fixed("0", 8)) + fixed("X", 80) + fixed("X", 80) + fixed("01.01.24", 8) + fixed("00.00.00", 8) + fixed(256 * (n + 1), 8) + fixed("", 44) + fixed(records, 8) + fixed(1, 8) + fixed(n, 4)
    for values, w in ((labels, 16), ([""] * n, 80), (["uV"] * n, 8), ([-limit] * n, 8), ([limit] * n, 8), ([low] * n, 8), ([high] * n, 8), ([""] * n, 80), ([rate] * n, 8), ([""] * n, 32)):
        head += b"".join(fixed(v, w) for v in values)
    digital = np.rint((signals[:, : records * rate] + limit) * (high - low) / (2 * limit) + low).astype("<i4")
    blocks = digital.reshape(n, records, rate).transpose(1, 0, 2)
    return head + (blocks.astype("<i2").tobytes() if not bdf else np.ascontiguousarray(blocks).view("u1").reshape(-1, 4)[:, :3].tobytes())


def edf_annotation_bytes(marks: list[tuple[float, str]], duration: float, *, per_record: int = 8) -> bytes:
    """An EDF+ file of annotations alone (onset, text), for round trips: records without a time of their own hold per_record marks."""
    marks = sorted(marks)
    lists = [b"".join(f"+{o:g}\x15{duration:g}\x14{t}\x14".encode() + b"\0" for o, t in marks[k : k + per_record]) for k in range(0, len(marks), per_record)]
    starts = [f"+{k}\x14\x14".encode() + b"\0" for k in range(len(lists))]
    size = max((len(s) + len(x) for s, x in zip(starts, lists, strict=True)), default=2)
    size += size % 2
    fixed = lambda x, w: str(x).ljust(w)[:w].encode("latin-1")
    head = fixed("0", 8) + fixed("X", 80) + fixed("X", 80) + fixed("01.01.24", 8) + fixed("00.00.00", 8) + fixed(512, 8) + fixed("EDF+C", 44) + fixed(len(lists), 8) + fixed(0, 8) + fixed(1, 4)
    for value, w in (("EDF Annotations", 16), ("", 80), ("", 8), (-1, 8), (1, 8), (-32768, 8), (32767, 8), ("", 80), (size // 2, 8), ("", 32)):
        head += fixed(value, w)
    return head + b"".join((s + x).ljust(size, b"\0") for s, x in zip(starts, lists, strict=True))


def read_annotations(files: DataFrame) -> DataFrame:
    """path, onset, duration, description of the timed annotations of all EDF+ and BDF+ files among files (column path)."""

    def read(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.float64(), pa.float64(), pa.string()]
        for b in batches:
            for r in b.to_pylist():
                if rows := list(EdfReader({"path": r["path"]}, True).read(Range(**r))):
                    yield _batch(rows, ["path", "onset", "duration", "description"], kinds)

    known = files.where(F.lower("path").rlike("[.](edf|bdf)$"))
    return planned_ranges(known, lambda p: EdfReader({"path": p}, True)).mapInArrow(read, "path string, onset double, duration double, description string")


def vhdr(text: str) -> dict:
    """The header of a multiplexed raw recording: file, orientation, format, interval and channels with their resolutions."""
    section, values, channels = "", {}, []
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1]
        elif "=" in line and not line.startswith(";"):
            k, _, v = line.partition("=")
            if section == "Channel Infos":
                name, _, resolution, *_ = [*v.split(","), "", ""]
                channels.append((name.replace("\\1", ","), float(resolution or 1)))
            else:
                values[k.strip()] = v.strip()
    return {**values, "channels": channels, "rate": 1e6 / float(values["SamplingInterval"])}


class RawReader(DataSourceReader):
    """Chunks of the channels of a raw file named by its header."""

    TYPES = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}

    def __init__(self, options) -> None:
        self.options = options
        self.paths = [p for p in options["path"].split(",") if p]

    def _header(self, path: str) -> tuple[dict, str, np.dtype]:
        with opened(path) as f:
            h = vhdr(f.read().decode("utf-8", "replace"))
        return h, path.rpartition("/")[0] + "/" + h["DataFile"], np.dtype(self.TYPES[h.get("BinaryFormat", "INT_16")])

    def partitions(self) -> list[Range]:
        out = []
        for p in self.paths:
            h, data, kind = self._header(p)
            with opened(data) as f:
                f.seek(0, 2)
                n = f.tell() // (kind.itemsize * len(h["channels"]))
            step = max(1, PART_BYTES // (kind.itemsize * len(h["channels"])))
            a = int(float(self.options.get("start", 0)) * h["rate"] + 0.5)
            b = min(n, int(float(self.options["end"]) * h["rate"] + 0.5)) if "end" in self.options else n
            out += [Range(p, k, min(k + step, b)) for k in range(a, b, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        h, data, kind = self._header(part.path)
        n, samples = len(h["channels"]), part.last - part.first
        chosen = _chosen([c for c, _ in h["channels"]], self.options)
        with opened(data) as f:
            f.seek(0, 2)
            total = f.tell() // (kind.itemsize * n)
        block = _float_block(data, n, total, part.first, samples, h.get("DataOrientation", "MULTIPLEXED").upper() != "MULTIPLEXED", kind)
        columns = {k: block[k] for k in chosen}
        for k, x in columns.items():
            name, resolution = h["channels"][k]
            yield part.path, k, name, h["rate"], part.first, (x.astype("f8") * resolution).tolist()


class RawSource(DataSource):
    """format("brainvision"): options path (comma-separated headers), channels, exclude, start, end (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "brainvision"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)


def _scalar(x, default: float = 0.0) -> float:
    return float(np.ravel(x)[0]) if isinstance(x, np.ndarray) and x.size else default


def set_header(path: str) -> dict:
    """The header of an EEGLAB data set: labels, rate, samples (of all trials), trials, where its numbers are and in what order.

    The numbers are in a file beside it (float32, by samples in .fdt, by channels in .dat) or in the file itself. Fields
    are variables of their own or those of the record EEG.
    """
    with opened(path) as f:
        v = matlab.variables(f)
    eeg = v["EEG"][0] if isinstance(v.get("EEG"), list) and v["EEG"] else v
    n, points, trials = int(_scalar(eeg.get("nbchan"))), int(_scalar(eeg.get("pnts"))), int(_scalar(eeg.get("trials"), 1.0))
    rate = _scalar(eeg.get("srate"))
    if n <= 0 or points <= 0 or rate <= 0:
        raise ValueError(f"{path}: nbchan {n}, pnts {points} and srate {rate} must be above 0")
    places = eeg.get("chanlocs")
    labels = [str(x.get("labels", "")) for x in places] if isinstance(places, list) else []
    labels = labels if len(labels) == n else [f"EEG{k:03d}" for k in range(1, n + 1)]
    data = eeg.get("data", "")
    if not isinstance(data, str):
        return {"labels": labels, "rate": rate, "samples": points * trials, "trials": trials, "inside": data, "by_channel": False}
    name = data or str(eeg.get("datfile", "")) or path.rpartition("/")[2].removesuffix(".set") + ".fdt"
    file = (path.rpartition("/")[0] + "/" if "/" in path else "") + name.replace("\\", "/").rpartition("/")[2]
    return {"labels": labels, "rate": rate, "samples": points * trials, "trials": trials, "file": file, "by_channel": name.endswith(".dat")}


class SetReader(DataSourceReader):
    """Chunks of the channels of EEGLAB data sets."""

    def __init__(self, options) -> None:
        self.options = options
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[Range]:
        out = []
        for p in self.paths:
            h = set_header(p)
            n, inside = len(h["labels"]), h.get("inside")
            if "file" in h:
                with opened(h["file"]) as f:
                    f.seek(0, 2)
                    size = f.tell()
                if size < 4 * n * h["samples"]:
                    raise ValueError(f"{h['file']}: {size} bytes, but {n} channels of {h['samples']} samples")
            a = int(float(self.options.get("start", 0)) * h["rate"] + 0.5)
            b = min(h["samples"], int(float(self.options["end"]) * h["rate"] + 0.5)) if "end" in self.options else h["samples"]
            #: A deflated element is inflated from its start by each task, so there is one.
            whole = isinstance(inside, np.ndarray) or (inside is not None and inside.element is not None)
            step = max(1, b - a) if whole else max(1, PART_BYTES // (4 * n))
            out += [Range(p, k, min(k + step, b)) for k in range(a, b, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        h = set_header(part.path)
        n, inside = len(h["labels"]), h.get("inside")
        chosen, step = _chosen(h["labels"], self.options), max(1, PART_BYTES // (4 * n))
        for first in range(part.first, part.last, step):
            m = min(step, part.last - first)
            if isinstance(inside, np.ndarray):
                block = inside.reshape(n, -1, order="F")[:, first : first + m]
            elif inside is not None:
                with opened(part.path) as f:
                    block = matlab.read_place(f, inside, first * n, m * n).reshape(-1, n).T
            else:
                block = _float_block(h["file"], n, h["samples"], first, m, h["by_channel"], np.dtype("<f4"))
            for k in chosen:
                yield part.path, k, h["labels"][k], h["rate"], first, block[k].astype("f8").tolist()


def _float_block(path: str, n: int, total: int, first: int, m: int, by_channel: bool, kind: np.dtype) -> np.ndarray:
    """[channel, sample] of samples [first, first + m): one seek where samples follow each other, one for each channel else."""
    with opened(path) as f:
        if not by_channel:
            f.seek(first * n * kind.itemsize)
            return np.frombuffer(f.read(m * n * kind.itemsize), kind).reshape(-1, n).T
        out = []
        for k in range(n):
            f.seek((k * total + first) * kind.itemsize)
            out.append(np.frombuffer(f.read(m * kind.itemsize), kind))
        return np.array(out)


class SetSource(DataSource):
    """format("eeglab"): options path (comma-separated .set files), channels, exclude, start, end (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "eeglab"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> SetReader:
        return SetReader(self.options)


def set_files(name: str, labels: list[str], rate: float, signals: np.ndarray, *, inside: bool = False, record: bool = True, deflated: bool = False, order: str = "<") -> dict[str, bytes]:
    """The files of an EEGLAB data set of signals [channel, sample], by name: a .set, and a .fdt where its numbers aren't inside."""
    x = np.asarray(signals, "f4")
    eeg = {"setname": name, "nbchan": float(len(x)), "trials": 1.0, "pnts": float(x.shape[1]), "srate": float(rate), "data": x if inside else f"{name}.fdt"}
    eeg["chanlocs"] = [{"labels": n, "X": float(k)} for k, n in enumerate(labels)]
    out = {f"{name}.set": matlab.mat_bytes({"EEG": [eeg]} if record else eeg, deflated=deflated, order=order)}
    return out if inside else out | {f"{name}.fdt": x.astype("<f4").tobytes(order="F")}


def raw_files(name: str, labels: list[str], rate: float, signals: np.ndarray, *, by_channel: bool = False, kind: str = "IEEE_FLOAT_32", resolution: float = 1.0) -> dict[str, bytes]:
    """The header and data file of a raw recording of signals [channel, sample], by name."""
    channels = "".join(f"Ch{k}={n.replace(',', chr(92) + '1')},,{resolution},uV\n" for k, n in enumerate(labels, 1))
    head = f"Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile={name}.eeg\nDataFormat=BINARY\nDataOrientation={'VECTORIZED' if by_channel else 'MULTIPLEXED'}\n"
    head += f"NumberOfChannels={len(labels)}\nSamplingInterval={1e6 / rate}\n[Binary Infos]\nBinaryFormat={kind}\n[Channel Infos]\n{channels}"
    x = np.asarray(signals, "f8") / resolution
    x = (x if RawReader.TYPES[kind][1] == "f" else np.rint(x)).astype(RawReader.TYPES[kind])
    return {f"{name}.vhdr": head.encode(), f"{name}.eeg": x.tobytes(order="C" if by_channel else "F")}


#: Endings of recordings and the readers of their formats.
READERS = {".edf": lambda o: EdfReader(o, False), ".bdf": lambda o: EdfReader(o, False), ".vhdr": RawReader, ".set": SetReader}


def _reader(path: str, options) -> DataSourceReader:
    ending = path[path.rfind(".") :].lower()
    if ending not in READERS:
        raise ValueError(f"no reader of recordings for {path}")
    return READERS[ending]({**options, "path": path})


class RecordingReader(DataSourceReader):
    """Each file's own ranges, by the reader of its format."""

    def __init__(self, options) -> None:
        self.options = dict(options)
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[Range]:
        return [r for p in self.paths for r in _reader(p, self.options).partitions() if r.path] or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.path:
            yield from _reader(part.path, self.options).read(part)


class RecordingSource(DataSource):
    """format("recording"): EDF, BDF, BrainVision and EEGLAB files as one table; options path, channels, exclude, start, end."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


def read_recordings(files: DataFrame, **options: str) -> DataFrame:
    """The chunks of all recordings among files (column path), of any format; other files are left out.

    Tasks read the headers and plan the ranges, which are then dealt to tasks that read them: for folders with more files
    than a driver should open.
    """

    def chunks(batches):
        import pyarrow as pa

        names = ["path", "channel", "label", "rate", "start", "values"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
        for b in batches:
            for r in b.to_pylist():
                if rows := list(_reader(r["path"], options).read(Range(**r))):
                    yield _batch(rows, names, kinds)

    known = files.where(F.lower("path").rlike("[.](edf|bdf|vhdr|set)$"))
    return planned_ranges(known, lambda p: _reader(p, options)).mapInArrow(chunks, CHUNK_SCHEMA)


# Codes of the numeric types of volume images.
VOXEL_TYPES = {2: "<u1", 4: "<i2", 8: "<i4", 16: "<f4", 64: "<f8", 256: "<i1", 512: "<u2", 768: "<u4", 1024: "<i8", 1280: "<u8"}


def nifti_header(raw: bytes) -> dict:
    """The header of a volume image, either version: shape, zooms, type, offset, scaling and affine."""
    two = struct.unpack("<i", raw[:4])[0] == 540
    dims = struct.unpack("<8q", raw[16:80]) if two else struct.unpack("<8h", raw[40:56])
    zooms = struct.unpack("<8d", raw[104:168]) if two else struct.unpack("<8f", raw[76:108])
    code = struct.unpack("<h", raw[12:14])[0] if two else struct.unpack("<h", raw[70:72])[0]
    offset = struct.unpack("<q", raw[168:176])[0] if two else int(struct.unpack("<f", raw[108:112])[0])
    slope, inter = struct.unpack("<2d", raw[176:192]) if two else struct.unpack("<2f", raw[112:120])
    if two:
        qcode, scode = struct.unpack("<2i", raw[344:352])
        quat, rows = struct.unpack("<6d", raw[352:400]), struct.unpack("<12d", raw[400:496])
    else:
        qcode, scode = struct.unpack("<2h", raw[252:256])
        quat, rows = struct.unpack("<6f", raw[256:280]), struct.unpack("<12f", raw[280:328])
    if scode > 0:
        affine = [list(rows[k : k + 4]) for k in (0, 4, 8)]
    elif qcode > 0:
        b, c, d, *shift = quat
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        turn = [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
        flip = -1 if zooms[0] < 0 else 1
        affine = [[turn[i][0] * zooms[1], turn[i][1] * zooms[2], turn[i][2] * zooms[3] * flip, shift[i]] for i in range(3)]
    else:
        affine = [[zooms[i + 1] if i == j else 0.0 for j in range(3)] + [0.0] for i in range(3)]
    n = max(0, min(7, dims[0]))
    return {"shape": list(dims[1 : n + 1]), "zooms": list(zooms[1 : n + 1]), "code": code, "offset": offset, "slope": slope or 1.0, "inter": inter, "affine": [*affine, [0.0, 0.0, 0.0, 1.0]]}


def _image(path: str):
    """A header file, or an image that holds its header, unpacked as it is read."""
    f = opened(path)
    if path.endswith(".gz"):
        import gzip

        return gzip.GzipFile(fileobj=f)
    return f


def _voxels_of(path: str) -> str:
    """The file of an image's voxels: beside its header (.hdr and .img, packed or not), else the same."""
    for head, data in ((".hdr", ".img"), (".hdr.gz", ".img.gz")):
        if path.endswith(head):
            return path.removesuffix(head) + data
    return path


class NiftiReader(DataSourceReader):
    """Volumes of images; a filter on t, or the option volume, reads these alone."""

    def __init__(self, options) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.only = int(options["volume"]) if "volume" in options else None

    def partitions(self) -> list[Range]:
        out = []
        for p in self.paths:
            with _image(p) as f:
                h = nifti_header(f.read(540))
            n = h["shape"][3] if len(h["shape"]) > 3 else 1
            voxels = int(np.prod(h["shape"][:3])) * np.dtype(VOXEL_TYPES[h["code"]]).itemsize
            step = n if p.endswith(".gz") else max(1, PART_BYTES // max(1, voxels))
            a, b = (0, n) if self.only is None else (self.only, min(self.only + 1, n))
            out += [Range(p, k, min(k + step, b)) for k in range(a, b, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        with _image(part.path) as f:
            h = nifti_header(f.read(540))
        kind = np.dtype(VOXEL_TYPES[h["code"]])
        with _image(_voxels_of(part.path)) as f:
            voxels = int(np.prod(h["shape"][:3]))
            f.seek(h["offset"] + part.first * voxels * kind.itemsize)
            for t in range(part.first, part.last):
                x = np.frombuffer(f.read(voxels * kind.itemsize), kind).astype("f8")
                yield part.path, t, (x * h["slope"] + h["inter"]).tolist()


class NiftiSource(DataSource):
    """format("nifti"): options path (comma-separated .nii or .hdr files, packed or not), volume."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return "path string, t int, voxels array<double>"

    def reader(self, schema) -> NiftiReader:
        return NiftiReader(self.options)


def nifti_files(name: str, data: np.ndarray, *, slope: float = 1.0, inter: float = 0.0, zooms: tuple = (1.0, 1.0, 1.0, 1.0), pair: bool = False, packed: bool = False, two: bool = False) -> dict[str, bytes]:
    """An image of data [x, y, z, t] by file name: one file, or a header and its voxels; two: the second version's header."""
    import gzip

    code = {np.dtype(v): k for k, v in VOXEL_TYPES.items()}[data.dtype.newbyteorder("<")]
    shape = [*data.shape, *[1] * (7 - data.ndim)]
    size = 540 if two else 348
    h, offset = bytearray(size + 4), 0 if pair else size + 4
    if two:
        h[:12] = struct.pack("<i", 540) + (b"ni2\0" if pair else b"n+2\0") + b"\r\n\x1a\n"
        struct.pack_into("<2h8q", h, 12, code, data.itemsize * 8, data.ndim, *shape)
        struct.pack_into("<8d", h, 104, 1.0, *zooms, 0, 0, 0)
        struct.pack_into("<q2d", h, 168, offset, slope, inter)
    else:
        struct.pack_into("<i", h, 0, 348)
        struct.pack_into("<8h", h, 40, data.ndim, *shape)
        struct.pack_into("<3h8f3f", h, 70, code, data.itemsize * 8, 0, 1.0, *zooms, 0, 0, 0, offset, slope, inter)
        h[344:348] = b"ni1\0" if pair else b"n+1\0"
    voxels = data.astype(data.dtype.newbyteorder("<")).tobytes(order="F")
    made = {f"{name}.hdr": bytes(h[:size]), f"{name}.img": voxels} if pair else {f"{name}.nii": bytes(h) + voxels}
    return {f"{n}.gz": gzip.compress(d) for n, d in made.items()} if packed else made


def read_volumes(files: DataFrame) -> DataFrame:
    """path, t, voxels of all images among files (column path): tasks plan the volumes, which are then dealt to tasks."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                for row in NiftiReader({"path": r["path"]}).read(Range(**r)):
                    yield _batch([row], ["path", "t", "voxels"], [pa.string(), pa.int32(), pa.list_(pa.float64())])

    known = files.where(F.col("path").rlike("[.](nii|hdr)([.]gz)?$"))
    return planned_ranges(known, lambda p: NiftiReader({"path": p})).mapInArrow(read, "path string, t int, voxels array<double>")


def register(spark) -> None:
    """Makes the formats known to a session."""
    for source in (EdfSource, EdfAnnotationSource, RawSource, SetSource, RecordingSource, NiftiSource):
        spark.dataSource.register(source)
