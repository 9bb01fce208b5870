"""Microscopy images: TIFF files of either byte order and size, a block of pixels (strip or tile) for each row, and OME metadata.

Directories are a chain of offsets through the file; a task reads those of a file by seeking, never the pixels. Blocks are
dealt out by their bytes, so the strips of a large image are read by many tasks.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.files import opened
from tessera.sources.recordings import PART_BYTES, _batch

# Bytes and struct codes of the field types.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
# Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
#: Pages of a file at most, against chains that lead back.
MOST_PAGES = 1 << 20

PAGE_SCHEMA = "path string, page int, width int, height int, channels int, bits int, format string, compression int, blocks int, description string"
BLOCK_SCHEMA = "path string, page int, block int, x int, y int, width int, height int, channels int, values array<double>"


def _directory(f, order: str, big: bool, at: int) -> tuple[dict[int, object], int]:
    """The fields of a directory and the place of the next one (0: none)."""
    f.seek(at)
    count = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    size = 20 if big else 12
    raw = f.read(count * size + (8 if big else 4))
    found, wide = {}, 8 if big else 4
    for k in range(count):
        entry = raw[k * size : (k + 1) * size]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        n = struct.unpack(order + ("Q" if big else "I"), entry[4 : 4 + wide])[0]
        code = FIELDS.get(kind)
        if code is None:
            continue
        total = n * struct.calcsize("=" + code)
        data = entry[4 + wide :][:total]
        if total > wide:
            f.seek(struct.unpack(order + ("Q" if big else "I"), entry[4 + wide :])[0])
            data = f.read(total)
        if code == "s":
            found[tag] = data.rstrip(b"\0").decode("utf-8", "replace")
        else:
            found[tag] = list(struct.unpack(order + code * n, data))
    return found, struct.unpack(order + ("Q" if big else "I"), raw[count * size :])[0]


def directories(f) -> tuple[str, list[dict[int, object]]]:
    """Byte order and the directories of all pages of a file."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    pages, seen = [], set()
    while at and at not in seen and len(pages) < MOST_PAGES:
        seen.add(at)
        page, at = _directory(f, order, big, at)
        pages.append(page)
    return order, pages


def _one(page: dict, tag: int, default: int) -> int:
    return page[tag][0] if page.get(tag) else default


@dataclass
class Layout:
    """How a page's pixels are stored."""

    width: int
    height: int
    channels: int
    kind: np.dtype
    block_width: int
    block_height: int
    compression: int
    predictor: int
    planes: int
    places: list
    sizes: list

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)


def layout(page: dict, order: str) -> Layout:
    """The layout of a page; raises for samples that aren't whole bytes of one kind."""
    width, height, channels = _one(page, WIDTH, 0), _one(page, HEIGHT, 0), _one(page, SAMPLES, 1)
    bits, form = set(page.get(BITS, [1])), _one(page, FORMAT, 1)
    if len(bits) > 1 or not bits & {8, 16, 32, 64} or form not in (1, 2, 3):
        raise ValueError(f"samples of {sorted(bits)} bits in format {form} can't be read")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits.pop() // 8))
    tiled = TILES in page
    rows = _one(page, TILE_HEIGHT, height) if tiled else min(height, _one(page, STRIP_ROWS, height)) or 1
    planes = channels if _one(page, PLANAR, 1) == 2 else 1
    return Layout(width, height, channels, kind, _one(page, TILE_WIDTH, width) if tiled else max(1, width), rows, _one(page, COMPRESSION, 1), _one(page, PREDICTOR, 1), planes, page.get(TILES if tiled else STRIPS, []), page.get(TILE_BYTES if tiled else STRIP_BYTES, []))


def _unpacked_bits(data: bytes) -> bytes:
    """Runs of bytes: a count of literals, or 257 less the count of repeats."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def _unpacked_codes(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest first, for strings of a table that starts anew at code 256 and ends at 257."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, bits, held, at = list(first), 9, 0, 0, 0
    out, before = [], b""
    while True:
        while bits < width and at < len(data):
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        if bits < width:
            break
        code = held >> (bits - width)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("a damaged block of codes")
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before:
            table.append(before + word[:1])
        before = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


# Compressions that can be read.
UNPACK = {1: lambda x: x, 5: _unpacked_codes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}


def pixels(f, shape: Layout, block: int) -> tuple[int, int, np.ndarray]:
    """x, y and [row, column, channel] of one block (all its planes), cut at the image's edge; whole numbers as parts of 1."""
    per_plane = shape.across * shape.down
    x, y = block % shape.across * shape.block_width, block // shape.across * shape.block_height
    if shape.compression not in UNPACK:
        raise ValueError(f"compression {shape.compression} can't be read")
    planes = []
    for p in range(shape.planes):
        f.seek(shape.places[block + p * per_plane])
        data = UNPACK[shape.compression](f.read(shape.sizes[block + p * per_plane]))
        n = shape.channels if shape.planes == 1 else 1
        row = shape.block_width * n
        rows = min(shape.block_height, len(data) // (row * shape.kind.itemsize))
        v = np.frombuffer(data, shape.kind, rows * row).reshape(rows, shape.block_width, n)
        if shape.predictor == 2:
            v = np.cumsum(v, axis=1, dtype=shape.kind.newbyteorder("="))
        elif shape.predictor != 1:
            raise ValueError(f"predictor {shape.predictor} can't be read")
        planes.append(v[: shape.height - y, : shape.width - x].astype("f8"))
    out = np.concatenate(planes, axis=2)
    return x, y, out / float(np.iinfo(shape.kind).max) if shape.kind.kind in "ui" else out


@dataclass
class Blocks(InputPartition):
    """Blocks [first, last) of a page."""

    path: str
    page: int
    first: int
    last: int


class TiffReader(DataSourceReader):
    """Blocks of the pages of images."""

    def __init__(self, options) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.only = int(options["page"]) if "page" in options else None

    def partitions(self) -> list[Blocks]:
        out = []
        for p in self.paths:
            with opened(p) as f:
                order, pages = directories(f)
            for k, page in enumerate(pages):
                if self.only is None or k == self.only:
                    s = layout(page, order)
                    step = max(1, PART_BYTES // max(1, s.block_width * s.block_height * s.channels * s.kind.itemsize))
                    out += [Blocks(p, k, n, min(n + step, s.across * s.down)) for n in range(0, s.across * s.down, step)]
        return out or [Blocks("", 0, 0, 0)]

    def read(self, part: Blocks):
        if not part.path:
            return
        with opened(part.path) as f:
            order, pages = directories(f)
            s = layout(pages[part.page], order)
            for block in range(part.first, part.last):
                x, y, v = pixels(f, s, block)
                yield part.path, part.page, block, x, y, v.shape[1], v.shape[0], s.channels, v.ravel().tolist()


class TiffSource(DataSource):
    """format("tiff"): options path (comma-separated files), page."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def read_pages(files: DataFrame) -> DataFrame:
    """A row for each page of the images of files (column path), read by tasks; pixels stay where they are."""

    def pages(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path in b["path"]:
                with opened(path) as f:
                    order, found = directories(f)
                for k, page in enumerate(found):
                    form = {1: "uint", 2: "int", 3: "float"}.get(_one(page, FORMAT, 1), "other")
                    blocks = len(page.get(TILES, page.get(STRIPS, [])))
                    rows.append((path, k, _one(page, WIDTH, 0), _one(page, HEIGHT, 0), _one(page, SAMPLES, 1), _one(page, BITS, 1), form, _one(page, COMPRESSION, 1), blocks, page.get(DESCRIPTION)))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])

    return files.select("path").mapInPandas(pages, PAGE_SCHEMA)


def read_blocks(files: DataFrame) -> DataFrame:
    """The blocks of all images of files (column path): tasks plan them, then each is read by the task it was dealt to."""

    def planned(batches):
        import pyarrow as pa

        for b in batches:
            found = [(r.path, r.page, r.first, r.last) for p in b.column(0).to_pylist() for r in TiffReader({"path": p}).partitions() if r.path]
            if found:
                yield _batch(found, ["path", "page", "first", "last"], [pa.string(), *[pa.int32()] * 3])

    def read(batches):
        import pyarrow as pa

        kinds = [pa.string(), *[pa.int32()] * 7, pa.list_(pa.float64())]
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        for b in batches:
            for r in b.to_pylist():
                if rows := list(TiffReader({"path": r["path"]}).read(Blocks(**r))):
                    yield _batch(rows, names, kinds)

    ranges = files.select("path").mapInArrow(planned, "path string, page int, first int, last int")
    return ranges.repartition(F.xxhash64("path", "page", "first")).mapInArrow(read, BLOCK_SCHEMA)


def _element(name: str) -> str:
    return f'//*[name()="{name}" or name()="ome:{name}" or name()="OME:{name}"]'


def ome(description: Column) -> list[Column]:
    """name, sizes, physical sizes, pixel type and channel names of the OME-XML in a description; null where it isn't that."""
    xml = F.when(description.rlike("<(ome:|OME:)?OME"), description)
    text = lambda element, attribute: F.nullif(F.xpath_string(xml, F.lit(f"{_element(element)}[1]/@{attribute}")), F.lit(""))
    sizes = [text("Pixels", f"Size{c}").try_cast("int").alias(f"size_{c.lower()}") for c in "XYZCT"]
    physical = [text("Pixels", f"PhysicalSize{c}").try_cast("double").alias(f"physical_size_{c.lower()}") for c in "XYZ"]
    channels = F.xpath(xml, F.lit(f"{_element('Channel')}/@Name"))
    return [text("Image", "Name").alias("name"), *sizes, *physical, text("Pixels", "Type").alias("pixel_type"), channels.alias("channel_names")]


def tiff_bytes(pages: list[np.ndarray], *, order: str = "<", big: bool = False, rows: int = 0, tile: int = 0, compression: int = 1, predictor: int = 1, planar: bool = False, description: str = "") -> bytes:
    """An image of pages [row, column, channel], all of one type, in strips of `rows` rows or square tiles."""
    word = "Q" if big else "I"
    out = bytearray({"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for page in pages:
        x = page if page.ndim == 3 else page[:, :, None]
        h, w, n = x.shape
        bw, bh = (tile, tile) if tile else (w, rows or h)
        places, sizes = [], []
        for plane in [x[:, :, k : k + 1] for k in range(n)] if planar else [x]:
            for top in range(0, h, bh):
                for left in range(0, w, bw):
                    v = plane[top : top + bh, left : left + bw]
                    if tile:
                        v = np.pad(v, ((0, bh - v.shape[0]), (0, bw - v.shape[1]), (0, 0)))
                    if predictor == 2:
                        v = np.diff(v, axis=1, prepend=np.zeros_like(v[:, :1]))
                    data = v.astype(v.dtype.newbyteorder(order)).tobytes()
                    data = {1: lambda d: d, 8: zlib.compress, 32773: lambda d: b"".join(bytes([len(c) - 1]) + c for c in (d[k : k + 128] for k in range(0, len(d), 128)))}[compression](data)
                    places.append(len(out))
                    sizes.append(len(data))
                    out += data
        form = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [x.dtype.itemsize * 8] * n), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if n > 2 else 1]), (SAMPLES, 3, [n]), (PLANAR, 3, [2 if planar else 1]), (PREDICTOR, 3, [predictor]), (FORMAT, 3, [form] * n)]
        at, lengths = (TILES, TILE_BYTES) if tile else (STRIPS, STRIP_BYTES)
        fields += [(at, 16 if big else 4, places), (lengths, 16 if big else 4, sizes)] + ([(TILE_WIDTH, 4, [bw]), (TILE_HEIGHT, 4, [bh])] if tile else [(STRIP_ROWS, 4, [bh])])
        if description:
            fields.append((DESCRIPTION, 2, description.encode() + b"\0"))
        made = []
        for tag, kind, values in sorted(fields):
            data = values if kind == 2 else struct.pack(order + FIELDS[kind] * len(values), *values)
            if len(data) > (8 if big else 4):
                out += b"\0" * (len(out) % 2)
                place, data = len(out), data
                out += data
                data = struct.pack(order + word, place)
            made.append(struct.pack(order + "HH" + word, tag, kind, len(values)) + data.ljust(8 if big else 4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + (8 if big else 4)] = struct.pack(order + word, len(out))
        if big and link == 8:
            out[4:8] = struct.pack(order + "HH", 8, 0)
        out += struct.pack(order + ("Q" if big else "H"), len(made)) + b"".join(made)
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)


def register(spark) -> None:
    """Makes the formats known to a session."""
    spark.dataSource.register(TiffSource)
