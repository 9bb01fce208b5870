"""Files of tagged, possibly deflated elements (MAT version 5): a walker that leaves large arrays where they are."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Numpy types of the element types that hold numbers.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
#: Element types of matrices, deflated elements and text; classes of matrices.
MATRIX, DEFLATED, TEXT = 14, 15, {2: "latin-1", 16: "utf-8", 17: "utf-16", 18: "utf-32", 1: "latin-1", 4: "utf-16"}
CELL, STRUCT, OBJECT, CHARS, SPARSE = 1, 2, 3, 4, 5
#: Bytes of an array's numbers that are read into memory while walking; longer ones become a Place.
HELD = 1 << 20


@dataclass
class Place:
    """Numbers left in the file: from byte `at` of the element that starts at `element` (deflated), or of the file (None)."""

    element: int | None
    at: int
    kind: str
    shape: list[int]


class _Plain:
    """A file from its present place on."""

    element = None

    def __init__(self, file) -> None:
        self.file = file

    def read(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> None:
        self.file.seek(n, 1)

    def tell(self) -> int:
        return self.file.tell()


class _Inflated:
    """What a deflated element holds, forwards only, a piece at a time."""

    PIECE = 1 << 16

    def __init__(self, file, element: int, size: int) -> None:
        self.file, self.element, self.left = file, element, size
        self.inflate, self.held, self.at = zlib.decompressobj(), b"", 0

    def read(self, n: int) -> bytes:
        out, want = [], n
        while want:
            if not self.held:
                data = self.inflate.unconsumed_tail
                if not data:
                    data = self.file.read(min(self.PIECE, self.left))
                    self.left -= len(data)
                self.held = self.inflate.decompress(data, self.PIECE)
                if not self.held:
                    if data:
                        continue
                    break
            out.append(self.held[:want])
            self.held = self.held[want:]
            want -= len(out[-1])
        self.at += n - want
        return b"".join(out)

    def skip(self, n: int) -> None:
        while n > 0:
            n -= len(self.read(min(n, self.PIECE))) or n

    def tell(self) -> int:
        return self.at


def _tag(stream, order: str):
    """type, size, own bytes (of a small element) and padding after the data; None at the end."""
    raw = stream.read(8)
    if len(raw) < 8:
        return None
    first, size = struct.unpack(order + "II", raw)
    if first >> 16:
        return first & 0xFFFF, first >> 16, raw[4 : 4 + (first >> 16)], 0
    return first, size, None, -size % 8


def _data(stream, tag) -> bytes:
    kind, size, own, padding = tag
    if own is not None:
        return own
    out = stream.read(size)
    stream.skip(padding)
    return out


def _numbers(stream, order: str, shape: list[int]):
    """A numeric array in column order, or its Place."""
    tag = _tag(stream, order)
    kind = order + NUMBERS[tag[0]]
    if tag[2] is None and tag[1] > HELD:
        place = Place(stream.element, stream.tell(), kind, shape)
        stream.skip(tag[1] + tag[3])
        return place
    return np.frombuffer(_data(stream, tag), kind).reshape(shape, order="F")


def _matrix(stream, order: str):
    """name and value of the matrix whose tag was read: an array or Place, text, a list of cells, or a list of records."""
    flags = _data(stream, _tag(stream, order))
    kind = struct.unpack(order + "I", flags[:4])[0] & 0xFF
    shape = np.frombuffer(_data(stream, _tag(stream, order)), order + "i4").tolist()
    name = _data(stream, _tag(stream, order)).decode("latin-1")
    n = int(np.prod(shape))
    if kind == CHARS:
        tag = _tag(stream, order)
        codec = TEXT[tag[0]]
        text = _data(stream, tag).decode(codec + {"<": "-le", ">": "-be"}[order] if codec in ("utf-16", "utf-32") else codec, "replace")
        rows = shape[0] if shape else 1
        return name, text if rows <= 1 else ["".join(text[r::rows]).rstrip() for r in range(rows)]
    if kind == CELL:
        return name, [_element(stream, order)[1] for _ in range(n)]
    if kind in (STRUCT, OBJECT):
        if kind == OBJECT:
            _data(stream, _tag(stream, order))
        width = struct.unpack(order + "i", _data(stream, _tag(stream, order))[:4])[0]
        raw = _data(stream, _tag(stream, order))
        fields = [raw[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(raw), width)] if width else []
        return name, [{f: _element(stream, order)[1] for f in fields} for _ in range(n)]
    if kind == SPARSE:
        raise ValueError(f"a sparse matrix: {name}")
    return name, _numbers(stream, order, shape)


def _element(stream, order: str):
    """name and value of the next matrix; an empty one has neither."""
    tag = _tag(stream, order)
    if tag is None:
        raise EOFError("the file ends inside a matrix")
    if tag[0] != MATRIX:
        raise ValueError(f"a matrix was expected, not an element of type {tag[0]}")
    return _matrix(stream, order) if tag[1] else ("", np.zeros((0, 0)))


def variables(file) -> dict[str, object]:
    """Every variable of a MAT file by name."""
    head = file.read(128)
    order = {b"IM": "<", b"MI": ">"}.get(head[126:128])
    if order is None or not head.startswith(b"MATLAB 5"):
        raise ValueError("not a MAT file of version 5; version 7.3 (HDF5) can't be read")
    out = {}
    while True:
        at = file.tell()
        tag = _tag(_Plain(file), order)
        if tag is None:
            return out
        end = at + 8 + tag[1] + (0 if tag[0] == DEFLATED else tag[3])
        if tag[0] == DEFLATED:
            name, value = _element(_Inflated(file, at, tag[1]), order)
        elif tag[0] == MATRIX and tag[1]:
            name, value = _matrix(_Plain(file), order)
        else:
            name, value = None, None
        if name is not None:
            out[name] = value
        file.seek(end)


def read_place(file, place: Place, first: int, n: int) -> np.ndarray:
    """n numbers of a Place from its number `first` on; a deflated element is inflated up to there, a piece at a time."""
    size = np.dtype(place.kind).itemsize
    if place.element is None:
        file.seek(place.at + first * size)
        return np.frombuffer(file.read(n * size), place.kind)
    file.seek(place.element)
    raw = file.read(8)
    stream = _Inflated(file, place.element, struct.unpack(place.kind[0] + "II", raw)[1])
    stream.skip(place.at + first * size)
    return np.frombuffer(stream.read(n * size), place.kind)


def _written(kind: int, data: bytes, order: str) -> bytes:
    if 0 < len(data) <= 4:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _made(name: str, value, order: str) -> bytes:
    """A matrix element of text, numbers, a list of records (with equal keys) or a list of other values as cells."""
    head = lambda kind, shape: _written(6, struct.pack(order + "II", kind, 0), order) + _written(5, np.array(shape, order + "i4").tobytes(), order) + _written(1, name.encode("latin-1"), order)
    if isinstance(value, str):
        body = head(CHARS, [1, len(value)]) + _written(4, value.encode("utf-16" + {"<": "-le", ">": "-be"}[order]), order)
    elif isinstance(value, list) and value and isinstance(value[0], dict):
        fields = list(value[0])
        names = b"".join(f.encode("latin-1").ljust(32, b"\0") for f in fields)
        body = head(STRUCT, [1, len(value)]) + _written(5, struct.pack(order + "i", 32), order) + _written(1, names, order) + b"".join(_made("", r[f], order) for r in value for f in fields)
    elif isinstance(value, list):
        body = head(CELL, [1, len(value)]) + b"".join(_made("", x, order) for x in value)
    else:
        x = np.atleast_2d(np.asarray(value))
        code = {np.dtype(v): k for k, v in NUMBERS.items()}[x.dtype.newbyteorder("=")]
        kind = {7: 7, 9: 6, 1: 8, 2: 9, 3: 10, 4: 11, 5: 12, 6: 13, 12: 14, 13: 15}[code]
        body = head(kind, x.shape) + _written(code, x.astype(x.dtype.newbyteorder(order)).tobytes(order="F"), order)
    return struct.pack(order + "II", MATRIX, len(body)) + body


def mat_bytes(values: dict[str, object], *, deflated: bool = False, order: str = "<") -> bytes:
    """A MAT file of version 5 with these variables."""
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + {"<": b"IM", ">": b"MI"}[order]
    for name, value in values.items():
        made = _made(name, value, order)
        if deflated:
            made = zlib.compress(made)
            made = struct.pack(order + "II", DEFLATED, len(made)) + made
        out += made
    return out
