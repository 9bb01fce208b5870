"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writing: records are built where the rows are and written by Spark's own file writer and commit protocol, so
a lost task leaves nothing behind; an empty gzip member stands between records, so a part file is a plain
sequence of members. Of equal payloads the one with the smallest id is a response, the others revisit it.

Reading: a task has a byte range of a file. It scans the range for the gzip magic, takes a candidate as a
member if its header and the first decoded bytes are those of a record, and owns the records that start in
its range; it reads past the range's end to finish the last one. Between members it jumps, so a magic inside
compressed data is only ever met at the start of a range, where decoding refuses it. A damaged member raises
an error: where one must start, because another ended there, and where a record's first bytes decode but not
the rest. A range looks at the start of the next member beyond its end too, so none is lost between two ranges.

Defined results: a null payload is empty. Null ids are written as such; they are responses only where no
equal payload has an id. Rows that repeat the smallest id are all responses. A null uri leaves the header
out, line breaks in one are percent-encoded. An empty table gives no records. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, scratch_path

#: An empty gzip member: the record separator of the part files.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300000000000000000000")[:10] + bytes.fromhex("03000000000000000000")
MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that a task scans, that are read at once, and that are inflated at once.
RANGE_BYTES = 64 << 20
CHUNK, PIECE = 1 << 20, 1 << 14
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def roles(pages: DataFrame, *, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """pages as id, uri-independent payload bytes and refers_to: null for responses. Payloads under min_bytes all are."""
    p = pages.withColumn("payload", F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))
    p = p.withColumn("_sha", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    #: Only digests and ids are grouped; payloads that occur once leave no row to join.
    first = p.where("_sha IS NOT NULL").groupBy("_sha").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL").drop("_n")
    #: As a table its size is known before the join: where it is small, the payloads aren't shuffled.
    j = p.join(materialize(first, "first"), "_sha", "left")
    return j.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("_first")), F.col("_first"))).drop("_sha", "_first")


def _record(record_id, uri, payload: bytes, refers_to, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the headers of the response."""
    import base64
    import hashlib
    import zlib

    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-record:{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-record:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + squeeze.flush()


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row of pages to the archives under path."""
    p = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(payload_col).alias("html"))
    r = roles(p, id_col="id", payload_col="html", min_bytes=min_bytes)
    r = r.select(F.col("id").cast("string").alias("id"), "uri", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def build(batches):
        import pyarrow as pa

        for b in batches:
            ids, uris, payloads, refers = (b.column(k) for k in range(4))
            for start in range(0, b.num_rows, 500):
                rows = range(start, min(start + 500, b.num_rows))
                made = [_record(ids[i].as_py(), uris[i].as_py(), payloads[i].as_py(), refers[i].as_py(), date) for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    #: The text writer writes the bytes of its column as they are, and the separator as latin-1.
    r.mapInArrow(build, "member binary").select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _opened(path: str):
    """A seekable file of any store that Arrow knows, local paths without it."""
    from urllib.parse import unquote, urlparse

    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb")  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class _Window:
    """The bytes of a file from any place, read in chunks, of which one is held."""

    def __init__(self, file) -> None:
        self.file, self.base, self.held = file, 0, b""
        file.seek(0, 2)
        self.size = file.tell()

    def at(self, place: int, most: int) -> bytes:
        """Up to most bytes from place; none beyond the file's end."""
        if not self.base <= place < self.base + len(self.held):
            self.file.seek(place)
            self.base, self.held = place, self.file.read(CHUNK)
        return self.held[place - self.base : place - self.base + most]


def _inflated(window: _Window, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """What the gzip member at `at` holds and its length in the file; None if there is none. most: stop after so many bytes."""
    import zlib

    inflate, out, used, held = zlib.decompressobj(31), [], 0, 0
    try:
        while not inflate.eof:
            data = window.at(at + used, 64 if most else PIECE)
            if not data:
                return None
            used += len(data)
            out.append(inflate.decompress(data))
            held += len(out[-1])
            if most and held >= most:
                break
    except zlib.error:
        return None
    return b"".join(out), used - len(inflate.unused_data)


def members(file, start: int, end: int) -> Iterator[bytes]:
    """The records whose gzip members start in [start, end). Raises where a member is damaged."""
    window = _Window(file)
    at, in_step = start, start == 0
    while at < (window.size if in_step else end):
        if not in_step:
            data = window.at(at, end - at + len(MAGIC) - 1)
            k = data.find(MAGIC)
            if k < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
                continue
            at += k
            if at >= end:
                return
        head = _inflated(window, at, 7)
        if head is None or (head[0] and not head[0].startswith(b"WARC/1.")):
            if in_step:
                raise ValueError(f"no record at byte {at}, where one must start: the archive is damaged")
            at += 1
            continue
        if head[0] and at >= end:
            return
        whole = _inflated(window, at)
        if whole is None:
            if in_step or head[0]:
                raise ValueError(f"the record at byte {at} is damaged or cut off")
            at += 1
            continue
        if not whole[0] and not in_step:
            at += 1
            continue
        if whole[0]:
            yield whole[0]
        at, in_step = at + whole[1], True


def parsed(record: bytes, with_payload: bool) -> tuple:
    """The row of a record; a response's digest is worked out from its payload and must be the header's."""
    import base64
    import hashlib

    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = lambda x: None if x is None else x.strip("<>").removeprefix("urn:x-record:")
    said, kind = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"]
    if kind == "response":
        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        if said and said != digest:
            raise ValueError(f"{fields.get('warc-record-id')}: the payload's digest is {digest}, the header says {said}")
    else:
        lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        digest, n = said, int(lengths[0]) if lengths else None
    return name(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), digest, n, name(fields.get("warc-refers-to")), payload if with_payload and kind == "response" else None


def read(spark: SparkSession, path: str, *, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to and payload of every record under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))

    def scan(batches):
        import pandas as pd

        columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for where, start, end in batch.itertuples(index=False):
                rows, held = [], 0
                with _opened(where) as file:
                    for record in members(file, start, end):
                        rows.append(parsed(record, with_payload))
                        held += len(record) if with_payload else 500
                        if held > 4 * CHUNK:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    #: A task for each range: dealt in turn to as many partitions as there are ranges, which aren't merged again.
    return ranges.repartition(max(1, ranges.count())).mapInPandas(scan, RECORD_SCHEMA)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The records of pages after they were written to archives in the shared folder, without payloads."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, id_col=id_col, uri_col=uri_col, payload_col=payload_col, min_bytes=min_bytes)
    return read(pages.sparkSession, path, with_payload=False)
