"""Files of any store that Arrow knows, for readers that run in tasks; listings come from Spark."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened(path: str):
    """A seekable file; local paths without Arrow."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb")  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def listing(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, length and modified of the files under root; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.col("modificationTime").alias("modified"))


def read_at(path: str, start: int, n: int) -> bytes:
    """n bytes from start on."""
    with opened(path) as f:
        f.seek(start)
        return f.read(n)


def free_name(path: str, taken: set[str]) -> str:
    """path, or the first of path_1, path_2 ... (before its ending) that isn't taken."""
    folder, _, name = path.rpartition("/")
    stem, dot, ending = name.partition(".")
    out, k = path, 0
    while out in taken:
        k += 1
        out = f"{folder}/{stem}_{k}{dot}{ending}" if folder else f"{stem}_{k}{dot}{ending}"
    return out


def write_file(spark: SparkSession, path: str, content: bytes, conflict: str = "fail") -> str | None:
    """Writes one small file (a sidecar, a description) and returns its path; conflict: fail, skip, overwrite or number."""
    if conflict not in ("fail", "skip", "overwrite", "number"):
        raise ValueError(f"unknown strategy {conflict}")
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(at(path)) and conflict != "overwrite":
        if conflict == "fail":
            raise FileExistsError(path)
        if conflict == "skip":
            return None
        taken = {path}
        while store.exists(at(free_name(path, taken))):
            taken.add(free_name(path, taken))
        path = free_name(path, taken)
    out = store.create(at(path), True)
    out.write(bytearray(content))
    out.close()
    return path


def copy_files(pairs: DataFrame, *, link: bool = False) -> DataFrame:
    """dst, bytes of files copied by tasks, as they are read. pairs: src, dst; a lost task copies its files again.

    link: symbolic links instead, for paths of a file system that all tasks share; one that stands there is replaced.
    """

    def linked(src: str, dst: str) -> int:
        import os
        import uuid

        if any(urlparse(p).scheme not in ("", "file") for p in (src, dst)):
            raise ValueError(f"no symbolic links in this store: {dst}")
        source, target = (unquote(urlparse(p).path) for p in (src, dst))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        own = f"{target}.{uuid.uuid4().hex}"
        os.symlink(source, own)
        os.replace(own, target)
        return os.path.getsize(source)

    def copied(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        for b in batches:
            sizes = []
            for src, dst in zip(b["src"], b["dst"], strict=True):
                if link:
                    sizes.append(linked(src, dst))
                    continue
                parsed = urlparse(dst)
                store, inner = (pafs.LocalFileSystem(), unquote(parsed.path)) if parsed.scheme in ("", "file") else pafs.FileSystem.from_uri(dst)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                n = 0
                with opened(src) as f, store.open_output_stream(inner, compression=None) as out:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)
                        n += len(chunk)
                sizes.append(n)
            yield pd.DataFrame({"dst": b["dst"], "bytes": pd.Series(sizes, dtype="int64")})

    return pairs.select("src", "dst").mapInPandas(copied, "dst string, bytes long")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir (a local one where that is unset and all runs here), deleted at the end."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        root = sc.getCheckpointDir()
    path = f"{root.rstrip('/')}/tessera-files/{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def write_files(contents: DataFrame, root: str) -> DataFrame:
    """path, bytes of files written by tasks, as they are read. contents: name (below root), content (binary).

    A file is written under another name and then moved, so a task that is lost and run again leaves whole files.
    """

    def written(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs as pafs

        parsed = urlparse(root)
        local = parsed.scheme in ("", "file")
        store, inner = (pafs.LocalFileSystem(), unquote(parsed.path)) if local else pafs.FileSystem.from_uri(root)
        for b in batches:
            paths, sizes = [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, data = f"{inner.rstrip('/')}/{name}", content.as_buffer()
                store.create_dir(at.rpartition("/")[0], recursive=True)
                own = f"{at}.{uuid.uuid4().hex}"
                with store.open_output_stream(own, compression=None) as out:
                    out.write(data)
                store.move(own, at)
                paths.append(f"{root.rstrip('/')}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return contents.select("name", "content").mapInArrow(written, "path string, bytes long")


def copies_to(files: DataFrame, values: dict, pattern: str) -> DataFrame:
    """src, dst of files under the paths that a pattern gives their entities; those without a path are left out."""
    from tessera.functions.paths import build_path

    return files.select(F.col("path").alias("src"), build_path(values, pattern).alias("dst")).where("dst IS NOT NULL")
