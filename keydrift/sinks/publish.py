"""Datasets copied to another place: their files as they are, byte by byte, under their own names."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 16 << 20
# Copies that a driver has under way where tasks cannot reach the files themselves.
THREADS = 16

# Schemes of file systems that tasks open without Hadoop, and what they are called there.
_DIRECT = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}
_URI = re.compile("^([A-Za-z][A-Za-z0-9+.-]*):/*(.*)$", re.DOTALL)


def _scheme(path: str) -> str:
    return _URI.match(path)[1].lower()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    kind, rest = _DIRECT[_scheme(path)], _URI.match(path)[2]
    if kind == "file":
        return fs.LocalFileSystem(), f"/{rest}"
    return fs.FileSystem.from_uri(f"{kind}://{rest.split('/')[0]}")[0], rest


def copy_file(source: str, target: str) -> int:
    """Copy one file in blocks; it shows up at its place when it is whole. Returns its length."""
    (reading, a), (writing, b) = _place(source), _place(target)
    local = isinstance(writing, fs.LocalFileSystem)
    made = posixpath.join(posixpath.dirname(b), f".{uuid.uuid4().hex}") if local else b
    if local:
        writing.create_dir(posixpath.dirname(b))
    copied = 0
    with reading.open_input_stream(a, compression=None) as f, writing.open_output_stream(made, compression=None) as g:
        while block := f.read(BLOCK):
            g.write(block)
            copied += len(block)
    if local:
        writing.move(made, b)
    return copied


def _qualified(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system and path."""
    it = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = it.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(it)


def _copy(spark: SparkSession, source: str, target: str, folder: bool) -> bool:
    """Copy a file, or the files of a folder, in place of what was there; False if there is none."""
    try:
        listed = spark.read.format("binaryFile").load(source)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    # the driver lists files to plan a scan; the scan itself leaves empty ones out
    names = [(unquote(name),) for name in listed.inputFiles()]
    if not names:
        return False
    total = listed.agg(F.sum("length")).first()[0] or 0
    system, place = _qualified(spark, target)
    system.delete(place, True)
    into = place.toString()
    named = F.concat(F.lit(into), F.lit("/"), F.substring_index("path", "/", -1)) if folder else F.lit(into)
    files = spark.createDataFrame(names, "path string").select("path", named.alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [copy_file(*pair) for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array(done, pa.int64())], ["copied"])

    if _scheme(_qualified(spark, source)[1].toString()) in _DIRECT and _scheme(into) in _DIRECT:
        # a task for a file or two, as long as there are not too many
        spread = files.repartition(min(len(names), 100_000))
        copied = spread.mapInArrow(run, "copied long").agg(F.sum("copied")).first()[0]
    else:
        copied = _copy_from_driver(spark, files)
    if copied != total:
        raise OSError(f"copied {copied} bytes of {total} from {source}")
    return True


def _copy_from_driver(spark: SparkSession, files: DataFrame) -> int:
    """Through Hadoop's file systems, which only the JVM of the driver offers to Python."""
    configuration = spark._jsc.hadoopConfiguration()

    def one(row) -> int:
        (a, source), (b, target) = _qualified(spark, row.path), _qualified(spark, row.target)
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, source, b, target, False, True, configuration)
        return b.getFileStatus(target).getLen()

    with ThreadPoolExecutor(THREADS) as pool:
        return sum(pool.map(one, files.toLocalIterator()))


def publish_dataset(spark: SparkSession, source: str, target: str, include_manifest: bool = True) -> list[str]:
    """Copy ``before``, ``after`` and the manifest of a dataset to another place, replacing what was there.

    Both may be on any file system Spark reaches. Files keep their names and their bytes. Tasks copy files of local, S3 and
    Google storage; between others the bytes go through the driver. Returns what was written and fails if there was nothing to publish.
    """
    wanted = ["before", "after"] + (["manifest.json"] if include_manifest else [])
    pairs = [(f"{source.rstrip('/')}/{name}", f"{target.rstrip('/')}/{name}") for name in wanted]
    written = [there for here, there in pairs if _copy(spark, here, there, folder=not there.endswith(".json"))]
    if not written:
        raise ValueError(f"nothing to publish under {source}")
    return written
