"""Tables that are replaced as a whole: versioned folders and small commit
files.

A table's folder holds one ``data-<id>`` folder for each version and
``_commits/<number>.json``, which names the folder of that version, its format
and its number of rows. A commit file appears by a rename that fails if the
number is taken, so a version is there completely or not at all; readers take
the highest number. Until then the version before stays, whatever happens to
the writer, and a job may read and replace the same table.

Old versions stay for readers that have begun on them (and for epochs of a
stream, which note their version) until ``expire`` deletes them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    path: str
    version: int
    folder: str
    fmt: str
    rows: int

    @property
    def location(self) -> str:
        return f"{self.path}/{self.folder}"


# -- small files, on any file system that Spark knows ------------------------

def _hadoop(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    return fs, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    _, at, system = _hadoop(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file in one step; False if it exists already."""
    fs, at, system = _hadoop(spark, path)
    draft = fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    system.mkdirs(at.getParent())
    stream = system.create(draft)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    no_options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, at, no_options)
        return True
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
            raise
        return False


def record_once(spark: SparkSession, path: str, text: str) -> str:
    """The text of the file, which is ``text`` if there was none: the first
    writer decides for all later ones."""
    if not put_if_absent(spark, path, text):
        text = read_text(spark, path)
    return text


# -- versions ------------------------------------------------------------------

def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's versions, rising; none if it has no commits."""
    fs, at, system = _hadoop(spark, f"{path.rstrip('/')}/{COMMITS}")
    if not system.exists(at):
        return []
    names = [status.getPath().getName() for status in system.listStatus(at)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """A version of the table, by default the newest; None if it has none."""
    path = path.rstrip("/")
    known = versions(spark, path)
    if version is None and not known:
        return None
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"{path} has no version {version}")
    said = json.loads(read_text(spark, f"{path}/{COMMITS}/{version:010d}.json"))
    return Snapshot(path, version, said["folder"], said["format"], said["rows"])


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> Snapshot:
    """Writes ``df`` as the table's next version and makes it current. The rows
    that were written are counted again where they lie before the switch. A
    failure leaves the current version as it is; writers at the same time get
    numbers one after the other."""
    spark, path = df.sparkSession, path.rstrip("/")
    folder = f"data-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).save(f"{path}/{folder}")
    rows = seen.get["rows"]
    stored = spark.read.schema(df.schema).format(fmt).load(f"{path}/{folder}").count()
    if stored != rows:
        raise OSError(f"{path}/{folder} holds {stored} rows of {rows}; the table stays as it was")
    said = json.dumps({"folder": folder, "format": fmt, "rows": rows})
    version = (versions(spark, path) or [0])[-1] + 1
    while not put_if_absent(spark, f"{path}/{COMMITS}/{version:010d}.json", said):
        version += 1
    return Snapshot(path, version, folder, fmt, rows)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all versions but the newest ``keep`` (one at least); their
    numbers. The commit goes first, so no reader finds a version without
    data."""
    gone = versions(spark, path)[:-max(1, keep)]
    for version in gone:
        old = snapshot(spark, path, version)
        for name, deep in ((f"{old.path}/{COMMITS}/{version:010d}.json", False), (old.location, True)):
            _, at, system = _hadoop(spark, name)
            system.delete(at, deep)
    return gone
