"""What the library asks of a Spark session: shared storage and importable workers."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 32 << 20
#: Bytes a core up to which a table may be dealt out to all cores.
SMALL = 16 << 20
_WRITTEN: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where the driver found it by sys.path alone, and keep their batches small.

    Rows here are whole texts: Spark's default of 10,000 rows a batch would hold tens of megabytes several times over.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "2000")
    if int(spark.conf.get(BATCH_BYTES, str(2**31 - 1))) > MOST_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here if unset and all run in one process (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gleanery-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    _WRITTEN.append(path)
    return stored


def release(*stored: DataFrame) -> None:
    """Remove the files of tables that materialise() wrote, once nothing reads them any more."""
    for table in stored:
        _WRITTEN.remove(table.stored_at)
        remove_shared(table.sparkSession, table.stored_at)


def written() -> list[str]:
    """Where the tables of materialise() lie that haven't been released."""
    return list(_WRITTEN)


def release_new(spark: SparkSession, before: list[str], *keep: DataFrame) -> None:
    """Remove all such tables that weren't there before, but for some."""
    for path in set(_WRITTEN) - set(before) - {k.stored_at for k in keep}:
        _WRITTEN.remove(path)
        remove_shared(spark, path)


def read_bytes(df: DataFrame) -> int:
    """How many bytes Spark expects df to read, by the sizes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def files_state(df: DataFrame) -> int:
    """A digest of the names, sizes and times of all files that df reads, as Spark listed them when it made df."""
    nil = getattr(getattr(df.sparkSession.sparkContext._jvm.scala.collection.immutable, "Nil$"), "MODULE$")
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            raise ValueError(f"not a table of files: {leaf.nodeName()}")
        listed = leaf.relation().location().listFiles(nil, nil).mkString(" ")  # one call, however many files
        files = sorted(re.findall(r"FileStatus\{path=(.*?); isDirectory=.*?length=(\d+);.*?modification_time=(\d+)", listed))
        if listed.count("FileStatus{") != len(files):
            raise ValueError("this listing of files can't be read")
        found += files
    return hash(tuple(found))


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt out to all cores where it is so small that a few tasks would read it whole.

    A file of one row group is read by one task however many cores wait. Tables of over SMALL bytes a core, and those
    that are read by more tasks than there are cores, are never dealt out: there it would be a shuffle for nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if read_bytes(df) > SMALL * cores or df._jdf.queryExecution().toRdd().getNumPartitions() > cores:
        return df
    return df.repartition(cores)


def write_shared_bytes(spark: SparkSession, label: str, content: bytes) -> str:
    """Store bytes as one file in the shared folder by Hadoop's file API; returns its URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(fresh_path(spark, label))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return str(fs.makeQualified(path).toString())


def path_of(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = path_of(spark, name)
    return fs.exists(path)


def read_text(spark: SparkSession, name: str) -> str | None:
    """The content of a small file, null if there is none."""
    return spark.read.text(name, wholetext=True).first()[0] if exists(spark, name) else None


def replace_text(spark: SparkSession, name: str, content: str) -> None:
    """Write a small file whole under another name and move it into place at once."""
    jvm = spark.sparkContext._jvm
    new, fs = path_of(spark, f"{name}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = overwrite
    place, _ = path_of(spark, name)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(place), options)


@contextlib.contextmanager
def only_writer(spark: SparkSession, name: str, stale_s: float = 6 * 3600) -> Iterator[bool]:
    """Whether this application made the lock file and so is the one writer; a lock older than stale_s seconds is taken over."""
    path, fs = path_of(spark, name)
    if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale_s:
        fs.delete(path, False)
    fs.mkdirs(path.getParent())
    try:
        mine = fs.createNewFile(path)
    except Exception as e:  # some file systems raise where others answer False
        if not fs.exists(path):
            raise e
        mine = False
    try:
        yield mine
    finally:
        if mine:
            fs.delete(path, False)


def remove_shared(spark: SparkSession, uri: str) -> None:
    path, fs = path_of(spark, uri)
    fs.delete(path, True)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanery")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())
