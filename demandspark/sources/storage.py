"""Paths through the Hadoop file system, and the shared scratch folder."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``, sorted; none if it is absent."""
    hadoop_path, fs = _path(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isDirectory())


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"nothing stored at {path}")
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (a local session, as in tests) a folder of this machine is made and set;
    it goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="demandspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for exchanges that AQE must not shrink."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all: written aside and renamed over the old one in one step."""
    jvm = spark._jvm
    target, fs = _path(spark, path)
    aside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(aside), context.makeQualified(target), rename)


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _path(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def input_mark(spark: SparkSession, path: str) -> str:
    """A hash over name, size and time of every file under ``path``; it changes when the input does."""
    folder, fs = _path(spark, path)
    files, seen = fs.listFiles(folder, True), []
    while files.hasNext():
        status = files.next()
        seen.append((status.getPath().getName(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Read the Parquet table at ``path``, writing ``df`` there first if it is not there as a whole.

    The table is written aside and renamed once it is complete, so a job that dies leaves nothing at
    ``path``; what an older job left there without its mark of success is replaced."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(aside)
        target, fs = _path(spark, path)
        if not exists(spark, f"{path}/_SUCCESS"):  # another job may have been quicker
            fs.delete(target, True)
            fs.rename(_path(spark, aside)[0], target)
        else:
            fs.delete(_path(spark, aside)[0], True)
    return spark.read.parquet(path)
