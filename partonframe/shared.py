"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; without one a temporary folder, on a local master only."""
    named = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors of {master} share")
    own = tempfile.mkdtemp(prefix="partonframe-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(SETTING, f"file://{own}")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def new_folder(spark: SparkSession, kind: str = "run") -> str:
    """The name of a folder below the shared one, which :func:`sweep` deletes, at the latest when Python ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` read back from a table in the shared folder, which cuts its lineage."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)
    _made[:] = [(s, p) for s, p in _made if p != path]


def sweep() -> None:
    """Delete every folder that this process made and hasn't deleted; results that still read them end with it."""
    for spark, path in list(_made):
        delete(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        sweep()
    except (Py4JError, OSError):  # Spark has ended already
        pass
