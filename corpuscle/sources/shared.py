"""Tables in the folder that the driver and all executors share; writing there ends a lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master may leave it unset: its executors are in one process, and a folder of
    this machine is shared by all of them."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/corpuscle-shared"
    return found.rstrip("/")


def _opened(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _opened(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _opened(spark, path)
    fs.delete(where, True)
    _FOLDERS.pop(path, None)


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, such as a pointer; None if there is none."""
    fs, where = _opened(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_small(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in one step: whoever reads sees the old text or the new one."""
    jvm, (fs, fresh) = spark.sparkContext._jvm, _opened(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def _clean() -> None:
    for path, spark in list(_FOLDERS.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            _FOLDERS.pop(path, None)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpuscle-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_clean)
    _FOLDERS[path] = spark
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
