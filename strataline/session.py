"""Session helpers. Operators never create sessions; they use the one that owns their input."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a session on one
    machine may go without: it gets a temporary folder that ends with the
    process. Elsewhere every executor would write to a disk of its own, so a
    missing folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="strataline-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


_WRITTEN: list[str] = []


def intermediate(spark: SparkSession, *names: str) -> str:
    """A new path in the shared folder, remembered for :func:`forget_intermediates`."""
    path = "/".join([shared_folder(spark).rstrip("/"), *names, uuid.uuid4().hex])
    _WRITTEN.append(path)
    return path


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at a path."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def forget_intermediates(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; call it when the results that read them have been used."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
