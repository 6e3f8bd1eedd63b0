"""Session settings, shared-folder staging and size-aware helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "topicloom", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("TOPICLOOM_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TOPICLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.topicloom.text.partitions", cores if cores.isdigit() else "0")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="topicloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folder that owns what is staged now, if a run has one.
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_OWNER.get() or shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """What is staged inside lies in one folder of the shared one, and that folder goes at the end, after an error too.

    Results that read staged tables must be written elsewhere before the end. An inner run keeps to its own folder.
    """
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    token = _OWNER.set(folder)
    try:
        yield folder
    finally:
        _OWNER.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a form that outlives executors, lets several branches share one
    computation, and gives Catalyst the true size of the result, so that it
    broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it above.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the session's shuffle partitions ahead of a step that turns each
    into many; adaptive execution would otherwise merge small inputs into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
