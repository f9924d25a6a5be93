"""Session helpers.

The library never builds its own session inside an operator: callers pass
``spark``. ``get_session`` is for tests, the bench and the command line.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "sentimart") -> SparkSession:
    """Local session with AQE on and the UI off (no extra ports)."""
    master = master or os.environ.get("SENTIMART_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SENTIMART_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is visible to every
    executor. Only when it is unset (local runs, tests) do we create one
    under the system temp folder and register it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # "local-cluster" has executors of its own, like a cluster
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can read "
                "(shared storage); a machine-local folder does not work on a cluster")
        configured = tempfile.mkdtemp(prefix="sentimart-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique folder inside the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/sentimart-{name}-{uuid.uuid4().hex[:12]}"
    if (held := _folders.get()) is not None:
        held.append(path)
    return path


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Owner of intermediate folders: those that operators and plans make in
    the shared checkpoint folder within this block are removed at its end.
    Results that read them must be written or collected inside. Blocks nest."""
    token = _folders.set([])
    try:
        yield
    finally:
        for path in _folders.get():
            remove_dir(spark, path)
        _folders.reset(token)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package made, whatever the file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
