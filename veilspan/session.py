"""Session helpers."""

from __future__ import annotations

import functools
import re
import tempfile
import weakref
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("veilspan")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
            # Call sites of every column operation cost more than small queries do.
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables and stream checkpoints that all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    # "local-cluster" has executors of its own, which may not share this machine's folders.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veilspan-"))
    return context.getCheckpointDir().removeprefix("file:")


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep a column expression that is built from names and other hashable arguments.

    A large expression takes thousands of calls into the JVM to build, but it is
    immutable and holds names only, so every later query can use the same one.
    """
    # By context, and no longer than it lives: columns are objects of its JVM.
    kept: weakref.WeakKeyDictionary[SparkContext, dict[tuple, Column]] = (
        weakref.WeakKeyDictionary())

    @functools.wraps(build)
    def get(*args) -> Column:
        context = SparkContext._active_spark_context
        if context is None:
            return build(*args)
        own = kept.setdefault(context, {})
        if args not in own:
            own[args] = build(*args)
        return own[args]

    return get
