"""Session settings and the shared folder for tables written between stages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PASSING: list[list[str]] = []  # paths of the stages written since each open ``passing_stages`` began
_LOCAL_DIRS: dict[str, tempfile.TemporaryDirectory] = {}  # removed when the process ends


def local_session(app: str = "rolefit", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    A private temporary folder is used only in local mode with the setting unset; on a
    cluster an unset folder is an error, since other executors could not read a local one.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    app = sc.applicationId
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.TemporaryDirectory(prefix="rolefit-", ignore_cleanup_errors=True)
        configured = _LOCAL_DIRS[app].name
    return f"{configured.rstrip('/')}/rolefit/{app}"


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition narrow rows over all configured shuffle partitions, ahead of a step that fans out.

    Adaptive execution sizes partitions by the bytes it sees now; where each row is about to become many
    (pairs, subsets, gram keys) that would leave the real work to a few tasks. Partitioning is by a hash
    column: by the plain columns the step would be optimised away after an aggregate on them.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, F.xxhash64(*columns))


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` with a hint that its joins shuffle both sides.

    Before a join runs, Spark knows a table by the size of its files. Files of short or repeated values are many times
    smaller than their rows, so a table that grows with the input would be collected by the driver and broadcast.
    """
    return df.hint("merge")


def write_stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage durably: a lost executor re-reads files instead of recomputing, and work whose
    row placement is not repeatable (range sampling, partition ids) is fixed once. ``keep`` exempts it from ``passing_stages``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """Stages written inside are removed at the end, for work whose own result is stored by then (``keep``)."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            remove(spark, path)
        spark.sparkContext._jvm.System.gc()  # shuffle files are removed once the plans that wrote them are collected


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this session has written and nothing reads any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
