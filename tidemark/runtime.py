"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests and timing runs; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for tables that must outlive an executor.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is local is a temporary
    folder chosen; elsewhere executors do not see each other's disks, so it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not is_local(context.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {context.master})")
        root = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def freeze(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there with the lineage cut."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())  # tables of the scopes around this code


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, sort: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    For inputs that several jobs read (splits, model fits, scoring): columnar, so each reader takes only its columns,
    and safe against the loss of executors, which a cached copy is not. ``sort`` orders the rows of each file, so
    that later filters on those columns skip row groups. In a block of :func:`files_of` a partition of more rows becomes
    several files.
    """
    path = scratch_path(df.sparkSession, label)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    for held in _open.get()[-1:]:
        held.append(out)
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stage` returned, once nothing reads it any more. Other frames: no effect."""
    path = getattr(df, "staged_path", None)
    if path is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    df.staged_path = None


@contextmanager
def working() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``with working() as keep:`` drops at its end every table that was staged within it, by whatever code, but the kept ones.

    For callers that write a result and then need nothing it was made from: frames that read dropped tables fail from
    then on. ``keep(t)`` hands a table of :func:`stage` to the scope around this one, if there is any. Also drops on errors.
    """
    held: list[DataFrame] = []
    around = _open.get()
    token = _open.set((*around, held))

    def keep(df: DataFrame) -> DataFrame:
        held[:] = [t for t in held if t is not df]
        if around and getattr(df, "staged_path", None):
            around[-1].append(df)
        return df

    try:
        yield keep
    finally:
        _open.reset(token)
        for df in held:
            unstage(df)


@contextmanager
def session_options(spark: SparkSession, **options: str) -> Iterator[None]:
    """SQL options for the plans made and run in the block, with double underscores for dots; then as they were before."""
    names = {k.replace("__", "."): v for k, v in options.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files_of(spark: SparkSession, rows: int):
    """A block in which files that are written have at most ``rows`` rows."""
    return session_options(spark, spark__sql__files__maxRecordsPerFile=str(rows))


def file_by_file(spark: SparkSession):
    """A block in which each file of up to 128 MB is read by a task of its own, where Spark would pack small files together."""
    size = str(128 << 20)
    return session_options(spark, spark__sql__files__maxPartitionBytes=size, spark__sql__files__openCostInBytes=size)


@contextmanager
def staging() -> Iterator[Callable[..., DataFrame]]:
    """``with staging() as keep: t = keep(df, "label")`` stages tables and deletes them at the end of the block."""
    held: list[DataFrame] = []

    def keep(df: DataFrame, label: str, sort: Sequence[str] = ()) -> DataFrame:
        held.append(stage(df, label, sort))
        return held[-1]

    try:
        yield keep
    finally:
        for df in held:
            unstage(df)
