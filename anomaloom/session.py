"""Session defaults and durable staging."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "anomaloom", **conf: str) -> SparkSession:
    """Session with the settings the operators assume (UTC, AQE on).

    Master, memory and ``spark.checkpoint.dir`` come from the cluster or from ``conf``.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged data: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    created = tempfile.mkdtemp(prefix="anomaloom-stage-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove what :func:`stage` writes inside the block when the block ends.

    For jobs whose results are in files of their own: nothing they return may read a staged table.
    """
    mark = _STAGED.set([])
    try:
        yield
    finally:
        paths = _STAGED.get()
        _STAGED.reset(mark)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def in_staging(job: Callable) -> Callable:
    """A job (session first) that removes its staged tables when it ends, well or not."""

    @wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        with staging(spark):
            return job(spark, *args, **kwargs)

    return run


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably (a lost executor re-reads files, it does not re-run the parse), and
    later passes read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (paths := _STAGED.get()) is not None:
        paths.append(path)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
