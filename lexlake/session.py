"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.sources.files import delete_folder

WORK_DIR_SETTING = "spark.checkpoint.dir"
# largest table we ask Spark to broadcast; there is another way for anything larger. The driver holds it several times over:
# as it comes, as a hash table and as the blocks it is sent in
BROADCAST_LIMIT = 24 * 1024 * 1024
SHUFFLE_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app_name: str = "lexlake", **settings: str) -> SparkSession:
    """A session with the settings the lake relies on; anything else is left to the cluster."""
    builder = SparkSession.builder.appName(app_name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get(WORK_DIR_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {WORK_DIR_SETTING} to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexlake-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_work_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


_open_scopes: ContextVar[list[str] | None] = ContextVar("open_scopes", default=None)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside the block delete their shuffle files when they end.

    Otherwise these stay until the driver happens to collect its garbage. For queries whose result is stored.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP_SETTING, None)
    spark.conf.set(SHUFFLE_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_SETTING)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_SETTING, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors, and several consumers read it instead of recomputing ``df``. What
    was shuffled to make it is deleted.
    """
    spark = df.sparkSession
    path = new_work_path(spark, label)
    scope = _open_scopes.get()
    if scope is not None:
        scope.append(path)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``written`` writes inside the block when the block ends.

    For a job whose result has been stored elsewhere by then.
    """
    paths: list[str] = []
    token = _open_scopes.set(paths)
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for path in paths:
            delete_folder(spark, path)


def byte_size(df: DataFrame) -> int:
    """Measured size of the text in ``df``, with a flat charge per row and cell."""
    cells = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(16))
    return df.agg(F.sum(cells).alias("n")).first()["n"] or 0
