"""Session defaults and the shared folder used for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# Narrow id frames up to this many rows may be broadcast (about 100 bytes a row -> 20 MB).
BROADCAST_ROWS = 200_000
# Bytes of different values of a column that a parquet file may hold once each, where many rows share long texts.
DICTIONARY_BYTES = 32 << 20


def get_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` entries override the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local folder stands in only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    local = tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


# Folders written by this process and not yet removed.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables written so far; frames that read them must not be used afterwards."""
    for path in list(_WRITTEN):
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove one folder that :func:`scratch` named."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _WRITTEN.remove(path)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one, which :func:`release` removes."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


# Executions that start while this is set remove their shuffle files when they end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind, which else lie on disk until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: stable under executor loss.

    The folder stays until :func:`release`, since frames derived from it are lazy; shuffle files of the write are removed.
    ``compression`` is a codec of parquet files, for large tables. Spark takes the size of a frame from its files, and packed
    keys are far larger in memory, so joins that may meet many of them need a hint against broadcasts.
    """
    path = scratch(df.sparkSession, name)
    with without_shuffles(df.sparkSession):
        df.write.mode("errorifexists").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_long_values(spark: SparkSession) -> None:
    """Let parquet files that the session writes from now on hold long values once, however many rows share them.

    By default a file gives up its dictionary of values at 1 MB, which one list of ids can exceed. Files whose first values
    do not repeat have none in either case.
    """
    spark.conf.set("parquet.dictionary.page.size", str(DICTIONARY_BYTES))


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count; a larger frame is joined by a shuffle, however small its files are."""
    return F.broadcast(df) if fits(df, max_rows) else df.hint("merge")


def spread(scan: DataFrame, key: str | None = None) -> DataFrame:
    """Distribute a scan with fewer splits than cores before heavy per-row work.

    Large inputs have more splits than that and are returned as they are, without a shuffle. Rows dealt by a ``key`` need
    no second shuffle for a join by it; rows whose key is NULL, which no join finds, are left out.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores) if key is None else scan.filter(F.col(key).isNotNull()).repartition(key)
