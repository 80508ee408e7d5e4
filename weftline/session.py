"""Session helpers: building a local session, loading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: dict[str, SparkSession] = {}


def local_session(cores: str = "8", partitions: int = 8, app: str = "weftline") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; column pruning and filters reach its scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir``, else the checkpoint folder set on the context.

    Only where neither is set and the session runs on one machine a temporary folder takes its place; on a cluster
    its executors couldn't share that, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_on_context.get() if set_on_context.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="weftline-shared-"))
        named = _local[0]
    return named.rstrip("/") + "/weftline"


def new_folder(spark: SparkSession) -> str:
    """The path of a folder in the shared folder that isn't there yet; it is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back, its lineage cut.

    Readers survive the loss of executors, and the optimizer sees the table's true size, unlike a checkpoint,
    which inherits the estimates of its plan (over many joins they grow without bound).  Tables that an
    operator no longer needs it gives to ``drop``; the rest go when the process ends.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def drop(*dfs: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and nothing will read again."""
    for df in dfs:
        path = getattr(df, "_weftline_path", None)
        if path and path in _written:
            _delete(_written.pop(path), path)


@contextmanager
def written_tables() -> Iterator[None]:
    """Delete on leaving what ``cut`` wrote inside, for sessions that run on; results must have been used or stored by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        _delete(spark, path)
    for path in _local:
        shutil.rmtree(path, ignore_errors=True)
