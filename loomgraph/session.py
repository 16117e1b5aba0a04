"""What every operator needs of the session: the package on the executors, a shared folder, written stages."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}
_paths: list[str] = []


#: Rows that go to Python at a time, unless the session says otherwise: a batch of texts, in several copies, is some megabytes.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once for each application."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    path = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph_ship.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that gives its memory back when its task ends: workers wait for the next task, and hold what
    they once had, beside the next stage's JVM."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-shared-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver's process ends, or its scratch() does."""
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    atexit.register(remove, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are removed at the end: what is made of them must be written by then."""
    at = len(_paths)
    try:
        yield
    finally:
        for path in _paths[at:]:
            remove(spark, path)
        del _paths[at:]


def remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is None:
            return
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: the folder's owner clears it
        if path.startswith("file://") and os.path.isdir(path[7:]):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table written below the shared folder and read again: lineage ends there, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
