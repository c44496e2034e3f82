"""Where intermediate tables go, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary
    folder, which no second machine could read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="sqlgauge-")
    return _LOCAL_DIRS[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call uses."""
    path = f"{shared_dir(spark)}/sqlgauge/{label}-{uuid.uuid4().hex}"
    scope = getattr(_SCOPES, "paths", None)
    if scope is not None:
        scope.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(target, True)


_SCOPES = threading.local()


@contextmanager
def shared_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the intermediate tables that this thread wrote inside.

    Results that still depend on them must have been written by then.
    """
    paths: list[str] = []
    outer = getattr(_SCOPES, "paths", None)
    _SCOPES.paths = paths
    try:
        yield
    finally:
        _SCOPES.paths = outer
        for path in paths:
            delete_path(spark, path)


@contextmanager
def temporary_conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside; what was set before holds again afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (runs a job).

    Cuts the lineage, fixes anything nondeterministic once and for all, and gives
    the planner the true size of the table. A column of bare NULLs becomes text.
    """
    untyped = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({name: F.col(name).cast("string") for name in untyped})
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="sqlgauge-package-"))
    with zipfile.ZipFile(folder / "sqlgauge.zip", "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(folder / "sqlgauge.zip"))
    _SHIPPED.add(application)
