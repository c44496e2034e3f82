"""The results tree: one folder per configuration, one report file of each kind in it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import materialise, ship_package, temporary_conf

# A folder that a plain name cannot have, or that readers skip, is written like this.
_MARK = "config="
_PLAIN = re.compile(r"(?!config=)[^._/\x00-\x1f][^/\x00-\x1f]*")
# Folders listed by one task of the listing job; Spark itself would give each its own.
_LISTING_TASKS = 32


def folder_name(config: str) -> str:
    """The folder of a configuration: its name, or ``config=`` and the quoted name where
    the name cannot be a folder or readers would skip it."""
    return config if _PLAIN.fullmatch(config) else f"{_MARK}{quote(config, safe='')}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Written(WriterCommitMessage):
    """How many files a task published."""

    def __init__(self, files: int):
        self.files = files


class ReportWriter(DataSourceArrowWriter):
    """Writes each row's ``value`` as the file ``root/<config>/<file_name>``.

    A task writes its files into a folder of its own under ``root/_staging`` and moves
    them into place when it has read all its rows, each in one step. A task that fails or
    runs twice therefore publishes whole files or none, and the same ones. Readers skip
    names that begin with an underscore.
    """

    def __init__(self, root: str, file_name: str):
        self.root, self.file_name = root.rstrip("/"), file_name
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = file_system(self.root)
        staging = f"{root}/_staging/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(staging, recursive=True)
        folders: list[str] = []
        for batch in iterator:
            configs, values = (batch.column(c).to_pylist() for c in ("config", "value"))
            for config, value in zip(configs, values, strict=True):
                with system.open_output_stream(f"{staging}/{len(folders)}") as out:
                    out.write(value.encode())
                folders.append(folder_name(config))
        for number, folder in enumerate(folders):
            system.create_dir(f"{root}/{folder}", recursive=True)
            system.move(f"{staging}/{number}", f"{root}/{folder}/{self.file_name}")
        return _Written(len(folders))

    def _clear(self) -> None:
        system, root = file_system(self.root)
        staging = f"{root}/_staging/{self.job}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


class ReportTree(DataSource):
    """``df.write.format("report_tree")`` with options ``root`` and ``file_name``."""

    @classmethod
    def name(cls) -> str:
        return "report_tree"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["root"], self.options["file_name"])


def write_results_tree(reports: DataFrame, root: str, file_name: str) -> None:
    """One report per configuration as ``root/<config>/<file_name>``, in one job.

    ``config`` names the folder and is left out of the file, a JSON object that keeps keys
    whose value is null. A null or repeated configuration is a ValueError: two reports
    cannot be one file. Existing files of the same name are replaced.
    """
    spark = reports.sparkSession
    columns = [F.col(c) for c in reports.columns if c != "config"]
    values = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    ready = materialise(reports.select("config", values.alias("value")), "reports")
    wrong = ready.groupBy("config").count().where("config IS NULL OR count > 1").head(1)
    if wrong:
        raise ValueError(f"not one report for configuration {wrong[0]['config']!r}")
    ship_package(spark)
    spark.dataSource.register(ReportTree)
    ready.write.format("report_tree").mode(
        "append"
    ).option("root", root).option("file_name", file_name).save()


def _depth(spark: SparkSession, root: str) -> int:
    """Folders above and with ``root``, in its own file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len([part for part in system.makeQualified(path).toUri().getPath().split("/") if part])


def _listed(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """All files of these names, and part files, below ``root``: path and whole text.

    The folders are listed by a few tasks, not by one each.
    """
    few = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(_LISTING_TASKS)}
    with temporary_conf(spark, few):
        return (
            spark.read.option("pathGlobFilter", "{" + ",".join([*names, "part-*"]) + "}")
            .text(root, wholetext=True, recursiveFileLookup=True)
            .select(F.col("_metadata.file_path").alias("path"), "value")
        )


def read_tree(spark: SparkSession, root: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Per file name the reports of a results tree with their ``config`` (runs a job).

    Reports are ``root/<config>/<file name>``, a file of one JSON object each. Folders that
    Spark wrote are read too: ``root/<config>/<file name>/part-*`` and
    ``root/<file name>/config=<config>/part-*``, a JSON object a line. Anything deeper is
    none of them. All files are listed and read once, whatever their number and kinds.
    Malformed files fail the read; empty ones count as absent.
    """
    names = list(schemas)
    path = F.regexp_replace("path", r"^[^:/]+:(?://[^/]*)?", "")
    tail = F.slice(F.split(path, "/"), _depth(spark, root) + 2, 1000)
    first, second, third = (F.get("tail", F.lit(k)) for k in range(3))
    part = F.coalesce(third.startswith("part-"), F.lit(False))

    def decoded(text):
        return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))

    folder = decoded(first)
    marked = F.substring(folder, len(_MARK) + 1, 1 << 30)
    own = F.when(folder.startswith(_MARK), decoded(marked)).otherwise(folder)
    spark_name = F.substring(decoded(second), len(_MARK) + 1, 1 << 30)
    found = _listed(spark, root, names).select("value", tail.alias("tail"))
    in_folder = second.isin(names) & ((F.size("tail") == 2) | ((F.size("tail") == 3) & part))
    in_table = first.isin(names) & (F.size("tail") == 3) & part & second.startswith(_MARK)
    files = materialise(
        found.select(
            "value",
            F.when(in_folder, second).when(in_table, first).alias("file"),
            F.when(in_folder, own)
            .when(spark_name != "__HIVE_DEFAULT_PARTITION__", decoded(spark_name))
            .alias("config"),
            F.coalesce(third.isNotNull(), F.lit(False)).alias("lines"),
        ).where("file IS NOT NULL"),
        "tree",
    )
    texts = files.select(
        "file",
        "config",
        F.explode(
            F.when(F.col("lines"), F.split("value", "\n")).otherwise(F.array("value"))
        ).alias("value"),
    ).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    return {
        name: texts.where(F.col("file") == name)
        .select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "config")
        .select("r.*", "config")
        for name, schema in schemas.items()
    }
