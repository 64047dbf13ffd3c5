"""Versioned tables of Parquet files: a data source whose writes are seen whole or not at all.

Tasks write files of their own under the table's folder.  When all have, the driver writes a manifest that lists the files of
the new version and then moves one pointer file, by a rename, to it; readers follow the pointer.  A task or job that dies
leaves files that no manifest lists, and the version before stays readable.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

POINTER, FORMAT = "CURRENT", "snapshot"
#: once: only a table without a version is written; append: files are added to the version before; replace: they are all.
MODES = ("once", "append", "replace")
ROWS = 100_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{posixpath.abspath(path)}")


def current_version(path: str) -> dict | None:
    """The manifest of the version that readers see: version, files, schema; None if there is none."""
    system, root = _open(path)
    try:
        with system.open_input_stream(f"{root}/{POINTER}") as f:
            name = f.read().decode()
    except FileNotFoundError:
        return None
    with system.open_input_stream(f"{root}/{name}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.mode, self.schema = options["path"], options.get("kind", "append"), schema.json()
        self.expected = int(options["expected"]) if "expected" in options else None
        self.job = uuid.uuid4().hex
        self.arrow = to_arrow_schema(schema)
        if self.mode not in MODES:
            raise ValueError(f"kind must be one of {', '.join(MODES)}")
        if self.mode == "once" and current_version(self.path) is not None:
            raise FileExistsError(f"{self.path} is written already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        name, out = f"parts/{self.job}/{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(f"{root}/parts/{self.job}", recursive=True)
                out = pq.ParquetWriter(f"{root}/{name}", self.arrow, filesystem=system)
            out.write_table(pa.Table.from_batches([batch]).cast(self.arrow), row_group_size=ROWS)
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        before = current_version(self.path)
        version = before["version"] if before else 0
        if self.mode == "once" and before or self.expected is not None and version != self.expected:
            self.abort(messages)
            raise RuntimeError(f"{self.path} has moved on to version {version}")
        files = [m.file for m in messages if m is not None and m.file]
        kept = before["files"] if before and self.mode == "append" else []
        system.create_dir(f"{root}/manifests", recursive=True)
        name = f"manifests/{version + 1:010d}-{self.job}.json"
        for target, said in ((name, json.dumps({"version": version + 1, "files": kept + files, "schema": self.schema})), (f"{POINTER}.{self.job}", name)):
            with system.open_output_stream(f"{root}/{target}") as f:
                f.write(said.encode())
        system.move(f"{root}/{POINTER}.{self.job}", f"{root}/{POINTER}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        if system.get_file_info(f"{root}/parts/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/parts/{self.job}")


class Snapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(schema, dict(self.options))


def write_snapshot(rows: DataFrame, path: str, kind: str = "append", expected: int | None = None) -> None:
    """A new version of the table at path, a folder that driver and executors share, of rows and, if kind is append, those before.

    expected: fails unless this is the version when the write is complete (0: none), so a writer that has read a version
    does not overwrite a later one.  The check and the rename are two steps: of two writers that commit within the same
    moment the later one stays, so one table has one writer at a time.
    """
    rows.sparkSession.dataSource.register(Snapshot)
    writer = rows.write.format(FORMAT).mode("append").option("path", path).option("kind", kind)
    (writer if expected is None else writer.option("expected", str(expected))).save()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that the pointer names; later writes do not change them."""
    found = current_version(path)
    if found is None:
        raise FileNotFoundError(f"{path} has no version")
    schema = StructType.fromJson(json.loads(found["schema"]))
    if not found["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{name}" for name in found["files"]])


def replace_keys(rows: DataFrame, path: str, keys: list[str]) -> None:
    """A version in which rows stand for all rows that share their keys (null keys too); others stay as they are."""
    spark, before = rows.sparkSession, current_version(path)
    if before is None:
        return write_snapshot(rows, path, "replace", 0)
    old = read_snapshot(spark, path)
    given = rows.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return write_snapshot(old.join(given, same, "left_anti").unionByName(rows), path, "replace", before["version"])
