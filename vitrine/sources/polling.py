"""A source that is asked again and again, as a streaming data source with offsets.

Each reading of the polled things is a file of JSON lines (name, value, at) in a folder or below it; the names of files with
their folders grow from one reading to the next. The offset is the name of the last file read, so a stream that starts again from its checkpoint goes on
behind it. What has been worked through is written to ``_done``; whoever makes the readings may delete files up to there.
The folder may be in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

DONE = "_done"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Readings(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _names(self) -> list[str]:
        store, folder = _at(self.path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
        return sorted(posixpath.relpath(f.path, folder) for f in found if f.is_file and f.base_name[0] not in "_.")

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        names = self._names()
        return {"after": names[-1] if names else self._done()}

    def _done(self) -> str:
        store, folder = _at(self.path)
        marker = posixpath.join(folder, DONE)
        if store.get_file_info(marker).type == fs.FileType.NotFound:
            return ""
        with store.open_input_stream(marker) as f:
            return f.read().decode()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(name) for name in self._names() if start["after"] < name <= end["after"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, folder = _at(self.path)
        with store.open_input_stream(posixpath.join(folder, partition.value)) as f:
            for line in f.read().decode().splitlines():
                if line.strip():
                    row = json.loads(line)
                    yield row["name"], row["value"], row["at"]

    def commit(self, end: dict) -> None:
        store, folder = _at(self.path)
        with store.open_output_stream(posixpath.join(folder, DONE)) as f:
            f.write(end["after"].encode())


class Readings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "readings"

    def schema(self) -> str:
        return "name string, value string, at long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Readings(self.options["path"])


def readings(spark: SparkSession, path: str) -> DataFrame:
    """The readings in a folder as a stream (name, value, at)."""
    spark.dataSource.register(Readings)
    return spark.readStream.format("readings").option("path", path).load()


def add_reading(path: str, number: int, rows: list[tuple[str, str | None, int]]) -> None:
    """One reading (name, value, at) of all polled things, as the next file."""
    store, folder = _at(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(posixpath.join(folder, f"{number:010d}.jsonl")) as f:
        f.write("".join(json.dumps({"name": n, "value": v, "at": t}) + "\n" for n, v, t in rows).encode())
