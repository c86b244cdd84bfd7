"""Readers: tables, JSON documents, drop folders as streams, polled values and fan-out sources."""

from __future__ import annotations

import json
import os
import select
import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vitrine.schemas import TABLES


def catalog_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A catalogue table with its declared schema."""
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with a known contract; malformed ones become rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)


def search_results(documents: DataFrame, body: str = "body") -> DataFrame:
    """(title, url, mime, width, height, search_rank) of an encyclopaedia's image search answers."""
    schema = "struct<query:struct<pages:map<string,struct<title:string,index:int,imageinfo:array<struct<url:string,mime:string,width:int,height:int,thumburl:string,thumbwidth:int,thumbheight:int>>>>>>"
    pages = documents.select(F.explode(F.map_values(F.from_json(body, schema)["query"]["pages"])).alias("p"))
    return pages.select("p.title", F.col("p.index").alias("search_rank"), F.explode("p.imageinfo").alias("i")).select(
        "title", F.coalesce("i.thumburl", "i.url").alias("url"), "i.mime", F.coalesce("i.thumbwidth", "i.width").alias("width"), F.coalesce("i.thumbheight", "i.height").alias("height"), "search_rank")


def pushed_updates(spark: SparkSession, path: str) -> DataFrame:
    """A stream of pushed updates: files of one JSON update a line that a gateway drops into a folder."""
    raw = spark.readStream.format("text").load(path)
    get = lambda *paths: F.coalesce(*[F.get_json_object("value", f"$.{p}") for p in paths])
    return raw.select(
        get("update_id").try_cast("long").alias("update_id"), get("message.from.id", "callback_query.from.id").alias("telegram_user_id"), get("message.chat.id", "callback_query.message.chat.id").alias("chat_id"),
        get("message.message_id", "callback_query.message.message_id").try_cast("long").alias("message_id"), get("message.text", "callback_query.data").alias("text"),
        F.timestamp_seconds(get("message.date", "callback_query.message.date").try_cast("long")).alias("created_at"), F.when(get("message.voice.file_id").isNotNull(), "voice").when(get("callback_query.id").isNotNull(), "callback").otherwise("text").alias("kind"), F.col("value").alias("payload"),
    ).where("update_id IS NOT NULL")


def queued_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of jobs from a folder that producers append to; the queue is a column to split by."""
    return spark.readStream.schema(TABLES["jobs"]).parquet(path)


class _FanOutReader(DataSourceReader):
    """One partition for each request; a failed request is a row with an error, not a failed job."""

    def __init__(self, requests: list[str], fetch: Callable[[str], str]) -> None:
        self.requests, self.fetch = requests, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.requests]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            yield partition.value, self.fetch(partition.value), None
        except Exception as error:  # noqa: BLE001
            yield partition.value, None, str(error)[:500]


def fan_out(spark: SparkSession, requests: list[str], fetch: Callable[[str], str], name: str = "fan_out") -> DataFrame:
    """(request, body, error): ``fetch`` called in parallel, a task for each request."""

    class FanOut(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "request string, body string, error string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _FanOutReader(requests, fetch)

    spark.dataSource.register(FanOut)
    return spark.read.format(name).load()


def from_script(tasks: DataFrame, command: list[str], column: str = "payload", timeout: int = 90) -> DataFrame:
    """(payload, output, error): a program run for each row, its input as JSON on stdin, its answer as JSON on stdout."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            outputs, errors = [], []
            for payload in frame[column]:
                try:
                    done = subprocess.run(command, input=payload, capture_output=True, text=True, timeout=timeout)
                    json.loads(done.stdout)
                    outputs.append(done.stdout.strip())
                    errors.append(None if done.returncode == 0 else done.stderr[-500:])
                except (subprocess.TimeoutExpired, ValueError, OSError) as error:
                    outputs.append(None)
                    errors.append(type(error).__name__)
            yield pd.DataFrame({"payload": frame[column], "output": outputs, "error": errors})

    return tasks.select(column).mapInPandas(run, "payload string, output string, error string")


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose first column holds ``most`` bytes or is one row."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column(0)).to_pylist()):
        if i > start and held + (size or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


class _Program:
    """A running program that answers each line of JSON on its stdin with one on its stdout."""

    def __init__(self, command: list[str]) -> None:
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        for pipe in (self.process.stdin, self.process.stdout):
            os.set_blocking(pipe.fileno(), False)

    def ask(self, line: bytes, timeout: float) -> bytes:
        """The answer to a line; TimeoutError or EOFError if there is none."""
        source, sink, until = self.process.stdout.fileno(), self.process.stdin.fileno(), time.monotonic() + timeout
        rest, answer = memoryview(line + b"\n"), bytearray()
        while not answer.endswith(b"\n"):
            left = until - time.monotonic()
            readable, writable, _ = select.select([source], [sink] if rest else [], [], max(0.0, left))
            if not readable and not writable:
                raise TimeoutError
            if writable:
                rest = rest[os.write(sink, rest[:65_536]) :]
            if readable:
                part = os.read(source, 1 << 20)
                if not part:
                    raise EOFError
                answer += part
        return bytes(answer[:-1])

    def end(self) -> None:
        self.process.kill()
        self.process.communicate()


def from_program(tasks: DataFrame, command: list[str], column: str = "payload", timeout: float = 90) -> DataFrame:
    """(payload, output, error): each JSON payload as a line to a program that runs as long as its task, and the line of JSON it answers with.

    A payload without an answer in ``timeout`` seconds, one at which the program ends or says something that is not JSON, and one that is not
    JSON itself are rows with an error; the program is started anew for the next row, so they cost only themselves. Null payloads are errors too.
    Answers are given back every few megabytes of payloads, so a worker holds Python texts of one row and answers of one slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program: _Program | None = None
        try:
            for payloads in (rows.column(0) for batch in batches for rows in _slices(batch)):
                outputs: list[str | None] = []
                errors: list[str | None] = []
                for payload in (p.as_py() for p in payloads):
                    output = error = None
                    try:
                        line = json.dumps(json.loads(payload)).encode()
                    except (ValueError, TypeError):
                        error = "payload is not JSON"
                    else:
                        try:
                            program = program or _Program(command)
                            output = program.ask(line, timeout).decode()
                            json.loads(output)
                        except (TimeoutError, EOFError, ValueError, OSError) as failed:
                            output, error = None, {TimeoutError: "timeout", EOFError: "ended"}.get(type(failed), "answer is not JSON" if isinstance(failed, ValueError) else type(failed).__name__)
                            if program:
                                program.end()
                            program = None
                    outputs.append(output)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([payloads, pa.array(outputs, pa.string()), pa.array(errors, pa.string())], ["payload", "output", "error"])
        finally:
            if program:
                program.end()

    return tasks.select(column).mapInArrow(run, "payload string, output string, error string")


def literal_rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
