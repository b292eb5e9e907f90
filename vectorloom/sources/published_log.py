"""Run log with a commit: the records of a run show up once and all together, or not at all.

Tasks write their records as part files. The driver publishes them by a small commit file that is named
by the run id and lists the parts; readers take listed parts only. A task that is repeated leaves a part that
nothing lists, a job that fails leaves no commit, and a job that is run again under the same id finds the commit
and withdraws its own parts.

Defined results: columns that `runs` lacks are null; a run without records is published and has no rows; an
absent log is empty. Two jobs that commit one id at the same time both name the same file, and one of them stays.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from vectorloom.sources.files import open_folder, put, shared_uri
from vectorloom.sources.runlog import RUN_SCHEMA

PUBLISHED_SCHEMA = StructType(
    [
        StructField("split", StringType()),
        StructField("rows", LongType()),
        StructField("majority_share", DoubleType()),
        *RUN_SCHEMA.fields,
    ]
)
COMMIT = "run_id string, part string"
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


@dataclass
class PartWritten(WriterCommitMessage):
    name: str | None  # None: the task had no records


class RunLogWriter(DataSourceWriter):
    def __init__(self, uri: str, run_id: str):
        self.uri, self.run_id = uri, run_id
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> PartWritten:
        first = next(iterator, None)
        if first is None:
            return PartWritten(None)
        filesystem, root = open_folder(self.uri)
        task = TaskContext.get()
        name = f"{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}.json"
        filesystem.create_dir(f"{root}/parts", recursive=True)
        with filesystem.open_output_stream(f"{root}/parts/{name}") as sink:
            sink.write(first[0].encode() + b"\n")
            for row in iterator:
                sink.write(row[0].encode() + b"\n")
        return PartWritten(name)

    def commit(self, messages: list[PartWritten | None]) -> None:
        filesystem, root = open_folder(self.uri)
        target = f"{root}/commits/{hashlib.sha256(self.run_id.encode()).hexdigest()}.json"
        if filesystem.get_file_info(target).type != pafs.FileType.NotFound:
            self.abort(messages)
            return
        names = [m.name for m in messages if m is not None and m.name]
        lines = [json.dumps({"run_id": self.run_id, "part": name}) for name in names]
        for folder in ("commits", "pending"):
            filesystem.create_dir(f"{root}/{folder}", recursive=True)
        put(filesystem, f"{root}/pending/{self.job}.json", "".join(line + "\n" for line in lines).encode())
        filesystem.move(f"{root}/pending/{self.job}.json", target)

    def abort(self, messages: list[PartWritten | None]) -> None:
        filesystem, root = open_folder(self.uri)
        for message in messages:
            if message is not None and message.name:
                filesystem.delete_file(f"{root}/parts/{message.name}")


class RunLogSink(DataSource):
    """Takes one column of JSON records; options `path` (a full address) and `runId`."""

    @classmethod
    def name(cls) -> str:
        return "runlog"

    def writer(self, schema: StructType, overwrite: bool) -> RunLogWriter:
        if overwrite:
            raise ValueError("a run log is only appended to")
        return RunLogWriter(self.options["path"], self.options["runId"])


def publish_runs(runs: DataFrame, path: str, run_id: str) -> None:
    """Publish the records of `runs` under `run_id`; an id that is already published keeps what it has."""
    unknown = set(runs.columns) - set(PUBLISHED_SCHEMA.names)
    if unknown:
        raise ValueError(f"unknown run fields: {sorted(unknown)}")
    if not run_id:
        raise ValueError("a run needs an id")
    spark, known = runs.sparkSession, set(runs.columns)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PUBLISHED_SCHEMA.fields if f.name in known]
    record = F.to_json(F.struct(*columns), {"timestampFormat": MICROSECONDS})
    spark.dataSource.register(RunLogSink)
    sink = runs.select(record.alias("record")).write.format("runlog").mode("append")
    sink.option("runId", run_id).save(shared_uri(spark, path))


def published_runs(spark: SparkSession, path: str) -> DataFrame:
    """`run_id` and the record columns of all published runs."""
    uri = shared_uri(spark, path)
    filesystem, root = open_folder(uri)
    folders = filesystem.get_file_info([f"{root}/commits", f"{root}/parts"])
    if any(f.type == pafs.FileType.NotFound for f in folders):
        return spark.createDataFrame([], StructType([StructField("run_id", StringType()), *PUBLISHED_SCHEMA.fields]))
    commits = spark.read.schema(COMMIT).json(f"{uri}/commits")
    parts = spark.read.schema(PUBLISHED_SCHEMA).json(f"{uri}/parts")
    parts = parts.select("*", F.col("_metadata.file_name").alias("part"))
    return parts.join(commits, "part").select("run_id", *PUBLISHED_SCHEMA.names)
