"""Files written by tasks into a folder that all of them reach."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def shared_uri(spark: SparkSession, path: str) -> str:
    """The full address of `path`, with the file system that Spark itself would take for it."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a full address."""
    return pafs.FileSystem.from_uri(uri)


def put(filesystem: pafs.FileSystem, path: str, content: bytes) -> None:
    """Write one file; a repeated task replaces its own."""
    with filesystem.open_output_stream(path) as sink:
        sink.write(content)
