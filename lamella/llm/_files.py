"""Files written by tasks in any store that pyarrow reaches (local, HDFS, S3, GCS): temporary names, renames, manifests.

A task writes each file under a name of its own attempt and renames it when it is whole. Contents depend on the shard
alone, so a second attempt (a lost executor, speculation) replaces a file by an equal one. Readers go by the manifest,
which the driver commits last; files that it doesn't name don't count.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def store(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URL, and the path in it. Spark writes file:/ and s3a:// where pyarrow says file:/// and s3://; a bare
    path is a local one."""
    if "://" not in url:
        url = "file://" + url.removeprefix("file:")
    return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))


class WholeFile:
    """A file that gets its name when it is closed."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = store(folder)
        self.name = name
        self.temporary = f"{self.folder}/_temporary/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")


def commit_manifest(rows: DataFrame, folder: str) -> DataFrame:
    """Runs the writing tasks, whose rows tell of their files, then writes the manifest; rows read from it."""
    spark: SparkSession = rows.sparkSession
    rows.write.mode("overwrite").json(f"{folder}/_manifest")
    files, at = store(folder)
    try:
        files.delete_dir(f"{at}/_temporary")
    except FileNotFoundError:
        pass
    return spark.read.schema(rows.schema).json(f"{folder}/_manifest")
