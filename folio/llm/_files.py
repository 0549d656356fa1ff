"""Binary files in shared folders, for formats that Spark has no writer for."""

from __future__ import annotations

import re

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style URI (file, hdfs, s3a, gs ...) or local path, and the path in it."""
    uri = re.sub(r"^file:/+", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def task_name() -> str:
    """A name that no other task or attempt of this application has."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}" if t else "driver"


def part_name() -> str:
    """A name of the partition, the same for each attempt and each evaluation of one plan."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}" if t else "driver"
