"""Binary files in the shared folder, from the driver and from tasks."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs and what else Arrow knows) and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else path)


@contextmanager
def new_file(path: str):
    """A stream to a file that appears whole under its name, or not at all; a repeated task replaces it."""
    store, where = opened(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    part = f"{where}.{uuid.uuid4().hex[:8]}.tmp"
    with store.open_output_stream(part, compression=None) as out:
        yield out
    if store.get_file_info(where).type != fs.FileType.NotFound:
        store.delete_file(where)
    store.move(part, where)


@contextmanager
def stored_file(path: str):
    """A seekable file for reading."""
    store, where = opened(path)
    with store.open_input_file(where) as f:
        yield f


#: Tasks, at most, among which files or blocks are dealt.
MOST_TASKS = 20_000


def tasks(files: int) -> int:
    """A task for each of so many files, MOST_TASKS at most."""
    return min(max(files, 1), MOST_TASKS)


def listed(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names of the folder's files with this suffix, in order."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    return sorted(f.getPath().toString() for f in store.listStatus(where) if f.getPath().getName().endswith(suffix))
