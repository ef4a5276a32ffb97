"""Shared-folder helpers: every intermediate that outlives a task goes below ``spark.checkpoint.dir``.

The folder is read from the session.  Only where it is unset (tests on one machine) a folder of this
module's own is configured.  Files are opened through ``pyarrow.fs`` so that any store a cluster names by
URI works from executors; each writer publishes with a rename, so a retried task replaces its own output.
"""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_HELD: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where the session names none."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        root = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="opinara-shared-")
        spark.conf.set(_KEY, root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, remembered until it is dropped (see ``drop_scratch``)."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _HELD.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, label: str, thin: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there.

    ``thin`` tables (ids and counts) are written by an eighth of the shuffle partitions, behind a shuffle of their
    own: what makes the rows runs in all tasks.
    """
    path = scratch(df.sparkSession, label)
    (df.repartition(max(1, partitions(df.sparkSession) // 8)) if thin else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(spark: SparkSession) -> list[str]:
    """The scratch paths of this application that still exist, oldest first."""
    return list(_HELD.get(spark.sparkContext.applicationId, ()))


def drop_scratch(spark: SparkSession, keep: int = 0, last: int = 0) -> None:
    """Remove the scratch tables but the first ``keep`` and the ``last`` ones: nothing may read them any more."""
    paths = _HELD.get(spark.sparkContext.applicationId, [])
    gone = paths[keep : len(paths) - last]
    del paths[keep : len(paths) - last]
    jvm = spark.sparkContext._jvm
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def open_fs(uri: str):
    """``(filesystem, path)`` of a URI or plain path, usable on driver and executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes) -> None:
    """Write ``data`` under a name of this attempt, then rename it to ``uri``."""
    where, path = open_fs(uri)
    where.create_dir(posixpath.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(attempt, compression=None) as out:
        out.write(data)
    where.move(attempt, path)


def fetch(uri: str, offset: int = 0, size: int | None = None) -> bytes:
    """A file, or ``size`` bytes of it from ``offset`` on."""
    where, path = open_fs(uri)
    with where.open_input_file(path) as source:
        source.seek(offset)
        return source.read(size)


def trim() -> None:
    """Give freed memory of a Python worker back: workers are reused, and the next task's peak would add to it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A batch function that trims when its partition ends."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
