"""Tables written to the folder that driver and executors share.

A plan that is used more than once, or whose lineage would be long, is written
as Parquet under ``spark.checkpoint.dir`` and read back. A lost executor then
costs the tasks it was running and nothing else. ``collected`` and ``discard``
delete such tables as soon as nothing reads them any more.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; one of our own only if unset, and only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/millrace-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    for paths in getattr(_open, "lists", ()):
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collected(paths: list[str]) -> Iterator[list[str]]:
    """Adds to ``paths`` all that this thread makes in the shared folder meanwhile."""
    lists = _open.__dict__.setdefault("lists", [])
    lists.append(paths)
    try:
        yield paths
    finally:
        lists.pop()


def read_by(df: DataFrame) -> set[str]:
    """Root paths of the files that a plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(i).toString() for i in range(roots.size())}
    return found


def _whole(jvm, conf, path: str) -> str:
    """A path as plans have it, with file system: the same for /x, file:/x and file:///x where files are local."""
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).makeQualified(at).toString()


def discard(spark: SparkSession, paths: Iterable[str], keep: DataFrame | None = None) -> list[str]:
    """Delete tables of ``paths`` that ``keep`` doesn't read; gives the others."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    held = {_whole(jvm, conf, p) for p in read_by(keep)} if keep is not None else set()
    kept = []
    for path in list(paths):
        if _whole(jvm, conf, path) in held:
            kept.append(path)
            continue
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _written:
            _written.remove(path)
    return kept


def sweep(spark: SparkSession) -> int:
    """Delete what ``materialize`` and ``new_path`` made in this process.

    Call it once the results that read those tables have been written out.
    """
    found = list(_written)
    discard(spark, found)
    return len(found)
