"""Published versions of a table that jobs change as a whole.

A version is a folder that is written once; which one holds is told by the
highest numbered pointer file.  A pointer appears by a rename that fails if its
number is taken, after its data is complete.  So a reader sees the version
before or the one after, never parts of both, a job that dies between the steps
leaves a folder that nobody reads, and of two jobs that change the same version
one is refused.  The rename is atomic where the file system's is (HDFS, local
disks); on an object store put the folder behind a table format instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another job has published after the version that this one began with."""


def _files(spark: SparkSession, root: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    return jvm, path.getFileSystem(conf), lambda name: jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published version numbers, ascending."""
    _, fs, at = _files(spark, root)
    if not fs.exists(at("_pointers")):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at("_pointers")) if f.getPath().getName().isdigit())


def current(spark: SparkSession, root: str) -> int:
    """The version that holds; 0 before the first one."""
    return max(versions(spark, root), default=0)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version (the current one by default) as it was published."""
    version = current(spark, root) if version is None else version
    jvm, fs, at = _files(spark, root)
    pointer = fs.open(at(f"_pointers/{version:010d}"))
    try:
        folder = jvm.org.apache.commons.io.IOUtils.toString(pointer, "UTF-8")
    finally:
        pointer.close()
    return spark.read.parquet(f"{root.rstrip('/')}/{folder}")


def write_data(df: DataFrame, root: str) -> str:
    """The first step: a new folder, which nothing points to yet."""
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root.rstrip('/')}/{folder}")
    return folder


def point(spark: SparkSession, root: str, folder: str, after: int) -> int:
    """The second step: ``folder`` becomes version ``after`` + 1."""
    jvm, fs, at = _files(spark, root)
    fs.mkdirs(at("_pointers"))
    draft, pointer = at(f"_pointers/draft-{uuid.uuid4().hex}"), at(f"_pointers/{after + 1:010d}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, pointer, no_options)  # without OVERWRITE: fails if it is there
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(pointer):
            raise Conflict(f"version {after + 1} of {root} is published already") from e
        raise
    return after + 1


def publish(df: DataFrame, root: str, after: int | None = None) -> int:
    """Write ``df`` and make it the version after ``after`` (the one it was made
    from; the current one by default).  Raises Conflict if that is taken."""
    spark = df.sparkSession
    after = current(spark, root) if after is None else after
    if current(spark, root) != after:
        raise Conflict(f"{root} is at version {current(spark, root)}, not {after}")
    return point(spark, root, write_data(df, root), after)
