"""What operators need of a session: the shared folder, tables kept in it, the package on workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, which shares every folder with itself."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    temporary folder is made and set on a local master (tests); on a cluster, whose machines
    don't share such a folder, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_MADE: list[str] = []  # folders in the shared one that this process has written


def made(path: str) -> str:
    """Remembers a folder in the shared one, for clear()."""
    _MADE.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes what this process has written to the shared folder. Call it when no result is read any
    more: tables that are kept are what later plans read."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())  # noqa: SLF001
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def kept(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again. What a plan draws
    anew each time that it runs (samples for range borders, ids by partition) is settled by this."""
    path = made(f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows(spark: SparkSession, values: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of whole numbers and nulls that is part of the plan itself."""
    names = [c.split()[0] for c in schema.split(",")]
    if not values:
        return spark.createDataFrame([], schema)
    text = ", ".join("(" + ", ".join("NULL" if x is None else str(int(x)) for x in v) + ")" for v in values)
    df = spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")
    return df.select(*[df[c.split()[0]].cast(c.split()[1]) for c in schema.split(",")])


def ship(spark: SparkSession) -> None:
    """Sends this package to Python workers, which unpickle functions by their module's name. Workers of a
    local master have the driver's path; executors fetch a file from the driver, once a context."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if local(spark):
        seen = [os.path.realpath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]]
        if os.path.realpath(root) in seen:
            return
    if getattr(spark.sparkContext, "_tidemark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidemark", "zip", root, "tidemark"))
    spark.sparkContext._tidemark_shipped = True  # noqa: SLF001
