"""Session helpers: local sessions for tests and benchmarks, and the shared work folder."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session.  On a cluster, pass your own session to the library instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@lru_cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="folioforge-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, named by ``spark.checkpoint.dir``.

    A temporary folder stands in only where driver and executors are one process.  Anywhere
    else it would be another folder on each machine, so a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder with master {master!r}")
    return _own_dir(spark.sparkContext.applicationId)


@lru_cache
def _package_zip() -> str:
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="folioforge-")) / package.name
    return shutil.make_archive(str(base), "zip", package.parent, package.name)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session, once.

    Needed where the session was not started with the package on its path, as with
    ``spark-submit --py-files``.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        context.addPyFile(_package_zip())
        _shipped.add(context.applicationId)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, name: str):
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike caching, the result survives the loss of any executor without recomputation.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df) -> None:
    """Delete a table that ``cut_lineage`` wrote, when what was made of it has been written.

    Nothing is deleted but folders with a name of ``new_table_path`` right below the shared one.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    shared = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    top = shared.getFileSystem(conf).makeQualified(shared)
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(conf)
        path = system.makeQualified(path)
        if path.getParent().equals(top) and re.search(r"-[0-9a-f]{32}$", path.getName()):
            system.delete(path, True)
