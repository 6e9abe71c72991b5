"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, as in tests, one of our own, but only if driver and
    executors are one process; executors of a cluster don't share local folders.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
    return _LOCAL[app]


def saved(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor, so a lost one costs only the tasks it
    was running. The plan above starts anew from the file scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldloom/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``saved`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_fieldloom_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            df._fieldloom_path = None
