"""Tables that an operator writes once and reads several times.

They live under the folder that ``spark.checkpoint.dir`` names, which driver and executors
share; where that setting is unset, a local session (tests, a notebook) uses a temporary folder of
this machine, and any other session gets an error.  A written table cuts lineage like ``checkpoint()`` does, survives
lost executors, and gives the planner true sizes for its broadcast decisions.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's shared scratch folder, created in local tests where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tensorquay-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tensorquay/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
