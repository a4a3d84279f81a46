"""Sessions for tests and benches, and this package on the executors' path."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tensorquay")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = b.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tensorquay-"), "tensorquay_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    spark.sparkContext.addPyFile(path)


_folders: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one for local sessions where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if not _folders:
        _folders.append(tempfile.mkdtemp(prefix="tensorquay-"))
        atexit.register(shutil.rmtree, _folders[0], ignore_errors=True)
    return "file://" + _folders[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, as a Parquet table in the shared folder."""
    path = f"{scratch_folder(df.sparkSession)}/tensorquay/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query``, after its session has this package on the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
