"""What the corpus operators share: table reading, shared scratch tables, shipping code to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import duovox

#: Bounds of an Arrow batch that goes to a Python worker, unless the session sets its own: long texts make the default too large.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of the input folder; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable on executors and bound the batches sent to Python.

    The package goes out once for each application, as a zip of its sources. Bounds that the user has set stay.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = os.path.dirname(os.path.abspath(duovox.__file__))
        folder = tempfile.mkdtemp(prefix="duovox-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "duovox.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(at, n)
                        z.write(full, os.path.join("duovox", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent on a local master (tests) a temporary folder takes its place; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/duovox-{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    path = path or shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def batch_udf(run: Callable, returns: str, columns: int = 1) -> Callable[..., Column]:
    """A pandas UDF over an iterator of batches; several columns come as tuples. Returns of several fields are data frames.

    Ids stay beside it in the JVM: pandas would turn whole numbers next to a null into doubles, which damages those beyond 2^53.
    """
    out = pd.DataFrame if "," in returns.split("<")[0] or " " in returns.split("<")[0] else pd.Series
    run.__annotations__ = {"parts": Iterator[pd.Series if columns == 1 else tuple[(pd.Series,) * columns]], "return": Iterator[out]}
    return F.pandas_udf(run, returns)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
