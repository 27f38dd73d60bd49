"""Spark sessions and the shared folder where lineage is cut."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "codegrain", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every query relies on (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map={
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("CODEGRAIN_DRIVER_MEMORY", "8g"),
    })
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share; the master is {master}")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-codegrain-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so their Python needs no path of its own."""
    context = spark.sparkContext
    if getattr(context, "_codegrain_shipped", False):
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    target = f"{shared_folder(spark)}/codegrain-{uuid.uuid4().hex}.zip"
    files, path = file_system(spark, target)
    out = files.create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target)
    context._codegrain_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the stages after this table only, and
    later readers get column pruning that an RDD checkpoint would not give.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/codegrain/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
