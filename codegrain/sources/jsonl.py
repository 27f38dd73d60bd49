"""JSON lines: strict and lenient reading, overwriting in place, appending; CSV summaries; checkpoint folders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.session import file_system

SAMPLES = "idx BIGINT, func STRING, target STRING, vulnir STRING"
PAIRS = "cve STRING, cve_desc STRING, cwe ARRAY<STRING>, func_before STRING, func_after STRING"


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One malformed line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _object(line: Column) -> Column:
    return F.from_json(line, T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})


def parsed_lines(lines: DataFrame, column: str, schema: str | T.StructType, required: str | None) -> DataFrame:
    """Each non-blank line with ``status``: loaded, malformed or missing, and its fields.

    A field that is there but null is not missing.
    """
    rows = lines.where(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")) != "")
    keys = F.json_object_keys(F.col(column))
    well_formed = _object(F.col(column)).isNotNull() & keys.isNotNull() & F.col(column).rlike(r"\}\s*$")
    missing = ~F.array_contains(keys, required) if required else F.lit(False)
    status = F.when(~well_formed, "malformed").when(missing, "missing").otherwise("loaded")
    return rows.withColumn("status", status).withColumn("record", F.from_json(F.col(column), schema))


def read_lenient(spark: SparkSession, path: str, schema: str | T.StructType = SAMPLES, required: str | None = "func") -> DataFrame:
    """Records of well-formed lines that have the required field."""
    return parsed_lines(spark.read.text(path), "value", schema, required).where("status = 'loaded'").select("record.*")


def load_counts(lines: DataFrame, column: str, schema: str = SAMPLES, required: str | None = "func") -> DataFrame:
    status = parsed_lines(lines, column, schema, required)
    return status.agg(F.count_if(F.col("status") == "loaded").alias("loaded"), F.count_if(F.col("status") != "loaded").alias("skipped"))


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a JSON lines folder by ``df``, which may be read from it.

    The new files are written beside it, the old folder is moved aside, the new one moved into its
    place, and only then the old one deleted: at any time one of them is whole, and ``recover`` or
    the next ``overwrite`` brings a folder back that a crash has left aside.
    """
    spark = df.sparkSession
    recover(spark, path)
    df.write.mode("overwrite").json(f"{path}.tmp")
    files, target = file_system(spark, path)
    move = lambda a, b: _moved(files, file_system(spark, a)[1], file_system(spark, b)[1])
    if files.exists(target):
        move(path, f"{path}.old")
    move(f"{path}.tmp", path)
    files.delete(file_system(spark, f"{path}.old")[1], True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash within ``overwrite``: the old folder back in its place if the new one did not get there, else deleted."""
    files, target = file_system(spark, path)
    old = file_system(spark, f"{path}.old")[1]
    if files.exists(old):
        if files.exists(target):
            files.delete(old, True)
        else:
            _moved(files, old, target)


def _moved(files, a, b) -> None:
    if not files.rename(a, b):
        raise OSError(f"could not move {a} to {b}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_inferred(spark: SparkSession, path: str, required: str | None = None) -> DataFrame:
    """JSON lines with the schema that Spark finds in them; lines that are no JSON, or lack ``required``, are left out."""
    found = spark.read.option("columnNameOfCorruptRecord", "_corrupt_record").json(path).schema
    schema = T.StructType([f for f in found.fields if f.name != "_corrupt_record"])
    rows = read_lenient(spark, path, schema, required)
    return rows.where(F.col(required).isNotNull()) if required else rows


def present(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, so a run over a missing input can end before it begins."""
    files, at = file_system(spark, path)
    return bool(files.exists(at))


def write_summary(df: DataFrame, path: str, *order: str) -> None:
    """A small report as one CSV file with a header."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary_path(checkpoint: str, name: str = "summary", at: datetime | None = None) -> str:
    """Where the report of a checkpoint goes: beside it, in its parent folder, under a name with the time."""
    parent = checkpoint.rstrip("/").rpartition("/")[0]
    return f"{parent or '.'}/{name}_{(at or datetime.now()):%Y%m%d_%H%M%S}"


def checkpoint_steps(folders: DataFrame, name: str) -> DataFrame:
    """Folders called ``checkpoint-N`` with their number, in its order; others are left out."""
    step = F.regexp_extract(F.col(name), r"checkpoint-(\d+)$", 1).try_cast("long")
    return folders.withColumn("step", step).where("step is not null").orderBy("step")
