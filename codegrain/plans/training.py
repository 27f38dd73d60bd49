"""From records to packed training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions import text as X
from codegrain.operators import examples as S
from codegrain.operators import statements
from codegrain.sources import jsonl
from codegrain.sources.tables import latest


def with_events(df: DataFrame, key: str, code: str, into: str) -> DataFrame:
    """Records with event texts made anew from their code; old ones are replaced."""
    return df.drop(into).join(statements.generated(df, key, code).withColumnRenamed("ir", into), key, "left")


def training_set(df: DataFrame, key: str, code: str, events: str, target: str, order: str, stage: str, context: int = 6144, epoch: int = 0) -> DataFrame:
    """``(key, task, input_ids, labels, attention_mask, label_truncated)`` for a stage and an epoch.

    Re-deliveries are reduced to the last by ``order``, dirty targets read as numbers (none: 0), and the
    windows are those of the stage.
    """
    stage = S.ALIASES.get(stage, stage)
    window, head, tail = S.PRUNING[stage]
    rows = latest(df.select(key, code, events, target, order), key, order).withColumn("_label", F.coalesce(X.number_of_dirty(F.col(target)), F.lit(0)))
    made = S.build(rows, key, code, events, "_label", stage, context, epoch, window, head, tail)
    return S.packed(made, "prompt", "completion", context).drop("prompt", "completion")


def splits(spark: SparkSession, train: str, valid: str | None, schema: str = jsonl.SAMPLES) -> dict[str, DataFrame | None]:
    """The training split, and the validation split if its path is given and there is something at it."""
    there = bool(valid) and jsonl.present(spark, valid)
    return {"train": jsonl.read_lenient(spark, train, schema), "validation": jsonl.read_lenient(spark, valid, schema) if there else None}


DATASETS = {"records": training_set}


def dataset(name: str):
    """The function that makes the training set of a name."""
    if name not in DATASETS:
        raise NotImplementedError(f"no dataset {name}")
    return DATASETS[name]
