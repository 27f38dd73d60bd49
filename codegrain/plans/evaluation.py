"""From records to scores: prompts, replies of a text model, verdicts, metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.functions import text as X
from codegrain.operators import examples as S
from codegrain.operators import metrics as M
from codegrain.operators import pruning
from codegrain.operators.enrichment import Completer
from codegrain.session import materialize
from codegrain.sources.tables import spread

BUFFER = 64  # fixed value
NEW_TOKENS = {True: 96, False: 10}  # fixed values: with reasoning and without


@dataclass(frozen=True)
class Evaluation:
    """How records are put to a model: the task, what is left for code, the windows of pruning, the length of a reply."""

    task: str
    context: int
    reserved: int | None  # None: what the prompt, a label and a buffer take
    window: int
    head: int
    tail: int
    new_tokens: int

    @property
    def reads_verdict_line(self) -> bool:
        """Whether a reply is read by its verdict line; else by the bare word."""
        return self.task == "task_a_cot"

    @property
    def budget(self) -> int:
        return code_budget(self.task, self.context) if self.reserved is None else max(0, self.context - self.reserved)


# Context, reserve, windows and length of the reply of each evaluation.
EVALUATIONS = {
    "verdict": Evaluation("task_a", 8192, None, 12, 20, 15, 10),
    "verdict_reasoned": Evaluation("task_a_cot", 8192, None, 12, 20, 15, 96),
    "auxiliary": Evaluation("task_b", 6144, 512, 12, 20, 15, 64),
    "lines": Evaluation("task_b", 6144, 512, 3, 8, 6, 128),
    "test": Evaluation("task_a", 8192, 256, 12, 20, 15, 10),
}
# What is evaluated after a stage, and the folder of a stage's checkpoints.
AFTER_STAGE = {"aux_pretrain": ["auxiliary"], "task1_finetune": ["verdict_reasoned"], "joint_finetune": ["verdict_reasoned", "auxiliary"]}
SWEEPS = {"stage1": ("verdict", "stage1_baseline"), "stage2_1": ("lines", "stage2_1_expert"), "stage2_2": ("verdict_reasoned", "stage2_2_fusion")}


def after_stage(stage: str, context: int | None = None) -> dict[str, Evaluation]:
    """The evaluations that follow a training stage, by name, in its context and with its windows."""
    stage = S.ALIASES.get(stage, stage)
    if stage not in AFTER_STAGE:
        raise ValueError(f"unknown stage {stage}")
    window, head, tail = S.PRUNING[stage]
    return {name: replace(EVALUATIONS[name], window=window, head=head, tail=tail, context=context or EVALUATIONS[name].context) for name in AFTER_STAGE[stage]}


def sweep_of(stage: str, root: str = "out") -> tuple[Evaluation, str]:
    """The evaluation of a stage's checkpoints and the folder that holds them."""
    if stage not in SWEEPS:
        raise ValueError(f"no sweep for stage {stage}")
    name, folder = SWEEPS[stage]
    return EVALUATIONS[name], f"{root}/{folder}"


def code_budget(task: str, context: int) -> int:
    """What the prompt, a one-word label and a buffer leave of the context; never below 0."""
    longest = max(len(pruning.PIECE.findall(x)) for x in ("Vulnerable", "Safe"))
    return max(0, context - S.prompt_length(task) - longest - BUFFER)


def predicted(df: DataFrame, key: str, code: str, events: str, make: Callable[[], Completer], how: Evaluation, concurrent: int = 20) -> DataFrame:
    """``(key, pred)``: the verdict of the model on each record, as ``how`` says.

    Prompts that show events show them whole. Each partition has a model of its own and ``concurrent`` requests
    at a time. The result is a written table, so the model is asked once however often it is read.
    """
    rows = spread(df.select(key, code, events), key)
    asked = pruning.prune(rows, code, events, how.budget, "_code", how.window, how.head, how.tail).select(key, S.prompt(how.task, F.col("_code"), F.col(events)).alias("prompt"))

    @F.pandas_udf(T.StringType())
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        complete = make()
        with ThreadPoolExecutor(concurrent) as pool:
            for b in batches:
                yield pd.Series(list(pool.map(lambda p: complete([{"role": "user", "content": p}], max_tokens=how.new_tokens), b)), dtype=object)

    read = X.verdict if how.reads_verdict_line else X.verdict_by_substring
    return materialize(asked.select(key, read(reply("prompt")).alias("pred")), "predictions")


def predictions(df: DataFrame, key: str, code: str, events: str, make: Callable[[], Completer], reasoning: bool, context: int = 8192, window: int = 12, head: int = 20, tail: int = 15) -> DataFrame:
    """``predicted`` for the verdict, with ``reasoning`` or without."""
    how = EVALUATIONS["verdict_reasoned" if reasoning else "verdict"]
    return predicted(df, key, code, events, make, replace(how, context=context, window=window, head=head, tail=tail))


def scores(df: DataFrame, key: str, target: str, predicted: DataFrame, *groups: str) -> DataFrame:
    """Scores of predictions, over all or per column of ``predicted``; a target that is no number counts as 0."""
    known = df.select(key, F.coalesce(X.number_of_dirty(F.col(target)), F.lit(0)).alias("_target"))
    return M.binary_metrics(known.join(predicted, key), "_target", "pred", *groups)


def sweep(df: DataFrame, key: str, target: str, by_checkpoint: DataFrame, step: str = "step") -> tuple[DataFrame, DataFrame]:
    """The scores of every checkpoint of ``by_checkpoint(step, key, pred)`` in one aggregation, and the best by f1, first by step."""
    table = scores(df, key, target, by_checkpoint, step)
    return table.orderBy(step), M.best(table, "f1", step)


def report(table: DataFrame, checkpoint: str = "checkpoint") -> DataFrame:
    """Scores under the names of a report: F1, Accuracy, Precision, Recall, Checkpoint."""
    return table.select(F.col("f1").alias("F1"), F.col("accuracy").alias("Accuracy"), F.col("precision").alias("Precision"), F.col("recall").alias("Recall"), F.col(checkpoint).alias("Checkpoint"))
