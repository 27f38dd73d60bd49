"""Training examples: task mixture, prompts, labels, packed token arrays, padding, length statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codegrain.functions import pieces as P
from codegrain.operators import pruning

END, MASK, BUFFER = "<|im_end|>", -100, 50  # fixed values

# The prompts by task; {input} stands for the code, {vulnir} for the reference.
TEMPLATES = {
    "task_a": """<|im_start|>system
You are a security expert specialized in detecting vulnerabilities in code.
<|im_end|>
<|im_start|>user
Determine whether the following code is vulnerable.
Only answer with one word: Vulnerable or Safe.

Input Code:
{input}
<|im_end|>
<|im_start|>assistant
""",
    "task_a_cot": """<|im_start|>system
You are a security expert specialized in detecting vulnerabilities in code.
<|im_end|>
<|im_start|>user
You are given a code snippet and a vulnerability reference.
Analyze if the code is vulnerable and explain briefly.
Then output a strict verdict line: Verdict: Vulnerable or Verdict: Safe.

Input Code:
{input}

Vulnerability Reference:
{vulnir}
<|im_end|>
<|im_start|>assistant
""",
    "task_b": """<|im_start|>system
You are a security expert.
<|im_end|>
<|im_start|>user
Given the code below, identify the vulnerable line(s) and explain.

Input Code:
{input}
<|im_end|>
<|im_start|>assistant
""",
    "task_c": """<|im_start|>system
You are a security expert.
<|im_end|>
<|im_start|>user
Given the code below and a vulnerability reference, generate a vulnerability IR/trace.

Input Code:
{input}

Vulnerability Reference:
{vulnir}
<|im_end|>
<|im_start|>assistant
""",
}
ANSWER_BUDGET = {"task_a_cot": 512, "task_b": 256, "task_c": 256}
# Shares of the tasks by stage, as upper ends of the draw.
MIXTURES = {"aux_pretrain": [("task_c", 0.5), ("task_b", 1.0)], "task1_finetune": [("task_a", 1.0)], "joint_finetune": [("task_a_cot", 0.34), ("task_b", 0.67), ("task_c", 1.0)]}


def around(task: str) -> list[str]:
    """The fixed parts of a prompt: before the code, between code and reference if there is one, after."""
    return re.split(r"\{input\}|\{vulnir\}", TEMPLATES[task])


def prompt(task: str, code: Column, reference: Column) -> Column:
    """Concatenation, not replacement: code may contain anything."""
    parts = [F.lit(x) for x in around(task)]
    middle = [code, parts[1], reference, parts[2]] if len(parts) == 3 else [code, parts[1]]
    return F.concat(parts[0], *[F.coalesce(c, F.lit("")) for c in middle])


def prompt_length(task: str) -> int:
    return len(pruning.PIECE.findall("".join(around(task))))


def code_budget(task: str, context: int) -> int:
    """What the prompt, the answer and a buffer leave of the context for the code."""
    answer = ANSWER_BUDGET.get(task) or max(len(pruning.PIECE.findall(x + END)) for x in ("Vulnerable", "Safe"))
    return context - prompt_length(task) - answer - BUFFER


def label(target: Column) -> Column:
    return F.when(target == 1, "Vulnerable").otherwise("Safe")


def fused(ir: Column, target: Column) -> Column:
    return F.concat(F.lit("Analysis:\n"), F.coalesce(ir, F.lit("")), F.lit("\n\nVerdict: "), label(target))


def draw(key: Column, epoch: int = 0) -> Column:
    """A number in [0, 1) for each key and epoch, by arithmetic that any engine can repeat."""
    return F.pmod(key * 7919 + 104729 + epoch * 15485863, F.lit(1000)) / F.lit(1000.0)


def task(stage: str, roll: Column) -> Column:
    if stage not in MIXTURES:
        raise ValueError(f"unknown stage {stage}")
    out = None
    for name, below in MIXTURES[stage][:-1]:
        out = (F if out is None else out).when(roll < below, name)
    last = F.lit(MIXTURES[stage][-1][0])
    return last if out is None else out.otherwise(last)


def packed(df: DataFrame, prompt_text: str, completion: str, context: int) -> DataFrame:
    """Adds input_ids, labels and attention_mask, cut at ``context``, and whether the cut reached the label."""
    p, c = P.ids(P.pieces(F.col(prompt_text))), P.ids(P.pieces(F.concat(F.col(completion), F.lit(END))))
    out = df.withColumn("_p", p).withColumn("_c", c)
    both = F.concat("_p", "_c")
    labels = F.concat(F.transform("_p", lambda _: F.lit(MASK).cast("long")), F.col("_c"))
    return (out.withColumn("input_ids", F.slice(both, 1, context)).withColumn("labels", F.slice(labels, 1, context))
            .withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1).cast("long")))
            .withColumn("label_truncated", F.size(both) > context).drop("_p", "_c"))


def padded(df: DataFrame, batch: str, pad: int = 0) -> DataFrame:
    """Arrays filled up to the longest of their batch: ids with ``pad``, labels masked, attention 0."""
    longest = F.max(F.size("input_ids")).over(W.partitionBy(batch))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v).cast("long"), F.col("_longest") - F.size(c)))
    return (df.withColumn("_longest", longest).withColumn("input_ids", fill("input_ids", pad)).withColumn("labels", fill("labels", MASK))
            .withColumn("attention_mask", fill("attention_mask", 0)).drop("_longest"))


def build(df: DataFrame, key: str, code: str, ir: str, target: str, stage: str, context: int = 6144, epoch: int = 0, window: int = 12, head: int = 20, tail: int = 15) -> DataFrame:
    """``(key, task, prompt, completion)`` for every record with code.

    The task is drawn by key and epoch, the code pruned to what its task leaves, and the answer is the
    label, the analysis with its verdict, or the event text pruned to 256 pieces.
    """
    out = df.where(F.col(code).isNotNull()).withColumn("task", task(stage, draw(F.col(key), epoch)))
    names = [t for t, _ in MIXTURES[stage]]
    limit = F.create_map(*[F.lit(x) for t in names for x in (t, max(0, code_budget(t, context)))])[F.col("task")]
    out = pruning.prune(out, code, ir, limit, "_code", window, head, tail)
    by_task = lambda make: F.coalesce(*[F.when(F.col("task") == t, make(t)) for t in names])
    answers = {"task_a": label(F.col(target)), "task_a_cot": fused(F.col(ir), F.col(target))}
    return out.select(key, "task", by_task(lambda t: prompt(t, F.col("_code"), F.col(ir))).alias("prompt"),
                      by_task(lambda t: answers[t] if t in answers else pruning.prune_ir(F.col(ir), 256)).alias("completion"))


def length_sample(df: DataFrame, key: str, code: str, size: int = 512) -> DataFrame:
    """Lengths of a uniform sample of non-empty texts: those of the smallest hashes, a top-k per partition."""
    hash_ = F.md5(F.col(key).cast("string").cast("binary"))
    return df.where(F.length(code) > 0).select(key, code, hash_.alias("_h")).orderBy("_h", key).limit(size).select(key, P.count_of(F.col(code)).alias("length"))


def length_statistics(lengths: DataFrame, column: str = "length") -> DataFrame:
    """One row: n, mean, the 50th, 90th and 99th percentiles by index, and the maximum, over a bounded sample."""
    a = F.sort_array(F.collect_list(column))
    n = F.size("a")
    at = lambda q: F.element_at("a", F.least(n, F.floor(n * q).cast("int") + 1))
    return lengths.agg(a.alias("a"), F.avg(column).alias("mean")).select(n.cast("long").alias("n"), "mean", at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.element_at("a", -1).alias("max"))


def tuned_window(stats: DataFrame, context: int, window: int) -> DataFrame:
    """The wider the fewer codes come near the context: at least 14, 12 or 10 lines."""
    p90 = F.col("p90")
    floor = F.when(p90 <= int(context * 0.55), 14).when(p90 <= int(context * 0.75), 12).otherwise(10)
    return stats.withColumn("window", F.greatest(F.lit(window), floor))


@dataclass(frozen=True)
class Stage:
    """What a training stage is run with; explicit values win over those of the stage."""

    stage: str
    epochs: int
    rate: float
    folder: str
    window: int
    head: int
    tail: int


# Epochs, learning rate, folder, window, head and tail by stage; aliases of stages.
STAGES = {"aux_pretrain": (7, 2e-5, "stage1_aux_tasks", 12, 20, 15), "task1_finetune": (4, 2e-5, "stage2_task1", 6, 10, 8), "joint_finetune": (3, 1e-5, "stage3_joint", 6, 10, 8)}
ALIASES = {"stage2_1": "aux_pretrain", "stage1": "task1_finetune", "stage2_2": "joint_finetune"}
PRUNING = {"aux_pretrain": (12, 20, 15), "task1_finetune": (8, 12, 10), "joint_finetune": (6, 10, 8)}


def stage_name(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[name], name)


def resolve(stage: str, root: str = "out", **overrides) -> Stage:
    stage = ALIASES.get(stage, stage)
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    epochs, rate, folder, window, head, tail = STAGES[stage]
    values = {"epochs": epochs, "rate": rate, "folder": f"{root}/{folder}", "window": window, "head": head, "tail": tail}
    return Stage(stage, **(values | {k: v for k, v in overrides.items() if v is not None and (k not in ("window", "head", "tail") or v > 0)}))


def pipeline(root: str = "out") -> list[Stage]:
    """The three stages in their order; each starts from what the one before has left."""
    return [resolve(s, root) for s in STAGES]
