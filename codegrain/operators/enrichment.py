"""Enrichment of pairs by a text model: fingerprints, resume, conversations, failures, statistics.

The model is a ``Completer``: a batch of message lists in, a batch of replies out.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions import text as X
from codegrain.session import materialize
from codegrain.sources.tables import spread

OVERFLOW, FAILED = "[Skipped: Context Overflow]", "[Analysis Failed]"  # fixed values
GOOD, BAD = "HIGH_MULTITURN", "FAIL"
PAIR_BUDGET, MARGIN = 13_000, 1_000


class Completer(Protocol):
    def __call__(self, messages: list[dict[str, str]], **options) -> str: ...


# What the last reply of a conversation must look like.
REPLY_SCHEMA = {"type": "object", "properties": {"root_cause": {"type": "string"}, "safety_justification": {"type": "string"}}, "required": ["root_cause", "safety_justification"]}


@dataclass(frozen=True)
class Sampling:
    """How the model draws its replies."""

    temperature: float = 0.2
    top_p: float = 0.95
    max_tokens: int = 800
    repetition_penalty: float = 1.05
    top_k: int = 50

    def options(self, last: bool) -> dict:
        """Options of one request; the last of a conversation is guided by the schema of the reply."""
        return asdict(self) | ({"json": True, "schema": REPLY_SCHEMA} if last else {"json": False})


class ContextOverflow(Exception):
    """The model can't take so long a conversation; trying again is of no use."""


def fingerprint(cve: str, before: str) -> Column:
    """What identifies a pair: md5 of both fields; null counts as missing."""
    return F.md5(F.concat(F.coalesce(F.col(cve), F.lit("")), F.lit("|"), F.coalesce(F.col(before), F.lit(""))).cast("binary"))


def remaining(pairs: DataFrame, done: DataFrame, cve: str = "cve", before: str = "func_before") -> DataFrame:
    """Pairs whose fingerprint is not among the done ones, failed ones included; copies within the input stay."""
    seen = done.select(fingerprint(cve, before).alias("_fp")).distinct()
    return pairs.withColumn("_fp", fingerprint(cve, before)).join(seen, "_fp", "left_anti").drop("_fp")


def skipped(pairs: DataFrame, done: DataFrame, cve: str = "cve", before: str = "func_before") -> DataFrame:
    seen = done.select(fingerprint(cve, before).alias("_fp")).distinct()
    return pairs.withColumn("_fp", fingerprint(cve, before)).join(seen, "_fp", "left_semi").drop("_fp")


def within_budget(df: DataFrame, before: str = "func_before", after: str = "func_after", budget: int = PAIR_BUDGET) -> DataFrame:
    """Both functions truncated where together they exceed the budget, and a flag that says so."""
    over = X.over_pair_budget(F.col(before), F.col(after), budget)
    each = (budget - MARGIN) // 2
    return df.withColumn("_over", over).withColumns({c: F.when(F.col("_over"), X.truncate_middle(F.col(c), each)).otherwise(F.col(c)) for c in (before, after)}).withColumnRenamed("_over", "truncated")


def weaknesses(cwe: Column) -> Column:
    return X.joined_list(cwe, "Unknown CWE")


def description(text: Column, cwe: Column) -> Column:
    return F.coalesce(F.when(text != "", text), F.concat(F.lit("A vulnerability classified as "), weaknesses(cwe), F.lit(".")))


def retried(complete: Completer, messages: list[dict[str, str]], attempts: int = 3, wait: Callable[[float], None] = time.sleep, **options) -> str:
    """Up to three attempts, one and two seconds apart; an overflow is final."""
    for k in range(attempts):
        try:
            return complete(messages, **options)
        except Exception as e:
            if "maximum context length" in str(e):
                raise ContextOverflow from e
            if k == attempts - 1:
                raise
            wait(2.0**k)
    raise AssertionError


def converse(complete: Completer, system: str, turns: list[str], attempts: int = 3, wait: Callable[[float], None] = time.sleep, sampling: Sampling = Sampling()) -> dict:
    """A conversation whose last turn asks for JSON; its fields fall back to the second and third replies."""
    messages, replies = [{"role": "system", "content": system}], []
    try:
        for k, turn in enumerate(turns):
            messages.append({"role": "user", "content": turn})
            replies.append(retried(complete, messages, attempts, wait, **sampling.options(k == len(turns) - 1)))
            messages.append({"role": "assistant", "content": replies[-1]})
        final = json.loads(replies[-1])
        return {"root_cause": final.get("root_cause", replies[1]), "safety_justification": final.get("safety_justification", replies[2]), "quality_tag": GOOD}
    except ContextOverflow:
        return {"root_cause": OVERFLOW, "safety_justification": FAILED, "quality_tag": BAD}
    except Exception:
        return {"root_cause": FAILED, "safety_justification": FAILED, "quality_tag": BAD}


def turns(before: str, after: str, cve: str, described: str) -> list[Column]:
    """The four requests of a conversation: the difference, the cause, the justification, the summary."""
    return [
        F.concat(F.lit("Compare the code before the fix:\n"), F.coalesce(F.col(before), F.lit("")), F.lit("\nwith that after it:\n"), F.coalesce(F.col(after), F.lit("")), F.lit("\nName what was added or changed.")),
        F.concat(F.lit("Context: "), F.coalesce(F.col(cve), F.lit("Unknown CVE")), F.lit(" - "), F.col(described), F.lit("\nExplain the root cause in 30 to 100 words.")),
        F.lit("Explain in 30 to 100 words why the fix is safe."),
        F.lit("Put root_cause and safety_justification into one JSON object."),
    ]


def checked_reply(reply: Column) -> Column:
    """Whether a reply is a JSON object with both texts as strings, as its schema asks; null counts as none."""
    value = F.try_parse_json(reply)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.coalesce((kind("root_cause") == "STRING") & (kind("safety_justification") == "STRING"), F.lit(False))


def synthesis(reply: Column, cause: Column, justification: Column) -> Column:
    """struct(root_cause, safety_justification, quality_tag) of the last reply of a conversation.

    A field that the reply lacks is the earlier reply; a reply that is no JSON object fails the record.
    """
    value = F.try_parse_json(reply)
    sound = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    field = lambda name, other: F.when(sound, F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), other)).otherwise(F.lit(FAILED))
    return F.struct(field("root_cause", cause).alias("root_cause"), field("safety_justification", justification).alias("safety_justification"), F.when(sound, GOOD).otherwise(BAD).alias("quality_tag"))


ANSWER = "root_cause string, safety_justification string, quality_tag string"


def enriched(df: DataFrame, key: str, make: Callable[[], Completer], system: str, concurrent: int = 20, sampling: Sampling = Sampling()) -> DataFrame:
    """``df`` with ``root_cause``, ``safety_justification`` and ``quality_tag``; one row out for each row in.

    Expects func_before, func_after, cve, cve_desc and cwe. Each partition has a client of its own and
    ``concurrent`` conversations at a time. The model sees functions over the budget truncated, which
    ``truncation_warning`` tells; the record keeps its own. Small tables are spread over all
    cores by ``key``, which may repeat, as nothing is joined; columns of the
    new names are replaced. The result is a written table, so the model is asked once however often it is read.
    """
    @F.pandas_udf(ANSWER)
    def talk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        complete = make()
        with ThreadPoolExecutor(concurrent) as pool:
            for b in batches:
                done = list(pool.map(lambda t: converse(complete, system, list(t), sampling=sampling), b))
                yield pd.DataFrame(done, columns=["root_cause", "safety_justification", "quality_tag"])

    over = X.over_pair_budget(F.col("func_before"), F.col("func_after"), PAIR_BUDGET)
    short = lambda c: F.when(over, X.truncate_middle(F.col(c), (PAIR_BUDGET - MARGIN) // 2)).otherwise(F.col(c))
    rows = spread(df.drop("root_cause", "safety_justification", "quality_tag", "truncation_warning"), key)
    ready = rows.withColumns({"_before": short("func_before"), "_after": short("func_after"), "_described": description(F.col("cve_desc"), F.col("cwe")), "truncation_warning": F.when(over, True)})
    asked = ready.withColumn("_answer", talk(F.array(*turns("_before", "_after", "cve", "_described"))))
    return materialize(asked.select(*rows.columns, "_answer.*", "truncation_warning"), "enriched")


def run_statistics(df: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: records, successes, truncated ones and their percentages; with ``seconds`` of the run also records a second."""
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("total")), F.lit(0.0))
    counts = df.agg(F.count("*").alias("total"), F.count_if(F.col("quality_tag") == GOOD).alias("succeeded"), F.count_if(F.col("truncation_warning")).alias("truncated"))
    out = counts.withColumn("succeeded_percent", share("succeeded")).withColumn("truncated_percent", share("truncated"))
    return out if seconds is None else out.withColumn("per_second", F.coalesce(F.try_divide(F.col("total"), F.lit(float(seconds))), F.lit(0.0)))
