"""Problem 2: source files that do not parse, and event texts that are not well-formed.

A naive Bayes model of tokens ranks the supported languages of a file, and the file is parsed in
all of them, in that order. A file that parses in its own language, the one of its extension, is
valid; one that parses in others only has a wrong extension, one that parses nowhere is corrupt.
"""

from __future__ import annotations

import ast
import json
import keyword
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.llm.grammar import Syntax

# The language of an extension.
EXTENSIONS = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "py": "python", "json": "json"}
# Tokens that speak for a language, for languages of which the corpus may have no file.
TELLING = {
    "cpp": ":: class namespace template nullptr auto std static_cast public private throw catch new delete",
    "c": "-> struct sizeof typedef unsigned goto NULL",
    "python": " ".join(keyword.kwlist) + " self print ** #",
    "json": '":" true false null ": [{ }] },',
}
RANKED_TOKEN = re.compile(r"\w+|::|->|\*\*|\":|[\[\](){}]+,?|[^\w\s]")
SENTINELS = ("VULNIR_EMPTY", "VULNIR_PARSE_FAILED")
CUT_EVENT = "[Line ?] ...: VULNIR_TRUNCATED"
EVENT_BREAK = re.compile(r" \| (?=\[Line )")
EVENT_HEAD = re.compile(r"\[Line \d+\] [A-Z][A-Z_]*(?:\[[A-Z][A-Z0-9_]*\])?: ")
NAMES = r"\{[^{},|]+(?:,[^{},|]+)*\}"
EVENT_TAIL = re.compile(rf"(?: D{NAMES})?(?: U{NAMES})?$")
OPEN_NAMES = re.compile(r" [DU]\{[^{}]*$")
BRACKETS = re.compile(r"[()\[\]]")


@lru_cache(2)
def syntax(cpp: bool) -> Syntax:
    return Syntax(cpp)


def python_valid(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return bool(ast.parse(text).body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False


def json_valid(text: str) -> bool:
    try:
        return isinstance(json.loads(text), (dict, list))
    except (ValueError, RecursionError):
        return False


GRAMMARS = {"c": lambda t: syntax(False).valid(t), "cpp": lambda t: syntax(True).valid(t), "python": python_valid, "json": json_valid}


class Ranking:
    """Ranks the languages by the posteriors of a text's tokens: {language: {token: count}}."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        self.names = sorted(GRAMMARS)
        told = {x: Counter(counts.get(x, {})) + Counter(dict.fromkeys(TELLING[x].split(), 20)) for x in self.names}
        tokens = sorted({t for c in told.values() for t in c})
        seen = np.array([[told[x][t] for x in self.names] for t in tokens], float) + 0.5
        self.rows = {t: k for k, t in enumerate(tokens)}
        self.table = np.log(seen / seen.sum(axis=0))

    def __call__(self, text: str) -> list[str]:
        score = self.table[[self.rows[t] for t in RANKED_TOKEN.findall(text) if t in self.rows]].sum(axis=0)
        return [self.names[k] for k in np.argsort(-score, kind="stable")]


def fit_ranking(df: DataFrame, key: str, text: str, path: str, sample_rows: int = 2_000, most_tokens: int = 4_000) -> Ranking:
    """A ranking from the tokens of about ``sample_rows`` files, chosen by a hash of the key, and their extensions.

    Wrong extensions are outvoted. The ``most_tokens`` most frequent tokens go through the driver.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), language_of(F.col(path)).alias("language"))
    share = min(1.0, sample_rows / max(1, df.count()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for t, x in zip(b["t"], b["language"]):
                total.update((x, token) for token in RANKED_TOKEN.findall(t))
        yield pd.DataFrame([(x, t, n) for (x, t), n in total.items()], columns=["language", "token", "n"]).astype({"language": object, "token": object, "n": "int64"})

    picked = rows.where("k is not null and t is not null and language is not null").where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(share * 1_000_000))
    total = picked.select("t", "language").mapInPandas(count, "language string, token string, n long").groupBy("language", "token").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in total.orderBy(F.desc("n"), "token", "language").limit(most_tokens).collect():
        counts.setdefault(r["language"], {})[r["token"]] = r["n"]
    return Ranking(counts)


def accepting(text: str, ranking: Ranking) -> list[str]:
    """The languages a text parses in, of all that are supported, by rank."""
    return [x for x in ranking(text) if GRAMMARS[x](text)]


def balanced(text: str) -> bool:
    stack: list[str] = []
    for c in BRACKETS.findall(text):
        if c in "([":
            stack.append(c)
        elif not stack or stack.pop() + c not in ("()", "[]"):
            return False
    return not stack


def events_valid(text: str) -> bool:
    """A sentinel, or events joined by `` | ``; a list of names that is not closed is no text."""
    if text in SENTINELS:
        return True
    events = EVENT_BREAK.split(text)
    for k, event in enumerate(events):
        if k and event == CUT_EVENT and k == len(events) - 1:
            continue
        head = EVENT_HEAD.match(event)
        if not head:
            return event == CUT_EVENT and len(events) == 1
        tail = EVENT_TAIL.search(event, head.end())
        said = event[head.end():tail.start()] if tail else event[head.end():]
        if not said.strip() or not balanced(said) or OPEN_NAMES.search(said):
            return False
    return True


def language_of(path: Column) -> Column:
    """The language of a path's extension, null if there is none that is supported."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def parsed_languages(ranking: Broadcast):
    """A function from non-blank texts to the languages they parse in; else null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if not t or t.isspace() else accepting(t, ranking.value) for t in texts], dtype=object)

    return parsed


@F.pandas_udf(T.BooleanType())
def events_well_formed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if not t or t.isspace() else events_valid(t)).astype(object)


def verdicts(df: DataFrame, key: str, text: str, path: str, order: str, events: str | None = None, source: str | None = None) -> DataFrame:
    """One row per record: ``(key, source, language, verdict, parsed_as, accepted_by, events_ok)``.

    ``verdict`` is valid, wrong_extension or corrupt, and null for null and blank texts; a path
    without a supported extension makes every text that parses somewhere wrong_extension.
    ``accepted_by`` lists all languages that the text parses in, by rank; ``parsed_as`` is its own if it
    is among them, else the first. ``events_ok`` is null for null and blank event texts. Rows with a
    null key are left out, re-deliveries are reduced to the last by ``order``. Texts are parsed where
    they are read; only verdicts are shuffled. Brackets may be nested to any depth.
    """
    null = F.lit(None).cast("string")
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.coalesce(F.col(order), F.lit("1000-01-01").cast("timestamp")).alias("o"),
        F.col(text).alias("t"), language_of(F.col(path)).alias("language"), (F.col(events) if events else null).alias("e"), (F.col(source) if source else null).alias("source"))
    ranking = df.sparkSession.sparkContext.broadcast(fit_ranking(df, key, text, path))
    judged = rows.select("k", "o", "source", "language", parsed_languages(ranking)("t").alias("accepted"), events_well_formed("e").alias("events_ok"))
    last = judged.groupBy("k").agg(F.max_by(F.struct("source", "language", "accepted", "events_ok"), "o").alias("r")).select("k", "r.*")
    own = F.array_contains("accepted", F.coalesce("language", F.lit("")))
    verdict = F.when(F.col("accepted").isNull(), None).when(F.size("accepted") == 0, "corrupt").when(own, "valid").otherwise("wrong_extension")
    parsed = F.when(own, F.col("language")).otherwise(F.try_element_at("accepted", F.lit(1)))
    return last.select(F.col("k").alias(key), "source", "language", verdict.alias("verdict"), parsed.alias("parsed_as"), F.array_join("accepted", ",").alias("accepted_by"), "events_ok")


def ill_formed(judged: DataFrame, key: str, text: str, events: str) -> DataFrame:
    """``(key, field_name)`` of every text and event text that is ill-formed."""
    bad = F.filter(F.array(F.when(F.col("verdict") != "valid", F.lit(text)), F.when(~F.col("events_ok"), F.lit(events))), lambda x: x.isNotNull())
    return judged.select(key, F.explode(bad).alias("field_name"))


def rates(judged: DataFrame) -> DataFrame:
    """Per source and language: files, those ill-formed by kind, and their rate; nulls are groups of their own."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return judged.where("verdict is not null").groupBy("source", "language").agg(
        F.count("*").alias("files"), n("wrong_extension").alias("wrong_extension"), n("corrupt").alias("corrupt"),
    ).withColumn("ill_formed_rate", (F.col("wrong_extension") + F.col("corrupt")) / F.col("files"))
