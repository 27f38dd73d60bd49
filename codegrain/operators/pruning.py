"""Pruning of texts to a token budget, guided by anchor lines where there are any."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.functions import pieces as P
from codegrain.functions.once import let

ANCHOR = r"\bline\b\s*[:=]?\s*(\d{1,6})\b"
CODE_GAP, TEXT_GAP, IR_GAP = "// ...", "\n// ...\n", "\n# ...\n"
# Words that mark a line of an event text worth keeping.
KEY_WORDS = ("call", "sink", "source", "taint", "line", "memcpy", "strcpy", "sprintf", "malloc", "free", "bounds")
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SLACK = 10


def anchors(ir: Column) -> Column:
    """The distinct line numbers, 1 to a million, that a text names, in order of appearance."""
    found = F.transform(F.regexp_extract_all(F.lower(ir), F.lit(ANCHOR), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.array_distinct(F.filter(found, lambda x: x.between(1, 1_000_000))), F.array().cast("array<int>"))


def lines(text: Column) -> Column:
    """Lines as Python's splitlines cuts them: no empty one after a last line end."""
    return let(F.split(text, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def interest(n_lines: Column, critical: Column, window: int, head: int, tail: int) -> Column:
    """0-based indices of the first and last lines and of those around an anchor that exists."""
    none = F.array().cast("array<int>")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)

    def chosen(x: Column) -> Column:
        n = x["n"]
        around = F.flatten(F.transform(F.filter(x["a"], lambda a: a <= n), lambda a: span(F.greatest(a - 1 - window, F.lit(0)), F.least(a - 1 + window, n - 1))))
        return F.array_sort(F.array_distinct(F.concat(span(F.lit(0), F.least(F.lit(head), n) - 1), span(F.greatest(n - tail, F.lit(0)), n - 1), around)))

    return let(F.struct(n_lines.alias("n"), critical.alias("a")), chosen)


def reconstruct(all_lines: Column, chosen: Column) -> Column:
    """The chosen lines, trimmed at the end, with a mark wherever lines are left out between two."""
    def render(x: Column) -> Column:
        line = lambda i: F.regexp_replace(F.element_at(x["l"], i + 1), r"\s+\z", "")
        gap = lambda i, k: (k > 0) & (F.element_at(x["c"], F.greatest(k, F.lit(1))) != i - 1)
        return F.array_join(F.transform(x["c"], lambda i, k: F.when(gap(i, k), F.concat(F.lit(CODE_GAP + "\n"), line(i))).otherwise(line(i))), "\n")

    return let(F.struct(all_lines.alias("l"), chosen.alias("c")), render)


def _cut(parts: Column, limit: Column, share: float, middle: Column | None, gap: str) -> Column:
    """Head, middle and tail of an array of pieces within a budget; the middle from another array if one is given."""
    budget = F.greatest(F.lit(0), limit - SLACK)
    ends = F.greatest(F.lit(1), F.floor(budget * share).cast("int"))
    mid = F.greatest(F.lit(1), budget - 2 * ends)

    def render(x: Column) -> Column:
        n = F.size(x["p"])
        if middle is None:
            between = F.slice(x["p"], F.greatest(F.lit(0), F.floor((n - mid) / 2)).cast("int") + 1, mid)
        else:
            between = F.slice(x["m"], F.lit(1), mid)
        return F.concat(P.text_of(F.slice(x["p"], F.lit(1), ends)), F.lit(gap), P.text_of(between), F.lit(gap), P.text_of(F.slice(x["p"], F.greatest(n - ends + 1, F.lit(1)), ends)))

    both = F.struct(parts.alias("p")) if middle is None else F.struct(parts.alias("p"), middle.alias("m"))
    return F.when(budget <= 0, "").otherwise(let(both, render))


def prune_middle(text: Column, limit: int) -> Column:
    """Head, middle and tail (20, 60 and 20 per cent) of the budget if the text is over it."""
    if limit <= 0:
        return F.lit("")
    # A text of at most as many characters as the limit has no more pieces.
    cut = let(P.pieces(text), lambda parts: F.when(F.size(parts) > limit, _cut(parts, F.lit(limit), 0.2, None, TEXT_GAP)))
    return F.when(text.isNull() | (text == ""), "").when(F.length(text) <= limit, text).otherwise(F.coalesce(cut, text))


def prune_ir(ir: Column, limit: int) -> Column:
    """Head and tail (30 per cent each) and the lines with key words between them."""
    if limit <= 0:
        return F.lit("")
    telling = F.filter(lines(ir), lambda s: F.exists(F.array(*map(F.lit, KEY_WORDS)), lambda k: F.contains(F.lower(s), k)))
    middle = P.pieces(F.array_join(telling, "\n"))
    cut = let(P.pieces(ir), lambda parts: F.when(F.size(parts) > limit, _cut(parts, F.lit(limit), 0.3, middle, IR_GAP)))
    return F.when(ir.isNull() | (ir == ""), "").when(F.length(ir) <= limit, ir).otherwise(F.coalesce(cut, ir))


PIECE = re.compile(P.PATTERN)


BLANKS = " \t\r\n"


def fit(all_lines: list[str], critical: list[int], limit: int, window: int, head: int, tail: int, density: float = 0.6) -> str | None:
    """The lines around the anchors under the widest window that fits, None if none does.

    Where they fill less than ``density`` of the budget, lines at even distances are added,
    one for eight tokens that are missing. Pieces are counted once for each line: a text has those
    of its lines without the blanks before them, and one for each run of blanks between and around.
    """
    n = len(all_lines)
    trimmed = [s.rstrip() for s in all_lines]
    counts = [len(PIECE.findall(s.strip(BLANKS))) for s in trimmed]
    gap = len(PIECE.findall(CODE_GAP))

    def shown(chosen: set[int]) -> list[int | None]:
        """The chosen lines in their order, None for a gap."""
        out: list[int | None] = []
        for i in sorted(chosen):
            if out and i > out[-1] + 1:
                out.append(None)
            out.append(i)
        return out

    def size(lines: list[int | None]) -> int:
        inner = [k for k, i in enumerate(lines) if i is None or counts[i]]
        if not inner:
            return int(len(lines) > 1 or any(trimmed[i] for i in lines))
        first = lines[inner[0]]
        blank_before = inner[0] > 0 or first is not None and trimmed[first][0] in BLANKS
        return sum(gap if lines[k] is None else counts[lines[k]] for k in inner) + len(inner) - 1 + blank_before + (inner[-1] < len(lines) - 1)

    least = int(limit * density)
    known = [a - 1 for a in critical if a <= n]
    for w in range(max(0, window), -1, -1):
        chosen = {*range(min(head, n)), *range(max(0, n - tail), n)}
        for a in known:
            chosen.update(range(max(0, a - w), min(n, a + w + 1)))
        lines = shown(chosen)
        pieces = size(lines)
        if pieces < least and (more := min(n, (least - pieces) // 8)) > 0:
            lines = shown(chosen.union(range(0, n, max(1, n // more))))
            pieces = size(lines)
        if pieces <= limit:
            return "\n".join(CODE_GAP if i is None else trimmed[i] for i in lines)
    return None


def prune(df: DataFrame, code: str, ir: str, limit: Column | int, into: str, window: int = 3, head: int = 5, tail: int = 3) -> DataFrame:
    """Adds ``into``: the code pruned to ``limit`` pieces, around the anchors of ``ir`` if it names any.

    Code within the limit stays as it is; null or empty code, or a limit of 0, gives the empty text.
    Only rows over the limit with anchors reach Python, in Arrow batches; the others stay in the JVM.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit

    @F.pandas_udf(T.StringType())
    def fitted(texts: pd.Series, critical: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fit(t.splitlines(), list(a), int(x), window, head, tail) for t, a, x in zip(texts, critical, limits)], dtype=object)

    names = ("_n", "_anchors", "_limit", "_guided")
    out = df.withColumn("_n", P.count_of(F.col(code))).withColumn("_anchors", anchors(F.col(ir))).withColumn("_limit", limit)
    guided = (F.col("_n") > F.col("_limit")) & (F.col("_limit") > 0) & (F.size("_anchors") > 0)
    out = out.withColumn("_guided", fitted(F.when(guided, F.col(code)), F.when(guided, F.col("_anchors")), F.col("_limit")))
    plain = F.when(F.col(code).isNull() | (F.col(code) == "") | (F.col("_limit") <= 0), "").when(F.col("_n") <= F.col("_limit"), F.col(code))
    rest = _cut(P.pieces(F.col(code)), F.col("_limit"), 0.2, None, TEXT_GAP)
    return out.withColumn(into, plain.when(F.length(F.trim("_guided")) > 0, F.col("_guided")).otherwise(rest)).drop(*names)


def marked_lines(df: DataFrame, key: str, text: str, ir: str, window: int) -> DataFrame:
    """``(key, line, near)`` per line: whether an anchor is within ``window`` lines, by a frame over the lines."""
    rows = df.select(key, F.posexplode(lines(F.col(text))).alias("at", "_"), anchors(F.col(ir)).alias("a")).withColumn("hit", F.array_contains("a", F.col("at") + 1))
    frame = W.partitionBy(key).orderBy("at").rowsBetween(-window, window)
    return rows.select(key, (F.col("at") + 1).alias("line"), F.max("hit").over(frame).alias("near"))
