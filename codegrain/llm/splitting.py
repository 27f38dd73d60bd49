"""Problem 4: oversized texts are cut into overlapping pieces at natural boundaries.

Lexical cohesion: the text is taken as units (lines; overlong ones at statement ends, then at
blanks). At each gap between units the word bags of the units before and after are compared;
a gap whose similarity lies deep below the peaks on both sides is a topic boundary. Each piece
ends at the deepest valley of its size window, and the next one begins a little before that.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the problem: characters per estimated token, times two to stay with integers.
CHARS_PER_2_TOKENS = 7

LINE = re.compile(r"[^\n]*\n|[^\n]+")
STATEMENT = re.compile(r"[^;{}]*[;{}]+\s*|[^;{}]+")
BLANK_RUN = re.compile(r"\S*\s+|\S+")
WORD = re.compile(r"\w+")


def estimated(chars: int) -> int:
    """floor(characters / 3.5)."""
    return 2 * chars // CHARS_PER_2_TOKENS


def most_chars(tokens: int) -> int:
    """The greatest length whose estimate is at most ``tokens``."""
    return (CHARS_PER_2_TOKENS * (tokens + 1) - 1) // 2


def units(text: str, longest: int) -> list[tuple[int, int]]:
    """``(end, rank)`` of consecutive units of at most ``longest`` characters.

    Rank 0: ends at a line end, 1: at a statement end, 2: at a blank, 3: within a word.
    """
    out: list[tuple[int, int]] = []
    levels = (LINE, STATEMENT, BLANK_RUN)

    def cut(start: int, end: int, level: int) -> None:
        if level == len(levels):
            out.extend((p, 3) for p in range(start + longest, end, longest))
            return
        merged = start
        for m in levels[level].finditer(text, start, end):
            a, b = m.span()
            if b - a > longest:
                if level and a > merged:
                    out.append((a, level))
                cut(a, b, level + 1)
                if b < end:
                    out.append((b, level))
                merged = b
            elif not level:
                if b < end:
                    out.append((b, 0))
            elif b - merged > longest:  # below lines, short ones are put together
                out.append((a, level))
                merged = a
        return

    cut(0, len(text), 0)
    return out + [(len(text), 0)]


def depths(text: str, ends: list[int], block: int) -> list[float]:
    """For each gap after a unit but the last, how deep its similarity lies below the peaks around it."""
    starts = [0, *ends[:-1]]
    bags = [Counter(WORD.findall(text, a, b)) for a, b in zip(starts, ends)]
    left: Counter = Counter()
    right: Counter = Counter()
    dot = left2 = right2 = 0
    for b in bags[:block]:
        for w, n in b.items():
            right2 += n * (2 * right[w] + n)
            right[w] += n
    scores = []

    def move(side: Counter, other: Counter, bag: Counter, sign: int) -> tuple[int, int]:
        d = s = 0
        for w, n in bag.items():
            n *= sign
            old = side[w]
            d += n * other.get(w, 0)
            s += n * (2 * old + n)
            side[w] = old + n
        return d, s

    for i in range(len(bags) - 1):
        d, s = move(right, left, bags[i], -1)
        dot, right2 = dot + d, right2 + s
        if i + block < len(bags):
            d, s = move(right, left, bags[i + block], 1)
            dot, right2 = dot + d, right2 + s
        d, s = move(left, right, bags[i], 1)
        dot, left2 = dot + d, left2 + s
        if i >= block:
            d, s = move(left, right, bags[i - block], -1)
            dot, left2 = dot + d, left2 + s
        scores.append(dot / (left2 * right2) ** 0.5 if left2 and right2 else 0.0)
    # The peak on a side is reached by climbing as long as the similarity does not fall.
    up, down = scores[:], scores[:]
    for i in range(1, len(scores)):
        if scores[i - 1] >= scores[i]:
            up[i] = up[i - 1]
    for i in range(len(scores) - 2, -1, -1):
        if scores[i + 1] >= scores[i]:
            down[i] = down[i + 1]
    return [u + v - 2 * s for u, v, s in zip(up, down, scores)]


def split(text: str, limit: int = 1000, overlap: tuple[int, int] = (40, 80), block: int = 8) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a text: one, the whole, if it is within the limit.

    Every piece is within the limit and begins with the last ``overlap`` (at least, at most)
    estimated tokens of the one before. It ends at the best rank of boundary that its window, the
    last half of the room it has, offers; among those at the deepest valley, the later one on a tie.
    """
    size = most_chars(limit)
    if len(text) <= size:
        return [(0, len(text))]
    low, high = (CHARS_PER_2_TOKENS * overlap[0] + 1) // 2, most_chars(overlap[1])
    found = units(text, size // 4)
    ends = [e for e, _ in found]
    valley = depths(text, ends, block)
    pieces, start, first = [], 0, 0
    while len(text) - start > size:
        while ends[first] <= start + size // 2:
            first += 1
        last = first
        while ends[last] <= start + size:
            last += 1
        best = min(range(first, last), key=lambda i: (found[i][1], -valley[i], -i))
        end = ends[best]
        pieces.append((start, end))
        # The overlap begins at a line if one begins in its range, else at a word.
        a, b = end - high, end - low
        at = text.rfind("\n", a - 1, b)
        if at < 0:
            at = max((m.end() - 1 for m in re.finditer(r"\s(?=\S)", text[a - 1:b + 1])), default=high - (low + high) // 2) + a - 1
            at = min(at, b - 1)
        start = at + 1
    return [*pieces, (start, len(text))]


PIECES = T.ArrayType(T.StructType().add("piece", "integer").add("start", "integer").add("end", "integer").add("text", "string"))


def pieces(df: DataFrame, key: str, text: str, order: str, limit: int = 1000, overlap: tuple[int, int] = (40, 80)) -> DataFrame:
    """``(key, piece, start, end, text)`` of every text over ``limit`` estimated tokens.

    ``start`` and ``end`` count characters from 0; pieces count from 1. Texts within the limit, null
    and empty ones give no rows, nor do rows with a null key; re-deliveries are reduced to the last
    by ``order``. Other columns are ignored. Texts within the limit are never shuffled.
    """
    @F.pandas_udf(PIECES)
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [(k, a, b, t[a:b]) for k, (a, b) in enumerate(split(t, limit, overlap), 1)])

    over = F.when(F.length(text) > most_chars(limit), F.col(text))
    last = (df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.col(order), F.lit("1000-01-01").cast("timestamp")).alias("o"), over.alias("t"))
            .groupBy("k").agg(F.max_by(F.struct("t"), "o").alias("r")).select("k", "r.t").where("t is not null"))
    return last.select("k", F.explode(cut("t")).alias("p")).select(F.col("k").alias(key), "p.*")
