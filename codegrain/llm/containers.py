"""Problem 6: items are put whole into containers of fixed capacity.

Bin completion: the largest item left opens a container, and the undominated fillings of the
rest of it are tried in turn, those with least waste first. A branch is given up when the waste
of its containers exceeds what any better solution could have; the incumbent at the start is
the best-fit solution. Items are dealt to packing tasks of bounded size by hash; the
containers a task could not fill are opened again and packed with those of other tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.llm import tokens
from codegrain.session import materialize


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; containers of sizes."""
    room: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(room, (s, -1))
        if i == len(room):
            out.append([s])
            insort(room, (capacity - s, len(out) - 1))
        else:
            left, k = room.pop(i)
            out[k].append(s)
            insort(room, (left - s, k))
    return out


def least(sizes: list[int], capacity: int) -> int:
    """A lower bound of the number of containers: for every threshold, what large items leave of room for the others."""
    big = sorted(sizes)
    sums = [0, *accumulate(big)]
    half = bisect_right(big, capacity // 2)
    best = -(-sums[-1] // capacity)
    for k in {0, *(x for x in big if x <= capacity // 2)}:
        low, high = bisect_left(big, k), bisect_right(big, capacity - k)
        room = (high - half) * capacity - (sums[high] - sums[half]) if high > half else 0
        best = max(best, len(big) - half + max(0, -(-(sums[half] - sums[low] - room) // capacity)))
    return best


class Left:
    """The multiset of sizes that are not placed yet, with the set of its sizes as bits."""

    def __init__(self, sizes: list[int]) -> None:
        self.count = Counter(sizes)
        self.distinct = sorted(self.count)
        self.bits = sum(1 << s for s in self.distinct)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]
            del self.distinct[bisect_left(self.distinct, s)]
            self.bits ^= 1 << s

    def put(self, s: int) -> None:
        if s not in self.count:
            insort(self.distinct, s)
            self.bits |= 1 << s
        self.count[s] += 1


def dominated(filling: list[int], waste: int, left: Left) -> bool:
    """Whether a larger item that is left could stand in for some items of the filling, or one as large as these for two or more.

    Any domination contains such a step, so this finds them all. Sums of items are bits of an integer.
    """
    one = more = 0  # the sums of one, and of two or more, of the items
    for s in filling:
        more |= more << s | one << s
        one |= 1 << s
    reach = 0  # up to ``waste`` above a sum
    if waste:
        reach, covered = (one | more) << 1, 1
        while covered < waste:
            by = min(covered, waste - covered)
            reach |= reach << by
            covered += by
    spare = left.bits
    for s, n in Counter(filling).items():
        if left.count[s] == n:
            spare &= ~(1 << s)
    return bool((reach | more) & spare)


def fillings(left: Left, room: int, waste: int, steps: list[int]) -> Iterator[list[int]]:
    """All undominated fillings of ``room`` that waste at most ``waste``, least waste first, then larger items first.

    Which sums the sizes can make is known beforehand, so hardly a step is in vain. ``steps[0]`` is
    the budget of search steps that remains; it is counted down, and the enumeration ends with it.
    """
    d = left.distinct[:bisect_right(left.distinct, room)]
    count = [left.count[s] for s in d]
    mask = (2 << room) - 1
    sums = [1]  # sums[i]: what the first i sizes can make, as bits
    for s, n in zip(d, count):
        r, k = sums[-1], 1
        while n > 0:
            r |= r << s * min(k, n) & mask
            n, k = n - k, 2 * k
        sums.append(r)
    def exactly(target: int) -> Iterator[list[int]]:
        if not target:
            yield []
            return
        chosen: list[int] = []  # one place a size: a filling may have more items than calls can be nested
        j = bisect_right(d, target) - 1
        while True:
            while j >= 0 and sums[j + 1] >> target & 1:
                steps[0] -= 1
                if steps[0] <= 0:
                    return
                if count[j] and sums[j + 1] >> (target - d[j]) & 1:
                    break
                j -= 1
            else:
                j = -1
            if j >= 0:
                count[j] -= 1
                chosen.append(j)
                target -= d[j]
                if target:
                    j = min(j, bisect_right(d, target) - 1)
                    continue
                yield [d[i] for i in chosen]
            if not chosen:
                return
            j = chosen.pop()
            count[j] += 1
            target += d[j]
            j -= 1

    for w in range(min(waste, room) + 1):
        if sums[-1] >> (room - w) & 1:
            for filling in exactly(room - w):
                if not dominated(filling, w, left):
                    yield filling


def pack(sizes: list[int], capacity: int, steps: int = 200_000) -> tuple[list[list[int]], bool]:
    """Containers of sizes, as few as found within ``steps`` search steps, and whether bin completion made them.

    It does if it needs no more than best fit. Fewer than the lower bound are not looked for.
    """
    if not sizes:
        return [], False
    best, completed = best_fit(sizes, capacity), False
    fewest, total = least(sizes, capacity), sum(sizes)
    goal = len(best)  # a solution of so many containers is taken
    budget = [steps]
    left = Left(sizes)
    waste = 0
    levels: list[list] = []  # [largest item, its fillings, the filling that is tried]
    while budget[0] > 0 and goal >= fewest:
        if not levels or levels[-1][2] is not None and waste <= goal * capacity - total and left.distinct:
            largest = left.distinct[-1]
            left.take(largest)
            levels.append([largest, fillings(left, capacity - largest, goal * capacity - total - waste, budget), None])
        top = levels[-1]
        if top[2] is not None:
            for s in top[2]:
                left.put(s)
            waste -= capacity - top[0] - sum(top[2])
        budget[0] -= 1
        top[2] = next(top[1], None)
        if top[2] is None:
            left.put(top[0])
            levels.pop()
            if not levels:
                break
            continue
        for s in top[2]:
            left.take(s)
        waste += capacity - top[0] - sum(top[2])
        if not left.distinct:
            best, completed = [[largest, *filling] for largest, _, filling in levels], True
            goal = len(best) - 1
    return best, completed


PLACED = T.StructType().add("grp", "long").add("container", "long").add("position", "integer").add("k", "long").add("piece", "integer").add("start", "integer").add("end", "integer").add("n", "long").add("fill", "long").add("completed", "boolean")


def _packer(capacity: int, steps: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n", "k", "piece"], ascending=[False, True, True])
        by_size: dict[int, list] = defaultdict(list)
        for row in items.itertuples(index=False):
            by_size[row.n].append(row)
        for rows in by_size.values():
            rows.reverse()
        out = []
        packed, completed = pack(items["n"].tolist(), capacity, steps)
        for c, sizes in enumerate(packed):
            fill = sum(sizes)
            for p, s in enumerate(sizes, 1):
                row = by_size[s].pop()
                out.append((row.grp, c, p, row.k, row.piece, row.start, row.end, s, fill, completed))
        return pd.DataFrame(out, columns=PLACED.names)

    return run


PARTS = T.ArrayType(T.StructType().add("piece", "integer").add("start", "integer").add("end", "integer").add("n", "long"))


def items(df: DataFrame, key: str, text: str, order: str, capacity: int, tokenizer: str) -> DataFrame:
    """``(k, piece, start, end, n)``: one row per text, or per part of a text over the capacity."""

    @F.pandas_udf(PARTS)
    def sized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            sizes = [tokens.size(s, tokenizer) for s in b]
            yield pd.Series([[(j, x, y, m) for j, (x, y, m) in enumerate(tokens.cuts(s, capacity, tokenizer), 1)] if n > capacity else [(1, 0, len(s), n)] for s, n in zip(b, sizes)], dtype=object)

    rows = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(order), F.lit("1000-01-01").cast("timestamp")).alias("o"), sized(F.col(text)).alias("parts"))
    last = rows.groupBy("k").agg(F.max_by("parts", "o").alias("parts"))
    return last.select("k", F.explode("parts").alias("p")).select("k", "p.*")


def fill_containers(df: DataFrame, key: str, text: str, order: str, capacity: int = 2048, tokenizer: str = tokens.TOKENIZER, items_per_task: int = 2000, steps: int = 200_000) -> DataFrame:
    """``(container, position, key, piece, start, end, n, made_by)``: where each text, or part of one, goes.

    Only a text over the capacity is split; ``start`` and ``end`` are characters, ``n`` tokens.
    ``made_by`` tells whether bin completion or, where it found no solution as good, best fit filled the container.
    Containers are numbered with gaps, positions from 1. Null and empty texts take
    no room and get no row, nor do rows with a null key; re-deliveries are reduced to the last by
    ``order``; other columns are ignored. Equal inputs give equal containers.

    ``items_per_task`` bounds a packing task, ``steps`` its search: what is found by then is kept. Containers that are not full to
    99.9 % are packed again with those of other tasks, until one task holds all that is left, or
    these are as few as their tokens allow, or another round has saved none.
    """
    todo = materialize(items(df, key, text, order, capacity, tokenizer), "p6-items")
    count, open_before, done, level = todo.count(), None, [], 0
    full = F.col("fill") >= capacity - capacity // 1024
    while True:
        tasks = max(1, -(-count // items_per_task))
        grouped = todo.withColumn("grp", F.pmod(F.xxhash64(F.lit(level), "k", "piece"), F.lit(tasks)))
        placed = materialize(grouped.groupBy("grp").applyInPandas(_packer(capacity, steps), PLACED).withColumn("level", F.lit(level)), f"p6-level{level}")
        if tasks == 1:
            done.append(placed)
            break
        bins = F.count_if(F.col("position") == 1)
        size = placed.agg(bins.alias("bins"), F.count_if((F.col("position") == 1) & ~full).alias("open"), F.count_if(~full).alias("left"), F.sum(F.when(~full, F.col("n"))).alias("tokens")).first()
        if size["open"] <= -(-(size["tokens"] or 0) // capacity) or open_before is not None and size["bins"] >= open_before:
            done.append(placed)
            break
        done.append(placed.where(full))
        todo = placed.where(~full).select("k", "piece", "start", "end", "n")
        count, open_before, level = size["left"], size["open"], level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # Tasks and containers of a task are fewer than 2**28 each.
    number = F.shiftleft(F.col("level").cast("long"), 56) + F.shiftleft(F.col("grp"), 28) + F.col("container")
    return out.select(number.alias("container"), "position", F.col("k").alias(key), "piece", "start", "end", "n", F.when(F.col("completed"), "completion").otherwise("best_fit").alias("made_by"))


def fill_report(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, how many bin completion made, items, tokens, the least number of containers possible and the unused share."""
    bins = placed.groupBy("container").agg(F.sum("n").alias("fill"), F.count("*").alias("items"), F.first("made_by").alias("made_by"))
    total = bins.agg(F.count("*").alias("containers"), F.count_if(F.col("made_by") == "completion").alias("by_completion"), F.sum("items").alias("items"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
    return total.select("containers", "by_completion", "items", "tokens", F.ceil(F.col("tokens") / capacity).alias("lower_bound"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"), "fullest")
