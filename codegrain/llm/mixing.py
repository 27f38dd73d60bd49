"""Problem 7: sources are mixed to target weights.

Weighted fair queueing: the documents of a source stand in a shuffled queue, once per allowed
use, and each gets a virtual finish time, the tokens of its source up to and including it
divided by the target weight. In the order of these times every source contributes in
proportion to its weight at any point; the order is cut where the budget is spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codegrain.llm import tokens
from codegrain.session import materialize


def canonical_source(source: Column) -> Column:
    """Spelling variants of a source, capitals and blanks at the ends, are one source."""
    return F.lower(F.trim(F.regexp_replace(source, r"^\s+|\s+$", "")))


def running_total(df: DataFrame, group: list[str], order: list[str], bucket: str, totals: dict[str, str], buckets: int) -> DataFrame:
    """Running sums in ``order`` within ``group``, for groups of any size; totals: {new column: value}.

    ``bucket`` (0 to ``buckets``) is monotone in ``order`` and holds a bounded share of a group: rows
    are summed up within their bucket, and the sums of buckets on their own small table, which is
    bucketed again while it is large. No task sees a whole group.
    """
    sums = df.groupBy(*group, bucket).agg(*[F.sum(v).alias(c) for c, v in totals.items()])
    if buckets > 1 << 16:
        coarse = sums.withColumn("_coarse", F.floor(F.col(bucket) / 4096))
        upto = running_total(coarse, group, [bucket], "_coarse", {f"_upto_{c}": c for c in totals}, buckets // 4096 + 1)
        before = [(F.col(f"_upto_{c}") - F.col(c)).alias(f"_before_{c}") for c in totals]
    else:
        upto = sums
        ahead = W.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
        before = [F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_before_{c}") for c in totals]
    offsets = upto.select(*group, bucket, *before)
    within = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = df.select("*", *[F.sum(v).over(within).alias(f"_within_{c}") for c, v in totals.items()]).join(offsets, [*group, bucket])
    return summed.select(*df.columns, *[(F.col(f"_before_{c}") + F.col(f"_within_{c}")).alias(c) for c in totals])


def sizes(df: DataFrame, key: str, text: str, source: str, order: str, tokenizer: str) -> DataFrame:
    """``(k, source, n)``: documents with their tokens, re-deliveries reduced to the last by ``order``."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), canonical_source(F.col(source)).alias("source"), F.col(order).alias("o"), tokens.count(F.col(text), tokenizer).alias("n"))
    last = rows.groupBy("k").agg(F.max_by(F.struct("source", "n"), F.coalesce("o", F.lit("1000-01-01").cast("timestamp"))).alias("r")).select("k", "r.source", "r.n")
    return materialize(last.where("n > 0"), "p7-sizes")


def _targets(targets: DataFrame) -> DataFrame:
    return (targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("target_share > 0 and max_repeats > 0")
            .groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("uses")))


def reach(sources: list, total: float) -> float:
    """The virtual time by which documents of ``total`` tokens have surely finished; infinite if there are not so many.

    At time v a source has sent v times its share, or all it has, less at most one document.
    """
    wanted = total + sum(s["longest"] for s in sources)
    sent, at, rate = 0.0, 0.0, sum(s["share"] for s in sources)
    for end, share in sorted((s["have"] * s["uses"] / s["share"], s["share"]) for s in sources):
        if sent + rate * (end - at) >= wanted:
            return at + (wanted - sent) / rate
        sent, at, rate = sent + rate * (end - at), end, rate - share
    return math.inf


def mix(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, order: str, budget: int | None = None, seed: int = 0,
        tokenizer: str = tokens.TOKENIZER, rows_per_bucket: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(draw, sizes, targets)``; the draw is ``(position, k, use, source, n, finish)``.

    ``budget`` in tokens is the wanted total; by default the largest at which every source with
    documents meets its share without exceeding its ``max_repeats``. Under a larger one the sources that run out
    end early and the others go on in proportion. A document is used again only when every other
    one of its source was used as often. Documents without source, without a target, without
    text or with a null key are not drawn; no documents or no targets give an empty draw. Ties in
    the finish time go to the smaller source, then use, then key. Extra columns are ignored.

    One row per source with a target goes to the driver. Only the uses and finish times that the
    budget can reach are made; these are sorted by ranges that Spark samples to equal sizes.
    """
    documents, targets = sizes(df, key, text, source, order, tokenizer), _targets(targets)
    supply = documents.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n").alias("have"), F.max("n").alias("longest"))
    sources = supply.join(targets, "source").collect()
    total = float(budget) if budget is not None else min((s["have"] * s["uses"] / s["share"] for s in sources), default=0.0)
    last = reach(sources, total)
    needed = [(s["source"], s["share"], min(s["uses"], math.ceil((last * s["share"] + s["longest"]) / s["have"])) if last < math.inf else s["uses"]) for s in sources]
    limits = df.sparkSession.createDataFrame(needed, "source string, share double, uses int")
    buckets = max(1, -(-max((s["rows"] for s in sources), default=0) // rows_per_bucket))
    queue = documents.join(F.broadcast(limits), "source").withColumn("use", F.explode(F.sequence(F.lit(1), "uses")))
    queue = queue.withColumn("slot", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "use", "k"), 2))
    # Buckets of a queue: the use, then equal ranges of the shuffling hash.
    queue = queue.withColumn("bucket", F.col("use") * F.lit(buckets) + F.floor(F.col("slot") / F.lit(float(1 << 62)) * buckets))
    timed = running_total(queue, ["source"], ["use", "slot", "k"], "bucket", {"upto": "n"}, buckets * (1 + max((n[2] for n in needed), default=0)))
    timed = timed.select("k", "use", "source", "n", (F.col("upto") / F.col("share")).alias("finish"), F.lit(1).alias("one"))
    timed = materialize(timed.where(F.col("finish") <= last) if last < math.inf else timed, "p7-finish")
    by = ["finish", "source", "use", "k"]
    ranges = max(1, -(-timed.count() // rows_per_bucket))
    ranged = materialize(timed.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), "p7-ranges")
    placed = running_total(ranged, [], by, "range", {"total": "n", "position": "one"}, ranges)
    return placed.where(F.col("total") <= F.lit(total)).select("position", "k", "use", "source", "n", "finish"), documents, targets


def shares(draw: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: its target and actual share of the drawn tokens, documents, draws and most uses of one.

    Sources without target and targets without documents are listed too.
    """
    drawn = draw.groupBy("source").agg(F.count("*").alias("draws"), F.sum("n").alias("drawn_tokens"), F.max("use").alias("most_uses"))
    supply = documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))
    every = supply.join(targets, "source", "full").join(drawn, "source", "left")
    total = F.sum("drawn_tokens").over(W.partitionBy(F.lit(0)))  # one row per source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.select("source", zero("documents"), zero("tokens"), F.coalesce("share", F.lit(0.0)).alias("target_share"), F.coalesce("uses", F.lit(0)).alias("max_repeats"),
                        zero("draws"), zero("drawn_tokens"), zero("most_uses"), F.coalesce(F.col("drawn_tokens") / total, F.lit(0.0)).alias("actual_share"))
