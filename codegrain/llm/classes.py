"""Links between classes of records, written out as pairs of their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_pairs(links: DataFrame, left: DataFrame, right: DataFrame, rows_per_salt: int = 5_000) -> DataFrame:
    """``(left_key, right_key)`` for every link ``(l, r)`` and all members ``(rep, k)`` of its classes.

    A class of n members is cut into ceil(n / rows_per_salt) parts, and a link into the pairs of
    parts of its classes, so one task meets at most ``rows_per_salt`` members of either at a time.
    Members of classes without a link are dropped first. Joins are by merging: keys in columns shrink tenfold and more
    when they are written, so sizes as written let tables through to the driver that are large there.
    """
    blocks, parts = links, []
    for x, members in (("l", left), ("r", right)):
        members = members.hint("merge").join(links.select(F.col(x).alias("rep")).distinct(), "rep", "left_semi")
        salts = members.groupBy(F.col("rep").alias(x)).agg(F.ceil(F.count("*") / rows_per_salt).alias(f"{x}salts"))
        blocks = blocks.hint("merge").join(salts, x).withColumn(f"{x}part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{x}salts") - 1)))
        dealt = members.select(F.col("rep").alias(x), "k").hint("merge").join(salts, x)
        parts.append(dealt.select(x, F.pmod(F.xxhash64("k"), F.col(f"{x}salts")).alias(f"{x}part"), F.col("k").alias("left_key" if x == "l" else "right_key")))
    at = ["l", "r", "lpart", "rpart"]
    ours, theirs = (blocks.select(*at).hint("merge").join(p, [x, f"{x}part"]) for x, p in zip("lr", parts))
    return ours.hint("merge").join(theirs, at).select("left_key", "right_key")
