"""Parquet tables, the reduction of re-deliveries to one record per key, and semi-joins that spare a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A filter of keys is at most this many bits (64 MB), whatever the number of keys.
MOST_FILTER_BITS = 1 << 29
BITS_PER_BLOCK = 1 << 15  # what one bitmap of Spark's bitmap functions holds


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str, spread_by: str | None = None) -> DataFrame:
    """One table of a test data folder; columns, if given, are selected (and pruned in the scan)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df, spread_by) if spread_by else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """For costly work on rows: the same rows over all cores, where the table gives fewer partitions than that.

    A small file is often one partition, and is shuffled once, by ``key``, so grouping by it needs no
    other. A table of as many files as twice the cores, or of as many partitions that hold rows, is left
    as it is, without a shuffle. Partitions are counted on a scan that reads no column.
    """
    enough = 2 * df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= enough:
        return df
    partitions = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.lit(1)).count()
    return df if partitions >= enough else df.repartition(enough * 3 // 2, key)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key: the one with the greatest ``order``; nulls in ``order`` come last.

    Copies of a hot key are combined before the shuffle, by sorting, as whole rows can't be hashed in
    place. Rows with a null key form one record. Ties in ``order`` keep any one of the tied rows.
    """
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.coalesce(F.col(order).cast("timestamp"), F.lit("1000-01-01").cast("timestamp"))).alias("r")
    )
    return picked.select(*[F.col(c) if c == key else F.col("r")[c].alias(c) for c in df.columns])


def _position(key: str, bits: int):
    return F.pmod(F.xxhash64(key), F.lit(bits))


def probably_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys.key``, and a few others: for use before an exact join.

    A bitmap of hashed keys goes to every task, so rows are dropped where they are read and never
    shuffled. It has 16 to 32 bits a key, so that about one in twenty other rows stays, up to 64 MB;
    beyond some 30 million keys more of the others stay. No row of a key is ever lost.
    """
    n = keys.count()
    bits = BITS_PER_BLOCK
    while bits < min(16 * n, MOST_FILTER_BITS):
        bits *= 2
    at = keys.select(_position(key, bits).alias("at"))
    blocks = at.groupBy(F.floor(F.col("at") / BITS_PER_BLOCK).alias("_block")).agg(F.bitmap_construct_agg((F.col("at") % BITS_PER_BLOCK).cast("long")).alias("_bits"))
    offset = (_position(key, bits) % BITS_PER_BLOCK).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(offset / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_block", F.floor(_position(key, bits) / BITS_PER_BLOCK)).join(F.broadcast(blocks), "_block")
    return found.where(F.getbit(byte, offset % 8) == 1).select(*df.columns)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, rows_per_task: int = 50_000) -> DataFrame:
    """``rows`` joined with ``groups``, one row per key with its number of rows in ``size``, however hot a key is.

    Groups of over a thousandth of all rows, at most a thousand of them, are joined by broadcast,
    so no task gets the whole of a hot one; the others by shuffle, even where Spark would broadcast them
    by their size as written, which is many times as large in the driver. ``groups`` should be a written table.
    """
    n = rows.count()
    if n <= rows_per_task:
        return rows.join(groups, key)
    hot = F.col(size) > max(rows_per_task, n // 1000)
    many = rows.join(F.broadcast(groups.where(hot)), key)
    few = rows.join(F.broadcast(groups.where(hot).select(key)), key, "left_anti").hint("merge").join(groups.where(~hot), key)
    return many.unionByName(few)
