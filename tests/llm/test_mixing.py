import os
import random
from datetime import datetime

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codegrain.llm import mixing as p7
from codegrain.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer")
DAY = datetime(2030, 1, 1)
DOCS = "doc_id long, text string, source string, crawled_at timestamp, n int, use int"
TARGETS = "source string, target_share double, max_repeats int"


def tables(spark):
    rng = random.Random(6)
    rows = [(i, "some words " * rng.randrange(1, 60), rng.choice(["big", "BIG ", "big", "big", "small", " mid", "none"]), DAY, 0, 0) for i in range(900)]
    rows += [rows[0], (2000, None, "big", DAY, 0, 0), (2001, "", "big", DAY, 0, 0), (2002, "x", None, DAY, 0, 0), (None, "x", "big", DAY, 0, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([("big", 0.5, 1), ("Small", 0.3, 4), ("mid", 0.2, 2), ("absent", 0.0, 1)], TARGETS)


def test_shares_and_repeats(spark):
    documents, targets = tables(spark)
    draw, sizes, goal = p7.mix(documents, targets, "doc_id", "text", "source", "crawled_at", rows_per_bucket=100)
    rows = draw.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    assert len({(r.k, r.use) for r in rows}) == len(rows)
    shares = {r.source: r for r in p7.shares(draw, sizes, goal).collect()}
    for s, share, uses in (("big", 0.5, 1), ("small", 0.3, 4), ("mid", 0.2, 2)):
        assert abs(shares[s].actual_share - share) < 0.01 and shares[s].most_uses <= uses
    assert shares["none"].draws == 0 and shares[None].draws == 0 if None in shares else True
    # A document is used again only when all of its source were used as often.
    for s in ("small", "mid"):
        used = {}
        n = sum(1 for r in sizes.collect() if r.source == s)
        for r in rows:
            if r.source == s:
                used[r.use] = used.get(r.use, 0) + 1
                assert r.use == 1 or used[r.use - 1] == n


def test_budget_and_empty_tables(spark):
    documents, targets = tables(spark)
    draw = p7.mix(documents, targets, "doc_id", "text", "source", "crawled_at", budget=3000)[0]
    assert 2700 <= draw.agg(F.sum("n")).first()[0] <= 3000
    assert p7.mix(documents.limit(0), targets, "doc_id", "text", "source", "crawled_at")[0].count() == 0
    assert p7.mix(documents, targets.limit(0), "doc_id", "text", "source", "crawled_at")[0].count() == 0


@pytest.mark.parametrize("buckets", [7, 1 << 17])
def test_running_total(spark, buckets):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("v")).withColumn("b", F.floor(F.col("id") / 500 * buckets))
    plain = df.withColumn("expected", F.sum("v").over(W.partitionBy("g").orderBy("id").rowsBetween(W.unboundedPreceding, 0)))
    out = p7.running_total(plain, ["g"], ["id"], "b", {"total": "v"}, buckets)
    assert out.where("total <> expected").count() == 0 and out.count() == 500


def test_the_cut_before_sorting_loses_nothing():
    one = {"source": "a", "share": 0.5, "have": 100, "uses": 2, "longest": 10}
    two = {"source": "b", "share": 0.5, "have": 1000, "uses": 1, "longest": 50}
    assert p7.reach([one, two], 100) == 160 and p7.reach([one, two], 500) == 720 and p7.reach([one, two], 1200) == float("inf") and p7.reach([], 5) == float("inf")


def test_same_draw_whatever_the_buckets_and_extra_supply(spark):
    documents, targets = tables(spark)
    draws = [[tuple(r) for r in p7.mix(documents, targets, "doc_id", "text", "source", "crawled_at", budget=b, rows_per_bucket=n)[0].orderBy("position").collect()] for b, n in ((4000, 50), (4000, 10_000), (20_000, 64))]
    assert draws[0] == draws[1] and draws[2][:len(draws[0])] == draws[0]
    everything = p7.mix(documents, targets, "doc_id", "text", "source", "crawled_at", budget=10**9)[0]
    supply = {"big": 1, "small": 4, "mid": 2}
    _, sizes, _ = p7.mix(documents, targets, "doc_id", "text", "source", "crawled_at", budget=10)
    assert everything.count() == sum(supply.get(r.source, 0) for r in sizes.collect())
