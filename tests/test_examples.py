import pytest
from pyspark.sql import functions as F

from codegrain.operators import examples as S
from codegrain.operators import metrics as M


def test_stages():
    s = S.resolve("stage1", "out", window=0, epochs=9)
    assert (s.stage, s.window, s.epochs, s.folder) == ("task1_finetune", 6, 9, "out/stage2_task1")
    assert [x.stage for x in S.pipeline()] == ["aux_pretrain", "task1_finetune", "joint_finetune"]
    with pytest.raises(ValueError):
        S.resolve("other")
    with pytest.raises(ValueError):
        S.task("other", F.lit(0.5))


def test_prompt_keeps_braces(spark):
    text = spark.range(1).select(S.prompt("task_c", F.lit("int x[] = {input};"), F.lit("{vulnir}"))).first()[0]
    assert "int x[] = {input};\n\nVulnerability Reference:\n{vulnir}\n<|im_end|>" in text


def test_build_pack_and_pad(spark):
    rows = [(k, "x = %d;\n" % k * 300, "[Line 5] SET: x", k % 2) for k in range(60)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "k long, code string, ir string, target int")
    made = S.build(df, "k", "code", "ir", "target", "joint_finetune", context=900)
    counts = {r.task: r.n for r in made.groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 60 and set(counts) == {"task_a_cot", "task_b", "task_c"}
    packed = S.packed(made, "prompt", "completion", 500)
    for r in packed.collect():
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) <= 500
        assert all(x in (-100, y) for x, y in zip(r.labels, r.input_ids))
    padded = S.padded(packed.withColumn("batch", F.col("k") % 3), "batch")
    assert all(r.n == 1 for r in padded.groupBy("batch").agg(F.countDistinct(F.size("input_ids")).alias("n")).collect())


def test_length_statistics(spark):
    df = spark.createDataFrame([(k, "a " * k) for k in range(1, 101)] + [(0, "")], "k long, code string")
    r = S.length_statistics(S.length_sample(df, "k", "code", 512)).first()
    assert (r.n, r.p50, r.p90, r["max"]) == (100, 102, 182, 200)
    assert S.length_sample(df, "k", "code", 10).count() == 10
    assert S.tuned_window(S.length_statistics(S.length_sample(df, "k", "code")), 1000, 8).first().window == 14


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0), (None, 1)], "t int, p int")
    r = M.binary_metrics(df, "t", "p").first()
    assert (r.n, r.accuracy, r.precision, r.recall, r.f1) == (5, 0.6, 0.5, 0.5, 0.5)
    assert {(x.t, x.predicted_0, x.predicted_1) for x in M.confusion(df, "t", "p").collect()} == {(0, 2, 1), (1, 1, 1)}
    assert M.binary_metrics(df.where("p = 0 and t = 0"), "t", "p").first().f1 == 0.0
    sweep = spark.createDataFrame([(10, 0.5), (5, 0.7), (20, 0.7)], "step int, f1 double")
    assert M.best(sweep, "f1", "step").first().step == 5
    choice = spark.createDataFrame([(1.0, 2.0, 1.5), (1.0, 1.0, 1.0)], "a double, b double, c double").select(M.preferred([F.col("a"), F.col("b")], [F.col("c")])).collect()
    assert [r[0] for r in choice] == [1, 0]
