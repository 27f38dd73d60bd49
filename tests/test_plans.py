import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from codegrain.plans import evaluation as V
from codegrain.plans import training as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
SCHEMA = "idx long, func string, vulnir string, target string, ingested_at timestamp"


class Stub:
    """Calls code vulnerable that copies memory."""

    def __call__(self, messages, max_tokens=0, **options):
        return "Verdict: Vulnerable" if "memcpy" in messages[-1]["content"] else "Verdict: Safe, not a bit vulnerable" if max_tokens == 96 else "Safe"


def records(spark):
    rows = [(i, f"int f{i}(void) {{ {'memcpy(a, b, n);' if i % 2 else 'g();'} return {i}; }}", None, '"1"' if i % 4 == 1 else "0.0", None) for i in range(20)]
    return spark.createDataFrame([*rows, rows[0], (99, None, None, None, None)], SCHEMA)


def test_training_set(spark):
    df = T.with_events(records(spark).where("func is not null").dropDuplicates(["idx"]), "idx", "func", "vulnir")
    assert df.where("vulnir like '%CALL[MEMCPY]: memcpy(...)%'").count() == 10
    out = T.training_set(df, "idx", "func", "vulnir", "target", "ingested_at", "stage2_2", context=200).collect()
    assert len(out) == 20 and all(len(r.input_ids) == len(r.labels) <= 200 for r in out)
    again = T.training_set(df, "idx", "func", "vulnir", "target", "ingested_at", "stage2_2", context=200, epoch=1).collect()
    assert {r.idx: r.task for r in out} != {r.idx: r.task for r in again}


def test_evaluation(spark):
    df = records(spark).dropDuplicates(["idx"])
    for reasoning in (True, False):
        pred = V.predictions(df.where("func is not null"), "idx", "func", "vulnir", Stub, reasoning)
        r = V.scores(df, "idx", "target", pred).first()
        assert (r.n, r.recall, r.precision) == (20, 1.0, 0.5)
    assert V.code_budget("task_a", 10) == 0
    steps = pred.withColumn("step", F.lit(10)).unionByName(pred.withColumn("pred", F.lit(0)).withColumn("step", F.lit(5)))
    table, best = V.sweep(df, "idx", "target", steps)
    assert [x.step for x in table.collect()] == [5, 10] and best.first().step == 10


def test_evaluations_and_stages(spark):
    assert (V.EVALUATIONS["lines"].budget, V.EVALUATIONS["test"].budget, V.EVALUATIONS["auxiliary"].budget) == (5632, 7936, 5632)
    assert V.EVALUATIONS["verdict"].budget == V.code_budget("task_a", 8192) and V.EVALUATIONS["lines"].window == 3
    assert list(V.after_stage("stage2_2")) == ["verdict_reasoned", "auxiliary"] and V.after_stage("stage1")["verdict_reasoned"].window == 8 and V.after_stage("aux_pretrain", 100)["auxiliary"].budget == 0
    assert V.sweep_of("stage2_1", "r") == (V.EVALUATIONS["lines"], "r/stage2_1_expert")
    df = records(spark).dropDuplicates(["idx"]).where("func is not null")
    for how in V.EVALUATIONS.values():
        out = V.predicted(df, "idx", "func", "vulnir", Stub, how)
        assert out.count() == 20 and out.where("pred = 1").count() == (10 if how.reads_verdict_line or how.new_tokens != 96 else 20)
    assert V.report(V.scores(df, "idx", "target", out).withColumn("checkpoint", F.lit("c"))).columns == ["F1", "Accuracy", "Precision", "Recall", "Checkpoint"]
    for wrong in (lambda: V.after_stage("x"), lambda: V.sweep_of("x")):
        try:
            wrong()
        except ValueError:
            continue
        raise AssertionError


def test_splits_and_datasets(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"idx": 1, "func": "x"}\n{"idx": 2}\nnot json\n')
    found = T.splits(spark, str(tmp_path / "a.json"), str(tmp_path / "missing.json"))
    assert found["train"].count() == 1 and found["validation"] is None
    assert T.splits(spark, str(tmp_path / "a.json"), str(tmp_path / "a.json"))["validation"].count() == 1 and T.dataset("records") is T.training_set
    try:
        T.dataset("x")
    except NotImplementedError:
        return
    raise AssertionError
