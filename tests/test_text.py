from pyspark.sql import functions as F

from codegrain.functions import pieces as P
from codegrain.functions import text as X
from codegrain.sources import jsonl
from codegrain.sources.tables import latest


def values(spark, rows, expression, column="x"):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(expression(F.col(column))).collect()]


def test_estimate_and_truncation(spark):
    assert values(spark, [None, "", "a" * 7, "a" * 10], X.estimated_tokens) == [0, 0, 2, 2]
    text = "a" * 20 + "b" * 40
    assert values(spark, [text, "short", None], lambda c: X.truncate_middle(c, 10)) == ["a" * 14 + X.TRUNCATION_MARK + "b" * 21, "short", None]


def test_cleaning(spark):
    assert values(spark, ["a\t b \r\nc\x00\rd", "", None], X.clean_lines) == ["a     b\nc\nd", "", None]
    assert values(spark, ["x\n\n  #if A\ny"], X.blank_directives) == ["x\n\n\ny"]
    assert values(spark, ["x\n\n  #if A\ny"], lambda c: X.blank_directives(c, keep_lines=False)) == ["x\n\ny"]
    assert values(spark, ["  a \n b ", "a" * 200], lambda c: X.shorten(c, 10)) == ["a b", "aaaaaaa..."]


def test_callees(spark):
    assert values(spark, [" __builtin_memcpy ", "f"], X.normalized_callee) == ["memcpy", "f"]
    assert values(spark, ["a->b.c", "ns::f", "g"], X.last_segment) == ["c", "f", "g"]


def test_verdicts(spark):
    rows = ["Verdict: Safe, not vulnerable", "it is VULNERABLE", "invulnerable", "safe", "", None]
    assert values(spark, rows, X.verdict) == [0, 1, 0, 0, 0, 0]
    assert values(spark, rows, X.verdict_by_substring) == [1, 1, 1, 0, 0, 0]


def test_logs_replies_and_numbers(spark):
    log = "F1 Score : 0.25 Accuracy: 0.5"
    assert values(spark, [log], lambda c: X.metric_of_log(c, "F1 Score")) == [0.25]
    assert values(spark, [log], lambda c: X.metric_of_log(c, "Recall")) == [None]
    assert values(spark, ['{"root_cause": "x"}', "{}", "no json"], lambda c: X.reply_field(c, "root_cause", F.lit("-"))) == ["x", "-", "-"]
    assert values(spark, ['"1"', " 0", "1.0", None, "x"], X.number_of_dirty) == [1, 0, 1, None, None]


def test_pieces_are_lossless(spark):
    text = "int x=1;\n\t/* naïve 😀 */ "
    assert values(spark, [text], lambda c: P.text_of(P.pieces(c))) == [text]
    assert values(spark, [None, "", "a b"], P.count_of) == [0, 0, 3]


def test_latest(spark):
    from datetime import datetime

    df = spark.createDataFrame([(1, "a", datetime(2020, 1, 1)), (1, "b", datetime(2021, 1, 1)), (2, "c", None), (None, "d", None)], "k int, v string, t timestamp")
    assert sorted(latest(df, "k", "t").select("k", "v").collect(), key=str) == sorted([(1, "b"), (2, "c"), (None, "d")], key=str)
    assert latest(df.limit(0), "k", "t").count() == 0


def test_lenient_lines(spark, tmp_path):
    lines = ['{"idx": 1, "func": "a", "target": "1"}', "", "  ", '{"idx": 2, "func": null}', '{"idx": 3}', '{"idx": 4, "func": "b"', '{"idx": 5, "func": " é", "target": 0}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = jsonl.read_lenient(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.func) for r in rows] == [(1, "a"), (2, None), (5, " é")]
    counts = jsonl.load_counts(spark.read.text(str(tmp_path)), "value").first()
    assert (counts.loaded, counts.skipped) == (3, 2)


def test_strict_read_and_overwrite(spark, tmp_path):
    import pytest

    path = str(tmp_path / "data")
    spark.createDataFrame([(1, "a"), (2, "b")], "idx long, func string").write.json(path)
    df = jsonl.read_strict(spark, path, jsonl.SAMPLES)
    jsonl.overwrite(df.where("idx = 1"), path)
    assert jsonl.read_strict(spark, path, jsonl.SAMPLES).count() == 1
    jsonl.append(spark.createDataFrame([(3, "c")], "idx long, func string"), path)
    assert jsonl.read_strict(spark, path, jsonl.SAMPLES).count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{broken")
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(tmp_path / "bad"), jsonl.SAMPLES).collect()
    folders = spark.createDataFrame([("checkpoint-20",), ("checkpoint-3",), ("checkpoint-x",)], "name string")
    assert [r.step for r in jsonl.checkpoint_steps(folders, "name").collect()] == [3, 20]


def test_overwriting_survives_a_crash_between_its_steps(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(3).write.json(path)
    (tmp_path / "data").rename(tmp_path / "data.old")  # the old one moved aside, the new one not yet in place
    jsonl.recover(spark, path)
    assert spark.read.json(path).count() == 3
    jsonl.overwrite(spark.read.schema("id long").json(path).where("id > 0"), path)
    assert spark.read.json(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["data"]
    spark.range(9).write.json(f"{path}.old")  # the new one in place, the old one not yet deleted
    jsonl.recover(spark, path)
    assert spark.read.json(path).count() == 2 and not (tmp_path / "data.old").exists()


def test_inferred_reading_and_paths(spark, tmp_path):
    from datetime import datetime

    (tmp_path / "a.json").write_text('{"idx": 1, "func": "x", "more": [1]}\n{"idx": 2}\nnot json\n')
    assert jsonl.read_inferred(spark, str(tmp_path / "a.json")).count() == 2
    df = jsonl.read_inferred(spark, str(tmp_path / "a.json"), "func")
    assert df.count() == 1 and set(df.columns) == {"idx", "func", "more"}
    assert jsonl.present(spark, str(tmp_path / "a.json")) and not jsonl.present(spark, str(tmp_path / "b.json"))
    assert jsonl.summary_path("out/stage1/checkpoint-5/", at=datetime(2030, 1, 2, 3, 4, 5)) == "out/stage1/summary_20300102_030405"
