import json
import sys

from pyspark import cloudpickle

from codegrain.operators import enrichment as E
from codegrain.streaming import resume

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
SCHEMA = "pair_id long, cve string, cve_desc string, cwe array<string>, func_before string, func_after string"


class Stub:
    """Answers the last request with JSON; fails for code that asks for it."""

    def __call__(self, messages, json=False, **options):
        if "overflow" in messages[1]["content"]:
            raise RuntimeError("maximum context length is 10")
        if "broken" in messages[1]["content"]:
            raise RuntimeError("no connection")
        return '{"root_cause": "because"}' if json else f"reply {len(messages)}"


def test_conversation():
    waits = []
    turns = ["code", "cause", "why", "sum"]
    assert E.converse(Stub(), "s", turns) == {"root_cause": "because", "safety_justification": "reply 6", "quality_tag": "HIGH_MULTITURN"}
    assert E.converse(Stub(), "s", ["broken", *turns[1:]], wait=waits.append)["root_cause"] == E.FAILED and waits == [1.0, 2.0]
    assert E.converse(Stub(), "s", ["overflow", *turns[1:]], wait=waits.append)["root_cause"] == E.OVERFLOW and len(waits) == 2


def test_enriched(spark):
    rows = [(1, "CVE-1", "", [], "a", "b"), (2, None, None, None, "overflow", None)]
    out = {r.pair_id: r for r in E.enriched(spark.createDataFrame(rows, SCHEMA), "pair_id", Stub, "system").collect()}
    assert out[1].quality_tag == E.GOOD and out[2].root_cause == E.OVERFLOW
    assert E.enriched(spark.createDataFrame([], SCHEMA), "pair_id", Stub, "system").count() == 0


def test_resume(spark):
    pairs = spark.createDataFrame([(1, "c", "", [], "x", "y"), (1, "c", "", [], "x", "y"), (2, None, "", [], None, "y"), (3, "c", "", [], "z", "y")], SCHEMA)
    done = pairs.where("pair_id = 3")
    assert sorted(r.pair_id for r in E.remaining(pairs, done).collect()) == [1, 1, 2]
    assert [r.pair_id for r in E.skipped(pairs, done).collect()] == [3]
    assert E.remaining(pairs, pairs).count() == 0


def test_pair_budget(spark):
    pairs = spark.createDataFrame([(1, "c", "", [], "x" * 30_000, "y" * 20_000), (2, "c", "", [], "x" * 40_000, "y")], SCHEMA)
    out = {r.pair_id: r for r in E.within_budget(pairs).collect()}
    assert out[1].truncated and len(out[1].func_before) < 21_100 and len(out[1].func_after) == 20_000
    assert not out[2].truncated and len(out[2].func_before) == 40_000


def test_streaming_resume(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run(rows):
        if rows:
            (source / f"{len(list(source.iterdir()))}.json").write_text("\n".join(map(json.dumps, rows)))
        q = resume.resumed(spark, str(source), SCHEMA, str(sink), str(tmp_path / "state"), lambda df: df)
        q.awaitTermination()
        return spark.read.schema(SCHEMA).json(str(sink)).count()

    one = {"pair_id": 1, "cve": "c", "func_before": "a"}
    assert run([one, {"pair_id": 2, "cve": "c", "func_before": "b"}]) == 2
    assert run([{**one, "pair_id": 9}, {"pair_id": 3, "cve": "d", "func_before": "b"}]) == 3
    assert run([]) == 3


def test_resumed_stream_into_another_file_system(spark, tmp_path):
    source, held = tmp_path / "in", tmp_path / "held"
    source.mkdir()
    held.mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.resume.link./held", held.as_uri())
    sink = "viewfs://resume/held/pairs"
    for n, row in enumerate([{"pair_id": 1, "cve": "c", "func_before": "a"}, {"pair_id": 9, "cve": "c", "func_before": "a"}, {"pair_id": 2, "cve": "c", "func_before": "b"}]):
        (source / f"{n}.json").write_text(json.dumps(row))
        resume.resumed(spark, str(source), "pair_id long, cve string, func_before string", sink, str(tmp_path / "state"), lambda df: df).awaitTermination()
    assert sorted(r.pair_id for r in spark.read.json(sink).collect()) == [1, 2]


class Counting(Stub):
    """Writes a line for each request, with its options."""

    def __init__(self, path):
        self.path = path

    def __call__(self, messages, json=False, **options):
        with open(self.path, "a") as f:
            f.write(f"{json} {options.get('temperature')} {options.get('top_k')} {'schema' in options}\n")
        return super().__call__(messages, json=json, **options)


def test_repeated_keys_are_asked_once_each(spark, tmp_path):
    path = str(tmp_path / "asked")
    rows = [(1, "c", "", [], "a", "b"), (1, "c", "", [], "a", "b"), (None, "c", "", [], "a", "b"), (2, "c", "", [], "x" * 40_000, "y" * 20_000)]
    out = E.enriched(spark.createDataFrame(rows, SCHEMA), "pair_id", lambda: Counting(path), "system")
    assert out.count() == 4 and out.where("quality_tag = 'HIGH_MULTITURN'").count() == 4
    assert {(r.pair_id, r.truncation_warning, len(r.func_before)) for r in out.collect()} == {(1, None, 1), (None, None, 1), (2, True, 40_000)}
    asked = open(path).read().split("\n")[:-1]
    assert len(asked) == 16 and asked.count("True 0.2 50 True") == 4 and asked.count("False 0.2 50 False") == 12


def test_replies(spark):
    texts = ['{"root_cause": "a", "safety_justification": "b"}', '{"root_cause": "a"}', '{"root_cause": 1, "safety_justification": "b"}', '{"root_cause": "a", ', "[1]", "text", "", None, '{"root_cause": null, "safety_justification": "b"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    from pyspark.sql import functions as F

    out = df.select("k", E.checked_reply(F.col("t")).alias("ok"), E.synthesis(F.col("t"), F.lit("two"), F.lit("three")).alias("s")).orderBy("k").collect()
    assert [r.ok for r in out] == [True] + [False] * 8
    assert [tuple(r.s) for r in out] == [("a", "b", E.GOOD), ("a", "three", E.GOOD), ("1", "b", E.GOOD)] + [(E.FAILED, E.FAILED, E.BAD)] * 5 + [("two", "b", E.GOOD)]


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    source, sink, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    spark.createDataFrame([(7, "held", "", [], "h", "y")], SCHEMA).write.json(str(sink))
    fail = []

    def work(df):
        fail.append(df.count())
        return df

    def run(rows):
        (source / f"{len(list(source.iterdir()))}.json").write_text("\n".join(map(json.dumps, rows)))
        resume.resumed(spark, str(source), SCHEMA, str(sink), str(state), work).awaitTermination()
        return sorted(r.pair_id for r in spark.read.schema(SCHEMA).json(str(sink)).collect())

    assert run([{"pair_id": 1, "cve": "c", "func_before": "a"}, {"pair_id": 8, "cve": "held", "func_before": "h"}]) == [1, 7]
    (state / "commits" / "0").unlink()  # as if the run had ended before the batch was noted
    for crc in (state / "commits").glob(".0.crc"):
        crc.unlink()
    assert run([{"pair_id": 2, "cve": "c", "func_before": "b"}]) == [1, 2, 7]


def test_statistics_of_a_run(spark):
    df = spark.createDataFrame([("HIGH_MULTITURN", True), ("FAIL", None)], "quality_tag string, truncation_warning boolean")
    assert E.run_statistics(df, 4.0).first().per_second == 0.5 and "per_second" not in E.run_statistics(df).columns
