from datetime import datetime

from codegrain.llm import lookalikes as p8

DAY = datetime(2030, 1, 1)
SCHEMA = "doc_id long, text string, crawled_at timestamp, k string, unified string"
SAME = [["pay café", "ｐａｙ café", "раy café", "pay caf​é", "pay　cafe​́", "﻿pay café­"], ["Zürich Ёлка", "Zürich Ёлка", "Zürich Ëлка"], ["ế", "ế", "е̂́"]]
APART = ["pay cafe", "pay  café", "pay\ncafé", "x2", "x²", "x②", "l1", "I1", "rn", "m", "ı", "i", "tab\tx", "tab x"]


def test_forms(spark):
    texts = [t for g in SAME for t in g] + APART + ["", None]
    df = spark.createDataFrame([(i, t, DAY, "", None) for i, t in enumerate(texts)], SCHEMA)
    out = {r.text: r.u for r in p8.unified(df, "text", "u").collect()}
    for group in SAME:
        assert len({out[t] for t in group}) == 1, [out[t] for t in group]
    forms = [out[g[0]] for g in SAME] + [out[t] for t in APART]
    assert len(set(forms)) == len(forms)
    assert out[""] == "" and out[None] is None and all(out[t] == t for t in APART if t.isascii())


def test_idempotent_and_long(spark):
    text = "а́ ｘ​ " * 30_000
    df = spark.createDataFrame([(1, text, DAY, "", "")], SCHEMA)
    once = p8.unified(df, "text").first().unified
    assert p8.unified(spark.createDataFrame([(1, once, DAY, "", "")], SCHEMA), "text").first().unified == once == "á x " * 30_000


def test_pairs(spark):
    texts = [t for g in SAME for t in g] + APART
    rows = [(i, t, DAY, "", "") for i, t in enumerate(texts)] + [(100, SAME[0][0], DAY, "", ""), (0, SAME[0][0], DAY, "", ""), (101, None, DAY, "", ""), (102, "", None, "", ""), (None, "x", DAY, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in p8.lookalike_pairs(df, "doc_id", "text", "crawled_at").collect()}
    expected, at = set(), 0
    for g in SAME:
        expected |= {(at + i, at + j) for i in range(len(g)) for j in range(i + 1, len(g))}
        at += len(g)
    expected |= {(i, 100) for i in range(1, len(SAME[0]))}
    assert found == expected
    assert p8.lookalike_pairs(df.limit(0), "doc_id", "text", "crawled_at").count() == 0


def test_representatives():
    to = p8.representatives({"é": 1, "ё": 5, "а": 9, "​": 3, " ": 2, "ａ": 1})
    assert to["а"] == to["ａ"] == "a" and to["​"] == "" and to[" "] == " " and to["ë"] == "ё"
    assert all(not (len(x) == 1 and x.isascii()) for x in to)


def test_letters_of_the_same_shape():
    for a, b in [tuple(x) for x in "VѴ ƟӨ ɵө ƩΣ ɑα ĐƉ κк τт ʋυ ΛɅ ɩι".split()]:
        to = p8.representatives({a: 2, b: 1})
        assert to.get(a, a) == to.get(b, b), (a, b)
    letters = [x for row in p8.shapes() for x in row]
    assert len(letters) == len(set(letters)) and all(sum(x.isascii() for x in row) <= 1 and len({x.isupper() for x in row}) == 1 for row in p8.shapes())


def test_classes(spark):
    texts = [t for g in SAME for t in g] + APART
    rows = [(i, t, DAY, "", "") for i, t in enumerate(texts)] + [(100, SAME[0][0], DAY, "", ""), (None, "x", DAY, "", "")]
    found = {r.k: (r.form, r.spelling) for r in p8.lookalike_classes(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "crawled_at").collect()}
    assert {k for k in found if k < 100} == set(range(sum(map(len, SAME)))) and found[100] == found[0] == (0, 0)
    assert len({f for f, _ in found.values()}) == len(SAME)
