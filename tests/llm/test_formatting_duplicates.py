from datetime import datetime

from codegrain.llm import formatting_duplicates as p1

DAY = datetime(2030, 1, 1)
SCHEMA = "idx long, func string, ingested_at timestamp, k string, fp string"


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t, DAY, "x", None) for i, t in enumerate(texts, 1)], SCHEMA)
    return sorted(tuple(r) for r in p1.formatting_duplicates(df, "idx", "func", "ingested_at").collect())


def test_what_counts_as_the_same(spark):
    texts = [
        "int f(int a) { return a + 1; }", "INT F(int a)\n{\n\treturn a+1;\n}", "int f(int a) { return a - 1; }",
        "s x = { .a = 1, .b = f(2, 3) };", "s x = {\n .b = f(2,3),\n .a = 1,\n};", "s x = { .a = f(2, 3), .b = 1 };",
        "/**\n * g\n * @a: one\n * @b: two\n */\nint g;", "// g\n// @b: two\n// @a: one\nint g;", "/**\n * g\n * @b: two\n * @a: one\n */\nint g;", "/**\n * g\n * @a: two\n * @b: one\n */\nint g;",
        "a; b;", "b; a;", "x /* note */", "x // note",
    ]
    assert pairs(spark, texts) == [(1, 2), (4, 5), (7, 9), (13, 14)]


def test_nested_initializers(spark):
    texts = ["s x = { .a = { .p = 1, .q = 2 }, .b = 3 };", "s x = { .b = 3, .a = { .q = 2, .p = 1 } };", "s x = { .b = 3, .a = { .q = 1, .p = 2 } };", "s x = { .a = '{', .b = \",}\" }; y;", "s x = { .b = \",}\", .a = '{' }; y;"]
    assert pairs(spark, texts) == [(1, 2), (4, 5)]


def test_nulls_blanks_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, " \n", None, None, None), (3, "", None, None, None), (None, "x", None, None, None), (None, "x", None, None, None), (4, None, DAY, None, None), (5, " ", DAY, None, None)], SCHEMA)
    assert p1.formatting_duplicates(df, "idx", "func", "ingested_at").count() == 0
    assert p1.collapsed(df, "idx", "func", "ingested_at").count() == 0
    assert p1.formatting_duplicates(df.limit(0), "idx", "func", "ingested_at").count() == 0


def test_redeliveries_ties_and_hot_groups(spark):
    rows = [(i, "int  hot;" if i % 2 else "int hot", DAY, "", "") for i in range(300)] + [(5, "int hot", DAY, "", "")] * 3 + [(1000, "alone" * 100_000, None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = p1.formatting_duplicates(df, "idx", "func", "ingested_at", rows_per_salt=16)
    assert sorted(tuple(r) for r in found.collect()) == [(0, i) for i in range(1, 300)]
    assert {(r.keep, r.copies) for r in p1.collapsed(df, "idx", "func", "ingested_at").collect()} == {(0, 300), (1000, 1)}


def test_fields_are_compared_not_only_hashed(spark, monkeypatch):
    a, b = p1.record_fields("s x = { .a = 1, .b = 2 };"), p1.record_fields("s x = { .b = 2, .a = 1 };")
    assert a == b and hash(a) == hash(b)
    assert p1.fingerprint("int a") != p1.fingerprint("int b") and p1.fingerprint("int a") != p1.fingerprint("int a", 7919)


def test_assigned_members_are_no_entries():
    a = "{ struct s t = { .m = 1 }; int a, b; t.x = 1; g(); int c, d; t.y = 2; h(); int c, d; }"
    b = "{ struct s t = { .m = 1 }; int c, d; t.y = 2; h(); int c, d; int a, b; t.x = 1; g(); }"
    for x, y in ((a, b), ("{ s t = { .m = 1 }; t.x = 1, t.y = 2; }", "{ s t = { .m = 1 }; t.y = 2, t.x = 1; }")):
        assert p1.fingerprint(x) != p1.fingerprint(y) and not p1.same_fields(x, y) and p1.second_fingerprint(x) != p1.second_fingerprint(y)


def test_braces_around_statements_do_not_number_initializers():
    a = "f() { if (x) y(); s t = { .a = 1, .b = { .c = 2, .d = 3 } }; }"
    b = "f()\n{\n\tif (x) {\n\t\ty();\n\t}\n\ts t = { /* note */ .b = { .d = 3, .c = 2 }, .a = 1, };\n}".replace("/* note */ ", "")
    assert p1.fingerprint(a) == p1.fingerprint(b) and p1.same_fields(a, b) and p1.second_fingerprint(a) == p1.second_fingerprint(b)
    two = "s t = { .a = 1 }; s u = { .a = 2 };"
    assert p1.fingerprint(two) != p1.fingerprint("s t = { .a = 2 }; s u = { .a = 1 };") and not p1.same_fields(two, "s t = { .a = 2 }; s u = { .a = 1 };")


def test_wrong_groups_of_the_first_cut_are_taken_apart(spark, monkeypatch):
    """Rows that only share a fingerprint are grouped again by the second cut."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(p1, "fingerprints", lambda c: F.when(F.length(c) > 0, "all the same"))
    assert pairs(spark, ["int a;", "int A", "int b;", "int  b", "int c", "int b"]) == [(1, 2), (3, 4), (3, 6)]
