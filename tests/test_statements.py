from pyspark.sql import functions as F

from codegrain.operators import events as V
from codegrain.operators import statements as ir

EXAMPLE = """int f(char *dst, char *src, int n) {
    int len = n + 4;
    if (len > 64)
        return -1;
    memcpy(dst, src, len);
    buf[len] = 0;
}
"""


def test_worked_example(spark):
    df = spark.createDataFrame([(1, EXAMPLE), (2, ""), (3, None), (4, "int g(void) { return; }")], "k int, code string")
    out = {r.k: r.ir for r in ir.generated(df, "k", "code").collect()}
    assert out[1].split(" | ") == [
        "[Line 2] SET: len = n + 4 D{len} U{len@2,n}",
        "[Line 3] BRANCH: if ((len > 64)) U{len@2,n}",
        "[Line 4] RET: return -1",
        "[Line 5] CALL[MEMCPY]: memcpy(...) U{dst,len@2,src,n}",
        "[Line 6] SET: buf[len] = 0 D{buf[len]} U{buf[len]@6}",
        "[Line 6] INDEX[SINK]: buf[len] U{buf,len@2,n}",
    ]
    assert out[2] == out[3] == V.EMPTY
    assert out[4] == "[Line 1] RET: return"


def kinds(spark, code):
    df = spark.createDataFrame([(1, code)], "k int, code string")
    rows = ir.raw_events(ir.statements(df, "k", "code"), "k").orderBy("pos").collect()
    return [(r.kind, r.text) for r in rows]


def test_statements(spark):
    assert kinds(spark, "void f() { do { g(a); } while (a < 3); switch (x) { case 1: goto out; } out: i++; i = i + 1; }") == [
        ("CALL", "g(...)"), ("BRANCH", "do ((a < 3))"), ("SWITCH", "switch ((x))"), ("GOTO", "goto out")]
    assert kinds(spark, "void f() { for (int i = 0; i < n; i++) p->q.r[i] = h(i); }") == [
        ("BRANCH", "for (i < n)"), ("SET", "i = 0"), ("CALL", "h(...) -> p->q->r[i]"), ("INDEX", "p->q.r[i]"), ("CALL", "h(...)")]
    assert kinds(spark, "void f() { for (auto &x : items(a[i])) g(x); }") == [("CALL", "items(...)"), ("INDEX", "a[i]"), ("CALL", "g(...)")]
    assert kinds(spark, "int g(void) { a(); } int h(void) { b(); }") == [("CALL", "a(...)")]
    assert kinds(spark, "x = y; return f(z);") == [("SET", "x = y"), ("RET", "return f(z)")]


def test_what_is_no_event(spark):
    assert kinds(spark, 'void f() { char buf[LEN]; /* a(); } */ s = "b(); {"; // c();\n#define D d()\n i = i - 1u; x++; y = sizeof(z); t[3]; }') == [("SET", 's = "b(); {"'), ("SET", "y = sizeof(z)")]


def test_declarations(spark):
    assert kinds(spark, "void f() { int a = g(x, y), *b = q->r + 1, c; struct s v = { .a = 1 }; std::vector<int> w = T::make(u); }") == [
        ("CALL", "g(...) -> a"), ("SET", "b = q->r + 1"), ("CALL", "g(...)"), ("SET", "v = { .a = 1 }"), ("CALL", "make(...) -> w"), ("CALL", "make(...)")]


def test_names(spark):
    rows = {"a->b.c + d": ["a", "a->b", "a->b->c", "d"], "f(x, \"y z\", 'q', 0x1F, 10u)": ["f", "x"], "t[i].n + (p)->m": ["i", "p", "t"], "NULL": [], "s . n": ["s", "s.n"], "ns::f(1)": ["ns::f"]}
    df = spark.createDataFrame([(k,) for k in rows], "e string")
    assert {r.e: r.s for r in df.select("e", ir.symbols(F.col("e")).alias("s")).collect()} == rows
    single = {"&x": "x", "*p": "p", "a->b.c": "a->b->c", "\"s\"": "", "17": "", "b[i]": "b[i]", "b[0]": "b", "n + 1": "n + 1", "(*q)->z": "q->z"}
    df = spark.createDataFrame([(k,) for k in single], "e string")
    assert {r.e: r.s for r in df.select("e", ir.symbol(F.col("e")).alias("s")).collect()} == single
    guards = {"(a < b && c)": ["a", "b"], "(!p || q->r == NULL)": ["p", "q", "q->r"], "(x)": [], "(a->b)": [], "(x << 2)": []}
    df = spark.createDataFrame([(k,) for k in guards], "e string")
    assert {r.e: r.s for r in df.select("e", ir.guarded(F.col("e")).alias("s")).collect()} == guards


def test_long_and_deep_texts(spark):
    long = "void f() { x = g(" + ", ".join(f'"s{i}", a{i}' for i in range(2_000)) + "); " + "y = z; " * 3_000 + "h(" * 40 + ")" * 40 + "; w = v; }"
    df = spark.createDataFrame([(1, long)], "k int, code string")
    rows = ir.raw_events(ir.statements(df, "k", "code"), "k")
    assert rows.where("kind = 'SET'").count() == 3_001 and rows.where("text = 'g(...) -> x'").first().uses[:1] == ["a0"]


def test_assigned_calls_come_twice_and_runs_are_compressed(spark):
    df = spark.createDataFrame([(1, "void f() { g(a); g(b); x = g(c); h(d); h(e); }")], "k int, code string")
    text = ir.generated(df, "k", "code").first().ir
    assert text.startswith("[Line 1] CALL: g(...) ×4 -> x D{x}") and text.count("h(...)") == 2


def test_broken_code_is_survived(spark):
    assert kinds(spark, "void f() { x = = 3; y = 4; }") == [("SET", "y = 4")]
    assert kinds(spark, "{" + "x = = 3;" * 200 + "}") == []
    df = spark.createDataFrame([(1, "{" + "x = = 3;" * 200 + "}")], "k int, code string")
    assert ir.generated(df, "k", "code").first().ir == V.FAILED


def test_parse_of_rendered_events(spark):
    text = "[Line 3] SET: a = b | c D{a} U{b@2,c} | [Line 4] CALL[FREE]: free(a) U{a@3} | [Line ?] ...: VULNIR_TRUNCATED"
    df = spark.createDataFrame([(1, text), (2, V.EMPTY), (3, None)], "k int, ir string")
    rows = V.event_table(df, "k", "ir").orderBy("pos").collect()
    assert [(r.line, r.kind, r.tag, r.text, r.defs, r.uses) for r in rows] == [(3, "SET", "", "a = b | c", ["a"], ["b", "c"]), (4, "CALL", "FREE", "free(a)", [], ["a"])]


def test_limit_and_mark(spark):
    events = spark.createDataFrame([(1, p, p + 1, "RET", "CTRL", "return", [], []) for p in range(5)], "k int, pos int, line int, kind string, tag string, text string, defs array<string>, uses array<string>")
    assert V.rendered(events, "k", 3).first().ir == "[Line 1] RET: return | [Line 2] RET: return | [Line 3] RET: return | " + V.CUT
    assert V.rendered(events, "k", 5).first().ir.count("RET") == 5


def test_closure_is_two_steps(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (2, "a", "z")], "k int, src string, dst string")
    seeds = spark.createDataFrame([(1, 0, "a")], "k int, pos int, name string")
    assert sorted(r.name for r in V.closure(seeds, edges, "k").collect()) == ["a", "b", "c"]


def test_categories(spark):
    assert [r[0] for r in spark.createDataFrame([("memcpy",), ("kfree",), ("mine",)], "c string").select(V.category(F.col("c"))).collect()] == ["MEMCPY", "FREE", ""]


def test_changes(spark):
    same = "int g(void) { return; }"
    rows = [(1, "p", same, "[Line 1] RET: return"), (2, "p", same, "[Line 9] RET: return"), (3, "p", same, None), (None, "p", same, "[Line 1] RET: return"), (4, "q", "{" + "x = = 3;" * 200 + "}", V.FAILED), (5, "q", None, V.EMPTY)]
    df = spark.createDataFrame(rows, "k long, project string, code string, old string")
    assert {tuple(r) for r in ir.changes(df, "k", "code", "old", "project").collect()} == {("p", 4, 2, 0), ("q", 2, 0, 1)}


def test_within_a_row_as_over_rows(spark):
    """Closures, runs and rendering of arrays give what the operators on rows give."""
    import random

    rng = random.Random(1)
    schema = "k int, events array<struct<pos:int,line:int,kind:string,tag:string,text:string,defs:array<string>,uses:array<string>>>"
    some = lambda: rng.sample("abcdef", rng.randrange(3))
    rows = [(k, [(p, p + 1, rng.choice(["CALL", "SET"]), rng.choice(["", "DF", "FREE"]), rng.choice(["f(x)", "g(x)", "a = b"]), some(), some()) for p in range(rng.randrange(12))]) for k in range(60)]
    df = spark.createDataFrame(rows, schema)
    flat = df.select("k", F.explode("events").alias("e")).select("k", "e.*")
    edges, _ = V.dependencies(flat, "k")
    over = {(r.k, r.pos, r.name) for r in V.closure(flat.select("k", "pos", F.explode("uses").alias("name")), edges, "k").collect()}
    within = df.select("k", F.explode(V.reached(F.col("events"), lambda e: e["uses"])).alias("r")).select("k", "r.pos", F.explode("r.names").alias("name")).collect()
    assert {tuple(r) for r in within} == over and len(within) == len(over)
    for least in (2, 3):
        one = {(r.k, r.pos, r.line, r.kind, r.text, tuple(r.uses), r.calls) for r in V.compressed(flat, "k", least).collect()}
        two = {(r.k, r.pos, r.line, r.kind, r.text, tuple(r.uses), r.calls) for r in df.select("k", F.explode(V.runs(F.col("events"), least)).alias("e")).select("k", "e.*").collect()}
        assert one == two
    for most in (3, 220):
        assert {(r.k, r.ir) for r in V.rendered(flat, "k", most).collect()} == {(r.k, r.ir) for r in df.select("k", V.rewritten(F.col("events"), most).alias("ir")).where("ir is not null").collect()}
