from datetime import datetime

import pytest

from codegrain.llm import syntax as p2

GOOD_C = [
    "int f(a, b) int a; char *b; { return a; }", "static struct s *g(struct s *new, int class) { new->x[class] = (int)sizeof(*new); return new; }",
    "void f(void) { for (int i = 0; i < n; i++) { if (a) b(); else if (c) { d(); } } do { x--; } while (x > 0); }",
    "int x = (a) - 1, *p, q[3] = {1, 2, [2] = 3}; struct t { int a : 3; union { int b; } u; } v = {.a = 1, .u.b = 2};",
    "void f() { switch (x) { case A ? 1 : 2: y(); break; default: ; } out: return; }", "typedef int (*fn)(int, char *, ...); fn table[] = { 0 };",
    "#ifdef A\nint a(void) {\n#else\nint a(int x) {\n#endif\nreturn 1; }", "void f() { char c = '\\''; s = \"a\" \"b\\\"\"; /* } */ // {\n }", "enum e { A, B = 2, } x; int y = (struct s){1}.a;",
]
BAD_C = [
    "int f(void) { return 1 }", "int f(void) { if (a { b(); } }", "int f(void) { a = ; }", "int f(void) {", "int f(void) { } }", "int f(void) {\n<<<<<<< a\nx();\n=======\ny();\n>>>>>>> b\n}",
    "int A::f(const B &b) { return 0; }", "void f() { out: }", "void f() { s = \"open; }", "/* open", "def f():\n    return 1", "void f() { x = 0x; }", "#if A\nint x;", "#else\nint x;", "else x;", "void f() { a + b = c; }",
    "void f() { for (;;;) {} }", "void f() { else { } }", "int x", "void f() { do x(); }", "void f() { int a[; }",
]
GOOD_CPP = [
    "std::string A::f(const B &b, long n) { auto *p = &b; std::vector<uint8_t> v(n + 1); for (const auto &x : v) use(x); return p->s() + \"x\"; }",
    "int A::g() { try { h(); } catch (const std::exception &e) { log(e.what()); } catch (...) { throw; } delete[] a; a = new int[n + 1]; return static_cast<int>(x.size()); }",
    "template <typename T> class Q : public R<T> { public: Q() : a(1), b{2} {} ~Q(); virtual int f() const override = 0; private: int a, b; };",
    "void f() { std::sort(a.begin(), a.end(), [](const auto &x, const auto &y) { return x.k < y.k; }); std::lock_guard<std::mutex> g(m); std::map<int, std::vector<int>> z; if (auto p = q(); p) r(); }",
    "namespace n { using t = int; } using namespace std; bool operator==(const A &a, const A &b) { return a.x == b.x; }", "struct s v = {.a = 1, .b = 2,}; auto r = R\"(a \" b)\";", "void f() { out: int x = 1; }",
]
BAD_CPP = ["int f(struct s *new, int class) { return 0; }", "int f(a, b) int a; { return a; }", "void f() { auto x = ; }", "void f() { std::vector<int v; }", "fn main() -> i32 { 0 }", "void f() { [](int x { return x; }; }"]


@pytest.mark.parametrize("cpp, good, bad", [(False, GOOD_C, BAD_C), (True, GOOD_CPP, BAD_CPP)])
def test_grammars(cpp, good, bad):
    g = p2.syntax(cpp)
    assert [x for x in good if not g.valid(x)] == []
    assert [x for x in bad if g.valid(x)] == []


def test_deep_nesting_is_parsed():
    g = p2.syntax(False)
    assert g.valid("void f() {" + "if (a) {" * 900 + "}" * 900 + "}")
    assert g.valid("int x = " + "(" * 700 + "1" + ")" * 700 + ";")
    assert not g.valid("int x = " + "(" * 700 + "1" + ")" * 699 + ";")


@pytest.mark.parametrize("cpp", [False, True])
def test_any_depth(cpp):
    g, n = p2.Syntax(cpp), 30_000
    for a, b, c in (("int x = " + "(" * n, "1", ")" * n + ";"), ("int x = a" + "[b" * n, "", "]" * n + ";"), ("int x[] = " + "{" * n, "1", "}" * n + ";"), ("void f() {" + "if (a) {" * n, "b();", "}" * n + "}")):
        assert g.valid(a + b + c) and not g.valid(a + b + c[1:])
    assert not g.valid("int x = " + "(" * n + "1 +" + ")" * n + ";")


def test_every_grammar_is_asked_and_tokens_rank():
    ranking = p2.Ranking({"c": {"int": 50, "->": 20}, "cpp": {"int": 40, "std": 30, "::": 60}})
    assert p2.accepting("int x;", ranking) == ["c", "cpp"] and p2.accepting("[1, 2]", ranking) == ["json", "python"] and p2.accepting("int A::f() { return 0; }", ranking) == ["cpp"]
    assert ranking("def f(self):\n    return None")[0] == "python" and ranking('{"a": true, "b": null}')[0] == "json" and ranking("std::x a;")[0] == "cpp"


def test_event_texts():
    good = ["VULNIR_EMPTY", "VULNIR_PARSE_FAILED", "[Line 3] SET: a = b | c D{a} U{b@2,c}", "[Line 3] RET: return 0 | [Line ?] ...: VULNIR_TRUNCATED", "[Line 4] CALL[FREE]: free(a[0]) U{a}"]
    bad = ["[Line ] SET: a", "[Line 3] SET:", "[Line 3] SET: a D{a", "[Line 3] SET: f(a", "[Line 3] SET: f]", "[Line 3] SET: a | [Lin", "text", "[Line ?] ...", "[Line 3] SET: "]
    assert [x for x in good if not p2.events_valid(x)] == [] and [x for x in bad if p2.events_valid(x)] == []


def test_verdicts(spark):
    day = datetime(2030, 1, 1)
    rows = [
        (1, "int x;", "a.c", "VULNIR_EMPTY", "p", day, 0), (2, "int A::f() { return 0; }", "a.c", None, "p", day, 0), (3, "int f( {", "a.cc", "bad", None, day, 0), (4, None, "a.c", " ", None, None, 0),
        (5, "  ", "a.h", "", None, None, 0), (6, "def f():\n    return [1]\n", "x.c", None, "p", day, 0), (7, "int x;", None, None, None, None, 0), (1, "int x;", "a.c", "VULNIR_EMPTY", "p", day, 1), (None, "x", "a.c", "x", "p", day, 0), (8, "[" * 200_000, "a.c", None, "p", day, 0),
    ]
    df = spark.createDataFrame(rows, "idx long, func string, file_path string, vulnir string, project string, ingested_at timestamp, verdict int")
    judged = p2.verdicts(df, "idx", "func", "file_path", "ingested_at", "vulnir", "project")
    found = {r.idx: (r.verdict, r.parsed_as) for r in judged.collect()}
    assert found == {1: ("valid", "c"), 2: ("wrong_extension", "cpp"), 3: ("corrupt", None), 4: (None, None), 5: (None, None), 6: ("wrong_extension", "python"), 7: ("wrong_extension", "c"), 8: ("corrupt", None)}
    assert {tuple(r) for r in p2.ill_formed(judged, "idx", "func", "vulnir").collect()} == {(2, "func"), (3, "func"), (3, "vulnir"), (6, "func"), (7, "func"), (8, "func")}
    rates = {(r.source, r.language): (r.files, r.ill_formed_rate) for r in p2.rates(judged).collect()}
    assert rates[("p", "c")] == (4, 0.75) and rates[(None, "cpp")] == (1, 1.0)
    assert p2.verdicts(df.limit(0), "idx", "func", "file_path", "ingested_at", "vulnir", "project").count() == 0
