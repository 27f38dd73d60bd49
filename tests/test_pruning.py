import random

from pyspark.sql import functions as F

from codegrain.operators import pruning as R


def test_anchors(spark):
    df = spark.createDataFrame([("[Line 7] x | [line: 3] Line=7 line 0 lines 9",), (None,)], "x string")
    assert [r[0] for r in df.select(R.anchors(F.col("x"))).collect()] == [[7, 3], []]


def test_lines_as_python_cuts_them(spark):
    texts = ["a\nb\r\nc\rd\x0ce f\n", "", "\n", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r[0] for r in df.select(R.lines(F.col("x"))).collect()] == [t.splitlines() for t in texts]


def brute_interest(n, anchors, w, head, tail):
    out = {*range(min(head, n)), *range(max(0, n - tail), n)}
    for a in anchors:
        if a <= n:
            out |= set(range(max(0, a - 1 - w), min(n, a + w)))
    return sorted(out)


def test_interest_and_gaps(spark):
    rng = random.Random(1)
    rows = [([f"l{i} " for i in range(n)], sorted({rng.randrange(1, 40) for _ in range(rng.randrange(4))})) for n in range(30)]
    df = spark.createDataFrame(rows, "l array<string>, a array<int>")
    df = df.withColumn("c", R.interest(F.size("l"), F.col("a"), 2, 3, 2)).withColumn("t", R.reconstruct(F.col("l"), F.col("c")))
    for row in df.collect():
        assert row.c == brute_interest(len(row.l), row.a, 2, 3, 2)
        expected, last = [], None
        for i in row.c:
            if last is not None and i > last + 1:
                expected.append("// ...")
            expected.append(row.l[i].rstrip())
            last = i
        assert row.t == "\n".join(expected)


def test_prune_cases(spark):
    code = "\n".join(f"line_{i} = {i};" for i in range(200))
    rows = [(1, code, "[Line 100] SET: x"), (2, code, None), (3, "short", "[Line 1] x"), (4, None, None), (5, "", "x"), (6, code, "")]
    df = spark.createDataFrame(rows, "k int, code string, ir string")
    out = {r.k: r.pruned for r in R.prune(df, "code", "ir", 200, "pruned").collect()}
    assert "line_99 = 99;" in out[1] and len(R.PIECE.findall(out[1])) <= 200
    assert out[2] == out[6] and out[2].count("// ...") == 2
    assert out[3] == "short" and out[4] == "" and out[5] == ""
    assert all(r.pruned == "" for r in R.prune(df, "code", "ir", 0, "pruned").collect())
    fixed = {r.k: r.p for r in df.select("k", R.prune_middle(F.col("code"), 200).alias("p")).collect()}
    assert fixed[2] == out[2]


def test_ir_prune(spark):
    ir = "\n".join(f"[Line {i}] CALL: memcpy(a{i})" for i in range(50))
    row = spark.createDataFrame([(ir, "")], "a string, b string").select(R.prune_ir(F.col("a"), 60), R.prune_ir(F.col("b"), 60), R.prune_ir(F.col("a"), 5000)).first()
    assert row[0].count("# ...") == 2 and row[1] == "" and row[2] == ir


def test_pieces_of_lines_add_up():
    """Every text that fits has as many pieces as were counted line by line, and the widest window that fits is taken."""
    import random

    rng = random.Random(4)
    for _ in range(400):
        lines = [rng.choice(["", "  ", "\t\tx = f(a, b);", "}", "int y;   ", "\x0c z", "  " + "w " * rng.randrange(9)]) for _ in range(rng.randrange(1, 40))]
        anchors = [rng.randrange(1, 45) for _ in range(rng.randrange(1, 4))]
        limit = rng.randrange(1, 120)
        found = R.fit(lines, anchors, limit, 4, 2, 2)
        sizes = {}
        for w in range(4, -1, -1):
            wide = R.fit(lines, anchors, 10**6, w, 2, 2, density=0.0)
            sizes[w] = len(R.PIECE.findall(wide))
        plain = next((w for w in range(4, -1, -1) if sizes[w] <= limit), None)
        if found is None:
            assert plain is None or sizes[plain] < int(limit * 0.6)
        else:
            assert len(R.PIECE.findall(found)) <= limit
            if plain is not None and all(sizes[w] >= int(limit * 0.6) for w in sizes):
                assert found == R.fit(lines, anchors, 10**6, plain, 2, 2, density=0.0)
