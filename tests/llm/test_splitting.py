import random
from datetime import datetime

from codegrain.llm import splitting as p4


def check(text, limit=1000, overlap=(40, 80)):
    pieces = p4.split(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in pieces:
        assert p4.estimated(b - a) <= limit
    for (_, e), (s, _) in zip(pieces, pieces[1:]):
        assert overlap[0] <= p4.estimated(e - s) <= overlap[1]
    return pieces


def test_limits():
    assert p4.most_chars(1000) == 3503 and p4.estimated(3503) == 1000 and p4.estimated(3504) == 1001
    assert len(check("x" * 3503)) == 1 and len(check("x" * 3504)) == 2 and check("") == [(0, 0)]


def test_all_kinds_of_text():
    rng = random.Random(4)
    lines = "".join(f"    call_{rng.randrange(9)}(arg_{i}, {i});\n" for i in range(600))
    pieces = check(lines)
    assert all(lines[e - 1] == "\n" for _, e in pieces[:-1]) and all(lines[s - 1] == "\n" for s, _ in pieces[1:])
    one_line = lines.replace("\n", "")
    assert all(one_line[:e].rstrip()[-1] == ";" for _, e in check(one_line)[:-1])
    check("y" * 50_000)
    check("词" * 9_000 + "\n" * 5_000 + "a b " * 3_000)
    check("\r\n".join("z" * rng.randrange(1, 3_000) for _ in range(40)))
    for _ in range(30):
        check("".join(rng.choice(["a", " ", "\n", ";", "}", "word ", "é"]) * rng.randrange(1, 400) for _ in range(rng.randrange(1, 60))), rng.choice([300, 1000]))


def test_valley_is_chosen():
    text = "alpha beta gamma delta;\n" * 110 + "omega sigma kappa theta;\n" * 110
    assert p4.split(text)[0][1] == len("alpha beta gamma delta;\n") * 110


def test_operator(spark):
    day = datetime(2030, 1, 1)
    rows = [(1, "a;\n" * 3_000, day, 0), (1, "a;\n" * 3_000, day, 1), (2, "small", day, 0), (3, None, day, 0), (4, "", None, 0), (None, "b" * 9_000, day, 0), (5, "c" * 300_000, None, 0)]
    df = spark.createDataFrame(rows, "idx long, func string, ingested_at timestamp, piece int")
    out = p4.pieces(df, "idx", "func", "ingested_at").collect()
    assert {r.idx for r in out} == {1, 5}
    one = sorted((r.piece, r.start, r.end, r.text) for r in out if r.idx == 1)
    assert [p for p, *_ in one] == list(range(1, len(one) + 1)) and all(("a;\n" * 3_000)[s:e] == t for _, s, e, t in one)
    assert p4.pieces(df.limit(0), "idx", "func", "ingested_at").count() == 0
