import random
from datetime import datetime

from codegrain.llm import cross_split as p5

DAY = datetime(2030, 1, 1)
SCHEMA = "idx long, func string, project string, ingested_at timestamp, k int, l string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(14))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(14))]
        for limit in (0, 1, 3, 6):
            assert p5.within(a, b, limit) == (levenshtein(a, b) <= limit), (a, b, limit)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 120))) for _ in range(n)]
    train = [(i, t, f"p{i % 3}", DAY, 0, "") for i, t in enumerate(texts)]
    valid = []
    for j, t in enumerate(texts[::2]):
        ws = t.split()
        for _ in range(int(len(ws) * rng.choice([0, 0.05, 0.1, 0.25]))):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        valid.append((10_000 + j, " ; ".join(ws).upper(), None if j % 5 == 0 else "q", DAY, 0, ""))
    return train, valid


def brute(train, valid):
    out = set()
    for i, t, *_ in train:
        for j, v, *_ in valid:
            if t and v and t.strip() and v.strip():
                a, b = p5.words(t), p5.words(v)
                if levenshtein(a, b) * 100 <= 15 * max(len(a), len(b)):
                    out.add((i, j))
    return out


def test_against_brute_force(spark):
    train, valid = corpus(7)
    train += [(500, None, "p", DAY, 0, ""), (501, "  ", None, None, 0, ""), (502, train[3][1], "p0", DAY, 0, ""), train[0], (503, "x " * 60_000, "p", DAY, 0, "")]
    valid += [(20_000, None, "q", DAY, 0, ""), (20_001, "", None, None, 0, ""), (20_002, train[3][1], "q", DAY, 0, ""), (None, train[3][1], "q", DAY, 0, "")]
    a, b = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(valid, SCHEMA)
    found = {tuple(r) for r in p5.overlapping_pairs(a, b, "idx", "func", "ingested_at").collect()}
    expected = brute({r[0]: r for r in train}.values(), [v for v in valid if v[0] is not None])
    assert found <= expected and len(found) >= 0.98 * len(expected) and (502, 20_002) in found
    report = p5.overlap_report(a, b, "idx", "func", "ingested_at", "project", ("train", "valid")).collect()
    assert sum(r.records for r in report if r.split == "train") == len({r[0] for r in train})
    for k, side in enumerate(("train", "valid")):
        assert sum(r.partners for r in report if r.split == side) == len(found)
        assert sum(r.overlapping for r in report if r.split == side) == len({p[k] for p in found})


def test_hot_class_and_empty_tables(spark):
    text = "int hot function with some words in it"
    a = spark.createDataFrame([(i, text, "p", DAY, 0, "") for i in range(200)], SCHEMA)
    b = spark.createDataFrame([(1000 + i, text.upper(), "p", DAY, 0, "") for i in range(50)], SCHEMA)
    links, left, right = p5.cross_split(a, b, "idx", "func", "ingested_at")
    assert links.count() == 1 and left.count() == 200 and right.count() == 50
    assert p5.overlapping_pairs(a, b, "idx", "func", "ingested_at").count() == 10_000
    assert p5.overlapping_pairs(a.limit(0), b, "idx", "func", "ingested_at").count() == 0


def test_plan_follows_the_sizes():
    plans = [p5.plan(n, n // 6) for n in (100, 10_000, 1_000_000, 100_000_000)]
    assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(plans, plans[1:]))
    for (bits, blocks), n in zip(plans, (100, 10_000, 1_000_000, 100_000_000)):
        assert blocks * n * (n // 6) * 8 / 2**bits < 60 * n * blocks


def test_hot_blocks_are_split(spark, monkeypatch):
    train, valid = corpus(9, 60)
    a, b = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(valid, SCHEMA)
    plain = {tuple(r) for r in p5.overlapping_pairs(a, b, "idx", "func", "ingested_at").collect()}
    hot = p5._hot
    monkeypatch.setattr(p5, "_hot", lambda x, y, pairs: hot(x, y, 1, sample=1))
    assert {tuple(r) for r in p5.overlapping_pairs(a, b, "idx", "func", "ingested_at").collect()} == plain == brute(train, valid)


def test_members_of_hot_classes_are_paired_in_parts(spark):
    from codegrain.llm.classes import member_pairs

    links = spark.createDataFrame([(0, 100), (0, 200)], "l long, r long")
    left = spark.createDataFrame([(0, i) for i in range(37)], "rep long, k long")
    right = spark.createDataFrame([(100, 100 + i) for i in range(23)] + [(200, 200)], "rep long, k long")
    found = [tuple(r) for r in member_pairs(links, left, right, rows_per_salt=5).collect()]
    assert len(found) == len(set(found)) == 37 * 24


def test_members_are_not_sent_to_the_driver(spark):
    from codegrain.llm.classes import member_pairs

    links = spark.createDataFrame([(0, 100)], "l long, r long")
    left = spark.createDataFrame([(i % 3, i) for i in range(30)], "rep long, k long")
    right = spark.createDataFrame([(100, 100), (100, 101), (102, 102)], "rep long, k long")
    pairs = member_pairs(links, left, right, rows_per_salt=4)
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j) for i in range(0, 30, 3) for j in (100, 101))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
