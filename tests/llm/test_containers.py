import random
from datetime import datetime

import pytest

from codegrain.llm import containers as p6
from codegrain.llm import tokens


def test_packing():
    rng = random.Random(3)
    for low, high, n in ((1, 100, 200), (30, 60, 90), (50, 50, 9), (100, 100, 3), (34, 34, 10)):
        sizes = [rng.randint(low, high) for _ in range(n)]
        bins, _ = p6.pack(sizes, 100, 20_000)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= 100
        assert len(bins) <= len(p6.best_fit(sizes, 100))
    assert p6.pack([], 100) == ([], False)


def exact(sizes, capacity):
    """The least number of containers, by trying all ways."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1:])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_search_improves_on_best_fit():
    rng = random.Random(8)
    better = 0
    for _ in range(60):
        sizes = sorted((rng.randint(15, 60) for _ in range(11)), reverse=True)
        found, fewest, greedy = len(p6.pack(sizes, 100, 50_000)[0]), exact(sizes, 100), len(p6.best_fit(sizes, 100))
        assert p6.least(sizes, 100) <= fewest <= found <= greedy
        better += found < greedy
        assert found == fewest
    assert better


def test_fillings_of_more_items_than_calls_can_be_nested():
    for sizes in ([1] * 3_000, [1] * 1_500 + [2] * 900):
        bins, completed = p6.pack(sizes, 2048)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and len(bins) == 2 and max(map(sum, bins)) <= 2048, completed


def test_dominance():
    left = p6.Left([50, 30, 20, 10])
    assert p6.dominated([20, 10], 0, left) and p6.dominated([10, 10, 10], 0, p6.Left([30, 10, 10, 10])) and p6.dominated([7, 7, 7], 4, p6.Left([25, 7, 7, 7])) and not p6.dominated([7, 7, 7], 3, p6.Left([25, 7, 7, 7]))
    assert p6.dominated([20, 10], 20, left) and p6.dominated([30], 20, left) and not p6.dominated([50], 0, left)


@pytest.mark.skipif(not __import__("os").path.exists(tokens.TOKENIZER), reason="no tokenizer")
def test_operator(spark):
    rng = random.Random(5)
    day = datetime(2030, 1, 1)
    texts = [" ".join("word%d" % rng.randrange(50) for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    texts += ["long text é 词 " * 700, "x" * 3_000, "词" * 2_000]
    rows = [(i, t, day, 0, "") for i, t in enumerate(texts)] + [(0, texts[0], day, 0, ""), (900, None, day, 0, ""), (901, "", None, 0, ""), (None, "x", day, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, crawled_at timestamp, n int, k string")
    out = p6.fill_containers(df, "doc_id", "text", "crawled_at", capacity=256, items_per_task=150, steps=20_000).collect()
    size = tokens.size
    fill, places, parts = {}, set(), {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.n
        assert (r.container, r.position) not in places
        places.add((r.container, r.position))
        parts.setdefault(r.doc_id, []).append((r.piece, r.start, r.end, r.n))
    assert max(fill.values()) <= 256
    assert set(parts) == set(range(len(texts)))
    for k, ps in parts.items():
        ps.sort()
        assert "".join(texts[k][a:b] for _, a, b, _ in ps) == texts[k]
        assert all(size(texts[k][a:b]) == n for _, a, b, n in ps)
        assert len(ps) == 1 or size(texts[k]) > 256
    assert {r.made_by for r in out} == {"completion"}
    report = p6.fill_report(spark.createDataFrame(out), 256).first()
    assert report.containers <= report.lower_bound * 1.03 + 1 and report.fullest <= 256 and report.by_completion == report.containers
    assert p6.fill_containers(df.limit(0), "doc_id", "text", "crawled_at").count() == 0


@pytest.mark.skipif(not __import__("os").path.exists(tokens.TOKENIZER), reason="no tokenizer")
def test_items_that_share_no_container_end_the_rounds(spark):
    """Containers that can't be filled are not dealt again for ever."""
    df = spark.createDataFrame([(i, " the" * (150 + i % 7), None) for i in range(90)], "doc_id long, text string, crawled_at timestamp")
    out = p6.fill_containers(df, "doc_id", "text", "crawled_at", capacity=256, items_per_task=20)
    assert out.count() == out.select("container").distinct().count() == 90
