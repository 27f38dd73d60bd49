"""Every query runs on the smallest tables; those with SQL agree with it."""

import math
import os

import duckdb
import pandas as pd
import pytest

from codegrain.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v).replace("+00:00", "")

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        expected = duck.execute(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found)


def test_production_limits(spark, tmp_path):
    text = lambda n: " | ".join(f"[Line {p}] RET: return" for p in range(n))
    code = "int f(void) {\n" + "".join(f"    g{k}(a{k});\n" for k in range(400)) + "}\n"
    rows = [(1, code, text(230), "0", "p", None), (2, code, text(40), "1", "p", None)]
    spark.createDataFrame(rows, "idx long, func string, vulnir string, target string, project string, ingested_at timestamp").write.parquet(str(tmp_path / "primevul_train.parquet"))
    run = lambda name: {r[0]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    built = run("build_examples")
    assert len(built) == 2 and min(r.prompt_pieces for r in built.values()) > 2_400
    assert {k: (r.events, r.cut) for k, r in run("event_limit_production").items()} == {1: (230, 10)}
    assert {k: (r.ir.count("RET"), r.ir.endswith("VULNIR_TRUNCATED")) for k, r in run("render_ir_production").items()} == {1: (220, True), 2: (40, False)}
    assert not any(r.label_truncated for r in run("pack_labels_production").values())
    assert run("pad_batch_production")[0].longest > 1_000


def test_names_of_events(spark, tmp_path):
    code = "void f() { int len = n + 4; memcpy(d + e, s, len); buf[len] = i1 + i2 + i3 + i4; }"
    spark.createDataFrame([(1, code, None)], "idx long, func string, ingested_at timestamp").write.parquet(str(tmp_path / "primevul_train.parquet"))
    found = {}
    for r in sorted(QUERIES["key_vars"](spark, str(tmp_path)).collect()):
        found.setdefault(r.pos, []).append(r.name)
    # A category keeps up to five names, with n that len depends on; two seeds or more keep four.
    assert found == {0: ["len", "n"], 1: ["s", "len", "d + e", "n"], 2: ["buf[len]", "i1", "i2", "i3"], 3: ["buf", "len", "n"]}
