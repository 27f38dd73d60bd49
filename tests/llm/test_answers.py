import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codegrain.llm import answers as p3

EN = "The value is read from the packet and used as a size before any check is made. The caller returns an error when the buffer is too small. "
DE = "Der Wert wird aus dem Paket gelesen und als Größe verwendet, bevor eine Prüfung erfolgt. Der Aufrufer gibt einen Fehler zurück, wenn der Puffer zu klein ist. "
RU = "Значение берётся из пакета и используется как размер до любой проверки. Вызывающий возвращает ошибку, если буфер слишком мал. "
SCHEMA = "pair_id long, cve_desc string, func_before string, root_cause string, enriched_at timestamp, defect string, k long"


@pytest.fixture(scope="module")
def language(spark):
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate([(EN, "en"), (EN, " EN"), (DE, "de"), (RU, "ru"), ("int x = 1; return x;", "c"), (EN, None), (None, "en")] * 8)], "doc_id long, text string, lang string")
    return p3.fit_language(docs, "doc_id", "text", "lang", "en")


@pytest.fixture(scope="module")
def manner(spark):
    told = [EN, "The value `n` is compared with the limit first, and entries that do not fit are refused early. Older branches need the same change.", "An attacker who can send a packet chooses the length of the access. The caller cannot tell.",
            "The length `a` comes from the request and is used before it is checked.", "`f` is unable to go on when the request is refused, and frees the buffer twice."]
    return p3.fit_manner(spark.createDataFrame(list(enumerate(told * 20)), "pair_id long, root_cause string"), "pair_id", ["root_cause"])


def test_language(language):
    assert language.mismatch(EN, EN) < 0.1 and language.mismatch(EN, DE) > 0.9 and language.mismatch(None, RU) > 0.9
    assert language.mismatch(EN, EN + 'The comment says "' + RU.replace(". ", "") + '" there.') < 0.3
    assert language.mismatch(EN, "Here it is. " + DE) > 0.5
    assert language.mismatch(EN, "") == 0.0


def test_single_rules():
    for s in (None, "", " \n", "n/a", "...", "{}", "```\n```", "Root cause:", "**root_cause**", "[Analysis Failed]", "[Skipped: Context Overflow]", '{"root_cause": ""}', "TODO", "(none)", "<answer>", "[no reply]", "Answer: Analysis: Root cause: Summary: n/a"):
        assert p3.is_empty(s), s
    assert not p3.is_empty("None of the callers checks it.") and not p3.is_empty("Root cause: the size wraps.")
    asked = p3.asked_text(["An overflow was found in the parser of quux 1.2 that allows code execution.", None])
    assert p3.is_copy("Question: AN OVERFLOW was found in the\nparser of quux 1.2", asked)
    assert not p3.is_copy("The report says \"An overflow was found in the parser\". The fix compares the length with the size of the buffer first.", asked)


def test_refusals(manner):
    for s in ("Sorry, I can't help with that.", "I'd rather not walk through a defect.", "This request is outside what I may assist with.", "My guidelines do not allow me to comment.",
              "I cannot help with this request. " * 30, "Unfortunately, helping with that isn't possible here.", "I don't feel able to answer this.", "We can't give you an answer to that question, sorry.",
              "Thank you for the question about `f`. However, I am not at liberty to explain how this may be used. Please ask the maintainers."):
        assert manner.refuses(s), s
    for s in ("Sorry state of `x` aside, I cannot find another path to `y`.", "`f` refuses the request and is unable to go on.", "The request is refused when the limit is reached.", EN, DE, RU, "",
              "I cannot help with every detail. " + EN * 3):
        assert not manner.refuses(s), s


def test_models_count_every_row(spark, monkeypatch):
    """Neither model is fitted on a part of the rows."""
    monkeypatch.setattr(p3, "Manner", lambda counts: counts)
    monkeypatch.setattr(p3, "Language", lambda counts, home: counts)
    monkeypatch.setattr(p3, "MOST_COUNTED", 20, raising=False)
    rows = spark.range(30_000).select(F.col("id").alias("k"), F.lit("The size is read. It is read").alias("a"), F.lit("so it is").alias("b"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"))
    told = p3.fit_manner(rows.limit(9_000), "k", ["a", "b"])
    assert told[" size"] == 9_000 and told[" it i"] == told["it is"] == 18_000 and told[" read"] == 18_000
    spoken = p3.fit_language(rows, "k", "a", "lang", "en")
    assert spoken["en"]["siz"] == 20_000 and spoken["de"]["siz"] == 10_000 and spoken["en"][" re"] == 40_000


def test_identifiers_are_found_from_the_start_of_words():
    for text, left in (("a foo_1.b->c, x", "a  , x"), ("call f(x y)z of aB.c::d. Then and/or a.b/c", "call  z of  . Then   a. "), ("плохоA_b wordбx1 end", "плохо  wordб  end")):
        assert p3.IDENTIFIER.sub(" ", text).split() == left.split() == re.sub(p3.IDENTIFIER.pattern.removeprefix("(?!\\B\\w)"), " ", text, flags=re.A).split(), text


def test_defects(spark, language, manner):
    day = datetime(2030, 1, 1)
    full = [f"The size `{n}_len` is read from the packet and never checked. A crafted packet writes past the buffer." for n in ("abc", "defg", "hij")] * 40
    rows = [(i, "quux overflow", "int f;", t, day, "x", 0) for i, t in enumerate(full)]
    rows += [(1000, "q", "c", "The size `z_len` is read from the packet and never che", day, "", 0), (1001, "q", "c", None, day, "", 0), (1002, "q", "c", RU, None, "", 0),
             (1003, None, None, "I cannot comply with this request.", day, "", 0), (1004, "An overflow in the frobnicator of quux 3.4 was found by us.", None, "an overflow in the frobnicator of quux 3.4 was found by us", day, "", 0),
             (1001, "q", "c", None, day, "", 1), (None, "q", "c", None, day, "", 0), (1005, "q", "c", EN * 4_000 + "A crafted packet writes past the buffer.", day, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.pair_id, r.defect) for r in p3.defects(df, language, manner, "pair_id", "cve_desc", ["cve_desc", "func_before"], ["root_cause"], "enriched_at").collect()}
    assert found == {(1000, "truncated"), (1001, "empty"), (1002, "other_language"), (1003, "refusal"), (1004, "copy")}
    assert p3.defects(df.limit(0), language, manner, "pair_id", "cve_desc", ["cve_desc"], ["root_cause"], "enriched_at").count() == 0


def test_copies_of_a_cut_answer(spark, language, manner):
    day = datetime(2030, 1, 1)
    whole = [f"The size `{'abcdefghij'[i % 10] * (i // 10 + 1)}_len` is read from packet {'klmnopqrst'[i % 10] * (i // 10 + 1)} and never checked. A crafted packet writes past the buffer." for i in range(40)]
    cut = "The size `z_len` is read from the packet and never che"
    rows = [(i, "quux overflow", "int f;", t, day, "", 0) for i, t in enumerate(whole + [cut] * 300 + ["The length is taken from the wire and the cal"] * 2)]
    found = p3.defects(spark.createDataFrame(rows, SCHEMA), language, manner, "pair_id", "cve_desc", ["cve_desc", "func_before"], ["root_cause"], "enriched_at").collect()
    assert {r.pair_id for r in found if r.defect == "truncated"} == set(range(40, 342)) and len(found) == 302
