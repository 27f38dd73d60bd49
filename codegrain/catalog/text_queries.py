"""Queries on text functions, fingerprints, resume and lenient reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions import text as X
from codegrain.operators import enrichment as E
from codegrain.sources import jsonl
from codegrain.sources.tables import read_table

MARK = X.TRUNCATION_MARK.replace("\n", "\\n")


def _text_query(table: str, key: str, column: str, into: str, make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_table(spark, sf_dir, table, key, column).select(key, make(F.col(column)).alias(into))

    return run


def pair_budget_gate(spark, sf_dir):
    pairs = E.within_budget(read_table(spark, sf_dir, "train_aug_paired"))
    return pairs.select("pair_id", "ingested_at", "truncated", F.length("func_before").alias("chars_before"), F.length("func_after").alias("chars_after"))


def resume_anti(spark, sf_dir):
    return E.remaining(read_table(spark, sf_dir, "train_aug_paired"), read_table(spark, sf_dir, "train_llama_paired")).select("pair_id", "ingested_at")


def resume_skipped_semi(spark, sf_dir):
    return E.skipped(read_table(spark, sf_dir, "train_aug_paired"), read_table(spark, sf_dir, "train_llama_paired")).agg(F.count("*").alias("skipped"))


def resume_dup_kept(spark, sf_dir):
    pairs = read_table(spark, sf_dir, "train_aug_paired").select(E.fingerprint("cve", "func_before").alias("fp"))
    return pairs.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(spark, sf_dir):
    return read_table(spark, sf_dir, "train_aug_paired").select("pair_id", E.fingerprint("cve", "func_before").alias("fp"))


def cwe_join(spark, sf_dir):
    return read_table(spark, sf_dir, "train_aug_paired").select("pair_id", E.weaknesses(F.col("cwe")).alias("weaknesses"))


def cve_defaults(spark, sf_dir):
    return read_table(spark, sf_dir, "train_aug_paired").select("pair_id", F.coalesce("cve", F.lit("Unknown CVE")).alias("cve"), E.description(F.col("cve_desc"), F.col("cwe")).alias("description"))


def change_detect(spark, sf_dir):
    """Pairs whose two functions differ, and pairs without the second, per project."""
    pairs = read_table(spark, sf_dir, "train_aug_paired", "project", "func_before", "func_after")
    return pairs.groupBy("project").agg(F.count("*").alias("total"), F.count_if(~F.col("func_before").eqNullSafe(F.col("func_after"))).alias("updated"), F.count_if(F.col("func_after").isNull()).alias("failed"))


def _broken_lines(spark, sf_dir) -> DataFrame:
    """The training table as JSON lines, of which some are cut and some lack the code."""
    rows = read_table(spark, sf_dir, "primevul_train", "idx", "func", "target")
    whole = F.to_json(F.struct("idx", F.coalesce("func", F.lit("")).alias("func"), "target"))
    line = F.when(F.col("idx") % 13 == 0, F.left(whole, F.lit(20))).when(F.col("idx") % 11 == 0, F.to_json(F.struct("idx", "target"))).when(F.col("idx") % 17 == 0, "  ").otherwise(whole)
    return rows.select(line.alias("value"))


def lenient_scan_counts(spark, sf_dir):
    return jsonl.load_counts(_broken_lines(spark, sf_dir), "value")


def callees(spark, sf_dir):
    """How often each callee is called in the event texts, by its normalized last segment."""
    names = F.regexp_extract_all("vulnir", F.lit(r"CALL(?:\[[A-Z]+\])?: ([^(]+)\("), F.lit(1))
    calls = read_table(spark, sf_dir, "primevul_train", "vulnir").select(F.explode(names).alias("name"))
    return calls.groupBy(X.last_segment(X.normalized_callee(F.col("name"))).alias("callee")).agg(F.count("*").alias("calls"))


def metric_log_parse(spark, sf_dir):
    """Logs written from counts per project and read back."""
    rows = read_table(spark, sf_dir, "primevul_train", "project", "target")
    n = rows.groupBy("project").agg(F.count("*").alias("n"), F.count_if(X.number_of_dirty(F.col("target")) == 1).alias("v"))
    log = F.concat(F.lit("Eval done. Accuracy : "), F.col("n").cast("string"), F.lit(".5 | F1 Score: "), F.col("v").cast("string"), F.lit(" | Recall : none"))
    logs = n.select("project", log.alias("log"))
    return logs.select("project", *[X.metric_of_log(F.col("log"), name).alias(c) for c, name in (("accuracy", "Accuracy"), ("f1", "F1 Score"), ("precision", "Precision"), ("recall", "Recall"))])


def json_reply_parse(spark, sf_dir):
    rows = read_table(spark, sf_dir, "train_llama_paired", "pair_id", "root_cause", "safety_justification")
    reply = F.to_json(F.struct("root_cause"))
    return rows.select("pair_id", X.reply_field(reply, "root_cause", F.lit("-")).alias("cause"), X.reply_field(reply, "safety_justification", F.col("safety_justification")).alias("justification"))


def enrich_stats(spark, sf_dir):
    return E.run_statistics(read_table(spark, sf_dir, "train_llama_paired"))


def messages_chain(spark, sf_dir):
    """The length of each conversation's requests."""
    ready = E.within_budget(read_table(spark, sf_dir, "train_aug_paired")).withColumn("d", E.description(F.col("cve_desc"), F.col("cwe")))
    turns = F.array(*E.turns("func_before", "func_after", "cve", "d"))
    return ready.select("pair_id", F.posexplode(turns).alias("turn", "text")).groupBy("pair_id", "turn").agg(F.max(F.length("text")).alias("chars"))


def _replies(spark, sf_dir) -> DataFrame:
    """Replies written from the answers, of which some are cut, some lack a field, some hold a number and some are no objects."""
    rows = read_table(spark, sf_dir, "train_llama_paired", "pair_id", "root_cause", "safety_justification", "enriched_at")
    a, b = F.coalesce("root_cause", F.lit("")), F.coalesce("safety_justification", F.lit(""))
    whole = F.to_json(F.struct(a.alias("root_cause"), b.alias("safety_justification")))
    k = F.col("pair_id")
    reply = (F.when(k % 5 == 0, F.left(whole, F.length(whole) - 3)).when(k % 7 == 0, F.to_json(F.struct(a.alias("root_cause")))).when(k % 11 == 0, F.to_json(F.struct(F.col("pair_id").alias("root_cause"), b.alias("safety_justification"))))
             .when(k % 13 == 0, "[1]").when(k % 17 == 0, F.lit(None).cast("string")).otherwise(whole))
    return rows.withColumn("reply", reply)


def reply_checked(spark, sf_dir):
    """Whether each reply is what its schema asks for, and what comes of it."""
    s = E.synthesis(F.col("reply"), F.lit("second reply"), F.lit("third reply"))
    return _replies(spark, sf_dir).select("pair_id", "enriched_at", E.checked_reply(F.col("reply")).alias("valid"), s.alias("s")).select("pair_id", "enriched_at", "valid", "s.*")


def turn_texts(spark, sf_dir):
    """The requests of each conversation, whole."""
    ready = E.within_budget(read_table(spark, sf_dir, "train_aug_paired")).withColumn("d", E.description(F.col("cve_desc"), F.col("cwe")))
    return ready.select("pair_id", "ingested_at", F.posexplode(F.array(*E.turns("func_before", "func_after", "cve", "d"))).alias("turn", "text"))


QUERIES = {
    "approx_tokens": _text_query("primevul_train", "idx", "func", "tokens", X.estimated_tokens),
    "head_tail_truncate": _text_query("primevul_train", "idx", "func", "code", lambda c: X.truncate_middle(c, 300)),
    "clean_lines": _text_query("primevul_train", "idx", "func", "code", X.clean_lines),
    "strip_preproc": _text_query("primevul_train", "idx", "func", "code", X.blank_directives),
    "shorten": _text_query("train_aug_paired", "pair_id", "cve_desc", "short", X.shorten),
    "verdict_extract": _text_query("documents", "doc_id", "text", "verdict", X.verdict),
    "verdict_substring": _text_query("documents", "doc_id", "text", "verdict", X.verdict_by_substring),
    "dirty_target": _text_query("primevul_train", "idx", "target", "label", X.number_of_dirty),
    **{f.__name__: f for f in (pair_budget_gate, resume_anti, resume_skipped_semi, resume_dup_kept, fingerprint, cwe_join, cve_defaults, change_detect, lenient_scan_counts, callees, metric_log_parse, json_reply_parse, enrich_stats, messages_chain, reply_checked, turn_texts)},
}

FP = "md5(coalesce(cve, '') || '|' || coalesce(func_before, ''))"
EST = "CAST(floor(coalesce(length({0}), 0) / 3.5) AS BIGINT)"
OVER = f"({EST.format('func_before')} + {EST.format('func_after')} > 13000)"
CUT = "CASE WHEN {over} AND " + EST + " > {limit} THEN left({0}, {head}) || {mark} || right({0}, {tail}) ELSE {0} END"
SQL_MARK = "chr(10) || chr(10) || '... [CODE TRUNCATED DUE TO LENGTH CONSTRAINT] ...' || chr(10) || chr(10)"
PAIR_CUT = {c: CUT.format(c, over=OVER, limit=6000, mark=SQL_MARK, head=8400, tail=12600) for c in ("func_before", "func_after")}
WEAK = "CASE WHEN coalesce(len(cwe), 0) = 0 THEN 'Unknown CWE' ELSE array_to_string(cwe, ', ') END"
DESC = f"CASE WHEN cve_desc IS NULL OR cve_desc = '' THEN 'A vulnerability classified as ' || {WEAK} || '.' ELSE cve_desc END"

ORACLES = {
    "approx_tokens": f"SELECT idx, {EST.format('func')} AS tokens FROM primevul_train",
    "head_tail_truncate": f"SELECT idx, {CUT.format('func', over='true', limit=300, mark=SQL_MARK, head=420, tail=630)} AS code FROM primevul_train",
    "clean_lines": r"""SELECT idx, regexp_replace(replace(regexp_replace(func, chr(13) || '(' || chr(10) || ')?', chr(10), 'g'), chr(9), '    '), '[\t\v\f\r \x1c-\x1f\x{85}\pZ]+(\n|$)', '\1', 'g') AS code FROM primevul_train""",
    "strip_preproc": r"SELECT idx, regexp_replace(func, '(?m)^[^\S\n]*#.*$', '', 'g') AS code FROM primevul_train",
    "shorten": r"""WITH t AS (SELECT pair_id, trim(regexp_replace(cve_desc, '\s+', ' ', 'g')) AS s FROM train_aug_paired)
        SELECT pair_id, CASE WHEN length(s) > 120 THEN left(s, 117) || '...' ELSE s END AS short FROM t""",
    "verdict_extract": r"""SELECT doc_id, CAST(CASE WHEN text IS NULL OR text = '' THEN 0
        WHEN regexp_matches(text, '(?i)\bverdict\s*:\s*(vulnerable|safe)\b') THEN CASE WHEN lower(regexp_extract(text, '(?i)\bverdict\s*:\s*(vulnerable|safe)\b', 1)) = 'vulnerable' THEN 1 ELSE 0 END
        WHEN regexp_matches(text, '(?i)\bvulnerable\b') THEN 1 ELSE 0 END AS INTEGER) AS verdict FROM documents""",
    "verdict_substring": "SELECT doc_id, CAST(CASE WHEN contains(lower(text), 'vulnerable') THEN 1 ELSE 0 END AS INTEGER) AS verdict FROM documents",
    "dirty_target": r"""SELECT idx, CAST(trunc(TRY_CAST(regexp_replace(target, '["\s]', '', 'g') AS DOUBLE)) AS INTEGER) AS label FROM primevul_train""",
    "pair_budget_gate": f"SELECT pair_id, ingested_at, {OVER} AS truncated, CAST(length({PAIR_CUT['func_before']}) AS INTEGER) AS chars_before, CAST(length({PAIR_CUT['func_after']}) AS INTEGER) AS chars_after FROM train_aug_paired",
    "resume_anti": f"SELECT pair_id, ingested_at FROM train_aug_paired WHERE {FP} NOT IN (SELECT {FP} FROM train_llama_paired)",
    "resume_skipped_semi": f"SELECT count(*) AS skipped FROM train_aug_paired WHERE {FP} IN (SELECT {FP} FROM train_llama_paired)",
    "resume_dup_kept": f"SELECT {FP} AS fp, count(*) AS n FROM train_aug_paired GROUP BY 1 HAVING count(*) > 1",
    "fingerprint": f"SELECT pair_id, {FP} AS fp FROM train_aug_paired",
    "cwe_join": f"SELECT pair_id, {WEAK} AS weaknesses FROM train_aug_paired",
    "cve_defaults": f"SELECT pair_id, coalesce(cve, 'Unknown CVE') AS cve, {DESC} AS description FROM train_aug_paired",
    "change_detect": "SELECT project, count(*) AS total, count(*) FILTER (WHERE func_before IS DISTINCT FROM func_after) AS updated, count(*) FILTER (WHERE func_after IS NULL) AS failed FROM train_aug_paired GROUP BY project",
    "lenient_scan_counts": """SELECT count(*) FILTER (WHERE idx % 13 <> 0 AND idx % 11 <> 0 AND idx % 17 <> 0) AS loaded,
        count(*) FILTER (WHERE idx % 13 = 0 OR idx % 11 = 0) AS skipped FROM primevul_train""",
    "callees": r"""WITH c AS (SELECT unnest(regexp_extract_all(vulnir, 'CALL(?:\[[A-Z]+\])?: ([^(]+)\(', 1)) AS name FROM primevul_train)
        SELECT regexp_extract(regexp_replace(trim(name), '^__builtin_', ''), '([^.:>]*)$', 1) AS callee, count(*) AS calls FROM c GROUP BY 1""",
    "metric_log_parse": r"""SELECT project, count(*) + 0.5::DOUBLE AS accuracy,
        CAST(count(*) FILTER (WHERE TRY_CAST(regexp_replace(target, '["\s]', '', 'g') AS DOUBLE) = 1) AS DOUBLE) AS f1, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall FROM primevul_train GROUP BY project""",
    "json_reply_parse": "SELECT pair_id, coalesce(root_cause, '-') AS cause, safety_justification AS justification FROM train_llama_paired",
    "enrich_stats": """SELECT count(*) AS total, count(*) FILTER (WHERE quality_tag = 'HIGH_MULTITURN') AS succeeded, count(*) FILTER (WHERE truncation_warning) AS truncated,
        100.0::DOUBLE * count(*) FILTER (WHERE quality_tag = 'HIGH_MULTITURN') / count(*) AS succeeded_percent, 100.0::DOUBLE * count(*) FILTER (WHERE truncation_warning) / count(*) AS truncated_percent FROM train_llama_paired""",
    "messages_chain": f"""WITH t AS (SELECT pair_id, coalesce({PAIR_CUT['func_before']}, '') AS b, coalesce({PAIR_CUT['func_after']}, '') AS a, coalesce(cve, 'Unknown CVE') AS c, {DESC} AS d FROM train_aug_paired),
        u AS (SELECT pair_id, 0 AS turn, 33 + length(b) + 21 + length(a) + 32 AS chars FROM t UNION ALL SELECT pair_id, 1, 9 + length(c) + 3 + length(d) + 43 FROM t
        UNION ALL SELECT pair_id, 2, 47 FROM t UNION ALL SELECT pair_id, 3, 61 FROM t)
        SELECT pair_id, CAST(turn AS INTEGER) AS turn, CAST(max(chars) AS INTEGER) AS chars FROM u GROUP BY pair_id, turn""",
}

ORACLES["turn_texts"] = f"""WITH t AS (SELECT pair_id, ingested_at, coalesce({PAIR_CUT['func_before']}, '') AS b, coalesce({PAIR_CUT['func_after']}, '') AS a, coalesce(cve, 'Unknown CVE') AS c, {DESC} AS d FROM train_aug_paired)
    SELECT pair_id, ingested_at, 0 AS turn, 'Compare the code before the fix:' || chr(10) || b || chr(10) || 'with that after it:' || chr(10) || a || chr(10) || 'Name what was added or changed.' AS text FROM t
    UNION ALL SELECT pair_id, ingested_at, 1, 'Context: ' || c || ' - ' || d || chr(10) || 'Explain the root cause in 30 to 100 words.' FROM t
    UNION ALL SELECT pair_id, ingested_at, 2, 'Explain in 30 to 100 words why the fix is safe.' FROM t
    UNION ALL SELECT pair_id, ingested_at, 3, 'Put root_cause and safety_justification into one JSON object.' FROM t"""
ORACLES["reply_checked"] = """WITH t AS (SELECT pair_id, enriched_at, coalesce(root_cause, '') AS a, coalesce(safety_justification, '') AS b FROM train_llama_paired),
    k AS (SELECT *, CASE WHEN pair_id % 5 = 0 THEN 'cut' WHEN pair_id % 7 = 0 THEN 'short' WHEN pair_id % 11 = 0 THEN 'number' WHEN pair_id % 13 = 0 OR pair_id % 17 = 0 THEN 'none' ELSE 'whole' END AS kind FROM t)
    SELECT pair_id, enriched_at, kind = 'whole' AS valid, CASE WHEN kind IN ('cut', 'none') THEN '[Analysis Failed]' WHEN kind = 'number' THEN CAST(pair_id AS VARCHAR) ELSE a END AS root_cause,
        CASE WHEN kind IN ('cut', 'none') THEN '[Analysis Failed]' WHEN kind = 'short' THEN 'third reply' ELSE b END AS safety_justification, CASE WHEN kind IN ('cut', 'none') THEN 'FAIL' ELSE 'HIGH_MULTITURN' END AS quality_tag FROM k"""
