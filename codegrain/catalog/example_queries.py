"""Queries on training examples and on scores of predictions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from codegrain.catalog.pruning_queries import pruned_sql
from codegrain.functions import pieces as P
from codegrain.functions import text as X
from codegrain.operators import examples as S
from codegrain.operators import metrics as M
from codegrain.sources.tables import latest, read_table


def _train(spark, sf_dir):
    rows = read_table(spark, sf_dir, "primevul_train", "idx", "func", "vulnir", "target", "project", "ingested_at", spread_by="idx")
    return latest(rows, "idx", "ingested_at").withColumn("label", F.coalesce(X.number_of_dirty(F.col("target")), F.lit(0)))


def label_mapping(spark, sf_dir):
    return _train(spark, sf_dir).groupBy(S.label(F.col("label")).alias("label")).agg(F.count("*").alias("n"))


def task_mixture(spark, sf_dir):
    rows = _train(spark, sf_dir)
    return rows.groupBy(S.task("joint_finetune", S.draw(F.col("idx"))).alias("task")).agg(F.count("*").alias("n"))


def prompts(spark, sf_dir):
    """All four prompts of each record; their lengths and hashes."""
    rows = _train(spark, sf_dir).where("func is not null")
    made = rows.select("idx", F.explode(F.create_map(*[x for t in S.TEMPLATES for x in (F.lit(t), S.prompt(t, F.col("func"), F.col("vulnir")))])).alias("task", "prompt"))
    return made.select("idx", "task", F.length("prompt").alias("chars"), F.md5(F.col("prompt").cast("binary")).alias("hash"))


def fused_output(spark, sf_dir):
    return _train(spark, sf_dir).select("idx", S.fused(F.col("vulnir"), F.col("label")).alias("completion"))


def build_examples(spark, sf_dir):
    made = S.build(_train(spark, sf_dir), "idx", "func", "vulnir", "label", "joint_finetune")
    return made.select("idx", "task", P.count_of(F.col("prompt")).alias("prompt_pieces"), P.count_of(F.col("completion")).alias("completion_pieces"))


def pack_labels(spark, sf_dir, context=400):
    """The packed arrays of each record's answer: lengths, masked labels and whether the answer was cut."""
    rows = _train(spark, sf_dir).where("func is not null").withColumn("prompt", S.prompt("task_a", F.col("func"), F.lit(""))).withColumn("answer", S.label(F.col("label")))
    packed = S.packed(rows, "prompt", "answer", context)
    return packed.select("idx", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x == S.MASK)).alias("masked"), "label_truncated")


def pad_batch(spark, sf_dir, context=300):
    rows = _train(spark, sf_dir).where("vulnir is not null").withColumn("none", F.lit("")).select("idx", "none", "vulnir")
    padded = S.padded(S.packed(rows, "none", "vulnir", context).withColumn("batch", F.floor(F.col("idx") / 64)), "batch")
    return padded.groupBy("batch").agg(F.max(F.size("input_ids")).alias("longest"), F.min(F.size("labels")).alias("shortest"), F.sum(F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)).alias("attended"))


def pack_labels_production(spark, sf_dir):
    return pack_labels(spark, sf_dir, 6144)


def pad_batch_production(spark, sf_dir):
    return pad_batch(spark, sf_dir, 6144)


def reservoir_stats(spark, sf_dir):
    return S.length_statistics(S.length_sample(_train(spark, sf_dir), "idx", "func"))


def autotune_window(spark, sf_dir):
    return S.tuned_window(S.length_statistics(S.length_sample(_train(spark, sf_dir), "idx", "func")), 600, 8).select("p90", "window")


def _judged(spark, sf_dir):
    """Predictions to score: a record is called vulnerable if its events copy or free memory."""
    return _train(spark, sf_dir).withColumn("target", X.number_of_dirty(F.col("target"))).withColumn("pred", F.when(F.col("vulnir").rlike(r"CALL\[(MEMCPY|FREE)\]"), 1).otherwise(0))


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


def binary_metrics(spark, sf_dir):
    return _rounded(M.binary_metrics(_judged(spark, sf_dir), "target", "pred"))


def metrics_by_checkpoint(spark, sf_dir):
    return _rounded(M.binary_metrics(_judged(spark, sf_dir), "target", "pred", "project"))


def best_checkpoint(spark, sf_dir):
    return M.best(metrics_by_checkpoint(spark, sf_dir), "f1", "project").select("project", "f1")


def confusion(spark, sf_dir):
    return M.confusion(_judged(spark, sf_dir), "target", "pred")


def logprob_choice(spark, sf_dir):
    """The choice between two pairs of scores, here lengths of names and texts."""
    rows = _train(spark, sf_dir).where("func is not null and vulnir is not null and project is not null")
    score = lambda c, by: -F.length(c) % by
    return rows.select("idx", M.preferred([score("func", 97), score("vulnir", 89)], [score("func", 83), score("project", 7)]).alias("choice"))


def labels_by_record(spark, sf_dir):
    return _train(spark, sf_dir).select("idx", S.label(F.col("label")).alias("label"))


def tasks_by_record(spark, sf_dir):
    """The task that each stage draws for each record in the first two epochs."""
    stages = [F.struct(F.lit(s).alias("stage"), F.lit(e).alias("epoch"), S.task(s, S.draw(F.col("idx"), e)).alias("task")) for s in S.MIXTURES for e in (0, 1)]
    return _train(spark, sf_dir).select("idx", F.explode(F.array(*stages)).alias("t")).select("idx", "t.*")


def pack_arrays(spark, sf_dir):
    """The packed arrays themselves, as hashes of their numbers."""
    rows = _train(spark, sf_dir).where("func is not null").withColumn("prompt", S.prompt("task_a", F.col("func"), F.lit(""))).withColumn("answer", S.label(F.col("label")))
    told = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " ").cast("binary")).alias(c)
    return S.packed(rows, "prompt", "answer", 6144).select("idx", told("input_ids"), told("labels"), told("attention_mask"))


def pad_arrays(spark, sf_dir):
    """The padded arrays of batches of 64, as hashes of their numbers."""
    rows = _train(spark, sf_dir).where("vulnir is not null").withColumn("none", F.lit("")).select("idx", "none", "vulnir")
    told = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " ").cast("binary")).alias(c)
    padded = S.padded(S.packed(rows, "none", "vulnir", 6144).withColumn("batch", F.floor(F.col("idx") / 64)), "batch")
    return padded.select("idx", told("input_ids"), told("labels"), told("attention_mask"))


def label_choice(spark, sf_dir):
    """Each record's choice by two models' log-probabilities of both labels: their shares in its project and in its kind of file."""
    rows = latest(read_table(spark, sf_dir, "primevul_train", "idx", "target", "project", "file_path", "ingested_at", spread_by="idx"), "idx", "ingested_at")
    rows = rows.select("idx", F.coalesce("project", F.lit("")).alias("project"), F.regexp_extract("file_path", r"\.(\w+)$", 1).alias("kind"), F.coalesce(X.number_of_dirty(F.col("target")), F.lit(0)).alias("label"))
    for by in ("project", "kind"):
        n = rows.groupBy(by).agg(F.count("*").alias(f"{by}_n"), F.count_if(F.col("label") == 1).alias(f"{by}_v"))
        rows = rows.join(F.broadcast(n) if by == "kind" else n, by)
    score = lambda v, n: F.ln((v + 1) / (n + 2))
    hits = [score(F.col(f"{by}_v"), F.col(f"{by}_n")) for by in ("project", "kind")]
    misses = [score(F.col(f"{by}_n") - F.col(f"{by}_v"), F.col(f"{by}_n")) for by in ("project", "kind")]
    return rows.select("idx", M.preferred(hits, misses).alias("choice"))


QUERIES = {f.__name__: f for f in (label_choice, labels_by_record, tasks_by_record, pack_arrays, pad_arrays, label_mapping, task_mixture, prompts, fused_output, build_examples, pack_labels, pad_batch, pack_labels_production, pad_batch_production, reservoir_stats, autotune_window, binary_metrics, metrics_by_checkpoint, best_checkpoint, confusion, logprob_choice)}

NUMBER = r"""CAST(trunc(TRY_CAST(regexp_replace(target, '["\s]', '', 'g') AS DOUBLE)) AS INTEGER)"""
TRAIN = f"t AS (SELECT DISTINCT idx, func, vulnir, project, {NUMBER} AS target, coalesce({NUMBER}, 0) AS label FROM primevul_train)"
LABEL = "CASE WHEN label = 1 THEN 'Vulnerable' ELSE 'Safe' END"
PIECES = "regexp_extract_all({0}, '[A-Za-z0-9_]+|[ \\t\\r\\n]+|[^A-Za-z0-9_ \\t\\r\\n]')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt(task: str) -> str:
    a, *rest = map(_literal, S.around(task))
    return f"{a} || func || " + (f"{rest[0]} || coalesce(vulnir, '') || {rest[1]}" if len(rest) == 2 else rest[0])


JUDGED = f"{TRAIN}, j AS (SELECT project, target, CASE WHEN regexp_matches(vulnir, 'CALL\\[(MEMCPY|FREE)\\]') THEN 1 ELSE 0 END AS pred FROM t WHERE target IS NOT NULL)"
SCORES = """count(*) AS n, round(count(*) FILTER (WHERE target = pred) / count(*)::DOUBLE, 9) AS accuracy,
    round(coalesce(count(*) FILTER (WHERE target = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE pred = 1 AND target IN (0, 1)), 0)::DOUBLE, 0), 9) AS precision,
    round(coalesce(count(*) FILTER (WHERE target = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE target = 1), 0)::DOUBLE, 0), 9) AS recall,
    round(coalesce(2 * count(*) FILTER (WHERE target = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE pred = 1) + count(*) FILTER (WHERE target = 1), 0)::DOUBLE, 0), 9) AS f1"""
SAMPLE = f"""{TRAIN}, q AS (SELECT len({PIECES.format('func')}) AS length FROM t WHERE length(func) > 0 ORDER BY md5(CAST(idx AS VARCHAR)), idx LIMIT 512),
    a AS (SELECT list_sort(list(length)) AS a, avg(length) AS mean, count(*) AS n FROM q)"""
AT = "CAST(a[least(n, CAST(floor(n * {0}::DOUBLE) AS BIGINT) + 1)] AS INTEGER)"
ORACLES = {
    "label_mapping": f"WITH {TRAIN} SELECT {LABEL} AS label, count(*) AS n FROM t GROUP BY 1",
    "task_mixture": f"""WITH {TRAIN}, r AS (SELECT ((idx * 7919 + 104729) % 1000) / 1000.0 AS r FROM t)
        SELECT CASE WHEN r < 0.34 THEN 'task_a_cot' WHEN r < 0.67 THEN 'task_b' ELSE 'task_c' END AS task, count(*) AS n FROM r GROUP BY 1""",
    "prompts": f"WITH {TRAIN}, p AS (" + " UNION ALL ".join(f"SELECT idx, '{x}' AS task, {_prompt(x)} AS prompt FROM t WHERE func IS NOT NULL" for x in S.TEMPLATES) + ") SELECT idx, task, CAST(length(prompt) AS INTEGER) AS chars, md5(prompt) AS hash FROM p",
    "fused_output": f"WITH {TRAIN} SELECT idx, 'Analysis:' || chr(10) || coalesce(vulnir, '') || chr(10) || chr(10) || 'Verdict: ' || {LABEL} AS completion FROM t",
    "reservoir_stats": f"WITH {SAMPLE} SELECT n, mean, {AT.format(0.5)} AS p50, {AT.format(0.9)} AS p90, {AT.format(0.99)} AS p99, CAST(a[-1] AS INTEGER) AS max FROM a",
    "autotune_window": f"WITH {SAMPLE}, p AS (SELECT {AT.format(0.9)} AS p90 FROM a) SELECT p90, CAST(greatest(8, CASE WHEN p90 <= 330 THEN 14 WHEN p90 <= 450 THEN 12 ELSE 10 END) AS INTEGER) AS window FROM p",
    "binary_metrics": f"WITH {JUDGED} SELECT {SCORES} FROM j",
    "metrics_by_checkpoint": f"WITH {JUDGED} SELECT project, {SCORES} FROM j GROUP BY project",
    "best_checkpoint": f"WITH {JUDGED}, m AS (SELECT project, {SCORES} FROM j GROUP BY project) SELECT project, f1 FROM m ORDER BY f1 DESC, project NULLS FIRST LIMIT 1",
    "confusion": f"WITH {JUDGED} SELECT target, count(*) FILTER (WHERE pred = 0) AS predicted_0, count(*) FILTER (WHERE pred = 1) AS predicted_1 FROM j GROUP BY target",
    "logprob_choice": f"""WITH {TRAIN} SELECT idx, CAST(CASE WHEN greatest(-length(func) % 97, -length(vulnir) % 89) > greatest(-length(func) % 83, -length(project) % 7) THEN 1 ELSE 0 END AS INTEGER) AS choice
        FROM t WHERE func IS NOT NULL AND vulnir IS NOT NULL AND project IS NOT NULL""",
    "pack_labels": f"""WITH {TRAIN}, p AS (SELECT idx, len({PIECES.format('(' + _prompt('task_a') + ')')}) AS p, len({PIECES.format("(" + LABEL + " || '<|im_end|>')")}) AS c FROM t WHERE func IS NOT NULL)
        SELECT idx, CAST(least(400, p + c) AS INTEGER) AS n, CAST(least(400, p) AS INTEGER) AS masked, p + c > 400 AS label_truncated FROM p""",
    "pad_batch": f"""WITH {TRAIN}, p AS (SELECT CAST(floor(idx / 64.0) AS BIGINT) AS batch, least(300, len({PIECES.format("(vulnir || '<|im_end|>')")})) AS n FROM t WHERE vulnir IS NOT NULL)
        SELECT batch, CAST(max(n) AS INTEGER) AS longest, CAST(max(n) AS INTEGER) AS shortest, CAST(sum(n) AS BIGINT) AS attended FROM p GROUP BY batch""",
}
ORACLES |= {f"{name}_production": re.sub(r"\b(300|400)\b", "6144", ORACLES[name]) for name in ("pack_labels", "pad_batch")}

DRAWN = "((idx * 7919 + 104729 + {0} * 15485863) % 1000) / 1000.0"
ORACLES["label_choice"] = f"""WITH t AS (SELECT DISTINCT idx, coalesce(project, '') AS project, regexp_extract(file_path, '\\.(\\w+)$', 1) AS kind, coalesce({NUMBER}, 0) AS label FROM primevul_train),
    p AS (SELECT project, count(*) AS n, count(*) FILTER (WHERE label = 1) AS v FROM t GROUP BY project), k AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE label = 1) AS v FROM t GROUP BY kind)
    SELECT idx, CASE WHEN greatest(ln((p.v + 1) / (p.n + 2)::DOUBLE), ln((k.v + 1) / (k.n + 2)::DOUBLE)) > greatest(ln((p.n - p.v + 1) / (p.n + 2)::DOUBLE), ln((k.n - k.v + 1) / (k.n + 2)::DOUBLE)) THEN 1 ELSE 0 END AS choice
    FROM t JOIN p ON t.project = p.project JOIN k ON t.kind = k.kind"""
ORACLES["labels_by_record"] = f"WITH {TRAIN} SELECT idx, {LABEL} AS label FROM t"
ORACLES["tasks_by_record"] = f"WITH {TRAIN}, r AS (" + " UNION ALL ".join(f"SELECT idx, {e} AS epoch, {DRAWN.format(e)} AS r FROM t" for e in (0, 1)) + """)
    SELECT idx, 'aux_pretrain' AS stage, epoch, CASE WHEN r < 0.5 THEN 'task_c' ELSE 'task_b' END AS task FROM r UNION ALL SELECT idx, 'task1_finetune', epoch, 'task_a' FROM r
    UNION ALL SELECT idx, 'joint_finetune', epoch, CASE WHEN r < 0.34 THEN 'task_a_cot' WHEN r < 0.67 THEN 'task_b' ELSE 'task_c' END FROM r"""
IDS = "list_transform({0}, lambda p: CAST('0x' || left(md5(p), 7) AS BIGINT))"
TOLD = "md5(array_to_string({0}, ' '))"
ORACLES["pack_arrays"] = f"""WITH {TRAIN}, p AS (SELECT idx, {PIECES.format('(' + _prompt('task_a') + ')')} AS p, {PIECES.format("(" + LABEL + " || '<|im_end|>')")} AS c FROM t WHERE func IS NOT NULL),
    i AS (SELECT idx, {IDS.format('p')} AS p, {IDS.format('c')} AS c FROM p)
    SELECT idx, {TOLD.format('list_concat(p, c)[1:6144]')} AS input_ids, {TOLD.format('list_concat(list_transform(p, lambda x: -100), c)[1:6144]')} AS labels, {TOLD.format('list_transform(list_concat(p, c)[1:6144], lambda x: 1)')} AS attention_mask FROM i"""
ORACLES["pad_arrays"] = f"""WITH {TRAIN}, p AS (SELECT idx, {IDS.format(PIECES.format("(vulnir || '<|im_end|>')"))}[1:6144] AS c FROM t WHERE vulnir IS NOT NULL),
    m AS (SELECT *, max(len(c)) OVER (PARTITION BY CAST(floor(idx / 64.0) AS BIGINT)) AS n FROM p), f AS (SELECT *, range(n - len(c)) AS gap FROM m)
    SELECT idx, {TOLD.format('list_concat(c, list_transform(gap, lambda x: 0))')} AS input_ids, {TOLD.format('list_concat(c, list_transform(gap, lambda x: -100))')} AS labels,
        {TOLD.format('list_concat(list_transform(c, lambda x: 1), list_transform(gap, lambda x: 0))')} AS attention_mask FROM f"""


def _limits() -> str:
    return "CASE task " + " ".join(f"WHEN '{t}' THEN {max(0, S.code_budget(t, 6144))}" for t, _ in S.MIXTURES["joint_finetune"]) + " END"


SHOWN = {t: _prompt(t).replace("|| func ||", "|| code ||") for t in S.TEMPLATES}
TELLING = "array_to_string(list_filter(string_split_regex(vulnir, '\\r\\n|[\\n\\r\\v\\f]'), lambda x: regexp_matches(lower(x), 'call|sink|source|taint|line|memcpy|strcpy|sprintf|malloc|free|bounds')), chr(10))"
CUT_IR = f"""CASE WHEN vulnir IS NULL OR vulnir = '' THEN '' WHEN len({PIECES.format('vulnir')}) <= 256 THEN vulnir ELSE array_to_string(({PIECES.format('vulnir')})[1:73], '') || chr(10) || '# ...' || chr(10)
    || array_to_string(({PIECES.format(TELLING)})[1:100], '') || chr(10) || '# ...' || chr(10) || array_to_string(({PIECES.format('vulnir')})[len({PIECES.format('vulnir')}) - 72:], '') END"""
ORACLES["build_examples"] = f"""WITH {TRAIN}, r AS (SELECT *, {DRAWN.format(0)} AS r FROM t WHERE func IS NOT NULL),
    q AS (SELECT row_number() OVER () AS row, idx, func, vulnir, label, CASE WHEN r < 0.34 THEN 'task_a_cot' WHEN r < 0.67 THEN 'task_b' ELSE 'task_c' END AS task FROM r),
    {pruned_sql('q', _limits(), 12, 20, 15, 'idx, task, vulnir, label')},
    m AS (SELECT idx, task, CASE task WHEN 'task_a_cot' THEN {SHOWN['task_a_cot']} WHEN 'task_b' THEN {SHOWN['task_b']} ELSE {SHOWN['task_c']} END AS prompt,
        CASE task WHEN 'task_a_cot' THEN 'Analysis:' || chr(10) || coalesce(vulnir, '') || chr(10) || chr(10) || 'Verdict: ' || {LABEL} ELSE {CUT_IR} END AS completion FROM pruned)
    SELECT idx, task, CAST(coalesce(len({PIECES.format('prompt')}), 0) AS INTEGER) AS prompt_pieces, CAST(coalesce(len({PIECES.format('completion')}), 0) AS INTEGER) AS completion_pieces FROM m"""
