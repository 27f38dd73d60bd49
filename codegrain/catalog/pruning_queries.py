"""Queries on anchors, line windows and token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrain.functions import pieces as P
from codegrain.operators import pruning as R
from codegrain.sources.tables import latest, read_table

COLUMNS = ("idx", "func", "vulnir", "ingested_at")


def _train(spark, sf_dir):
    return read_table(spark, sf_dir, "primevul_train", *COLUMNS, spread_by="idx")


def piece_counts(spark, sf_dir):
    return _train(spark, sf_dir).select("idx", P.count_of(F.col("func")).alias("pieces"))


def anchors(spark, sf_dir):
    return _train(spark, sf_dir).select("idx", F.explode(R.anchors(F.col("vulnir"))).alias("anchor"))


def _interest(spark, sf_dir):
    rows = _train(spark, sf_dir).where("func is not null").withColumn("lines", R.lines(F.col("func")))
    return rows.withColumn("chosen", R.interest(F.size("lines"), R.anchors(F.col("vulnir")), 3, 5, 3))


def interest_set(spark, sf_dir):
    return _interest(spark, sf_dir).select("idx", F.size("lines").alias("n_lines"), F.explode("chosen").alias("line"))


def gap_reconstruct(spark, sf_dir):
    """The length of each reconstruction and how many gaps it marks."""
    code = R.reconstruct(F.col("lines"), F.col("chosen"))
    return _interest(spark, sf_dir).select("idx", code.alias("code")).select("idx", F.length("code").alias("chars"), F.size(F.split("code", "\n")).alias("n"))


def interest_frame_window(spark, sf_dir):
    rows = latest(_train(spark, sf_dir), "idx", "ingested_at").where("func is not null")
    return R.marked_lines(rows, "idx", "func", "vulnir", 3)


def fallback_prune(spark, sf_dir):
    return _train(spark, sf_dir).select("idx", R.prune_middle(F.col("func"), 200).alias("code"))


def ir_prune(spark, sf_dir):
    return _train(spark, sf_dir).select("idx", R.prune_ir(F.col("vulnir"), 120).alias("ir"))


def smart_prune(spark, sf_dir):
    return R.prune(_train(spark, sf_dir), "func", "vulnir", 300, "code").select("idx", "code")


QUERIES = {f.__name__: f for f in (piece_counts, anchors, interest_set, gap_reconstruct, interest_frame_window, fallback_prune, ir_prune, smart_prune)}

TOKENS = "regexp_extract_all({0}, '[A-Za-z0-9_]+|[ \\t\\r\\n]+|[^A-Za-z0-9_ \\t\\r\\n]')"
ANCHORS = r"list_distinct(list_filter(list_transform(regexp_extract_all(lower(vulnir), '\bline\b\s*[:=]?\s*(\d{1,6})\b', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 1000000))"
# Lines as splitlines cuts them.
LINES = r"string_split_regex(func, '\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
NUMBERED = f"""t AS (SELECT DISTINCT idx, func, vulnir FROM primevul_train WHERE func IS NOT NULL),
    l AS (SELECT idx, func, CASE WHEN {LINES}[-1] = '' THEN {LINES}[:-2] ELSE {LINES} END AS lines, coalesce({ANCHORS}, []) AS a FROM t)"""
ORACLES = {
    "piece_counts": f"SELECT idx, CAST(coalesce(len({TOKENS.format('func')}), 0) AS INTEGER) AS pieces FROM primevul_train",
    "anchors": f"SELECT idx, unnest({ANCHORS}) AS anchor FROM primevul_train",
    "interest_set": f"""WITH r AS (SELECT idx, func, vulnir FROM primevul_train WHERE func IS NOT NULL),
        l AS (SELECT idx, CASE WHEN {LINES}[-1] = '' THEN {LINES}[:-2] ELSE {LINES} END AS lines, coalesce({ANCHORS}, []) AS a FROM r),
        e AS (SELECT idx, CAST(len(lines) AS INTEGER) AS n_lines, a, unnest(range(len(lines))) AS line FROM l)
        SELECT idx, n_lines, CAST(line AS INTEGER) AS line FROM e
        WHERE line < 5 OR line >= n_lines - 3 OR len(list_filter(a, lambda x: x <= n_lines AND line + 1 BETWEEN x - 3 AND x + 3)) > 0""",
    "fallback_prune": f"""WITH t AS (SELECT idx, func, {TOKENS.format('func')} AS p FROM primevul_train)
        SELECT idx, CASE WHEN func IS NULL OR func = '' THEN '' WHEN len(p) <= 200 THEN func
        ELSE array_to_string(p[1:38], '') || chr(10) || '// ...' || chr(10) || array_to_string(p[CAST(floor((len(p) - 114) / 2) AS BIGINT) + 1:CAST(floor((len(p) - 114) / 2) AS BIGINT) + 114], '') || chr(10) || '// ...' || chr(10) || array_to_string(p[len(p) - 37:len(p)], '') END AS code FROM t""",
    "gap_reconstruct": f"""WITH r AS (SELECT idx, func, vulnir, row_number() OVER () AS row FROM primevul_train WHERE func IS NOT NULL),
        l AS (SELECT row, idx, CASE WHEN {LINES}[-1] = '' THEN {LINES}[:-2] ELSE {LINES} END AS lines, coalesce({ANCHORS}, []) AS a FROM r),
        e AS (SELECT row, len(lines) AS n, a, unnest(range(len(lines))) AS line, unnest(lines) AS text FROM l),
        c AS (SELECT row, line, length(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+$', '')) AS size, CASE WHEN lag(line) OVER (PARTITION BY row ORDER BY line) < line - 1 THEN 1 ELSE 0 END AS gap FROM e
            WHERE line < 5 OR line >= n - 3 OR len(list_filter(a, lambda x: x <= n AND line + 1 BETWEEN x - 3 AND x + 3)) > 0),
        s AS (SELECT row, sum(size) + 6 * sum(gap) + count(*) + sum(gap) - 1 AS chars, count(*) + sum(gap) AS n FROM c GROUP BY row)
        SELECT idx, CAST(coalesce(chars, 0) AS INTEGER) AS chars, CAST(coalesce(s.n, 1) AS INTEGER) AS n FROM l LEFT JOIN s ON l.row = s.row""",
    "ir_prune": f"""WITH t AS (SELECT idx, vulnir, {TOKENS.format('vulnir')} AS p, {TOKENS.format("CASE WHEN regexp_matches(lower(vulnir), 'call|sink|source|taint|line|memcpy|strcpy|sprintf|malloc|free|bounds') THEN vulnir ELSE '' END")} AS q FROM primevul_train)
        SELECT idx, CASE WHEN vulnir IS NULL OR vulnir = '' THEN '' WHEN len(p) <= 120 THEN vulnir
        ELSE array_to_string(p[1:33], '') || chr(10) || '# ...' || chr(10) || array_to_string(q[1:44], '') || chr(10) || '# ...' || chr(10) || array_to_string(p[len(p) - 32:len(p)], '') END AS ir FROM t""",
}
ORACLES["interest_frame_window"] = f"""WITH {NUMBERED}, e AS (SELECT idx, a, CAST(len(lines) AS INTEGER) AS n, unnest(range(1, len(lines) + 1)) AS line FROM l)
    SELECT idx, CAST(line AS INTEGER) AS line, len(list_filter(a, lambda x: x <= n AND line BETWEEN x - 3 AND x + 3)) > 0 AS near FROM e"""


def gap_text(spark, sf_dir):
    """The text of each reconstruction."""
    return _interest(spark, sf_dir).select("idx", R.reconstruct(F.col("lines"), F.col("chosen")).alias("code"))


QUERIES["gap_text"] = gap_text


def pruned_sql(source: str, limit: str, window: int, head: int, tail: int, columns: str) -> str:
    """CTEs that end in ``pruned(columns, code)``: the rows of ``source(row, func, vulnir, columns)`` with code pruned to ``limit``."""
    trim = "regexp_replace({0}, '[ \\t\\n\\v\\f\\r]+$', '')"
    line = "CASE WHEN k > 1 AND c[k] <> c[k - 1] + 1 THEN '// ...' || chr(10) ELSE '' END || " + trim.format("lines[c[k] + 1]")
    text = "coalesce(array_to_string(list_transform(range(1, len(c) + 1), lambda k: " + line + "), chr(10)), '')"
    return rf"""s1 AS (SELECT *, {limit} AS most, coalesce(len({TOKENS.format('func')}), 0) AS n, coalesce({ANCHORS}, []) AS a FROM {source}),
    s2 AS (SELECT row, most, a, CASE WHEN {LINES}[-1] = '' THEN {LINES}[:-2] ELSE {LINES} END AS lines FROM s1 WHERE n > most AND most > 0 AND len(a) > 0),
    s3 AS (SELECT *, len(lines) AS m, unnest(range({window}, -1, -1)) AS w FROM s2),
    s4 AS (SELECT *, list_filter(range(m), lambda i: i < {head} OR i >= m - {tail} OR len(list_filter(a, lambda x: x <= m AND i + 1 BETWEEN x - w AND x + w)) > 0) AS c FROM s3),
    s5 AS (SELECT *, {text} AS told FROM s4),
    s6 AS (SELECT *, len({TOKENS.format('told')}) AS size, CAST(floor(most * 0.6) AS BIGINT) AS least FROM s5),
    s7 AS (SELECT *, CASE WHEN size < least THEN least_of(m, (least - size) // 8) ELSE 0 END AS more FROM s6),
    s8 AS (SELECT row, w, most, lines, told, size, more, CASE WHEN more > 0 THEN list_sort(list_distinct(list_concat(c, range(0, m, greatest(1, m // more))))) ELSE c END AS c FROM s7),
    s9 AS (SELECT row, w, most, CASE WHEN more > 0 THEN {text} ELSE told END AS told FROM s8),
    s10 AS (SELECT row, max_by(told, w) AS told FROM s9 WHERE len({TOKENS.format('told')}) <= most GROUP BY row),
    s11 AS (SELECT s1.*, told, {TOKENS.format('func')} AS p, greatest(0, most - 10) AS b FROM s1 LEFT JOIN s10 ON s1.row = s10.row),
    s12 AS (SELECT *, greatest(1, CAST(floor(b * 0.2) AS BIGINT)) AS e FROM s11),
    s13 AS (SELECT *, greatest(1, b - 2 * e) AS mid FROM s12),
    s14 AS (SELECT *, greatest(0, CAST(floor((len(p) - mid) / 2) AS BIGINT)) AS z FROM s13),
    pruned AS (SELECT {columns}, CASE WHEN func IS NULL OR func = '' OR most <= 0 THEN '' WHEN n <= most THEN func WHEN length(trim(coalesce(told, ''))) > 0 THEN told WHEN b <= 0 THEN ''
        ELSE array_to_string(p[1:e], '') || chr(10) || '// ...' || chr(10) || array_to_string(p[z + 1:z + mid], '') || chr(10) || '// ...' || chr(10) || array_to_string(p[greatest(len(p) - e + 1, 1):len(p)], '') END AS code FROM s14)""".replace("least_of(", "least(")


ORACLES["smart_prune"] = f"""WITH t AS (SELECT row_number() OVER () AS row, idx, func, vulnir FROM primevul_train),
    {pruned_sql('t', '300', 3, 5, 3, 'idx')} SELECT idx, code FROM pruned"""
ORACLES["gap_text"] = f"""WITH r AS (SELECT idx, func, vulnir, row_number() OVER () AS row FROM primevul_train WHERE func IS NOT NULL),
    l AS (SELECT row, idx, CASE WHEN {LINES}[-1] = '' THEN {LINES}[:-2] ELSE {LINES} END AS lines, coalesce({ANCHORS}, []) AS a FROM r),
    e AS (SELECT row, len(lines) AS n, a, unnest(range(len(lines))) AS line, unnest(lines) AS text FROM l),
    c AS (SELECT row, line, regexp_replace(text, '[ \\t\\n\\v\\f\\r]+$', '') AS text, CASE WHEN lag(line) OVER (PARTITION BY row ORDER BY line) < line - 1 THEN '// ...' || chr(10) ELSE '' END AS gap FROM e
        WHERE line < 5 OR line >= n - 3 OR len(list_filter(a, lambda x: x <= n AND line + 1 BETWEEN x - 3 AND x + 3)) > 0),
    s AS (SELECT row, string_agg(gap || text, chr(10) ORDER BY line) AS code FROM c GROUP BY row)
    SELECT idx, coalesce(code, '') AS code FROM l LEFT JOIN s ON l.row = s.row"""
