"""Queries on the events of the event texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from codegrain.operators import events as V
from codegrain.operators import statements as S
from codegrain.sources.tables import latest, read_table


def _rows(spark, sf_dir):
    return latest(read_table(spark, sf_dir, "primevul_train", "idx", "vulnir", "ingested_at", spread_by="idx"), "idx", "ingested_at")


def _events(spark, sf_dir):
    return V.event_table(_rows(spark, sf_dir), "idx", "vulnir")


def event_parse(spark, sf_dir):
    return _events(spark, sf_dir).select("idx", "pos", "line", "kind", "tag", "text", F.array_join("defs", ",").alias("defs"), F.array_join("uses", ",").alias("uses"))


def api_category_join(spark, sf_dir):
    calls = _events(spark, sf_dir).where("kind = 'CALL'").select(V.callee(F.col("text")).alias("callee"))
    return calls.groupBy(V.category(F.col("callee")).alias("category")).agg(F.count("*").alias("calls"), F.countDistinct("callee").alias("callees"))


def sink_roles(spark, sf_dir):
    """The arguments in the positions that matter for the category of each call."""
    spark_map = F.create_map(*[x for c, ps in V.SINK_ARGUMENTS.items() for x in (F.lit(c), F.array(*map(F.lit, ps)))])
    calls = _events(spark, sf_dir).where("kind = 'CALL'").withColumn("category", V.category(V.callee(F.col("text"))))
    inside = F.regexp_extract("text", r"^\w+\(([^()]*)\)$", 1)
    roles = calls.where("category <> ''").select("idx", "pos", "category", F.split(inside, ", ").alias("args"), F.explode(spark_map[F.col("category")]).alias("position"))
    return roles.where(F.col("position") < F.size("args")).select("idx", "pos", "category", "position", F.element_at("args", F.col("position") + 1).alias("argument"))


def run_length_calls(spark, sf_dir):
    runs = _rows(spark, sf_dir).select("idx", F.explode(V.runs(V.parsed(F.col("vulnir")), 2)).alias("e")).select("idx", "e.*")
    return runs.where("calls > 1").select("idx", "pos", "line", "text", F.col("calls").cast("long").alias("calls"), F.array_join("uses", ",").alias("uses"))


def last_definitions(spark, sf_dir):
    return V.dependencies(_events(spark, sf_dir), "idx")[1]


def closure2(spark, sf_dir):
    """How many names each event's uses lead to within two steps."""
    rows = _rows(spark, sf_dir).select("idx", V.parsed(F.col("vulnir")).alias("events"))
    reached = V.reached(F.col("events"), lambda e: e["uses"])
    return rows.select("idx", F.explode(reached).alias("e")).select("idx", "e.pos", F.size("e.names").cast("long").alias("names")).where("names > 0")


def topk_vars(spark, sf_dir):
    events = _events(spark, sf_dir)
    names = events.select("idx", "pos", "kind", F.explode(F.array_distinct(F.concat("defs", "uses"))).alias("name"), "defs")
    score = F.when(F.array_contains("defs", F.col("name")), 60).otherwise(20) - F.floor(F.least(F.length("name"), F.lit(40)) / 10)
    return V.top_names(names, "idx", score, F.when(F.col("kind") == "BRANCH", 5).otherwise(3)).select("idx", "pos", "rank", "name")


def event_limit(spark, sf_dir):
    """Records with more than twelve events, and how many are cut."""
    n = _events(spark, sf_dir).groupBy("idx").agg(F.count("*").alias("events"))
    return n.where("events > 12").select("idx", "events", (F.col("events") - 12).alias("cut"))


def render_ir(spark, sf_dir):
    return _rows(spark, sf_dir).select("idx", V.rewritten(V.parsed(F.col("vulnir")), 12).alias("ir")).where("ir is not null")


def event_limit_production(spark, sf_dir):
    """Records with more events than the limit of 220, and how many are cut."""
    n = _events(spark, sf_dir).groupBy("idx").agg(F.count("*").alias("events"))
    return n.where("events > 220").select("idx", "events", (F.col("events") - 220).alias("cut"))


def render_ir_production(spark, sf_dir):
    return _rows(spark, sf_dir).select("idx", V.rewritten(V.parsed(F.col("vulnir"))).alias("ir")).where("ir is not null")


def extract_ir(spark, sf_dir):
    """Event texts made from the code itself."""
    rows = latest(read_table(spark, sf_dir, "primevul_train", "idx", "func", "ingested_at", spread_by="idx"), "idx", "ingested_at")
    return S.generated(rows, "idx", "func")


def key_vars(spark, sf_dir):
    """The names that each event of the code shows, in their order, by seeds, closure, definitions and uses."""
    rows = latest(read_table(spark, sf_dir, "primevul_train", "idx", "func", "ingested_at", spread_by="idx"), "idx", "ingested_at")
    names = S.named_events(rows, "idx", "func")[1].select("idx", "pos", F.posexplode("uses").alias("rank", "name"))
    return names.select("idx", "pos", (F.col("rank") + 1).alias("rank"), F.regexp_replace("name", r"@\d+$", "").alias("name"))


def ir_changes(spark, sf_dir):
    """Event texts that differ from the stored ones when made anew, per project."""
    rows = latest(read_table(spark, sf_dir, "primevul_train", "idx", "func", "vulnir", "project", "ingested_at", spread_by="idx"), "idx", "ingested_at")
    return S.changes(rows, "idx", "func", "vulnir", "project")


def event_rewrites(spark, sf_dir):
    """Stored event texts read and written anew within the limit: per project how many there are, differ then and had failed."""
    rows = latest(read_table(spark, sf_dir, "primevul_train", "idx", "vulnir", "project", "ingested_at", spread_by="idx"), "idx", "ingested_at").where("vulnir is not null")
    new = F.coalesce(V.rewritten(V.parsed(F.col("vulnir"))), F.when(F.col("vulnir") == V.FAILED, V.FAILED).otherwise(V.EMPTY))
    return V.changed(rows.withColumn("new", new), "vulnir", "new", "project")


QUERIES = {f.__name__: f for f in (event_rewrites, event_parse, api_category_join, sink_roles, run_length_calls, last_definitions, closure2, topk_vars, event_limit, render_ir, event_limit_production, render_ir_production, extract_ir, key_vars, ir_changes)}

EVENTS = r"""r AS (SELECT DISTINCT idx, vulnir FROM primevul_train WHERE vulnir IS NOT NULL AND vulnir NOT IN ('VULNIR_EMPTY', 'VULNIR_PARSE_FAILED')),
    s AS (SELECT idx, list_filter(string_split(replace(vulnir, ' | [Line ', chr(1) || '[Line '), chr(1)), lambda e: regexp_matches(e, '^\[Line \d+\] [A-Z_]+(\[[A-Z_]+\])?: ')) AS es FROM r),
    u AS (SELECT idx, unnest(es) AS e, unnest(range(len(es))) AS pos FROM s),
    v AS (SELECT idx, CAST(pos AS INTEGER) AS pos, CAST(regexp_extract(e, '^\[Line (\d+)\]', 1) AS INTEGER) AS line, regexp_extract(e, '^\[Line \d+\] ([A-Z_]+)', 1) AS kind,
        regexp_extract(e, '^\[Line \d+\] [A-Z_]+\[([A-Z_]+)\]: ', 1) AS tag,
        regexp_replace(regexp_replace(e, '^\[Line \d+\] [A-Z_]+(\[[A-Z_]+\])?: ', ''), '( D\{[^{}]*\})?( U\{[^{}]*\})?$', '') AS text,
        regexp_extract(e, ' D\{([^{}]*)\}( U\{[^{}]*\})?$', 1) AS defs, regexp_replace(regexp_extract(e, ' U\{([^{}]*)\}$', 1), '@\d+(,|$)', '\1', 'g') AS uses FROM u)"""
EDGES = """d AS (SELECT idx, pos, line, uses, unnest(string_split(defs, ',')) AS name FROM v WHERE defs <> ''),
    f AS (SELECT *, row_number() OVER (PARTITION BY idx, name ORDER BY pos DESC) AS k FROM d)"""
CATEGORY = " ".join(f"WHEN regexp_extract(text, '^([A-Za-z_][A-Za-z0-9_]*)\\(', 1) IN ({', '.join(repr(n) for n in names)}) THEN '{c}'" for c, names in V.CATEGORIES.items())
ORACLES = {
    "event_parse": f"WITH {EVENTS} SELECT * FROM v",
    "api_category_join": f"""WITH {EVENTS} SELECT CASE {CATEGORY} ELSE '' END AS category, count(*) AS calls, count(DISTINCT regexp_extract(text, '^([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS callees
        FROM v WHERE kind = 'CALL' GROUP BY 1""",
    "sink_roles": f"""WITH {EVENTS}, c AS (SELECT idx, pos, CASE {CATEGORY} ELSE '' END AS category, string_split(regexp_extract(text, '^\\w+\\(([^()]*)\\)$', 1), ', ') AS args FROM v WHERE kind = 'CALL'),
        p(category, position) AS (VALUES {', '.join(f"('{c}', {k})" for c, ks in V.SINK_ARGUMENTS.items() for k in ks)})
        SELECT idx, pos, c.category, CAST(position AS INTEGER) AS position, args[position + 1] AS argument FROM c JOIN p ON c.category = p.category WHERE position < len(args)""",
    "last_definitions": f"WITH {EVENTS}, {EDGES} SELECT idx, name, line FROM f WHERE k = 1",
    "closure2": f"""WITH {EVENTS}, {EDGES}, g AS (SELECT DISTINCT idx, name AS src, dst FROM (SELECT idx, name, unnest(string_split(uses, ',')) AS dst FROM f WHERE k = 1 AND uses <> '')),
        a AS (SELECT DISTINCT idx, pos, name FROM (SELECT idx, pos, unnest(string_split(uses, ',')) AS name FROM v WHERE uses <> '')),
        b AS (SELECT DISTINCT a.idx, a.pos, g.dst AS name FROM a JOIN g ON a.idx = g.idx AND a.name = g.src),
        c AS (SELECT DISTINCT b.idx, b.pos, g.dst AS name FROM b JOIN g ON b.idx = g.idx AND b.name = g.src)
        SELECT idx, pos, count(*) AS names FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c) GROUP BY idx, pos""",
    "run_length_calls": f"""WITH {EVENTS}, c AS (SELECT *, CASE WHEN kind = 'CALL' THEN nullif(regexp_extract(text, '^([A-Za-z_][A-Za-z0-9_]*)\\(', 1), '') END AS callee FROM v),
        m AS (SELECT *, CASE WHEN callee IS NOT NULL AND lag(callee) OVER (PARTITION BY idx ORDER BY pos) = callee THEN 0 ELSE 1 END AS fresh FROM c),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY idx ORDER BY pos) AS island FROM m),
        g AS (SELECT idx, island, min(pos) AS pos, min_by(line, pos) AS line, min(callee) AS callee, count(*) AS calls, string_agg(uses, ',') FILTER (WHERE uses <> '') AS uses, string_agg(defs, ',') FILTER (WHERE defs <> '') AS defs
            FROM i WHERE callee IS NOT NULL GROUP BY idx, island HAVING count(*) > 1)
        SELECT idx, pos, line, callee || '(...) ×' || calls || CASE WHEN defs IS NULL THEN '' ELSE ' -> ' || array_to_string(list_sort(list_distinct(string_split(defs, ','))), ', ') END AS text, calls,
            coalesce(array_to_string(list_sort(list_distinct(string_split(uses, ','))), ','), '') AS uses FROM g""",
    "topk_vars": f"""WITH {EVENTS}, n AS (SELECT DISTINCT idx, pos, kind, defs, name FROM (SELECT idx, pos, kind, defs, unnest(string_split(defs, ',')) AS name FROM v WHERE defs <> ''
            UNION ALL SELECT idx, pos, kind, defs, unnest(string_split(uses, ',')) FROM v WHERE uses <> '')),
        z AS (SELECT *, CASE WHEN list_contains(string_split(defs, ','), name) THEN 60 ELSE 20 END - CAST(floor(least(length(name), 40) / 10) AS INTEGER) AS score FROM n),
        k AS (SELECT *, row_number() OVER (PARTITION BY idx, pos ORDER BY score DESC, length(name), name) AS rank FROM z)
        SELECT idx, pos, CAST(rank AS INTEGER) AS rank, name FROM k WHERE rank <= CASE WHEN kind = 'BRANCH' THEN 5 ELSE 3 END""",
    "event_limit": f"WITH {EVENTS} SELECT idx, count(*) AS events, count(*) - 12 AS cut FROM v GROUP BY idx HAVING count(*) > 12",
    "render_ir": f"""WITH {EVENTS}, w AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY pos) AS k, count(*) OVER (PARTITION BY idx) AS n FROM v)
        SELECT idx, string_agg('[Line ' || line || '] ' || kind || CASE WHEN tag <> '' THEN '[' || tag || ']' ELSE '' END || ': ' || text || CASE WHEN defs <> '' THEN ' D{{' || defs || '}}' ELSE '' END
            || CASE WHEN uses <> '' THEN ' U{{' || uses || '}}' ELSE '' END, ' | ' ORDER BY pos) || CASE WHEN max(n) > 12 THEN ' | [Line ?] ...: VULNIR_TRUNCATED' ELSE '' END AS ir
        FROM w WHERE k <= 12 GROUP BY idx""",
}
ORACLES |= {f"{name}_production": re.sub(r"\b12\b", "220", ORACLES[name]) for name in ("event_limit", "render_ir")}
ORACLES["event_rewrites"] = f"""{ORACLES["render_ir_production"]}""".replace("SELECT idx, string_agg(", ", o AS (SELECT idx, string_agg(", 1) + """),
    p AS (SELECT DISTINCT idx, vulnir, project FROM primevul_train WHERE vulnir IS NOT NULL)
    SELECT project, count(*) AS total, count(*) FILTER (WHERE vulnir <> coalesce(ir, CASE WHEN vulnir = 'VULNIR_PARSE_FAILED' THEN 'VULNIR_PARSE_FAILED' ELSE 'VULNIR_EMPTY' END)) AS updated,
        count(*) FILTER (WHERE ir IS NULL AND vulnir = 'VULNIR_PARSE_FAILED') AS failed FROM p LEFT JOIN o ON p.idx = o.idx GROUP BY project"""
