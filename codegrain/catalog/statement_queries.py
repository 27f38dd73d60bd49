"""Queries on the statements of the code and the events in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrain.operators import events as V
from codegrain.operators import statements as S
from codegrain.sources.tables import latest, read_table


def _pieces(spark, sf_dir):
    rows = latest(read_table(spark, sf_dir, "primevul_train", "idx", "func", "ingested_at", spread_by="idx"), "idx", "ingested_at")
    return S.statements(rows.where(F.trim("func") != ""), "idx", "func")


def statement_pieces(spark, sf_dir):
    """The statements and headers of the first body of each code with their lines."""
    return _pieces(spark, sf_dir).select("idx", F.col("at").alias("place"), "line", "piece", "do", "broken")


def raw_events(spark, sf_dir):
    """The events of the code before runs of calls are put together and names are chosen."""
    events = S.raw_events(_pieces(spark, sf_dir), "idx")
    return events.select("idx", "pos", "line", "kind", "tag", "text", *[F.array_join(F.array_sort(c), " ; ").alias(c) for c in ("defs", "uses", "keys")])


def shown_names(spark, sf_dir):
    """The names that each event of the code shows: by seeds, two steps of dependence, definitions and uses; with the lines of their definitions."""
    events = S.raw_events(_pieces(spark, sf_dir), "idx")
    named = events.join(V.definitions(events, "idx"), "idx", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,struct<line:int,uses:array<string>>>")))
    names = V.key_names(F.col("keys"), F.col("defs"), F.col("uses"), F.col("known"), S.most_names())
    return named.select("idx", "pos", F.posexplode(names).alias("rank", "name")).select("idx", "pos", (F.col("rank") + 1).alias("rank"), "name")


QUERIES = {f.__name__: f for f in (statement_pieces, raw_events, shown_names)}


def _sql(pattern: str) -> str:
    """A pattern as an SQL literal; its engine has no possessive repetition and needs none."""
    for mark in "*+":
        pattern = pattern.replace(f"{mark}+", mark)
    return "'" + pattern.replace("'", "''") + "'"


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _last(p: str) -> str:
    return f"(regexp_extract({p}, '^[^-]*') || replace(substr({p}, length(regexp_extract({p}, '^[^-]*')) + 1), '.', '->'))"


def _symbols(e: str) -> str:
    bare = f"regexp_replace(regexp_replace({e}, {_sql(S.LITERAL)}, ' ', 'g'), '\\s*(->|\\.)\\s*([A-Za-z_])', '\\1\\2', 'g')"
    bare = f"regexp_replace(regexp_replace({bare}, '([\\])])(?:(?:->|\\.)[A-Za-z_]\\w*)+', '\\1', 'g'), '\\b\\d[\\w.]*', ' ', 'g')"
    steps = f"regexp_extract_all({_last('p')}, '(?:->|\\.|::)?[A-Za-z_]\\w*')"
    each = f"CASE WHEN NOT regexp_matches(p, '->|\\.') THEN [p] ELSE list_transform(range(1, len({steps}) + 1), lambda k: array_to_string(({steps})[1:k], '')) END"
    return f"coalesce(list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all({bare}, {_sql(S.PATH)}), lambda p: {each})), lambda n: n NOT IN ({_list(S.NO_NAMES)})))), [])"


def _symbol(e: str) -> str:
    """One expression as a name; ``x`` is computed once as the only element of a list."""
    bare = f"regexp_replace(regexp_replace({e}, '^[\\s*&!~+(-]+|[\\s)]+$', '', 'g'), '\\s*(->|\\.|\\[|\\])\\s*', '\\1', 'g')"
    bare = f"regexp_replace({bare}, '^([A-Za-z_]\\w*)\\)(->|\\.)', '\\1\\2')"
    base, index = f"regexp_extract(x, {_sql(rf'^({S.PATH})\[.*\]$')}, 1)", "regexp_extract(x, '^[^\\[]*\\[(.*)\\]$', 1)"
    named = f"""CASE WHEN regexp_full_match(x, {_sql(S.PATH)}) THEN CASE WHEN x IN ({_list(S.NO_NAMES)}) THEN '' ELSE {_last('x')} END WHEN regexp_matches(x, '^$|^[\\d"''.]') THEN ''
        WHEN {base} <> '' THEN CASE WHEN regexp_matches({index}, '^\\d\\w*$') THEN {_last(base)} ELSE {_last(base)} || '[' || {index} || ']' END ELSE {_shorten(e, 60)} END"""
    return f"list_transform([{bare}], lambda x: {named})[1]"


def _shorten(e: str, most: int) -> str:
    t = f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({t}) > {most} THEN left({t}, {most - 3}) || '...' ELSE {t} END"


def _inside(e: str) -> str:
    return f"substr({e}, 2, greatest(length({e}) - 2, 0))"


def _args(e: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({_inside(e)}, {_sql(S.ELEMENT)}), lambda a: trim(a)), lambda a: a <> '')"


CLEAN = r"""regexp_replace(regexp_replace(replace(regexp_replace(func, chr(13) || '(' || chr(10) || ')?', chr(10), 'g'), chr(9), '    '), '[\t\v\f\r \x1c-\x1f\x{85}\pZ]+(\n|$)', '\1', 'g'), '(?m)^[^\S\n]*#.*$', '', 'g')"""
PIECES = f"""c AS (SELECT DISTINCT idx, {CLEAN} AS code FROM primevul_train WHERE func IS NOT NULL AND trim(func) <> ''),
    n AS (SELECT idx, array_to_string(list_transform(string_split(code, chr(10)), lambda x, i: chr(1) || i || chr(2) || x), chr(10)) AS code FROM c),
    e AS (SELECT idx, list_filter(regexp_extract_all(regexp_replace(code, {_sql(S.COMMENT_OR_LITERAL)}, '\\1', 'g'), {_sql(S.PIECE)}), lambda p: NOT regexp_matches(p, '^\\s+$')) AS ps FROM n),
    r AS (SELECT idx, unnest(ps) AS piece, CAST(unnest(range(len(ps))) AS INTEGER) AS place FROM e),
    l AS (SELECT *, last_value(CAST(nullif(regexp_extract(piece, {_sql('(?s).*' + S.MARK)}, 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY idx ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM r),
    d AS (SELECT *, coalesce(sum(CASE piece WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY idx ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM l WHERE NOT regexp_full_match(piece, {_sql(S.MARK)})),
    o AS (SELECT *, coalesce(count(*) FILTER (WHERE piece = '{{' AND depth <= 0) OVER (PARTITION BY idx ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened,
        count(*) FILTER (WHERE piece = '{{') OVER (PARTITION BY idx) AS braces, count(*) FILTER (WHERE piece IN ('(', ')', '"', '''')) OVER (PARTITION BY idx) AS unread,
        coalesce(regexp_matches(piece, '^while\\b') AND lead(piece) OVER (PARTITION BY idx ORDER BY place) = ';' AND lag(piece) OVER (PARTITION BY idx ORDER BY place) = '}}', false) AS "do" FROM d),
    s AS (SELECT idx, place, coalesce(line, 1) AS line, "do", unread, trim(regexp_replace(trim(regexp_replace(regexp_replace(piece, {_sql(S.MARK)}, ' ', 'g'), '\\s+', ' ', 'g')), {_sql(S.LABEL)}, '\\1')) AS piece
        FROM o WHERE (braces = 0 OR opened = 1 AND depth >= 1) AND piece NOT IN (';', '{{', '}}', 'else', 'do')),
    b AS (SELECT *, regexp_matches(piece, {_sql(S.BROKEN)}) AS broken FROM s WHERE piece <> '')"""
CATEGORY = "CASE " + " ".join(f"WHEN {{0}} IN ({_list(n for n, k in V.CATEGORY_OF.items() if k == c)}) THEN '{c}'" for c in V.CATEGORIES) + " ELSE '' END"
ROLES = "CASE {0} " + " ".join(f"WHEN '{c}' THEN {p}" for c, p in V.SINK_ARGUMENTS.items()) + " ELSE [0, 1] END"
CALLEE = "regexp_replace(trim(regexp_extract({0}, '([^.:>]*)$', 1)), '^__builtin_', '')"
JOINED = ", ".join(f"coalesce(array_to_string(list_sort({c}), ' ; '), '') AS {c}" for c in ("defs", "uses", "keys"))
EVENTS = f"""{PIECES}, t AS (SELECT idx, place, line, "do", piece AS p, regexp_extract(piece, '^(if|while|for|switch|return|goto)\\b', 1) AS word, regexp_extract(piece, {_sql(rf'^(?:if|while|for|switch)\b\s*({S.PAREN})')}, 1) AS bracket
        FROM (SELECT *, unread + count(*) FILTER (WHERE broken) OVER (PARTITION BY idx) AS bad FROM b) WHERE bad <= {S.MOST_ERRORS} AND NOT broken),
    u AS (SELECT *, CASE WHEN word = 'for' THEN trim(regexp_extract(bracket, '^\\([^;]*;([^;]*);', 1)) ELSE bracket END AS cond, CASE word WHEN '' THEN p WHEN 'for' THEN trim(regexp_extract(bracket, '^\\(([^;]*);', 1)) ELSE '' END AS told FROM t),
    v AS (SELECT *, regexp_matches(told, {_sql(S.DECLARED)}) AND NOT regexp_matches(told, {_sql(S.NO_DECLARATION)}) AS declares FROM u),
    w AS (SELECT *, CASE WHEN declares THEN list_filter(list_transform(regexp_extract_all(told, {_sql(S.ELEMENT)}), lambda e: [trim(regexp_extract(e, {_sql(S.INITIAL)}, 1)), trim(regexp_extract(e, {_sql(S.INITIAL)}, 2))]), lambda x: x[1] <> '')
        WHEN word = '' AND regexp_matches(p, {_sql(S.ASSIGNED)}) THEN [[trim(regexp_extract(p, {_sql(S.ASSIGNED)}, 1)), trim(regexp_extract(p, {_sql(S.ASSIGNED)}, 2))]] ELSE [] END AS sets FROM v),
    heads AS (SELECT idx, place, 0 AS sub, line, CASE word WHEN 'switch' THEN 'SWITCH' WHEN 'goto' THEN 'GOTO' WHEN 'return' THEN 'RET' ELSE 'BRANCH' END AS kind, CASE WHEN word IN ('switch', 'goto', 'return') THEN 'CTRL' ELSE 'GUARD' END AS tag,
        CASE WHEN word = 'return' THEN rtrim('return ' || {_shorten('substr(p, 7)', 120)}) WHEN word = 'goto' THEN {_shorten('p', 120)} ELSE CASE WHEN "do" THEN 'do' ELSE word END || ' (' || {_shorten('cond', 120)} || ')' END AS text, []::VARCHAR[] AS defs,
        CASE word WHEN 'return' THEN substr(p, 7) WHEN 'goto' THEN '' ELSE cond END AS about,
        array_to_string(list_filter(regexp_split_to_array(cond, '&&|\\|\\|'), lambda q: regexp_matches(regexp_replace(q, '->|<<|>>', ' ', 'g'), '[<>]|==|!=|^[\\s(]*!')), ' ; ') AS guard, word FROM w WHERE word <> '' AND (word <> 'for' OR cond <> '')),
    heads2 AS (SELECT idx, place, sub, line, kind, tag, text, defs, {_symbols('about')} AS uses, {_symbols("CASE WHEN kind = 'BRANCH' THEN guard ELSE about END")} AS keys FROM heads),
    one AS (SELECT idx, place, line, unnest(sets) AS z, unnest(range(1, len(sets) + 1)) AS sub FROM w),
    two AS (SELECT idx, place, line, sub, {_symbol('z[1]')} AS lhs, z[2] AS rhs FROM one),
    three AS (SELECT *, regexp_matches(rhs, {_sql(rf'^{S.PATH}\s*{S.PAREN}$')}) AND regexp_extract(rhs, {_sql(rf'^({S.PATH})')}, 1) NOT IN ({_list(S.NO_CALLS)}) AS called FROM two
        WHERE lhs <> '' AND regexp_replace(rhs, '\\s+', '', 'g') NOT IN (SELECT unnest(list_transform(['+1', '+1u', '+1U', '-1', '-1u', '-1U'], lambda x: regexp_replace(lhs, '\\s+', '', 'g') || x)))),
    sets AS (SELECT idx, place, sub, line, 'SET' AS kind, 'DF' AS tag, lhs || ' = ' || {_shorten('rhs', 120)} AS text, [lhs] AS defs, {_symbols('rhs')} AS uses, lhs FROM three WHERE NOT called),
    sets2 AS (SELECT idx, place, sub, line, kind, tag, text, defs, uses, list_distinct(list_concat([lhs], uses[1:2])) AS keys FROM sets),
    places AS (SELECT idx, place, line, string_split(regexp_replace(CASE WHEN word IN ('return', 'goto') THEN '' WHEN declares AND word = '' THEN array_to_string(list_transform(sets, lambda x: x[2]), ' , ') WHEN word <> '' THEN bracket ELSE p END,
        {_sql(rf'({S.LITERAL})|({S.PATH})(\s*[(\[])')}, '\\1' || chr(3) || '\\2\\3', 'g'), chr(3)) AS parts FROM w),
    spots AS (SELECT idx, place, line, unnest(range(2, len(parts) + 1)) AS k, parts FROM places),
    named AS (SELECT idx, place, line, 1000000 + k - 1 AS sub, regexp_extract(array_to_string(parts[k:], ''), {_sql(rf'^({S.PATH})')}, 1) AS name, regexp_extract(array_to_string(parts[k:], ''), {_sql(rf'^{S.PATH}\s*({S.PAREN}|{S.BRACKET})')}, 1) AS bracket FROM spots),
    calling AS (SELECT idx, place, sub, line, regexp_extract(rhs, {_sql(rf'^({S.PATH})')}, 1) AS name, regexp_extract(rhs, {_sql(rf'^{S.PATH}\s*({S.PAREN})$')}, 1) AS bracket, lhs FROM three WHERE called
        UNION ALL SELECT idx, place, sub, line, name, bracket, NULL FROM named WHERE bracket LIKE '(%' AND name NOT IN ({_list(S.NO_CALLS)})),
    cat AS (SELECT *, {CALLEE.format('name')} AS callee, {_args('bracket')} AS args FROM calling),
    cat2 AS (SELECT *, {CATEGORY.format('callee')} AS tag FROM cat),
    calls AS (SELECT *, {_symbols("array_to_string(args, ' , ')")} AS uses, CASE WHEN lhs IS NULL THEN [] ELSE [lhs] END AS defs, list_filter({ROLES.format('tag')}, lambda r: r < len(args)) AS marks FROM cat2),
    calls2 AS (SELECT *, list_distinct(list_concat(list_filter(list_transform(marks, lambda r: {_symbol('args[r + 1]')}), lambda n: n <> ''), defs)) AS ks FROM calls),
    calls3 AS (SELECT idx, place, sub, line, 'CALL' AS kind, tag, callee || '(...)' || CASE WHEN lhs IS NULL THEN '' ELSE ' -> ' || lhs END AS text, defs, uses, CASE WHEN len(ks) > 0 THEN ks ELSE uses END AS keys FROM calls2),
    indexed AS (SELECT *, {_symbols(_inside('bracket'))} AS names FROM named WHERE bracket LIKE '[%' AND name NOT IN ({_list(S.NO_NAMES)})),
    indexed2 AS (SELECT idx, place, sub, line, 'INDEX' AS kind, 'SINK' AS tag, {_shorten('name || bracket', 80)} AS text, []::VARCHAR[] AS defs, list_distinct(list_concat({_symbols('name')}, names)) AS uses,
        list_distinct(list_filter([{_last('name')}, {_symbol(_inside('bracket'))}], lambda n: n <> '')) AS keys FROM indexed WHERE len(names) > 0),
    every AS (SELECT * FROM heads2 UNION ALL SELECT * FROM sets2 UNION ALL SELECT * FROM calls3 UNION ALL SELECT * FROM indexed2)"""
ORACLES = {
    "statement_pieces": f'WITH {PIECES} SELECT idx, place, line, piece, "do", broken FROM b',
    "raw_events": f"WITH {EVENTS} SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY place, sub) - 1 AS INTEGER) AS pos, line, kind, tag, text, {JOINED} FROM every",
}
ORACLES["shown_names"] = f"""WITH {EVENTS}, ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY idx ORDER BY place, sub) - 1 AS INTEGER) AS pos FROM every),
    df AS (SELECT idx, name, max_by(line, pos) AS line, max_by(uses, pos) AS uses FROM (SELECT idx, pos, line, uses, unnest(defs) AS name FROM ev) GROUP BY idx, name),
    k0 AS (SELECT DISTINCT idx, pos, unnest(keys) AS name FROM ev),
    k1 AS (SELECT DISTINCT k0.idx, pos, unnest(df.uses) AS name FROM k0 JOIN df ON k0.idx = df.idx AND k0.name = df.name),
    k2 AS (SELECT DISTINCT k1.idx, pos, unnest(df.uses) AS name FROM k1 JOIN df ON k1.idx = df.idx AND k1.name = df.name),
    cand AS (SELECT * FROM k0 UNION SELECT * FROM k1 UNION SELECT * FROM k2 UNION SELECT idx, pos, unnest(defs) FROM ev),
    scored AS (SELECT c.idx, c.pos, c.name, CASE WHEN list_contains(keys, name) THEN 100 ELSE 0 END + CASE WHEN list_contains(defs, name) THEN 60 ELSE 0 END + CASE WHEN list_contains(uses, name) THEN 20 ELSE 0 END
        - CAST(floor(least(length(name), 40) / 10) AS INTEGER) AS score FROM cand c JOIN ev ON c.idx = ev.idx AND c.pos = ev.pos WHERE name NOT IN ('NULL', 'nullptr', '')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY idx, pos ORDER BY score DESC, length(name), name) AS r FROM scored),
    best AS (SELECT ev.idx, ev.pos, coalesce(list(name ORDER BY r) FILTER (WHERE r <= CASE WHEN kind IN ('INDEX', 'BRANCH') OR tag IN ({_list(['SINK', *V.CATEGORIES])}) THEN 5 WHEN len(keys) >= 2 THEN 4 ELSE 3 END), []) AS top,
        coalesce(list(name) FILTER (WHERE name IS NOT NULL), []) AS near, any_value(uses) AS uses FROM ev LEFT JOIN ranked ON ev.idx = ranked.idx AND ev.pos = ranked.pos GROUP BY ev.idx, ev.pos),
    filled AS (SELECT idx, pos, list_concat(top, list_sort(list_filter(uses, lambda x: NOT list_contains(near, x)))[1:greatest(0, 3 - len(top))]) AS names FROM best),
    flat AS (SELECT idx, pos, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS rank FROM filled)
    SELECT flat.idx, pos, CAST(rank AS INTEGER) AS rank, flat.name || CASE WHEN rank <= 3 AND line IS NOT NULL THEN '@' || line ELSE '' END AS name FROM flat LEFT JOIN df ON flat.idx = df.idx AND flat.name = df.name"""
