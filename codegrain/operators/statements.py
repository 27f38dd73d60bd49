"""Event texts made from C and C++ functions: statements, their events and the names in them, as Spark columns and windows.

A code is cut into statements by one regular expression and exploded; windows give each statement its
line and its depth of braces; columns tell its kind and cut out conditions, assignments, calls and indexed
accesses; events are numbered, runs of calls are put together and every event shows its best names
(``operators.events``). All steps of a record happen where its rows are, after the one shuffle by key.

Brackets are matched to a depth of five within a statement. Types in casts are taken for names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codegrain.functions import text as X
from codegrain.functions.once import let
from codegrain.operators import events as V
from codegrain.session import materialize

MOST_ERRORS = 120  # fixed value: with more pieces that can't be read a code fails
# Words that are no names, and words before a bracket that are no calls.
NO_NAMES = ("NULL nullptr true false if else while for do switch case default return goto break continue sizeof new delete throw const volatile static extern register inline auto struct union enum class typename "
            "void char short int long float double signed unsigned bool this operator using namespace template typedef static_cast dynamic_cast reinterpret_cast const_cast").split()
NO_CALLS = "if while for switch return sizeof case catch defined alignof decltype typeof static_cast dynamic_cast reinterpret_cast const_cast".split()

LITERAL = r'''"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+\''''


def _nested(open_: str, close: str, depth: int = 5) -> str:
    """Balanced brackets with literals; repetitions are possessive, so long texts need no stack."""
    inner = ""
    for _ in range(depth):
        inner = rf"\{open_}(?:{LITERAL}|[^\{open_}\{close}\"']++{'|' + inner if inner else ''})*+\{close}"
    return inner


PAREN, BRACKET, BRACE = _nested("(", ")"), _nested("[", "]", 3), _nested("{", "}", 4)
MARK = "\x01(\\d+)\x02"
HEADER = rf"(?:if|while|for|switch)\b\s*+{PAREN}"
RUN = rf"(?:=\s*+{BRACE}|{LITERAL}|{PAREN}|[^;{{}}()\"'=]++|=)++"
PIECE = rf"\x01\d+\x02|\s++|{HEADER}|(?:else|do)\b|[;{{}}]|{RUN}|(?s:.)"
COMMENT_OR_LITERAL = rf"({LITERAL})|/\*(?s:.*?)\*/|//[^\n]*"
NAME = r"[A-Za-z_]\w*+"
PATH = rf"{NAME}(?:(?:->|\.|::){NAME})*+"
TYPE = rf"(?:{NAME}(?:::{NAME})*+(?:<[^<>;=]*+>)?[\s*&]++)+"
DECLARED = rf"^{TYPE}(?:{NAME})\s*(?:{BRACKET}\s*)*(?:=[^=]|,|\{{|$)"
NO_DECLARATION = r"^(?:return|goto|else|delete|throw|case)\b"
ASSIGNED = rf"^([*&(\s]*+{PATH}(?:\s*+{BRACKET}|\s*+(?:->|\.)\s*+{NAME}|\s*+\))*+\s*+)(?:[-+*/%&|^]|<<|>>)?=\s*([^=\s].*)$"
INITIAL = rf"({NAME})\s*(?:{BRACKET}\s*)*=\s*([^=\s].*)$"
LABEL = r"^(?:case\b[^:?]*|[A-Za-z_]\w*)\s*:([^:]|$)"
BROKEN = r"=\s+=(?:[^=]|$)|[-+*/%&|^<>=,]$|^[=/%|^,.)\]]"
ELEMENT = rf"(?:{LITERAL}|{PAREN}|{BRACKET}|{BRACE}|[^,()\[\]{{}}\"']++)++"


def statements(df: DataFrame, key: str, code: str) -> DataFrame:
    """``(key, at, line, piece, do, unread, broken)``: headers and statements of the first body of each code, in their order.

    Comments and directives are left out. A code without braces is one body. ``do`` marks the
    condition at the end of a do loop, ``broken`` a statement that can't be read; ``unread`` counts what can't in the code.
    """
    clean = X.blank_directives(X.clean_lines(F.col(code)))
    numbered = F.array_join(F.transform(F.split(clean, "\n"), lambda x, i: F.concat(F.lit("\x01"), (i + 1).cast("string"), F.lit("\x02"), x)), "\n")
    pieces = F.regexp_extract_all(F.regexp_replace(numbered, COMMENT_OR_LITERAL, "$1"), F.lit(PIECE), F.lit(0))
    rows = df.select(key, F.posexplode(F.filter(pieces, lambda p: ~p.rlike(r"^\s+$"))).alias("at", "piece"))
    order = W.partitionBy(key).orderBy("at")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    last_line = F.nullif(F.regexp_extract("piece", rf"(?s)^.*{MARK}", 1), F.lit("")).cast("int")
    rows = rows.withColumn("mark", last_line).withColumn("line", F.last("mark", ignorenulls=True).over(before)).drop("mark").where(~F.col("piece").rlike(rf"^{MARK}$"))
    step = F.when(F.col("piece") == "{", 1).when(F.col("piece") == "}", -1).otherwise(0)
    depth = F.coalesce(F.sum(step).over(before), F.lit(0))
    rows = rows.withColumn("depth", depth).withColumn("opened", F.coalesce(F.count_if((F.col("piece") == "{") & (F.col("depth") <= 0)).over(before), F.lit(0)))
    whole = W.partitionBy(key)
    rows = rows.withColumn("bodies", F.max("opened").over(whole)).withColumn("braces", F.count_if(F.col("piece") == "{").over(whole))
    rows = rows.withColumn("unread", F.count_if(F.col("piece").isin("(", ")", '"', "'")).over(whole))
    tail = F.col("piece").rlike(r"^while\b") & (F.lead("piece").over(order) == ";") & (F.lag("piece").over(order) == "}")
    inside = (F.col("braces") == 0) | (F.col("opened") == 1) & (F.col("depth") >= 1)
    rows = rows.withColumn("do", F.coalesce(tail, F.lit(False))).where(inside & ~F.col("piece").isin(";", "{", "}", "else", "do"))
    text = F.trim(F.regexp_replace(F.regexp_replace("piece", MARK, " "), r"\s+", " "))
    unlabelled = F.trim(F.regexp_replace(text, LABEL, "$1"))
    rows = rows.select(key, "at", F.coalesce("line", F.lit(1)).alias("line"), unlabelled.alias("piece"), "do", "unread").where("piece <> ''")
    broken = F.col("piece").rlike(BROKEN)
    return rows.withColumn("unread", F.col("unread") + F.count_if(broken).over(whole)).withColumn("broken", broken)


def prefixes(path: Column) -> Column:
    """``a``, ``a->b`` and ``a->b->c`` of a path; after an arrow every step is one."""
    parts = F.regexp_extract_all(path, F.lit(r"(?:->|\.|::)?[A-Za-z_]\w*"), F.lit(0))
    arrows = lambda p: F.transform(p, lambda x, i: F.when(x.startswith(".") & F.exists(F.slice(p, F.lit(1), i), lambda y: y.startswith("->")), F.concat(F.lit("->"), F.substring(x, 2, 1_000))).otherwise(x))
    steps = lambda p: F.transform(p, lambda x, i: F.array_join(F.slice(p, F.lit(1), i + 1), ""))
    return F.when(~path.rlike(r"->|\."), F.array(path)).otherwise(let(parts, lambda p: let(arrows(p), steps)))


def symbols(expression: Column) -> Column:
    """The names in an expression, sorted: identifiers, field paths and the paths that these begin with."""
    bare = F.regexp_replace(F.regexp_replace(expression, LITERAL, " "), r"\s*(->|\.)\s*([A-Za-z_])", "$1$2")
    bare = F.regexp_replace(F.regexp_replace(bare, r"([\])])(?:(?:->|\.)[A-Za-z_]\w*)+", "$1"), r"\b\d[\w.]*", " ")
    paths = F.regexp_extract_all(bare, F.lit(rf"{PATH}"), F.lit(0))
    known = F.filter(F.flatten(F.transform(paths, prefixes)), lambda n: ~n.isin(*NO_NAMES))
    return F.coalesce(F.array_sort(F.array_distinct(known)), F.array().cast("array<string>"))


def symbol(expression: Column) -> Column:
    """One expression as a name: a path, an indexed one, nothing for a literal, else its text, shortened."""
    bare = F.regexp_replace(F.regexp_replace(expression, r"^[\s*&!~+(-]+|[\s)]+$", ""), r"\s*(->|\.|\[|\])\s*", "$1")
    bare = F.regexp_replace(bare, r"^([A-Za-z_]\w*)\)(->|\.)", "$1$2")

    def named(b: Column) -> Column:
        base, index = F.regexp_extract(b, rf"^({PATH})\[.*\]$", 1), F.regexp_extract(b, r"^[^\[]*\[(.*)\]$", 1)
        indexed = F.when(index.rlike(r"^\d\w*$"), last_prefix(base)).otherwise(F.concat(last_prefix(base), F.lit("["), index, F.lit("]")))
        path = F.when(b.isin(*NO_NAMES), "").otherwise(last_prefix(b))
        return F.when(b.rlike(rf"^{PATH}$"), path).when(b.rlike(r"^$|^[\d\"'.]"), "").when(base != "", indexed).otherwise(X.shorten(expression, 60))

    return let(bare, named)


def last_prefix(path: Column) -> Column:
    """A path with its steps as ``prefixes`` writes them."""
    head = F.regexp_extract(path, r"^[^-]*", 0)
    return F.concat(head, F.replace(F.substring(path, F.length(head) + 1, F.length(path)), F.lit("."), F.lit("->")))


def guarded(condition: Column) -> Column:
    """The names that a condition checks or takes as bounds: those of its comparisons and negations."""
    parts = F.filter(F.split(condition, r"&&|\|\|"), lambda p: F.regexp_replace(p, r"->|<<|>>", " ").rlike(r"[<>]|==|!=|^[\s(]*!"))
    return symbols(F.array_join(parts, " ; "))


def arguments(bracket: Column) -> Column:
    """The arguments of a call, from its bracket."""
    inside = F.substring(bracket, F.lit(2), F.greatest(F.length(bracket) - 2, F.lit(0)))
    return F.filter(F.transform(F.regexp_extract_all(inside, F.lit(ELEMENT), F.lit(0)), lambda a: F.trim(a)), lambda a: a != "")


def trivial(lhs: Column, rhs: Column) -> Column:
    """Whether an assignment only counts by one: ``x = x + 1``, ``x = x - 1u``."""
    return F.regexp_replace(rhs, r"\s+", "").isin(*[F.concat(F.regexp_replace(lhs, r"\s+", ""), F.lit(s)) for s in ("+1", "+1u", "+1U", "-1", "-1u", "-1U")])


def _called(name: Column, bracket: Column) -> dict[str, Column]:
    """Columns of a call event: callee, category, names used and names that matter for the category."""
    callee = X.normalized_callee(X.last_segment(name))
    roles = F.create_map(*[x for c, ps in V.SINK_ARGUMENTS.items() for x in (F.lit(c), F.array(*map(F.lit, ps)))])
    args = arguments(bracket)
    return {"callee": callee, "tag": V.category(callee), "uses": symbols(F.array_join(args, " , ")), "args": args, "roles": F.coalesce(roles[V.category(callee)], F.array(F.lit(0), F.lit(1)))}


def raw_events(pieces: DataFrame, key: str, most: int = 120) -> DataFrame:
    """``(key, pos, line, kind, tag, text, defs, uses, keys)``: the events of each statement, outer before inner, left before right."""
    none = F.array().cast("array<string>")
    p = F.col("piece")
    word = F.regexp_extract(p, r"^(if|while|for|switch|return|goto)\b", 1)
    bracket = F.regexp_extract(p, rf"^(?:if|while|for|switch)\b\s*+({PAREN})", 1)
    condition = F.when(F.col("word") == "for", F.trim(F.regexp_extract("bracket", r"^\([^;]*;([^;]*);", 1))).otherwise(F.col("bracket"))
    first = F.trim(F.regexp_extract("bracket", r"^\(([^;]*);", 1))  # what a for loop declares
    told = F.when(F.col("word") == "", p).when(F.col("word") == "for", first).otherwise("")
    rows = pieces.withColumn("word", word).withColumn("bracket", bracket).withColumn("condition", condition).withColumn("told", told)
    rows = rows.withColumn("declares", F.col("told").rlike(DECLARED) & ~F.col("told").rlike(NO_DECLARATION))
    pair = lambda a, b: F.struct(F.trim(a).alias("lhs"), F.trim(b).alias("rhs"))
    of_declaration = F.filter(F.transform(F.regexp_extract_all("told", F.lit(ELEMENT), F.lit(0)), lambda e: pair(F.regexp_extract(e, INITIAL, 1), F.regexp_extract(e, INITIAL, 2))), lambda x: x["lhs"] != "")
    of_expression = F.when((F.col("word") == "") & p.rlike(ASSIGNED), F.array(pair(F.regexp_extract(p, ASSIGNED, 1), F.regexp_extract(p, ASSIGNED, 2))))
    sets = F.coalesce(F.when(F.col("declares"), of_declaration).otherwise(of_expression), F.array().cast("array<struct<lhs:string,rhs:string>>"))
    rows = materialize(rows.withColumn("sets", sets), "statements").where(f"unread <= {MOST_ERRORS} and not broken")

    # Conditions, jumps and returns; one for a statement.
    text = F.when(F.col("word").isin("if", "while", "for", "switch"), F.concat(F.when(F.col("do"), "do").otherwise(F.col("word")), F.lit(" ("), X.shorten(F.col("condition"), most), F.lit(")")))
    text = text.when(F.col("word") == "return", F.rtrim(F.concat(F.lit("return "), X.shorten(F.substring(p, 7, 1 << 30), most)))).otherwise(X.shorten(p, most))
    kind = F.when(F.col("word") == "switch", "SWITCH").when(F.col("word") == "goto", "GOTO").when(F.col("word") == "return", "RET").otherwise("BRANCH")
    about = F.when(F.col("word") == "return", F.substring(p, 7, 1 << 30)).when(F.col("word") == "goto", "").otherwise(F.col("condition"))
    heads = rows.where((F.col("word") != "") & ((F.col("word") != "for") | (F.col("condition") != ""))).select(
        key, "at", F.lit(0).alias("sub"), "line", kind.alias("kind"), F.when(kind == "BRANCH", "GUARD").otherwise("CTRL").alias("tag"), text.alias("text"), none.alias("defs"),
        symbols(about).alias("uses"), F.when(kind == "BRANCH", guarded(F.col("condition"))).otherwise(symbols(about)).alias("keys"))

    # Assignments and initializers: SET, or CALL where the value is one call.
    one = rows.select(key, "at", "line", F.posexplode("sets").alias("_k", "_s")).select(key, "at", "line", (F.col("_k") + 1).alias("sub"), symbol(F.col("_s.lhs")).alias("lhs"), F.col("_s.rhs").alias("rhs"))
    one = one.where((F.col("lhs") != "") & ~trivial(F.col("lhs"), F.col("rhs")))
    whole_call = F.col("rhs").rlike(rf"^{PATH}\s*+{PAREN}$") & ~F.regexp_extract("rhs", rf"^({PATH})", 1).isin(*NO_CALLS)
    call = _called(F.regexp_extract("rhs", rf"^({PATH})", 1), F.regexp_extract("rhs", rf"^{PATH}\s*+({PAREN})$", 1))
    calls = one.where(whole_call).select(key, "at", "sub", "line", "lhs", *[c.alias(n) for n, c in call.items()])
    used = symbols(F.col("rhs"))
    sets_ = one.where(~whole_call).select(key, "at", "sub", "line", F.lit("SET").alias("kind"), F.lit("DF").alias("tag"), F.concat("lhs", F.lit(" = "), X.shorten(F.col("rhs"), most)).alias("text"),
                                          F.array("lhs").alias("defs"), used.alias("uses"), F.array_distinct(F.concat(F.array("lhs"), F.slice(used, 1, 2))).alias("keys"))

    # Calls and indexed accesses anywhere in a statement, but for returns: every name before a bracket begins one.
    values = F.when(F.col("word").isin("return", "goto"), "").when(F.col("declares") & (F.col("word") == ""), F.array_join(F.transform("sets", lambda s: s["rhs"]), " , ")).when(F.col("word") != "", F.col("bracket")).otherwise(p)
    parts = F.split(F.regexp_replace(values, rf"({LITERAL})|({PATH})(\s*+[(\[])", "$1\x03$2$3"), "\x03")
    places = rows.withColumn("parts", parts).select(key, "at", "line", "parts", F.posexplode("parts").alias("_k", "_part"))
    rest = F.array_join(F.slice("parts", F.col("_k") + 1, F.size("parts")), "")
    places = places.where("_k > 0").select(key, "at", "line", (F.col("_k") + 1_000_000).alias("sub"), F.regexp_extract(rest, rf"^({PATH})", 1).alias("name"), F.regexp_extract(rest, rf"^{PATH}\s*+({PAREN}|{BRACKET})", 1).alias("bracket"))
    inner = _called(F.col("name"), F.col("bracket"))
    more = places.where(F.col("bracket").startswith("(") & ~F.col("name").isin(*NO_CALLS)).select(key, "at", "sub", "line", F.lit(None).cast("string").alias("lhs"), *[c.alias(n) for n, c in inner.items()])
    index = F.substring("bracket", F.lit(2), F.greatest(F.length("bracket") - 2, F.lit(0)))
    base, names = last_prefix(F.col("name")), symbols(index)
    indexed = places.where(F.col("bracket").startswith("[") & ~F.col("name").isin(*NO_NAMES) & (F.size(names) > 0)).select(
        key, "at", "sub", "line", F.lit("INDEX").alias("kind"), F.lit("SINK").alias("tag"), X.shorten(F.concat("name", "bracket"), 80).alias("text"), none.alias("defs"),
        F.array_sort(F.array_union(symbols(F.col("name")), names)).alias("uses"), F.array_distinct(F.filter(F.array(base, symbol(index)), lambda n: n != "")).alias("keys"))

    both = calls.unionByName(more)
    marked = F.filter(F.transform(F.filter("roles", lambda r: r < F.size("args")), lambda r: symbol(F.element_at("args", r + 1))), lambda n: n != "")
    defs = F.when(F.col("lhs").isNotNull(), F.array("lhs")).otherwise(none)
    keys = F.array_distinct(F.concat(marked, defs))
    told_call = F.concat("callee", F.lit("(...)"), F.when(F.col("lhs").isNotNull(), F.concat(F.lit(" -> "), F.col("lhs"))).otherwise(""))
    call_events = both.select(key, "at", "sub", "line", F.lit("CALL").alias("kind"), "tag", told_call.alias("text"), defs.alias("defs"), "uses", F.when(F.size(keys) > 0, keys).otherwise(F.col("uses")).alias("keys"))
    every = heads.unionByName(sets_).unionByName(call_events).unionByName(indexed)
    return every.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("at", "sub")) - 1).drop("at", "sub")


def most_names() -> Column:
    """How many names an event shows at most."""
    return F.when((F.col("tag") == "SINK") | F.col("kind").isin("INDEX", "BRANCH") | F.col("tag").isin(*V.CATEGORIES), 5).when(F.size("keys") >= 2, 4).otherwise(3)


def named_events(df: DataFrame, key: str, code: str) -> tuple[DataFrame, DataFrame]:
    """``(key, status)`` of each code and its events, runs of calls as one, with the names that each shows as uses.

    Names of an event: those within two steps of its key names, its definitions first, by score; three
    to five of them, filled up to three from its uses. The first three name the line that last defines them.
    """
    rows = df.select(F.col(key).alias("_id"), F.col(code).alias("_code"))
    pieces = materialize(statements(rows.where(F.trim("_code") != ""), "_id", "_code"), "pieces")
    raw = materialize(raw_events(pieces, "_id"), "raw-events")
    state = pieces.groupBy("_id").agg(F.max("unread").alias("unread"))
    status = rows.select("_id").join(state, "_id", "left").select(F.col("_id").alias(key), F.when(F.col("unread") > MOST_ERRORS, "failed").otherwise("read").alias("status"))
    events = V.compressed(raw, "_id", sets=("defs", "uses", "keys")).join(V.definitions(raw, "_id"), "_id", "left").withColumnRenamed("_id", key)
    known = F.coalesce("known", F.create_map().cast("map<string,struct<line:int,uses:array<string>>>"))
    return status, events.withColumn("known", known).withColumn("uses", V.key_names(F.col("keys"), F.col("defs"), F.col("uses"), F.col("known"), most_names()))


def generated(df: DataFrame, key: str, code: str, most_events: int = 220) -> DataFrame:
    """``(key, ir)``: the event text of each code; a sentinel for codes without events or that fail."""
    read, events = named_events(df, key, code)
    text = V.rendered(events, key, most_events)
    other = F.when(F.col("status") == "failed", V.FAILED).otherwise(V.EMPTY)
    return read.join(text, key, "left").select(key, F.coalesce("ir", other).alias("ir"))


def changes(df: DataFrame, key: str, code: str, old: str, *by: str) -> DataFrame:
    """Per group of ``by`` how many event texts there are, differ from ``old`` when made anew, and fail."""
    named = df.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    made = named.join(generated(named, "_key", code), "_key")
    return V.changed(made, old, "ir", *by)
