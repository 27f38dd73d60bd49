"""Event texts as relations: runs of calls, variable closures, top variables, limits, rendering.

A rendered event reads ``[Line n] KIND[TAG]: text D{defs} U{uses}``; events are joined by `` | ``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codegrain.functions.once import let

EMPTY, FAILED, CUT = "VULNIR_EMPTY", "VULNIR_PARSE_FAILED", "[Line ?] ...: VULNIR_TRUNCATED"  # fixed values
HIDDEN_TAGS = ("DF", "CTRL", "GUARD")

# Callees by category, and the argument positions that matter for a category.
CATEGORIES = {
    "MEMCPY": ["memcpy", "memmove", "bcopy", "mempcpy"],
    "STRCPY": ["strcpy", "stpcpy", "strncpy", "strcat", "strncat", "strlcpy", "strlcat"],
    "FORMAT": ["sprintf", "snprintf", "vsprintf", "vsnprintf", "asprintf", "vasprintf", "printf", "fprintf", "vprintf", "vfprintf"],
    "READ": ["read", "pread", "recv", "recvfrom", "fread", "gets", "fgets", "getline"],
    "ALLOC": ["malloc", "calloc", "realloc", "aligned_alloc", "new", "kmalloc", "kzalloc", "vmalloc", "strdup", "strndup", "operator new", "operator new[]"],
    "FREE": ["free", "kfree", "vfree", "delete", "operator delete", "operator delete[]"],
    "FILE": ["open", "fopen", "freopen", "close", "fclose", "write", "pwrite", "send", "sendto", "fwrite"],
    "EXEC": ["system", "popen", "execve", "execl", "execlp", "execv", "execvp"],
    "ENV": ["getenv", "setenv", "putenv", "unsetenv"],
    "PARSE": ["atoi", "atol", "atoll", "strtol", "strtoll", "strtoul", "strtoull", "sscanf", "scanf", "fscanf"],
    "CRYPTO": ["memcmp", "EVP_DigestVerifyInit", "EVP_DigestVerifyFinal"],
}
SINK_ARGUMENTS = {"MEMCPY": [0, 1, 2], "STRCPY": [0, 1, 2], "FORMAT": [0, 1], "READ": [0, 1, 2], "ALLOC": [0, 1], "FREE": [0], "FILE": [0, 1, 2], "EXEC": [0], "ENV": [0, 1], "PARSE": [0, 1]}
CATEGORY_OF = {name: category for category, names in CATEGORIES.items() for name in names}


def category(callee: Column) -> Column:
    """The category of a callee, "" if it has none: a constant map of some seventy names."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in CATEGORY_OF.items() for x in pair])[callee], F.lit(""))


def parsed(ir: Column) -> Column:
    """The events of a rendered text: array<struct<pos,line,kind,tag,text,defs,uses>>; no events for sentinels."""
    pieces = F.when(ir.isin(EMPTY, FAILED), F.array().cast("array<string>")).otherwise(F.split(ir, r" \| (?=\[Line )"))
    kept = F.filter(pieces, lambda e: e.rlike(r"^\[Line \d+\] [A-Z_]+(\[[A-Z_]+\])?: "))

    def names(e: Column, which: str) -> Column:
        inside = F.regexp_extract(e, rf" {which}\{{([^{{}}]*)\}}{'( U\\{[^{}]*\\})?' if which == 'D' else ''}$", 1)
        return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, ","))

    return F.transform(kept, lambda e, i: F.struct(
        i.alias("pos"),
        F.regexp_extract(e, r"^\[Line (\d+)\]", 1).cast("int").alias("line"),
        F.regexp_extract(e, r"^\[Line \d+\] ([A-Z_]+)", 1).alias("kind"),
        F.regexp_extract(e, r"^\[Line \d+\] [A-Z_]+\[([A-Z_]+)\]: ", 1).alias("tag"),
        F.regexp_replace(F.regexp_replace(e, r"^\[Line \d+\] [A-Z_]+(\[[A-Z_]+\])?: ", ""), r"( D\{[^{}]*\})?( U\{[^{}]*\})?$", "").alias("text"),
        names(e, "D").alias("defs"),
        F.transform(names(e, "U"), lambda u: F.regexp_replace(u, r"@\d+$", "")).alias("uses"),
    ))


def event_table(df: DataFrame, key: str, ir: str) -> DataFrame:
    """One row per event of each rendered text."""
    return df.select(key, F.explode(parsed(F.col(ir))).alias("e")).select(key, "e.*")


def callee(text: Column) -> Column:
    return F.regexp_extract(text, r"^([A-Za-z_][A-Za-z0-9_]*)\(", 1)


def compressed(events: DataFrame, key: str, least: int = 3, sets: tuple[str, ...] = ("defs", "uses")) -> DataFrame:
    """Runs of ``least`` or more consecutive calls of one callee become one event each.

    Gaps and islands within a record. The run keeps the line, tag and position of its first call; names
    in the columns ``sets`` are united. Shorter runs stay as they are.
    """
    w = W.partitionBy(key).orderBy("pos")
    name = F.when(F.col("kind") == "CALL", F.nullif(callee(F.col("text")), F.lit("")))
    marked = events.withColumn("_callee", name).withColumn("_new", F.when(F.col("_callee").isNotNull() & (F.lag("_callee").over(w) == F.col("_callee")), 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(w))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    sized = island.withColumn("_n", F.count("*").over(W.partitionBy(key, "_island")))
    runs = sized.where((F.col("_n") >= least) & F.col("_callee").isNotNull()).groupBy(key, "_island").agg(
        F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.min_by("tag", "pos").alias("tag"), F.first("_callee").alias("_callee"), F.first("_n").alias("calls"),
        *[union(c).alias(c) for c in sets],
    )
    text = F.concat(F.col("_callee"), F.lit("(...) ×"), F.col("calls").cast("string"), F.when(F.size("defs") > 0, F.concat(F.lit(" -> "), F.array_join("defs", ", "))).otherwise(""))
    columns = [key, "pos", "line", "kind", "tag", "text", *sets, "calls"]
    single = sized.where((F.col("_n") < least) | F.col("_callee").isNull()).withColumn("calls", F.lit(1).cast("long"))
    return single.select(*columns).unionByName(runs.withColumn("kind", F.lit("CALL")).withColumn("text", text).select(*columns))


def dependencies(events: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The final state after all events: edges ``(key, src, dst)`` and lines ``(key, name, line)`` of the last definition."""
    defs = events.select(key, "pos", "line", "uses", F.explode("defs").alias("src"))
    last = defs.groupBy(key, "src").agg(F.max_by(F.struct("line", "uses"), "pos").alias("r"))
    edges = last.select(key, "src", F.explode("r.uses").alias("dst")).distinct()
    return edges, last.select(key, F.col("src").alias("name"), F.col("r.line").alias("line"))


def closure(seeds: DataFrame, edges: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """``(key, pos, name)``: the seeds of each event and what they depend on within ``depth`` steps."""
    reached = frontier = seeds.select(key, "pos", "name").distinct()
    for _ in range(depth):
        step = frontier.join(edges, [key, *()]).where(F.col("name") == F.col("src")).select(key, "pos", F.col("dst").alias("name"))
        frontier = step.distinct()
        reached = reached.unionByName(frontier).distinct()
    return reached


def definitions(events: DataFrame, key: str) -> DataFrame:
    """``(key, known)``: per record a map from each name to the line and the uses of its last definition."""
    last = events.select(key, "pos", "line", "uses", F.explode("defs").alias("name")).groupBy(key, "name").agg(F.max_by(F.struct("line", "uses"), "pos").alias("r"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "r"))).alias("known"))


def key_names(keys: Column, defs: Column, uses: Column, known: Column, most: Column, depth: int = 2) -> Column:
    """The names that an event shows: the best of its keys, what these depend on, and its definitions.

    Keys score 100, definitions 60, uses 20, less a point for each ten characters; ties go to the
    shorter, then the smaller name. Under three, they are filled up from the uses. The first three
    carry the line of their last definition.
    """
    none = F.array().cast("array<string>")
    leads = lambda names: F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(known, n)["uses"], none)))

    def reach(x: Column, step: int) -> Column:
        return x if not step else let(x, lambda y: F.concat(y, reach(F.array_distinct(leads(y)), step - 1)))

    near = F.array_except(F.array_distinct(F.concat(reach(F.array_distinct(keys), depth), defs)), F.array(F.lit("NULL"), F.lit("nullptr"), F.lit("")))
    points = lambda n: (F.when(F.array_contains(keys, n), 100).otherwise(0) + F.when(F.array_contains(defs, n), 60).otherwise(0) + F.when(F.array_contains(uses, n), 20).otherwise(0)
                        - F.floor(F.least(F.length(n), F.lit(40)) / 10))
    best = lambda names: F.transform(F.slice(F.array_sort(F.transform(names, lambda n: F.struct((-points(n)).alias("p"), F.length(n).alias("l"), n.alias("n")))), F.lit(1), most), lambda x: x["n"])
    filled = lambda names: let(best(names), lambda b: F.concat(b, F.slice(F.array_sort(F.array_except(uses, names)), F.lit(1), F.greatest(F.lit(0), 3 - F.size(b)))))
    shown = lambda n, i: F.when((i < 3) & F.try_element_at(known, n).isNotNull(), F.concat(n, F.lit("@"), F.try_element_at(known, n)["line"].cast("string"))).otherwise(n)
    return F.transform(let(near, filled), shown)


def top_names(names: DataFrame, key: str, score: Column, k: Column | int) -> DataFrame:
    """The best ``k`` names of each event, ranked by score, then length, then the name itself."""
    w = W.partitionBy(key, "pos").orderBy(F.desc("_score"), F.length("name"), "name")
    return names.withColumn("_score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (F.lit(k) if isinstance(k, int) else k)).drop("_score")


def rendered(events: DataFrame, key: str, most: int = 220) -> DataFrame:
    """``(key, ir)``: the first ``most`` events of a record as text, and a mark if there were more."""
    tag = F.when((F.col("tag") != "") & ~F.col("tag").isin(*HIDDEN_TAGS), F.concat(F.lit("["), F.col("tag"), F.lit("]"))).otherwise("")
    listed = lambda c, mark: F.when(F.size(c) > 0, F.concat(F.lit(f" {mark}{{"), F.array_join(c, ","), F.lit("}"))).otherwise("")
    text = F.concat(F.lit("[Line "), F.col("line").cast("string"), F.lit("] "), F.col("kind"), tag, F.lit(": "), F.col("text"), listed("defs", "D"), listed("uses", "U"))
    ordered = events.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy("pos"))).where(F.col("_at") <= most + 1)
    all_ = F.sort_array(F.collect_list(F.struct("_at", text.alias("text"))))
    shown = ordered.groupBy(key).agg(all_.alias("all")).withColumn("shown", F.transform(F.slice("all", 1, most), lambda e: e["text"]))
    return shown.select(key, F.array_join(F.when(F.size("all") > most, F.concat("shown", F.array(F.lit(CUT)))).otherwise(F.col("shown")), " | ").alias("ir"))


# The same within a row: for events that are an array of their record, nothing is shuffled.


def last_known(events: Column) -> Column:
    """A map from each name to the line and the uses of its last definition in an array of events."""
    entries = F.flatten(F.transform(events, lambda e: F.transform(e["defs"], lambda n: F.struct(n.alias("key"), F.struct(e["line"].alias("line"), e["uses"].alias("uses")).alias("value")))))
    last = lambda es: F.filter(es, lambda x, i: ~F.exists(F.slice(es, i + 2, F.greatest(F.size(es) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(let(entries, last))


def reached(events: Column, seeds: Callable[[Column], Column], depth: int = 2) -> Column:
    """array<struct<pos,names>>: for each event its seeds and what they depend on within ``depth`` steps."""
    none = F.array().cast("array<string>")

    def of(x: Column) -> Column:
        leads = lambda names: F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(x["known"], n)["uses"], none)))

        def near(names: Column, step: int) -> Column:
            return names if not step else let(names, lambda y: F.array_distinct(F.concat(y, near(F.array_distinct(leads(y)), step - 1))))

        return F.transform(x["events"], lambda e: F.struct(e["pos"].alias("pos"), near(F.array_distinct(seeds(e)), depth).alias("names")))

    return let(F.struct(events.alias("events"), last_known(events).alias("known")), of)


def runs(events: Column, least: int = 3) -> Column:
    """The events of a record with runs of ``least`` or more consecutive calls of one callee as one, and ``calls``, how many one stands for."""
    name = lambda e: F.when(e["kind"] == "CALL", F.nullif(callee(e["text"]), F.lit("")))
    named = F.transform(events, lambda e: F.struct(e.alias("e"), name(e).alias("callee")))

    def begun(x: Column) -> Column:
        before = lambda i: F.try_element_at(x, F.greatest(i, F.lit(1)))["callee"]
        return F.transform(x, lambda y, i: F.struct(y["e"].alias("e"), y["callee"].alias("callee"), (y["callee"].isNull() | (i == 0) | ~before(i).eqNullSafe(y["callee"])).alias("first")))

    def grouped(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda y, i: F.when(y["first"], i)), lambda i: i.isNotNull())
        cut = lambda s: F.transform(s, lambda a, k: F.slice(x, a + 1, F.coalesce(F.try_element_at(s, k + 2), F.size(x)) - a))
        return let(starts, cut)

    def put(run: Column) -> Column:
        united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(run, lambda y: y["e"][c]))))
        first = F.element_at(run, 1)["e"]
        text = lambda defs: F.concat(F.element_at(run, 1)["callee"], F.lit("(...) ×"), F.size(run).cast("string"), F.when(F.size(defs) > 0, F.concat(F.lit(" -> "), F.array_join(defs, ", "))).otherwise(""))
        made = F.struct(first["pos"].alias("pos"), first["line"].alias("line"), first["kind"].alias("kind"), first["tag"].alias("tag"), text(united("defs")).alias("text"), united("defs").alias("defs"), united("uses").alias("uses"), F.size(run).alias("calls"))
        alone = F.transform(run, lambda y: F.struct(*[y["e"][c].alias(c) for c in ("pos", "line", "kind", "tag", "text", "defs", "uses")], F.lit(1).alias("calls")))
        return F.when((F.size(run) >= least) & (F.size(run) > 1), F.array(made)).otherwise(alone)

    return F.flatten(F.transform(let(let(named, begun), grouped), put))


def _written(e: Column) -> Column:
    """One event as text."""
    tag = F.when((e["tag"] != "") & ~e["tag"].isin(*HIDDEN_TAGS), F.concat(F.lit("["), e["tag"], F.lit("]"))).otherwise("")
    listed = lambda c, mark: F.when(F.size(c) > 0, F.concat(F.lit(f" {mark}{{"), F.array_join(c, ","), F.lit("}"))).otherwise("")
    return F.concat(F.lit("[Line "), e["line"].cast("string"), F.lit("] "), e["kind"], tag, F.lit(": "), e["text"], listed(e["defs"], "D"), listed(e["uses"], "U"))


def rewritten(events: Column, most: int = 220) -> Column:
    """An array of events as text: the first ``most`` and a mark if there were more; null without events."""
    told = lambda es: F.transform(F.slice(es, 1, most), _written)
    return let(events, lambda es: F.when(F.size(es) > 0, F.array_join(F.when(F.size(es) > most, F.concat(told(es), F.array(F.lit(CUT)))).otherwise(told(es)), " | ")))


def changed(df: DataFrame, old: str, new: str, *by: str) -> DataFrame:
    """Per group how many event texts there are, differ from the old ones, nulls being equal, and fail."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("updated"), F.count_if(F.col(new) == FAILED).alias("failed"))
