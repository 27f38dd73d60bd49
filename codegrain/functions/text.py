"""Text functions on columns: estimates, truncation, cleaning and the reading of replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5
TRUNCATION_MARK = "\n\n... [CODE TRUNCATED DUE TO LENGTH CONSTRAINT] ...\n\n"  # fixed value
SPACE = r" \t\x0B\f\r\x1C-\x1F\x{85}\p{Z}"


def estimated_tokens(text: Column) -> Column:
    """floor(characters / 3.5); 0 for null."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / F.lit(CHARS_PER_TOKEN)).cast("long")


def truncate_middle(text: Column, max_tokens: int) -> Column:
    """The first 40 % and the last 60 % of the budget around a mark, if the text is over the budget."""
    budget = int(max_tokens * CHARS_PER_TOKEN)
    cut = F.concat(F.left(text, F.lit(int(budget * 0.4))), F.lit(TRUNCATION_MARK), F.right(text, F.lit(int(budget * 0.6))))
    return F.when(estimated_tokens(text) > max_tokens, cut).otherwise(text)


def over_pair_budget(before: Column, after: Column, max_tokens: int = 13_000) -> Column:
    """Whether two texts together are over the budget; either alone never matters."""
    return estimated_tokens(before) + estimated_tokens(after) > max_tokens


def clean_lines(code: Column) -> Column:
    """Line ends to \\n, tabs to four blanks; NULs, then white space, off the end of each line."""
    lines = F.split(F.replace(F.regexp_replace(code, "\r\n?", "\n"), F.lit("\t"), F.lit("    ")), "\n")
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, rf"[{SPACE}]*\x00*\z", "")), "\n")


def blank_directives(code: Column, keep_lines: bool = True) -> Column:
    """Preprocessor lines emptied. Without ``keep_lines`` the blank lines before one vanish with it."""
    space = r"[^\S\n]*" if keep_lines else r"\s*"
    return F.regexp_replace(code, rf"(?md)^{space}#.*?$", "")


def shorten(text: Column, most: int = 120) -> Column:
    """White space collapsed; over ``most`` characters cut with three dots at the end."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 3)), F.lit("..."))).otherwise(t)


def normalized_callee(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "^__builtin_", "")


def last_segment(name: Column) -> Column:
    """``a->b.c`` is c, ``ns::f`` is f."""
    return F.regexp_extract(name, r"([^.:>]*)$", 1)


def verdict(reply: Column) -> Column:
    """1 for vulnerable: by the first verdict line, else by the bare word, else 0."""
    line = F.lower(F.regexp_extract(reply, r"(?i)\bverdict\s*:\s*(vulnerable|safe)\b", 1))
    return (F.when(reply.isNull() | (reply == ""), 0).when(line == "vulnerable", 1).when(line == "safe", 0)
            .when(reply.rlike(r"(?i)\bvulnerable\b"), 1).otherwise(0))


def verdict_by_substring(reply: Column) -> Column:
    return F.when(F.lower(reply).contains("vulnerable"), 1).otherwise(0)


def metric_of_log(log: Column, name: str) -> Column:
    """The number after ``name :`` in a log, null if it is missing or no number."""
    return F.regexp_extract(log, rf"{name}\s*:\s*([\d.]+)", 1).try_cast("double")


def reply_field(reply: Column, field: str, otherwise: Column) -> Column:
    """A field of a JSON reply, or what stands in for it if the field is missing."""
    return F.coalesce(F.get_json_object(reply, f"$.{field}"), otherwise)


def joined_list(items: Column, empty: str) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.array_join(items, ", "))


def number_of_dirty(text: Column) -> Column:
    """An integer from text with quotes, blanks or decimals; null if there is none."""
    return F.regexp_replace(text, r"[\"\s]", "").try_cast("double").cast("int")
