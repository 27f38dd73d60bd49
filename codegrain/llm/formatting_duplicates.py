"""Problem 1: records that differ in formatting only are collapsed into one.

Every function is cut into fields: a skeleton (its text with layout removed) and named
entries, the ``.name = value`` entries of each initializer and the ``@name: value`` entries
of the opening comment. Each field is hashed on its own and the hashes are added modulo
2**128, a commutative multiset hash, so the order of the entries does not matter and nothing
is sorted. Groups are formed on that fingerprint; every member of a group is then compared
with the representative: their texts without layout are equal, or a second cut that works from
the innermost brackets outwards, and shares nothing with the first, finds equal multisets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.session import materialize
from codegrain.sources.tables import join_groups, probably_among

# What the statement of the problem says to ignore.
IGNORED_MARKS = re.compile(r"/\*|\*/|//")
IGNORED_CHARACTERS = ",;:.?'\"(){}[]\\`"

DROP = {ord(c): None for c in IGNORED_CHARACTERS}
BLANK = re.compile(r"\s+")
GAP = r"(?:\s+|/\*.*?\*/|//[^\n]*|\#[^\n]*)*"
DESIGNATOR = r"\.\s*[a-z_]\w*(?:\s*(?:\.\s*\w+|\[[^\]\n]*\]))*\s*=(?!=)"
HAS_INITIALIZER = re.compile(rf"[{{,]{GAP}{DESIGNATOR}", re.S)
OPENING_COMMENT = re.compile(r"\s*(?:/\*.*?\*/|(?://[^\n]*(?:\n\s*|$))+)", re.S)
COMMENT_ENTRY = re.compile(r"@(\w+)\s*:")
BLANK_COMMENT_LINE = re.compile(r"\n[ \t]*(?:\*|//)?[ \t]*\n")
COMMENT = r"/\*.*?\*/|//[^\n]*"
LITERAL = r""" "(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*' """.strip()
LEXEME = re.compile(rf"{COMMENT}|{LITERAL}|[{{}}()\[\],]|{DESIGNATOR}|(?m:^)[ \t]*\#[^\n]*", re.S)
MASK = (1 << 128) - 1


def plain(text: str) -> str:
    """Text without the ignored characters and marks; the input is already in lower case."""
    return BLANK.sub("", IGNORED_MARKS.sub("", text).translate(DROP))


def _initializers(text: str) -> tuple[list[str], list[tuple]]:
    """Cut the designated entries out of every initializer of ``text``.

    An entry's name follows its brace or a comma of it, with nothing but blanks, comments and
    directives between; a member that is assigned to (``t.x = 1``) is none. Returns the pieces of
    text outside entries and ``(number of the initializer, name, value fields)`` for each entry.
    Only braces that hold entries are numbered, as others may come and go with the layout.
    Values are cut the same way.
    """
    # Frames of open brackets: [bracket, start of the entry's value, name of the entry or None, number]
    pieces: list[str] = []
    entries: list[tuple] = []
    stack: list[list] = []
    at, number = 0, 0
    inside = 0  # how many open frames are within an entry's value
    may_begin = -1  # an entry may begin here, but for blanks

    def close(frame: list, end: int) -> None:
        nonlocal at, inside
        if frame[2] is None:
            return
        inside -= 1
        if not inside:
            entries.append((frame[3], plain(frame[2]), fields_of(text[frame[1]:end])))
            at = end
        frame[2] = None

    for m in LEXEME.finditer(text):
        t = m.group()
        c = t[0]
        follows = may_begin >= 0 and (may_begin == m.start() or text[may_begin:m.start()].isspace())
        may_begin = -1
        if c in "{([":
            stack.append([c, 0, None, None])
            if c == "{":
                may_begin = m.end()
        elif c in "})]":
            if stack:
                close(stack.pop(), m.start())
        elif c == ",":
            if stack:
                close(stack[-1], m.start())
                may_begin = m.end()
        elif c == ".":
            if follows and stack and stack[-1][0] == "{":
                if not inside:
                    pieces.append(text[at:m.start()])
                    if stack[-1][3] is None:
                        stack[-1][3] = number
                        number += 1
                inside += 1
                stack[-1][1], stack[-1][2] = m.end(), t
        elif follows and c not in "\"'":  # a comment or a directive
            may_begin = m.end()
    pieces.append(text[at:])
    return pieces, entries


def fields_of(text: str) -> tuple:
    """``(skeleton, entries)`` of a lower-case text; equal tuples mean equal records."""
    if "{" not in text or not HAS_INITIALIZER.search(text):
        return plain(text), frozenset()
    pieces, entries = _initializers(text)
    return plain("\x01".join(pieces)), frozenset(Counter(entries).items())


def record_fields(func: str) -> tuple:
    """The fields of a function: those of its body and those of its opening comment."""
    text = func.lower()
    head, tags = "", frozenset()
    if "@" in text and (m := OPENING_COMMENT.match(text)) and COMMENT_ENTRY.search(m.group()):
        comment, text = m.group(), text[m.end():]
        found = list(COMMENT_ENTRY.finditer(comment))
        rest, pairs = [comment[:found[0].start()]], []
        for k, e in enumerate(found):
            end = found[k + 1].start() if k + 1 < len(found) else len(comment)
            if gap := BLANK_COMMENT_LINE.search(comment, e.end(), end):
                rest.append(comment[gap.start():end])
                end = gap.start()
            value = plain(comment[e.end():end])
            bare = value.rstrip("*")  # line decoration belongs to the frame of the comment
            rest.append("*" * (len(value) - len(bare)))
            pairs.append((e.group(1), bare))
        head, tags = plain("".join(rest)), frozenset(Counter(pairs).items())
    body, entries = fields_of(text)
    return head, tags, body, entries


def _hash(seed: int, *parts: str) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest("\x1f".join(parts).encode("utf-8", "surrogatepass"), seed=seed), "big")


def _value(fields: tuple, seed: int) -> str:
    """A value as text: nested entries come in as their multiset hash."""
    skeleton, entries = fields
    return skeleton if not entries else f"{skeleton}\x02{_entries(entries, seed):x}"


def _entries(entries: frozenset, seed: int) -> int:
    return sum(n * _hash(seed + 1, str(k), name, _value(value, seed)) for (k, name, value), n in entries) & MASK


def fingerprint(func: str, seed: int = 0) -> str:
    """128 bits over all fields, independent of the order of entries."""
    head, tags, body, entries = record_fields(func)
    total = _hash(seed + 2, head, body) + _entries(entries, seed) + sum(n * _hash(seed + 3, name, value) for (name, value), n in tags)
    return f"{total & MASK:032x}"


MASKED = re.compile(rf"({COMMENT})|({LITERAL})", re.S)
INNERMOST = re.compile(r"\([^(){}\[\]]*\)|\[[^(){}\[\]]*\]|\{[^(){}\[\]]*\}")
KEPT_COMMENT = re.compile("\x03(\\d+)\x03")
REDUCED_ENTRY = re.compile("((?:\\s|\x03\\d+\x03|\\#[^\\n]*)*)(\\.\\s*[a-z_][^=]*=)(?!=)(.*)", re.S)


def cut_again(func: str, name: Callable[[frozenset], str]) -> tuple:
    """The fields of a function by another way, to check the first: innermost brackets are reduced first.

    A bracket without entries loses its commas; a brace with entries becomes ``name`` of the multiset
    of its entries, and stands in the value of the entry around it.
    """
    text = func.lower()
    tags: frozenset = frozenset()
    opening = OPENING_COMMENT.match(text) if "@" in text else None
    if opening and COMMENT_ENTRY.search(opening.group()):
        first, *found = COMMENT_ENTRY.split(opening.group())
        pairs: Counter = Counter()
        for key, value in zip(found[::2], found[1::2]):
            told, *after = BLANK_COMMENT_LINE.split(value, 1)
            told = plain(told)
            pairs[key, told.rstrip("*")] += 1
            first += (value[value.index(after[0], len(value) - len(after[0])):] if after else "") + told[len(told.rstrip("*")):]
        tags = frozenset(pairs.items())
        first, text = plain(first), text[opening.end():]
    else:
        first = ""
    if not HAS_INITIALIZER.search(text):
        return first, tags, plain(text)
    comments: list[str] = []

    def mask(m: re.Match) -> str:
        if m.group(1) is None:
            return plain(m.group())
        comments.append(plain(m.group()))
        return f"\x03{len(comments) - 1}\x03"

    def bare(part: str) -> str:
        return plain(KEPT_COMMENT.sub(lambda m: comments[int(m.group(1))], part))

    def reduced(m: re.Match) -> str:
        bracket, parts = m.group()[0], m.group()[1:-1].split(",")
        found = [REDUCED_ENTRY.fullmatch(p) for p in parts] if bracket == "{" else [None]
        if not any(found):
            return f" {' '.join(parts)} "
        entries = Counter((bare(e.group(2)), bare(e.group(3))) for e in found if e)
        rest = [f"{e.group(1)}\x01" if e else p for e, p in zip(found, parts)]
        return f" {' '.join(rest)}\x04{name(frozenset(entries.items()))}\x04 "

    text, some = MASKED.sub(mask, text), 1
    while some:
        text, some = INNERMOST.subn(reduced, text)
    return first, tags, bare(text)


def same_fields(a: str, b: str) -> bool:
    """Whether two functions are the same, decided on the texts and not on hashes."""
    names: dict[frozenset, str] = {}
    number = lambda x: names.setdefault(x, str(len(names)))
    return plain(a.lower()) == plain(b.lower()) or cut_again(a, number) == cut_again(b, number)


def second_fingerprint(func: str) -> str:
    """128 bits of the second cut; multisets are hashed by sums as well."""
    name = lambda entries: f"{sum(n * _hash(7919, *e) for e, n in entries) & MASK:x}"
    first, tags, body = cut_again(func, name)
    return f"{_hash(7920, first, name(tags), body):032x}"


@F.pandas_udf(T.StringType())
def fingerprints(func: pd.Series) -> pd.Series:
    return func.map(lambda s: fingerprint(s) if s and not s.isspace() else None)


@F.pandas_udf(T.StructType().add("same", "boolean").add("other", "string"))
def compared(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Whether the fields of both texts are equal; if not, an independent fingerprint of the first."""
    for a, b in pairs:
        same = [same_fields(x, y) for x, y in zip(a, b)]
        yield pd.DataFrame({"same": same, "other": [None if s else second_fingerprint(x) for s, x in zip(same, a)]})


def formatting_duplicates(df: DataFrame, key: str, text: str, order: str, rows_per_salt: int = 50_000) -> DataFrame:
    """``(keep, copy)`` for every record whose text is the same as that of a record of smaller key.

    Re-deliveries (rows of equal key) are reduced to the last by ``order`` first. Null and blank
    texts belong to no group, rows with a null key are left out; an empty table gives no rows.
    Other columns of ``df`` are ignored, whatever their names. Only fingerprints are shuffled to
    find the groups; only texts of groups of two or more move, to the comparison. There, a group
    of n rows is spread over ceil(n / rows_per_salt) salts.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(order).alias("o")).where("k is not null")
    prints = materialize(
        rows.select("k", "o", fingerprints("t").alias("fp")).groupBy("k").agg(F.max_by("fp", F.coalesce("o", F.lit("1000-01-01").cast("timestamp"))).alias("fp")).where("fp is not null"),
        "p1-prints",
    )
    groups = materialize(prints.groupBy("fp").agg(F.min("k").alias("keep"), F.count("*").alias("n")).where("n > 1"), "p1-groups")
    members = materialize(join_groups(prints, groups, "fp", "n").withColumn("salts", F.ceil(F.col("n") / rows_per_salt)), "p1-members")
    texts = probably_among(rows, "k", members).groupBy("k").agg(F.max_by("t", F.coalesce("o", F.lit("1000-01-01").cast("timestamp"))).alias("t"))
    members = members.join(texts, "k")
    kept = members.where("k = keep").select("keep", F.col("t").alias("kept_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    copies = members.where("k <> keep").withColumn("salt", F.pmod(F.xxhash64("k"), "salts"))
    checked = materialize(copies.join(kept, ["keep", "salt"]).select("fp", "keep", "k", compared("t", "kept_text").alias("c")).select("fp", "keep", "k", "c.*"), "p1-checked")
    same = checked.where("same").select("keep", F.col("k").alias("copy"))
    # Unequal fields under one fingerprint are a hash collision: those rows form groups of their own.
    apart = checked.where("not same")
    regrouped = apart.groupBy("fp", "other").agg(F.min("k").alias("keep"))
    return same.unionByName(apart.drop("keep").join(regrouped, ["fp", "other"]).where("k <> keep").select("keep", F.col("k").alias("copy")))


def collapsed(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One row per distinct non-blank record: its smallest key and its number of copies (1: unique)."""
    pairs = formatting_duplicates(df, key, text, order)
    copies = pairs.groupBy("keep").agg(F.count("*").alias("more"))
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("keep")).agg(F.max(F.length(F.trim(F.regexp_replace(F.col(text), r"\s+", "")))).alias("size")).where("size > 0")
    return (rows.join(pairs.select(F.col("copy").alias("keep")), "keep", "left_anti").join(copies, "keep", "left")
            .select("keep", (F.coalesce("more", F.lit(0)) + 1).alias("copies")))
