"""Problem 8: texts that look the same are brought to one form.

Strings and code points that look alike are joined by union-find into transitive classes, built
from the characters that occur in the corpus. Each class is represented by its member that is
most frequent in the corpus, and texts are rewritten greedily, leftmost and longest first, with
an Aho-Corasick automaton over all class members.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.llm.classes import member_pairs
from codegrain.session import materialize
from codegrain.sources.tables import join_groups

# Latin, Greek and Cyrillic letters of the same shape, a class of letters to a row.
SAME_SHAPE = """
A Α А
B Β В
C Ϲ С
E Ε Е
F Ϝ
G Ԍ
H Η Н
I Ι І Ӏ
J Ϳ Ј
K Κ К
M Μ М Ϻ
N Ν
O Ο О
P Ρ Р
Q Ԛ
S Ѕ
T Τ Т
V Ѵ
W Ԝ
X Χ Х
Y Υ У Ү
Z Ζ
a а
c ϲ с
d ԁ
e е
h һ
i і
j ϳ ј
l ӏ
o ο о
p ρ р
q ԛ
s ѕ
v ν ѵ
w ԝ
x х
y у ү
Æ Ӕ
æ ӕ
Ə Ә
ə ә ǝ
Ð Đ Ɖ
Þ Ϸ
þ ϸ
Ɔ Ͻ
ɔ ͻ
Ɛ Ԑ
ɛ ε ԑ
Ɵ Θ Ө Ѳ
ɵ θ ө ѳ
Ʃ Σ
Ʌ Λ
Ʒ Ӡ
ʒ ӡ
Ɯ Ш
ɯ ш
ɑ α
ɣ γ
ɩ ι
ʋ υ
ɜ з
ʙ в
ɢ ԍ
ʜ н
ᴋ κ к
ᴍ м
ᴛ τ т
ᴙ я
Γ Г
Π П
Φ Ф
Ψ Ѱ
ψ ѱ
Ͷ И
ͷ и
"""

# Fillers that are letters by category but draw nothing.
EXTRA_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"


def invisible(c: str) -> bool:
    """Format characters, variation selectors and fillers: nothing is drawn for them."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F or c in EXTRA_INVISIBLE


def blank(c: str) -> bool:
    """Kinds of blank other than ASCII ones; line and paragraph separators are no blanks."""
    return unicodedata.category(c) == "Zs" and c != " "


class Classes:
    """Union-find over strings; the empty string is the class of what cannot be seen."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[b] = a

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


@lru_cache(1)
def shapes() -> list[list[str]]:
    return [line.split() for line in SAME_SHAPE.strip().split("\n")]


def classes_of(alphabet: Iterable[str]) -> Classes:
    """Classes over the code points of a corpus and the strings they look like."""
    alphabet = set(alphabet)
    c = Classes()
    for row in shapes():
        for x in row[1:]:
            c.union(row[0], x)
    for x in alphabet:
        wide = unicodedata.decomposition(x)
        if wide.startswith(("<wide>", "<narrow>")):
            c.union("".join(chr(int(h, 16)) for h in wide.split()[1:]), x)
        elif invisible(x):
            c.union("", x)
        elif blank(x):
            c.union(" ", x)
    # Composed letters: the string of a base letter of the same class and its marks looks the same.
    marks = {x for x in alphabet if unicodedata.combining(x)} | {m for x in alphabet for m in unicodedata.normalize("NFD", x)[1:]}
    bases = {x for x in alphabet if x.isalpha()} | {y for row in shapes() for y in row} | {unicodedata.normalize("NFD", x)[0] for x in alphabet}
    like: dict[str, list[str]] = {}
    for b in bases:
        like.setdefault(c.find(b), []).append(b)
    for group in like.values():
        whole: dict[str, list[str]] = {}
        for b in group:
            for m in marks:
                if len(x := unicodedata.normalize("NFC", b + m)) == 1:
                    whole.setdefault(m, []).append(x)
        for m, xs in whole.items():
            for b in group:
                c.union(xs[0], b + m)
            for x in xs:
                c.union(xs[0], x)
    return c


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Each class member that has to be rewritten, with the most frequent member of its class.

    One ASCII character at most is in a class, and it represents it however frequent the others
    are: ASCII text never changes. What cannot be seen is represented by nothing. Ties go to the
    smaller string.
    """
    out = {}
    for group in classes_of(counts).members().values():
        if len(group) == 1:
            continue
        ascii_ones = [x for x in group if len(x) == 1 and x.isascii()]
        singles = [x for x in group if len(x) == 1]
        best = "" if "" in group else ascii_ones[0] if ascii_ones else min(singles or group, key=lambda x: (-counts.get(x, 0), x))
        out |= {x: best for x in group if x != best}
    return out


class Rewriter:
    """Rewrites texts with an automaton over all members of the classes."""

    def __init__(self, to: dict[str, str]) -> None:
        self.first, self.second = ahocorasick.Automaton(), ahocorasick.Automaton()
        # Marks may stand apart from their letter by invisible characters, so single code points go first.
        for x, y in to.items():
            (self.first if len(x) == 1 else self.second).add_word(x, (len(x), y))
        for a in (self.first, self.second):
            if len(a):
                a.make_automaton()

    @staticmethod
    def _apply(automaton: ahocorasick.Automaton, text: str) -> str:
        if not len(automaton):
            return text
        out, at = [], 0
        for end, (n, y) in automaton.iter_long(text):
            out += text[at:end - n + 1], y
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        # Repeated until nothing changes: a letter joined with its first mark may take another one.
        while (new := self._apply(self.second, unicodedata.normalize("NFC", self._apply(self.first, text)))) != text:
            text = new
        return text


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """``(c, n)``: how often each non-ASCII character occurs; there are at most 1.1 million of them."""
    schema = T.StructType().add("c", "string").add("n", "long")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        total: Counter = Counter()
        for b in batches:
            for s in b["t"]:
                if not s.isascii():
                    total.update(s)
        yield pd.DataFrame({"c": list(total), "n": list(total.values())}).astype({"c": "object", "n": "int64"})

    return df.select(F.col(text).alias("t")).where("t is not null").mapInPandas(count, schema).where("ascii(c) > 127").groupBy("c").agg(F.sum("n").alias("n"))


def unified(df: DataFrame, text: str, into: str = "unified") -> DataFrame:
    """``df`` with a column ``into`` that holds ``text`` in its consistent form.

    Null stays null, the empty text stays empty; every other column is kept. The classes are built
    from all characters of the column: only the table of characters, which Unicode bounds, goes
    through the driver.
    """
    counts = {r["c"]: r["n"] for r in character_counts(df, text).collect()}
    to = df.sparkSession.sparkContext.broadcast(representatives(counts))

    @F.pandas_udf(T.StringType())
    def rewrite(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(to.value)
        for s in texts:
            yield s.map(lambda x: None if x is None else rewriter(x))

    return df.withColumn(into, rewrite(F.col(text)))


def lookalike_classes(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """``(k, spelling, form)`` of every record whose text looks like that of another but is not the same string.

    A form is a class of texts that look the same, a spelling one of its distinct texts; both are
    named by their smallest key. Rows with a null key or text are left out, re-deliveries reduced
    to the last by ``order``. Hot forms and spellings are not brought into one task.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(order).alias("o")).where("k is not null and t is not null")
    sha = lambda c: F.unhex(F.sha2(c, 256))
    hashed = unified(rows, "t", "u").select("k", "o", F.struct(sha("u").alias("form"), sha("t").alias("spelling")).alias("h"))
    last = materialize(hashed.groupBy("k").agg(F.max_by("h", F.coalesce("o", F.lit("1000-01-01").cast("timestamp"))).alias("h")).select("k", "h.*"), "p8-forms")
    spelled = materialize(last.groupBy("form", "spelling").agg(F.min("k").alias("s"), F.count("*").alias("n")), "p8-spellings")
    forms = spelled.groupBy("form").agg(F.min("s").alias("f"), F.count("*").alias("spellings")).where("spellings > 1")
    varied = materialize(join_groups(spelled, forms, "form", "spellings").select("spelling", "s", "f", "n"), "p8-varied")
    return join_groups(last.select("spelling", "k"), varied, "spelling", "n").select("k", F.col("s").alias("spelling"), F.col("f").alias("form"))


def lookalike_pairs(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """``(a, b)``, a < b: records whose texts look the same but are not the same string.

    Only the spellings of a form are paired, then written out as their members; both in parts of
    bounded size. ``lookalike_classes`` gives the same without pairs.
    """
    classes = materialize(lookalike_classes(df, key, text, order), "p8-classes")
    spellings = classes.groupBy("form", "spelling").agg(F.lit(1)).select(F.col("form").alias("rep"), F.col("spelling").alias("k"))
    forms = spellings.select(F.col("rep").alias("l"), F.col("rep").alias("r")).distinct()
    pairs = member_pairs(forms, spellings, spellings).where("left_key < right_key").select(F.col("left_key").alias("l"), F.col("right_key").alias("r"))
    members = classes.select(F.col("spelling").alias("rep"), "k")
    return member_pairs(pairs, members, members).select(F.least("left_key", "right_key").alias("a"), F.greatest("left_key", "right_key").alias("b"))
