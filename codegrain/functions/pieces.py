"""A lossless tokenizer in plain expressions: words, runs of white space, single other characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"[A-Za-z0-9_]+|[ \t\r\n]+|[^A-Za-z0-9_ \t\r\n]"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def count_of(text: Column) -> Column:
    return F.coalesce(F.size(pieces(text)), F.lit(0))


def text_of(parts: Column) -> Column:
    return F.array_join(parts, "")


def ids(parts: Column) -> Column:
    """A number for each piece, the same everywhere: the first 28 bits of its MD5."""
    return F.transform(parts, lambda p: F.conv(F.left(F.md5(p.cast("binary")), F.lit(7)), 16, 10).cast("long"))
