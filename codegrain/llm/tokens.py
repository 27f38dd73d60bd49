"""Sizes and cuts in tokens of a public tokenizer, whose file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this family of vocabularies cuts text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def load(path: str, pattern: str = PATTERN):
    """A byte-level tokenizer from a file of ranks; no text is special to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def size(text: str, path: str = TOKENIZER) -> int:
    return len(load(path).encode_ordinary(text))


def count(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens; null for null, 0 for the empty text."""

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else size(x, path) for x in s], dtype="Int64")

    return counted(text)


def character_starts(parts: list[bytes]) -> list[int]:
    """For each token the number of characters that begin before it; one within a character belongs to its end."""
    out, n = [], 0
    for p in parts:
        out.append(n)
        n += sum(b & 0xC0 != 0x80 for b in p)
    return out


def cuts(text: str, capacity: int, path: str = TOKENIZER) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` of consecutive parts of a text of at most ``capacity`` tokens each.

    Parts are as long as they can be while ending before a token that begins with a letter after
    one blank, where a tokenizer that works word by word cuts the parts as it cuts the whole;
    the tokens of every part are counted on the part itself.
    """
    t = load(path)
    out, start = [], 0
    while start < len(text):
        rest = text[start:]
        ids = t.encode_ordinary(rest)
        if len(ids) <= capacity:
            out.append((start, len(text), len(ids)))
            break
        starts = character_starts(t.decode_tokens_bytes(ids[: capacity + 1]))
        stop = capacity
        while stop > capacity // 2:
            a = starts[stop]
            if a and rest[a] == " " and rest[a + 1:a + 2].isalpha() and not rest[a - 1].isspace():
                break
            stop -= 1
        else:
            stop = capacity
        end = start + starts[stop]
        while end > start + 1 and size(text[start:end], path) > capacity:  # a character may be several tokens
            stop -= 1
            end = start + starts[stop]
        end = max(end, start + 1)
        out.append((start, end, size(text[start:end], path)))
        start = end
    return out
