"""Problem 5: the same or almost the same records in two splits.

Similarity hashing: the words of a text, weighted by the root of their frequency, vote on a
512-bit fingerprint. Permutations of the bits each lend a block; blocks are joined across the
splits, where one side also looks up every block with its three closest votes turned. How many
bits a block has follows from the numbers of texts, how many blocks from the recall that is
wanted (``plan``). Candidates must lie within a Hamming radius and agree in length, and an exact
word edit distance decides. Texts of equal words are one class, found by hash before any of
this, so copies cost one fingerprint and never all pairs of candidates.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.llm.classes import member_pairs
from codegrain.session import materialize
from codegrain.sources.tables import join_groups, probably_among

WORD = re.compile(r"[a-z0-9_]+")
BITS, TURNED = 512, 3
WORDS = [f"w{i}" for i in range(BITS // 64)]
#: Measured on functions of the test tables with 15 % of their words replaced, the rarest ones first, which is the hardest case: the chance that
#: a block of 20 bits meets, and what another bit takes of it (.203 at 16 bits, .103 at 20, .052 at 24, .025 at 28; with random edits .366 at 20).
MEETS_20, MEETS_MORE = 0.103, 0.84


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def plan(left: int, right: int, miss: float = 0.003, pair_cost: float = 0.05) -> tuple[int, int]:
    """Bits of a block and number of blocks for ``left`` and ``right`` texts.

    Blocks enough that a pair at 15 % of the hardest edits is missed with probability ``miss``; bits such that the
    rows of the block tables, which are shuffled, and the pairs that meet by chance, which are only compared where
    they meet and cost ``pair_cost`` of a row each, cost least together. At twice
    the texts a block has about one more bit, so the work grows as the 1.2th power of the texts and not with their product.
    """
    def blocks(bits: int) -> int:
        return math.ceil(math.log(miss) / math.log(1 - min(0.9, MEETS_20 * MEETS_MORE ** (bits - 20))))

    turns = 1 << TURNED
    cost = {b: blocks(b) * (left + turns * right + pair_cost * left * right * turns / 2**b) for b in range(8, 49)}
    bits = min(cost, key=cost.get)
    return bits, blocks(bits)


@lru_cache(4)
def permutations(bits: int, blocks: int) -> np.ndarray:
    """Which bits make up each block: random but fixed, every bit used about equally often."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(BITS)[:bits] for _ in range(blocks)])


@lru_cache(1 << 17)
def _word_bits(word: str) -> bytes:
    return hashlib.blake2b(word.encode(), digest_size=BITS // 8).digest()


def votes(counts: Counter) -> np.ndarray:
    """What the bag of words votes for on each bit: positive means 1, the size how clearly."""
    if not counts:
        return np.zeros(BITS, np.float32)
    bits = np.unpackbits(np.frombuffer(b"".join(map(_word_bits, counts)), np.uint8)).reshape(-1, BITS)
    weight = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    return 2 * (weight @ bits.astype(np.float32)) - weight.sum()


def clearness(vote: np.ndarray) -> np.ndarray:
    """How clear each vote of a row is, in 256 steps."""
    size = np.abs(vote)
    return (255 * size / np.maximum(size.max(axis=1, keepdims=True), 1e-9)).astype(np.uint8)


def blocks_of(bits: np.ndarray, clear: np.ndarray | None, block_bits: int, blocks: int) -> np.ndarray:
    """The blocks of each row, numbered; where ``clear`` is given with all ways to turn the closest votes of a block."""
    perm = permutations(block_bits, blocks)
    place = 1 << np.arange(block_bits, dtype=np.int64)
    keys = bits[:, perm].astype(np.int64) @ place + (np.arange(blocks, dtype=np.int64) << block_bits)
    if clear is not None:
        close = np.argpartition(clear[:, perm], TURNED, axis=2)[:, :, :TURNED]
        flips = place[close]
        for i in range(TURNED):
            keys = np.concatenate([keys, keys ^ np.tile(flips[:, :, i], (1, 1 << i))], axis=1)
    return keys


SIGNATURE = T.StructType([T.StructField("words_hash", T.StringType()), T.StructField("n_words", T.IntegerType()), *(T.StructField(w, T.LongType()) for w in WORDS), T.StructField("clear", T.BinaryType())])


def signatures(turned: bool):
    """A function from text to its class, number of words, fingerprint and, if asked for, clearness of the votes."""

    @F.pandas_udf(SIGNATURE)
    def signed(text: pd.Series) -> pd.DataFrame:
        parts = []
        for i in range(0, len(text), 500):
            rows = []
            for s in text.iloc[i:i + 500]:
                ws = words(s) if s and not s.isspace() else None
                rows.append((None, None, votes(Counter())) if ws is None else (hashlib.md5(" ".join(ws).encode()).hexdigest(), len(ws), votes(Counter(ws))))
            vote = np.stack([v for _, _, v in rows])
            df = pd.DataFrame({"words_hash": [h for h, _, _ in rows], "n_words": pd.array([n for _, n, _ in rows], "Int32")})
            df[WORDS] = np.packbits(vote > 0, axis=1).view(np.int64)
            df["clear"] = [x.tobytes() for x in clearness(vote)] if turned else None
            parts.append(df)
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in SIGNATURE.names})

    return signed


def blocked(block_bits: int, blocks: int):
    """A function from a fingerprint, and the clearness of its votes, to its blocks."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cut(clear: pd.Series, fingerprint: pd.DataFrame) -> pd.Series:
        out = []
        for i in range(0, len(clear), 500):
            bits = np.unpackbits(np.ascontiguousarray(fingerprint.iloc[i:i + 500].to_numpy(np.int64)).view(np.uint8), axis=1)
            some = clear.iloc[i:i + 500]
            known = np.frombuffer(b"".join(some), np.uint8).reshape(-1, BITS) if some.notna().any() else None
            out.extend(blocks_of(bits, known, block_bits, blocks))
        return pd.Series(out, dtype=object)

    return cut("clear", F.struct(*WORDS))


def within(a: list[str], b: list[str], limit: int) -> bool:
    """Whether at most ``limit`` insertions, deletions and replacements of words turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > limit:
        return False
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    longer = max(len(a), len(b))
    if longer <= limit:
        return True
    if longer - (Counter(a) & Counter(b)).total() > limit:
        return False
    ids: dict[str, int] = {}
    x = [ids.setdefault(w, len(ids)) for w in a]
    y = np.array([ids.setdefault(w, len(ids)) for w in b], np.int64)
    # Rows of the distance table, restricted to the band of width 2 * limit + 1 around the diagonal.
    big, m = longer + 1, len(y)
    row = np.arange(m + 1)
    row[limit + 1:] = big
    for i, w in enumerate(x, 1):
        first, last = max(0, i - limit), min(m, i + limit)
        j = np.arange(first, last + 1)
        new = row[first:last + 1] + 1
        low = max(first, 1)
        cut = new[low - first:]
        np.minimum(cut, row[low - 1:last] + (y[low - 1:last] != w), out=cut)
        new = np.minimum.accumulate(new - j) + j
        row = np.full(m + 1, big)
        row[first:last + 1] = new
        if new.min() > limit:
            return False
    return bool(row[m] <= limit)


@F.pandas_udf(T.BooleanType())
def alike(a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    """Word edit distance of at most ``percent`` per cent of the longer list (integers: no rounding)."""
    out = []
    for s, t, p in zip(a, b, percent):
        x, y = words(s), words(t)
        out.append(within(x, y, max(len(x), len(y)) * int(p) // 100))
    return pd.Series(out, dtype=bool)


def _side(df: DataFrame, key: str, text: str, order: str, name: str, turned: bool) -> tuple[DataFrame, DataFrame]:
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(order).alias("o")).where("k is not null and t is not null")
    signed = rows.select("k", "o", signatures(turned)("t").alias("s"))
    last = materialize(
        signed.groupBy("k").agg(F.max_by("s", F.coalesce("o", F.lit("1000-01-01").cast("timestamp"))).alias("s")).where("s.words_hash is not null").select("k", "s.*"), f"p5-{name}"
    )
    return last, rows


def _texts(rows: DataFrame, keys: DataFrame, key: str, into: str) -> DataFrame:
    """The last text of each of the keys; rows of other keys are dropped where they are read."""
    keys = keys.select(F.col(key).alias("k")).distinct()
    last = probably_among(rows, "k", keys).groupBy("k").agg(F.max_by("t", F.coalesce("o", F.lit("1000-01-01").cast("timestamp"))).alias("t"))
    return last.select(F.col("k").alias(key), F.col("t").alias(into))


def _hot(a: DataFrame, b: DataFrame, pairs: int, sample: int = 64) -> DataFrame:
    """``(block, salts)`` of the blocks with, by a sample of both sides, over ``pairs`` pairs; few thousand at most."""
    def counts(df: DataFrame, x: str) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(x), F.lit(sample)) == 0).groupBy("block").agg((F.count("*") * sample).alias(f"{x}many"))

    many = counts(a, "l").join(counts(b, "r"), "block").withColumn("salts", F.ceil(F.col("lmany") * F.col("rmany") / pairs))
    return many.where("salts > 1").select("block", "salts")


def cross_split(left: DataFrame, right: DataFrame, key: str, text: str, order: str, percent: int = 15, miss: float = 0.003, radius: float = 0.275, radius_of_128: float = 0.285, pairs_per_task: int = 50_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between text classes of two splits, and the members of the classes on either side.

    Returns ``(links(l, r), left members(rep, k), right members(rep, k))``: a class holds the
    records of a split with equal word lists and is named by its smallest key. Rows with null key,
    null or blank text match nothing; re-deliveries are reduced to the last by ``order``; other
    columns of the inputs are ignored. A text without any word equals only its like.

    ``miss`` is the chance to miss a pair at 15 % of the hardest edits, from which the blocks follow. ``radius`` is
    the share of all bits in which candidates may differ, ``radius_of_128`` the share of the 128 that travel with a block:
    pairs at 15 % of edits differ in .11 of the bits, .24 at most, unrelated ones in .45. Blocks of over ``pairs_per_task`` pairs are split.
    """
    signed, rows = zip(_side(left, key, text, order, "left", False), _side(right, key, text, order, "right", True))
    classes, members = [], []
    for s, x in zip(signed, ("left", "right")):
        c = materialize(s.groupBy("words_hash").agg(F.min("k").alias("rep"), F.count("*").alias("n"), *[F.first(w).alias(w) for w in ("n_words", *WORDS, "clear")]), f"p5-{x}-classes")
        classes.append(c)
        members.append(join_groups(s.select("words_hash", "k"), c.select("words_hash", "rep", "n"), "words_hash", "n").select("rep", "k"))
    blocks = blocked(*plan(*(c.count() for c in classes), miss))
    a, b = (c.select(F.explode(blocks).alias("block"), F.col("rep").alias(x), F.col("n_words").alias(f"{x}n"), *[F.col(w).alias(f"{x}{w}") for w in WORDS[:2]]) for c, x in zip(classes, "lr"))
    hot = materialize(_hot(a, b, pairs_per_task), "p5-hot")
    if hot.isEmpty():
        on = ["block"]
    else:
        on = ["block", "salt"]
        a, b = (x.join(F.broadcast(hot), "block", "left").withColumn("salts", F.coalesce("salts", F.lit(1))) for x in (a, b))
        a = a.withColumn("salt", F.pmod(F.xxhash64("l"), "salts"))
        b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    differ = lambda ws: sum(F.bit_count(F.col(f"l{w}").bitwiseXOR(F.col(f"r{w}"))) for w in ws)
    apart = differ(WORDS[:2])
    near = (F.abs(F.col("ln") - F.col("rn")) * 100 <= percent * F.greatest("ln", "rn")) & (apart <= int(radius_of_128 * 128))
    # Hints to merge: what Spark would broadcast by its size as written is many times as large in the driver.
    candidates = a.hint("merge").join(b, on).where(near).select("l", "r", apart.alias("apart")).distinct()
    for c, x in zip(classes, "lr"):
        candidates = candidates.hint("merge").join(c.select(F.col("rep").alias(x), *[F.col(w).alias(x + w) for w in WORDS[2:]]), x)
    rest = differ(WORDS[2:])
    candidates = materialize(candidates.where(F.col("apart") + rest <= int(radius * BITS)).select("l", "r"), "p5-candidates")
    pairs = candidates.hint("merge").join(_texts(rows[1], candidates, "r", "rt"), "r").hint("merge").join(_texts(rows[0], candidates, "l", "lt"), "l")
    links = materialize(pairs.where(alike("lt", "rt", F.lit(percent))).select("l", "r"), "p5-links")
    return links, *members


def overlapping_pairs(left: DataFrame, right: DataFrame, key: str, text: str, order: str, percent: int = 15) -> DataFrame:
    """Every pair ``(left_key, right_key)`` of same or almost the same records, copies written out."""
    return member_pairs(*cross_split(left, right, key, text, order, percent))


def overlap_report(left: DataFrame, right: DataFrame, key: str, text: str, order: str, source: str, names: tuple[str, str], percent: int = 15) -> DataFrame:
    """Per split and source: records, records with a partner in the other split, and partners in all.

    Counted through the classes, so copies are never written out as pairs. A null source is a source.
    """
    links, *members = cross_split(left, right, key, text, order, percent)
    parts = []
    for side, (df, own, other) in enumerate(((left, "l", "r"), (right, "r", "l"))):
        size = members[1 - side].groupBy(F.col("rep").alias(other)).agg(F.count("*").alias("n"))
        linked = links.join(size, other).groupBy(F.col(own).alias("rep")).agg(F.sum("n").alias("n"))
        hits = members[side].join(linked, "rep").select("k", "n")
        rows = (df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
                .agg(F.max_by(F.col(source), F.coalesce(F.col(order), F.lit("1000-01-01").cast("timestamp"))).alias("source")))
        parts.append(rows.join(hits, "k", "left").groupBy("source").agg(
            F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("partners"),
        ).select(F.lit(names[side]).alias("split"), "source", "records", "overlapping", "partners"))
    return parts[0].unionByName(parts[1])
