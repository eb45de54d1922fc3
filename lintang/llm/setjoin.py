"""Shared parts of the set-similarity operators: classes of equal word sets, hot lists in tiles, verification, expansion.

Texts with the same set of distinct words form one class. Candidate search and verification run over one
representative per class, so a text that stands in a third of all rows costs no more than a single row.

Nothing hangs on one key: members of a class meet it by (key, salt) and are numbered into chunks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.words import distinct_word_hashes
from lintang.session import materialize, release, spread

CHUNK = 512
SALTS = 16


def word_sets(df: DataFrame, id_col: str, text: Column, min_words: int) -> DataFrame:
    """(id, hashes, key) of the rows whose text has at least ``min_words`` distinct words; stored, so words are hashed once."""
    hashed = spread(df.select(F.col(id_col).alias("id"), text.alias("text")), 1).select("id", distinct_word_hashes(F.col("text")).alias("hashes"))
    key = F.struct(*[F.xxhash64(F.lit(seed), "hashes").alias(name) for seed, name in ((1, "x"), (2, "y"))])  # 128 bits
    return materialize(hashed.where(F.size("hashes") >= max(min_words, 1)).withColumn("key", key))


def set_classes(sets: DataFrame) -> DataFrame:
    """(rep, members, key, hashes): one row per distinct word set; ``rep`` is the smallest id. Copies are counted before the shuffle."""
    return sets.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("hashes").alias("hashes"))


def stored_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key) of ``sets`` and their classes, both stored; the hashes stay with the classes only, ``sets`` is deleted."""
    classes, keys = materialize(set_classes(sets)), materialize(sets.select("id", "key"))
    release(sets)
    return keys, classes


def odd_sketches(hash_lists: list[np.ndarray], words: int) -> np.ndarray:
    """Odd sketch of each set of word hashes as ``words`` (a power of two) int64: bit k is the parity of the hashes in its class k.

    Each word that only one of two sets has turns one bit of the XOR, so no more bits than such words can differ.
    """
    bits = 64 * words
    flat = np.concatenate(hash_lists).view(np.uint64)
    mixed = (flat ^ (flat >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    place = (mixed >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    owner = np.repeat(np.arange(len(hash_lists)), [len(h) for h in hash_lists])
    odd = (np.bincount(owner * bits + place, minlength=len(hash_lists) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1, bitorder="little").view(np.int64)


def sketches_allow(threshold: float, words: int) -> Column:
    """Rows a and b (n, s0, s1, ..) may have that Jaccard similarity. Exact: at most (1 - t) / (1 + t) of n_a + n_b words are in one set only."""
    apart = [F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(words)]
    most = (1 - threshold) / (1 + threshold) * (F.col("a.n") + F.col("b.n"))
    return (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")) & (sum(apart[1:], apart[0]) <= most + 1e-6)


def membership(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, rep, members, chunk) of the rows in classes of two or more; a chunk has about CHUNK rows.

    Rows meet their class by (key, salt), so that a class with a third of all rows is spread over SALTS tasks.
    """
    several = classes.where("members > 1").select("key", "rep", "members")
    chunk = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("members") / CHUNK)).cast("int")
    return salted_join(sets.select("id", "key"), several, ["key"], "id").select("id", "rep", "members", chunk.alias("chunk"))


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Inner join of rows with one row per group; the rows of a group are spread over SALTS tasks by ``spread_by``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def verified_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Keep the (a, b) whose exact Jaccard similarity is at least ``threshold``; adds ``similarity``.

    ``left`` and ``right`` hold (rep, members, hashes) of the classes on either side.
    """
    checked = with_sets(pairs, left, right).withColumn("common", F.size(F.array_intersect("hashes_a", "hashes_b")))
    union = F.size("hashes_a") + F.size("hashes_b") - F.col("common")
    # compared as common >= threshold * union, free of rounding for thresholds such as 3/4
    return checked.where(F.col("common") >= threshold * union).select("a", "b", "members_a", "members_b", (F.col("common") / union).alias("similarity"))


def with_sets(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) with members and hashes of both sides."""
    a = left.select(F.col("rep").alias("a"), F.col("members").alias("members_a"), F.col("hashes").alias("hashes_a"))
    b = right.select(F.col("rep").alias("b"), F.col("members").alias("members_b"), F.col("hashes").alias("hashes_b"))
    return pairs.join(a, "a").join(b, "b")


def expand(pairs: DataFrame, members_a: DataFrame, members_b: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity) for all members of the paired classes (a, b, members_a, members_b, similarity).

    A class of one is its own representative; larger ones are crossed chunk by chunk, so that no join key carries more than
    CHUNK x CHUNK results.
    """
    chunks = lambda c: F.sequence(F.lit(0), (F.ceil(F.col(c) / CHUNK) - 1).cast("int"))
    tiles = pairs.withColumn("chunk_a", F.explode(chunks("members_a"))).withColumn("chunk_b", F.explode(chunks("members_b")))
    out = None
    for single_a in (True, False):
        part = tiles.where("members_a = 1" if single_a else "members_a > 1")
        a = members_a.select(F.col("rep").alias("a"), F.col("chunk").alias("chunk_a"), F.col("id").alias("id_a"))
        part = part.withColumn("id_a", F.col("a")) if single_a else part.join(a, ["a", "chunk_a"])
        for single_b in (True, False):
            both = part.where("members_b = 1" if single_b else "members_b > 1")
            b = members_b.select(F.col("rep").alias("b"), F.col("chunk").alias("chunk_b"), F.col("id").alias("id_b"))
            both = both.withColumn("id_b", F.col("b")) if single_b else both.join(b, ["b", "chunk_b"])
            both = both.select("id_a", "id_b", "similarity")
            out = both if out is None else out.unionByName(both)
    return out
