"""Near-duplicate records with small edits (problem 4).

Method: MinHash signatures are cut into bands; rows that agree in a band are candidates. An odd sketch of the word set (a
parity bitmap) goes with each row; no more bits of two sketches can differ than words stand in one set only, so candidates
that differ in too many are dropped inside the join, before anything is shuffled, and none of them is a pair. What is left
is checked exactly on the word sets. The bands of large tables are joined in passes of ``at_once``, and the files of a pass
go before the next one begins.

Defined cases: null, empty and short texts (fewer than ``min_words`` distinct words) are in no class and no
pair; rows with equal word sets are one class with similarity 1; ties do not arise, pairs are (smaller id,
larger id); an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintang.llm.setjoin import expand, membership, odd_sketches, salted_join, sketches_allow, stored_classes, verified_pairs, word_sets
from lintang.operators.tiles import cut_in_tiles, long_lists, tile_pairs
from lintang.session import materialize


@dataclass(frozen=True)
class SketchParameters:
    """``bands`` x ``rows`` MinHash values find candidates; an odd sketch of 64 * ``words`` bits prunes them.

    A pair of similarity 0.75 misses all 30 bands of 5 rows with probability 0.0003, one of 0.8 with 6e-6.
    """

    bands: int = 30
    rows: int = 5
    words: int = 4
    at_once: int = 10
    seed: int = 20240607


#: Up to so many classes, all bands are joined at once. Hash functions drawn beyond those of the bands, which fixes the latter.
SMALL, SPARE = 20_000, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def band_keys(hash_lists: list[np.ndarray], p: SketchParameters, bands: range) -> np.ndarray:
    """Keys of those bands of the given non-empty arrays of word hashes, one row each, as int64."""
    rng = np.random.default_rng(p.seed)
    count = p.bands * p.rows + SPARE
    factor = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, count, dtype=np.uint64)
    weight = rng.integers(1, 2**63, p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.cumsum([0] + [len(h) for h in hash_lists[:-1]])
    values = np.empty((len(hash_lists), len(bands) * p.rows), dtype=np.uint64)
    mixed = _mix(np.concatenate(hash_lists).view(np.uint64))
    for k in range(values.shape[1]):  # one function at a time keeps memory at the size of the batch
        at = bands[0] * p.rows + k
        values[:, k] = np.minimum.reduceat(mixed * factor[at] + shift[at], starts)
    banded = values.reshape(len(hash_lists), len(bands), p.rows)
    return _mix((banded * weight).sum(axis=2, dtype=np.uint64) + np.array(bands, dtype=np.uint64) + np.uint64(1)).view(np.int64)


def signed_classes(classes: DataFrame, p: SketchParameters, bands: range) -> DataFrame:
    """(rep, n, bands, s0, s1, ..) of each class: its size, the keys of those bands and its odd sketch."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                hashes = [np.asarray(h, dtype=np.int64) for h in part["hashes"]]
                sketches = odd_sketches(hashes, p.words)
                out = pd.DataFrame({"rep": part["rep"].to_numpy(), "n": [len(h) for h in hashes], "bands": list(band_keys(hashes, p, bands))})
                yield out.assign(**{f"s{i}": sketches[:, i] for i in range(p.words)})

    words = ", ".join(f"s{i} bigint" for i in range(p.words))
    return classes.select("rep", "hashes").mapInPandas(sketch, f"rep bigint, n int, bands array<bigint>, {words}")


def candidate_pairs(classes: DataFrame, threshold: float, p: SketchParameters, tile: int | None = None, sampled: int | None = None) -> DataFrame:
    """Distinct (a, b) of class representatives that share a band and pass the size and sketch filters inside the join.

    Long bands are compared in tiles, so the pairs of one band are spread over many tasks.
    """
    names = [f"s{i}" for i in range(p.words)]
    at_once = p.bands if p.at_once >= p.bands or classes.count() <= SMALL else p.at_once
    close = tile_pairs() & (F.col("a.rep") < F.col("b.rep")) & sketches_allow(threshold, p.words)
    lists = lambda rows, bands: signed_classes(rows, p, bands).select(F.explode("bands").alias("list_key"), "rep", "n", *names)
    hot = long_lists(classes, lambda rows: lists(rows, range(p.bands)), tile, sampled)
    found = None
    for first in range(0, p.bands, at_once):
        banded = cut_in_tiles(lists(classes, range(first, min(first + at_once, p.bands))), hot)
        pairs = banded.alias("a").join(banded.alias("b"), close).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
        pairs = pairs if at_once == p.bands else materialize(pairs)
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def near_duplicate_classes(
    df: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = 0.8,
    min_words: int = 1,
    parameters: SketchParameters = SketchParameters(),
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets, classes, members, links): classes (rep, members, key, hashes), members (id, rep, members, chunk) of classes of two or
    more, and linked classes (a, b, members_a, members_b, similarity)."""
    sets, classes = stored_classes(word_sets(df, id_col, F.col(text_col), min_words))
    links = materialize(verified_pairs(candidate_pairs(classes, threshold, parameters), classes, classes, threshold))
    return sets, classes, membership(sets, classes), links


def near_duplicate_membership(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """(id, rep, members, links): each row with its class, the size of the class, and how many other classes are linked to it."""
    sets, classes, _, links = near_duplicate_classes(df, id_col, text_col, threshold, min_words)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    of_class = classes.select("key", "rep", "members").join(ends, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    # single rows are their class; the others meet it by key and salt
    single = of_class.where("members = 1").select(F.col("rep").alias("id"), "rep", "members", "links")
    several = salted_join(sets.select("id", "key"), of_class.where("members > 1"), ["key"], "id")
    return single.unionByName(several.select("id", "rep", "members", "links"))


def near_duplicate_pairs(
    df: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = 0.8,
    min_words: int = 1,
    parameters: SketchParameters = SketchParameters(),
) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: all pairs of rows with similarity >= threshold, copies included."""
    _, classes, members, links = near_duplicate_classes(df, id_col, text_col, threshold, min_words, parameters)
    within = classes.where("members > 1").select(
        F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("members").alias("members_a"), F.col("members").alias("members_b"), F.lit(1.0).alias("similarity")
    )
    across = expand(links, members, members).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")
    # within a class both orders and the row itself come up
    return across.unionByName(expand(within, members, members).where("id_a < id_b"))
