"""Long candidate lists, cut into tiles so that the pairs of one list are compared in many tasks.

Every pair of a list is compared, whatever its length; only the balance depends on the sample that finds the long lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.operators.sampling import bounded_top

#: Rows of a list that are compared in one task, the share of rows that is looked at to find long lists, and how many of them are cut.
TILE, SAMPLED, MOST_HOT = 1000, 64, 50_000


def long_lists(rows: DataFrame, lists: Callable[[DataFrame], DataFrame], tile: int | None = None, sampled: int | None = None) -> DataFrame | None:
    """(list_key, parts) of the long lists in a sample of the rows; none if there is no such list."""
    size, one_in = tile or TILE, sampled or SAMPLED
    found = lists(rows.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(one_in)) == 0)).groupBy("list_key").count()
    hot = bounded_top(found.where(F.col("count") * one_in > size), "count", MOST_HOT).select("list_key", F.ceil(F.col("count") * one_in / size).cast("int").alias("parts"))
    return None if hot.isEmpty() else hot


def in_tiles(rows: DataFrame, lists: Callable[[DataFrame], DataFrame], tile: int | None = None, sampled: int | None = None) -> DataFrame:
    """``lists(rows)`` with ``side``: the rows of a long list are cut into parts that meet pair by pair, under a list_key of each tile.

    Two rows of a list meet in one tile and there once, if ``tile_pairs`` is part of the join condition. Long lists are found
    in a sample of the rows; missing one changes the balance, not the result. ``rows`` has a column ``rep``.
    """
    return cut_in_tiles(lists(rows), long_lists(rows, lists, tile, sampled))


def cut_in_tiles(all_rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``in_tiles`` of rows with a list_key, cut by the ``long_lists`` given."""
    if hot is None:
        return all_rows.withColumn("side", F.lit(0))
    cut = all_rows.join(F.broadcast(hot.withColumnRenamed("parts", "_parts")), "list_key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))  # at most MOST_HOT rows
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("_parts")).cast("int")
    tiled = cut.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    number = F.least("_own", "_other") * F.col("_parts") + F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    key = F.when(F.col("_parts") > 1, F.xxhash64("list_key", number)).otherwise(F.col("list_key"))
    return tiled.withColumns({"list_key": key, "side": side}).drop("_own", "_other", "_parts")


def tile_pairs(a: str = "a", b: str = "b") -> Column:
    """Join condition of two aliased tables that ``in_tiles`` made."""
    return (F.col(f"{a}.list_key") == F.col(f"{b}.list_key")) & ((F.col(f"{a}.side") == 0) | (F.col(f"{a}.side") != F.col(f"{b}.side")))
