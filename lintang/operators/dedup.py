"""Deduplication: best row per key, exact, first, greedy by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.predicates import trimmed
from lintang.session import materialize


def best_per_key(df: DataFrame, key: Column, ranking: list[Column]) -> DataFrame:
    """One row per key, the one with the greatest ranking; rows with a null key are dropped.

    An aggregation over the whole row, so a hot key is reduced before the shuffle instead of being sorted in one task.
    The ranking should end in a unique column; otherwise which of equal rows stays is open.
    """
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(ranking)])
    whole = F.struct(*[F.col(c) for c in df.columns])
    kept = df.where(key.isNotNull()).groupBy(key.alias("__key")).agg(F.max_by(whole, rank).alias("__row"))
    return kept.select("__row.*")


def completeness(question_answer: Column, steps: Column) -> list[Column]:
    """Ranking by (has answer, has steps, length of steps)."""
    a, s = trimmed(question_answer), trimmed(steps)
    return [(a != "").cast("int"), (s != "").cast("int"), F.length(s)]


def most_complete(df: DataFrame, question: str, answer: str, steps: str, order: str) -> DataFrame:
    """Most complete row per question; ties go to the smallest ``order``; blank questions are dropped."""
    key = F.nullif(trimmed(F.col(question)), F.lit(""))
    return best_per_key(df, key, [*completeness(F.col(answer), F.col(steps)), -F.col(order)])


def first_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    return best_per_key(df, key, [-F.col(order)])


def exact_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct trimmed values of the columns."""
    return df.select(*[trimmed(F.col(c)).alias(c) for c in columns]).distinct()


def duplicate_count(df: DataFrame, key: Column) -> DataFrame:
    """(rows, distinct_keys, duplicates) of the non-null keys."""
    return df.select(key.alias("k")).where("k IS NOT NULL").agg(
        F.count("k").alias("rows"), F.countDistinct("k").alias("distinct_keys"), (F.count("k") - F.countDistinct("k")).alias("duplicates")
    )


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept): in id order, a row stays unless it is linked to a smaller row that stays.

    ``edges`` has (a, b) with a < b. Fixpoint: a row is settled once all its smaller neighbours are; the number of
    rounds is the longest chain of links, and each round only carries the open rows.
    """
    links = materialize(edges.select("a", "b").distinct())
    dropped = None
    kept = materialize(nodes.join(links.select(F.col("b").alias("id")), "id", "left_anti").select("id"))
    while True:
        out = links.join(kept.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
        dropped = out if dropped is None else dropped.unionByName(out)
        dropped = materialize(dropped.distinct())
        links = materialize(
            links.join(dropped.withColumnRenamed("id", "b"), "b", "left_anti").join(dropped.withColumnRenamed("id", "a"), "a", "left_anti")
            .join(kept.withColumnRenamed("id", "a"), "a", "left_anti")
        )
        if links.isEmpty():
            break
        starts = links.select(F.col("a").alias("id")).distinct()
        kept = materialize(starts.join(links.select(F.col("b").alias("id")), "id", "left_anti"))
    return nodes.select("id").distinct().join(dropped.withColumn("gone", F.lit(True)), "id", "left").select("id", F.col("gone").isNull().alias("kept"))
