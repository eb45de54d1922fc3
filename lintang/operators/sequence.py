"""Order-dependent operators inside documents and problems.

A document may hold a large share of all rows, so documents are not sorted in one task each: rows are cut into blocks by
(document, order), windows run inside the blocks, and what a block needs from the blocks before it is carried over from
one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintang.functions.predicates import trimmed
from lintang.session import materialize


def in_blocks(df: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Adds ``__b``: blocks of consecutive rows of a document, cut by ranges of (document, order); stored, so that they stay the same."""
    return materialize(df.repartitionByRange(*[F.col(c) for c in (document, *order)]).withColumn("__b", F.spark_partition_id()))


def _joined(rows: DataFrame, blocks: DataFrame, document: str) -> DataFrame:
    """Rows with the columns of their block; a null document is a document."""
    other = blocks.withColumnsRenamed({document: "__d", "__b": "__c"})
    return rows.join(other, F.col(document).eqNullSafe(F.col("__d")) & (F.col("__b") == F.col("__c"))).drop("__d", "__c")


def _inside(document: str, order: list[str]):
    return W.partitionBy(document, "__b").orderBy(*order)


def running_sum(blocked: DataFrame, document: str, order: list[str], flag: Column, out: str) -> DataFrame:
    """Adds the sum of ``flag`` over all rows of the document up to each row."""
    rows = blocked.withColumn("__f", F.coalesce(flag.cast("bigint"), F.lit(0)))
    totals = rows.groupBy(document, "__b").agg(F.sum("__f").alias("__t"))
    earlier = W.partitionBy(document).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(document, "__b", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__s"))
    summed = rows.withColumn("__i", F.sum("__f").over(_inside(document, order).rowsBetween(W.unboundedPreceding, 0)))
    return _joined(summed, before, document).withColumn(out, F.col("__i") + F.col("__s")).drop("__f", "__i", "__s")


def previous_value(blocked: DataFrame, document: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``value`` of the row before, null for the first row of a document."""
    ends = blocked.groupBy(document, "__b").agg(F.max_by(value, F.struct(*order)).alias("__e"))
    before = ends.select(document, "__b", F.lag("__e").over(W.partitionBy(document).orderBy("__b")).alias("__p"))
    w = _inside(document, order)
    rows = blocked.withColumn("__l", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return _joined(rows, before, document).withColumn(out, F.when(F.col("__n") == 1, F.col("__p")).otherwise(F.col("__l"))).drop("__l", "__n", "__p")


def continuation_merge(items: DataFrame, document: str, order: list[str], kind: str, steps: str, answer: str) -> DataFrame:
    """Each ``lanjutan`` row adds its steps to the ``soal`` row before it and fills its empty answer; orphans are dropped."""
    blocked = in_blocks(items.where(F.col(kind).isin("soal", "lanjutan")), document, order)
    rows = running_sum(blocked, document, order, F.col(kind) == "soal", "__g")
    part = F.struct(*[F.col(c) for c in order], trimmed(F.col(steps)).alias("s"), trimmed(F.col(answer)).alias("a"))
    merged = rows.where("__g > 0").groupBy(document, "__g").agg(F.array_sort(F.collect_list(part)).alias("p"))
    filled = lambda name: F.filter(F.col("p")[name], lambda x: x != "")
    return merged.select(
        document, *[F.col("p")[0][c].alias(c) for c in order], F.array_join(filled("s"), "\n").alias(steps),
        F.coalesce(F.try_element_at(filled("a"), F.lit(1)), F.lit("")).alias(answer), F.size("p").alias("parts"),
    )


def pending_questions(blocks: DataFrame, document: str, order: list[str], text: str, numbered: str, complete: str) -> DataFrame:
    """Blocks without number that follow an incomplete block are joined to it, page after page."""
    rows = previous_value(in_blocks(blocks, document, order), document, order, complete, "__before")
    begins = F.col(numbered) | F.coalesce(F.col("__before"), F.lit(True))
    grouped = running_sum(rows, document, order, begins, "__g")
    part = F.struct(*[F.col(c) for c in order], F.col(text).alias("t"))
    return grouped.groupBy(document, "__g").agg(F.array_sort(F.collect_list(part)).alias("p")).select(
        document, *[F.col("p")[0][c].alias(c) for c in order], F.array_join(F.col("p")["t"], "\n").alias(text), F.size("p").alias("parts")
    )


def carry_down(df: DataFrame, document: str, order: str, value: str, out: str) -> DataFrame:
    """Adds the latest non-null ``value`` at or before each row of a document."""
    blocked = in_blocks(df, document, [order])
    ends = blocked.groupBy(document, "__b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__e"))
    earlier = W.partitionBy(document).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select(document, "__b", F.last("__e", ignorenulls=True).over(earlier).alias("__s"))
    rows = blocked.withColumn("__i", F.last(value, ignorenulls=True).over(_inside(document, [order]).rowsBetween(W.unboundedPreceding, 0)))
    return _joined(rows, before, document).withColumn(out, F.coalesce("__i", "__s")).select(*df.columns, out)


def top_k(df: DataFrame, key: str, ranking: list[Column], k: int | None) -> DataFrame:
    """First k rows of each key; None keeps all. The ranking should end in a unique column."""
    if k is None:
        return df
    w = W.partitionBy(key).orderBy(*ranking)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
