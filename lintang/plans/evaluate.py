"""Generations to metrics: accuracy, pass@k, maj@k, format rate, per group in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintang.functions.answers import extract_answer, extract_boxed, graded, normalize_answer_text, pass_at_k


def graded_generations(gens: DataFrame, text: str = "text", gold: str = "jawaban", symbolic: bool = True) -> DataFrame:
    """Adds pred, has_boxed and correct."""
    rows = gens.withColumn("pred", extract_answer(F.col(text))).withColumn("has_boxed", extract_boxed(F.col(text)).isNotNull())
    return graded(rows, "pred", gold, symbolic=symbolic)


def majority_votes(rows: DataFrame, by: list[str], index: str, k: int) -> DataFrame:
    """(by, correct): the most frequent normalised prediction of the first k, ties to the one seen first; is it right?

    Votes are counted per normalised prediction before they meet, so a problem never gathers its texts.
    """
    norm = normalize_answer_text(F.col("pred"))
    # rank of the sample in its problem: at most a few per problem, by index
    from pyspark.sql import Window as W

    first = rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(index))).where(F.col("__n") <= k)
    votes = first.where(F.coalesce(F.col("pred"), F.lit("")) != "").groupBy(*by, norm.alias("norm")).agg(
        F.count(F.lit(1)).alias("votes"), F.min(index).alias("seen"), F.max("correct").alias("correct")
    )
    return votes.groupBy(*by).agg(F.max_by("correct", F.struct("votes", -F.col("seen"))).alias("correct"))


def sampled_scores(rows: DataFrame, group: list[str], problem: str, index: str, ks_pass: tuple = (1, 2, 3), ks_majority: tuple = (3, 5)) -> DataFrame:
    """Per group: n problems, mean pass@k, maj@k, format rate (rounded to 4 digits)."""
    by = [*group, problem]
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("c"), F.sum(F.col("has_boxed").cast("int")).alias("boxed")
    )
    for k in ks_majority:
        vote = majority_votes(rows, by, index, k).withColumnRenamed("correct", f"maj{k}")
        counts = counts.join(vote, by, "left").withColumn(f"maj{k}", F.coalesce(F.col(f"maj{k}").cast("int"), F.lit(0)))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return counts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("problems"), F.sum("n").alias("samples"),
        *[mean(pass_at_k(F.col("n"), F.col("c"), k), f"pass_{k}") for k in ks_pass],
        *[mean(F.col(f"maj{k}"), f"maj_{k}") for k in ks_majority],
        F.round(F.sum("boxed") / F.sum("n"), 4).alias("format_ok_rate"),
    )
