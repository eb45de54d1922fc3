"""Audits: rule counters, cleaning reasons, inspection flags, statistics of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.answers import answer_from_steps, answer_shape, extract_boxed, graded
from lintang.functions.predicates import is_garbled, needs_external_context, text_or_empty, trimmed
from lintang.functions.text import squeeze


def reason_counts(df: DataFrame, reason: Column, by: list[str] = ()) -> DataFrame:
    """(by, reason, rows); accepted rows have the reason ``passed``."""
    return df.withColumn("reason", F.coalesce(reason, F.lit("passed"))).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("rows"))


def cleaning_reasons(df: DataFrame, drop_text: bool = False, drop_mismatch: bool = True, symbolic: bool = True) -> DataFrame:
    """Adds ``reason`` (null: keep), in priority: empty answer, short question, garbled, outside context, steps against answer, free text."""
    rows = df.withColumn("__p", answer_from_steps(F.col("cara")))
    rows = graded(rows, "__p", "jawaban", "__ok", symbolic)
    question = trimmed(F.col("soal"))
    broken = is_garbled(F.col("soal")) | is_garbled(F.col("jawaban")) | is_garbled(F.col("cara"))
    reason = F.when(trimmed(F.col("jawaban")) == "", "jawaban_kosong").when(F.length(question) < 20, "soal_rusak").when(broken, "mojibake")
    reason = reason.when(needs_external_context(question), "butuh_konteks_luar")
    if drop_mismatch:
        reason = reason.when((text_or_empty(F.col("cara")) != "") & F.col("__p").isNotNull() & ~F.col("__ok"), "cara_vs_gold_mismatch")
    if drop_text:
        reason = reason.when(answer_shape(F.col("jawaban")) == "text", "jawaban_teks_bebas")
    return rows.withColumn("reason", reason).drop("__p", "__ok")


def inspection(df: DataFrame, by: list[str]) -> DataFrame:
    """Flag counts of gold rows per group."""
    flag = lambda c, name: F.sum(c.cast("int")).alias(name)
    soal, jawaban = F.col("soal"), F.col("jawaban")
    key = squeeze(soal)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), flag(trimmed(soal) == "", "empty_question"), flag(trimmed(jawaban) == "", "empty_answer"),
        flag(is_garbled(soal) | is_garbled(jawaban), "garbled"), flag(needs_external_context(soal), "outside_context"),
        (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicates"),
        *[flag(answer_shape(jawaban) == s, f"shape_{s}") for s in ("empty", "numeric", "fraction", "text", "expr")],
    )


def chat_inspection(df: DataFrame, arm: str) -> DataFrame:
    from lintang.functions.text import last_message

    said, asked = last_message(F.col("messages"), "assistant"), last_message(F.col("messages"), "user")
    flag = lambda c, name: F.sum(c.cast("int")).alias(name)
    return df.groupBy(arm).agg(
        F.count(F.lit(1)).alias("rows"), flag(trimmed(said) == "", "empty_reply"), flag(trimmed(asked) == "", "empty_prompt"),
        flag(extract_boxed(said).isNull(), "no_box"), flag(is_garbled(said), "garbled"), flag(F.length(said) > 2500, "very_long"),
    )


def answer_distribution(df: DataFrame, by: list[str], answer: Column) -> DataFrame:
    """Normalised entropy of the answers and the share of the most frequent one, rounded to 3 digits; 0 with fewer than two answers."""
    counts = df.withColumn("__a", answer).where("__a <> ''").groupBy(*by, "__a").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy(*by).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_answers"), F.max("c").alias("top"), F.sum(F.col("c") * F.log2("c")).alias("s")
    )
    entropy = F.when(F.col("distinct_answers") < 2, 0.0).otherwise((F.log2("n") - F.col("s") / F.col("n")) / F.log2("distinct_answers"))
    return sums.select(*by, "n", "distinct_answers", F.round(entropy, 3).alias("entropy"), F.round(F.col("top") / F.col("n"), 3).alias("top_share"))


def length_outliers(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Share of texts with a robust z above 3.5 (median, MAD; mean deviation if MAD is 0), rounded to 3 digits; blank texts are left out.

    Lengths are counted first, so exact medians come from a table of distinct lengths.
    """
    sizes = df.select(*by, F.length(text).alias("len")).where("len > 0")
    centre = sizes.groupBy(*by).agg(F.median("len").alias("med"), F.count(F.lit(1)).alias("n"))
    apart = sizes.join(centre, by).withColumn("d", F.abs(F.col("len") - F.col("med")))
    spread = apart.groupBy(*by).agg(F.median("d").alias("mad"), F.avg("d").alias("mean_ad"))
    z = F.when(F.col("mad") > 0, 0.6745 * F.col("d") / F.col("mad")).when(F.col("mean_ad") > 0, F.col("d") / (1.253314 * F.col("mean_ad"))).otherwise(0.0)
    out = apart.join(spread, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((z > 3.5).cast("int")).alias("rate"))
    return out.select(*by, "n", F.when(F.col("n") < 3, 0.0).otherwise(F.round("rate", 3)).alias("outlier_rate"))


def shape_crosstab(df: DataFrame, row: str, shape: Column, shapes: list[str]) -> DataFrame:
    return df.withColumn("__s", shape).groupBy(row).pivot("__s", shapes).agg(F.count(F.lit(1))).na.fill(0)


def funnel(stages: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(step, stage, problems, share of the first stage)."""
    rows = None
    for step, (name, df, key) in enumerate(stages):
        one = df.agg(F.countDistinct(key).alias("problems")).select(F.lit(step).alias("step"), F.lit(name).alias("stage"), "problems")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.where("step = 0").select(F.col("problems").alias("f"))
    return rows.join(F.broadcast(first), F.lit(True)).select("step", "stage", "problems", F.round(F.try_divide("problems", "f"), 4).alias("share"))
