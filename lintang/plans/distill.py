"""Candidates to verified chat pairs: rejection sampling, teacher comparison, training sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.answers import extract_boxed_loose, normalize_answer_loose
from lintang.functions.predicates import is_indonesian, text_or_empty, trimmed
from lintang.functions.text import clean_solution, solution_rank, squeeze, training_target, wrap_prompt, chat_messages
from lintang.operators.dedup import best_per_key
from lintang.operators.joins import decontaminate, without_done
from lintang.operators.sequence import top_k

Judge = Callable[[DataFrame], DataFrame]


def judged(candidates: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Adds ``pred`` and ``status``: no_boxed, no_gold, kept (by the prefilter or the judge), wrong.

    ``judge`` gets only the undecided rows and adds a boolean ``judged_correct``; without it they are wrong.
    """
    pred, gold = extract_boxed_loose(F.col("text")), trimmed(F.col("jawaban"))
    equal = normalize_answer_loose(pred) == normalize_answer_loose(F.col("jawaban"))
    status = F.when(F.col("pred").isNull(), "no_boxed").when(gold == "", "no_gold").when(equal & (normalize_answer_loose(pred) != ""), "kept").otherwise("open")
    rows = candidates.withColumn("pred", pred).withColumn("status", status)
    if judge is None:
        return rows.withColumn("status", F.when(F.col("status") == "open", "wrong").otherwise(F.col("status")))
    decided = judge(rows.where("status = 'open'")).withColumn("status", F.when(F.col("judged_correct"), "kept").otherwise("wrong")).drop("judged_correct")
    return rows.where("status <> 'open'").unionByName(decided)


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """One row per (id, candidate_idx): repeats are full duplicates but for the time they were made; the earliest stays."""
    key = F.when(F.col("id").isNotNull() & F.col("candidate_idx").isNotNull(), F.struct("id", "candidate_idx"))
    order = [-F.unix_micros("made_at")] if "made_at" in candidates.columns else []
    return best_per_key(candidates, key, [*order, F.xxhash64("text")])


def rejection_sampling(candidates: DataFrame, done: list[DataFrame] = (), judge: Judge | None = None) -> DataFrame:
    return judged(without_done(distinct_candidates(candidates), list(done), ["id", "candidate_idx"]), judge)


def sampling_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    count = lambda s: F.sum((F.col("status") == s).cast("int")).alias(s)
    solved = F.countDistinct(F.when(F.col("status") == "kept", F.col("id"))).alias("problems_covered")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), count("no_boxed"), count("no_gold"), count("wrong"), count("kept"), solved)


def sampling_counters(candidates: DataFrame, done: DataFrame, by: list[str], judge: Judge | None = None) -> DataFrame:
    """(by, total, skipped_done, no_boxed, no_gold, by_prefilter, by_judge, kept, wrong, problems_covered) of one resumed run."""
    rows = distinct_candidates(candidates)
    keys = ["id", "candidate_idx"]
    marked = rows.join(done.select(*keys).distinct().withColumn("__d", F.lit(True)), keys, "left")
    open_rows = judged(marked.where("__d IS NULL").drop("__d")).withColumn("__how", F.when(F.col("status") == "kept", "by_prefilter").otherwise(F.col("status")))
    if judge is not None:
        again = judge(open_rows.where("status = 'wrong'")).withColumn("__how", F.when(F.col("judged_correct"), "by_judge").otherwise("wrong")).drop("judged_correct")
        open_rows = open_rows.where("status <> 'wrong'").unionByName(again)
    skipped = marked.where("__d").select(*by, "id", F.lit("skipped_done").alias("__how"))
    every = open_rows.select(*by, "id", "__how").unionByName(skipped)
    count = lambda s: F.sum((F.col("__how") == s).cast("int")).alias(s)
    kept = F.col("__how").isin("by_prefilter", "by_judge")
    return every.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[count(s) for s in ("skipped_done", "no_boxed", "no_gold", "by_prefilter", "by_judge", "wrong")],
        F.sum(kept.cast("int")).alias("kept"), F.count_distinct(F.when(kept, F.col("id"))).alias("problems_covered"),
    )


def teacher_scores(candidates: DataFrame, correct: DataFrame, teacher: str) -> DataFrame:
    """(teacher, rows, retention_pct, coverage_pct, winner): the winner has the greatest (retention, coverage, name)."""
    a = candidates.groupBy(teacher).agg(F.count(F.lit(1)).alias("candidate_rows"), F.countDistinct("id").alias("problems_tried"))
    b = correct.groupBy(teacher).agg(F.count(F.lit(1)).alias("correct_rows"), F.countDistinct("id").alias("problems_solved"))
    share = lambda x, y: F.round(F.coalesce(F.try_divide(100.0 * F.col(x), F.col(y)), F.lit(0.0)), 2)
    rows = a.join(b, teacher, "left").na.fill(0, ["correct_rows", "problems_solved"])
    rows = rows.withColumn("retention_pct", share("correct_rows", "candidate_rows")).withColumn("coverage_pct", share("problems_solved", "problems_tried"))
    best = rows.agg(F.max_by(F.col(teacher), F.struct("retention_pct", "coverage_pct", F.col(teacher))).alias("__w"))
    return rows.join(F.broadcast(best), F.lit(True)).withColumn("winner", F.col(teacher) == F.col("__w")).drop("__w")  # one row


def to_chat(correct: DataFrame, keep_think: bool = False, max_per_problem: int | None = None, most_chars: int | None = None, id_only: bool = False) -> DataFrame:
    """(id, candidate_idx, arm, messages): ranked solutions per problem in two arms of equal size."""
    body = clean_solution(F.col("text"), keep_think)
    rows = correct.withColumn("__body", body).withColumn("__boxed", extract_boxed_loose(F.col("text"))).where("__boxed IS NOT NULL")
    if most_chars is not None:
        rows = rows.where(F.length("__body") <= most_chars)
    if id_only:
        rows = rows.where(is_indonesian(F.col("__body")))
    rows = top_k(rows, "id", [*solution_rank(F.col("__body")), F.col("candidate_idx")], max_per_problem)
    arm = lambda name, said: F.struct(F.lit(name).alias("arm"), chat_messages(wrap_prompt(F.col("soal"), name), said).alias("messages"))
    both = F.array(arm("cot", F.col("__body")), arm("nocot", F.concat(F.lit("\\boxed{"), F.col("__boxed"), F.lit("}"))))
    return rows.select("id", "candidate_idx", F.explode(both).alias("x")).select("id", "candidate_idx", "x.arm", "x.messages")


def training_pairs(correct: DataFrame, test: DataFrame) -> DataFrame:
    """Decontaminated, one solution per squeezed question (the smallest corr_id with a box), both arms."""
    clean = decontaminate(correct, test, "soal", "soal").where(extract_boxed_loose(F.col("text")).isNotNull())
    first = best_per_key(clean, squeeze(F.col("soal")), [-F.col("corr_id")])
    return to_chat(first)


def sft_rows(gold: DataFrame, most_steps: int = 1200) -> DataFrame:
    """(rid, with_steps, target_chars, messages) of the rows with an answer."""
    rows = gold.where(trimmed(F.col("jawaban")) != "")
    target = training_target(F.col("cara"), F.col("jawaban"), most_steps)
    steps = trimmed(F.col("cara"))
    return rows.select(
        "rid", ((steps != "") & (F.length(steps) <= most_steps)).alias("with_steps"), F.length(target).alias("target_chars"),
        chat_messages(wrap_prompt(F.col("soal")), target).alias("messages"),
    )


def language_ok(c: Column) -> Column:
    return is_indonesian(text_or_empty(c))
