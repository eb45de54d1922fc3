"""Quality reports: full inspections, heuristic rates, judge rates, cleaning and hold-out counters, comparisons of arms and teachers.

Rates are rounded to three digits. A group without rows is in no report; null text counts as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.answers import answer_from_steps, answer_shape, answer_type, extract_boxed, graded, symbolic_match
from lintang.functions.predicates import is_garbled, is_hard_topic, is_latex_balanced, needs_external_context, text_or_empty, trimmed
from lintang.functions.text import last_message, squeeze, unwrap_prompt

SHAPES = ("empty", "numeric", "fraction", "text", "expr")


def count_of(c: Column, name: str) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(name)


def rate(c: Column, of: Column, name: str) -> Column:
    """Share rounded to three digits; 0 of nothing is 0."""
    return F.round(F.coalesce(F.try_divide(c, of), F.lit(0.0)), 3).alias(name)


def gold_flags(df: DataFrame, symbolic: bool = True) -> DataFrame:
    """Adds ``flags`` (array of names), ``checked`` and ``matched`` (steps against answer) to gold rows."""
    rows = graded(df.withColumn("__p", answer_from_steps(F.col("cara"))), "__p", "jawaban", "__ok", symbolic)
    soal, jawaban, cara = trimmed(F.col("soal")), trimmed(F.col("jawaban")), text_or_empty(F.col("cara"))
    checked = (cara != "") & (jawaban != "")
    named = [
        (jawaban == "", "jawaban_kosong"), (soal == "", "soal_kosong"), ((soal != "") & (F.length(soal) < 20), "soal_pendek"),
        (is_garbled(F.col("soal")) | is_garbled(F.col("jawaban")) | is_garbled(F.col("cara")), "mojibake"),
        ((soal != "") & needs_external_context(soal), "butuh_konteks_luar"), (answer_shape(F.col("jawaban")) == "text", "jawaban_teks_bebas"),
        (checked & F.col("__p").isNull(), "cara_tanpa_jawaban"), (checked & F.col("__p").isNotNull() & ~F.col("__ok"), "cara_vs_gold_mismatch"),
    ]
    flags = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in named]), lambda x: x.isNotNull())
    return rows.withColumns({"flags": flags, "checked": checked, "matched": checked & F.col("__ok")}).drop("__p", "__ok")


def chat_flags(df: DataFrame, mode: Column) -> DataFrame:
    """Adds ``flags`` to chat rows; ``mode`` is ``cot`` or ``nocot`` per row and decides what the format demands."""
    asked, said = unwrap_prompt(last_message(F.col("messages"), "user")), last_message(F.col("messages"), "assistant")
    rows = df.withColumns({"__asked": asked, "__said": said}).withColumn("__box", extract_boxed(F.col("__said")))
    residue = trimmed(F.regexp_replace("__said", r"(?s)\\boxed\s*\{.*\}", ""))
    bare = F.length(trimmed(F.col("__said"))) - F.length("__box") < 40
    named = [
        (trimmed(F.col("__said")) == "", "assistant_kosong"), (F.col("__box").isNull(), "tanpa_boxed"), (F.col("__box").isNotNull() & (trimmed(F.col("__box")) == ""), "boxed_kosong"),
        (is_garbled(F.col("__asked")) | is_garbled(F.col("__said")), "mojibake"), ((mode == "nocot") & (F.length(residue) > 15), "nocot_ada_penalaran"),
        ((mode == "cot") & F.col("__box").isNotNull() & bare, "cot_tanpa_penalaran"),
    ]
    flags = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in named]), lambda x: x.isNotNull())
    return rows.withColumns({"flags": flags, "question": F.col("__asked"), "reply": F.col("__said")}).drop("__asked", "__said", "__box")


def flag_counts(flagged: DataFrame, by: list[str]) -> DataFrame:
    """(by, flag, n_rows)."""
    return flagged.select(*by, F.explode("flags").alias("flag")).groupBy(*by, "flag").agg(F.count(F.lit(1)).alias("n_rows"))


def flagged_examples(flagged: DataFrame, id_col: str) -> DataFrame:
    """(id, flags) of the rows with a flag."""
    return flagged.where(F.size("flags") > 0).select(id_col, F.array_join("flags", ",").alias("flags"))


def gold_summary(flagged: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, dup_soal, soal_len_median, cara_checked, cara_match_gold, self_consistency): null consistency where no row was checked."""
    checked, matched = count_of(F.col("checked"), "cara_checked"), count_of(F.col("matched"), "cara_match_gold")
    sums = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct(squeeze(F.col("soal")))).alias("dup_soal"),
        F.floor(F.median(F.length(trimmed(F.col("soal"))))).cast("int").alias("soal_len_median"), checked, matched,
    )
    return sums.withColumn("self_consistency", F.round(F.try_divide("cara_match_gold", "cara_checked"), 3))


def gold_rates(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Heuristic rates of gold rows per group."""
    has = lambda flag: F.sum(F.array_contains("flags", flag).cast("int"))
    n = F.count(F.lit(1))
    return flagged.groupBy(*by).agg(
        n.alias("n"), F.round(F.try_divide(F.sum(F.col("matched").cast("int")), F.sum(F.col("checked").cast("int"))), 3).alias("self_consistency"),
        rate(has("butuh_konteks_luar"), n, "unanswerable_rate"), rate(has("jawaban_kosong"), n, "empty_jawaban_rate"), rate(has("jawaban_teks_bebas"), n, "text_answer_rate"),
        rate(has("mojibake"), n, "mojibake_rate"), rate(n - F.count_distinct(squeeze(F.col("soal"))), n, "dup_rate"),
    )


def chat_rates(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Heuristic rates of chat rows per group."""
    has = lambda flag: F.sum(F.array_contains("flags", flag).cast("int"))
    n = F.count(F.lit(1))
    return flagged.groupBy(*by).agg(
        n.alias("n"), rate(has("tanpa_boxed"), n, "tanpa_boxed_rate"), rate(has("mojibake"), n, "mojibake_rate"),
        rate(n - F.count_distinct(squeeze(F.col("question"))), n, "dup_rate"), rate(has("nocot_ada_penalaran") + has("cot_tanpa_penalaran"), n, "format_issue_rate"),
        F.floor(F.median(F.length("reply"))).cast("int").alias("asst_len_median"),
    )


def cleaning_report(reasons: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_before, n_after, n_dropped, keep_rate) of rows with a column ``reason`` (null: kept)."""
    kept = count_of(F.col("reason").isNull(), "n_after")
    out = reasons.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"), kept)
    return out.select(*by, "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_dropped"), F.round(F.col("n_after") / F.col("n_before"), 3).alias("keep_rate"))


def is_gradeable(answer: Column) -> Column:
    """A number, a fraction, or an expression that the symbolic tier can read."""
    readable = F.when(~answer_type(answer).isin("pure_int", "pure_num", "empty"), answer)
    return answer_type(answer).isin("pure_int", "pure_num") | F.coalesce(symbolic_match(readable, readable), F.lit(False))


def holdout_counters(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_input, bad_gold, bad_latex, kept, hard): bad answers and bad LaTeX are counted independently of each other."""
    rows = df.withColumn("__g", is_gradeable(F.col("jawaban"))).withColumn("__l", is_latex_balanced(F.col("soal")))
    ok = F.col("__g") & F.col("__l")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_input"), count_of(~F.col("__g"), "bad_gold"), count_of(~F.col("__l"), "bad_latex"), count_of(ok, "kept"), count_of(ok & is_hard_topic(F.col("soal")), "hard")
    )


def judge_prompts(df: DataFrame, template: str, question: Column, **parts: tuple[Column, int]) -> DataFrame:
    """Adds ``prompt``: the template with ``{soal}`` (1,800 characters) and each named part, cut to its length; ``(kosong)`` for an empty one."""
    out = F.replace(F.lit(template), F.lit("{soal}"), F.substring(trimmed(question), 1, 1800))
    for name, (c, most) in parts.items():
        value = F.substring(trimmed(c), 1, most)
        out = F.replace(out, F.lit(f"{{{name}}}"), F.when(value == "", "(kosong)").otherwise(value))
    return df.withColumn("prompt", out)


def says_correct(reply: Column) -> Column:
    """Whether a judge's reply says ``benar``."""
    return F.contains(F.lower(text_or_empty(reply)), F.lit("benar"))


def label_rates(verdicts: DataFrame, by: list[str], labels: dict[str, tuple[str, str]]) -> DataFrame:
    """(by, n, a rate for each name): ``labels`` has name: (column, value)."""
    n = F.count(F.lit(1))
    return verdicts.groupBy(*by).agg(n.alias("n"), *[rate(F.sum((F.col(c) == v).cast("int")), n, name) for name, (c, v) in labels.items()])


GOLD_LABELS = {
    "gold_benar_rate": ("gold", "benar"), "gold_salah_rate": ("gold", "salah"), "gold_ragu_rate": ("gold", "ragu"), "soal_lengkap_rate": ("lengkap", "ya"),
}
TRAIN_LABELS = {
    "jawaban_benar_rate": ("jawaban", "benar"), "jawaban_salah_rate": ("jawaban", "salah"), "penalaran_valid_rate": ("penalaran", "valid"), "penalaran_cacat_rate": ("penalaran", "cacat"),
}


def language_rate(df: DataFrame, by: list[str], text: str, language: Column, wanted: str = "id") -> DataFrame:
    """(by, n, rate) among texts of 20 characters or more."""
    long = df.where(F.length(text) >= 20)
    return long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate(F.sum((language == wanted).cast("int")), F.count(F.lit(1)), "language_rate"))


def duplicate_rate(pairs: DataFrame, total: DataFrame) -> DataFrame:
    """(n, with_twin, rate): share of rows that are an end of a pair (a, b)."""
    ends = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).distinct().agg(F.count(F.lit(1)).alias("with_twin"))
    n = total.agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(ends).select("n", "with_twin", rate(F.col("with_twin"), F.col("n"), "rate"))  # one row on each side


def best_matches(pairs: DataFrame, k: int) -> DataFrame:
    """Top k rows (a, b, cosine): of each a its closest b, ties to the smaller b; ordered by cosine, then ids."""
    best = pairs.groupBy("a").agg(F.max_by(F.struct("b", "cosine"), F.struct("cosine", -F.col("b"))).alias("m")).select("a", "m.b", "m.cosine")
    return best.orderBy(F.desc("cosine"), "a").limit(k)


def composite_order(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order)


def arm_delta(scores: DataFrame, arm: str, plus: str, minus: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, plus, minus, delta) of two arms; keys that stand in both."""
    long = scores.select(*keys, F.col(arm).alias("__arm"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    pivoted = long.select(*keys, "__arm", "x.*").groupBy(*keys, "metric").pivot("__arm", [plus, minus]).agg(F.first("v"))
    return pivoted.where(F.col(plus).isNotNull() & F.col(minus).isNotNull()).withColumn("delta", F.round(F.col(plus) - F.col(minus), 4))


def merged_results(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of result tables of different columns; of equal keys the last table wins."""
    from lintang.operators.dedup import best_per_key

    out = None
    for number, part in enumerate(parts):
        numbered = part.withColumn("__n", F.lit(number))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    return best_per_key(out, F.col(key), [F.col("__n")]).drop("__n")


def coverage_scores(runs: DataFrame, pools: DataFrame, run: str, key: str) -> DataFrame:
    """(run, coverage_raw, total_correct, pool_size, coverage_common, winner): runs compared on the problems that all of them tried.

    If a run has no pool, the problems that any run solved stand in; if nothing is common, the raw coverage decides.
    The winner has the greatest (coverage, total_correct, name).
    """
    solved = runs.groupBy(run).agg(F.count_distinct(key).alias("coverage_raw"), F.count(F.lit(1)).alias("total_correct"))
    tried = pools.where(F.col(key).isNotNull()).select(run, key).distinct()
    sizes = tried.groupBy(run).agg(F.count(F.lit(1)).alias("pool_size"))
    rows = solved.join(sizes, run, "left")
    number = rows.agg(F.count(F.lit(1)).alias("runs"), F.min(F.coalesce("pool_size", F.lit(0))).alias("least"))
    shared = tried.groupBy(key).agg(F.count(F.lit(1)).alias("by")).crossJoin(F.broadcast(number)).where("by = runs AND least > 0").select(key)  # one row
    union = runs.select(key).distinct().crossJoin(F.broadcast(number)).where("least = 0").select(key)
    common = shared.unionByName(union)
    covered = runs.select(run, key).distinct().join(common, key).groupBy(run).agg(F.count(F.lit(1)).alias("coverage_common"))
    rows = rows.join(covered, run, "left").withColumn("coverage_common", F.coalesce("coverage_common", F.lit(0)))
    size = common.agg(F.count(F.lit(1)).alias("__common"))
    scored = rows.crossJoin(F.broadcast(size)).withColumn("__key", F.when(F.col("__common") == 0, F.col("coverage_raw")).otherwise(F.col("coverage_common")))
    best = scored.agg(F.max_by(F.col(run), F.struct("__key", "total_correct", F.col(run))).alias("__w"))
    return scored.crossJoin(F.broadcast(best)).withColumn("winner", F.col(run) == F.col("__w")).drop("__w", "__key", "__common")


def provenance_summary(tagged: DataFrame, certain: DataFrame, school: DataFrame, text: str) -> DataFrame:
    """(total, unknown, unknown_pct, conflicts): conflicts are texts in both the certain and the school set."""
    both = certain.select(trimmed(F.col("text")).alias("k")).intersect(school.select(trimmed(F.col("text")).alias("k")))
    conflicts = tagged.select(trimmed(F.col(text)).alias("k")).join(both, "k", "left_semi").agg(F.count(F.lit(1)).alias("conflicts"))
    sums = tagged.agg(F.count(F.lit(1)).alias("total"), count_of(F.col("tag") == "unknown", "unknown"))
    return sums.crossJoin(conflicts).withColumn("unknown_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("unknown"), F.col("total")), F.lit(0.0)), 1))  # one row on each side


def payload_counts(rows: DataFrame, route: Column, payload: Column) -> DataFrame:
    """(route, n_rows, payload_bytes)."""
    return rows.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length(payload)).alias("payload_bytes"))
