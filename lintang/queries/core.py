"""Queries of the core operators; each runs over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintang.functions import answers as A
from lintang.functions import predicates as P
from lintang.functions import text as X
from lintang.operators import dedup, generate, joins, sampling, sequence, similarity
from lintang.plans import distill, evaluate, quality
from lintang.session import ensure_checkpoint_dir
from lintang.sources import readers, writers
from lintang.streaming import resumable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flags(by: str, **columns: Column):
    """Aggregates that count each flag."""
    return [F.count(F.lit(1)).alias("n_rows"), *[F.sum(c.cast("int")).alias(name) for name, c in columns.items()]]


def question_flags(spark, d):
    q = F.col("soal")
    return table(spark, d, "gold").groupBy("split").agg(
        *flags(
            "split", choice_loose=P.is_multiple_choice(q), choice_strict=P.is_multiple_choice(q, True), true_false_loose=P.is_true_false(q),
            true_false_strict=P.is_true_false(q, True), image_short=P.needs_image(q), image_long=P.needs_image(q, True),
            image_hint=P.mentions_image(q), outside_context=P.needs_external_context(q), valid_problem=P.is_valid_problem(q),
            latex_balanced=P.is_latex_balanced(q), hard_topic=P.is_hard_topic(q), complete=P.looks_complete(q), indonesian=P.is_indonesian(q),
            numeric_gold=P.is_numeric_gold(F.col("jawaban")), school_item=P.is_clean_school_item(q, F.col("jawaban")),
            needs_fill=P.needs_fill(F.col("jawaban"), F.col("cara")), usable=P.is_usable_record(q, F.col("jawaban")),
        )
    )


def rule_reasons(spark, d):
    gold, q = table(spark, d, "gold"), F.col("soal")
    parts = [quality.reason_counts(gold, P.reason_rules(q, v), ["split"]).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def answer_shapes(spark, d):
    shapes = ["empty", "numeric", "fraction", "text", "expr"]
    return quality.shape_crosstab(table(spark, d, "gold"), "split", A.answer_shape(F.col("jawaban")), shapes)


def answer_types(spark, d):
    return table(spark, d, "gold").groupBy("split", A.answer_type(F.col("jawaban")).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"))


def most_complete(spark, d):
    gold = table(spark, d, "gold")
    return dedup.most_complete(gold, "soal", "jawaban", "cara", "rid").select("rid")


def exact_rows(spark, d):
    return dedup.exact_rows(table(spark, d, "gold"), ["soal", "cara", "jawaban"])


def duplicate_counts(spark, d):
    return dedup.duplicate_count(table(spark, d, "gold"), X.squeeze(F.col("soal")))


def candidates_distinct(spark, d):
    return distill.distinct_candidates(table(spark, d, "candidate")).select("id", "candidate_idx")


def rejection_sampling_stats(spark, d):
    return distill.sampling_stats(distill.rejection_sampling(table(spark, d, "candidate")), ["source"])


def resumed_candidates(spark, d):
    rows = joins.without_done(table(spark, d, "candidate"), [table(spark, d, "correct")], ["id", "candidate_idx"])
    return rows.groupBy("candidate_idx").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("problems"))


def missing_candidates(spark, d):
    problems = table(spark, d, "gold").select(F.format_string("q%09d", "rid").alias("id"))
    return joins.missing_indices(problems, table(spark, d, "candidate").select("id", "candidate_idx").distinct(), "id", 4)


def graded_candidates(spark, d):
    rows = evaluate.graded_generations(table(spark, d, "candidate"), symbolic=False)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("correct").cast("int")).alias("correct"), F.sum(F.col("has_boxed").cast("int")).alias("boxed")
    )


def sampled_scores(spark, d):
    rows = distill.distinct_candidates(table(spark, d, "candidate"))
    return evaluate.sampled_scores(evaluate.graded_generations(rows, symbolic=False), ["source"], "id", "candidate_idx")


def symbolic_grades(spark, d):
    rows = evaluate.graded_generations(table(spark, d, "candidate"))
    return rows.groupBy("source").agg(F.sum(F.col("correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("n_rows"))


def teacher_scores(spark, d):
    candidate = table(spark, d, "candidate")
    correct = table(spark, d, "correct").join(candidate.select("id", "source").distinct(), "id")
    return distill.teacher_scores(candidate, correct, "source")


def training_pairs(spark, d):
    test = table(spark, d, "gold").where("split <> 'train_pool'")
    pairs = distill.training_pairs(table(spark, d, "correct"), test)
    return pairs.select("id", "candidate_idx", "arm", F.element_at("messages", 2)["content"].alias("reply"))


def best_solutions(spark, d):
    return distill.to_chat(table(spark, d, "correct"), max_per_problem=1).where("arm = 'nocot'").select("id", "candidate_idx")


def sft_statistics(spark, d):
    return distill.sft_rows(table(spark, d, "gold")).groupBy("with_steps").agg(
        F.count(F.lit(1)).alias("n_rows"), F.median("target_chars").alias("median_chars"), F.max("target_chars").alias("most_chars")
    )


def decontaminated_chat(spark, d):
    chat = table(spark, d, "chatml").withColumn("question", X.unwrap_prompt(X.last_message(F.col("messages"), "user")))
    chat = chat.withColumn("question", F.trim(F.regexp_replace("question", "^Soal:", "")))
    return joins.decontaminate(chat, table(spark, d, "gold").where("split <> 'train_pool'"), "question", "soal").select("chat_id")


def provenance_tags(spark, d):
    gold = table(spark, d, "gold")
    of = lambda prefix: gold.where(F.col("source").startswith(prefix)).select(F.col("soal").alias("text"))
    tagged = joins.tag_provenance(gold.select("rid", "soal"), "soal", of("osn"), of("un_"), of("paket"))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"))


def cache_overlay(spark, d):
    gold = table(spark, d, "gold").select("rid", "soal", "cara", "jawaban")
    cache = table(spark, d, "candidate").select("soal", F.col("text").alias("cara"), "jawaban", F.col("text").contains("boxed").alias("ok"), F.xxhash64("text", "id", "candidate_idx").alias("o"))
    return joins.overlay_cache(gold, cache, "soal", ["cara", "jawaban"], "ok", "o").groupBy("filled").agg(F.count(F.lit(1)).alias("n_rows"))


def cross_arm(spark, d):
    chat = table(spark, d, "chatml").select("chat_id", "arm", X.unwrap_prompt(X.last_message(F.col("messages"), "user")).alias("q"), A.normalize_answer_text(A.extract_boxed(X.last_message(F.col("messages"), "assistant"))).alias("a"))
    both = joins.cross_arm(chat.where("arm = 'cot'"), chat.where("arm = 'nocot'"), "q", "a", "chat_id")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("same").cast("int")).alias("same"))


def pool_intersection(spark, d):
    return joins.pool_intersection([table(spark, d, n) for n in ("candidate", "correct", "progress")], "id").where("id IS NOT NULL")


def cleaning_reasons(spark, d):
    rows = quality.cleaning_reasons(table(spark, d, "gold"), drop_text=True, symbolic=False)
    return quality.reason_counts(rows, F.col("reason"), ["split"])


def inspection(spark, d):
    return quality.inspection(table(spark, d, "gold"), ["split"])


def chat_inspection(spark, d):
    return quality.chat_inspection(table(spark, d, "chatml"), "arm")


def valid_chat(spark, d):
    return table(spark, d, "chatml").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(P.is_valid_chat(F.col("messages")).cast("int")).alias("valid"))


def answer_distribution(spark, d):
    return quality.answer_distribution(table(spark, d, "gold"), ["split"], P.trimmed(F.col("jawaban")))


def length_outliers(spark, d):
    return quality.length_outliers(table(spark, d, "gold"), ["split"], "soal")


def clipped_lengths(spark, d):
    size = F.least(F.length(P.text_or_empty(F.col("soal"))), F.lit(800))
    return table(spark, d, "gold").groupBy((F.floor(size / 50) * 50).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


def funnel(spark, d):
    stages = [(n, table(spark, d, n), "id") for n in ("candidate", "progress", "correct")]
    return quality.funnel(stages)


def source_yield(spark, d):
    kept = table(spark, d, "correct").groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    made = table(spark, d, "candidate").groupBy("source", "id").agg(F.count(F.lit(1)).alias("m"))
    return made.join(kept, "id", "left").groupBy("source").agg(
        F.sum("m").alias("candidates"), F.coalesce(F.sum("k"), F.lit(0)).alias("kept"), F.round(F.coalesce(F.sum("k"), F.lit(0)) / F.sum("m"), 3).alias("share")
    )


def source_status(spark, d):
    s = F.col("status")
    folded = F.when(s.startswith("dedup"), "dedup").when(s.isin("ok", "no_links", "partial"), "ok").otherwise(s)
    return table(spark, d, "sources").groupBy(folded.alias("state")).agg(F.count(F.lit(1)).alias("n_rows"))


def source_fields(spark, d):
    rows = table(spark, d, "sources")
    return rows.select("slug", X.normalize_url(F.col("url")).alias("url_key"), X.drive_id(F.col("url")).alias("drive"), X.parse_level(F.col("slug")).alias("level_name"), X.parse_year(F.col("note")).alias("year"), X.slug(F.col("filename")).alias("file_slug"))


def document_inventory(spark, d):
    rows = table(spark, d, "extracted")
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("pages"), F.sum("source_page").alias("page_sum"), F.sum(F.coalesce(F.col("has_image"), F.lit(False)).cast("int")).alias("with_image"))


def markdown_verdicts(spark, d):
    m = X.markdown_metrics(F.col("text"))
    rows = table(spark, d, "documents").select(X.markdown_verdict(m).alias("why"))
    return rows.groupBy((F.col("why") == "").alias("good")).agg(F.count(F.lit(1)).alias("n_rows"))


def split_questions(spark, d):
    return generate.split_questions(table(spark, d, "extracted"), "ext_id", "raw_text")


def qa_pairs(spark, d):
    return generate.qa_pairs(table(spark, d, "extracted"), "ext_id", "raw_text")


def merged_questions(spark, d):
    blocks = split_questions(spark, d).join(table(spark, d, "extracted").select("ext_id", "source_file", "source_page"), "ext_id")
    blocks = blocks.withColumn("complete", P.looks_complete(F.col("question")))
    return sequence.pending_questions(blocks, "source_file", ["source_page", "ext_id", "position"], "question", "numbered", "complete")


def carried_method(spark, d):
    rows = table(spark, d, "extracted").withColumn("v", F.when(F.col("has_image"), F.col("extraction_method")))
    return sequence.carry_down(rows, "source_file", "ext_id", "v", "carried").select("ext_id", "carried")


def page_routes(spark, d):
    share = F.when(F.col("has_image"), 0.2).otherwise(0.0)
    return table(spark, d, "extracted").groupBy(P.page_route(F.col("raw_text"), share).alias("route")).agg(F.count(F.lit(1)).alias("n_rows"))


def message_roles(spark, d):
    rows = table(spark, d, "chatml").select("arm", F.explode("messages").alias("m"))
    return rows.groupBy("arm", F.col("m.role").alias("role")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("m.content")).alias("chars"))


def math_segments(spark, d):
    rows = table(spark, d, "gold").select(F.explode(X.segments(F.col("soal"))).alias("s"))
    return rows.groupBy("s.kind").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("s.content")).alias("chars"))


def latex_questions(spark, d):
    return table(spark, d, "gold").select("rid", X.normalize_math(X.clean_record_text(F.col("soal"))).alias("soal"))


def document_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 600)).alias("position", "chunk"))


def holdout_split(spark, d):
    gold = table(spark, d, "gold").select("rid", "soal", "jawaban")
    eligible = A.answer_type(F.col("jawaban")).isin("pure_int", "pure_num", "single_expr")
    return sampling.holdout(gold, "rid", 300, eligible=eligible).select("rid", "part")


def embedding_decontamination(spark, d):
    rows = table(spark, d, "embeddings")
    unit = similarity.unit_vectors(rows, "vec_id", "embedding")
    labels = rows.select(F.col("vec_id").alias("id"), "label")
    bench = unit.join(labels.where("label = 0").select("id"), "id")
    kept = similarity.embedding_decontamination(unit.join(labels.where("label <> 0").select("id"), "id"), bench, 0.4)
    return kept.select(F.col("id").alias("vec_id"))


def lexical_leaks(spark, d):
    gold = table(spark, d, "gold").select("rid", "soal", "split")
    return similarity.leaked_rows(gold.where("split <> 'train_pool'"), gold.where("split = 'train_pool'"), "rid", "rid", "soal").select("a", "b")


def lexical_duplicates(spark, d):
    return similarity.near_duplicate_rows(table(spark, d, "gold"), "rid", "soal").select("a", "b")


def greedy_survivors(spark, d):
    return similarity.greedy_lexical_survivors(table(spark, d, "gold"), "rid", "soal").groupBy("kept").agg(F.count(F.lit(1)).alias("n_rows"))


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def jsonl_roundtrip(spark, d):
    path = _folder(spark)
    writers.jsonl(table(spark, d, "gold").select("soal", "cara", "jawaban", "source", "answer_type", "hard"), path)
    return readers.jsonl(spark, path, readers.GOLD).withColumn("hard", F.col("hard").cast("int"))


def streamed_sampling(spark, d):
    """The candidate table as a stream of files; each key is judged once."""
    folder = _folder(spark)
    rows = table(spark, d, "candidate").where("id IS NOT NULL AND candidate_idx IS NOT NULL")
    writers.jsonl(rows.select("id", "soal", "jawaban", "cara", "source", "candidate_idx", "text"), f"{folder}/in")
    resumable.run_resumable(resumable.candidate_stream(spark, f"{folder}/in"), distill.judged, f"{folder}/out", f"{folder}/state")
    return resumable.status_counts(spark.read.parquet(f"{folder}/out"))


QUERIES = {f.__name__: f for f in (
    question_flags, rule_reasons, answer_shapes, answer_types, most_complete, exact_rows, duplicate_counts, candidates_distinct,
    rejection_sampling_stats, resumed_candidates, missing_candidates, graded_candidates, sampled_scores, symbolic_grades, teacher_scores,
    training_pairs, best_solutions, sft_statistics, decontaminated_chat, provenance_tags, cache_overlay, cross_arm, pool_intersection,
    cleaning_reasons, inspection, chat_inspection, valid_chat, answer_distribution, length_outliers, clipped_lengths, funnel, source_yield,
    source_status, source_fields, document_inventory, markdown_verdicts, split_questions, qa_pairs, merged_questions, carried_method,
    page_routes, message_roles, math_segments, latex_questions, document_chunks, holdout_split, embedding_decontamination, lexical_leaks,
    lexical_duplicates, greedy_survivors, jsonl_roundtrip, streamed_sampling,
)}
