"""Queries of the reports and of the record operators; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintang.functions import answers as A
from lintang.functions import predicates as P
from lintang.functions import text as X
from lintang.operators import records, sequence, similarity
from lintang.plans import distill, quality, reports
from lintang.queries.core import _folder, table
from lintang.sources import readers, writers


def _gold(spark, d):
    return reports.gold_flags(table(spark, d, "gold"), symbolic=False)


def gold_flag_counts(spark, d):
    return reports.flag_counts(_gold(spark, d), ["split"])


def gold_flagged(spark, d):
    return reports.flagged_examples(_gold(spark, d), "rid")


def gold_summary(spark, d):
    return reports.gold_summary(_gold(spark, d), ["split"])


def gold_rates(spark, d):
    return reports.gold_rates(_gold(spark, d), ["split"])


def _chat(spark, d):
    return reports.chat_flags(table(spark, d, "chatml"), F.col("arm"))


def chat_flag_counts(spark, d):
    return reports.flag_counts(_chat(spark, d), ["arm"])


def chat_rates(spark, d):
    return reports.chat_rates(_chat(spark, d), ["arm"])


def arm_delta(spark, d):
    rates = reports.chat_rates(_chat(spark, d), ["split", "arm"])
    return reports.arm_delta(rates, "arm", "cot", "nocot", ["split"], ["tanpa_boxed_rate", "mojibake_rate", "dup_rate"])


def cleaning_report(spark, d):
    return reports.cleaning_report(quality.cleaning_reasons(table(spark, d, "gold"), drop_text=True, symbolic=False), ["split"])


def cleaning_reasons_symbolic(spark, d):
    """As cleaning_reasons, with the symbolic tier that the grader has."""
    rows = quality.cleaning_reasons(table(spark, d, "gold"), drop_text=True)
    return quality.reason_counts(rows, F.col("reason"), ["split"])


def holdout_counters(spark, d):
    return reports.holdout_counters(table(spark, d, "gold"), ["split"])


def verdict_rates(spark, d):
    """Labels read from the candidate texts as if they were judge replies."""
    labels = {"gold": (["benar", "salah", "ragu"], "ragu"), "lengkap": (["ya", "tidak"], "ya")}
    rows = table(spark, d, "candidate").select("source", *[X.parse_verdict(F.col("text"), n, values, default).alias(n) for n, (values, default) in labels.items()])
    return reports.label_rates(rows, ["source"], reports.GOLD_LABELS)


def judge_replies(spark, d):
    return table(spark, d, "candidate").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), reports.count_of(reports.says_correct(F.col("text")), "correct"))


def judge_prompts(spark, d):
    rows = reports.judge_prompts(table(spark, d, "gold"), "SOAL:\n{soal}\nJAWABAN: {gold}\n{cara}", F.col("soal"), gold=(F.col("jawaban"), 80), cara=(F.col("cara"), 1200))
    return rows.select("rid", "prompt")


def language_rates(spark, d):
    return reports.language_rate(table(spark, d, "documents"), ["source"], "text", F.coalesce("lang", F.lit("unknown")))


def language_labels(spark, d):
    return table(spark, d, "gold").groupBy("split", P.language_label(F.col("soal")).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))


def detected_languages(spark, d):
    """The detector is the column ``lang``."""
    rows = table(spark, d, "documents")
    return rows.groupBy("source", P.language_label(F.col("text"), F.col("lang")).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))


def rule_reasons_detected(spark, d):
    """Rule reasons of documents with the stored language as the detector."""
    return quality.reason_counts(table(spark, d, "documents"), P.reason_rules(F.col("text"), 2, F.coalesce(F.col("lang") == "id", F.lit(False))), ["jenis"])


def lexical_duplicate_rate(spark, d):
    gold = table(spark, d, "gold").select("rid", "soal")
    return reports.duplicate_rate(similarity.near_duplicate_links(gold, "rid", "soal"), gold)


def leak_examples(spark, d):
    gold = table(spark, d, "gold").select("rid", "soal", "split")
    pairs = similarity.leaked_rows(gold.where("split <> 'train_pool'"), gold.where("split = 'train_pool'"), "rid", "rid", "soal", first=True)
    return reports.best_matches(pairs, 5).select("a", "b", F.round("cosine", 3).alias("cosine"))


def embedding_survivors(spark, d):
    unit = similarity.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return similarity.greedy_embedding_survivors(unit).groupBy("kept").agg(F.count(F.lit(1)).alias("n_rows"))


def embedding_twins(spark, d):
    """Pairs of embeddings with a cosine of at least 0.5."""
    unit = similarity.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return similarity.embedding_pairs(unit, 0.5, bits=6, bands=64).select("a", "b", F.round("cosine", 4).alias("cosine"))


def progress_log(spark, d):
    """The progress table as a tab-separated log and back."""
    path = _folder(spark)
    table(spark, d, "progress").write.option("sep", "\t").csv(path)
    return readers.progress(spark, path)


def json_lines_skipped(spark, d):
    """Records with the lines of documents between them; what is no record is skipped."""
    return readers.jsonl(spark, _mixed_lines(spark, d), "rid bigint, soal string", "skip").select("rid", "soal")


def json_lines_kept(spark, d):
    rows = readers.jsonl(spark, _mixed_lines(spark, d), "rid bigint, soal string", "keep")
    return rows.select("rid", F.length("_parse_error").alias("error_chars")).groupBy(F.col("rid").isNull().alias("broken")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("error_chars").alias("most_chars"))


def _mixed_lines(spark, d):
    path = _folder(spark)
    records = table(spark, d, "gold").select(F.to_json(F.struct("rid", F.coalesce("soal", F.lit("")).alias("soal"))).alias("value"))
    records.unionByName(table(spark, d, "sources").select(F.concat(F.lit("bukan rekaman "), F.repeat(F.col("slug"), F.lit(20))).alias("value"))).write.text(path)
    return path


def json_array_slice(spark, d):
    """Items 10 to 60 of the benchmark as one JSON array."""
    path = _folder(spark)
    items = table(spark, d, "benchmark").agg(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "text")))).alias("value"))
    items.coalesce(1).write.text(path)
    return readers.json_array(spark, path, "item_id bigint, text string", 10, 60).select("position", "item_id")


def csv_union(spark, d):
    """Two tables of different columns in one CSV file and back."""
    path = _folder(spark)
    parts = [table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "sources").select("slug", "level", "trust")]
    writers.csv(writers.csv_union(parts, ["slug"]), path)
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return rows.select(*rows.columns)


def partitioned_gold(spark, d):
    path = _folder(spark)
    writers.partitioned(table(spark, d, "gold").select("rid", "soal", F.coalesce("hard", F.lit(False)).alias("hard")), path, "hard")
    return spark.read.parquet(path).groupBy(F.col("hard").cast("string").alias("hard")).agg(F.count(F.lit(1)).alias("n_rows"))


def coverage_scores(spark, d):
    runs = table(spark, d, "correct").select(F.col("candidate_idx").alias("run"), "id").where("id IS NOT NULL")
    return reports.coverage_scores(runs, table(spark, d, "candidate").select(F.col("candidate_idx").alias("run"), "id").where("run IS NOT NULL"), "run", "id")


def sampling_counters(spark, d):
    """A run resumed behind the correct table; the judge is the grader's string and number tier."""
    judge = lambda df: df.withColumn("judged_correct", A.quick_match(F.col("pred"), F.col("jawaban")))
    return distill.sampling_counters(table(spark, d, "candidate"), table(spark, d, "correct"), ["source"], judge)


def merged_results(spark, d):
    count = lambda name, column: table(spark, d, name).groupBy("source").agg(F.count(F.lit(1)).alias(column))
    return reports.merged_results([count("gold", "n_gold"), count("documents", "n_documents"), count("chatml", "n_chat")], "source")


def provenance_summary(spark, d):
    from lintang.operators import joins

    gold = table(spark, d, "gold")
    of = lambda prefix: gold.where(F.col("source").startswith(prefix)).select(F.col("soal").alias("text"))
    tagged = joins.tag_provenance(gold.select("rid", "soal"), "soal", of("osn"), of("un_"), of("paket"))
    return reports.provenance_summary(tagged, of("osn"), of("un_"), "soal")


def solved_or_tried(spark, d):
    ids = lambda name: table(spark, d, name).select("id")
    return records.union_distinct(ids("correct"), ids("candidate"))


def unsolved(spark, d):
    ids = lambda name: table(spark, d, name).select("id")
    return records.set_difference(ids("correct"), ids("candidate"), "id")


def distinct_lines(spark, d):
    return records.distinct_lines(table(spark, d, "extracted").select(F.explode(F.split("raw_text", "\n")).alias("value")))


def first_links(spark, d):
    return records.first_links(table(spark, d, "sources").select("slug", "url"), "url", [F.hash("slug").cast("bigint") * 0 + F.length("slug")]).select(X.normalize_url(F.col("url")).alias("url_key"))


def protected_formulas(spark, d):
    protected, formulas = X.protect_formulas(F.col("soal"))
    rows = table(spark, d, "gold").select("rid", "soal", protected.alias("p"), formulas.alias("f"))
    back = X.restore_formulas(F.col("p"), F.col("f"))
    return rows.select("rid", F.size("f").alias("n_formulas"), (F.length("p") - F.length(F.replace(F.col("p"), F.lit("$"), F.lit("")))).alias("signs_left"), (back == P.text_or_empty(F.col("soal"))).cast("int").alias("same"))


def extraction_metrics(spark, d):
    return table(spark, d, "documents").select("doc_id", X.extraction_metrics(F.col("text")).alias("m")).select("doc_id", "m.*")


def markdown_order(spark, d):
    """Broken pages first, then by cid signs, then by the share of letters."""
    m = X.markdown_metrics(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", m.alias("m"), X.markdown_verdict(m).alias("why"))
    ranked = reports.composite_order(rows, (F.col("why") == "").cast("int"), F.desc("m.cid_per_kc"), F.col("m.alpha_ratio"), F.col("doc_id"))
    return ranked.limit(20).select("doc_id")


def attached_images(spark, d):
    rows = records.attach_images(table(spark, d, "extracted"), ["source_file", "source_page"], "raw_text", "image_files")
    return rows.select("ext_id", F.size("image_files").alias("n_images"))


def field_tasks(spark, d):
    tasks = records.field_tasks(table(spark, d, "gold"), "rid", ["soal", "cara", "jawaban"])
    return tasks.groupBy("field").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("chars"))


def translated_once(spark, d):
    """The model is a stand-in that lower-cases."""
    rows = records.translate_once(table(spark, d, "gold").select("rid", "soal"), "soal", lambda pool: pool.withColumn("translated", F.lower("text")))
    return rows.select("rid", "translated")


def text_layers(spark, d):
    page = F.row_number().over(W.partitionBy("source_file").orderBy("ext_id")) - 1
    return records.text_layers(table(spark, d, "extracted").withColumn("page", page), "source_file", "page", "raw_text")


def page_payloads(spark, d):
    share = F.when(F.col("has_image"), 0.2).otherwise(0.0)
    return reports.payload_counts(table(spark, d, "extracted"), P.page_route(F.col("raw_text"), share), F.col("raw_text"))


def continued_items(spark, d):
    """Complete questions begin an item, others continue it."""
    kind = F.when(P.looks_complete(F.col("question")), "soal").otherwise("lanjutan")
    items = table(spark, d, "extracted").select("source_file", "ext_id", "steps", "answer", kind.alias("kind"))
    return sequence.continuation_merge(items, "source_file", ["ext_id"], "kind", "steps", "answer").select("source_file", "ext_id", "parts")


def text_keys(spark, d):
    return table(spark, d, "gold").select("rid", X.text_hash(F.col("soal")).alias("hash"))


def clean_texts(spark, d):
    return table(spark, d, "extracted").select("ext_id", X.clean_page_text(F.col("raw_text")).alias("page"), X.with_image_text(F.col("raw_text"), F.col("image_text")).alias("described"))


def solution_texts(spark, d):
    return table(spark, d, "correct").select("corr_id", X.strip_think(F.col("text")).alias("behind"), X.clean_solution(F.col("text")).alias("body"))


def rendered_chats(spark, d):
    return table(spark, d, "chatml").select("chat_id", X.chat_render(F.col("messages")).alias("rendered"))


def file_names(spark, d):
    return table(spark, d, "sources").select("slug", X.safe_filename(F.coalesce("filename", "slug"), 20, ".pdf").alias("safe"), X.mode_of_file(F.coalesce("filename", F.lit(""))).alias("mode"), X.relative_path(F.coalesce("url", F.lit("")), "https://contoh.id").alias("relative"))


def page_flags(spark, d):
    t = F.col("text")
    flags = {
        "marked": P.has_problem_marker(t, F.coalesce("source", F.lit("")), ["web_01"]), "verdict": P.is_valid_verdict(t), "letters": P.has_letters(t), "described": P.visual_reference_undescribed(t),
    }
    return table(spark, d, "documents").groupBy("jenis").agg(F.count(F.lit(1)).alias("n_rows"), *[reports.count_of(c, n) for n, c in flags.items()])


def chat_questions(spark, d):
    return table(spark, d, "chatml").select("chat_id", X.without_prompt(X.last_message(F.col("messages"), "user")).alias("question"))


QUERIES = {f.__name__: f for f in (
    gold_flag_counts, gold_flagged, gold_summary, gold_rates, chat_flag_counts, chat_rates, arm_delta, cleaning_report, cleaning_reasons_symbolic, holdout_counters, verdict_rates,
    judge_replies, judge_prompts, language_rates, language_labels, detected_languages, rule_reasons_detected, lexical_duplicate_rate, leak_examples, coverage_scores,
    embedding_survivors, embedding_twins, progress_log, json_lines_skipped, json_lines_kept, json_array_slice, csv_union, partitioned_gold,
    sampling_counters, merged_results, provenance_summary, solved_or_tried, unsolved, distinct_lines, first_links, protected_formulas, extraction_metrics, markdown_order,
    attached_images, field_tasks, translated_once, text_layers, page_payloads, continued_items, text_keys, clean_texts, solution_texts, rendered_chats, file_names, page_flags,
    chat_questions,
)}
