"""The registered pN_ queries; each takes (spark, directory of the tables) and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintang.llm import consensus, cross_split, defects, encoding, leakage, near_duplicates, residue, scanned, token_ids
from lintang.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scanned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """(id, noise, repaired) per table; one model over the texts of both."""
    gold, extracted = table(spark, sf_dir, "gold"), table(spark, sf_dir, "extracted")
    pages = gold.select(F.col("soal").alias("text"), F.col("source").alias("file"))
    texts = spread(pages.unionByName(extracted.select(F.col("raw_text").alias("text"), F.col("source_file").alias("file"))), 1)
    model = scanned.page_model(texts)
    return {
        "gold": scanned.scan_noise(gold, "rid", F.col("soal"), model),
        "extracted": scanned.scan_noise(extracted, "ext_id", F.col("raw_text"), model),
    }


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        found.select(F.lit(name).alias("tbl"), F.col("id").alias("row_id"), F.explode("noise").alias("noise"))
        for name, found in _scanned(spark, sf_dir).items()
    ]
    return parts[0].unionByName(parts[1])


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy records with their repaired text."""
    parts = [
        found.select(F.lit(name).alias("tbl"), F.col("id").alias("row_id"), "repaired")
        for name, found in _scanned(spark, sf_dir).items()
    ]
    return parts[0].unionByName(parts[1])


def _survivors(spark: SparkSession, sf_dir: str, weights: str) -> DataFrame:
    gold, sources = table(spark, sf_dir, "gold"), table(spark, sf_dir, "sources")
    trust = sources.groupBy("slug").agg(F.max("trust").alias("source_trust"))
    rows = gold.select("rid", "soal", "cara", "jawaban", "scraped_at", "source").join(trust, gold["source"] == trust["slug"], "left")
    found = consensus.survivors(rows, "rid", "soal", ["soal", "cara", "jawaban"], F.col("source_trust"), F.col("scraped_at"), ["cara"], weights)
    return found.select(F.col("group").alias("group_rid"), "field", F.col("id").alias("from_rid"), "value")


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving values in the order of trust, time and id."""
    return _survivors(spark, sf_dir, "rank")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving values by a vote of equal records: the existing value closest to the tokens that most records hold."""
    return _survivors(spark, sf_dir, "equal")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_survivors: the order alone decides. ``p2_consensus`` has the vote by alignment."""
    return p2_survivors(spark, sf_dir).select("group_rid", "field", "from_rid")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected fields with the text as stored and as restored."""
    gold = table(spark, sf_dir, "gold").select("rid", "soal", "cara")
    return encoding.restored_fields(gold, "rid", ["soal", "cara"]).withColumnRenamed("id", "rid")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("rid", "field")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "gold").select("rid", "soal")
    pairs = near_duplicates.near_duplicate_pairs(gold, "rid", "soal", 0.75, 12)
    return pairs.select(F.col("id_a").alias("rid_a"), F.col("id_b").alias("rid_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per gold row with enough words: its class of equal word sets, its size, and links to other classes."""
    gold = table(spark, sf_dir, "gold").select("rid", "soal")
    found = near_duplicates.near_duplicate_membership(gold, "rid", "soal", 0.8, 12)
    return found.select(F.col("id").alias("rid"), F.col("rep").alias("class_rid"), F.col("members").alias("class_size"), F.col("links").alias("linked_classes"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of class representatives with similarity of at least 0.8, beside the membership in p4_classes."""
    gold = table(spark, sf_dir, "gold").select("rid", "soal")
    links = near_duplicates.near_duplicate_classes(gold, "rid", "soal", 0.8, 12)[3]
    return links.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def _overlaps(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    gold = table(spark, sf_dir, "gold").where("split <> 'train_pool'").select("rid", "soal")
    chat = table(spark, sf_dir, "chatml").where("split = 'train'").select("chat_id", "messages")
    return cross_split.cross_split_overlaps(
        gold, chat, "rid", "chat_id", F.col("soal"), cross_split.chat_question(F.col("messages")), threshold, 12
    ).select(F.col("id_a").alias("rid"), F.col("id_b").alias("chat_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir, 0.75)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted per gold split and source."""
    found = _overlaps(spark, sf_dir, 0.75)
    per_row = found.groupBy("rid").agg(F.count(F.lit(1)).alias("pairs"))
    gold = table(spark, sf_dir, "gold").select("rid", "split", "source")
    return per_row.join(gold, "rid").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("pairs").alias("pairs")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat, correct = table(spark, sf_dir, "chatml"), table(spark, sf_dir, "correct")
    pairs = defects.prompt_answer_pairs(chat, correct, cross_split.chat_question(F.col("messages")))
    documents = table(spark, sf_dir, "documents").select("text", "lang")
    model = defects.pair_model(pairs, documents, "text", "lang", {"ms": "id"})
    return defects.defective_pairs(pairs, model)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of the latent search with their longest common run and subsequence."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return leakage.leaks(documents, items, "doc_id", "text", "item_id", "text", 12)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("run >= 12").select("item_id", "doc_id")


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item in other words, with its numbers, but no verbatim run of it."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = leakage.paraphrases(documents, items, "doc_id", "text", "item_id", "text")
    return found.where("run < 12 AND answer_share >= 0.8").select("item_id", "doc_id", F.round("lcs_share", 4).alias("lcs_share"), F.round("answer_share", 4).alias("answer_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    model = residue.residue_model(documents)
    return residue.residue_scores(documents, "doc_id", "text", model).where("score > 0").select(F.col("id").alias("doc_id"))


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the residue classifier on unseen sources, with all labels and without the labels that know a document."""
    return residue.validation(table(spark, sf_dir, "documents").select("text", "source"))


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_survivors": p2_survivors,
    "p2_consensus": p2_consensus,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p4_links": p4_links,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_paraphrases": p8_paraphrases,
    "p9_found": p9_found,
    "p9_validation": p9_validation,
}
