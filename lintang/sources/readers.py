"""Readers with declared schemas; what happens to a malformed line is the caller's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintang.functions.predicates import is_valid_chat

GOLD = "soal string, cara string, jawaban string, source string, answer_type string, hard boolean"
CANDIDATE = "id string, soal string, jawaban string, cara string, source string, candidate_idx int, text string"
CHAT = "messages array<struct<role:string,content:string>>"
VERDICT = "rid int, soal string, gold string, lengkap string, jawaban string, penalaran string, _raw string"
PROGRESS = "id string, candidate_idx int"


def jsonl(spark: SparkSession, path: str | list[str], schema: str, bad_lines: str = "fail", pattern: str | None = None) -> DataFrame:
    """JSON lines; ``bad_lines`` is ``fail``, ``skip``, or ``keep`` (adds ``_parse_error``, the first 200 characters)."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if bad_lines == "keep":
        df = reader.schema(f"{schema}, _parse_error string").option("columnNameOfCorruptRecord", "_parse_error").json(path)
        return df.withColumn("_parse_error", F.substring("_parse_error", 1, 200))
    return reader.schema(schema).option("mode", {"fail": "FAILFAST", "skip": "DROPMALFORMED"}[bad_lines]).json(path)


def chat(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Valid chat rows; malformed lines and invalid rows are left out."""
    rows = jsonl(spark, path, CHAT, "skip").where(is_valid_chat(F.col("messages")))
    return rows if most is None else rows.limit(most)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a tab-separated log without header, each once."""
    return spark.read.schema(PROGRESS).option("sep", "\t").csv(path).distinct()


def json_array(spark: SparkSession, path: str, schema: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Slice [start, end) of the objects of one JSON array file, with their ``position``."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{_struct(schema)}>>")).alias("position", "x"))
    kept = rows.where(F.col("position") >= start)
    return (kept if end is None else kept.where(F.col("position") < end)).select("position", "x.*")


def _struct(schema: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (part.strip().split(" ", 1) for part in schema.split(",")))


def sample_cache(spark: SparkSession, folder: str, problems: DataFrame, index: str, most: int | None = None) -> DataFrame:
    """(index, gens): files p00000.json of string arrays; unreadable or missing files give an empty array."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="p*.json").select(
        F.regexp_extract(F.input_file_name(), r"p(\d+)\.json$", 1).cast("int").alias(index), F.from_json("value", "array<string>").alias("gens")
    )
    gens = F.coalesce("gens", F.array().cast("array<string>"))
    return problems.select(F.col(index).cast("int").alias(index)).join(files, index, "left").select(index, (gens if most is None else F.slice(gens, 1, most)).alias("gens"))


def keyed_responses(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Requests with the first non-empty text part of their response, or empty text."""
    first = F.try_element_at(F.filter("parts", lambda p: p != ""), F.lit(1))
    return requests.join(responses.select(key, first.alias("reply")), key, "left").withColumn("reply", F.coalesce("reply", F.lit("")))


def html_links(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, position, heading_year, url, label) of every link; the latest year heading holds for the links below it."""
    token = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>|<a\s[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>"
    tokens = df.select(F.col(id_col), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(token), F.lit(0))).alias("position", "t"))
    from lintang.operators.sequence import carry_down

    plain = F.trim(F.regexp_replace("t", r"<[^>]+>", " "))
    year = F.when(F.col("t").rlike(r"(?i)^<h"), F.nullif(F.regexp_extract(plain, r"\b(20\d{2})\b", 1), F.lit("")))
    marked = carry_down(tokens.withColumn("y", year), id_col, "position", "y", "heading_year")
    return marked.where(F.col("t").rlike(r"(?i)^<a")).select(
        id_col, "position", F.coalesce("heading_year", F.lit("unknown")).alias("heading_year"),
        F.regexp_extract("t", r"(?i)href=[\"']([^\"']+)[\"']", 1).alias("url"), plain.alias("label"),
    )


def landing_pdf(html: Column) -> Column:
    """First PDF of a landing page: a link, a frame, or the citation tag."""
    patterns = (r"(?i)<a\s[^>]*href=[\"']([^\"']+\.pdf[^\"']*)", r"(?i)<(?:iframe|embed)\s[^>]*src=[\"']([^\"']+\.pdf[^\"']*)", r"(?i)<meta\s[^>]*citation_pdf_url[^>]*content=[\"']([^\"']+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, is_pdf) by the first bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))
