"""One row to many: question blocks, answer keys, page items, arms, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.predicates import is_valid_problem, text_or_empty, trimmed
from lintang.functions.text import chat_messages, clean_solution, extract_first, wrap_prompt
from lintang.functions.answers import extract_boxed_loose

# Patterns of numbered questions and answer sections.
SECTION = r"(?i)\n\s*(KUNCI|JAWABAN|PEMBAHASAN|PENYELESAIAN)\b"
SOAL_BLOCK = r"(?is)(?:^|\n)\s*SOAL\s+\d+\s*[:.)]?\s+(.*?)(?=\n\s*SOAL\s+\d+|\z)"
NUMBERED_BLOCK = r"(?s)(?:^|\n)\s*\d{1,3}[.)]\s+(.*?)(?=\n\s*\d{1,3}[.)]\s+|\z)"
FORMAT_A = r"(?is)SOAL\s+\d+\s*\n(.*?)(?=SOAL\s+\d+|\z)"
FORMAT_B = r"(?s)(?:^|\n)\s*(\d{1,2}\.\s+.*?)(?=\n\s*\d{1,2}\.\s+|\z)"
INLINE_ANSWER = r"(?i)Jawaban\s*:\s*(.+)"


def strip_answer_sections(c: Column) -> Column:
    """Text before the first answer section."""
    return trimmed(F.split(text_or_empty(c), SECTION, 2)[0])


def question_blocks(c: Column) -> Column:
    """SOAL blocks, else numbered blocks, else the whole text; blank text gives an empty array."""
    t = trimmed(c)
    clean = lambda a: F.transform(a, lambda x: trimmed(x))
    soal, numbered = (F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (SOAL_BLOCK, NUMBERED_BLOCK))
    return (
        F.when(t == "", F.array().cast("array<string>")).when(F.size(soal) > 0, clean(soal)).when(F.size(numbered) > 0, clean(numbered)).otherwise(F.array(t))
    )


def has_numbering(c: Column) -> Column:
    return trimmed(c).rlike(SOAL_BLOCK) | trimmed(c).rlike(NUMBERED_BLOCK)


def split_questions(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, position, question, numbered) of every block before the answer section."""
    body = strip_answer_sections(F.col(text))
    return df.select(F.col(id_col), has_numbering(body).alias("numbered"), F.posexplode(question_blocks(body)).alias("position", "question"))


def qa_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, question, answer): SOAL blocks with inline answers if there are any, else a numbered list with its key section.

    Of repeated numbers in the key the last one counts; questions that are no valid problem are dropped.
    """
    t = text_or_empty(F.col(text))
    a = F.transform(F.regexp_extract_all(t, F.lit(FORMAT_A), F.lit(1)), lambda x: trimmed(x))
    a = F.transform(a, lambda x: F.struct(trimmed(F.regexp_replace(x, INLINE_ANSWER, "")).alias("question"), trimmed(extract_first(x, INLINE_ANSWER)).alias("answer")))
    a = F.filter(a, lambda x: is_valid_problem(x["question"]))
    parts = F.split(t, r"(?i)\n(?=(?:KUNCI|JAWABAN|PEMBAHASAN|PENYELESAIAN)\b)", 2)
    key_lines = F.regexp_extract_all(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), F.lit(r"(?m)^\s*(\d{1,2}[.)]\s+.+)$"), F.lit(1))
    keys = F.transform(key_lines, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).alias("n"), trimmed(F.regexp_replace(x, r"^\d+[.)]\s+", "")).alias("v")))
    last = lambda n: F.coalesce(F.try_element_at(F.filter(keys, lambda k: k["n"] == n), F.lit(-1))["v"], F.lit(""))
    b = F.transform(
        F.regexp_extract_all(parts[0], F.lit(FORMAT_B), F.lit(1)),
        lambda x: F.struct(trimmed(F.regexp_replace(F.regexp_replace(x, r"^\d+\.\s+", ""), r"\n+", " ")).alias("question"), last(F.regexp_extract(x, r"^(\d+)", 1)).alias("answer")),
    )
    b = F.filter(b, lambda x: is_valid_problem(x["question"]))
    pairs = F.when(F.size(a) > 0, a).otherwise(b)
    return df.select(F.col(id_col), F.explode(pairs).alias("p")).select(id_col, "p.question", "p.answer")


def chat_arms(df: DataFrame, id_col: str, question: str, text: str) -> DataFrame:
    """(id, arm, messages): each judged solution as a row with reasoning and a row with the bare result."""
    boxed = extract_boxed_loose(F.col(text))
    rows = df.withColumn("__b", boxed).where("__b IS NOT NULL")
    arm = lambda name, said: F.struct(F.lit(name).alias("arm"), chat_messages(wrap_prompt(F.col(question), name), said).alias("messages"))
    both = F.array(arm("cot", clean_solution(F.col(text))), arm("nocot", F.concat(F.lit("\\boxed{"), F.col("__b"), F.lit("}"))))
    return rows.select(id_col, F.explode(both).alias("x")).select(id_col, "x.arm", "x.messages")


def candidate_rows(df: DataFrame, id_col: str, generations: str) -> DataFrame:
    return df.select(id_col, F.posexplode(generations).alias("candidate_idx", "text"))


def numbered_ids(df: DataFrame, document: str, page: str, order: str, prefix: str = "q") -> DataFrame:
    """Adds ``question_id`` = document, page and the running number on the page."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(document, page).orderBy(order))
    return df.withColumn("question_id", F.concat(F.col(document), F.format_string(f"_p%03d_{prefix}%02d", F.col(page), n)))
