"""Projections and scalar text functions as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lintang.functions.predicates import is_indonesian, text_or_empty, trimmed

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# The two prompts before a question.
COT_PROMPT = (
    "Selesaikan soal matematika berikut. Tunjukkan langkah-langkah penyelesaian "
    "secara rinci dan sistematis dalam Bahasa Indonesia. Pastikan jawaban akhir "
    "(dan hanya jawaban) berada di dalam \\boxed{}.\n\n"
)
SHORT_PROMPT = "Selesaikan soal matematika berikut. Berikan HANYA jawaban akhir di dalam \\boxed{} tanpa langkah-langkah.\n\n"
# Rules of plain mathematics, in their order.
PLAIN_MATH = (
    (r"(?<!\$)(\d+)\s*/\s*(\d+)(?!\$)", r"$\\frac{\1}{\2}$"),
    (r"(?<!\$)([a-zA-Z0-9]+)\^(\d+)(?!\$)", r"$\1^{\2}$"),
    (r"(?<!\$)[√∛](\d+)(?!\$)", r"$\\sqrt{\1}$"),
    (r"(?<!\$)([a-zA-Z])_(\d+)(?!\$)", r"$\1_{\2}$"),
)
#: Cue of a competition level and its name, in the order in which they are tried.
LEVELS = (
    ("kabupaten", "kabupaten"), ("kota", "kabupaten"), ("provinsi", "provinsi"), ("nasional", "nasional"),
    ("semifinal", "nasional_semi"), ("semi final", "nasional_semi"), ("final", "nasional_final"),
)


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def squeeze(c: Column) -> Column:
    """Comparison key: white space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")))


def text_hash(c: Column) -> Column:
    return F.sha1(squeeze(c))


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host only, without slashes at the end."""
    url = F.trim(c)
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substr(url, F.length(head) + 1)), "/+$", "")


def drive_id(url: Column) -> Column:
    patterns = (r"drive\.google\.com/file/d/([^/?#]+)", r"drive\.google\.com/open\?id=([^&]+)", r"drive\.google\.com/uc\?.*?id=([^&]+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])


def drive_download_url(file_id: Column) -> Column:
    return F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id)


def parse_year(c: Column) -> Column:
    return first_or(F.regexp_extract(text_or_empty(c), r"\b(20\d{2})\b", 1), "unknown")


def first_or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def parse_level(c: Column) -> Column:
    low = F.lower(text_or_empty(c))
    out = F.when(low.contains(LEVELS[0][0]), LEVELS[0][1])
    for cue, name in LEVELS[1:]:
        out = out.when(low.contains(cue), name)
    return out.otherwise("unknown")


def safe_filename(c: Column, most: int = 120, suffix: str = "") -> Column:
    name = chain(trimmed(c), (r"[^\w\s.-]", ""), (r"[\s_]+", "_"), (r"^_+|_+$", ""))
    return F.concat(F.substring(name, 1, most), F.lit(suffix))


def slug(c: Column) -> Column:
    return first_or(chain(text_or_empty(c), (r"[^0-9A-Za-z._-]+", "_"), (r"^_+|_+$", "")), "x")


def clean_raw_text(c: Column) -> Column:
    """Extraction residue: URLs, private-use signs, trailing fragments, control characters, lines of 1 to 3 signs."""
    base = chain(
        text_or_empty(c), (r"(?i)https?://\S+", ""), (r"[\x{FFFD}\x{E0000}-\x{EFFFF}]", ""), (r"(?m)[ \t]+[a-zA-Z.]{1,2}$", ""), (CONTROL, "")
    )
    lines = F.filter(F.split(base, r"\r\n|\r|\n"), lambda x: ~trimmed(x).rlike(r"^.{1,3}$"))
    return trimmed(chain(F.array_join(lines, "\n"), (r" {2,}", " "), (r"\n{3,}", "\n\n")))


def clean_page_text(c: Column) -> Column:
    return trimmed(chain(text_or_empty(c), (r"\r", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def clean_record_text(c: Column) -> Column:
    return trimmed(chain(text_or_empty(c), (CONTROL, ""), (r" {2,}", " "), (r"\n{3,}", "\n\n")))


MATH_SPAN = re.compile(r"\$\$[\s\S]*?\$\$|\$[^$\n]+?\$|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)")


def math_segments(text: str) -> list[tuple[str, str]]:
    """Alternating (``text`` or ``math``, content)."""
    out, at = [], 0
    for m in MATH_SPAN.finditer(text or ""):
        if m.start() > at:
            out.append(("text", text[at : m.start()]))
        out.append(("math", m.group()))
        at = m.end()
    if text and at < len(text):
        out.append(("text", text[at:]))
    return out


def plain_math_to_latex(text: str) -> str:
    """Fractions, powers, roots and indices of plain text as inline LaTeX; existing formulas stay as they are."""
    out = []
    for kind, part in math_segments(text):
        if kind == "text":
            for pattern, to in PLAIN_MATH:
                part = re.sub(pattern, to, part)
        out.append(part)
    return "".join(out).strip()


def normalize_math(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: plain_math_to_latex(t) if t else t)

    return run(c)


def segments(c: Column) -> Column:
    @F.pandas_udf("array<struct<kind:string,content:string>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [{"kind": k, "content": s} for k, s in math_segments(t or "")])

    return run(c)


def pack(parts: list[str], most: int, joint: str) -> list[str]:
    """Greedy packing of parts up to ``most`` characters."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joint) + len(part) <= most:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def chunked(text: str | None, most: int) -> list[str]:
    """Chunks of at most ``most`` characters where paragraphs, sentences and words allow it; nothing is lost."""
    parts: list[str] = []
    for paragraph in re.split(r"\f|\n\s*\n", text or ""):
        if len(paragraph) <= most:
            parts += [paragraph.strip()] if paragraph.strip() else []
        else:
            sentences = re.split(r"(?<=[.!?])\s+", paragraph.strip())
            parts += [c for s in sentences for c in (pack(s.split(), most, " ") if len(s) > most else [s])]
    return pack(parts, most, "\n\n")


def chunks(c: Column, most: int = 6000) -> Column:
    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: chunked(t, most))

    return run(c)


def reattach_space(original: Column, replaced: Column) -> Column:
    return F.concat(F.regexp_extract(original, r"^\s*", 0), trimmed(replaced), F.regexp_extract(original, r"\s*$", 0))


def strip_think(c: Column) -> Column:
    at = F.instr(c, "</think>")
    return trimmed(F.when(at > 0, F.substr(c, at + 8)).otherwise(c))


def clean_solution(c: Column, keep_think: bool = False) -> Column:
    text = text_or_empty(c) if keep_think else F.regexp_replace(text_or_empty(c), r"(?i)</?think>", "")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def wrap_prompt(question: Column, mode: str = "cot") -> Column:
    if mode not in ("cot", "nocot"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.concat(F.lit(COT_PROMPT if mode == "cot" else SHORT_PROMPT), trimmed(question))


def unwrap_prompt(c: Column) -> Column:
    """Text behind the first blank line, or the whole text."""
    at = F.instr(c, "\n\n")
    return trimmed(F.when(at > 0, F.substr(c, at + 2)).otherwise(c))


def without_prompt(c: Column) -> Column:
    """Text without the long prompt, if it begins with exactly that."""
    return trimmed(F.when(c.startswith(COT_PROMPT), F.substr(c, F.lit(len(COT_PROMPT) + 1))).otherwise(c))


def last_message(messages: Column, role: str) -> Column:
    return text_or_empty(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"])


def chat_messages(user: Column, assistant: Column) -> Column:
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(one("user", user), one("assistant", assistant))


def chat_render(messages: Column) -> Column:
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), text_or_empty(m["content"]), F.lit("<|im_end|>"))
    return F.array_join(F.transform(messages, turn), "\n")


def training_target(steps: Column, answer: Column, most: int = 1200) -> Column:
    boxed = F.concat(F.lit("\\boxed{"), trimmed(answer), F.lit("}"))
    s = trimmed(steps)
    return F.when((s != "") & (F.length(s) <= most), F.concat(s, F.lit("\n\n"), boxed)).otherwise(boxed)


def solution_rank(c: Column) -> list[Column]:
    """Order of solutions: Indonesian first, then shorter."""
    return [F.when(is_indonesian(c), 0).otherwise(1), F.length(text_or_empty(c))]


def markdown_metrics(c: Column) -> Column:
    t = text_or_empty(c)
    n = F.greatest(F.length(t), F.lit(1))
    count = lambda p: F.regexp_count(t, F.lit(p))
    return F.struct(
        F.length(t).alias("chars"), count("[A-Za-z]{2,}").alias("words"), count(r"\(cid:\d+\)").alias("cid"), count("\ufffd").alias("repl"),
        (count(r"\(cid:\d+\)") / n * 1000).alias("cid_per_kc"), (count("\ufffd") / n * 1000).alias("repl_per_kc"), (count(r"\p{L}") / n).alias("alpha_ratio"),
    )


def markdown_verdict(m: Column) -> Column:
    """Joined reasons why an extracted page is broken; empty if it is good."""
    reasons = F.array(
        F.when((m["chars"] < 500) | (m["words"] < 50), F.format_string("kosong (chars=%d, words=%d)", m["chars"], m["words"])),
        F.when(m["cid_per_kc"] > 3.0, F.format_string("cid %.1f/kc", m["cid_per_kc"])),
        F.when(m["repl_per_kc"] > 1.0, F.format_string("repl %.1f/kc", m["repl_per_kc"])),
        F.when(m["alpha_ratio"] < 0.20, F.format_string("alpha %.2f", m["alpha_ratio"])),
    )
    return F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "; ")


def extraction_metrics(c: Column) -> Column:
    """(chars, cid, mathsym, latex) of an extracted text. The two patterns of signs are fixed values."""
    t = text_or_empty(c)
    count = lambda p: F.regexp_count(t, F.lit(p))
    return F.struct(
        F.length(t).alias("chars"), count(r"\(cid:\d+\)").alias("cid"), count("[√∫∑∏≤≥≠±∞→∂∆πθλµ²³¼½¾⁄∈∉⊂∪∩]").alias("mathsym"),
        count(r"\$[^$]+\$|\\frac|\\sqrt|\\int|\\sum").alias("latex"),
    )


def protect_formulas(c: Column) -> tuple[Column, Column]:
    """(text with ``__LATEXn__`` in place of each ``$..$``, the formulas in order)."""
    formulas = F.regexp_extract_all(text_or_empty(c), F.lit(r"\$[^$]+\$"), F.lit(0))
    pieces = F.split(text_or_empty(c), r"\$[^$]+\$", -1)
    marked = F.transform(pieces, lambda p, i: F.when(i < F.size(formulas), F.concat(p, F.lit("__LATEX"), i.cast("string"), F.lit("__"))).otherwise(p))
    return F.array_join(marked, ""), formulas


def restore_formulas(c: Column, formulas: Column) -> Column:
    """Inverse of ``protect_formulas``, also after the text around the marks was changed."""
    numbered = F.transform(formulas, lambda f, i: F.struct(F.concat(F.lit("__LATEX"), i.cast("string"), F.lit("__")).alias("k"), f.alias("f")))
    return F.aggregate(numbered, text_or_empty(c), lambda text, x: F.replace(text, x["k"], x["f"]))


def relative_path(path: Column, base: str) -> Column:
    """Path below ``base`` with forward slashes; other paths stay whole."""
    whole, root = F.replace(path, F.lit("\\"), F.lit("/")), base.rstrip("/") + "/"
    return F.when(whole.startswith(root), F.substr(whole, F.lit(len(root) + 1))).otherwise(whole)


def json_items(c: Column, item_schema: str) -> Column:
    """Objects of a JSON array inside a reply, code fences and text around it ignored; unreadable gives an empty array."""
    bare = F.regexp_replace(text_or_empty(c), r"```(?:json)?", "")
    array = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    single = F.concat(F.lit("["), F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("]"))
    items = F.from_json(F.when(array != "", array).otherwise(single), f"array<{item_schema}>")
    return F.filter(F.coalesce(items, F.array().cast(f"array<{item_schema}>")), lambda x: x.isNotNull())


def parse_verdict(c: Column, name: str, values: list[str], default: str) -> Column:
    return first_or(F.lower(F.regexp_extract(text_or_empty(c), rf"(?i){name}\s*=\s*({'|'.join(values)})", 1)), default)


def mode_of_file(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("nocot") | low.contains("no_cot"), "nocot").when(low.contains("cot"), "cot").otherwise("auto")


def with_image_text(text: Column, image_text: Column) -> Column:
    return F.when(trimmed(image_text) == "", text).otherwise(F.concat(trimmed(text), F.lit("\n\n[Deskripsi Gambar]\n"), trimmed(image_text)))


def extract_first(c: Column, pattern: str) -> Column:
    return F.regexp_extract(text_or_empty(c), pattern, 1)
