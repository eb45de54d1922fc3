"""Row predicates as boolean columns. Null text counts as empty text unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must equal the established rules for the same rows to pass.
CHOICE_LOOSE = r"(?m)^\s*[A-Ea-e][.)\s]"
CHOICE_STRICT = r"(?m)^\s*[A-Ea-e][.)]\s+\S"
TRUE_FALSE_LOOSE = r"(?i)\b(benar|salah|true|false)\b.*\b(benar|salah|true|false)\b"
TRUE_FALSE_STRICT = (
    r"(?i)\b(pernyataan\s+berikut\s+(yang\s+)?(benar|salah)|benar\s+atau\s+salah|true\s+or\s+false|"
    r"tentukan\s+(mana\s+yang\s+)?(benar|salah))\b"
)
IMAGE_SHORT = (
    r"(?i)(lihat\s+gambar|perhatikan\s+gambar|gambar\s+di\s+(atas|bawah|samping)|pada\s+gambar|sesuai\s+gambar|"
    r"berdasarkan\s+gambar)"
)
IMAGE_LONG = (
    r"(?i)\b(lihat\s+(gambar|foto|tabel|diagram|grafik)|perhatikan\s+(gambar|foto|tabel|diagram|grafik)|pada\s+gambar|"
    r"gambar\s+(di\s+)?(atas|bawah|samping|berikut)|sesuai\s+(dengan\s+)?gambar|berdasarkan\s+gambar|"
    r"ditunjukkan\s+(pada\s+)?gambar|gambar\s+\d+|pada\s+foto|foto\s+di\s+(atas|bawah)|yang\s+saya\s+kirim|terlampir)\b"
)
IMAGE_HINT = r"(?i)\b(gambar|diagram|grafik|tabel|foto|ilustrasi|fig|figure)\b"
EXTERNAL_CONTEXT = (
    r"(?i)\b(menurut|berdasarkan|sesuai)\b.*\b(laporan|tabel|grafik|gambar|diagram|teks|bacaan|paragraf|data|kutipan|artikel|"
    r"wacana|cerita)\b|\b(tabel|grafik|gambar|diagram|teks|bacaan|paragraf|wacana)\b\s+(di\s+atas|berikut|di\s+bawah|tersebut)"
)
INDONESIAN_CUES = (
    r"(?i)\b(adalah|maka|sehingga|dengan|untuk|kita|persamaan|jawaban|nilai|langkah|diketahui|jadi|misalkan|karena|bilangan|"
    r"sebuah|pada|dari|yang)\b"
)
ENGLISH_CUES = (
    r"(?i)\b(the|is|we|so|therefore|equation|answer|value|step|since|let|because|first|then|thus|need|find|number|given|"
    r"where|which|that)\b"
)
PROBLEM_KEYWORDS = (
    r"(?i)\b(tentukan|hitunglah|carilah|buktikan|tunjukkan|hitung|cari|berapakah|berapa|banyaknya|nilai\s+dari|ada\s+berapa|"
    r"adalah|jika|diketahui|diberikan|misalkan|suatu|sebuah)\b"
)
MATH_SIGNS = (
    r"(\d+[+\-*/^=<>]\d+|\d+[a-zA-Z]|[a-zA-Z]\s*=\s*-?\d+|[a-zA-Z]\s*\^\s*\d+|\\[a-zA-Z]+\{|\$[^$\n]+\$)"
)
GARBLED = r"�|Ã[\x80-\xbf]|â€|Â[\x80-\xbf]|[\x00-\x08\x0b\x0c\x0e-\x1f]"
HARD_TOPICS = (
    r"(?i)(integral|∫|\\int|analiti|akar kesatuan|persamaan fungsi|modulo|kombinator|deret tak hingga|\\sum|\\prod|kompleks|"
    r"matriks|turunan|\\lim)"
)
UNIT_WORDS = r"(?i)(meter|cm|km|kg|gram|liter|rp|juta|ribu|orang|cara|buah|detik|menit|jam|°|satuan|\s)"
NEEDS_VISUAL = r"(?i)(tabel|gambar|grafik|diagram|di atas|berikut ini|perhatikan|kurva|histogram)"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.regexp_replace(text_or_empty(c), r"^\s+|\s+$", "")


def matches(c: Column, pattern: str) -> Column:
    return text_or_empty(c).rlike(pattern)


def count_of(c: Column, literal: str) -> Column:
    """Occurrences of a literal, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def is_multiple_choice(c: Column, strict: bool = False) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(CHOICE_STRICT if strict else CHOICE_LOOSE)) >= 3


def is_true_false(c: Column, strict: bool = False) -> Column:
    return matches(c, TRUE_FALSE_STRICT if strict else TRUE_FALSE_LOOSE)


def needs_image(c: Column, long_list: bool = False) -> Column:
    return matches(c, IMAGE_LONG if long_list else IMAGE_SHORT)


def mentions_image(c: Column) -> Column:
    return matches(c, IMAGE_HINT)


def needs_external_context(c: Column) -> Column:
    return matches(c, EXTERNAL_CONTEXT)


def visual_reference_undescribed(c: Column, least: int = 25) -> Column:
    """Refers to something visual, and no ``[Gambar: ...]`` description of at least ``least`` characters is there."""
    described = F.exists(
        F.regexp_extract_all(text_or_empty(c), F.lit(r"\[Gambar:([^\]]*)\]"), F.lit(1)), lambda d: F.length(F.trim(d)) >= least
    )
    return matches(F.regexp_replace(text_or_empty(c), r"\[Gambar:[^\]]*\]", ""), IMAGE_LONG) & ~described


def cue_language(c: Column) -> Column:
    """``id`` if there are at least as many Indonesian as English cue words, else ``en``."""
    own, other = (F.regexp_count(text_or_empty(c), F.lit(p)) for p in (INDONESIAN_CUES, ENGLISH_CUES))
    return F.when(own >= other, "id").otherwise("en")


# Words that mark a text as Indonesian, and what is not language in a formula-laden text.
INDONESIAN_TOKENS = (
    "dan", "atau", "yang", "dengan", "dari", "untuk", "pada", "adalah", "ini", "itu", "akan", "tidak", "jika", "maka", "nilai", "carilah",
    "tentukan", "hitunglah", "buktikan", "diketahui", "misalkan", "penyelesaian", "sebuah", "suatu", "bilangan", "persamaan",
)
NOT_LANGUAGE = r"\$[^$]+\$|\\[a-zA-Z]+\{[^}]*\}|\\[a-zA-Z]+|[0-9+\-*/^_=().]+"


def language_label(c: Column, detected: Column | None = None) -> Column:
    """``id``, ``en`` or ``unknown``: no word left beside formulas is unknown, an Indonesian token is id; the rest is ``detected``.

    ``detected`` is what a detector says (en, or anything else for id, null where it failed); without it cue words decide.
    """
    plain = F.lower(F.regexp_replace(text_or_empty(c), NOT_LANGUAGE, " "))
    found = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    other = cue_language(c) if detected is None else F.when(detected == "en", "en").when(detected.isNotNull(), "id").otherwise("unknown")
    return F.when(F.size(found) == 0, "unknown").when(F.arrays_overlap(found, F.array(*[F.lit(t) for t in INDONESIAN_TOKENS])), "id").otherwise(other)


def is_indonesian(c: Column) -> Column:
    return cue_language(c) == "id"


def is_valid_problem(c: Column) -> Column:
    t = trimmed(c)
    return F.length(t).between(30, 1500) & (t.rlike(PROBLEM_KEYWORDS) | t.rlike(MATH_SIGNS))


def is_garbled(c: Column) -> Column:
    return matches(c, GARBLED)


def is_numeric_gold(c: Column) -> Column:
    bare = F.regexp_replace(text_or_empty(c), UNIT_WORDS, "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\.+|\.+$", ""), r"^\$+|\$+$", "").rlike(r"^-?\d+([.,]\d+)?$")


def is_clean_school_item(question: Column, answer: Column) -> Column:
    j = trimmed(answer)
    size = F.length(text_or_empty(question))
    return (j != "") & ~j.rlike(r"^[A-E]\.?$") & ~matches(question, NEEDS_VISUAL) & is_numeric_gold(answer) & (size > 20) & (size < 600)


def is_latex_balanced(c: Column) -> Column:
    t = text_or_empty(c)
    return (
        (count_of(t, r"\(") == count_of(t, r"\)"))
        & (count_of(t, r"\[") == count_of(t, r"\]"))
        & (count_of(t, "{") == count_of(t, "}"))
        & (count_of(t, "$") % 2 == 0)
    )


def is_hard_topic(c: Column) -> Column:
    return matches(c, HARD_TOPICS)


def looks_complete(c: Column) -> Column:
    return trimmed(c).rlike(r"[.?!:;]$")


def has_problem_marker(c: Column, folder: Column, always: list[str]) -> Column:
    """A page worth reading: of a listed folder, short, or with a problem marker."""
    marker = r"(?i)\b(soal|jawaban|pembahasan|tentukan|hitung|buktikan|berapa)\b|(?m)^\s*\d{1,3}[.)]\s"
    return folder.isin(always) | (F.length(trimmed(c)) < 40) | matches(c, marker)


def page_route(c: Column, image_share: Column) -> Column:
    """``skip`` below 40 characters, ``image`` with large images or mostly short lines, else ``text``."""
    lines = F.filter(F.split(text_or_empty(c), "\n"), lambda x: F.trim(x) != "")
    short = F.when(F.size(lines) == 0, 1.0).otherwise(F.size(F.filter(lines, lambda x: F.length(F.trim(x)) <= 3)) / F.size(lines))
    return F.when(F.length(trimmed(c)) < 40, "skip").when((image_share > 0.12) | (short > 0.3), "image").otherwise("text")


def needs_fill(answer: Column, steps: Column) -> Column:
    return (trimmed(answer) == "") | (trimmed(steps) == "")


def is_valid_verdict(reply: Column) -> Column:
    up = F.upper(trimmed(reply))
    return up.contains("VALID") & ~up.contains("TIDAK_VALID") & ~up.contains("TIDAK VALID")


def is_valid_chat(messages: Column) -> Column:
    """Two messages or more, a user and an assistant role, and an assistant message that is not blank."""
    role = lambda name: F.exists(messages, lambda m: m["role"] == name)
    filled = F.exists(messages, lambda m: (m["role"] == "assistant") & (trimmed(m["content"]) != ""))
    return F.coalesce((F.size(messages) >= 2) & role("user") & role("assistant") & filled, F.lit(False))


def is_usable_record(question: Column, answer: Column) -> Column:
    return (trimmed(question) != "") | (trimmed(answer) != "")


def has_letters(c: Column) -> Column:
    return matches(c, r"\p{L}")


def in_shard(index: Column, shard: int, shards: int) -> Column:
    return F.lit(True) if shards <= 1 else F.pmod(index, F.lit(shards)) == shard


def reason_rules(c: Column, version: int = 2, language_ok: Column | None = None) -> Column:
    """First rule that rejects the text, or null; versions 1 to 3 differ in rules and their order."""
    short = (F.length(trimmed(c)) < 10, "too_short")
    language = (~(is_indonesian(c) if language_ok is None else language_ok), "not_indonesian")
    rules = {
        1: [(is_multiple_choice(c), "multiple_choice"), (is_true_false(c), "true_false"), (needs_image(c), "needs_image"), language],
        2: [short, (is_multiple_choice(c, True), "multiple_choice"), (is_true_false(c, True), "true_false"), (needs_image(c, True), "needs_image"), language],
        3: [short, (is_multiple_choice(c, True), "multiple_choice"), (is_true_false(c, True), "true_false")],
    }[version]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out
