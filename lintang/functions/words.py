"""Word columns: a word is a longest run of letters and digits of any script, lower-cased."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """All words in order; null text gives an empty array."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def distinct_word_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the distinct words."""
    return F.array_sort(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))
