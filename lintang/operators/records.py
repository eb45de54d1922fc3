"""Record, set and page operators: line and link dedup, set tests, translate-once pools, image attachment, fan-out, sampling of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.predicates import mentions_image, trimmed
from lintang.functions.text import drive_id, normalize_url, reattach_space
from lintang.operators.dedup import best_per_key


def distinct_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Each non-blank line once."""
    return lines.select(column).where(trimmed(F.col(column)) != "").distinct()


def first_links(links: DataFrame, url: str, order: list[Column]) -> DataFrame:
    """The first link of each Drive file or, for other links, of each normalised address; null addresses are dropped."""
    key = F.coalesce(drive_id(F.col(url)), normalize_url(F.col(url)))
    return best_per_key(links, key, [-c for c in order])


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that stand on one side only; no row if the two sets are equal. Null is a key like any other."""
    a = left.select(key).distinct().withColumn("__a", F.lit(True))
    b = right.select(F.col(key).alias("__k")).distinct().withColumn("__b", F.lit(True))
    both = a.join(b, F.col(key).eqNullSafe(F.col("__k")), "full").where("__a IS NULL OR __b IS NULL")
    return both.select(F.when(F.col("__a").isNotNull(), F.col(key)).otherwise(F.col("__k")).alias(key), F.when(F.col("__a").isNotNull(), "left").otherwise("right").alias("side"))


def aligned_by_index(rows: DataFrame, generations: DataFrame, index: str) -> DataFrame:
    """Rows with the generation of the same explicit index; rows without one are dropped."""
    return rows.join(generations, index)


def missing_files(wanted: DataFrame, present: DataFrame, path: str) -> DataFrame:
    """Wanted paths that are not there, to be reported and skipped."""
    return wanted.join(present.select(path).distinct(), path, "left_anti")


def attach_images(blocks: DataFrame, page: list[str], text: str, images: str) -> DataFrame:
    """``images`` stay with a block that mentions one, or that is the only block of its page; other blocks get an empty array."""
    alone = blocks.groupBy(*page).agg(F.count(F.lit(1)).alias("__n"))
    joined = blocks.join(alone, page)
    keep = mentions_image(F.col(text)) | (F.col("__n") == 1)
    kind = dict(blocks.dtypes)[images]
    return joined.withColumn(images, F.when(keep, F.coalesce(F.col(images), F.array().cast(kind))).otherwise(F.array().cast(kind))).drop("__n")


def field_tasks(df: DataFrame, id_col: str, fields: list[str], shortest: int = 5) -> DataFrame:
    """(id, field, text): one row for each field of at least ``shortest`` characters."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")
    return df.select(F.col(id_col), pairs).select(id_col, "x.field", "x.text").where(F.length("text") >= shortest)


def translate_once(segments: DataFrame, text: str, translate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each distinct text with a letter goes once through ``translate`` (text -> text, translated); white space at its ends is kept.

    Adds ``translated``; texts without letters stay as they are. The pool is joined back by text.
    """
    pool = segments.where(F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text")).distinct()
    done = translate(pool).select(F.col("text").alias("__t"), F.col("translated").alias("__to"))
    joined = segments.join(done, F.col(text) == F.col("__t"), "left")
    return joined.withColumn("translated", F.when(F.col("__to").isNotNull(), reattach_space(F.col(text), F.col("__to"))).otherwise(F.col(text))).drop("__t", "__to")


def sampled_pages(pages: DataFrame, document: str, page: str, most: int = 20) -> DataFrame:
    """At most ``most`` evenly spaced pages (numbered from 0) of each document."""
    sizes = pages.groupBy(document).agg(F.count(F.lit(1)).alias("__n"))
    number = F.floor(F.col(page) * most / F.col("__n"))
    first = F.ceil(number * F.col("__n") / most)
    return pages.join(sizes, document).where((F.col("__n") <= most) | (F.col(page) == first)).drop("__n")


def text_layers(pages: DataFrame, document: str, page: str, text: str, most: int = 20, least: int = 40, share: float = 0.5) -> DataFrame:
    """(document, ratio, is_text): whether enough of the sampled pages have a text layer."""
    sampled = sampled_pages(pages, document, page, most)
    filled = F.avg((F.length(trimmed(F.col(text))) >= least).cast("double"))
    return sampled.groupBy(document).agg(F.round(filled, 4).alias("ratio"), (filled >= share).alias("is_text"))


def priority_order(path_folder: Column, name: Column, first: list[str]) -> list[Column]:
    """Sort order: listed folders first, in their order, then the lower-cased name."""
    place = F.lit(len(first))
    for number, folder in reversed(list(enumerate(first))):
        place = F.when(path_folder == folder, number).otherwise(place)
    return [place, F.lower(name)]


def chosen_sources(sources: DataFrame, slug: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources whose slug is wanted, wanted slugs that do not exist)."""
    return sources.join(wanted, slug, "left_semi"), wanted.join(sources.select(slug), slug, "left_anti")
