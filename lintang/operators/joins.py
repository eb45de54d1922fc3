"""Set membership and lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.predicates import trimmed
from lintang.functions.text import squeeze
from lintang.operators.dedup import best_per_key


def decontaminate(train: DataFrame, test: DataFrame, train_text: str, test_text: str) -> DataFrame:
    """Training rows whose squeezed text is not among the test texts; null counts as empty text."""
    keys = test.select(squeeze(F.col(test_text)).alias("__k")).distinct()
    return train.withColumn("__k", squeeze(F.col(train_text))).join(keys, "__k", "left_anti").drop("__k")


def overlay_cache(base: DataFrame, cache: DataFrame, key: str, fields: list[str], ok: str, order: str) -> DataFrame:
    """The last successful cache row of a key replaces all fields; other rows stay. Adds ``filled``."""
    good = cache.where(F.col(ok)).select(trimmed(F.col(key)).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields], F.col(order).alias("__o"))
    last = best_per_key(good, F.col("__k"), [F.col("__o")]).drop("__o").withColumn("__hit", F.lit(True))
    joined = base.withColumn("__k", trimmed(F.col(key))).join(last, "__k", "left")
    hit = F.col("__hit").isNotNull()
    replaced = {f: F.when(hit, F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(replaced | {"filled": hit}).select(*base.columns, "filled")


def tag_provenance(df: DataFrame, text: str, certain: DataFrame, school: DataFrame, sub: DataFrame) -> DataFrame:
    """Adds ``tag``: AIMO (certain), UN, AIMO (sub), unknown, in this priority. Sets have a column ``text``."""
    out = df.withColumn("__k", trimmed(F.col(text)))
    for name, keys in (("certain", certain), ("school", school), ("sub", sub)):
        out = out.join(keys.select(trimmed(F.col("text")).alias("__k")).distinct().withColumn(f"__{name}", F.lit(True)), "__k", "left")
    tag = F.when(F.col("__certain"), "AIMO").when(F.col("__school"), "UN").when(F.col("__sub"), "AIMO").otherwise("unknown")
    return out.withColumn("tag", tag).select(*df.columns, "tag")


def without_done(df: DataFrame, done: list[DataFrame], keys: list[str]) -> DataFrame:
    """Resume: rows whose key is in none of the done tables."""
    for table in done:
        df = df.join(table.select(*keys).distinct(), keys, "left_anti")
    return df


def missing_indices(problems: DataFrame, candidates: DataFrame, key: str, wanted: int) -> DataFrame:
    """(key, candidate_idx) still to be made for each problem with fewer than ``wanted`` candidates."""
    have = candidates.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("have"))
    open_rows = problems.select(key).distinct().join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < wanted)
    return open_rows.select(key, F.explode(F.sequence(F.col("have"), F.lit(wanted - 1))).alias("candidate_idx"))


def cross_arm(a: DataFrame, b: DataFrame, question: str, answer: str, order: str, normal: Column | None = None) -> DataFrame:
    """(question_key, answer_a, answer_b, same): both arms joined on the squeezed question, last row of a key wins."""
    sides = []
    for df, name in ((a, "answer_a"), (b, "answer_b")):
        keyed = df.select(squeeze(F.col(question)).alias("question_key"), F.col(answer).alias(name), F.col(order).alias("__o"))
        sides.append(best_per_key(keyed, F.col("question_key"), [F.col("__o")]).drop("__o"))
    return sides[0].join(sides[1], "question_key").withColumn("same", F.coalesce(F.col("answer_a") == F.col("answer_b"), F.lit(False)))


def pool_intersection(pools: list[DataFrame], key: str) -> DataFrame:
    common = pools[0].select(key).distinct()
    for pool in pools[1:]:
        common = common.intersect(pool.select(key))
    return common


def carried_from_first(df: DataFrame, keys: dict[str, Column], known: dict[str, DataFrame]) -> DataFrame:
    """Rows of which no key stands in the matching table of known values (column ``value``); null keys never match."""
    for name, key in keys.items():
        values = known[name].select(F.col("value").alias("__v")).where("__v IS NOT NULL").distinct()
        df = df.withColumn("__v", key).join(values, "__v", "left_anti").drop("__v")
    return df
