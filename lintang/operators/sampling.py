"""Deterministic splits and samples by hash rank, without a global shuffle order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.session import materialize


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def smallest(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash rank; ties by the key. Each task keeps only its best n rows."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def holdout(df: DataFrame, key: str, n: int, seed: int = 42, eligible: Column | None = None) -> DataFrame:
    """Adds ``part``: ``test`` for min(n, half) of the eligible rows, ``train`` for all others; the key must be unique."""
    pool = df if eligible is None else df.where(eligible)
    size = min(n, pool.count() // 2 if eligible is None else pool.count())
    chosen = smallest(pool.select(key), key, size, seed).withColumn("__t", F.lit(True))
    return df.join(chosen, key, "left").withColumn("part", F.when(F.col("__t"), "test").otherwise("train")).drop("__t")


def train_val(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds ``part``; max(1, floor(n * ratio)) validation rows, none for ratio <= 0 or fewer than two rows."""
    total = df.count()
    if ratio <= 0 or total < 2:
        return df.withColumn("part", F.lit("train"))
    chosen = smallest(df.select(key), key, max(1, int(total * ratio)), seed).withColumn("__t", F.lit(True))
    return df.join(chosen, key, "left").withColumn("part", F.when(F.col("__t"), "val").otherwise("train")).drop("__t")


def leak_safe_holdout(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """As ``holdout``, but all rows of a question go to the same part; n counts questions."""
    keyed = df.withColumn("__k", key)
    chosen = smallest(keyed.select("__k").distinct(), "__k", n, seed).withColumn("__t", F.lit(True))
    return keyed.join(chosen, "__k", "left").withColumn("part", F.when(F.col("__t"), "test").otherwise("train")).drop("__k", "__t")


def bounded_sample(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """At most n rows by smallest hash of ``key``, of a table of ``total`` rows; the same rows at any partitioning.

    A hash threshold leaves about 1.5 n rows of the whole table, so that what reaches the driver does not grow with
    the number of tasks, as a plain sort with limit would let it.
    """
    scale = 1 << 40
    share = min(1.0, (1.5 * n + 200) / max(total, 1))
    hashed = df.withColumn("__h", F.pmod(F.xxhash64(key, F.lit(17)), F.lit(scale)))
    order = [c for c in df.columns]
    return hashed.where(F.col("__h") < int(share * scale)).orderBy("__h", *order).limit(n).drop("__h")


def bounded_top(df: DataFrame, count: str, n: int) -> DataFrame:
    """The rows with the greatest counts, at most n; of the count class that crosses n as many as fit, chosen by hash.

    A histogram of the counts (eight classes per doubling) and a hash threshold in the crossing class bound what leaves the tasks.
    """
    klass = F.floor(F.log2(F.col(count).cast("double")) * 8)
    stored = materialize(df.where(F.col(count) > 0).withColumn("__k", klass).withColumn("__h", F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40))))
    whole, crossing, room, share, seen = None, None, 0, 0.0, 0
    for r in stored.groupBy("__k").count().orderBy(F.desc("__k")).collect():
        if seen + r["count"] > n:
            crossing, room = r["__k"], n - seen
            share = min(1.0, (1.5 * room + 200) / r["count"])
            break
        seen += r["count"]
        whole = r["__k"]
    kept = stored.where(F.lit(False) if whole is None else F.col("__k") >= whole)
    if room:
        fitting = stored.where((F.col("__k") == crossing) & (F.col("__h") < int(share * (1 << 40))))
        kept = kept.unionByName(fitting.orderBy("__h", *df.columns).limit(room))
    return kept.drop("__k", "__h")


def ranked(df: DataFrame, value: str, rank: int) -> float:
    """The value that stands at ``rank``, from 0 on, of all values in rising order; no nulls.

    A histogram between the smallest and the greatest value tells the class that holds the rank, in which the next one is taken, until
    few rows are left. Each step reads the rows of ``df``, which should be stored.
    """
    low, high, within, left = None, None, df, rank
    while True:
        if low is None:
            r = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n")).first()
        else:
            share = (F.col(value) - low) / (high - low)
            klass = F.least(F.floor(share * 1000), F.lit(999))
            classes = within.groupBy(klass.alias("k")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
            for r in classes.orderBy("k").collect():
                if left < r["n"]:
                    break
                left -= r["n"]
        low, high = r["low"], r["high"]
        if low == high:
            return low
        within = df.where(F.col(value).between(low, high))
        if r["n"] <= 10_000:
            return sorted(x[value] for x in within.select(value).collect())[left]
