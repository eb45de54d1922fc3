"""Sinks. Spark's commit protocol makes each write atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv_union(frames: list[DataFrame], first: list[str]) -> DataFrame:
    """Union of columns, the preferred ones first, then sorted; nested values as JSON, null as empty text."""
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    names = [c for c in first if c in df.columns] + sorted(c for c in df.columns if c not in first)
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    return df.select(*[F.coalesce(F.to_json(c) if c in nested else F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)


def partitioned(df: DataFrame, path: str, flag: str) -> None:
    df.write.mode("overwrite").partitionBy(flag).parquet(path)


def markdown_table(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> str:
    """Rows by columns with three decimals, ``-`` for a missing cell; for small results."""
    cells = df.groupBy(row).pivot(column, columns).agg(F.first(F.format_string("%.3f", F.col(value)))).orderBy(row).collect()
    lines = [f"| {row} | " + " | ".join(columns) + " |", "|" + "---|" * (len(columns) + 1)]
    return "\n".join(lines + [f"| {r[0]} | " + " | ".join(x or "-" for x in r[1:]) + " |" for r in cells])


def json_summary(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("summary"))
