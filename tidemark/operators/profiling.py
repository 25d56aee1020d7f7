"""Profiles of tables: column types, sample values, summaries, constraint reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .relational import money

DATE_WORDS = ("date", "time", "day", "month", "year", "week")


def numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row (column, value as text) for each cell of the columns, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_c")).select("_c.*")


def unfold(row: DataFrame, columns: Sequence[str], parts: dict[str, str]) -> DataFrame:
    """One wide row of aggregates named <column>__<part> as a row for each column."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{p}").cast(kind).alias(p) for p, kind in parts.items()]) for c in columns])
    return row.select(F.explode(items).alias("_c")).select("_c.*")


def column_types(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """column, kind (date by its name, numeric if more than threshold of the values are numbers, else text)."""
    aggs = []
    for c in df.columns:
        text = F.col(c).cast("string")
        aggs += [F.count(F.col(c)).alias(f"{c}__n"), F.count(text.try_cast("double")).alias(f"{c}__numeric")]
    found = unfold(df.agg(*aggs), df.columns, {"n": "bigint", "numeric": "bigint"})
    dated = F.lit(False)
    for w in DATE_WORDS:
        dated = dated | F.lower("column").contains(w)
    kind = F.when(dated, "date").when(F.col("numeric") > threshold * F.col("n"), "numeric").otherwise("text")
    return found.select("column", kind.alias("kind"))


def sample_values(df: DataFrame, k: int = 3) -> DataFrame:
    """column, rank, value: the k smallest distinct values of each column, as text."""
    values = long_form(df, df.columns).where("value is not null").distinct()
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("rank") <= k)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_values(df: DataFrame, column: str, limit: int | None = 100) -> DataFrame:
    """The distinct values as text, ascending, the first `limit` (all with None)."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value")
    return values.limit(limit) if limit else values


def numeric_summary(df: DataFrame) -> DataFrame:
    """column, total, average, most, least of every numeric column, in one pass."""
    columns, aggs = numbers(df), []
    for c in columns:
        s = F.sum(F.col(c).cast("decimal(28,4)")).cast("double")
        aggs += [s.alias(f"{c}__total"), F.round(s / F.nullif(F.count(c), F.lit(0)), 4).alias(f"{c}__average"), F.max(c).alias(f"{c}__most"), F.min(c).alias(f"{c}__least")]
    return unfold(df.agg(*aggs), columns, dict.fromkeys(("total", "average", "most", "least"), "double"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, value, n for every text column; null is a value."""
    return long_form(df, columns or strings(df)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def constraint_report(df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[str] = (), checks: dict[str, Column] | None = None) -> DataFrame:
    """rule, violations. Checks fail on rows where the condition is false (null passes, as in SQL).

    All row rules are one aggregation; each uniqueness rule counts the rows beyond the first of a value.
    """
    rules = {f"not_null:{c}": F.col(c).isNull() for c in not_null} | {f"check:{name}": ~cond for name, cond in (checks or {}).items()}
    out = None
    if rules:
        names = list(rules)
        row = df.agg(*[F.count(F.when(rules[n], 1)).alias(f"r{i}") for i, n in enumerate(names)])
        out = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(names)])).alias("_r")).select("_r.*")
    for c in unique:
        repeats = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        repeats = repeats.select(F.lit(f"unique:{c}").alias("rule"), "violations")
        out = repeats if out is None else out.unionByName(repeats)
    return out


def fk_orphans(tables: dict[str, DataFrame], edges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """edge, orphans: child rows whose key no parent has, one row per edge."""
    out = None
    for child, key, parent, parent_key in edges:
        c, p = tables[child].select(F.col(key).alias("k")).where("k is not null"), tables[parent].select(F.col(parent_key).alias("k"))
        row = c.join(p, "k", "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(f"{child}.{key}->{parent}.{parent_key}").alias("edge"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out
