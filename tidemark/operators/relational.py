"""Relational shapes behind business questions, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "like": lambda c, v: c.ilike(v),
}


def money(column: Column | str) -> Column:
    """The column as an exact amount with two decimals, so that sums don't depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def total(column: Column | str) -> Column:
    return F.sum(money(column)).cast("double")


def mean(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(F.sum(money(c)).cast("double") / F.nullif(F.count(c), F.lit(0)), 4)


def filter_by_specs(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Rows that satisfy all specs: dicts of column, operator (or op; = by default) and value.

    Specs without a column or a value are skipped. Of several specs on a column, those that aren't
    equalities hold together; if all are equalities, the first holds.
    """
    by_column: dict[str, list[tuple[str, object]]] = {}
    for s in specs:
        if s.get("column") and s.get("value") is not None:
            by_column.setdefault(s["column"], []).append((s.get("operator") or s.get("op") or "=", s["value"]))
    held = []
    for column, found in by_column.items():
        ranges = [f for f in found if f[0] != "="]
        held += [COMPARE[op.lower()](F.col(column), value) for op, value in (ranges or found[:1])]
    return df.where(reduce(lambda a, b: a & b, held, F.lit(True)))


def join_related(tables: dict[str, DataFrame], edges: Sequence[tuple[str, str, str, str]], first: str, second: str) -> DataFrame:
    """The two tables joined along the edge (child, child column, parent, parent column) between them, whichever is named first."""
    for child, key, parent, parent_key in edges:
        if {child, parent} == {first, second}:
            keys = {child: key, parent: parent_key}
            a, b = tables[first], tables[second]
            return a.join(b, a[keys[first]] == b[keys[second]])
    raise ValueError(f"no relationship between {first} and {second}")


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is in none of the values; none at all if a value is null, as NOT IN has it.

    The null check is one row, so the rest stays a plain anti join on the key.
    """
    one = values.columns[0]
    nulls = values.agg(F.max(F.col(one).isNull().cast("int")).alias("_null"))
    named = values.select(F.col(one).alias("_value"))
    kept = df.where(F.col(column).isNotNull()).join(named, F.col(column) == F.col("_value"), "left_anti")
    return kept.join(F.broadcast(nulls), F.coalesce("_null", F.lit(0)) == 0).drop("_null")


def above_group_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows whose value is above the mean of their own group; sums combine before they shuffle."""
    means = df.groupBy(F.col(group).alias("_group")).agg((F.sum(money(value)).cast("double") / F.nullif(F.count(value), F.lit(0))).alias("_mean"))
    return df.join(means, F.col(group).eqNullSafe(F.col("_group")) & (F.col(value) > F.col("_mean"))).drop("_group", "_mean")


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in an order that should be total; rank counts them from 1."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def representative(df: DataFrame, group: str, key: str) -> DataFrame:
    """One row per group, that with the smallest key: an aggregation, not a sort."""
    columns = [c for c in df.columns if c not in (group, key)]
    best = df.groupBy(group).agg(F.min(F.struct(key, *columns)).alias("_row"))
    return best.select(group, "_row.*")


def rollup_onto_parent(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, value: str, count_as: str, total_as: str) -> DataFrame:
    """parent with the count and the sum of its children, zero for the childless."""
    sums = child.groupBy(F.col(child_key).alias("_key")).agg(F.count(F.lit(1)).alias(count_as), total(value).alias(total_as))
    joined = parent.join(sums, F.col(parent_key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({count_as: F.coalesce(count_as, F.lit(0)), total_as: F.coalesce(total_as, F.lit(0.0))})


def trend(df: DataFrame, moment: str, value: str, monthly: bool = True) -> DataFrame:
    """Rows and sum per month (or year): year, month, n, total."""
    keys = [F.year(moment).alias("year")] + [F.month(moment).alias("month")] * monthly
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), total(value).alias("total"))


def growth(monthly: DataFrame) -> DataFrame:
    """A monthly trend with the previous month's total and the growth in percent.

    The window runs over one row per month, not over raw rows.
    """
    w = Window.orderBy("year", "month")
    before = F.lag("total").over(w)
    return monthly.withColumn("previous", before).withColumn("growth", F.round(F.try_divide(F.col("total") - F.col("previous"), F.col("previous")) * 100, 4))


def share(condition: Column) -> Column:
    """The percentage of rows that meet a condition."""
    return F.round(F.count(F.when(condition, 1)) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 4)


def bag_union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_source(base: DataFrame, incoming: DataFrame, source_col: str, source: str) -> DataFrame:
    """base without the source's rows, then incoming: merging again gives the same rows."""
    return bag_union(base.where(~F.col(source_col).eqNullSafe(F.lit(source))), incoming)


def overlap(items: DataFrame, item_col: str, texts: DataFrame, text_col: str) -> DataFrame:
    """items with in_corpus: whether the item's text, trimmed and in lower case, is one of the texts."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    found = texts.select(F.sha2(key(text_col), 256).alias("_h")).distinct().withColumn("in_corpus", F.lit(True))
    return items.withColumn("_h", F.sha2(key(item_col), 256)).join(found, "_h", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False))).drop("_h")
