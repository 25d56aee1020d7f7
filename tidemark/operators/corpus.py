"""Corpora of questions and queries: statistics, enrichment, synthesis, noise, validation, splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from .ranges import number_in_groups


def bucket(*parts: Column | str, of: int = 100) -> Column:
    """A number below `of` drawn from the MD5 of the parts, the same on any partitioning and engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % of


def split_of(key: Column, train: int = 70, val: int = 15) -> Column:
    """train, val or test, by the key's bucket."""
    b = bucket(key)
    return F.when(b < train, "train").when(b < train + val, "val").otherwise("test")


def statistics(rows: DataFrame, tokens: str) -> DataFrame:
    """One row: n, tokens, unique_tokens, and least, most, mean, median tokens per record."""
    size = F.size(tokens)
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("tokens"), F.min(size).alias("least"), F.max(size).alias("most"), F.round(F.sum(size) / F.nullif(F.count(size), F.lit(0)), 4).alias("mean"), F.percentile(size, 0.5).alias("median"))
    unique = rows.select(F.explode(tokens).alias("t")).agg(F.countDistinct("t").alias("unique_tokens"))
    return one.crossJoin(unique)  # one row each


def label_distribution(rows: DataFrame, split: str, label: str) -> DataFrame:
    """split, label, n, percent of the split."""
    counts = rows.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(split).agg(F.sum("n").alias("_all"))
    return counts.join(sums, split).withColumn("percent", F.round(F.col("n") * 100.0 / F.col("_all"), 4)).drop("_all")


def enrich(rows: DataFrame, source: str, split: str, key: str, columns: dict[str, Column]) -> DataFrame:
    """rows with further columns and id = <source>_<split>_<number of the row in both by key, six digits>.

    Keys are unique; a row without one gets no id. Only keys, sources and splits are put in order; whole rows
    are joined with their numbers.
    """
    numbered = number_in_groups(rows.select(key, source, split).where(F.col(key).isNotNull()), [source, split], [F.asc(key)], "_number").select(F.col(key).alias("_key"), "_number")
    joined = rows.withColumns(columns).join(numbered, F.col(key) == F.col("_key"), "left")
    name = F.format_string("%s_%s_%06d", F.coalesce(source, F.lit("")), F.col(split), "_number")
    return joined.withColumn("id", F.when(F.col("_number").isNotNull(), name)).drop("_key", "_number")


def choose(draw: Column, weights: dict[str, int]) -> Column:
    """A name by cumulative weight; draw is below the weights' sum."""
    out, upto = None, 0
    for name, w in weights.items():
        upto += w
        out = (F if out is None else out).when(draw < upto, name)
    return out


def synthesise(rows: DataFrame, key: Column, templates: Sequence[tuple[str, str, str]], weights: dict[str, int], slots: dict[str, Column], seed: str) -> DataFrame:
    """rows' key with intent, question and query, drawn for each row from the templates (intent, question, query).

    The intent is drawn by weight, the template evenly among the intent's; {slot} is replaced by the
    slot's column. All draws come from the seed and the key. Templates are few and go into the plan.
    """
    by_intent = {i: [t for t in templates if t[0] == i] for i in weights}
    total = sum(weights.values())
    intent = choose(bucket(F.lit(seed), key, F.lit("intent"), of=total), weights)
    question = query = None
    for i, found in by_intent.items():
        pick = bucket(F.lit(seed), key, F.lit("template"), of=len(found))
        for n, (_, q, s) in enumerate(found):
            here = (F.col("intent") == i) & (pick == n)
            question, query = (F if question is None else question).when(here, q), (F if query is None else query).when(here, s)
    fill = lambda c: reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), slots.items(), F.col(c))
    drawn = rows.withColumn("intent", intent).withColumn("question", question).withColumn("query", query)
    return drawn.select(key.alias("key"), "intent", fill("question").alias("question"), fill("query").alias("query"))


def exact_sizes(rows: DataFrame, split: str, key: str, sizes: dict[str, int]) -> DataFrame:
    """Of each split, the rows with the smallest MD5 of their key, as many as asked for (all if there are fewer); other splits go."""
    wanted = rows.where(F.col(split).isin(*sizes)).withColumn("_h", F.md5(F.col(key).cast("string")))
    numbered = number_in_groups(wanted, [split], [F.asc("_h"), F.asc(key)], "_number")
    limit = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return numbered.where(F.col("_number") < F.element_at(limit, F.col(split))).drop("_number", "_h")


def reject(rows: DataFrame, key: str, errors: DataFrame) -> DataFrame:
    """rows without those that have an error."""
    return rows.join(errors.select(key).distinct(), key, "left_anti")


TABLE = r"(?i)\b(?:from|join)\s+([a-z_][a-z0-9_]*)"
COLUMN = r"(?i)\b([a-z_]+)\.([a-z_]+)\b"


def reference_errors(rows: DataFrame, key: str, query: str, catalog: DataFrame) -> DataFrame:
    """key, error for each table or table.column of a query that the catalog (table_name, column_name) lacks.

    Pairs whose first part is no table are aliases and pass. Whether the catalog is broadcast is left to adaptive execution.
    """
    tables = catalog.select("table_name").distinct()
    used = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(TABLE), F.lit(1)))).alias("table_name"))
    unknown = used.join(tables, "table_name", "left_anti").select(key, F.concat(F.lit("Unknown table '"), "table_name", F.lit("' in query")).alias("error"))
    text = F.lower(query)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(COLUMN), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(COLUMN), F.lit(2)).alias("c"))
    flat = rows.select(key, F.explode(F.array_distinct(pairs)).alias("_p")).select(key, F.col("_p.t").alias("table_name"), F.col("_p.c").alias("column_name"))
    real = flat.join(tables, "table_name", "left_semi")
    missing = real.join(catalog, ["table_name", "column_name"], "left_anti")
    return unknown.unionByName(missing.select(key, F.concat(F.lit("Unknown column '"), "table_name", F.lit("."), "column_name", F.lit("'")).alias("error")))


def validate(rows: DataFrame, required: dict[str, Sequence[str]]) -> DataFrame:
    """rows with valid, errors and warnings. required: further fields by source; every record needs id, question, query, intent, source."""
    checks = [F.when(F.col(f).isNull(), f"Missing required field: {f}") for f in ("id", "question", "query", "intent", "source")]
    for source, fields in required.items():
        checks += [F.when((F.col("source") == source) & F.col(f).isNull(), f"Missing required field: {f}") for f in fields]
    checks.append(F.when(~F.coalesce("intent", F.lit("")).isin(*W.INTENTS), F.concat(F.lit("Invalid intent: "), F.coalesce("intent", F.lit("")))))
    warnings = [F.when(F.coalesce("question", F.lit("")) == "", "Empty question"), F.when(F.length("query") > 500, "Very long query (>500 chars)")]
    out = rows.withColumn("errors", F.array_compact(F.array(*checks))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    return out.withColumn("valid", F.size("errors") == 0)


def validation_summary(checked: DataFrame, group: str, order: str = "id") -> DataFrame:
    """A row per group: total, valid, invalid, valid_percent, warnings, first_error (errors of the first failing record in order)."""
    bad = ~F.col("valid")
    return checked.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("valid"), 1)).alias("valid"),
        F.count(F.when(bad, 1)).alias("invalid"),
        F.round(F.count(F.when(F.col("valid"), 1)) * 100.0 / F.count(F.lit(1)), 4).alias("valid_percent"),
        F.sum(F.size("warnings")).alias("warnings"),
        F.min_by(F.array_join("errors", "; "), F.when(bad, F.col(order))).alias("first_error"),
    )


def top_errors(checked: DataFrame, n: int = 5) -> DataFrame:
    """error, n: the most frequent errors."""
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(n)


def stratified_folds(rows: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """rows with fold: rows of each label are dealt to k folds in turn, in the order of their keys' MD5."""
    numbered = number_in_groups(rows.withColumn("_h", F.md5(F.col(key).cast("string"))), [label], [F.asc("_h"), F.asc(key)], "_number")
    return numbered.withColumn("fold", (F.col("_number") % k).cast("int")).drop("_number", "_h")
