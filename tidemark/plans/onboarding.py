"""Registered queries: CSV and corpus sources, splits, previews, profiles, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import profiling as P
from ..sources import files as S
from ..sources.shared import scratch
from .base import EDGES, TABLES, Tables, query


def folder(t: Tables, label: str) -> str:
    return scratch(t.spark, label)


@query("SELECT c_custkey AS c_custkey, c_name AS c_name, c_mktsegment AS market_segment, c_acctbal AS c_acctbal_2 FROM customer")
def a1_ingest_csv(t: Tables) -> DataFrame:
    path = folder(t, "csv")
    t.customer.select("c_custkey", "c_name", F.col("c_mktsegment").alias("Market  Segment!"), F.col("c_acctbal").alias("C_AcctBal")).write.option("header", True).csv(path)
    df = S.ingest_csv(t.spark, path)
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "market_segment", F.col("c_acctbal").cast("double").alias("c_acctbal_2"))


@query("SELECT doc_id, md5(text) AS text_md5, length(text) AS chars FROM (SELECT doc_id, nullif(text, '') AS text FROM documents)")
def a1_ingest_quoted_breaks(t: Tables) -> DataFrame:
    """Texts with line breaks and quotes, written as CSV and read back from files that are split anywhere."""
    path = folder(t, "csv-texts")
    plain = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t.documents.select(F.col("doc_id").alias("Doc ID"), "text").write.options(**plain).csv(path)
    df = S.ingest_csv(t.spark, path)
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


@query("SELECT 'region' AS table_name, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def a2_ingest_csv_dir(t: Tables) -> DataFrame:
    root = folder(t, "csv-dir")
    for name in ("region", "nation"):
        t[name].write.option("header", True).csv(f"{root}/{name}.csv")
    loaded = S.ingest_csv_dir(t.spark, [f"{root}/region.csv", f"{root}/nation.csv", f"{root}/missing.csv"])
    one = loaded["region"].select(F.lit("region").alias("table_name"), F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("name"))
    return one.unionByName(loaded["nation"].select(F.lit("nation").alias("table_name"), F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name")))


CORPUS = StructType([StructField("id", LongType()), StructField("question", StringType()), StructField("source", StringType())])


@query("SELECT doc_id AS id, text AS question, source FROM documents")
def a3_read_corpus(t: Tables) -> DataFrame:
    path = folder(t, "corpus")
    t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("question"), "source").write.json(path)
    lines = S.read_corpus(t.spark, path, CORPUS, lines=True)
    missing = S.read_corpus(t.spark, f"{path}-none", CORPUS)
    return lines.unionByName(missing)


@query("SELECT lang AS split, count(*) AS n FROM documents GROUP BY lang")
def a4_write_splits(t: Tables) -> DataFrame:
    path = folder(t, "splits")
    S.write_splits(t.documents.withColumn("split", F.col("lang")), path)
    return t.spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(count(*), 1000) AS n, count(*) > 1000 AS truncated FROM lineitem")
def a5_preview(t: Tables) -> DataFrame:
    df, more = S.preview(t.lineitem, 1000)
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(more).alias("truncated"))


def types_sql(columns: list[str], table: str) -> str:
    rows = []
    for c in columns:
        dated = any(w in c for w in P.DATE_WORDS)
        kind = "'date'" if dated else f"CASE WHEN count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) > 0.8 * count({c}) THEN 'numeric' ELSE 'text' END"
        rows.append(f"SELECT '{c}' AS \"column\", {kind} AS kind FROM {table}")
    return " UNION ALL ".join(rows)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(types_sql(ORDER_COLUMNS, "orders").replace("SELECT 'o_orderdate' AS \"column\", 'date' AS kind FROM orders", "SELECT 'o_orderdate', 'date'"))
def b1_column_types(t: Tables) -> DataFrame:
    return P.column_types(t.orders)


PART_TEXT = ["p_name", "p_brand", "p_type"]


@query("SELECT \"column\", rank, value FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY value) AS rank FROM (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM part" for c in [*PART_TEXT, "p_partkey", "p_size"]) + ") WHERE value IS NOT NULL)) WHERE rank <= 3")
def b2_sample_values(t: Tables) -> DataFrame:
    return P.sample_values(t.part.select(*PART_TEXT, "p_partkey", "p_size"))


@query(" UNION ALL ".join(f"SELECT '{x}' AS \"table\", count(*) AS n FROM {x}" for x in TABLES))
def b3_row_counts(t: Tables) -> DataFrame:
    return P.row_counts({x: t[x] for x in TABLES})


@query("SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL")
def b4_distinct_values(t: Tables) -> DataFrame:
    return P.distinct_values(t.part, "p_brand", 100)


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) AS total, round(CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) / nullif(count({c}), 0), 4) AS average, CAST(max({c}) AS DOUBLE) AS most, CAST(min({c}) AS DOUBLE) AS least FROM lineitem" for c in LINE_NUMBERS))
def b5_numeric_summary(t: Tables) -> DataFrame:
    return P.numeric_summary(t.lineitem)


@query("SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_name', c_name, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def b6_value_counts(t: Tables) -> DataFrame:
    return P.value_counts(t.customer).unionByName(P.value_counts(t.orders))


@query("""SELECT 'not_null:p_name' AS rule, count(*) FILTER (p_name IS NULL) AS violations FROM part
UNION ALL SELECT 'check:price', count(*) FILTER (NOT p_retailprice > 1000) FROM part
UNION ALL SELECT 'check:size', count(*) FILTER (NOT (p_size BETWEEN 1 AND 40)) FROM part
UNION ALL SELECT 'unique:p_partkey', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM part WHERE p_partkey IS NOT NULL GROUP BY p_partkey)
UNION ALL SELECT 'unique:p_name', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name)
UNION ALL SELECT 'check:quantity', count(*) FILTER (NOT l_quantity > 0) FROM lineitem
UNION ALL SELECT 'check:discount', count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.05)) FROM lineitem""")
def b7_constraint_report(t: Tables) -> DataFrame:
    part = P.constraint_report(t.part, ["p_name"], ["p_partkey", "p_name"], {"price": F.col("p_retailprice") > 1000, "size": F.col("p_size").between(1, 40)})
    return part.unionByName(P.constraint_report(t.lineitem, checks={"quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount").between(0, 0.05)}))


NARROW = "(SELECT * FROM orders WHERE o_orderstatus <> 'P')"


@query(" UNION ALL ".join(f"SELECT '{c}.{k}->{p}.{q}' AS edge, count(*) AS orphans FROM {c} a WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p if p != 'orders' else NARROW} b WHERE b.{q} = a.{k})" for c, k, p, q in EDGES))
def b8_fk_orphans(t: Tables) -> DataFrame:
    """Orphans per edge; orders of status P are left out as parents, so that some edge has orphans."""
    tables = {x: t[x] for x in ("region", "nation", "customer", "supplier", "orders", "lineitem", "part")} | {"orders": t.orders}
    found = P.fk_orphans(tables, [e for e in EDGES if e[2] != "orders"])
    return found.unionByName(P.fk_orphans(tables | {"orders": t.orders.where("o_orderstatus <> 'P'")}, [e for e in EDGES if e[2] == "orders"]))
