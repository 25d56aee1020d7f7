"""Registered queries: projections, filters, joins, subqueries, aggregates, sorting, windows, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.matching import contained_in
from ..sources.files import SourceTable
from ..sources.shared import scratch
from ..operators.ranges import place
from .base import EDGES, Tables, amount, mean_sql, query, total_sql

YEAR = "year(o_orderdate)"


# --- C: projections, filters, predicates


@query("SELECT n_name, n_regionkey FROM nation")
def c1_named_columns(t: Tables) -> DataFrame:
    return t.nation.select("n_name", "n_regionkey")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal >= 1000 AND s_nationkey <> 3")
def c2_comparison_filter(t: Tables) -> DataFrame:
    return t.supplier.where((F.col("s_acctbal") >= 1000) & (F.col("s_nationkey") != 3)).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_size > 10 AND p_retailprice < 1500 AND p_brand <> 'Brand#11'")
def c3_conjunction(t: Tables) -> DataFrame:
    return t.part.where((F.col("p_size") > 10) & (F.col("p_retailprice") < 1500) & (F.col("p_brand") != "Brand#11")).select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority LIKE '1%'")
def c4_disjunction(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderstatus") == "P") | F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'a%' OR p_name ILIKE '%RE%'")
def c5_like_without_case(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("a%") | F.col("p_name").ilike("%RE%")).select("p_partkey", "p_name")


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31') OR o_orderdate > TIMESTAMP '2001-01-01' OR {YEAR} = 1998")
def c6_date_ranges(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    between = d.between(F.to_timestamp(F.lit("1996-01-01")), F.to_timestamp(F.lit("1996-12-31")))
    year = (d >= F.to_timestamp(F.lit("1998-01-01"))) & (d < F.to_timestamp(F.lit("1999-01-01")))
    return t.orders.where(between | (d > F.to_timestamp(F.lit("2001-01-01"))) | year).select("o_orderkey", "o_orderdate")


@query("SELECT * FROM supplier WHERE s_acctbal > 500 AND s_acctbal < 9000 AND s_nationkey = 7")
def c7_filter_by_specs(t: Tables) -> DataFrame:
    specs = [
        {"column": "s_acctbal", "operator": ">", "value": 500},
        {"column": "s_acctbal", "operator": "=", "value": 4},
        {"column": "s_acctbal", "op": "<", "value": 9000},
        {"column": "s_nationkey", "value": 7},
        {"column": "s_nationkey", "operator": "=", "value": 8},
        {"column": None, "value": 1},
        {"column": "s_name", "value": None},
    ]
    return R.filter_by_specs(t.supplier, specs)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def c8_distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct()


@query("SELECT l_orderkey, l_linenumber, c_custkey, s_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey")
def c9_columns_equal_after_join(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.where(F.col("c_nationkey") == F.col("s_nationkey")).select("l_orderkey", "l_linenumber", "c_custkey", "s_suppkey")


@query("SELECT doc_id, quality FROM labels WHERE toxic = 1")
def c10_flag_filter(t: Tables) -> DataFrame:
    return t.labels.where(F.col("toxic") == 1).select("doc_id", "quality")


@query("SELECT o_orderkey, o_custkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) q ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def c11_is_null_after_left_join(t: Tables) -> DataFrame:
    large = t.lineitem.where("l_quantity > 45").select("l_orderkey").distinct()
    return t.orders.join(large, F.col("l_orderkey") == F.col("o_orderkey"), "left").where(F.col("l_orderkey").isNull()).select("o_orderkey", "o_custkey")


# --- D: joins and subqueries


@query("SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def d1_inner_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("SELECT c_name, o_orderkey, p_name, l_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey")
def d2_join_chain(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("c_name", "o_orderkey", "p_name", "l_quantity")


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_nationkey, n_name")
def d3_left_join_count(t: Tables) -> DataFrame:
    rich = t.supplier.where("s_acctbal > 5000")
    return t.nation.join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def d4_anti_join(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def d5_not_in(t: Tables) -> DataFrame:
    return R.not_in(t.nation, "n_nationkey", t.supplier.where("s_acctbal > 8000").select("s_nationkey")).select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-01-01')")
def d6_exists(t: Tables) -> DataFrame:
    late = t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.to_timestamp(F.lit("2000-01-01"))))
    return t.customer.join(late, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING {mean_sql('p_retailprice')} > (SELECT {mean_sql('p_retailprice')} FROM part))")
def d7_in_grouped_subquery(t: Tables) -> DataFrame:
    brands = t.part.groupBy("p_brand").agg(R.mean("p_retailprice").alias("m"))
    high = brands.join(F.broadcast(t.part.agg(R.mean("p_retailprice").alias("all"))), F.col("m") > F.col("all"))  # one row
    return t.part.join(high, "p_brand", "left_semi").select("p_partkey", "p_brand")


@query(f"SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT {mean_sql('p_retailprice')} FROM part WHERE p_size < 25)")
def d8_scalar_subquery(t: Tables) -> DataFrame:
    mean = t.part.where("p_size < 25").agg(R.mean("p_retailprice").alias("mean"))  # one row
    return t.part.join(F.broadcast(mean), F.col("p_retailprice") > F.col("mean")).select("p_partkey", "p_retailprice")


@query(f"SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier s WHERE s_acctbal > (SELECT CAST(sum({amount('x.s_acctbal')}) AS DOUBLE) / count(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)")
def d9_above_own_group_mean(t: Tables) -> DataFrame:
    return R.above_group_mean(t.supplier, "s_nationkey", "s_acctbal").select("s_suppkey", "s_nationkey", "s_acctbal")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS order_count FROM customer")
def d10_count_per_row(t: Tables) -> DataFrame:
    counts = t.orders.where("o_totalprice > 200000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("order_count"))


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23'")
def d11_who_bought(t: Tables) -> DataFrame:
    part = t.part.where("p_brand = 'Brand#23'")
    buyers = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey").distinct()
    return t.customer.join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, count(o_orderkey) AS total_orders, coalesce({total_sql('o_totalprice')}, 0) AS total_spent FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey GROUP BY c_custkey")
def d12_rollup_onto_parent(t: Tables) -> DataFrame:
    return R.rollup_onto_parent(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'P'"), "c_custkey", "o_custkey", "o_totalprice", "total_orders", "total_spent")


@query("SELECT o_orderkey, c_name, 'ab' AS way FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, c_name, 'ba' FROM orders JOIN customer ON o_custkey = c_custkey")
def d13_join_along_edge(t: Tables) -> DataFrame:
    names = {"orders": t.orders, "customer": t.customer}
    one = R.join_related(names, EDGES, "orders", "customer").select("o_orderkey", "c_name", F.lit("ab").alias("way"))
    return one.unionByName(R.join_related(names, EDGES, "customer", "orders").select("o_orderkey", "c_name", F.lit("ba").alias("way")))


@query(f"SELECT n_name, {total_sql('l_extendedprice')} AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY n_name")
def d14_dimension_filter(t: Tables) -> DataFrame:
    where = t.nation.where("n_regionkey = 1")
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(R.total("l_extendedprice").alias("revenue"), F.count(F.lit(1)).alias("n"))


# --- E: aggregations


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f FROM orders")
def e1_count(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_f"))


@query(f"SELECT {total_sql('s_acctbal')} AS total, {mean_sql('s_acctbal')} AS average, min(s_acctbal) AS least, max(s_acctbal) AS most FROM supplier WHERE s_nationkey > 4")
def e2_aggregates(t: Tables) -> DataFrame:
    return t.supplier.where("s_nationkey > 4").agg(R.total("s_acctbal").alias("total"), R.mean("s_acctbal").alias("average"), F.min("s_acctbal").alias("least"), F.max("s_acctbal").alias("most"))


@query("SELECT p_brand, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def e3_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("orders"))


@query(f"SELECT l_returnflag, CAST(sum({amount('l_extendedprice')} * (1 - {amount('l_discount')})) AS DOUBLE) AS revenue FROM lineitem GROUP BY l_returnflag")
def e4_aggregate_of_expression(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(R.money("l_extendedprice") * (1 - R.money("l_discount"))).cast("double").alias("revenue"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def e5_group_by_one(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderstatus, {YEAR} AS year, month(o_orderdate) AS month, {total_sql('o_totalprice')} AS total FROM orders GROUP BY ALL")
def e6_group_by_several(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(R.total("o_totalprice").alias("total"))


@query(f"SELECT p_brand, count(*) AS n, {mean_sql('p_retailprice')} AS average, min(p_retailprice) AS least, max(p_retailprice) AS most, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand")
def e7_several_aggregates(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), R.mean("p_retailprice").alias("average"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"), F.sum("p_size").alias("sizes"))


@query(f"SELECT o_custkey, count(*) AS n, {total_sql('o_totalprice')} AS total, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_custkey HAVING count(*) > 5 AND {mean_sql('o_totalprice')} > 1000 AND count(DISTINCT o_orderpriority) > 2")
def e8_having(t: Tables) -> DataFrame:
    groups = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), R.total("o_totalprice").alias("total"), R.mean("o_totalprice").alias("m"), F.countDistinct("o_orderpriority").alias("priorities"))
    return groups.where("n > 5 AND m > 1000 AND priorities > 2").drop("m")


@query(f"SELECT c_mktsegment, {mean_sql('c_acctbal')} AS average FROM customer GROUP BY c_mktsegment HAVING {mean_sql('c_acctbal')} > (SELECT {mean_sql('c_acctbal')} FROM customer)")
def e9_having_above_overall(t: Tables) -> DataFrame:
    overall = t.customer.agg(R.mean("c_acctbal").alias("overall"))  # one row
    groups = t.customer.groupBy("c_mktsegment").agg(R.mean("c_acctbal").alias("average"))
    return groups.join(F.broadcast(overall), F.col("average") > F.col("overall")).drop("overall")


@query(f"SELECT {YEAR} AS year, month(o_orderdate) AS month, count(*) AS n, {total_sql('o_totalprice')} AS total FROM orders GROUP BY ALL")
def e10_monthly_trend(t: Tables) -> DataFrame:
    return R.trend(t.orders, "o_orderdate", "o_totalprice")


@query(f"""WITH s AS (SELECT s_nationkey AS k, {total_sql('s_acctbal')} AS paid FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey AS k, {total_sql('c_acctbal')} AS budget FROM customer GROUP BY 1)
SELECT n_name, round(paid / nullif(budget, 0) * 100, 4) AS percent FROM nation LEFT JOIN s ON s.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey""")
def e11_ratio_of_aggregates(t: Tables) -> DataFrame:
    s = t.supplier.groupBy("s_nationkey").agg(R.total("s_acctbal").alias("paid"))
    c = t.customer.groupBy("c_nationkey").agg(R.total("c_acctbal").alias("budget"))
    joined = t.nation.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("n_name", F.round(F.try_divide("paid", "budget") * 100, 4).alias("percent"))


@query(f"""SELECT p_brand, CAST(sum({amount('l_extendedprice')} * (1 - {amount('l_discount')})) AS DOUBLE) AS revenue, count(DISTINCT o_custkey) AS customers
FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY p_brand ORDER BY revenue DESC, p_brand LIMIT 5""")
def e12_top_brands_by_revenue(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.sum(R.money("l_extendedprice") * (1 - R.money("l_discount"))).cast("double")
    return joined.groupBy("p_brand").agg(revenue.alias("revenue"), F.countDistinct("o_custkey").alias("customers")).orderBy(F.desc("revenue"), "p_brand").limit(5)


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def e13_representative_per_group(t: Tables) -> DataFrame:
    return R.representative(t.part.select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey")


@query("SELECT round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / nullif(count(*), 0), 4) AS percent FROM orders")
def e14_share(t: Tables) -> DataFrame:
    return t.orders.agg(R.share(F.col("o_orderstatus") == "F").alias("percent"))


# --- F: sort, limit, top-k


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def f1_order_by_one(t: Tables) -> DataFrame:
    """Sorted, with each row's place: counted inside range partitions, plus the rows of the partitions before."""
    return place(t.supplier.select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")])


@query("SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS place FROM orders")
def f2_order_by_several(t: Tables) -> DataFrame:
    return place(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")])




@query("SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 100)")
def f3_limit(t: Tables) -> DataFrame:
    return t.lineitem.limit(100).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (SELECT 'top' AS side, p_partkey, p_retailprice FROM part WHERE p_size > 5 ORDER BY p_retailprice DESC, p_partkey LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'bottom', p_partkey, p_retailprice FROM part WHERE p_size > 5 ORDER BY p_retailprice, p_partkey LIMIT 10)""")
def f4_top_and_bottom(t: Tables) -> DataFrame:
    p = t.part.where("p_size > 5").select("p_partkey", "p_retailprice")
    top = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.lit("top").alias("side"), "*")
    return top.unionByName(p.orderBy("p_retailprice", "p_partkey").limit(10).select(F.lit("bottom").alias("side"), "*"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def f5_last_by_key(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey").orderBy(F.desc("o_orderkey")).limit(10)


@query("SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand ORDER BY sum(CAST(l_quantity AS DECIMAL(18,2))) DESC, p_brand LIMIT 1")
def f6_first_group_by_hidden_aggregate(t: Tables) -> DataFrame:
    sold = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum(R.money("l_quantity")).alias("q"))
    return sold.orderBy(F.desc("q"), "p_brand").limit(1).drop("q")


# --- G: windows


@query("SELECT p_brand, p_partkey, p_retailprice, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def g1_cheapest_per_group(t: Tables) -> DataFrame:
    return R.first_per_group(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.asc("p_retailprice"), F.asc("p_partkey")])


@query("SELECT s_nationkey, s_suppkey, s_acctbal, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r = 1")
def g2_highest_per_group(t: Tables) -> DataFrame:
    return R.first_per_group(t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")])


@query(f"""WITH m AS (SELECT {YEAR} AS year, month(o_orderdate) AS month, count(*) AS n, {total_sql('o_totalprice')} AS total FROM orders GROUP BY ALL),
l AS (SELECT *, lag(total) OVER (ORDER BY year, month) AS previous FROM m)
SELECT *, round((total - previous) / nullif(previous, 0) * 100, 4) AS growth FROM l""")
def g3_month_over_month(t: Tables) -> DataFrame:
    return R.growth(R.trend(t.orders, "o_orderdate", "o_totalprice"))


# --- H: set operations


@query("SELECT doc_id, NULL AS item_id, text, source FROM documents UNION ALL SELECT NULL, item_id, text, NULL FROM benchmark")
def h1_bag_union(t: Tables) -> DataFrame:
    return R.bag_union(t.documents.select("doc_id", "text", "source"), t.benchmark.select("item_id", "text"))


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src1' UNION ALL SELECT doc_id + 1000000, 'src1' FROM documents WHERE source = 'src2'")
def h2_merge_source(t: Tables) -> DataFrame:
    base = t.documents.select("doc_id", "source")
    incoming = base.where("source = 'src2'").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("src1").alias("source"))
    once = R.merge_source(base, incoming, "source", "src1")
    return R.merge_source(once, incoming, "source", "src1")


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src1' UNION ALL SELECT doc_id + 1000000, 'src1' FROM documents WHERE source = 'src2'")
def h2_merge_by_partition(t: Tables) -> DataFrame:
    """The same in a stored table, of which a merge writes its own source's partition only."""
    table = SourceTable(t.spark, scratch(t.spark, "sources"))
    base = t.documents.select("doc_id", "source")
    table.load(base)
    incoming = base.where("source = 'src2'").select((F.col("doc_id") + 1000000).alias("doc_id"))
    for _ in range(2):
        table.merge(incoming, "src1")
    return table.read()


@query("""SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE lower(trim(d.text)) = lower(trim(b.text))) AS in_corpus,
EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS contained FROM benchmark b""")
def h3_overlap(t: Tables) -> DataFrame:
    """Whole-text matches by hash join; containment by runs of eight words that the item shares with a document, then checked."""
    whole = R.overlap(t.benchmark, "text", t.documents, "text").select("item_id", "in_corpus")
    inside = contained_in(t.benchmark, "item_id", "text", t.documents, "text")
    return whole.join(inside, "item_id")
