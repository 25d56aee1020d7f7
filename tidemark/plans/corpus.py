"""Registered queries: corpus statistics, synthesis, validation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..operators import corpus as C
from ..operators import noise as N
from ..operators.families import family_split
from .base import EDGES, Tables, query
from .text import CLEANED, QUERY, QUESTION, TOKENS, documents_tokens, intent_sql, quoted


def bucket_sql(*parts: str, of: int = 100) -> str:
    text = " || '|' || ".join(parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {of})"


DOC_SPLIT = f"CASE WHEN {bucket_sql('CAST(doc_id AS VARCHAR)')} < 70 THEN 'train' WHEN {bucket_sql('CAST(doc_id AS VARCHAR)')} < 85 THEN 'val' ELSE 'test' END"


@query(f"""WITH k AS (SELECT {TOKENS} AS tokens FROM documents)
SELECT count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS tokens, min(len(tokens)) AS least, max(len(tokens)) AS most, round(CAST(sum(len(tokens)) AS DOUBLE) / count(*), 4) AS mean, CAST(median(len(tokens)) AS DOUBLE) AS median,
(SELECT count(DISTINCT x) FROM (SELECT unnest(tokens) AS x FROM k)) AS unique_tokens FROM k""")
def k1_statistics(t: Tables) -> DataFrame:
    return C.statistics(documents_tokens(t), "tokens")


@query(f"SELECT split, lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 4) AS percent FROM (SELECT {DOC_SPLIT} AS split, lang FROM documents) GROUP BY split, lang")
def k2_label_distribution(t: Tables) -> DataFrame:
    return C.label_distribution(t.documents.select(C.split_of(F.col("doc_id")).alias("split"), "lang"), "split", "lang")


@query(f"""WITH e AS (SELECT doc_id, source, {DOC_SPLIT} AS split, {CLEANED} AS cleaned FROM documents)
SELECT doc_id, cleaned, coalesce(source, '') || '_' || split || '_' || lpad(CAST(row_number() OVER (PARTITION BY source, split ORDER BY doc_id) - 1 AS VARCHAR), 6, '0') AS id FROM e""")
def k3_enrich(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("split", C.split_of(F.col("doc_id")))
    return C.enrich(docs, "source", "split", "doc_id", {"cleaned": X.clean_question(F.col("text"))}).select("doc_id", "cleaned", "id")


#: Intent, question, query; {slots} are columns of the row.
TEMPLATES = [
    ("SELECT", "Show all parts", "SELECT * FROM part"),
    ("SELECT", "List the brands of parts", "SELECT p_brand FROM part"),
    ("SELECT_WHERE", "Show parts with size above {size}", "SELECT * FROM part WHERE p_size > {size}"),
    ("SELECT_WHERE", "Which parts have brand {brand}", "SELECT * FROM part WHERE p_brand = '{brand}'"),
    ("SELECT_WHERE", "Find parts named {name}", "SELECT * FROM part WHERE p_name = '{name}'"),
    ("SELECT_AGGREGATE", "How many parts are there", "SELECT COUNT(*) FROM part"),
    ("SELECT_AGGREGATE", "What is the average price of brand {brand}", "SELECT AVG(p_retailprice) FROM part"),
    ("SELECT_ORDER", "Show parts sorted by price", "SELECT * FROM part ORDER BY p_retailprice"),
    ("SELECT_GROUP", "Count parts per brand", "SELECT p_brand, COUNT(*) FROM part GROUP BY p_brand"),
    ("SELECT_LIMIT", "Show only {size} parts", "SELECT * FROM part LIMIT {size}"),
    ("COMPLEX", "Top {size} parts of brand {brand} by price", "SELECT * FROM part WHERE p_brand = '{brand}' ORDER BY p_retailprice DESC LIMIT {size}"),
]
WEIGHTS = {"SELECT": 10, "SELECT_WHERE": 20, "SELECT_AGGREGATE": 15, "SELECT_ORDER": 10, "SELECT_GROUP": 15, "SELECT_LIMIT": 5, "COMPLEX": 5}
SLOTS = {"size": "p_size", "brand": "p_brand", "name": "p_name"}


def drawn_sql(column: int, templates=TEMPLATES) -> str:
    out = []
    for i in WEIGHTS:
        found = [x for x in templates if x[0] == i]
        out += [f"WHEN intent = '{i}' AND {bucket_sql(quoted('a'), 'CAST(p_partkey AS VARCHAR)', quoted('template'), of=len(found))} = {n} THEN {quoted(x[column])}" for n, x in enumerate(found)]
    text = "CASE " + " ".join(out) + " END"
    for slot, c in SLOTS.items():
        text = f"replace({text}, '{{{slot}}}', CAST({c} AS VARCHAR))"
    return text


def chosen_sql() -> str:
    out, upto = [], 0
    for i, w in WEIGHTS.items():
        upto += w
        out.append(f"WHEN b < {upto} THEN '{i}'")
    return "CASE " + " ".join(out) + " END"


DRAWN_SQL = f"""drawn AS (SELECT *, {chosen_sql()} AS intent FROM (SELECT *, {bucket_sql(quoted('a'), 'CAST(p_partkey AS VARCHAR)', quoted('intent'), of=sum(WEIGHTS.values()))} AS b FROM part))"""


def synthesised(t: Tables) -> DataFrame:
    return C.synthesise(t.part, F.col("p_partkey"), TEMPLATES, WEIGHTS, {s: F.col(c) for s, c in SLOTS.items()}, "a")


@query(f"WITH {DRAWN_SQL} SELECT p_partkey AS key, intent, {drawn_sql(1)} AS question, {drawn_sql(2)} AS query FROM drawn")
def k4_template_synthesis(t: Tables) -> DataFrame:
    return synthesised(t)


#: With a template whose query names no table of the catalog.
FAULTY = [*TEMPLATES, ("SELECT_LIMIT", "Show {size} of them", "SELECT * FROM parts LIMIT {size}")]
SIZES = {"train": 500, "val": 100, "test": 50}
KEY_SPLIT = DOC_SPLIT.replace("doc_id", "p_partkey")


@query(f"""WITH {DRAWN_SQL}, s AS (SELECT p_partkey AS key, {drawn_sql(1, FAULTY)} AS question, {drawn_sql(2, FAULTY)} AS query, {KEY_SPLIT} AS split FROM drawn),
n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(CAST(key AS VARCHAR)), key) AS r FROM s WHERE query NOT LIKE '%FROM parts%')
SELECT key, question, query, split FROM n WHERE r <= CASE split WHEN 'train' THEN 500 WHEN 'val' THEN 100 ELSE 50 END""")
def k4_exact_sizes(t: Tables) -> DataFrame:
    """Synthesis, rejection of queries that refer to nothing, and exact sizes per split."""
    made = C.synthesise(t.part, F.col("p_partkey"), FAULTY, WEIGHTS, {s: F.col(c) for s, c in SLOTS.items()}, "a")
    catalog = t.spark.createDataFrame(CATALOG, "table_name string, column_name string")
    valid = C.reject(made, "key", C.reference_errors(made, "key", "query", catalog))
    return C.exact_sizes(valid.withColumn("split", C.split_of(F.col("key"))), "split", "key", SIZES).select("key", "question", "query", "split")


PAIRS = EDGES[3:]
EDGE_QUERY = "concat('SELECT {a}.{k} FROM {a} JOIN {b} ON {a}.{k} = {b}.{q}', {tail})"
TAIL = "CASE {draw} WHEN 0 THEN '' WHEN 1 THEN concat(' WHERE {a}.{k} > ', CAST(o_orderkey AS STRING)) WHEN 2 THEN ' GROUP BY {a}.{k} HAVING COUNT(*) > 1' ELSE ' LIMIT 10' END"


def edge_query(draw: str, tail: str) -> str:
    """The query of a drawn edge, as an expression over orders."""
    cases = []
    for i, (a, k, b, q) in enumerate(PAIRS):
        names = {"a": a, "k": k, "b": b, "q": q}
        cases.append(f"WHEN {i} THEN " + EDGE_QUERY.format(**names, tail=TAIL.format(**names, draw=tail)))
    return f"CASE {draw} " + " ".join(cases) + " END"


@query(f"SELECT o_orderkey, q AS query, {intent_sql('b')} AS intent FROM (SELECT o_orderkey, {edge_query(bucket_sql(quoted('b'), 'CAST(o_orderkey AS VARCHAR)', quoted('edge'), of=len(PAIRS)), bucket_sql(quoted('b'), 'CAST(o_orderkey AS VARCHAR)', quoted('tail'), of=4))} AS q FROM orders)")
def k5_join_pair_synthesis(t: Tables) -> DataFrame:
    draws = t.orders.select("o_orderkey", C.bucket(F.lit("b"), F.col("o_orderkey"), F.lit("edge"), of=len(PAIRS)).alias("edge"), C.bucket(F.lit("b"), F.col("o_orderkey"), F.lit("tail"), of=4).alias("tail"))
    q = draws.select("o_orderkey", F.expr(edge_query("edge", "tail")).alias("query"))
    return q.withColumn("intent", X.sql_intent(F.col("query"), "b"))


@query()
def k6_noise(t: Tables) -> DataFrame:
    """Noisy variants of the questions over parts and of the users' turns."""
    asked = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.expr(QUESTION).alias("question"))
    said = t.conversations.where("role = 'user'").select(F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("id"), F.col("text").alias("question"))
    return N.augment(asked.unionByName(said), "id", "question", seed=7)


CATALOG = [("part", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")] + [("lineitem", c) for c in ("l_orderkey", "l_partkey", "l_suppkey")]


def faults(t: Tables) -> DataFrame:
    catalog = t.spark.createDataFrame(CATALOG, "table_name string, column_name string")
    return C.reference_errors(t.part.select("p_partkey", F.expr(QUERY).alias("q")), "p_partkey", "q", catalog)


FAULTS_SQL = f"""catalog(t, c) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CATALOG)}),
q AS (SELECT p_partkey, lower({QUERY}) AS q FROM part),
used AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(q, '\\b(?:from|join)\\s+([a-z_][a-z0-9_]*)', 1)) AS t FROM q),
pairs AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(q, '\\b([a-z_]+)\\.([a-z_]+)\\b', 1)) AS t, unnest(regexp_extract_all(q, '\\b([a-z_]+)\\.([a-z_]+)\\b', 2)) AS c FROM q),
faults AS (SELECT p_partkey, 'Unknown table ''' || t || ''' in query' AS error FROM used WHERE t NOT IN (SELECT t FROM catalog)
UNION ALL SELECT p_partkey, 'Unknown column ''' || t || '.' || c || '''' FROM pairs WHERE t IN (SELECT t FROM catalog) AND (t, c) NOT IN (SELECT t, c FROM catalog))"""


@query(f"WITH {FAULTS_SQL} SELECT * FROM faults")
def k7_reference_errors(t: Tables) -> DataFrame:
    return faults(t)


def records(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), F.when(F.col("toxic") == 1, None).otherwise(F.col("text")).alias("query"),
        F.when(F.col("quality") == 0, F.lit("BROKEN")).otherwise("SELECT").alias("intent"), F.when(F.col("doc_id") % 2 == 0, "wiki").otherwise("spider").alias("source"),
        F.when(F.col("lang") == "de", None).otherwise(F.col("lang")).alias("table_id"), F.col("source").alias("db_id"),
    )


CHECKED_SQL = """r AS (SELECT doc_id AS id, text AS question, CASE WHEN toxic = 1 THEN NULL ELSE text END AS query, CASE WHEN quality = 0 THEN 'BROKEN' ELSE 'SELECT' END AS intent,
 CASE WHEN doc_id % 2 = 0 THEN 'wiki' ELSE 'spider' END AS source, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS table_id FROM documents LEFT JOIN labels USING (doc_id)),
checked AS (SELECT id, source, list_filter([CASE WHEN question IS NULL THEN 'Missing required field: question' END, CASE WHEN query IS NULL THEN 'Missing required field: query' END,
 CASE WHEN source = 'wiki' AND table_id IS NULL THEN 'Missing required field: table_id' END, CASE WHEN intent <> 'SELECT' THEN 'Invalid intent: ' || intent END], lambda x: x IS NOT NULL) AS errors,
 list_filter([CASE WHEN coalesce(question, '') = '' THEN 'Empty question' END, CASE WHEN length(query) > 500 THEN 'Very long query (>500 chars)' END], lambda x: x IS NOT NULL) AS warnings FROM r)"""
REQUIRED = {"wiki": ("table_id",), "spider": ("db_id",)}


@query(f"WITH {CHECKED_SQL} SELECT id, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM checked")
def k8_validate(t: Tables) -> DataFrame:
    return C.validate(records(t), REQUIRED).select("id", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"""WITH {CHECKED_SQL} SELECT source, count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid, round(count(*) FILTER (len(errors) = 0) * 100.0 / count(*), 4) AS valid_percent,
CAST(sum(len(warnings)) AS BIGINT) AS warnings, min_by(array_to_string(errors, '; '), id) FILTER (len(errors) > 0) AS first_error, (SELECT string_agg(error || '=' || n, '; ' ORDER BY n DESC, error) FROM (SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM checked) GROUP BY error ORDER BY n DESC, error LIMIT 5)) AS top_errors FROM checked GROUP BY source""")
def k9_validation_summary(t: Tables) -> DataFrame:
    checked = C.validate(records(t), REQUIRED)
    top = C.top_errors(checked).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "error"))).alias("e"))  # five at most
    text = F.array_join(F.transform("e", lambda x: F.concat(x["error"], F.lit("="), (-x["m"]).cast("string"))), "; ")
    return C.validation_summary(checked, "source").crossJoin(F.broadcast(top.select(text.alias("top_errors"))))


@query(f"SELECT doc_id, {DOC_SPLIT} AS split FROM documents")
def k10_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.split_of(F.col("doc_id")).alias("split"))


@query("SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INT) AS fold FROM labels")
def k11_stratified_folds(t: Tables) -> DataFrame:
    return C.stratified_folds(t.labels.select("doc_id", "quality"), "quality", "doc_id")


BY_TEXT = bucket_sql(f"md5({CLEANED})")


@query(f"""WITH d AS (SELECT doc_id, md5({CLEANED}) AS parent, {DOC_SPLIT} AS by_row, CASE WHEN {BY_TEXT} < 70 THEN 'train' WHEN {BY_TEXT} < 85 THEN 'val' ELSE 'test' END AS by_parent FROM documents WHERE text IS NOT NULL),
s AS (SELECT parent, count(DISTINCT by_row) > 1 AS leaks_by_row, count(DISTINCT by_parent) > 1 AS leaks_by_parent FROM d GROUP BY parent)
SELECT count(*) AS parents, count(*) FILTER (leaks_by_row) AS leaks_by_row, count(*) FILTER (leaks_by_parent) AS leaks_by_parent FROM s""")
def k12_leakage_safe_split(t: Tables) -> DataFrame:
    """Texts whose rows fall into several splits, when rows are split by their id and by their cleaned text."""
    parent = F.md5(X.clean_question(F.col("text")))
    d = t.documents.where("text is not null").select(parent.alias("parent"), C.split_of(F.col("doc_id")).alias("by_row")).withColumn("by_parent", C.split_of(F.col("parent")))
    s = d.groupBy("parent").agg((F.min("by_row") != F.max("by_row")).alias("r"), (F.min("by_parent") != F.max("by_parent")).alias("p"))
    return s.agg(F.count(F.lit(1)).alias("parents"), F.count(F.when(F.col("r"), 1)).alias("leaks_by_row"), F.count(F.when(F.col("p"), 1)).alias("leaks_by_parent"))


FAMILY_SPLIT = bucket_sql("CAST(family AS VARCHAR)")


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, md5({CLEANED}) AS k1, md5(substr({CLEANED}, 1, 30)) AS k2 FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM d a JOIN d b USING (k1) UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b USING (k2)),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x), f AS (SELECT x AS doc_id, min(root) AS family FROM r GROUP BY x)
SELECT doc_id, family, CASE WHEN {FAMILY_SPLIT} < 70 THEN 'train' WHEN {FAMILY_SPLIT} < 85 THEN 'val' ELSE 'test' END AS split FROM f""")
def k12_family_split(t: Tables) -> DataFrame:
    """A split for every text, the same for all that share their cleaned text or its beginning, directly or through others."""
    clean = X.clean_question(F.col("text"))
    rows = t.documents.where("text IS NOT NULL").select("doc_id", F.md5(clean).alias("whole"), F.md5(F.substring(clean, 1, 30)).alias("beginning"))
    return family_split(rows, "doc_id", ["whole", "beginning"]).select("doc_id", "family", "split")
