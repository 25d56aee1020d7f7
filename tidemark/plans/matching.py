"""Registered queries: fuzzy values, corrections, TF-IDF links, tokens to columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import matching as M
from .base import Tables, query
from .text import SPACE, quoted

#: What was typed for a part's name: its second letter is missing.
TYPED = "concat(substr(p_name, 1, 1), substr(p_name, 3))"
EDIT = "CAST(floor((greatest(length(a), length(b)) - levenshtein(a, b)) * 100 / greatest(length(a), length(b), 1)) AS INT)"
BOOST = f"greatest({EDIT}, CASE WHEN contains(a, b) OR contains(b, a) THEN 70 WHEN least(length(a), length(b)) >= 2 AND substr(a, 1, least(length(a), length(b), 3)) = substr(b, 1, least(length(a), length(b), 3)) THEN 60 ELSE 0 END)"


def typed(t: Tables) -> DataFrame:
    return t.part.select(F.expr(TYPED).alias("typed"))


@query()
def l1_did_you_mean(t: Tables) -> DataFrame:
    return M.did_you_mean(typed(t), t.part.select("p_name"))


def suggestions_sql(score: str) -> str:
    return f"""WITH t AS (SELECT DISTINCT {TYPED} AS typed FROM part), v AS (SELECT DISTINCT p_name AS value FROM part),
p AS (SELECT typed, value, lower(typed) AS a, lower(value) AS b FROM t, v WHERE lower(typed) NOT IN (SELECT lower(value) FROM v)),
s AS (SELECT typed, value, {score} AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY score DESC, value) AS rank FROM s WHERE score >= 50)
SELECT * FROM r WHERE rank <= 3"""


@query(suggestions_sql(BOOST.replace(EDIT, "CAST(floor(jaccard(a, b) * 100 + 1e-9) AS INT)")))
def l2_char_overlap(t: Tables) -> DataFrame:
    return M.did_you_mean(typed(t), t.part.select("p_name"), score=M.OVERLAP)


@query(suggestions_sql(BOOST))
def l3_did_you_mean_by_edits(t: Tables) -> DataFrame:
    return M.did_you_mean(typed(t), t.part.select("p_name"), score=M.EDITS)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def l4_apply_corrections(t: Tables) -> DataFrame:
    """Every third segment is spelt without its second letter, then corrected by the best match."""
    dirty = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.expr("concat(substr(c_mktsegment, 1, 1), substr(c_mktsegment, 3))")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    found = M.did_you_mean(dirty.select("c_mktsegment"), t.customer.select("c_mktsegment"), score=M.EDITS, top=1)
    return M.apply_corrections(dirty, "c_mktsegment", found)


LEXICON_TEXT = "concat('custumers by departmant and categry of ', coalesce(text, ''))"


@query(f"""WITH w AS (SELECT conv_id, turn, unnest(string_split(trim(regexp_replace({LEXICON_TEXT}, '{SPACE}', ' ', 'g')), ' ')) AS word, generate_subscripts(string_split(trim(regexp_replace({LEXICON_TEXT}, '{SPACE}', ' ', 'g')), ' '), 1) AS pos FROM conversations),
lex(b) AS (VALUES {', '.join(f'({quoted(x)})' for x in W.LEXICON)}), d AS (SELECT DISTINCT word, lower(word) AS a FROM w WHERE length(word) > 4),
s AS (SELECT word, b, {EDIT} AS score FROM d, lex), best AS (SELECT word, arg_min(b, (-score, b)) AS entry FROM s WHERE score >= 85 GROUP BY word)
SELECT conv_id || '/' || turn AS id, string_agg(coalesce(entry, word), ' ' ORDER BY pos) AS corrected FROM w LEFT JOIN best USING (word) GROUP BY conv_id, turn""")
def l5_lexicon_correct(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.concat("conv_id", F.lit("/"), "turn").alias("id"), F.expr(LEXICON_TEXT).alias("text"))
    return M.lexicon_correct(rows, "id", "text", W.LEXICON)


def terms_sql(rows: str, key: str, text: str, stop: bool = False) -> str:
    left_out = f" AND w NOT IN ({', '.join(map(quoted, W.STOP_WORDS))})" if stop else ""
    words = f"list_filter(string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w <> ''{left_out})"
    return f"SELECT {key}, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT {key}, {words} AS w FROM {rows})"


@query(f"""WITH dt AS (SELECT item_id, term, count(*) AS tf FROM ({terms_sql('benchmark', 'item_id', 'text')}) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1.0 AS idf FROM dt GROUP BY term),
dw AS (SELECT item_id, term, tf * idf AS w FROM dt JOIN idf USING (term)), dn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY item_id),
qt AS (SELECT doc_id, term, count(*) AS tf FROM ({terms_sql('documents', 'doc_id', 'text')}) GROUP BY ALL), qw AS (SELECT doc_id, term, tf * idf AS w FROM qt JOIN idf USING (term)),
qn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY doc_id),
s AS (SELECT doc_id, item_id, round(sum(qw.w / qn.n * dw.w / dn.n), 6) AS score FROM qw JOIN dw USING (term) JOIN qn USING (doc_id) JOIN dn USING (item_id) GROUP BY ALL)
SELECT doc_id, max(score) AS best FROM s GROUP BY doc_id""")
def l6_tfidf_link(t: Tables) -> DataFrame:
    """The cosine of each document with the item that is most like it."""
    linked = M.tfidf_link(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", top=1)
    return linked.select("doc_id", F.col("score").alias("best"))


SCHEMA = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate", "order item": "quantity|unit price|ship date|order key|customer name", "part type": "part name|brand|size|price",
}
SCHEMA_ROWS = [(t, c) for t, cs in SCHEMA.items() for c in (cs.split("|") if "|" in cs else cs.split())]
ASKED = "concat(CASE turn % 5 WHEN 0 THEN 'what is the unit price and quantity of each order item?' WHEN 1 THEN 'Customer name, c_acctbal and order key by nation' WHEN 2 THEN 'the brand, the size, the price of a part type in orders' WHEN 3 THEN 'o_totalprice by o_orderdate for the customer' ELSE '' END, ' ', coalesce(text, ''))"


def asked_sql(name: str, source: str) -> str:
    """Unit vectors of the terms of a column of names that the schema knows."""
    return f"""{name}t AS (SELECT name, term, count(*) * min(idf) AS w FROM ({terms_sql(source, 'name', 'name', stop=True)}) JOIN idf USING (term) GROUP BY ALL),
{name}w AS (SELECT name, term, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM {name}t)"""


@query(f"""WITH sc("table", col) AS (VALUES {', '.join(f"('{t}', '{c}')" for t, c in SCHEMA_ROWS)}), names AS (SELECT min(name) AS name FROM (SELECT "table" AS name FROM sc UNION ALL SELECT col FROM sc) GROUP BY lower(name)),
nt AS (SELECT DISTINCT name, term FROM ({terms_sql('names', 'name', 'name', stop=True)})), idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM names)) / (1.0 + count(*))) + 1.0 AS idf FROM nt GROUP BY term),
q AS (SELECT conv_id || '/' || turn AS name0, {ASKED} AS words FROM conversations), qq AS (SELECT name0 AS name, words FROM q),
qt AS (SELECT name, term, count(*) * min(idf) AS w FROM ({terms_sql('qq', 'name', 'words', stop=True)}) JOIN idf USING (term) GROUP BY ALL), qw AS (SELECT name, term, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM qt),
tn AS (SELECT DISTINCT "table" AS name FROM sc), cn AS (SELECT DISTINCT col AS name FROM sc), {asked_sql('t', 'tn')}, {asked_sql('c', 'cn')},
ts AS (SELECT qq.name AS id, tn.name AS "table", round(coalesce(sum(qw.w * tw.w), 0), 6) AS table_score FROM qq, tn LEFT JOIN tw ON tw.name = tn.name LEFT JOIN qw ON qw.name = qq.name AND qw.term = tw.term GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY table_score DESC, "table") AS table_rank FROM ts QUALIFY table_rank <= 3),
cs AS (SELECT id, tr."table", table_score, table_rank, sc.col AS "column", round(coalesce(sum(qw.w * cw.w), 0), 6) AS column_score FROM tr JOIN sc ON sc."table" = tr."table" LEFT JOIN cw ON cw.name = sc.col LEFT JOIN qw ON qw.name = tr.id AND qw.term = cw.term GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY id, "table" ORDER BY column_score DESC, "column") AS column_rank FROM cs QUALIFY column_rank <= 3)
SELECT id, "table", table_score, table_rank, round(avg(column_score) OVER (PARTITION BY id, "table"), 6) AS confidence, "column", column_score, column_rank FROM cr""")
def l6_link_schema(t: Tables) -> DataFrame:
    """Tables, and columns of each, for a question before each turn's text."""
    schema = t.spark.createDataFrame(SCHEMA_ROWS, "table string, column string")
    return M.link_schema(t.conversations.select(F.concat("conv_id", F.lit("/"), "turn").alias("id"), F.expr(ASKED).alias("words")), "id", "words", schema)


FIXTURE_COLUMNS = ["name", "brand", "type", "size", "retail_price", "order", "customers", "in", "es", "th", "the"]
TOKEN_WORDS = "SELECT DISTINCT unnest(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' ')) AS token FROM conversations"


@query(f"""WITH c(position, col) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(FIXTURE_COLUMNS))}), k AS (SELECT token, lower(trim(token)) AS t FROM ({TOKEN_WORDS} UNION SELECT 'Brands' UNION SELECT 'SIZE' UNION SELECT 'customer')),
p AS (SELECT token, position, col, CASE WHEN col = t THEN 1 WHEN regexp_replace(t, 's+$', '') = col OR (CASE WHEN t LIKE '%s' THEN t ELSE t || 's' END) = col OR t = regexp_replace(col, 's+$', '') THEN 2
 WHEN (contains(col, t) OR contains(t, col)) AND length(t) >= 2 AND length(col) >= 2 THEN 3 END AS kind FROM k, c), b AS (SELECT token, min((kind, position, col)) AS m FROM p WHERE kind IS NOT NULL GROUP BY token)
SELECT token, m[3] AS "column", CASE m[1] WHEN 1 THEN 'exact' WHEN 2 THEN 'number' ELSE 'substring' END AS kind FROM b""")
def l7_match_columns(t: Tables) -> DataFrame:
    words = t.conversations.select(F.explode(F.split(F.trim(F.regexp_replace("text", M.SPACE, " ")), " ")).alias("token"))
    more = t.spark.createDataFrame([("Brands",), ("SIZE",), ("customer",)], "token string")
    return M.match_columns(words.unionByName(more), "token", FIXTURE_COLUMNS)
