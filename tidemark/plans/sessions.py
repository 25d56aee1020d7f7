"""Registered queries: sessions and query logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..operators import sessions as S
from .base import Tables, query
from .text import any_sql, quoted


@query("SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5")
def g4_last_turns(t: Tables) -> DataFrame:
    return S.last_turns(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", 5)


SAID = "CASE WHEN role = 'user' THEN text END"


@query(f"SELECT conv_id, turn, last_value({SAID} IGNORE NULLS) OVER w AS topic_said, role AS topic_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def g5_carry_forward(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", F.expr(SAID).alias("said"))
    return S.carry_forward(turns, "conv_id", "turn", ["said"], ["role"]).select("conv_id", "turn", "topic_said", "topic_role")


@query("SELECT conv_id, turn, row_number() OVER w AS number, lag(role) OVER w AS previous_role, lag(text) OVER w AS previous_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def g6_turn_numbers(t: Tables) -> DataFrame:
    return S.numbered(t.conversations, "conv_id", "turn", ["role", "text"]).select("conv_id", "turn", "number", "previous_role", "previous_text")


def follow_up_sql(text: str, first: str) -> str:
    low = f"lower({text})"
    has = {k: any_sql(low, ws) for k, ws in W.FOLLOW_UP.items()}
    starts = "(" + " OR ".join(f"starts_with({low}, {quoted(w)})" for w in W.FOLLOW_UP["starts"]) + ")"
    return (
        f"CASE WHEN {first} THEN 'independent' WHEN {has['count']} AND {has['reference']} THEN 'aggregate' WHEN {has['sort']} AND {has['reference']} THEN 'sort_add' WHEN {starts} OR {has['additive']} THEN 'filter_add' "
        f"WHEN {has['refining']} THEN 'filter_refine' WHEN {has['reference']} AND {has['filter']} THEN 'filter_add' WHEN {has['reference']} THEN 'full_reference' ELSE 'independent' END"
    )


#: A spoken follow-up for every user turn, by its number, before the turn's own words.
SPOKEN = "concat(CASE turn % 5 WHEN 0 THEN 'How many of them ' WHEN 1 THEN 'sort those by price ' WHEN 2 THEN 'Now what about ' WHEN 3 THEN 'but only ' ELSE '' END, coalesce(text, ''))"


@query(f"WITH u AS (SELECT conv_id, turn, {SPOKEN} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS f FROM conversations WHERE role = 'user') SELECT conv_id, turn, {follow_up_sql('said', 'f')} AS follow_up FROM u")
def n1_follow_up_types(t: Tables) -> DataFrame:
    said = t.conversations.where("role = 'user'").select("conv_id", "turn", F.expr(SPOKEN).alias("said"))
    return S.follow_ups(said, "conv_id", "turn", "said").select("conv_id", "turn", "follow_up")


@query("""WITH s AS (SELECT conv_id, count(*) AS turns, min(turn) AS started, max(turn) AS last_active, string_agg(DISTINCT role, ',' ORDER BY role) AS topics FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, md5(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS last_texts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 10 GROUP BY conv_id)
SELECT * FROM s JOIN l USING (conv_id)""")
def n2_session_summary(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    s = S.session_summary(turns, "conv_id", "turn", "turn", "role", "text", 10)
    return s.select("conv_id", "turns", "started", "last_active", F.array_join("topics", ",").alias("topics"), F.md5(F.array_join("last_texts", "|")).alias("last_texts"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed, coalesce(round(count(*) FILTER (event_type <> 'error') * 100.0 / nullif(count(*), 0), 4), 0) AS success_rate, count(DISTINCT user_id) AS sessions FROM events")
def n3_engine_stats(t: Tables) -> DataFrame:
    return S.engine_stats(t.events, F.col("event_type") == "error", "user_id")


MESSAGE = "CASE event_id % 5 WHEN 0 THEN concat('No such table: ', event_type) WHEN 1 THEN concat('no such column: ', props) WHEN 2 THEN 'near SELECT: syntax error' WHEN 3 THEN 'Query gave no results' ELSE concat('disk full at ', CAST(user_id AS STRING)) END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(lower(m), '{p}') THEN '{k}'" for p, k in W.ERRORS) + f" ELSE 'unknown' END AS kind FROM (SELECT {MESSAGE} AS m FROM events)) GROUP BY kind")
def n4_error_kinds(t: Tables) -> DataFrame:
    return t.events.select(X.error_kind(F.expr(MESSAGE)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, user_id % 2 = 0 AS fallback, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / nullif(count(value), 0), 4) AS mean,
round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY ALL""")
def n5_outcome_report(t: Tables) -> DataFrame:
    log = t.events.withColumn("fallback", F.col("user_id") % 2 == 0)
    return S.outcome_report(log, ["event_type", "fallback"], "value", F.col("event_type") == "error")
