"""Registered queries: the event feeds' folds in their batch form, and those with state as streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import feeds as S
from .base import Tables, query
from .onboarding import folder

BODY = "CASE event_id % 10 WHEN 0 THEN 'oops {' WHEN 1 THEN '  ' WHEN 2 THEN '{\"j\": 1}' ELSE props END"
LEVEL = "CASE event_type WHEN 'view' THEN 'inStock' WHEN 'click' THEN 'inStock' WHEN 'purchase' THEN 'lowStock' ELSE 'outOfStock' END"
PARSED_SQL = f"parsed AS (SELECT event_id, ts, user_id % 10 AS retailer, {LEVEL} AS level, CAST(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.k') END AS BIGINT) AS k FROM (SELECT *, {BODY} AS body FROM events) WHERE CASE WHEN json_valid(body) THEN json_extract_string(body, '$.k') END IS NOT NULL)"


def updates(t: Tables) -> DataFrame:
    messages = t.events.select("event_id", "ts", (F.col("user_id") % 10).alias("retailer"), F.expr(LEVEL).alias("level"), F.expr(BODY).alias("body"))
    return S.parse_updates(messages, "body").drop("body")


@query(f"WITH {PARSED_SQL} SELECT event_id, k FROM parsed")
def o1_parse_updates(t: Tables) -> DataFrame:
    return updates(t).select("event_id", "k")


@query(f"WITH {PARSED_SQL} SELECT event_id, retailer FROM parsed WHERE retailer IN (1, 3, 7)")
def o2_subscribed(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([(1,), (3,), (3,), (7,)], "retailer bigint")
    return S.subscribed(updates(t), wanted, "retailer").select("event_id", "retailer")


@query(f"WITH {PARSED_SQL} SELECT retailer, k, arg_max(level, (ts, event_id)) AS level, max(ts) AS updated_at FROM parsed GROUP BY retailer, k")
def o3_latest_levels(t: Tables) -> DataFrame:
    return S.latest_levels(updates(t), ("retailer", "k"), "level", "ts", "event_id")


@query(f"WITH {PARSED_SQL} SELECT retailer, k, arg_max(level, (ts, event_id)) AS level, max(ts) AS updated_at FROM parsed GROUP BY retailer, k")
def o3_latest_levels_stream(t: Tables) -> DataFrame:
    """The same as a stream in update mode, whose changes are put into a keyed table."""
    states = S.latest_levels(updates(streamed(t, "events")), ("retailer", "k"), "level", "ts", "event_id")
    table = S.levels_upsert(states, ("retailer", "k"), folder(t, "levels"))
    states.writeStream.outputMode("update").option("checkpointLocation", folder(t, "progress")).trigger(availableNow=True).foreachBatch(table.upsert).start().awaitTermination()
    return table.read()


@query(f"WITH {PARSED_SQL}, l AS (SELECT *, lag(level) OVER (PARTITION BY retailer, k ORDER BY ts, event_id) AS before FROM parsed) SELECT retailer, k, ts, event_id, before, level AS after FROM l WHERE before <> level")
def o4_transitions(t: Tables) -> DataFrame:
    return S.transitions(updates(t), ("retailer", "k"), "level", "ts", "event_id")


@query(f"WITH {PARSED_SQL}, l AS (SELECT *, lag(level) OVER (PARTITION BY retailer, k ORDER BY ts, event_id) AS before FROM parsed) SELECT retailer, k, ts, event_id, before, level AS after FROM l WHERE before <> level")
def o4_transitions_stream(t: Tables) -> DataFrame:
    """The same as a stream over the events' files, run until they end; state is kept per retailer and product."""
    found = updates(streamed(t, "events"))
    return folded(t, found, S.transitions_fold(found, ("retailer", "k"), "level", "ts", "event_id", folder(t, "transitions")), "retailer bigint, k bigint, ts timestamp, event_id bigint, before string, after string")


def streamed(t: Tables, name: str) -> Tables:
    """The tables, of which one is a stream."""
    other = Tables(t.spark, t.dir)
    other[name] = arriving(t, name)
    return other


def folded(t: Tables, stream: DataFrame, fold: S.Fold, columns: str) -> DataFrame:
    """All rows that a fold emits until a stream's files end."""
    stream.writeStream.option("checkpointLocation", folder(t, "progress")).trigger(availableNow=True).foreachBatch(fold).start().awaitTermination()
    return fold.emitted(columns)


def arriving(t: Tables, name: str) -> DataFrame:
    """A stream over a table's files."""
    reader = t.spark.readStream.schema(t[name].schema)
    return reader.parquet(f"{t.dir}/{name}.parquet") if _is_folder(t, name) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)


def ended(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives until its files end; a batch that runs again overwrites what it wrote."""
    out = folder(t, "stream")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", folder(t, "progress")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def _is_folder(t: Tables, name: str) -> bool:
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{t.dir}/{name}.parquet")
    return path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'deal' ELSE 'stockUpdate' END AS type, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'Stock Update' END AS title, coalesce(CASE WHEN event_id % 2 = 0 THEN props END, '') AS body, false AS is_read FROM events""")
def o5_notifications(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "DEAL").otherwise("STOCK")
    made = S.notification(t.events, kind, F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.when(F.col("event_id") % 2 == 0, F.col("props")))
    return made.select("event_id", "type", "title", "body", "is_read")


ACTION = "CASE event_type WHEN 'signup' THEN 'read_all' WHEN 'error' THEN 'read_one' ELSE 'incoming' END"


def actions(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", F.expr(ACTION).alias("action"), F.get_json_object("props", "$.k").cast("bigint").alias("item"), "ts", "event_id")


UNREAD_SQL = f"""WITH a AS (SELECT user_id, {ACTION} AS action, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, ts, event_id FROM events),
i AS (SELECT user_id, item, min((ts, event_id)) FILTER (action = 'incoming') AS came, max((ts, event_id)) FILTER (action = 'read_one') AS marked FROM a WHERE action <> 'read_all' GROUP BY ALL),
e AS (SELECT user_id, max((ts, event_id)) AS marked_all FROM a WHERE action = 'read_all' GROUP BY user_id)
SELECT user_id, count(*) FILTER (NOT coalesce(marked > came, false) AND NOT coalesce(marked_all > came, false)) AS unread FROM i LEFT JOIN e USING (user_id) WHERE came IS NOT NULL GROUP BY user_id"""


@query(UNREAD_SQL)
def o6_unread(t: Tables) -> DataFrame:
    return S.unread(actions(t), "user_id", "action", "item", "ts", "event_id")


@query(UNREAD_SQL)
def o6_unread_stream(t: Tables) -> DataFrame:
    """The same as a stream over the events' files; actions may come 40 days late, and state is kept per user, item and ten days."""
    states = S.unread_states_within(actions(streamed(t, "events")), "user_id", "action", "item", "ts", "event_id", late="40 days", span="10 days")
    return S.unread_counts(ended(t, states, "update").drop("span"), "user_id", "item")


CONTEXT_SQL = "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS topic_said, role AS topic_role, string_agg(CAST(turn AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(CONTEXT_SQL)
def o7_session_context(t: Tables) -> DataFrame:
    return S.context(said(t.conversations), "conv_id", "turn", "said", "role")


def said(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", F.expr("CASE WHEN role = 'user' THEN text END").alias("said"))


@query(CONTEXT_SQL)
def o7_session_context_stream(t: Tables) -> DataFrame:
    """The same as a stream over the conversations' files; state is the topic and the last turns of a session."""
    turns = said(arriving(t, "conversations"))
    types = dict(turns.dtypes)
    fold = S.context_fold(turns, "conv_id", "turn", "said", "role", folder(t, "context"))
    return folded(t, turns, fold, f"conv_id {types['conv_id']}, turn {types['turn']}, topic_said string, topic_role string, recent string")


@query("""WITH s AS (SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-30 12:00:00') AS s FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00')
SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE (s // 604800) || 'w ago' END AS age FROM s""")
def o8_age_buckets(t: Tables) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    return t.events.where(F.col("ts") < now).select("event_id", S.age(F.col("ts"), now).alias("age"))
