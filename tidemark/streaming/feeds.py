"""Folds over event feeds: stock updates, notifications, session context.

Functions without state serve batches and streams alike. Those that keep state take a stream; each has a
batch form that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import Fold, KeyedTable

UPDATE = "k bigint"


def parse_updates(messages: DataFrame, body: str, schema: str = UPDATE, need: str = "k") -> DataFrame:
    """messages with the fields of their JSON bodies; empty and malformed bodies, and those without `need`, are left out."""
    parsed = messages.where(F.trim(F.coalesce(F.col(body), F.lit(""))) != "").withColumn("_m", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col(f"_m.{need}").isNotNull()).select(*[c for c in messages.columns], "_m.*")


def subscribed(updates: DataFrame, subscriptions: DataFrame, retailer: str) -> DataFrame:
    """Updates of subscribed retailers; subscribing twice changes nothing. Works for a stream against a static table."""
    return updates.join(subscriptions.select(retailer).distinct(), retailer, "left_semi")


def latest_levels(updates: DataFrame, keys: tuple[str, ...], level: str, moment: str, tie: str) -> DataFrame:
    """The level of the newest update per key, by the updates' own time, so that late ones can't undo it."""
    newest = F.max_by(F.struct(F.col(level).alias("level"), F.col(moment).alias("updated_at")), F.struct(moment, tie))
    return updates.groupBy(*keys).agg(newest.alias("_s")).select(*keys, "_s.*")


def transitions(updates: DataFrame, keys: tuple[str, ...], level: str, moment: str, tie: str) -> DataFrame:
    """Updates whose level differs from the one before of the same keys: keys, moment, tie, before, after."""
    before = F.lag(level).over(Window.partitionBy(*keys).orderBy(moment, tie))
    return updates.withColumn("before", before).where(F.col("before") != F.col(level)).select(*keys, moment, tie, "before", F.col(level).alias("after"))


def transitions_fold(updates: DataFrame, keys: tuple[str, ...], level: str, moment: str, tie: str, folder: str, **more) -> Fold:
    """transitions over a stream of updates, for foreachBatch; the state is the newest update per key, and an update older than it is skipped.

    folder holds the state and what is emitted: keys, moment, tie, before, after. Updates of a key may come in any
    order within a batch, and are sorted by Spark, however many there are.
    """
    types = dict(updates.dtypes)
    columns = ", ".join(f"`{c}` {types[c]}" for c in keys) + f", at {types[moment]}, number {types[tie]}, level {types[level]}"
    state = KeyedTable(updates.sparkSession, f"{folder}/state", columns, keys)

    def step(batch: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = batch.select(*keys, F.col(moment).alias("at"), F.col(tie).alias("number"), F.col(level).alias("level")).withColumn("known", F.lit(False))
        both = rows.unionByName(last.withColumn("known", F.lit(True)))
        newest = F.max(F.when(F.col("known"), F.struct("at", "number"))).over(Window.partitionBy(*keys))
        both = both.withColumn("newest", newest).where("known OR newest IS NULL OR struct(at, number) > newest")
        before = F.lag("level").over(Window.partitionBy(*keys).orderBy("at", "number", F.desc("known")))
        changes = both.withColumn("before", before).where("NOT known AND before <> level")
        emitted = changes.select(*keys, F.col("at").alias(moment), F.col("number").alias(tie), "before", F.col("level").alias("after"))
        left = both.groupBy(*keys).agg(F.max_by(F.struct("at", "number", "level"), F.struct("at", "number")).alias("_s")).select(*keys, "_s.*")
        return emitted, left

    return Fold(state, f"{folder}/out", step, **more)


def levels_upsert(states: DataFrame, keys: tuple[str, ...], folder: str) -> KeyedTable:
    """The table to which a stream of latest_levels in update mode puts its rows, by foreachBatch(table.upsert)."""
    return KeyedTable(states.sparkSession, folder, ", ".join(f"`{c}` {t}" for c, t in states.dtypes), keys)


def notification(payload: DataFrame, kind: Column, title: Column, body: Column) -> DataFrame:
    """payload with type, title, body, is_read of the notification it makes."""
    return payload.withColumns({"type": F.when(kind == "DEAL", "deal").otherwise("stockUpdate"), "title": F.coalesce(title, F.lit("Stock Update")), "body": F.coalesce(body, F.lit("")), "is_read": F.lit(False)})


def unread_states(actions: DataFrame, user: str, action: str, item: str, moment: str, tie: str) -> DataFrame:
    """user, every, item, came, marked: when each item first came and was last marked as read, singly (read_one);
    and, where every is true, when all were (read_all).

    A stream in update mode keeps a row of state for each user and item; neither the order of arrival nor
    redelivered rows matter.
    """
    when, what = F.struct(moment, tie), F.col(action)
    rows = actions.where(what.isin("incoming", "read_one", "read_all")).select(user, (what == "read_all").alias("every"), F.when(what != "read_all", F.col(item)).alias(item), F.when(what == "incoming", when).alias("_came"), F.when(what != "incoming", when).alias("_marked"))
    return rows.groupBy(user, "every", item).agg(F.min("_came").alias("came"), F.max("_marked").alias("marked"))


def unread_states_within(actions: DataFrame, user: str, action: str, item: str, moment: str, tie: str, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """unread_states of each span of time, for a stream whose state doesn't grow for ever.

    An action that is delivered again within `late` of its moment is dropped, and one that comes later than
    that after the newest isn't counted; the state of a span is given up once no action of it can count. What the
    stream gives, of all spans, is put together by unread_counts.
    """
    fresh = actions.withWatermark(moment, late).dropDuplicatesWithinWatermark([user, action, item, tie])
    when, what = F.struct(moment, tie), F.col(action)
    rows = fresh.where(what.isin("incoming", "read_one", "read_all")).select(user, moment, (what == "read_all").alias("every"), F.when(what != "read_all", F.col(item)).alias(item), F.when(what == "incoming", when).alias("_came"), F.when(what != "incoming", when).alias("_marked"))
    return rows.groupBy(F.window(moment, span).alias("span"), user, "every", item).agg(F.min("_came").alias("came"), F.max("_marked").alias("marked"))


def unread_counts(states: DataFrame, user: str, item: str) -> DataFrame:
    """user, unread: items that came and weren't marked afterwards, from unread_states or all that its stream gave so far.

    An item that comes again counts as when it came first.
    """
    last = states.groupBy(user, "every", item).agg(F.min("came").alias("came"), F.max("marked").alias("marked"))
    every = last.where("every").select(user, F.col("marked").alias("marked_all"))
    open_ = last.where("NOT every AND came IS NOT NULL").join(every, user, "left")
    left = ~F.coalesce(F.col("marked") > F.col("came"), F.lit(False)) & ~F.coalesce(F.col("marked_all") > F.col("came"), F.lit(False))
    return open_.groupBy(user).agg(F.count(F.when(left, 1)).alias("unread"))


def unread(actions: DataFrame, user: str, action: str, item: str, moment: str, tie: str) -> DataFrame:
    """user, unread of a table of actions."""
    return unread_counts(unread_states(actions, user, action, item, moment, tie), user, item)


def context_fold(turns: DataFrame, session: str, turn: str, said: str, role: str, folder: str, n: int = 5, **more) -> Fold:
    """session, turn, topic_said, topic_role, recent after each turn of a stream, for foreachBatch: the last value of said that isn't
    null, the turn's own role, and the numbers of the last n turns. A session's turns may come in any order within a batch, but none before
    those of an earlier batch. folder holds the state (topic and last turns of each session) and what is emitted."""
    types = dict(turns.dtypes)
    state = KeyedTable(turns.sparkSession, f"{folder}/state", f"`{session}` {types[session]}, topic {types[said]}, turns array<{types[turn]}>", (session,))

    def step(batch: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
        w = Window.partitionBy(session).orderBy(turn)
        rows = batch.select(session, turn, said, F.col(role).alias("topic_role")).join(last, session, "left")
        topic = F.coalesce(F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "topic")
        own = F.collect_list(turn).over(w.rowsBetween(-(n - 1), Window.currentRow))
        every = F.concat(F.coalesce("turns", F.array().cast(f"array<{types[turn]}>")), own)
        rows = rows.withColumn("topic_said", topic).withColumn("every", every)
        rows = rows.withColumn("every", F.slice("every", F.greatest(F.size("every") - (n - 1), F.lit(1)), F.lit(n)))
        emitted = rows.select(session, turn, "topic_said", "topic_role", F.array_join(F.col("every").cast("array<string>"), ",").alias("recent"))
        left = rows.groupBy(session).agg(F.max_by(F.struct(F.col("topic_said").alias("topic"), F.col("every").alias("turns")), turn).alias("_s")).select(session, "_s.*")
        return emitted, left

    return Fold(state, f"{folder}/out", step, **more)


def context(turns: DataFrame, session: str, turn: str, said: str, role: str, n: int = 5) -> DataFrame:
    """What context_fold emits, over a table."""
    w = Window.partitionBy(session).orderBy(turn)
    recent = F.array_join(F.collect_list(turn).over(w.rowsBetween(-(n - 1), Window.currentRow)).cast("array<string>"), ",")
    return turns.select(session, turn, F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("topic_said"), F.col(role).alias("topic_role"), recent.alias("recent"))


def age(moment: Column, now: Column) -> Column:
    """How long ago: Just now, then whole minutes, hours, days, weeks."""
    s = F.unix_timestamp(now) - F.unix_timestamp(moment)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "Just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).when(s < 604800, part(86400, "d")).otherwise(part(604800, "w"))
