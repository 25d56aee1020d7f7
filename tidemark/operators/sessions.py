"""Sessions and query logs: last turns, carried topics, follow-ups, summaries, outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranges import quantiles


def last_turns(turns: DataFrame, session: str, turn: str, n: int = 5) -> DataFrame:
    """The last n turns of each session, back = 1 for the newest."""
    w = Window.partitionBy(session).orderBy(F.desc(turn))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def carry_forward(turns: DataFrame, session: str, turn: str, keep: Sequence[str], newest: Sequence[str] = ()) -> DataFrame:
    """turns with topic_<column>: the last value that isn't null so far for keep, the turn's own for newest."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {f"topic_{c}": F.last(c, ignorenulls=True).over(w) for c in keep} | {f"topic_{c}": F.last(c).over(w) for c in newest}
    return turns.withColumns(out)


def numbered(turns: DataFrame, session: str, turn: str, previous: Sequence[str] = ()) -> DataFrame:
    """turns with number (from 1) and previous_<column> of the turn before."""
    w = Window.partitionBy(session).orderBy(turn)
    return turns.withColumns({"number": F.row_number().over(w)} | {f"previous_{c}": F.lag(c).over(w) for c in previous})


def follow_ups(turns: DataFrame, session: str, turn: str, text: str) -> DataFrame:
    """turns with follow_up: how each depends on the turns before it in its session."""
    w = Window.partitionBy(session).orderBy(turn)
    return turns.withColumn("follow_up", X.follow_up(F.col(text), F.row_number().over(w) == 1))


def session_summary(turns: DataFrame, session: str, turn: str, moment: str, topic: str, text: str, last: int = 10) -> DataFrame:
    """A row per session: turns, started, last_active, topics (sorted), last_texts (newest last)."""
    newest = last_turns(turns, session, turn, last).groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("x")))), lambda s: s["x"]).alias("last_texts"))
    sums = turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.min(moment).alias("started"), F.max(moment).alias("last_active"), F.sort_array(F.collect_set(topic)).alias("topics"))
    return sums.join(newest, session)


def engine_stats(log: DataFrame, failed, session: str) -> DataFrame:
    """total, successful, failed, success_rate (0 without rows), sessions."""
    n, bad = F.count(F.lit(1)), F.count(F.when(failed, 1))
    return log.agg(n.alias("total"), (n - bad).alias("successful"), bad.alias("failed"), F.coalesce(F.round((n - bad) * 100.0 / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("success_rate"), F.countDistinct(session).alias("sessions"))


def outcome_report(log: DataFrame, groups: Sequence[str], latency: str, failed) -> DataFrame:
    """Per group: n, failures, mean, median, p95 and most of a latency."""
    sums = log.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(failed, 1)).alias("failures"),
        F.round(F.sum(F.col(latency).cast("decimal(28,6)")).cast("double") / F.nullif(F.count(latency), F.lit(0)), 4).alias("mean"), F.max(latency).alias("most"),
    )
    found = quantiles(log, groups, latency, {"median": 0.5, "p95": 0.95}).select(*[F.col(g).alias(f"_{g}") for g in groups], F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))
    same = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"_{g}")), groups, F.lit(True))
    return sums.join(found, same, "left").select(*groups, "n", "failures", "mean", "median", "p95", "most")
