"""Status, staleness, sessions and health: aggregations over the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status(events: DataFrame, tools: DataFrame | None = None, tool: str = "tool", ts: str = "ts") -> DataFrame:
    """(tool, n, last_ts), with a zero row for each of tools (tool) that has no event."""
    found = events.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
    if tools is None:
        return found
    return tools.select("tool").distinct().join(found, "tool", "left").select("tool", F.coalesce("n", F.lit(0)).alias("n"), "last_ts")


def silent(found: DataFrame, threshold: Column) -> DataFrame:
    """status rows with `silent`: no event, or the last one older than the newest by the threshold."""
    newest = F.max("last_ts").over(Window.partitionBy())
    return found.withColumn("silent", (F.col("n") == 0) | F.coalesce(newest - F.col("last_ts") > threshold, F.lit(True)))


def quiet_runs(periods: DataFrame, events: DataFrame, who: str, period: str) -> DataFrame:
    """(who, first, last, n): maximal runs of a user's periods without an event. periods has one row
    for each (who, period); events any number."""
    flagged = periods.join(events.select(who, period).distinct().withColumn("_hit", F.lit(1)), [who, period], "left")
    by = Window.partitionBy(who).orderBy(period)
    runs = flagged.withColumn("_run", F.sum(F.col("_hit")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_hit is null")
    return runs.groupBy(who, F.coalesce("_run", F.lit(0)).alias("_run")).agg(F.min(period).alias("first"), F.max(period).alias("last"), F.count("*").alias("n")).drop("_run")


def repeated(events: DataFrame, by: Sequence[Column], least: int) -> DataFrame:
    """Groups with at least so many events."""
    return events.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def queue_age(pending: DataFrame, now: Column, threshold: Column, ts: str = "ts") -> DataFrame:
    """One row: the oldest undelivered event, and whether it is over the threshold."""
    return pending.agg(F.min(ts).alias("oldest"), F.count("*").alias("n")).withColumn("late", F.coalesce(now - F.col("oldest") > threshold, F.lit(False)))


def health(log: DataFrame, code: str = "code") -> DataFrame:
    """(code, n, last_ts) over the health log, which holds codes only."""
    return log.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def listing(events: DataFrame, columns: Sequence[str], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The log: chosen columns in the order of time and id, by a distributed sort."""
    return events.orderBy(*order).select(*columns)


def in_file_order(lines: DataFrame, path: str = "path", offset: str = "offset") -> DataFrame:
    """Lines of transcripts by file and place."""
    return lines.orderBy(path, offset)


def rollup(events: DataFrame, tool: str = "tool", ts: str = "ts") -> DataFrame:
    """The report: events and sessions by day and tool."""
    return events.groupBy(F.to_date(ts).alias("day"), F.col(tool).alias("tool")).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))
