"""A pass's budget: rows and bytes, with a cursor at the first row left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..functions.text import free_name, row_digest
from ..policy import Policy
from .matching import new_events


def _cut(scratch: Scratch, places: DataFrame, policy: Policy) -> DataFrame:
    """One row (at, copies), or none: the last place that is taken, and how many rows there.

    places (at, size), dealt by range of their order: each range adds up by itself, and is shifted by what
    those before it hold, a row for each range.
    """
    n = max(8, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = scratch.save(places.repartitionByRange(n, "at").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    shift = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "bytes")])
    # a range that begins behind the budget can't hold the cut
    shift = shift.where((F.col("rows_before") < policy.batch_rows) & (F.col("bytes_before") <= policy.batch_bytes))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(F.broadcast(shift), "part").withColumns({"nth": F.col("rows_before") + F.count("*").over(inside), "upto": F.col("bytes_before") + F.sum("size").over(inside)})
    fits = run.where(((F.col("upto") <= policy.batch_bytes) & (F.col("nth") <= policy.batch_rows)) | (F.col("nth") == 1))
    return fits.groupBy("at").agg(F.count("*").alias("copies")).agg(F.max(F.struct("at", "copies")).alias("cut")).where("cut is not null").select("cut.*")


def within_budget(events: DataFrame, order: Sequence[str], policy: Policy = Policy(), text: str = "prompt") -> DataFrame:
    """The first events by order that fit rows and bytes. The row that would exceed the bytes is
    left, but a first row larger than all bytes passes alone, else it would never go. Nulls come first,
    ties go by the rows' digests, and equal rows go one by one, as far as they fit.

    Only places in the order and sizes are shuffled and summed up, by range; what comes out is a
    single place, the cut, and the events are filtered by it where they stand.
    """
    scratch = Scratch(events.sparkSession)
    at = F.struct(*[F.col(f"`{c}`") for c in order], row_digest(events))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    cut = scratch.save(_cut(scratch, events.select(at.alias("at"), size.alias("size")), policy))
    last, copies = free_name(events, "_last"), free_name(events, "_copies")
    met = events.join(F.broadcast(cut.select(F.col("at").alias(last), F.col("copies").alias(copies))), F.lit(True))  # one row
    all_before = met.where(at < F.col(last)).drop(last, copies)
    # rows of one place are alike, so one of them stands for as many as go
    there = met.where(at == F.col(last)).limit(1).withColumn(last, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(last, copies)
    return all_before.unionByName(there)


def cursor(events: DataFrame, taken: DataFrame, keys: Sequence[str], path: str = "path", offset: str = "offset") -> DataFrame:
    """(path, offset): the first pending offset of each path that is not done."""
    return events.join(taken.select(*keys), list(keys), "left_anti").groupBy(path).agg(F.min(offset).alias(offset))


def reserved_budget(events: DataFrame, known: Sequence[DataFrame], order: Sequence[str], keys: Sequence[str], policy: Policy = Policy(), text: str = "prompt") -> DataFrame:
    """The budget is spent only on events that none of `known` (exact ids, direct captures,
    aliases) accounts for, so that repeats cannot starve later ones."""
    for k in known:
        events = new_events(events, k, keys)
    return within_budget(events, order, policy, text)
