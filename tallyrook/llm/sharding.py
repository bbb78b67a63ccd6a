"""Shards of near equal bytes that keep linked documents together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, body, ranked


@dataclass(frozen=True)
class Balance:
    """shards: how many. rounds: propagation steps. filler: unlinked documents up to so many times
    the mean size may be dealt last, to even out. buckets: classes of documents by hash, by which
    quotas admit moves."""

    shards: int = 24
    rounds: int = 4
    filler: float = 2.0
    buckets: int = 1024


def _deal(scratch: Scratch, rows: DataFrame, n: int) -> DataFrame:
    """A first balanced state: documents by falling size are dealt forth and back over shards."""
    r = ranked(scratch, rows.withColumn("_neg", -F.col("size")), [], ["_neg", "_key", "text_crc32"], "_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(2 * n))
    return r.withColumn("shard", F.when(turn < n, turn).otherwise(2 * n - 1 - turn).cast("int")).drop("_neg", "_rank")


def _propagate(scratch: Scratch, linked: DataFrame, still: DataFrame, mean: DataFrame, rule: Balance) -> DataFrame:
    """One step over the linked documents.

    Each asks for the shard that holds most bytes of its group. A shard admits requests, in the
    order of a hash, while what it holds apart from fillers stays below the mean. Which fit is read
    off running sums over hash buckets: shards times buckets rows, whatever the data, of which a task has
    those of a shard.
    """
    held = linked.groupBy("group", "shard").agg(F.sum("size").alias("b"))
    best = held.groupBy("group").agg(F.max(F.struct("b", (-F.col("shard")).alias("s"))).alias("m")).select("group", (-F.col("m.s")).alias("goal"))
    asked = linked.join(scratch.save(best), "group").withColumn("bucket", F.pmod(F.xxhash64("_key"), F.lit(rule.buckets)).cast("int"))
    flow = asked.where("goal <> shard").groupBy("goal", "bucket").agg(F.sum("size").alias("b"))
    flow = flow.withColumn("upto", F.sum("b").over(Window.partitionBy("goal").orderBy("bucket")))
    own = linked.groupBy("shard").agg(F.sum("size").alias("own"))
    loads = still.join(own, "shard", "left").join(F.broadcast(mean), F.lit(True))
    room = loads.select(F.col("shard").alias("goal"), (F.col("mean") - F.col("still") - F.coalesce("own", F.lit(0))).alias("room"))
    admitted = flow.join(room, "goal").where("upto <= room").groupBy("goal").agg(F.max("bucket").alias("last"))
    moved = asked.join(F.broadcast(admitted), "goal", "left")  # one row a shard
    return moved.withColumn("shard", F.when(F.col("bucket") <= F.col("last"), F.col("goal")).otherwise(F.col("shard"))).select(*linked.columns)


def _fill(scratch: Scratch, fillers: DataFrame, loads: DataFrame) -> DataFrame:
    """fillers with the shard in which they raise all shards to one level.

    loads: (shard, load), a row for each shard. The level is where the fillers' bytes fill the
    lowest shards evenly. Fillers in the order of a hash then run through the shards' gaps, by running sums.
    """
    total = fillers.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("f"))  # one row
    low = Window.orderBy("load", "shard")
    level = loads.join(F.broadcast(total), F.lit(True)).withColumn("l", (F.col("f") + F.sum("load").over(low)) / F.row_number().over(low))
    gaps = level.withColumn("gap", F.greatest(F.min("l").over(Window.partitionBy()) - F.col("load"), F.lit(0.0)))
    ends = gaps.withColumn("end", F.sum("gap").over(Window.orderBy("shard"))).agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))  # one row
    f = ranked(scratch, fillers, [], ["_key", "size"], "_nth", "size").join(F.broadcast(ends), F.lit(True))
    mid = F.col("size_upto") - F.col("size") / 2
    nth = F.size(F.filter("ends", lambda e: e["end"] <= mid))
    return f.withColumn("shard", F.get("ends", F.least(nth, F.size("ends") - 1))["shard"]).select(*fillers.columns)


def shard_documents(docs: DataFrame, rule: Balance = Balance(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, size, text_crc32, group, shard, slot), one row for each of docs.

    Links: documents of equal text. Equal texts form a star around their group rather than all
    pairs, so a group of any size costs its members. All start in a balanced deal by size; then
    propagation moves linked documents towards the shard of most of their group, under quotas that
    leave no shard above the mean, so that a group larger than the room stays split; last, small unlinked
    documents are dealt anew to bring all shards to one level. Slots count from 0 in each shard, in the order of
    a hash of id and text; reruns agree, however the table is cut into tasks.
    Null and empty texts have 8 bytes and are not linked; repeated rows are documents of their own,
    linked; other columns do not matter; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(body(text_col).cast("binary")).cast("long").alias("text_crc32"),
        F.when(F.length(text) > 0, F.md5(text)).alias("group"),
    ).withColumn("_key", F.md5(F.concat_ws(":", F.col("_id").cast("string"), "text_crc32")))
    dealt = scratch.save(_deal(scratch, slim, rule.shards))
    # written, so that the join deals both sides anew and a large group can be split
    many = scratch.save(dealt.where("group is not null").groupBy("group").agg(F.count("*").alias("_m")).where("_m > 1").select("group", F.lit(True).alias("_linked")))
    mean = scratch.save(dealt.agg((F.sum("size") / rule.shards).alias("mean"), F.avg("size").alias("each")))  # one row
    kind = F.when(F.col("_linked"), "linked").when(F.col("size") <= rule.filler * F.col("each"), "filler").otherwise("large")
    dealt = scratch.save(dealt.join(many, "group", "left").join(F.broadcast(mean), F.lit(True)).withColumn("_kind", kind).drop("_linked", "mean", "each"))
    shards = docs.sparkSession.range(rule.shards).select(F.col("id").cast("int").alias("shard"))
    large = dealt.where("_kind = 'large'").groupBy("shard").agg(F.sum("size").alias("own"))
    still = scratch.save(shards.join(large, "shard", "left").select("shard", F.coalesce("own", F.lit(0)).alias("still")))
    linked = dealt.where("_kind = 'linked'")
    for _ in range(rule.rounds):
        linked = scratch.save(_propagate(scratch, linked, still, mean, rule))
    firm = linked.unionByName(dealt.where("_kind = 'large'"))
    loads = shards.join(firm.groupBy("shard").agg(F.sum("size").alias("own")), "shard", "left").select("shard", F.coalesce("own", F.lit(0)).alias("load"))
    placed = scratch.save(firm.unionByName(_fill(scratch, dealt.where("_kind = 'filler'"), loads)))
    out = ranked(scratch, placed, ["shard"], ["_key", "size"], "slot")
    return out.select("_id", "size", "text_crc32", "group", "shard", (F.col("slot") - 1).alias("slot"))


def report(sharded: DataFrame) -> DataFrame:
    """The columns of op9."""
    return sharded.select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
