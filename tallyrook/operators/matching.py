"""Joins: permanent deduplication, one-to-one correlation, aliases and full comparisons."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..functions.text import free_name


def new_events(events: DataFrame, durable: DataFrame, keys: Sequence[str] = ("tool", "event_id")) -> DataFrame:
    """Events whose id is not durable yet. Against the store itself, so an id is never forgotten. A null
    equals a null here, else events without an id would be new each time."""
    own = durable.select(*[F.col(k).alias(f"_known{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= events[k].eqNullSafe(own[f"_known{i}"])
    return events.join(own, same, "left_anti")


def first_per_id(events: DataFrame, keys: Sequence[str] = ("tool", "event_id"), order: Sequence[Column] = ()) -> DataFrame:
    """One row for each id, the first by order. Spark takes the first of each partition before it shuffles."""
    by = Window.partitionBy(*keys).orderBy(*(order or [F.col("ts")]))
    nth = free_name(events, "_rn")
    return events.withColumn(nth, F.row_number().over(by)).where(F.col(nth) == 1).drop(nth)


def candidates(direct: DataFrame, recovered: DataFrame, keys: Sequence[str], micros: int, id_col: str = "id", ts: str = "ts") -> DataFrame:
    """All (direct_id, recovered_id) of equal keys no further apart than micros, both ends included.

    The join is on the keys and on a stretch of time as long as the window, in which and in whose
    neighbours a direct event stands, so that a common key does not meet itself over all time.
    """
    side = lambda df, own: df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.unix_micros(F.col(ts)).alias(f"{own}_t"), F.col(id_col).alias(f"{own}_id"))
    span = max(micros, 1)
    at = F.expr(f"direct_t div {span}")
    d = side(direct, "direct").withColumn("slot", F.explode(F.array(at - 1, at, at + 1)))
    r = side(recovered, "recovered").withColumn("slot", F.expr(f"recovered_t div {span}"))
    both = d.join(r, [*[f"k{i}" for i in range(len(keys))], "slot"])
    return both.where(F.abs(F.col("direct_t") - F.col("recovered_t")) <= micros).select("direct_id", "recovered_id")


def _walk(names: Sequence[str], micros: int):
    """Pairs events that come sorted by (names, piece, t, id). What waits is of one side and within the window."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, side, waiting = None, True, deque()
        for b in batches:
            left, right = [], []
            keys = zip(*[b[n].to_pylist() for n in (*names, "piece")])
            for key, t, direct, own in zip(keys, b["t"].to_pylist(), b["direct"].to_pylist(), b["id"].to_pylist()):
                if key != now:
                    now = key
                    waiting.clear()
                while waiting and t - waiting[0][0] > micros:
                    waiting.popleft()
                if waiting and side != direct:
                    _, other = waiting.popleft()
                    left.append(own if direct else other)
                    right.append(other if direct else own)
                else:
                    side = direct
                    waiting.append((t, own))
            kind = b.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["direct_id", "recovered_id"])

    return walk


def _walk_on(micros: int):
    """As _walk, over ranges of which each begins with what waits from the one before it (first = 0). Beside
    pairs it yields what waits at a range's end, with no other."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, side, waiting, last = None, True, deque(), 0
        names, kinds = ["range", "t", "direct", "id", "other"], None

        def rest() -> list:
            return [(now, t, side, own, None) for t, own in waiting if last - t <= micros]

        for b in batches:
            kinds = b.schema
            rows = []
            for key, first, t, direct, own in zip(*[b[n].to_pylist() for n in ("range", "first", "t", "direct", "id")]):
                if key != now:
                    rows += rest()
                    now = key
                    waiting.clear()
                if first == 0:
                    side = direct
                    waiting.append((t, own))
                    last = t
                    continue
                last = t
                while waiting and t - waiting[0][0] > micros:
                    waiting.popleft()
                if waiting and side != direct:
                    _, other = waiting.popleft()
                    rows.append((key, t, None, own, other) if direct else (key, t, None, other, own))
                else:
                    side = direct
                    waiting.append((t, own))
            yield _batch(rows, names, kinds)
        if kinds is not None:
            yield _batch(rest(), names, kinds)

    return walk


def _batch(rows: list, names: Sequence[str], kinds: pa.Schema) -> pa.RecordBatch:
    of = {n: kinds.field("id" if n == "other" else n).type for n in names}
    return pa.RecordBatch.from_arrays([pa.array(c, of[n]) for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))], list(names))


def _pair_ranges(events: DataFrame, micros: int, n: int, scratch: Scratch) -> DataFrame:
    """(direct_id, recovered_id) of (chain, part, t, direct, id), in which a chain is one long piece over several parts.

    All parts are walked through at once, as if nothing waited at their starts. Then those are walked through
    again at whose start something else waits than was supposed, until there are none. The first part of a chain is right
    at once, and each round makes right at least one more; mostly what waits soon no longer
    depends on how a part began, and a few rounds do. What is kept in the driver is a number for each part.
    """
    spark = events.sparkSession
    events = scratch.save(events.withColumn("range", F.concat_ws(":", "chain", "part")))
    follows = events.select("chain", "part", "range").distinct().withColumn("after", F.lead("range").over(Window.partitionBy("chain").orderBy("part")))
    follows = scratch.save(follows.where("after is not null").select("range", "after"))
    kind = events.schema["id"].dataType.simpleString()

    def walked(own: DataFrame, waiting: DataFrame) -> DataFrame:
        both = own.select("range", F.lit(1).alias("first"), "t", "direct", "id").unionByName(waiting.select("range", F.lit(0).alias("first"), "t", "direct", "id"))
        dealt = both.repartition(n, "range").sortWithinPartitions("range", "first", "t", "id")
        return dealt.mapInArrow(_walk_on(micros), f"range string, t long, direct boolean, id {kind}, other {kind}")

    last = {r["range"]: 0 for r in events.select("range").distinct().collect()}
    empty = events.limit(0).select("range", "t", "direct", "id")
    supposed = scratch.save(multiset_digest(empty.withColumn("line", F.lit("")), ["range"], "line"))
    rounds = [scratch.save(walked(events, empty))]
    while True:
        held = F.broadcast(spark.createDataFrame(list(last.items()), "range string, round int"))  # a row for each part
        now = rounds[0].withColumn("round", F.lit(0))
        for i, table in enumerate(rounds[1:], 1):
            now = now.unionByName(table.withColumn("round", F.lit(i)))
        now = now.join(held, ["range", "round"]).drop("round")
        waits = now.where("other is null").join(F.broadcast(follows), "range").select(F.col("after").alias("range"), "t", "direct", "id")
        waits = scratch.save(waits)
        found = scratch.save(multiset_digest(waits.withColumn("line", F.concat_ws(" ", "t", "direct", F.xxhash64("id"))), ["range"], "line"))
        stale = differing(found, supposed, "range").select("range")
        names = [r["range"] for r in stale.collect()]  # at most a row for each part
        if not names:
            return now.where("other is not null").select(F.col("id").alias("direct_id"), F.col("other").alias("recovered_id"))
        again = F.broadcast(spark.createDataFrame([(x,) for x in names], "range string"))
        rounds.append(scratch.save(walked(events.join(again, "range", "left_semi"), waits.join(again, "range", "left_semi"))))
        last |= dict.fromkeys(names, len(rounds) - 1)
        supposed = found


def correlate(direct: DataFrame, recovered: DataFrame, keys: Sequence[str], micros: int, id_col: str = "id", ts: str = "ts") -> DataFrame:
    """(direct_id, recovered_id): the most one-to-one pairs of equal keys within micros.

    Two pointers go over both sides of a key in the order of (time, id): the two earliest pair if
    near enough, else the earlier one is left. Null keys and times match nothing.

    Events are dealt by range of (key, time), so that no key is whole in one task. There each learns
    how near the other side comes, and those that it does not come near leave. A key is cut wherever
    no pair can cross, that is where on either side the next event is too far from the last one of the
    other; the pieces are dealt by hash, and a task walks through its sorted pieces in batches
    and remembers no more than what may still be matched. A key in which both sides are dense
    throughout is one piece over many parts, and those are walked through side by side (`_pair_ranges`).
    """
    scratch = Scratch(direct.sparkSession)
    names = [f"k{i}" for i in range(len(keys))]
    side = lambda df, own: df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.unix_micros(F.col(ts)).alias("t"), F.col(id_col).alias("id"), F.lit(own).alias("direct"))
    both = side(direct, True).unionByName(side(recovered, False)).dropna(subset=[*names, "t"])
    order = ["t", "direct", "id"]
    n = max(8, int(direct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = scratch.save(both.repartitionByRange(n, *names, *order).withColumn("part", F.spark_partition_id()))
    d, r = F.when(F.col("direct"), F.col("t")), F.when(~F.col("direct"), F.col("t"))
    # what a part must know of the same key in others: a row for each part that a key goes on from, and for its start
    seen = at.groupBy("part", *names).agg(F.max(d).alias("d1"), F.max(r).alias("r1"), F.min(d).alias("d0"), F.min(r).alias("r0"))
    by = Window.partitionBy(*names).orderBy("part")
    earlier, later = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*names).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select("part", *names, F.max("d1").over(earlier).alias("pd"), F.max("r1").over(earlier).alias("pr"), F.min("d0").over(later).alias("nd"), F.min("r0").over(later).alias("nr"))
    carried = scratch.save(carried.where("coalesce(pd, pr, nd, nr) is not null"))
    inside = Window.partitionBy("part", *names)
    before = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = inside.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    near = at.join(F.broadcast(carried), ["part", *names], "left")  # at most two rows a part
    near = near.withColumns({
        "pd": F.greatest("pd", F.max(d).over(before)), "pr": F.greatest("pr", F.max(r).over(before)),
        "nd": F.least("nd", F.min(d).over(after)), "nr": F.least("nr", F.min(r).over(after)),
    })
    last, following = F.when(F.col("direct"), F.col("pr")).otherwise(F.col("pd")), F.when(F.col("direct"), F.col("nr")).otherwise(F.col("nd"))
    met = F.coalesce(F.col("t") - last <= micros, F.lit(False)) | F.coalesce(following - F.col("t") <= micros, F.lit(False))
    crossing = F.coalesce(F.least("nr", r) - F.col("pd") <= micros, F.lit(False)) | F.coalesce(F.least("nd", d) - F.col("pr") <= micros, F.lit(False))
    kept = near.withColumns({"met": met, "cut": (~crossing).cast("long")}).withColumn("cuts", F.sum("cut").over(inside.orderBy(*order)))
    kept = scratch.save(kept.where("met").select("part", *names, *order, "cuts"))
    most = kept.groupBy("part", *names).agg(F.min("cuts").alias("low"), F.max("cuts").alias("cuts"))
    most = scratch.save(most.withColumn("shift", F.coalesce(F.sum("cuts").over(earlier), F.lit(0))))
    shift = most.where("shift > 0").select("part", *names, "shift")
    pieces = kept.join(F.broadcast(shift), ["part", *names], "left").withColumn("piece", F.col("cuts") + F.coalesce("shift", F.lit(0)))
    # pieces that fill a part and reach into both its neighbours: fewer than there are parts
    ends = most.select("part", *names, F.explode(F.array_distinct(F.array(F.col("low") + F.col("shift"), F.col("cuts") + F.col("shift")))).alias("piece"))
    long = ends.groupBy(*names, "piece").agg(F.count("*").alias("parts")).where("parts >= 3").drop("parts")
    long = scratch.save(long.withColumn("chain", F.row_number().over(Window.orderBy(*names, "piece"))))
    id_type = direct.schema[id_col].dataType.simpleString()
    some = not long.isEmpty()
    short = pieces.join(F.broadcast(long), [*names, "piece"], "left_anti") if some else pieces
    dealt = short.repartition(n, *names, "piece").sortWithinPartitions(*names, "piece", "t", "id")
    pairs = dealt.select(*names, "piece", "t", "direct", "id").mapInArrow(_walk(names, micros), f"direct_id {id_type}, recovered_id {id_type}")
    if not some:
        return pairs
    return pairs.unionByName(_pair_ranges(pieces.join(F.broadcast(long), [*names, "piece"]).select("chain", "part", "t", "direct", "id"), micros, n, scratch))


def unmatched(recovered: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """Recovered events to import: those that no direct one answers for."""
    return recovered.join(pairs.select(F.col("recovered_id").alias(id_col)), id_col, "left_anti")


def aliases(old: DataFrame, events: DataFrame, on: str) -> DataFrame:
    """(old_id, event_id) where the match is one to one both ways. old has old_id, events event_id.

    Each side meets only the counts of the other, so that copies are never paired."""

    def alone(side: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
        many = other.groupBy(on).agg(F.count("*").alias("_n"))
        met = side.select(on, id_col).join(many, on).groupBy(id_col).agg(F.sum("_n").alias("_n"), F.min(on).alias(on))
        return met.where("_n = 1").select(on, id_col)

    return alone(old, events, "old_id").join(alone(events, old, "event_id"), on).select("old_id", "event_id")


def void_aliases(alias: DataFrame, exact: DataFrame) -> DataFrame:
    """Aliases whose event came back under its own id: their progress is void, and a full scan is due."""
    keys = [c for c in ("tool", "event_id") if c in alias.columns and c in exact.columns]
    return alias.join(exact.select(*keys), keys, "left_semi")


def compare(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing, extra or changed. Equal rows are left out."""
    e, f = expected.select(key, F.col(value).alias("want"), F.lit(1).alias("e")), found.select(key, F.col(value).alias("got"), F.lit(1).alias("f"))
    state = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("got")), "changed")
    return e.join(f, key, "full").select(key, state.alias("state")).where("state is not null")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repeated rows counted, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def manifest_ok(manifest: DataFrame, files: DataFrame, paths: int = 6) -> DataFrame:
    """One row (ok): the manifest has so many different paths, each once, and every file agrees."""
    shape = manifest.agg(((F.count("*") == paths) & (F.count_distinct("path") == paths)).alias("shape"))
    clean = compare(manifest, files, "path", "sha256").agg((F.count("*") == 0).alias("clean"))
    return shape.join(F.broadcast(clean), F.lit(True)).select((F.col("shape") & F.col("clean")).alias("ok"))


def prefixes_hold(backups: DataFrame, state: DataFrame) -> DataFrame:
    """(path, holds) for state (path, n_bytes, sha256): the backup (path, content) still starts so."""
    at = state.join(backups, "path", "left")
    same = F.sha2(F.substring(F.col("content"), F.lit(1), F.col("n_bytes").cast("int")), 256) == F.col("sha256")
    return at.select("path", F.coalesce((F.octet_length("content") >= F.col("n_bytes")) & same, F.lit(False)).alias("holds"))


def merge_pending(backup: DataFrame, pending: DataFrame, keys: Sequence[str] = ("tool", "event_id")) -> DataFrame:
    """The backup with the queue's events that it lacks, each once."""
    return backup.unionByName(new_events(first_per_id(pending, keys), backup, keys))


def multiset_digest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, digest, n_rows, n_bytes): rows of equal keys as a digest that no order changes and repeats do.

    It adds up two 60-bit parts of each value's SHA-256, so tasks add up their own rows first, and a
    hot key costs no more than others. A null value counts as a row of its own. Up to 10^12 rows a key.
    """
    sha = F.coalesce(F.sha2(F.col(value), 256), F.lit("0" * 64))
    part = lambda at: F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("n_bytes"), part(1).alias("a"), part(16).alias("b"))
    return sums.select(*keys, F.concat_ws("-", "n_rows", "a", "b").alias("digest"), "n_rows", "n_bytes")


def differing(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """(key, n_bytes, had) of keys whose digests differ between two results of multiset_digest: n_bytes that are wanted,
    and whether the other side has the key at all."""
    both = want.join(have.select(F.col(key).alias("_key"), F.col("digest").alias("_had")), F.col(key).eqNullSafe(F.col("_key")), "full")
    both = both.where(~F.col("digest").eqNullSafe(F.col("_had")))
    return both.select(F.coalesce(key, "_key").alias(key), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.col("_had").isNotNull().alias("had"))


def isolate(df: DataFrame, keys: Sequence[str], content: str, order: Sequence[Column] = (), scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, others): each id once, by order and then by its content's digest, and the rows whose content
    is another than the one kept under their id. Equal contents are one. Null keys are equal.

    Only rows of ids that stand more than once are shuffled; those are found by counts."""
    many = df.groupBy(*[F.col(k).alias(f"_many{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    many = (scratch or Scratch(df.sparkSession)).save(many)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= df[k].eqNullSafe(many[f"_many{i}"])
    repeated = df.join(many, same, "left_semi")
    first = first_per_id(repeated, keys, [*order, F.sha2(F.col(content), 256)])
    own = first.select(*[F.col(k).alias(f"_own{i}") for i, k in enumerate(keys)], F.sha2(F.col(content), 256).alias("_sha"))
    match = F.sha2(repeated[content], 256).eqNullSafe(own["_sha"])
    for i, k in enumerate(keys):
        match &= repeated[k].eqNullSafe(own[f"_own{i}"])
    return df.join(many, same, "left_anti").unionByName(first), repeated.join(own, match, "left_anti")
