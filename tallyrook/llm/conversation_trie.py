"""The trie of conversation prefixes, with totals of subtrees by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, body, n_words, small_batches

KEY = ["depth", "x1", "x2"]
NODE = "outside boolean, conv_id long, depth long, x1 long, x2 long, u1 long, u2 long, n_convs long, n_children long, n_leaves long, saved_tokens long"
NAMES = [c.split()[0] for c in NODE.split(", ")]


@dataclass(frozen=True)
class Trie:
    """members: a node with more conversations than this, and than an eighth of a shard's share,
    belongs to the crown, and what hangs below the crown is dealt into shards whole. queue: messages
    that a task's queue holds in memory before it writes a sorted run to its disk. every, heads: a
    conversation is rebuilt on the first turns, fewer than heads, of the one at the next lower
    multiple of every."""

    members: int = 1000
    queue: int = 200_000
    every: int = 20
    heads: int = 4


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, w): two hashes of role and text, a null read as empty, and the text's words.
    Later steps see no text. Rows without a conv_id are no one's turns."""
    role, text = body("role"), body("text")
    second = F.conv(F.substring(F.md5(F.concat(F.length(role), F.lit(":"), role, text)), 1, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.xxhash64(role, text).alias("a"), second.alias("b"), n_words(text).alias("w"))


def _along(scratch: Scratch, rows: DataFrame, order: Sequence[str], xors: Sequence[str] = ()) -> DataFrame:
    """rows with `place`, from 1 within a conversation by order, and the running xor of some columns.

    Rows are dealt by range, so that a long conversation is not in one task; each range is
    numbered by itself and shifted by what earlier ranges hold of the conversation that goes on in
    it, which is one for each range at most.
    """
    n = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc_nulls_first() for c in order]
    at = scratch.save(rows.repartitionByRange(n, "conv_id", *by).withColumn("_part", F.spark_partition_id()))
    sums = {"place": F.count("*")} | {c: F.bit_xor(c) for c in xors}
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = at.groupBy("_part", "conv_id").agg(*[v.alias(f"_{k}") for k, v in sums.items()])
    shift = counts.select("_part", "conv_id", F.sum("_place").over(before).alias("_place"), *[F.bit_xor(f"_{c}").over(before).alias(f"_{c}") for c in xors]).where("_place is not null")
    inside = Window.partitionBy("_part", "conv_id").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    run = at.withColumns({"place": F.count("*").over(inside)} | {f"{c}_run": F.bit_xor(c).over(inside) for c in xors})
    met = run.join(F.broadcast(shift), ["_part", "conv_id"], "left")
    carried = {"place": F.col("place") + F.coalesce("_place", F.lit(0))} | {f"{c}_run": F.col(f"{c}_run").bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in xors}
    return met.withColumns(carried).drop("_part", "_place", *[f"_{c}" for c in xors])


def rebuilt(scratch: Scratch, turns: DataFrame, rule: Trie = Trie()) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c begins with the first crc32(c) % heads turns of c - c %
    every, as far as there are any, and goes on with its own beyond as many."""
    placed = scratch.save(_along(scratch, turns, ["turn", "a", "b"]).select("conv_id", "place", "a", "b", "w"))
    convs = scratch.save(placed.groupBy("conv_id").agg(F.max("place").alias("n")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % rule.heads
    own = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % rule.every).alias("base"), h.alias("h"))
    info = own.join(convs.select(F.col("conv_id").alias("base"), "n"), "base", "left").withColumn("m", F.least("h", F.coalesce("n", F.lit(0))))
    info = scratch.save(info.select("conv_id", "base", "h", "m"))
    first = placed.where((F.col("place") < rule.heads) & (F.col("conv_id") % rule.every == 0)).withColumnRenamed("conv_id", "base")
    heads = info.where("m > 0").join(first, "base").where("place <= m").select("conv_id", F.col("place").alias("depth"), "a", "b", "w")
    rest = placed.join(info, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "a", "b", "w")
    return heads.unionByName(rest), convs.select("conv_id")


class SpillingQueue:
    """A priority queue of equal-sized tuples of whole numbers. Beyond its limit it writes what it holds as a
    sorted run to a file that has no name, and merges the runs as they are popped."""

    def __init__(self, limit: int, width: int):
        self.limit, self.pack = limit, struct.Struct(f"<{width}q")
        self.heap: list[tuple] = []
        self.fronts: list[tuple[tuple, int]] = []
        self.runs: list[Iterator[tuple]] = []

    def _read(self, f, block: int = 4096) -> Iterator[tuple]:
        at, size = 0, self.pack.size * block
        while True:
            f.seek(at)
            data = f.read(size)
            if not data:
                f.close()
                return
            at += len(data)
            yield from self.pack.iter_unpack(data)

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            f = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                f.write(self.pack.pack(*x))
            self.heap.clear()
            self.runs.append(self._read(f))
            heapq.heappush(self.fronts, (next(self.runs[-1]), len(self.runs) - 1))

    def first(self) -> tuple | None:
        tops = [x for x in (self.heap[:1] and self.heap[0], self.fronts[:1] and self.fronts[0][0]) if x]
        return min(tops) if tops else None

    def pop(self) -> tuple:
        if not self.fronts or (self.heap and self.heap[0] <= self.fronts[0][0]):
            return heapq.heappop(self.heap)
        item, i = self.fronts[0]
        after = next(self.runs[i], None)
        if after is None:
            heapq.heappop(self.fronts)
        else:
            heapq.heapreplace(self.fronts, (after, i))
        return item


def _forward(limit: int):
    """Nodes come deepest level first. Each takes what its children have sent, adds its own, and sends the sum
    to its parent's place in that order. What is sent to a node that is not among them is given out."""

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit, 6)

        def taken(upto: tuple | None) -> Iterator[tuple]:
            """The sums of messages to each place before upto."""
            while (top := queue.first()) and (upto is None or top[:3] < upto):
                yield received(top[:3])

        def received(place: tuple) -> tuple:
            children = leaves = saved = 0
            while (top := queue.first()) and top[:3] == place:
                _, _, _, c, n, s = queue.pop()
                children, leaves, saved = children + c, leaves + n, saved + s
            return (*place, children, leaves, saved)

        outside = lambda m: (True, None, -m[0], m[1], m[2], None, None, None, *m[3:])
        for b in batches:
            out = []
            for c, d, x1, x2, u1, u2, n, w, *more in zip(*[b[k].to_pylist() for k in ("conv_id", *KEY, "u1", "u2", "n_convs", "w", "n_children", "n_leaves", "saved_tokens")]):
                place = (-d, x1, x2)
                out += [outside(m) for m in taken(place)]
                children, leaves, saved = (x + y for x, y in zip(received(place)[3:], more))
                leaves, saved = leaves or 1, saved + (n - 1) * w
                out.append((False, c, d, x1, x2, u1, u2, n, children, leaves, saved))
                if d > 0:
                    queue.push((1 - d, u1, u2, 1, leaves, saved))
            yield _nodes(out)
        left = []
        for m in taken(None):
            left.append(outside(m))
            if len(left) == 4096:
                yield _nodes(left)
                left = []
        yield _nodes(left)

    return forward


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.bool_()] + [pa.int64()] * (len(NAMES) - 1)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and conversation; a node's digest takes its ids one at a time."""
    now, digest = None, None
    names = [*KEY, "ends_sha256"]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(4)], names)

    for b in batches:
        out = []
        for *key, c in zip(*[b[k].to_pylist() for k in (*KEY, "conv_id")]):
            if key == now:
                digest.update(b",%d" % c)
            else:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(b"%d" % c)
        yield batch(out)
    if now is not None:
        yield batch([(*now, digest.hexdigest())])


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch, rule: Trie = Trie()) -> DataFrame:
    """A row for each different beginning of a conversation, of turns (conv_id, depth, a, b, w) and
    conversations (conv_id), which may have no turns: the digest columns of op13, and `x1`, `x2`, which tell
    nodes of a depth apart.

    A node is its depth and the xor of its turns' hashes, each salted with its depth, twice 64 bits; so
    its parent's name takes one more xor, and no path is ever gathered. Nodes of many conversations
    are the crown, at each depth a few for each shard, and every conversation shows where its path
    leaves the crown. The subtrees below are dealt into shards, whose nodes are sorted by reverse
    level order outside memory; totals travel to parents through a queue that spills. What shards send
    to the crown is summed by Spark, and the crown is walked through last, in one task. A path is
    never split, so a single conversation of very many turns is one task's, in bounded memory.

    Equal rows are turns of their own, ordered side by side; turns of one number are ordered by
    their hashes; null turns come first. No conversations give no rows.
    """
    spark = turns.sparkSession
    small_batches(spark)
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = turns.withColumns({"p1": F.xxhash64("depth", "a", "b"), "p2": F.xxhash64("b", F.lit(1), "depth", "a")}).select("conv_id", "depth", "w", "p1", "p2")
    up = {"x1": F.col("p1_run"), "x2": F.col("p2_run"), "u1": F.col("p1_run").bitwiseXOR(F.col("p1")), "u2": F.col("p2_run").bitwiseXOR(F.col("p2"))}
    rows = scratch.save(_along(scratch, salted, ["depth"], ["p1", "p2"]).withColumns(up).select("conv_id", "depth", "x1", "x2", "u1", "u2", "w"))
    attributes = ["conv_id", *KEY, "u1", "u2", "n_convs", "w"]
    zero = F.lit(0).cast("long")
    found = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.count("*").alias("n_convs"), F.min("w").alias("w"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").withColumns({k: zero for k in (*KEY, "u1", "u2", "w")})
    nodes = scratch.save(found.select(*attributes).unionByName(top.select(*attributes)))
    most = max(rule.members, convs.count() // (8 * shards))
    in_crown = (F.col("n_convs") > most) | (F.col("depth") == 0)
    crown = scratch.save(nodes.where(in_crown))

    met = rows.join(crown.select(*KEY, F.lit(True).alias("in")), KEY, "left").where("in is null")
    shard = met.groupBy("conv_id").agg(F.min(F.struct(*KEY)).alias("r")).select("conv_id", F.col("r.x1").alias("r1"), F.col("r.x2").alias("r2"))
    none = {k: zero for k in ("n_children", "n_leaves", "saved_tokens")}
    below = nodes.where(~in_crown).join(shard, "conv_id").withColumns(none)
    levels = [F.desc("depth"), "x1", "x2"]
    below = scratch.save(below.repartition(shards, "r1", "r2").sortWithinPartitions(*levels).select(*attributes, *none).mapInArrow(_forward(rule.queue), NODE))
    sent = below.where("outside").groupBy(*KEY).agg(*[F.sum(k).alias(k) for k in none])
    crown = crown.join(sent, KEY, "left").fillna(0, list(none)).repartition(1).sortWithinPartitions(*levels)
    crown = crown.select(*attributes, *none).mapInArrow(_forward(rule.queue), NODE)
    totals = below.where("not outside").unionByName(crown)

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    last = convs.join(rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("l")), "conv_id", "left")
    last = last.select(*[F.coalesce(F.col(f"l.{k}"), zero).alias(k) for k in KEY], "conv_id")
    ends = last.repartition(shards, *KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(_ends, "depth long, x1 long, x2 long, ends_sha256 string")
    out = totals.join(parents, ["depth", "u1", "u2"], "left").join(ends, KEY, "left")
    nobody = F.sha2(F.lit(""), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"), "x1", "x2")


def conversation_trie(conversations: DataFrame, rule: Trie = Trie()) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text; other columns are not read)."""
    scratch = Scratch(conversations.sparkSession)
    return prefix_trie(*rebuilt(scratch, turns_of(conversations), rule), scratch, rule)


def report(trie: DataFrame) -> DataFrame:
    """The digest columns of op13."""
    return trie.drop("x1", "x2")
