"""A store of events in hash buckets, with a filter of its ids and commits that readers see whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..functions.text import free_name
from ..operators.matching import first_per_id
from .state import Folder, Superseded

#: Bits of a block, as Spark's bitmap functions have it: a bitmap of 4096 bytes.
BLOCK_BITS = 32_768
FILTER = "block long, bits binary"


@dataclass(frozen=True)
class Layout:
    """How a store is dealt. buckets: folders of a commit, by a hash of the id. blocks: bitmaps of the filter of
    ids; one holds some 3000 ids at a chance of 1 in 170 that an unknown one passes. probes: bits that an id sets
    in its block. A block is wholly of one bucket. keys: what an id is made of."""

    keys: tuple[str, ...] = ("tool", "event_id")
    buckets: int = 64
    blocks: int = 4096
    probes: int = 6

    def __post_init__(self) -> None:
        if not self.keys or self.buckets < 1 or self.blocks < self.buckets or self.probes < 1:
            raise ValueError("a layout needs keys, buckets, at least as many blocks, and probes")

    def block(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.blocks))

    def bucket(self, block: Column) -> Column:
        return F.pmod(block, F.lit(self.buckets)).cast("int")

    def bits(self) -> Column:
        """The places in a block that an id sets. A null is a value of its own by its place among the keys."""
        parts = [c for k in self.keys for c in (F.col(k), F.col(k).isNull())]
        return F.transform(F.sequence(F.lit(1), F.lit(self.probes)), lambda i: F.pmod(F.xxhash64(i, *parts), F.lit(BLOCK_BITS)))


def filter_of(rows: DataFrame, layout: Layout) -> DataFrame:
    """(block, bits): the bitmaps of the ids of rows. Each task makes its own, of which only bitmaps are shuffled."""
    return rows.select(layout.block().alias("block"), F.explode(layout.bits()).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


@dataclass(frozen=True)
class Manifest:
    """What a version of the store holds: parts, the last batch that each writer applied, and each cursor table."""

    version: int
    layout: Layout
    parts: tuple[str, ...]
    applied: dict[str, int]
    cursors: dict[str, str]


class Store(Folder):
    """Events that were appended once, and stay.

    A commit writes its rows, a filter of their ids and, if it has any, the cursors, each into folders that
    nothing names yet, and then creates one small file, versions/v=N, that names all parts. Readers go by
    that file, so that rows and cursors appear together, and what a crash leaves behind is never
    read. Of two commits upon one version one fails, looks again which ids are new, and tries once more.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, layout: Layout = Layout()):
        super().__init__(spark, path)
        self.schema, self.fresh_layout = schema, layout

    def manifest(self) -> Manifest:
        """The last version that is whole; the layout of an older store is its own."""
        for v in reversed(self.versions()):
            try:
                found = json.loads(self.text(f"versions/v={v}"))
                layout = Layout(**found["layout"] | {"keys": tuple(found["layout"]["keys"])})
                return Manifest(v, layout, tuple(found["parts"]), found["applied"], found["cursors"])
            except (ValueError, KeyError, TypeError):
                continue  # its writer died within the file
        return Manifest(0, self.fresh_layout, (), {}, {})

    def _table(self, kind: str, parts: Sequence[str], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/part={p}" for p in parts])

    def rows(self, at: Manifest | None = None) -> DataFrame:
        """The events of a version."""
        return self._buckets((at or self.manifest())).drop("bucket")

    def _buckets(self, at: Manifest, hit: Sequence[int] | None = None) -> DataFrame:
        rows = self._table("rows", at.parts, f"{self.schema}, bucket int")
        return rows if hit is None else rows.where(F.col("bucket").isin(list(hit)))

    def cursors(self, writer: str, schema: str, at: Manifest | None = None) -> DataFrame:
        """What the writer's last commit said of how far it has come."""
        name = (at or self.manifest()).cursors.get(writer)
        return self.spark.read.schema(schema).parquet(f"{self.path}/cursors/{name}") if name else self.spark.createDataFrame([], schema)

    def files(self, at: Manifest | None = None) -> list[str]:
        """The folders that a version's rows are in."""
        return [f"{self.path}/rows/part={p}" for p in (at or self.manifest()).parts]

    def new(self, events: DataFrame, at: Manifest | None = None, scratch: Scratch | None = None) -> DataFrame:
        """Events whose id the store does not have; repeated ids stay repeated. A null equals a null. scratch holds
        the judged events until it ends.

        The filter tells most new ids by itself. Only buckets into which some other id falls are read, of these
        only the ids, and an exact join decides. The filter is a table like any other, so it may be of any size.
        """
        at = at or self.manifest()
        if not at.parts:
            return events
        layout, scratch = at.layout, scratch or Scratch(self.spark)
        block, maybe = free_name(events, "_block"), free_name(events, "_maybe")
        bitmaps = self._table("filters", at.parts, FILTER).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
        known = bitmaps.select(F.col("block").alias(block), F.col("bits").alias(maybe))
        placed = events.withColumn(block, layout.block()).join(known, block, "left")
        passes = F.coalesce(F.forall(layout.bits(), lambda i: _is_set(F.col(maybe), i)), F.lit(False))
        told = scratch.save(placed.withColumn(maybe, passes))
        # at most as many rows as there are buckets
        hit = sorted(r[0] for r in told.where(maybe).select(layout.bucket(F.col(block))).distinct().collect())
        clear = told.where(~F.col(maybe))
        if not hit:
            return clear.select(*events.columns)
        own = self._buckets(at, hit).select(*[F.col(k).alias(f"_known{i}") for i, k in enumerate(layout.keys)], F.col("bucket").alias("_known"))
        asked = told.where(maybe)
        same = layout.bucket(F.col(block)) == own["_known"]
        for i, k in enumerate(layout.keys):
            same &= asked[k].eqNullSafe(own[f"_known{i}"])
        return clear.unionByName(asked.join(own, same, "left_anti")).select(*events.columns)

    def _write(self, rows: DataFrame, layout: Layout) -> str:
        part = uuid.uuid4().hex
        block = free_name(rows, "_block")
        dealt = rows.withColumn(block, layout.block()).withColumn("bucket", layout.bucket(F.col(block)))
        dealt.drop(block).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/part={part}")
        # a part without rows still has a filter, an empty one
        filter_of(rows, layout).write.parquet(f"{self.path}/filters/part={part}")
        return part

    def _commit(self, base: Manifest, to: Manifest) -> None:
        layout = {"keys": list(to.layout.keys), "buckets": to.layout.buckets, "blocks": to.layout.blocks, "probes": to.layout.probes}
        text = json.dumps({"layout": layout, "parts": list(to.parts), "applied": to.applied, "cursors": to.cursors})
        if not self.create(f"versions/v={base.version + 1}", text):
            raise Superseded(f"version {base.version + 1} was written by another run")

    def _discard(self, part: str | None, cursors: str | None = None) -> None:
        for kind, name in (("rows", f"part={part}"), ("filters", f"part={part}"), ("cursors", cursors)):
            if part and name:
                self.fs.delete(self._at(f"{kind}/{name}"), True)

    def append(self, events: DataFrame, writer: str | None = None, batch: int | None = None, cursors: DataFrame | None = None, tries: int = 5) -> int:
        """Appends the first of each id that is not there yet, and sets the writer's cursors, in one commit.
        A batch of a writer that was applied before changes nothing. How many events were appended."""
        if batch is not None and writer is None or cursors is not None and writer is None:
            raise ValueError("a batch and cursors belong to a writer")
        scratch = Scratch(self.spark)
        wanted = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        for last in range(tries, 0, -1):
            base = self.manifest()
            if batch is not None and base.applied.get(writer, -1) >= batch:
                return 0
            fresh = scratch.save(first_per_id(self.new(events, base, scratch), base.layout.keys, [F.xxhash64(*wanted)]).select(*wanted))
            n = fresh.count()
            if not n and batch is None and cursors is None:
                return 0
            part = self._write(fresh, base.layout) if n else None
            name = None
            if cursors is not None:
                name = uuid.uuid4().hex
                cursors.write.parquet(f"{self.path}/cursors/{name}")
            applied = base.applied | ({writer: batch} if batch is not None else {})
            set_to = base.cursors | ({writer: name} if name else {})
            try:
                self._commit(base, replace(base, parts=base.parts + ((part,) if part else ()), applied=applied, cursors=set_to))
                scratch.end()
                return n
            except Superseded:
                self._discard(part or "none", name)
                if last == 1:
                    raise
        raise ValueError("tries must be positive")

    def compact(self, blocks: int | None = None) -> int:
        """Writes all parts as one, with a filter of so many blocks, by default one for 3000 ids and never fewer
        than now. A commit meanwhile makes it fail, and nothing is lost. The number of events."""
        base = self.manifest()
        rows = self.rows(base)
        n = rows.count()
        layout = replace(base.layout, blocks=blocks or max(base.layout.blocks, -(-n // 3000)))
        part = self._write(rows, layout)
        try:
            self._commit(base, replace(base, layout=layout, parts=(part,)))
        except Superseded:
            self._discard(part)
            raise
        return n

    def clean(self, seconds: float) -> int:
        """Removes versions but the last, and folders that it does not name and that are older than this, which crashes and
        compaction leave; commits and readers that took longer would lose theirs. How many folders went."""
        now, gone = self.manifest(), 0
        live = {("rows", f"part={p}") for p in now.parts} | {("filters", f"part={p}") for p in now.parts} | {("cursors", c) for c in now.cursors.values()}
        for kind in ("rows", "filters", "cursors"):
            for name in self.names(kind):
                if (kind, name) not in live and self.seconds_old(f"{kind}/{name}") > seconds:
                    self.fs.delete(self._at(f"{kind}/{name}"), True)
                    gone += 1
        for v in self.versions():
            if v < now.version and self.seconds_old(f"versions/v={v}") > seconds:
                self.fs.delete(self._at(f"versions/v={v}"), False)
        return gone


def sink(store: Store, writer: str, cursors: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that appends each batch once, however often it runs: the batch's number is in
    the commit. cursors(batch) gives rows that say how far the writer has come."""

    def step(events: DataFrame, batch: int) -> None:
        kept = Scratch(events.sparkSession)
        stored = kept.save(events)
        store.append(stored, writer, batch, cursors(stored) if cursors else None)
        kept.end()

    return step
