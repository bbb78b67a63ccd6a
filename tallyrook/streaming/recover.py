"""Recovery: follow transcripts, keep what is new, append, and only then move the cursor."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.scratch import Scratch
from ..operators.budget import within_budget
from ..functions.schema import fields_of, let, parsed, verdict
from ..functions.text import free_name
from ..operators.filters import LINE, accepted, in_scope, judge_lines, quarantined, to_events
from ..operators.matching import correlate, first_per_id, new_events, void_aliases
from ..policy import EVENT_FIELDS, Policy
from ..sources.adapters import Adapter, event_at
from ..sources.files import alert, append_store, read_pending
from ..sources.tail import TailSource, authenticated, cursors, listed, read_ranges
from .state import BACKUPS, Lease, State, Superseded, read_or_empty
from .store import Store

EVENT_SCHEMA = "event_id string, tool string, session_id string, ts timestamp, prompt string, identity string, repo string, branch string, commit string"
STORE_SCHEMA = f"{EVENT_SCHEMA}, origin string"


@dataclass(frozen=True)
class Recovery:
    """What a pass goes by. root: the repository's folder, below which a line's cwd must lie; without
    it all lines are in scope. nested: repositories below it that are not it. repo: the project's
    fixed identity. device: the identity of events that have none. adapters: of clients whose transcripts have
    a shape of their own."""

    root: str | None = None
    nested: tuple[str, ...] = ()
    repo: str = "local"
    device: str = "device"
    policy: Policy = field(default_factory=Policy)
    adapters: tuple[Adapter, ...] = ()


def decoded(lines: DataFrame, policy: Policy, adapters: tuple[Adapter, ...] = ()) -> DataFrame:
    """lines with `reason` and, where that is ok, the fields of a line in the place of raw. A line of another role
    than user is `other`: neither event nor evidence. Files of an adapter are read by it, all others
    by the strict contract."""

    def strict(v: Column) -> Column:
        role = F.try_variant_get(v, "$.role", "variant")
        others = (F.schema_of_variant(role) == "STRING") & (F.try_variant_get(role, "$", "string") != "user")
        reason = let(verdict(v, LINE), lambda r: F.when(others & (r != "malformed"), "other").otherwise(r))
        return let(reason, lambda r: F.struct(r.alias("reason"), *[F.when(r == "ok", c).alias(f.name) for f, c in zip(LINE.fields, fields_of(v, LINE))]))

    told = free_name(lines, "_told")
    read = let(parsed(F.col("raw"), policy.line_bytes), lambda v: event_at(F.col("path"), v, adapters, strict(v)))
    big = F.coalesce(F.col("n_bytes") > policy.line_bytes, F.lit(False)) if "n_bytes" in lines.columns else F.lit(False)
    big |= F.coalesce(F.octet_length("raw") > policy.line_bytes, F.lit(False))
    reason = F.when(big, "oversize").when(F.col("raw").isNull(), "malformed").otherwise(F.col(f"{told}.reason"))
    rest = [c for c in lines.columns if c != "raw"]
    return lines.withColumn(told, read).select(*rest, reason.alias("reason"), *[F.col(f"{told}.{f.name}") for f in LINE.fields])


def append_evidence(bad: DataFrame, path: str) -> None:
    """Appends what is not there yet: where, how long, digest and reason. A line that is null has no digest, and is told by its place."""
    old = read_or_empty(bad.sparkSession, path, "path string, line_no long, n_bytes long, sha256 string, reason string")
    new_events(bad, old, ("path", "line_no", "sha256")).select("path", "line_no", "n_bytes", "sha256", "reason").write.mode("append").parquet(path)


class Stopped(RuntimeError):
    """The watchdog has ended the run."""


class WriteFailed(RuntimeError):
    """The store or the state could not be written; the cause says why."""


@contextlib.contextmanager
def writing() -> Iterator[None]:
    """Tells failures to write from all others."""
    try:
        yield
    except (Superseded, WriteFailed):
        raise
    except Exception as e:
        raise WriteFailed("the store or the state could not be written") from e


class Watched:
    """Tables written to scratch whose counts are observed while they are written, so no job is run for them."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.seen = scratch, {}

    def save(self, name: str, df: DataFrame, **counts: Column) -> DataFrame:
        """df, written. name is counted by its rows, and each of counts by its own aggregate."""
        seen = Observation()
        saved = self.scratch.save(df.observe(seen, F.count(F.lit(1)).alias(name), *[c.alias(n) for n, c in counts.items()]))
        self.seen |= {n: v or 0 for n, v in seen.get.items()}
        return saved

    def __getitem__(self, name: str) -> int:
        return self.seen[name]


PLACE = ("path", "start", "offset", "end", "upto", "n_bytes", "sha256", "reason", "cwd")


def redacted(lines: DataFrame, policy: Policy, repo: str, device: str, adapters: tuple[Adapter, ...] = ()) -> DataFrame:
    """Judged lines with their place, and the accepted ones as redacted events. Raw lines go no further."""
    read = decoded(lines, policy, adapters)
    return to_events(read, repo, device, policy, keep=[c for c in PLACE if c in read.columns])


def taken_ranges(rows: DataFrame) -> DataFrame:
    """(path, start, end, sha256) up to the last of the rows of each piece that was read."""
    return rows.groupBy("path", "start").agg(F.max("end").alias("end"), F.max_by("upto", "end").alias("sha256"))


def indexed_store(spark: SparkSession, path: str, **layout) -> Store:
    """A store of events in buckets, that tells repeats by its filter (`streaming/store.py`)."""
    return Store(spark, path, STORE_SCHEMA, **layout)


def stored(spark: SparkSession, store: str | Store) -> DataFrame:
    return store.rows() if isinstance(store, Store) else read_or_empty(spark, store, STORE_SCHEMA)


def not_stored(events: DataFrame, store: str | Store, scratch: Scratch) -> DataFrame:
    return store.new(events, scratch=scratch) if isinstance(store, Store) else new_events(events, stored(events.sparkSession, store))


def put(events: DataFrame, store: str | Store, origin: str, writer: str | None = None, batch: int | None = None) -> None:
    """Appends events. A store in buckets leaves out repeats once more, and a batch that it has applied."""
    if isinstance(store, Store):
        store.append(events.withColumn("origin", F.lit(origin)), writer, batch)
    else:
        append_store(events, store, origin)


def store_files(spark: SparkSession, store: str | Store) -> DataFrame:
    """(path, length, modified) of the store's files; their content is not read."""
    folders, read = [store], spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    if isinstance(store, Store):
        folders, read = store.files(), read.option("basePath", f"{store.path}/rows")
    if not folders:
        return spark.createDataFrame([], BACKUPS)
    try:
        found = read.load(folders)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BACKUPS)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def prefix_lost(before: DataFrame, now: DataFrame) -> bool:
    """Whether some file that repeats were told by is gone, or is not what it was."""
    return not before.join(now, ["path", "length", "modified"], "left_anti").isEmpty()


def recover_pass(
    spark: SparkSession, pattern: str, store: str | Store, quarantine: str, state: State, rules: Recovery = Recovery(), health: str | None = None,
    lease: Lease | None = None, going: Callable[[], None] = lambda: None, trusted: bool = False,
) -> dict:
    """One pass: what it appended, deferred and refused, as counts.

    Each file goes on behind what was taken of it, if all of that still has its digest, for which tasks read
    it once; else it is read again from the start. trusted: this run has just done so, and only sizes and
    identities are looked at. Lines of people in this repository become redacted events; what the
    store has under the same id (J1), what a direct capture answers for one to one (J3) and known
    aliases (J5) are left out before the budget is spent, so repeats cannot starve later events. After
    the append the cursor of each file moves to its first line that is deferred, for want of a folder
    or of budget, provided that the store's files by which repeats were told are still what they were, and
    that the lease holds. A crash before that repeats the pass, which then finds the ids in the store.
    going is called between steps, and raises if the run must end.
    """
    policy, scratch = rules.policy, Scratch(spark)
    watched = Watched(scratch)
    known, aliases, backups = state.read()
    durable_files = scratch.save(store_files(spark, store))
    forget = prefix_lost(backups, durable_files)  # the store was cut or replaced: all is scanned again
    known = scratch.save(known.limit(0) if forget else known)
    checked = known.select("path", "start", "end", "sha256", F.lit(0).cast("long").alias("n_bytes"), F.lit(True).alias("ok")) if trusted else authenticated(known)
    checked = watched.save("ranges", checked, authenticated=F.sum("n_bytes"))
    going()
    files = spark.createDataFrame([(p, f["size"]) for p, f in listed(pattern).items()], "path string, size long")
    at = cursors(checked)
    cut = at.join(files, "path", "left").where(F.col("size").isNull() | (F.col("size") < F.col("offset")))
    lost = watched.save("rescanned", checked.where("not ok").select("path").union(cut.select("path")).distinct())
    sound = checked.join(lost, "path", "left_anti")
    todo = files.join(cursors(sound), "path", "left").select("path", F.coalesce("offset", F.lit(0)).cast("long").alias("start"), F.col("size").alias("end"))
    # raw lines are not stored, not even here
    read = redacted(read_ranges(scratch.save(todo), policy.line_bytes), policy, rules.repo, rules.device, rules.adapters)
    rows = watched.save("lines", read, refused=F.count_if(~F.col("reason").isin("ok", "other")), partial=F.count_if(F.col("reason").isin("malformed", "oversize")))
    going()
    append_evidence(rows.where("reason not in ('ok', 'other')").select("path", F.col("offset").alias("line_no"), "n_bytes", "sha256", "reason"), quarantine)

    events = rows.where("reason = 'ok'")
    deferred = events.limit(0)
    if rules.root is not None:
        events, deferred = in_scope(events, rules.root, spark.createDataFrame([(r,) for r in rules.nested], "root string"))
    durable = stored(spark, store)
    deferred = not_stored(deferred, store, scratch)
    void = watched.save("voided", void_aliases(aliases, events.select("tool", "event_id")))
    aliases = scratch.save(aliases.join(void, ["tool", "old_id"], "left_anti"))
    first = first_per_id(events, order=[F.col("ts").asc_nulls_last(), F.col("path"), F.col("offset")])
    fresh = not_stored(first, store, scratch)
    fresh = scratch.save(fresh.join(aliases.select("tool", F.col("old_id").alias("event_id")), ["tool", "event_id"], "left_anti"))
    free = durable.where("origin = 'direct'").join(aliases.select("tool", "event_id"), ["tool", "event_id"], "left_anti")
    free = free.join(events.select("tool", "event_id"), ["tool", "event_id"], "left_anti")  # those answer for themselves
    side = lambda df: df.select("tool", "session_id", "ts", F.sha2("prompt", 256).alias("text"), F.struct("tool", "event_id").alias("id"))
    going()
    pairs = scratch.save(correlate(side(free), side(fresh), ["tool", "session_id", "text"], policy.correlation_minutes * 60_000_000))
    met = pairs.select("recovered_id.tool", F.col("recovered_id.event_id").alias("old_id"), F.col("direct_id.event_id").alias("event_id"))
    wanted = fresh.join(met.select("tool", F.col("old_id").alias("event_id")), ["tool", "event_id"], "left_anti")
    taken = watched.save("appended", within_budget(wanted, ["path", "offset"], policy), truncated=F.count_if("truncated"))
    going()
    if lease and not lease.holds():
        raise Superseded("the lease is over")
    with writing():
        put(taken.select(*EVENT_FIELDS), store, "recovered")

    waiting = watched.save("deferred", wanted.join(taken.select("tool", "event_id"), ["tool", "event_id"], "left_anti").select("path", "offset").unionByName(deferred.select("path", "offset")))
    stop = waiting.groupBy("path").agg(F.min("offset").alias("stop"))
    done = rows.join(stop, "path", "left").where(F.col("stop").isNull() | (F.col("offset") < F.col("stop")))
    new = taken_ranges(done)
    held = sound.select("path", "start", "end", "sha256")
    # an alias whose event came back under its own id voids what was scanned
    again = watched["voided"] > 0
    ranges = scratch.save((new if again else held.unionByName(new)).select("path", "start", "end", "sha256").where(F.lit(not again)))
    going()
    after = store_files(spark, store)
    moved = prefix_lost(durable_files, after)
    if not moved:
        with writing():
            state.write(ranges, aliases.unionByName(met.select("tool", "old_id", "event_id")), after, lease)
    out = {n: watched[n] for n in ("appended", "deferred", "refused", "truncated", "rescanned", "authenticated")} | {"voided": int(again), "backup_moved": int(forget or moved)}
    if health:
        codes = {"PARTIAL_TRANSCRIPT": watched["partial"], "QUARANTINED": out["refused"], "PROMPT_TRUNCATED": out["truncated"], "RESCANNED": out["rescanned"], "ALIAS_VOIDED": out["voided"], "BACKUP_CHANGED": out["backup_moved"]}
        alert(spark, health, *(c for c, n in codes.items() if n))
    scratch.end()
    return out


def merge_queue(spark: SparkSession, pending: str, store: str | Store, quarantine: str, rules: Recovery = Recovery()) -> int:
    """Appends what captures have left in the queue while the store was busy, one event in a file, as direct
    captures, redacted; those whose id the store has are left out, so it may be asked again. What is refused
    is evidence. The files stay for who owns the queue to remove. The number of events appended."""
    policy, scratch = rules.policy, Scratch(spark)
    try:
        lines = read_pending(spark, pending)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    judged = judge_lines(lines, policy)
    append_evidence(quarantined(judged).withColumn("line_no", F.lit(0).cast("long")), quarantine)
    events = to_events(accepted(judged), rules.repo, rules.device, policy, keep=["path"])
    fresh = not_stored(first_per_id(events, order=[F.col("ts").asc_nulls_last(), F.col("path")]), store, scratch)
    fresh = scratch.save(fresh.select(*EVENT_FIELDS))
    with writing():
        put(fresh, store, "direct")
    n = fresh.count()
    scratch.end()
    return n


def recover(
    spark: SparkSession, pattern: str, store: str | Store, quarantine: str, checkpoint: str, rules: Recovery = Recovery(), health: str | None = None, timeout: int = 300, throttled: bool = False,
    pending: str | None = None,
) -> bool:
    """Passes until nothing new is appended; True if they ended within the timeout (the watchdog).

    checkpoint holds the state, and leases that admit one run at a time. throttled: leaves at once
    if the last pass is younger than policy.recovery_minutes, as for a scheduler that asks often. pending:
    the queue's folder, which is merged first. health: where codes go; beside those of a pass, LOCKED if another run holds
    the lease or took it over, TIMEOUT if the watchdog ended the run, WRITE_FAILED if the store or the state could not be
    written, and RECOVERY_FAILED for all else that ended it.
    """
    state, code = State(spark, checkpoint), None
    age = state.age()
    if throttled and age is not None and age < 60 * rules.policy.recovery_minutes:
        return True
    lease = state.lease(timeout)
    if lease is None:
        if health:
            alert(spark, health, "LOCKED")
        return False
    group, stopped = f"recover-{uuid.uuid4().hex}", threading.Event()
    spark.sparkContext.setJobGroup(group, "recovery", interruptOnCancel=True)

    def stop() -> None:
        stopped.set()
        spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)

    def going() -> None:
        if stopped.is_set():
            raise Stopped

    watchdog = threading.Timer(timeout, stop)
    watchdog.daemon = True
    watchdog.start()
    try:
        if pending:
            merge_queue(spark, pending, store, quarantine, rules)
        more = first = True
        while more:
            going()
            done = recover_pass(spark, pattern, store, quarantine, state, rules, health, lease, going, trusted=not first)
            more, first = bool(done["appended"] or done["voided"]) and not done["backup_moved"], False
    except Superseded:
        code = "LOCKED"
        return False
    except Exception as e:
        if not stopped.is_set():
            code = "WRITE_FAILED" if isinstance(e, WriteFailed) else "RECOVERY_FAILED"
            raise
    finally:
        watchdog.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        lease.release()
        code = "TIMEOUT" if stopped.is_set() else code
        if health and code:
            with contextlib.suppress(Exception):  # what ended the run matters more, and a full disk takes no code
                alert(spark, health, code)
    return not stopped.is_set()


def append_batch(
    store: str | Store, quarantine: str, prepare: Callable[[DataFrame], DataFrame] | None = None, policy: Policy = Policy(), checkpoint: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step over the tail source. A batch that runs again after a crash appends nothing
    twice, since it leaves out ids that the store holds. Events are redacted, unless prepare does otherwise
    to the judged and decoded lines.

    checkpoint: where the digests of what was taken are kept. Files that a batch has lines of are
    authenticated then, and one that was rewritten meanwhile is read again from its start.
    """

    def read(lines: DataFrame) -> DataFrame:
        return prepare(decoded(lines, policy)) if prepare else redacted(lines, policy, "local", "device")

    def step(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        scratch = Scratch(spark)
        rows = scratch.save(read(lines))
        state = State(spark, checkpoint) if checkpoint else None
        if state:
            known, aliases, _backups = state.read()
            met = rows.groupBy("path").agg(F.min("start").alias("from"), F.max("end").alias("end"))
            # what a batch reads from the start again replaces what was known of a file
            old = known.join(met.where("from > 0"), "path", "left_semi")
            checked = scratch.save(authenticated(old))
            broken = scratch.save(checked.where("not ok").select("path").distinct())
            again = met.join(broken, "path").select("path", F.lit(0).cast("long").alias("start"), "end")
            if not again.isEmpty():
                whole = read(read_ranges(scratch.save(again), policy.line_bytes))
                rows = scratch.save(rows.join(broken, "path", "left_anti").unionByName(whole.select(*rows.columns)))
        bad = rows.where("reason not in ('ok', 'other')").select("path", F.col("offset").alias("line_no"), "n_bytes", "sha256", "reason")
        events = rows.where("reason = 'ok'").select(*EVENT_FIELDS)
        append_evidence(bad, quarantine)
        put(not_stored(first_per_id(events), store, scratch), store, "recovered", *((checkpoint, batch) if checkpoint else ()))
        if state:
            rest = known.join(met, "path", "left_anti").select("path", "start", "end", "sha256")
            held = checked.join(broken, "path", "left_anti").select("path", "start", "end", "sha256")
            state.write(scratch.save(rest.unionByName(held).unionByName(taken_ranges(rows)).distinct()), aliases)
        scratch.end()

    return step


def follow(spark: SparkSession, pattern: str, store: str | Store, quarantine: str, checkpoint: str, policy: Policy = Policy(), every: Sequence[str] | None = None):
    """A streaming query that appends what files gain, every policy.recovery_minutes, or once over all
    that is there if every is empty. It goes by ids alone, and reads files again
    that were rewritten; recover() correlates, defers and keeps a budget."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("path", pattern).option("lineBytes", policy.line_bytes).load()
    trigger = {"processingTime": f"{policy.recovery_minutes} minutes"} if every is None else {"availableNow": True}
    return lines.writeStream.foreachBatch(append_batch(store, quarantine, policy=policy, checkpoint=f"{checkpoint}/taken")).option("checkpointLocation", checkpoint).trigger(**trigger).start()
