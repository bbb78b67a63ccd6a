"""Named queries over the driver's tables, with the SQL that must agree.

The tables are not prompt logs. Each query applies an operator to a stand-in: events are captured
prompts (event_type the tool, user_id the session), conversations are transcripts, documents
are texts to redact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.scratch import Scratch
from ..functions.schema import Contract, Field, strings
from ..operators import budget, filters, matching, reports
from ..policy import EVENT_FIELDS, Policy
from ..sources.adapters import Adapter, Place
from ..streaming import capture
from ..streaming.recover import decoded
from ..streaming.store import Layout, Store

#: 2024-01-31, the day after the last event; the clock of all queries.
NOW = "timestamp_ntz'2024-01-31 00:00:00'"
#: The driver's events are sparse; ten minutes, the default, would match a handful.
WIDE = 6 * 3600 * 1_000_000
RULES = ((r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["']?)[A-Za-z0-9+/_.=-]{6,}""", "$1[REDACTED]"), (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even ids as direct captures, odd ones as recovered."""
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


def status_by_tool(spark, sf_dir):
    """A1."""
    return reports.status(_events(spark, sf_dir), tool="event_type")


def silent_tools(spark, sf_dir):
    """A2: a tool is silent if its last event is a minute older than the newest."""
    return reports.silent(reports.status(_events(spark, sf_dir), tool="event_type"), F.expr("interval 1 minute")).select("tool", "n", "silent")


def human_prompts(spark, sf_dir):
    """F4, P1."""
    return filters.human(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("text").alias("prompt"))


def _injected(spark, sf_dir):
    extra = F.regexp_replace("props", r"\}$", ', "response": "x"}')
    return _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 7 == 0, extra).otherwise(F.col("props")).alias("raw"))


def strict_keys(spark, sf_dir):
    """Every seventh row has a field that the schema does not know."""
    return filters.judge_lines(_injected(spark, sf_dir), contract=Contract((Field("k", "long", needed=True),))).where("reason = 'ok'").select("event_id")


def quarantine_digest(spark, sf_dir):
    """K4, X1."""
    bad = filters.judge_lines(_injected(spark, sf_dir), contract=Contract((Field("k", "long"),))).withColumn("line_no", F.col("event_id"))
    return filters.quarantined(bad)


def redact_text(spark, sf_dir):
    """P2, X5."""
    return _t(spark, sf_dir, "documents").select("doc_id", fx.redact(F.col("text"), RULES).alias("text"))


def exact_text_dedup(spark, sf_dir):
    """The first document of each text."""
    return _t(spark, sf_dir, "documents").groupBy(fx.digest(F.col("text")).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def known_id_anti(spark, sf_dir):
    """Events whose id is not among the even ones that are durable."""
    e = _events(spark, sf_dir)
    return matching.new_events(e, e.where("event_id % 2 = 0"), ["event_id"]).select("event_id", "event_type")


def indexed_new_ids(spark, sf_dir):
    """Documents whose source and id are not in a store of buckets, to which the even ones are committed."""
    d = _t(spark, sf_dir, "documents").select("source", "doc_id")
    store = Store(spark, f"{Scratch(spark).base}/store", "source string, doc_id long", Layout(("source", "doc_id")))
    store.append(d.where("doc_id % 2 = 0"))
    return store.new(d)


def correlate_candidates(spark, sf_dir):
    """J3, first half."""
    return matching.candidates(*_sides(spark, sf_dir), ["event_type", "user_id"], WIDE)


def correlate_one_to_one(spark, sf_dir):
    """J3."""
    return matching.correlate(*_sides(spark, sf_dir), ["event_type", "user_id"], WIDE)


def unmatched_recovered(spark, sf_dir):
    """J4 after J3."""
    direct, recovered = _sides(spark, sf_dir)
    return matching.unmatched(recovered, matching.correlate(direct, recovered, ["event_type", "user_id"], WIDE)).select("id")


def alias_bijection(spark, sf_dir):
    """Odd documents as old ids, even ones as events, matched by text."""
    d = _t(spark, sf_dir, "documents").select("doc_id", fx.digest(F.col("text")).alias("h"))
    return matching.aliases(d.where("doc_id % 2 = 1").select("h", F.col("doc_id").alias("old_id")), d.where("doc_id % 2 = 0").select("h", F.col("doc_id").alias("event_id")), "h")


def alias_void(spark, sf_dir):
    """Aliases whose event is divisible by 4 come back as exact."""
    exact = _t(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("event_id"))
    return matching.void_aliases(alias_bijection(spark, sf_dir), exact)


def manifest_equality(spark, sf_dir):
    """Nation as the manifest, against a copy that lacks, adds and changes a row."""
    m = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    found = m.where("path <> 'NATION_3'").withColumn("sha256", F.when(F.col("path").endswith("5"), "0").otherwise(F.col("sha256")))
    extra = _t(spark, sf_dir, "region").select(F.col("r_name").alias("path"), F.sha2("r_name", 256).alias("sha256"))
    return matching.compare(m, found.unionByName(extra), "path", "sha256")


def manifest_rows(spark, sf_dir):
    """Rows of nation and of a copy with other region keys, both ways."""
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return matching.set_difference(n, n.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 5 == 0, 9).otherwise(F.col("n_regionkey")).cast("int")))


def batch_budget(spark, sf_dir):
    """At most 100 prompts or 20 000 bytes."""
    c = filters.human(_t(spark, sf_dir, "conversations"))
    return budget.within_budget(c, ["conv_id", "turn"], Policy(batch_rows=100, batch_bytes=20_000), "text").select("conv_id", "turn")


def batch_cursor(spark, sf_dir):
    """L1: where each conversation goes on after batch_budget."""
    c = filters.human(_t(spark, sf_dir, "conversations"))
    taken = budget.within_budget(c, ["conv_id", "turn"], Policy(batch_rows=100, batch_bytes=20_000), "text")
    return budget.cursor(c, taken, ["conv_id", "turn"], "conv_id", "turn")


def reserve_then_budget(spark, sf_dir):
    """Known conversations do not use up the budget."""
    c = filters.human(_t(spark, sf_dir, "conversations"))
    return budget.reserved_budget(c, [c.where("conv_id % 2 = 0")], ["conv_id", "turn"], ["conv_id", "turn"], Policy(batch_rows=50, batch_bytes=20_000), "text").select("conv_id", "turn")


def retention(spark, sf_dir):
    """15 days."""
    return filters.retained(_events(spark, sf_dir), F.expr(NOW), Policy(retention_days=15)).select("event_id", "ts")


def pending_merge(spark, sf_dir):
    """A backup of ids not divisible by 3, and a queue of even ones, twice."""
    e = _events(spark, sf_dir).select("event_id", "event_type", "ts")
    pending = e.where("event_id % 2 = 0")
    return matching.merge_pending(e.where("event_id % 3 <> 0"), pending.unionByName(pending), ["event_id"]).drop("ts")


def _days(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"), "event_type")


def sessions_without_prompts(spark, sf_dir):
    """A3: user-days without a click."""
    d = _days(spark, sf_dir)
    return d.select("user_id", "day").distinct().join(d.where("event_type = 'click'").select("user_id", "day"), ["user_id", "day"], "left_anti")


def quiet_session_runs(spark, sf_dir):
    """A3: runs of a user's active days without a click."""
    d = _days(spark, sf_dir)
    return reports.quiet_runs(d.select("user_id", "day").distinct(), d.where("event_type = 'click'"), "user_id", "day")


def repeated_repairs(spark, sf_dir):
    """A4: two or more errors of a user in a day."""
    return reports.repeated(_days(spark, sf_dir).where("event_type = 'error'"), [F.col("user_id"), F.col("day")], 2)


def queue_age(spark, sf_dir):
    """A5: purchases as the queue."""
    return reports.queue_age(_events(spark, sf_dir).where("event_type = 'purchase'"), F.expr(NOW), F.expr("interval 7 days"))


def partial_sources(spark, sf_dir):
    """Sources with a text over 20 000 bytes."""
    d = _t(spark, sf_dir, "documents").select("source", F.when(F.octet_length("text") > 20_000, "oversize").otherwise("ok").alias("reason"))
    return filters.partial_sources(d, "source")


def version_floor(spark, sf_dir):
    """Versions made from ids."""
    v = F.concat_ws(".", (F.col("event_id") % 3).cast("string"), (F.col("event_id") % 140).cast("string"), F.concat((F.col("event_id") % 60).cast("string"), F.when(F.col("event_id") % 11 == 0, "-rc1").otherwise("")))
    e = _events(spark, sf_dir).select("event_id", F.lit("cli").alias("tool"), v.alias("version"))
    return filters.stable_clients(e, {"cli": "1.0.58"}).select("event_id", "version")


def health_rollup(spark, sf_dir):
    """A9."""
    return reports.health(_events(spark, sf_dir), "event_type")


def report_by_day(spark, sf_dir):
    """A8."""
    return reports.rollup(_events(spark, sf_dir).withColumnRenamed("user_id", "session_id"), "event_type")


def byte_truncate(spark, sf_dir):
    """1 000 bytes with a mark."""
    return _t(spark, sf_dir, "documents").select("doc_id", fx.truncate_bytes(F.col("text"), 1000, "[CUT]").alias("text"))


def prefix_digest(spark, sf_dir):
    """The digest of the first 64 bytes."""
    return _t(spark, sf_dir, "documents").select("doc_id", fx.prefix_digest(F.col("text"), 64).alias("sha256"))


def latest_per_session(spark, sf_dir):
    """A session's last event."""
    e = _events(spark, sf_dir)
    return matching.first_per_id(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


def repo_scope(spark, sf_dir):
    """urls' paths as folders, below /en but not below /en/9."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1), r"^(/en/)([0-9])", "$1$2/").alias("cwd"))
    nested = spark.createDataFrame([("/en/9",)], "root string")
    return filters.in_scope(p, "/en", nested)[0].select("page_id")


def canonical_scope(spark, sf_dir):
    """urls' paths as folders with detours, below /en/.. or not."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1).alias("path"))
    n = F.col("page_id")
    cwd = F.when(n % 5 == 0, F.concat(F.lit("/en/.."), "path")).when(n % 5 == 1, F.concat("path", F.lit("/../../x"))).when(n % 5 == 2, F.concat(F.lit("/./"), "path", F.lit("//.//"))).when(n % 5 == 3, F.concat(F.lit("en"), "path")).otherwise(F.col("path"))
    found = p.withColumn("cwd", cwd)
    return found.select("page_id", fx.canonical(F.col("cwd")).alias("folder"), fx.within(F.col("cwd"), F.lit("/en//./")).alias("inside"))


#: Events as three clients would write them: flat, below a message, and as a list of parts.
CLIENTS = (
    Adapter("one", "^/one/", "$.kind", ("user",), {"event_id": Place(("$.id",)), "session_id": Place(("$.session",)), "ts": Place(("$.at",)), "prompt": Place(("$.text",))}),
    Adapter("two", "^/two/", "$.type", ("user", "human"), {"event_id": Place(("$.uuid",)), "session_id": Place(("$.meta.sessionId",)), "ts": Place(("$.meta.timestamp",)), "prompt": Place(("$.message.content",))}),
    Adapter("three", "^/three/", "$.payload.type", ("message",), {"session_id": Place(("$.payload.session", "$.session")), "ts": Place(("$.timestamp",)), "prompt": Place(("$.payload.content",), kinds=("input_text",))}),
)


def adapted_events(spark, sf_dir):
    """events' props and types in the shapes of three clients become the same fields again."""
    e = _events(spark, sf_dir)
    q = lambda c: F.concat(F.lit('"'), c.cast("string") if not isinstance(c, str) else F.col(c).cast("string"), F.lit('"'))
    at, k = q(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.get_json_object("props", "$.k")
    who = F.when(F.col("event_type") == "error", F.lit('"assistant"')).otherwise(F.lit('"user"'))
    said = q(F.concat("event_type", F.lit(" "), k))
    one = F.concat(F.lit('{"kind":'), who, F.lit(',"id":'), q("event_id"), F.lit(',"session":'), q("user_id"), F.lit(',"at":'), at, F.lit(',"text":'), said, F.lit(',"response":"r"}'))
    two = F.concat(F.lit('{"type":'), who, F.lit(',"uuid":'), q("event_id"), F.lit(',"meta":{"sessionId":'), q("user_id"), F.lit(',"timestamp":'), at, F.lit('},"message":{"content":'), said, F.lit("}}"))
    kind = F.when(F.col("event_type") == "error", F.lit('"reasoning"')).otherwise(F.lit('"message"'))
    parts = F.concat(F.lit('[{"type":"input_text","text":'), q("event_type"), F.lit('},{"type":"tool","text":"x"},{"type":"input_text","text":'), q(k), F.lit("}]"))
    three = F.concat(F.lit('{"timestamp":'), at, F.lit(',"session":'), q("user_id"), F.lit(',"payload":{"type":'), kind, F.lit(',"content":'), parts, F.lit("}}"))
    shape = F.col("event_id") % 3
    lines = e.select(F.when(shape == 0, "/one/a").when(shape == 1, "/two/a").otherwise("/three/a").alias("path"), F.when(shape == 0, one).when(shape == 1, two).otherwise(three).alias("raw"))
    found = decoded(lines, Policy(), CLIENTS).where("reason = 'ok'")
    return found.select("tool", "event_id", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "prompt")


def registry_drift(spark, sf_dir):
    """The store against a registry that lost and changed rows."""
    e = _events(spark, sf_dir).select("event_id", "event_type")
    public = e.where("event_id % 10 <> 0").withColumn("event_type", F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("event_type")))
    return matching.compare(e, public, "event_id", "event_type")


def registry_changed_users(spark, sf_dir):
    """K3: conversations as users whose registry is not what the store has, by digests: one lost, changed or repeated lines."""
    e = _t(spark, sf_dir, "conversations").select("conv_id", F.concat_ws(" ", F.col("turn").cast("string"), "role", "text").alias("line"), (F.col("conv_id") * 31 + F.coalesce("turn", F.lit(0))).alias("k"))
    public = e.where("k % 7 <> 0").withColumn("line", F.when(F.col("k") % 11 == 0, "x").otherwise(F.col("line"))).unionByName(e.where("k % 13 = 0"))
    found = matching.differing(matching.multiset_digest(e, ["conv_id"], "line"), matching.multiset_digest(public, ["conv_id"], "line"), "conv_id")
    return found.select("conv_id", "had")


def id_collisions(spark, sf_dir):
    """Documents whose text is the id, and source the content: the first is kept, those of another source are set aside."""
    e = _t(spark, sf_dir, "documents").select("doc_id", "source", fx.digest(F.col("text")).alias("id"))
    kept, others = matching.isolate(e, ["id"], "source", [F.col("doc_id")])
    own = lambda df, state: df.select("doc_id", F.lit(state).alias("state"))
    return own(kept, "kept").unionByName(own(others, "collision"))


def captured_events(spark, sf_dir):
    """The capture step: turns of conversations as envelopes; by turn a client is too old, lacks its marker, works elsewhere, or is a sub-agent."""
    c = _t(spark, sf_dir, "conversations").where("role = 'user' and text is not null").withColumn("k", F.col("conv_id") * 31 + F.col("turn"))
    by = lambda n: F.col("k") % n == 0
    cwd = F.when(by(11), "/repo/inner/x").when(by(17), "/repo/../etc").otherwise("/repo/./x")
    fields = [F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("turn_id"), cwd.alias("cwd"), F.lit("ask").alias("permission_mode"), F.col("text").alias("prompt"), F.when(by(13), "a").alias("agent_id")]
    lines = c.select(F.to_json(F.struct(*fields)).alias("raw"), F.lit("one").alias("tool"), F.when(by(5), "1.0.57").otherwise("1.1.0").alias("version"), F.when(~by(7), "m").alias("marker"))
    rules = capture.Capture({"one": "1.0.58"}, {"one": ("marker",)}, "/repo", ("/repo/inner",), policy=Policy(redact=False))
    return capture.captured(filters.judge_envelopes(lines), rules).select("event_id", "session_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def _envelopes(spark, sf_dir):
    """Envelopes made from events: every 5th without a folder, every 7th of a sub-agent, every 11th with another field, every 13th long."""
    by = lambda n: F.col("event_id") % n == 0
    part = lambda name, c: F.concat(F.lit(f'"{name}":"'), c, F.lit('"'))
    fields = [
        part("session_id", F.col("user_id").cast("string")), part("turn_id", F.col("event_id").cast("string")), F.when(~by(5), part("cwd", F.lit("/r"))), part("permission_mode", F.lit("ask")),
        part("prompt", F.when(by(13), F.repeat(F.lit("x"), 400)).otherwise(F.col("event_type"))), F.when(by(7), part("agent_id", F.lit("a"))), F.when(by(11), part("response", F.lit("r"))),
    ]
    raw = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.when(by(17), F.lit("")).otherwise(F.lit("}")))
    return _events(spark, sf_dir).select("event_id", raw.alias("raw"))


def _typed_lines(spark, sf_dir):
    """Lines made from events, in which by id a field is missing, null, of a wrong type or nested too deep, a time can't be read, or the end is cut."""
    by = lambda n: F.col("event_id") % n == 0
    own = F.col("event_id").cast("string")
    fields = [
        F.when(~by(11), F.concat(F.lit('"event_id":'), F.when(by(7), "null").when(by(5), own).otherwise(F.concat(F.lit('"'), own, F.lit('"'))))),
        F.concat(F.lit('"ts":"'), F.when(by(13), "13:00").when(by(17), "2024-02-30T00:00:00Z").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit('"')),
        F.concat(F.lit('"meta":{"k":'), F.when(by(23), '"x"').otherwise(F.get_json_object("props", "$.k")), F.when(by(19), ',"response":"r"').otherwise(""), F.lit("}")),
        F.concat(F.lit('"tags":["a"'), F.when(by(29), ",1").otherwise(',"b"'), F.lit("]")),
        F.when(by(37), F.concat(F.lit('"event_type":{"event_type":"'), F.col("event_type"), F.lit('"}'))).otherwise(F.concat(F.lit('"event_type":"'), F.col("event_type"), F.lit('"'))),
    ]
    raw = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.when(by(31), F.lit("")).when(by(41), F.lit("}]{}")).otherwise(F.lit("}")))
    return _events(spark, sf_dir).select(F.col("event_id").alias("line_no"), raw.alias("raw"))


TYPED = Contract((
    Field("event_id", needed=True), Field("ts", "time", needed=True), Field("meta", "object", fields=(Field("k", "long", needed=True),)), Field("tags", "array", item=Field("tag", needed=True)),
    Field("event_type", needed=True),
))


def typed_lines(spark, sf_dir):
    """What a typed contract says of each line, at every level."""
    return filters.judge_lines(_typed_lines(spark, sf_dir), contract=TYPED).select("line_no", "reason")


def typed_fields(spark, sf_dir):
    """The accepted lines as typed columns."""
    found = filters.accept_lines(_typed_lines(spark, sf_dir), contract=TYPED)
    return found.select("line_no", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("meta.k").alias("k"), F.size("tags").alias("n_tags"), "event_type")


def envelope_verdicts(spark, sf_dir):
    """What the envelope's contract says of each, with a limit of 400 bytes; every 17th is cut."""
    return filters.judge_envelopes(_envelopes(spark, sf_dir), Policy(envelope_bytes=400)).select("event_id", "reason")


def envelope_fields(spark, sf_dir):
    """The accepted envelopes as columns."""
    return filters.accept_envelopes(_envelopes(spark, sf_dir), Policy(envelope_bytes=400), fields=Contract(strings(("session_id", "turn_id", "cwd", "prompt"))))


def event_kinds(spark, sf_dir):
    """two event types are allowed."""
    return filters.of_kinds(_events(spark, sf_dir), ("click", "signup"), "event_type").select("event_id", "event_type")


def provider_markers(spark, sf_dir):
    """two markers, made from ids, that a provider's rows must both carry."""
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, "a").alias("m1"), F.when(F.col("event_id") % 3 == 0, "b").alias("m2"))
    return filters.with_markers(rows, ["m1", "m2"]).select("event_id")


def native_ids(spark, sf_dir):
    """The event's own id: prompt, else turn, else session and time."""
    rows = _events(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("p"), "event_id")).alias("prompt_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), "event_id")).alias("turn_id"),
        F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )
    return rows.select("event_id", fx.native_id().alias("native_id"))


def _cwds(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1), r"^(/en/)([0-9])", "$1$2/").alias("cwd"))
    return p.withColumn("cwd", F.when(F.col("page_id") % 4 != 0, F.col("cwd")))


def deferred_rows(spark, sf_dir):
    """rows whose folder is unknown, as every fourth is here, wait."""
    return filters.in_scope(_cwds(spark, sf_dir), "/en", spark.createDataFrame([("/en/9",)], "root string"))[1].select("page_id")


def deferred_cursor(spark, sf_dir):
    """A transcript (a page's language) goes on at its first row that waits."""
    rows = _cwds(spark, sf_dir).withColumns({"path": F.col("page_id") % 10, "offset": F.col("page_id")})
    waiting = filters.in_scope(rows, "/en", spark.createDataFrame([("/en/9",)], "root string"))[1]
    return budget.cursor(rows, rows.join(waiting.select("page_id"), "page_id", "left_anti"), ["page_id"])


def republish_check(spark, sf_dir):
    """the store's rows of one user and project, of two tools."""
    rows = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("tool"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("identity"), F.when(F.col("event_id") % 9 == 0, "other").otherwise("repo").alias("repo"))
    return filters.publishable(rows, ["click", "purchase"], "u7", "repo").select("event_id")


def event_contract(spark, sf_dir):
    """Prompts as events; every third has no identity."""
    c = _t(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("event_id"), F.lit("tool").alias("tool"), F.col("conv_id").cast("string").alias("session_id"), F.lit(None).cast("timestamp").alias("ts"),
        F.concat(F.lit("token=abcdefgh "), "text").alias("prompt"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("u"), "conv_id")).alias("identity"), F.lit("main").alias("branch"), F.lit("c0").alias("commit"),
    )
    return filters.to_events(c, "repo", "device").drop("ts")


def truncation_alerts(spark, sf_dir):
    """Prompts that are over 100 bytes once redacted are cut with a mark, and told."""
    c = _t(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("event_id"), *[F.lit(None).cast("string").alias(x) for x in ("tool", "session_id", "ts", "identity", "branch", "commit")], F.concat(F.lit("secret=abcdef "), "text").alias("prompt")
    )
    return filters.to_events(c, "repo", "device", Policy(prompt_bytes=100, mark="[CUT]")).select("event_id", "prompt", "truncated")


def provider_names(spark, sf_dir):
    """Another provider's field names become ours."""
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("eventId"), F.col("event_type").alias("HookEventName"), "user_id")
    return filters.conform(rows, {"eventId": "event_id", "HookEventName": "hook_event_name", "absent": "other"})


def registry_strict(spark, sf_dir):
    """Registry lines, of which every sixth has a response; these are left out."""
    e = _events(spark, sf_dir)
    line = F.concat(F.lit('{"event_id":"'), "event_id", F.lit('","tool":"'), "event_type", F.lit('","prompt":"p"'), F.when(F.col("event_id") % 6 == 0, ',"response":"x"').otherwise(""), F.lit("}"))
    return filters.accept_lines(e.select(line.alias("raw")), contract=Contract(strings(EVENT_FIELDS, ("event_id", "tool", "prompt"))), fields=Contract(strings(("event_id", "tool", "prompt"))))


def torn_tails(spark, sf_dir):
    """Documents as files; what follows the last newline is a torn write."""
    return filters.torn_tails(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


def log_listing(spark, sf_dir):
    """The log, in order."""
    return reports.listing(_events(spark, sf_dir), ["event_id", "event_type", "ts"])


def lines_in_order(spark, sf_dir):
    """L2: turns by conversation and place."""
    return reports.in_file_order(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


_SIDES = "with d as (select event_id as id, event_type, user_id, ts from events where event_id % 2 = 0), r as (select event_id as id, event_type, user_id, ts from events where event_id % 2 = 1)"
_WALK = """with recursive d as (select event_id as id, event_type, user_id, ts, row_number() over (partition by event_type, user_id order by ts, event_id) as n from events where event_id % 2 = 0),
r as (select event_id as id, event_type, user_id, ts, row_number() over (partition by event_type, user_id order by ts, event_id) as n from events where event_id % 2 = 1),
w(event_type, user_id, i, j, a, b) as (
  select event_type, user_id, 1::bigint, 1::bigint, null::bigint, null::bigint from (select distinct event_type, user_id from d)
  union all
  select w.event_type, w.user_id,
    case when abs(epoch_us(d.ts) - epoch_us(r.ts)) <= 21600000000 or d.ts < r.ts then w.i + 1 else w.i end,
    case when abs(epoch_us(d.ts) - epoch_us(r.ts)) <= 21600000000 or d.ts >= r.ts then w.j + 1 else w.j end,
    case when abs(epoch_us(d.ts) - epoch_us(r.ts)) <= 21600000000 then d.id end,
    case when abs(epoch_us(d.ts) - epoch_us(r.ts)) <= 21600000000 then r.id end
  from w join d on d.event_type = w.event_type and d.user_id = w.user_id and d.n = w.i join r on r.event_type = w.event_type and r.user_id = w.user_id and r.n = w.j)"""
_CWDS = r"select page_id, case when page_id % 4 <> 0 then regexp_replace(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '^(/en/)([0-9])', '\1\2/') end as cwd from pages"


def _cut(text: str, limit: int, mark: str) -> str:
    """A text of at most limit bytes: the longest of four prefixes that is UTF-8."""
    room = limit - len(mark)
    cuts = ", ".join(f"try(decode(encode({text})[1:{room - i}]))" for i in range(4))
    return f"case when strlen({text}) <= {limit} then {text} else coalesce({cuts}, '') || '{mark}' end"


_LINES = """select event_id as line_no, concat('{', concat_ws(',',
  case when event_id % 11 <> 0 then '"event_id":' || case when event_id % 7 = 0 then 'null' when event_id % 5 = 0 then event_id::varchar else '"' || event_id || '"' end end,
  '"ts":"' || case when event_id % 13 = 0 then '13:00' when event_id % 17 = 0 then '2024-02-30T00:00:00Z' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end || '"',
  '"meta":{"k":' || case when event_id % 23 = 0 then '"x"' else props->>'$.k' end || case when event_id % 19 = 0 then ',"response":"r"' else '' end || '}',
  '"tags":["a"' || case when event_id % 29 = 0 then ',1' else ',"b"' end || ']',
  case when event_id % 37 = 0 then '"event_type":{"event_type":"' || event_type || '"}' else '"event_type":"' || event_type || '"' end),
  case when event_id % 31 = 0 then '' when event_id % 41 = 0 then '}]{}' else '}' end) as raw from events"""
_TYPED = f"""select line_no, raw, case when not json_valid(raw) then 'malformed'
  when len(list_filter(json_keys(raw), lambda x: x not in ('event_id', 'ts', 'meta', 'tags', 'event_type'))) > 0 or len(list_filter(json_keys(raw, '$.meta'), lambda x: x <> 'k')) > 0 then 'unknown'
  when json_type(raw, '$.event_id') is null then 'missing' when json_type(raw, '$.event_id') = 'NULL' then 'null'
  when json_type(raw, '$.event_id') <> 'VARCHAR' or json_type(raw, '$.meta.k') = 'VARCHAR' or json_type(raw, '$.tags[1]') <> 'VARCHAR' or json_type(raw, '$.event_type') <> 'VARCHAR' then 'type'
  when not regexp_matches(raw->>'$.ts', '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}Z$') or try_cast(replace(raw->>'$.ts', 'Z', '') as timestamp) is null then 'time' else 'ok' end as reason from ({_LINES})"""
_RAW = "select event_id, case when event_id % 7 = 0 then regexp_replace(props, '\\}$', ', \"response\": \"x\"}') else props end as raw from events"
_BUDGET = "select *, sum(strlen(text)) over (order by conv_id, turn) as s, row_number() over (order by conv_id, turn) as k from conversations where role = 'user'"
_ALIAS = """with a as (select o.doc_id as old_id, e.doc_id as event_id, count(*) over (partition by o.doc_id) as x, count(*) over (partition by e.doc_id) as y
from documents o join documents e on o.text = e.text and o.doc_id % 2 = 1 and e.doc_id % 2 = 0) select old_id, event_id from a where x = 1 and y = 1"""

ORACLES = {
    "status_by_tool": "select event_type as tool, count(*) as n, max(ts) as last_ts from events group by 1",
    "silent_tools": "select event_type as tool, count(*) as n, max(max(ts)) over () - max(ts) > interval 1 minute as silent from events group by 1",
    "human_prompts": "select conv_id, turn, text as prompt from conversations where role = 'user'",
    "typed_lines": f"select line_no, reason from ({_TYPED})",
    "typed_fields": f"""select line_no, raw->>'$.event_id' as event_id, (raw->>'$.ts')::timestamp as ts, (raw->>'$.meta.k')::bigint as k, json_array_length(raw, '$.tags')::int as n_tags, raw->>'$.event_type' as event_type
from ({_TYPED}) where reason = 'ok'""",
    "strict_keys": f"select event_id from ({_RAW}) where len(list_filter(json_keys(raw::json), lambda x: x not in ('k'))) = 0",
    "quarantine_digest": f"select event_id as line_no, strlen(raw) as n_bytes, sha256(raw) as sha256, 'unknown' as reason from ({_RAW}) where len(list_filter(json_keys(raw::json), lambda x: x not in ('k'))) > 0",
    "redact_text": r"""select doc_id, regexp_replace(regexp_replace(text, '(?i)((?:password|passwd|secret|token|api_?key)["'']?\s*[:=]\s*["'']?)[A-Za-z0-9+/_.=-]{6,}', '\1[REDACTED]', 'g'), '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '[IP]', 'g') as text from documents""",
    "exact_text_dedup": "select sha256(text) as sha256, min(doc_id) as doc_id, count(*) as n from documents group by text",
    "known_id_anti": "select event_id, event_type from events e where not exists (select 1 from events d where d.event_id = e.event_id and d.event_id % 2 = 0)",
    "indexed_new_ids": "select source, doc_id from documents where not coalesce(doc_id % 2 = 0, false)",
    "correlate_candidates": f"{_SIDES} select d.id as direct_id, r.id as recovered_id from d join r on d.event_type = r.event_type and d.user_id = r.user_id and abs(epoch_us(d.ts) - epoch_us(r.ts)) <= 21600000000",
    "correlate_one_to_one": f"{_WALK} select a as direct_id, b as recovered_id from w where a is not null",
    "unmatched_recovered": f"{_WALK} select id from r where id not in (select b from w where b is not null)",
    "alias_bijection": _ALIAS,
    "alias_void": f"select event_id, old_id from ({_ALIAS}) where event_id % 4 = 0",
    "manifest_equality": """with m as (select n_name as path, sha256(n_name) as h from nation), f as (select path, case when path like '%5' then '0' else h end as h from m where path <> 'NATION_3' union all select r_name, sha256(r_name) from region)
select coalesce(m.path, f.path) as path, case when f.path is null then 'missing' when m.path is null then 'extra' else 'changed' end as state from m full join f on m.path = f.path where m.h is distinct from f.h""",
    "manifest_rows": """with c as (select n_nationkey, (case when n_nationkey % 5 = 0 then 9 else n_regionkey end)::int as n_regionkey from nation), n as (select n_nationkey, n_regionkey from nation)
select *, 'left' as side from (select * from n except all select * from c) union all select *, 'right' as side from (select * from c except all select * from n)""",
    "batch_budget": f"select conv_id, turn from ({_BUDGET}) where k <= 100 and (s <= 20000 or k = 1)",
    "batch_cursor": f"select conv_id, min(turn) as turn from ({_BUDGET}) where not (k <= 100 and (s <= 20000 or k = 1)) group by 1",
    "reserve_then_budget": "select conv_id, turn from (select *, sum(strlen(text)) over (order by conv_id, turn) as s, row_number() over (order by conv_id, turn) as k from conversations where role = 'user' and conv_id % 2 <> 0) where k <= 50 and (s <= 20000 or k = 1)",
    "retention": "select event_id, ts from events where ts >= timestamp '2024-01-31' - interval 15 days",
    "pending_merge": "select event_id, event_type from events where event_id % 3 <> 0 or event_id % 2 = 0",
    "sessions_without_prompts": "select user_id, ts::date as day from events group by 1, 2 having not bool_or(event_type = 'click')",
    "quiet_session_runs": """with d as (select user_id, ts::date as day, bool_or(event_type = 'click') as hit from events group by 1, 2), g as (select *, sum(hit::int) over (partition by user_id order by day) as run from d)
select user_id, min(day) as "first", max(day) as "last", count(*) as n from g where not hit group by user_id, run""",
    "repeated_repairs": "select user_id, ts::date as day, count(*) as n from events where event_type = 'error' group by 1, 2 having count(*) >= 2",
    "queue_age": "select min(ts) as oldest, count(*) as n, timestamp '2024-01-31' - min(ts) > interval 7 days as late from events where event_type = 'purchase'",
    "partial_sources": "select source, bool_or(strlen(text) > 20000) as partial from documents group by 1",
    "version_floor": "select event_id, concat(event_id % 3, '.', event_id % 140, '.', event_id % 60) as version from events where event_id % 11 <> 0 and [event_id % 3, event_id % 140, event_id % 60] >= [1, 0, 58]",
    "health_rollup": "select event_type as code, count(*) as n, max(ts) as last_ts from events group by 1",
    "report_by_day": "select ts::date as day, event_type as tool, count(*) as n, count(distinct user_id) as sessions from events group by 1, 2",
    "envelope_verdicts": """select event_id, case when event_id % 13 = 0 then 'oversize' when event_id % 17 = 0 then 'malformed' when event_id % 7 = 0 then 'forbidden' when event_id % 11 = 0 then 'unknown' when event_id % 5 = 0 then 'missing' else 'ok' end as reason from events""",
    "envelope_fields": "select event_id, user_id::varchar as session_id, event_id::varchar as turn_id, '/r' as cwd, event_type as prompt from events where event_id % 13 <> 0 and event_id % 17 <> 0 and event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 5 <> 0",
    "event_kinds": "select event_id, event_type from events where event_type in ('click', 'signup')",
    "provider_markers": "select event_id from events where event_id % 6 = 0",
    "native_ids": "select event_id, case when event_id % 2 = 0 then concat('p', event_id) when event_id % 3 = 0 then concat('t', event_id) else concat(user_id, '/', strftime(ts, '%Y-%m-%d %H:%M:%S')) end as native_id from events",
    "deferred_rows": f"select page_id from ({_CWDS}) where cwd is null",
    "deferred_cursor": f'select page_id % 10 as path, min(page_id) as "offset" from ({_CWDS}) where cwd is null group by 1',
    "republish_check": "select event_id from events where event_type in ('click', 'purchase') and user_id % 10 = 7 and event_id % 9 <> 0",
    "event_contract": r"""select concat(conv_id, '/', turn) as event_id, 'tool' as tool, conv_id::varchar as session_id,
  regexp_replace(regexp_replace(concat('token=abcdefgh ', text), '(?i)((?:password|passwd|secret|token|api_?key)["'']?\s*[:=]\s*["'']?)[A-Za-z0-9+/_.=-]{6,}', '\1[REDACTED]', 'g'), 'AKIA[A-Z0-9]{16,}', '[REDACTED]', 'g') as prompt,
  case when conv_id % 3 <> 0 then concat('u', conv_id) else 'device' end as identity, sha256('repo') as repo, 'main' as branch, 'c0' as "commit", false as truncated from conversations""",
    "truncation_alerts": f"""with p as (select concat(conv_id, '/', turn) as event_id, regexp_replace(regexp_replace(concat('secret=abcdef ', text), '(?i)((?:password|passwd|secret|token|api_?key)["'']?\\s*[:=]\\s*["'']?)[A-Za-z0-9+/_.=-]{{6,}}', '\\1[REDACTED]', 'g'), 'AKIA[A-Z0-9]{{16,}}', '[REDACTED]', 'g') as t from conversations)
select event_id, {_cut("t", 100, "[CUT]")} as prompt, strlen(t) > 100 as truncated from p""",
    "provider_names": "select event_id, event_type as hook_event_name, user_id from events",
    "registry_strict": "select event_id::varchar as event_id, event_type as tool, 'p' as prompt from events where event_id % 6 <> 0",
    "torn_tails": "with t as (select doc_id as path, string_split(text, chr(10))[-1] as tail from documents) select path, strlen(tail) as n_bytes, sha256(tail) as sha256 from t where tail <> ''",
    "log_listing": "select event_id, event_type, ts from events",
    "lines_in_order": "select conv_id, turn, role from conversations",
    "byte_truncate": f"select doc_id, {_cut('text', 1000, '[CUT]')} as text from documents",
    "prefix_digest": "select doc_id, sha256(encode(text)[1:64]) as sha256 from documents",
    "latest_per_session": "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "repo_scope": r"with p as (select page_id, regexp_replace(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '^(/en/)([0-9])', '\1\2/') as cwd from pages) select page_id from p where (cwd = '/en' or starts_with(cwd, '/en/')) and not (cwd = '/en/9' or starts_with(cwd, '/en/9/'))",
    "canonical_scope": r"""with p as (select page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) as path from pages),
c as (select page_id, case page_id % 5 when 0 then '/en/..' || path when 1 then path || '/../../x' when 2 then '/./' || path || '//.//' when 3 then 'en' || path else path end as cwd from p),
f as (select page_id, case when starts_with(cwd, '/') then coalesce(nullif(list_reduce(list_concat([''], string_split(cwd, '/')),
  lambda a, x: case when x in ('', '.') then a when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end), ''), '/') end as folder from c)
select page_id, folder, coalesce(folder = '/en' or starts_with(folder, '/en/'), false) as inside from f""",
    "adapted_events": """select case event_id % 3 when 0 then 'one' when 1 then 'two' else 'three' end as tool,
  case when event_id % 3 = 2 then user_id || '/' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') else event_id::varchar end as event_id, user_id::varchar as session_id, date_trunc('second', ts) as ts,
  event_type || case when event_id % 3 = 2 then chr(10) else ' ' end || (props->>'$.k') as prompt from events where event_type <> 'error'""",
    "registry_drift": "select event_id, case when event_id % 10 = 0 then 'missing' else 'changed' end as state from events where event_id % 10 = 0 or event_id % 13 = 0",
    "registry_changed_users": """with e as (select conv_id, concat_ws(' ', turn, role, text) as line, conv_id * 31 + coalesce(turn, 0) as k from conversations),
  p as (select conv_id, case when k % 11 = 0 then 'x' else line end as line from e where k % 7 <> 0 union all select conv_id, line from e where k % 13 = 0),
  d as (select conv_id, line from (select conv_id, line, 1 as n from e union all select conv_id, line, -1 from p) group by all having sum(n) <> 0)
  select distinct conv_id, conv_id in (select conv_id from p) as had from d""",
    "id_collisions": """with e as (select doc_id, source, row_number() over w as n, first_value(source) over w as own from documents window w as (partition by text order by doc_id))
  select doc_id, case when n = 1 then 'kept' else 'collision' end as state from e where n = 1 or source is distinct from own""",
    "captured_events": """select conv_id || '-' || turn as event_id, conv_id::varchar as session_id, sha256(text) as prompt_sha256 from (select *, conv_id * 31 + turn as k from conversations)
  where role = 'user' and text is not null and k % 5 <> 0 and k % 7 <> 0 and k % 11 <> 0 and k % 13 <> 0 and k % 17 <> 0""",
}
QUERIES = (
    status_by_tool, silent_tools, human_prompts, strict_keys, quarantine_digest, redact_text, exact_text_dedup, known_id_anti, indexed_new_ids, correlate_candidates, correlate_one_to_one,
    unmatched_recovered, alias_bijection, alias_void, manifest_equality, manifest_rows, batch_budget, batch_cursor, reserve_then_budget, retention, pending_merge,
    sessions_without_prompts, quiet_session_runs, repeated_repairs, queue_age, partial_sources, version_floor, health_rollup, report_by_day, byte_truncate, prefix_digest,
    latest_per_session, repo_scope, registry_drift, registry_changed_users, id_collisions, captured_events, envelope_verdicts, envelope_fields, event_kinds, provider_markers, native_ids, deferred_rows, deferred_cursor, republish_check, typed_lines, typed_fields, canonical_scope, adapted_events,
    event_contract, truncation_alerts, provider_names, registry_strict, torn_tails, log_listing, lines_in_order,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
