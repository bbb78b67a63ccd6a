"""Operators on small literals, properties against brute force, and recovery under crashes."""

import hashlib
import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrook.functions import schema
from tallyrook.functions import text as fx
from tallyrook.operators import budget, filters, matching, reports
from tallyrook.plans import registry
from tallyrook.policy import ENVELOPE_FORBIDDEN, ENVELOPE_REQUIRED, EVENT_FIELDS, Policy, check_name
from tallyrook.sources import files
from tallyrook.sources import tail
from tallyrook.sources.tail import Piece, TailReader
from tallyrook.streaming import recover as rec

T0 = datetime(2024, 1, 1)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


def test_policy():
    assert Policy.from_json('{"retention_days": 30}').retention_days == 30
    for bad in ('{"x": 1}', '{"retention_days": 1, "retention_days": 2}', '{"batch_rows": 0}', '{"redact": 1}', '{"extra_rules": ["a"]}'):
        with pytest.raises(ValueError):
            Policy.from_json(bad)
    with pytest.raises(ValueError):
        check_name("../x")


def test_truncate_keeps_characters(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("aé€😀") for _ in range(rng.randrange(40))),) for _ in range(200)] + [(None,)]
    got = spark.createDataFrame(rows, "x string").select("x", fx.truncate_bytes(F.col("x"), 30, "…").alias("y")).collect()
    for x, y in got:
        raw = (x or "").encode()
        want = x if x is None or len(raw) <= 30 else raw[:27].decode("utf-8", "ignore") + "…"
        assert y == want and (y is None or len(y.encode()) <= 30)
    with pytest.raises(ValueError):
        fx.truncate_bytes(F.col("x"), 2, "…")


def test_versions(spark):
    for v, ok in (("1.0.58", True), ("1.0.57", False), ("1.1.0", True), ("2.0.0", True), ("1.0.58-rc1", False), ("1.0", False), ("", False), (None, False), ("1.0.158", True)):
        assert one(spark, v, lambda c: fx.version_at_least(c, "1.0.58")) is ok


def test_paths(spark):
    for p, ok in (("/a/b", True), ("/a/b/c", True), ("/a/bc", False), ("/a", False), ("/a/b/../c", False), ("/a/./b/x", True), ("/a//b/", True), ("/../a/b", True), ("/a/x/../b/y", True), ("a/b/c", False), (None, False), ("", False)):
        assert one(spark, p, lambda c: fx.within(c, F.lit("/a/b/"))) is ok, p
    assert one(spark, "/x", lambda c: fx.within(c, F.lit("/"))) is True
    for p, want in (("/", "/"), ("/..", "/"), ("/a/../..", "/"), ("/a/b/../../c/.", "/c"), ("C:\\Repo\\..\\x", "/c:/x"), ("c:/repo//y/", "/c:/repo/y"), ("/a/..b/...", "/a/..b/..."), ("x", None), (None, None)):
        assert one(spark, p, lambda c: fx.canonical(c)) == want, p


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('{"event_id":"1"}', "ok"), ('{"event_id":"1","response":"x"}', "unknown"), ('{"event_id":"1","assistant_response":"x"}', "unknown"), ('{"event_id":"1","event_id":"2"}', "malformed"), ('{"event_id":"1"', "malformed"),
        ('{"event_id":"1"} x', "malformed"), ('{"event_id":"1"} x}', "malformed"), ('{"event_id":"1"}{"event_id":"2"}', "malformed"), ('{"event_id":"1"},{"event_id":"2"}', "malformed"), ("[1]", "malformed"), ("", "malformed"),
        (None, "malformed"), ('{"tool":"x"}', "missing"), (' {"event_id":"é"} ', "ok"), ('{"event_id":"' + "x" * 200 + '"}', "oversize"),
    ],
)
def test_strict_lines(spark, line, want):
    contract = schema.Contract(schema.strings(EVENT_FIELDS, ["event_id"]))
    assert schema.judge(spark.createDataFrame([(line,)], "raw string"), contract, 150).first()["reason"] == want


TYPED = [
    ('{"event_id":"1","tool":"t","session_id":"s","prompt":"a"}', "ok"),
    ('{"event_id":"1","tool":"t","session_id":"s","prompt":{"prompt":"a","response":"leak"}}', "type"),
    ('{"event_id":{"x":1},"tool":"t","session_id":"s","prompt":"a"}', "type"),
    ('{"event_id":1,"tool":"t","session_id":"s","prompt":"a"}', "type"),
    ('{"event_id":"1","tool":["t"],"session_id":"s","prompt":"a"}', "type"),
    ('{"event_id":null,"tool":"t","session_id":"s","prompt":"a"}', "null"),
    ('{"event_id":"1","tool":"t","session_id":"s","prompt":"a","ts":"yesterday"}', "time"),
    ('{"event_id":"1","tool":"t","session_id":"s","prompt":"a","ts":"12:30"}', "time"),
    ('{"event_id":"1","tool":"t","session_id":"s","prompt":"a","ts":"2024-01-01T00:00:00.5+01:00"}', "ok"),
    ('{"event_id":"1","tool":"t","session_id":"s","prompt":"a","ts":null,"branch":null}', "ok"),
    ('{"event_id":"1","tool":"t","session_id":"s","prompt":"a"}]{}', "malformed"),
    ('{"event_id":"1","tool":"t","session_id":"s","prompt":"a"}} {', "malformed"),
    ('{"event_id":"1","tool":"t","session_id":"s"}', "missing"),
    ('{"Event_id":"1","tool":"t","session_id":"s","prompt":"a"}', "unknown"),
]


def test_typed_lines(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(TYPED)], "i int, raw string")
    assert [r["reason"] for r in filters.judge_lines(df).orderBy("i").collect()] == [w for _, w in TYPED]
    read = {r["i"]: r for r in filters.accepted(filters.judge_lines(df)).collect()}
    assert set(read) == {0, 8, 9} and read[8]["ts"] == datetime(2023, 12, 31, 23, 0, 0, 500_000) and read[9]["ts"] is None and read[0]["prompt"] == "a"


def test_nested_contracts(spark):
    F_ = schema.Field
    contract = schema.Contract((F_("a.b", "object", True, (F_("q'", "long"), F_("d", "double"), F_("ok", "boolean"))), F_("xs", "array", item=F_("x", "object", True, (F_("n", "long", True),)))), ("stop",))
    rows = {
        '{"a.b":{"q\'":1,"d":2,"ok":true},"xs":[{"n":1},{"n":2}]}': "ok", '{"a.b":{},"xs":[]}': "ok", '{"a.b":{},"xs":null}': "ok", '{"a.b":{"z":1}}': "unknown", '{"a.b":{},"xs":[{"n":1,"m":2}]}': "unknown",
        '{"a.b":{},"xs":[{}]}': "missing", '{"a.b":{},"xs":[{"n":null}]}': "null", '{"a.b":{},"xs":[null]}': "null", '{"a.b":{},"xs":[{"n":"1"}]}': "type", '{"a.b":[],"xs":[]}': "type", '{"a.b":{"q\'":1.5}}': "type",
        '{"a.b":{"ok":"true"}}': "type", '{"a.b":null}': "null", '{"stop":null,"a.b":{}}': "forbidden", '{"a.b":{"d":9007199254740993}}': "ok", "[]": "malformed", "7": "malformed", "null": "malformed",
    }
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    assert [r["reason"] for r in schema.judge(df, contract).orderBy("i").collect()] == list(rows.values())
    first = schema.decode(df.where("i = 0"), contract).first()
    assert tuple(first["a.b"]) == (1, 2.0, True) and [x["n"] for x in first["xs"]] == [1, 2]
    for bad in (dict(name="x", kind="date"), dict(name="x", kind="array"), dict(name="x", fields=(F_("y"),)), dict(name="x", kind="object", fields=(F_("y"), F_("y")))):
        with pytest.raises(ValueError):
            F_(**bad)


def test_envelopes(spark):
    full = {k: "x" for k in ENVELOPE_REQUIRED}
    rows = [json.dumps(full), json.dumps(full | {ENVELOPE_FORBIDDEN[0]: "y"}), json.dumps({k: v for k, v in full.items() if k != "cwd"}), json.dumps(full | {"z": 1})]
    judged = filters.judge_envelopes(spark.createDataFrame([(r,) for r in rows], "raw string"))
    assert [r["reason"] for r in judged.collect()] == ["ok", "forbidden", "missing", "unknown"]
    bad = filters.quarantined(judged)
    assert set(bad.columns) == {"n_bytes", "sha256", "reason"} and bad.count() == 3
    assert hashlib.sha256(rows[1].encode()).hexdigest() in {r["sha256"] for r in bad.collect()}
    assert filters.accepted(judged, schema.Contract(schema.strings(("session_id", "prompt")))).count() == 1


def test_accepted_lines_are_parsed_once(spark):
    """Neither the line, which a filter takes along, nor what is parsed from it is computed again for the reason or a field."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = plan(registry.envelope_fields(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")))
    assert made.count("parseJson") == made.count("sha2(") == made.count('"permission_mode"') == 1
    lines = spark.range(3).select("id", F.reverse(F.col("id").cast("string")).alias("raw"))
    judged = plan(filters.judge_lines(lines).where("reason = 'ok'").select("id"))
    assert judged.count("parseJson") == judged.count("sha2(") == judged.count("reverse(") == 1


def test_accepted_in_one_pass(spark):
    """The one pass gives the rows of judging and then reading."""
    F_ = schema.Field
    rows = [r for r, _ in TYPED] + [None, "", "null", '{"event_id":"1","tool":"t","session_id":"s","prompt":"' + "x" * 300 + '"}', ' {"event_id":"é","tool":"t","session_id":"s","prompt":"","cwd":null} ']
    df, policy = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string"), Policy(line_bytes=200, envelope_bytes=200)
    want = filters.accepted(filters.judge_lines(df, policy, filters.LINE), filters.LINE)
    got = filters.accept_lines(df, policy, filters.LINE)
    assert got.columns == want.columns and got.dtypes == want.dtypes and got.count() == 4
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    few = filters.accept_envelopes(df, policy, filters.LINE, schema.Contract(schema.strings(("prompt",))))
    assert few.columns == ["i", "prompt"] and {r["i"]: r["prompt"] for r in few.collect()} == {r["i"]: r["prompt"] for r in want.collect()} == {0: "a", 8: "a", 9: "a", 18: ""}
    contract = schema.Contract((F_("a.b", "object", True, (F_("q'", "long"), F_("t", "time"))), F_("xs", "array", item=F_("x", "long")), F_("ok", "boolean"), F_('d"', "double")))
    nested = spark.createDataFrame([(0, '{"a.b":{"q\'":1,"t":"2024-01-01T00:00:00Z"},"xs":[1,null],"ok":true,"d\\"":0.5}'), (1, '{"a.b":{}}'), (2, '{"a.b":{"q\'":"1"}}')], "i int, raw string")
    read = schema.accept(nested, contract, contract)
    assert read.collect() == schema.decode(nested.where("i < 2"), contract).collect() and read.first()["xs"] == [1, None] and read.first()['d"'] == 0.5


def test_scope(spark):
    rows = spark.createDataFrame([("/r",), ("/r/a",), ("/r/sub/x",), ("/rx",), (None,)], "cwd string")
    inside, later = filters.in_scope(rows, "/r", spark.createDataFrame([("/r/sub",)], "root string"))
    assert {r["cwd"] for r in inside.collect()} == {"/r", "/r/a"} and later.count() == 1
    assert "NestedLoop" not in inside._jdf.queryExecution().toString()


def test_events_are_redacted_and_limited(spark):
    rows = [("1", "t", "s", T0, "token=abcdefgh " + "x" * 50, None, "b", "c")]
    df = spark.createDataFrame(rows, "event_id string, tool string, session_id string, ts timestamp, prompt string, identity string, branch string, commit string")
    r = filters.to_events(df, "repo", "device", Policy(prompt_bytes=40)).first()
    assert r["prompt"].startswith("token=[REDACTED]") and r["prompt"].endswith("[TRUNCATED]") and r["truncated"] and r["identity"] == "device" and len(r["prompt"].encode()) <= 40


def _matched(direct, recovered, minutes):
    """The most pairs, by trying all."""

    def best(i, used):
        if i == len(direct):
            return 0
        most = best(i + 1, used)
        for j, t in enumerate(recovered):
            if j not in used and abs(direct[i] - t) <= minutes:
                most = max(most, 1 + best(i + 1, used | {j}))
        return most

    return best(0, frozenset())


def test_one_to_one_is_largest(spark):
    rng = random.Random(2)
    d, r, cases = [], [], {}
    for k in range(60):
        a, b = ([rng.randrange(60) for _ in range(rng.randrange(6))] for _ in range(2))
        cases[k] = (a, b)
        d += [(f"d{k}-{i}", k, T0 + timedelta(minutes=t)) for i, t in enumerate(a)]
        r += [(f"r{k}-{i}", k, T0 + timedelta(minutes=t)) for i, t in enumerate(b)]
    schema = "id string, k int, ts timestamp"
    direct, recovered = spark.createDataFrame([*d, ("n", None, T0)], schema), spark.createDataFrame([*r, ("m", None, T0)], schema)
    pairs = matching.correlate(direct, recovered, ["k"], 600_000_000).collect()
    when = {i: t for i, _, t in d + r}
    assert len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == len(pairs)
    assert all(abs(when[a] - when[b]) <= timedelta(minutes=10) for a, b in pairs)
    for k, (a, b) in cases.items():
        assert sum(p[0].startswith(f"d{k}-") for p in pairs) == _matched(a, b, 10)
    left = matching.unmatched(recovered, spark.createDataFrame(pairs, "direct_id string, recovered_id string"))
    assert left.count() == len(r) + 1 - len(pairs)


def test_one_to_one_with_a_hot_key(spark):
    """One key with most rows, both sides dense, dealt over several parts: the pairs of two pointers over all of it."""
    rng = random.Random(5)
    rows = [(i, 1 if i % 10 else i, rng.randrange(4_000_000)) for i in range(3000)]
    frame = lambda odd: spark.createDataFrame([(i, k, t) for i, k, t in rows if i % 2 == odd], "id long, k long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") / 1000))
    for micros in (200_000, 20_000_000):
        want = []
        for key in {k for _, k, _ in rows}:
            a, b = (sorted((t, i) for i, k, t in rows if k == key and i % 2 == odd) for odd in (0, 1))
            i = j = 0
            while i < len(a) and j < len(b):
                if abs(a[i][0] - b[j][0]) * 1000 <= micros:
                    want.append((a[i][1], b[j][1]))
                    i, j = i + 1, j + 1
                elif a[i][0] < b[j][0]:
                    i += 1
                else:
                    j += 1
        got = matching.correlate(frame(0), frame(1), ["k"], micros)
        assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)
        pairs = {(i, j) for i, k, t in rows for j, q, u in rows if i % 2 == 0 and j % 2 == 1 and k == q and abs(t - u) * 1000 <= micros} if micros < 10**6 else None
        assert pairs is None or set(map(tuple, matching.candidates(frame(0), frame(1), ["k"], micros).collect())) == pairs


def test_direct_at_0_and_12_recovered_at_11(spark):
    schema = "id int, k int, ts timestamp"
    d = spark.createDataFrame([(1, 1, T0), (2, 1, T0 + timedelta(minutes=12))], schema)
    r = spark.createDataFrame([(3, 1, T0 + timedelta(minutes=11))], schema)
    assert [tuple(p) for p in matching.correlate(d, r, ["k"], 600_000_000).collect()] == [(2, 3)]


def test_aliases_pair_no_copies(spark):
    """Against counting all pairs; ids under several texts and nulls included. Two sides of 50 000 copies end soon."""
    rng = random.Random(4)
    old = [(rng.choice([None, *range(25)]), rng.randrange(30)) for _ in range(40)]
    events = [(rng.choice([None, *range(25)]), rng.randrange(30)) for _ in range(40)]
    pairs = [(a, b) for x, a in old for y, b in events if x is not None and x == y]
    want = sorted((a, b) for a, b in pairs if sum(p[0] == a for p in pairs) == 1 == sum(p[1] == b for p in pairs))
    frame = lambda rows, name: spark.createDataFrame(rows, f"h int, {name} long")
    assert want and sorted(map(tuple, matching.aliases(frame(old, "old_id"), frame(events, "event_id"), "h").collect())) == want
    many = spark.range(50_000)
    start = time.monotonic()
    got = matching.aliases(many.selectExpr("if(id = 0, 1, 0) h", "id old_id"), many.selectExpr("if(id = 7, 1, 0) h", "id event_id"), "h").collect()
    assert [tuple(r) for r in got] == [(0, 7)] and time.monotonic() - start < 60


def test_budget(spark):
    rows = [(i, "x" * n) for i, n in enumerate((50, 10, 10, 10, 10))]
    df = spark.createDataFrame(rows, "n int, prompt string")
    ids = lambda p, d=df: [r["n"] for r in budget.within_budget(d, ["n"], p).orderBy("n").collect()]
    assert ids(Policy(batch_rows=3)) == [0, 1, 2] and ids(Policy(batch_bytes=70)) == [0, 1, 2] and ids(Policy(batch_bytes=20)) == [0]
    noise = df.where("n < 3")
    assert [r["n"] for r in budget.reserved_budget(df, [noise], ["n"], ["n"], Policy(batch_rows=1)).collect()] == [3]


def budget_by_hand(rows, most, room):
    """rows (order, size): how many of each go."""
    taken, upto = [], 0
    for i, (n, size) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        upto += size
        if i >= most or (upto > room and i):
            break
        taken.append((n, size))
    return taken


def test_budget_of_repeats_nulls_and_clashing_columns(spark):
    """Any number of equal rows, null order, null texts: as many go as fit, copy by copy."""
    rng = random.Random(4)
    for most, room in ((1, 1), (7, 10_000), (1000, 50), (1000, 0 + 1), (12, 30), (1000, 10_000)):
        rows = [(rng.choice([None, *range(6)]), rng.randrange(4)) for _ in range(60)] + [(3, 2)] * 25
        df = spark.createDataFrame([(n, "x" * k if k else None, n, {"m": 1}) for n, k in rows], "n int, prompt string, _at int, extra map<string,int>").repartition(5)
        got = budget.within_budget(df, ["n"], Policy(batch_rows=most, batch_bytes=room)).collect()
        # ties within one order go by the rows' digests, so sizes within it may be dealt otherwise
        assert all(set(r.asDict()) == {"n", "prompt", "_at", "extra"} for r in got)
        sizes = sorted(len(r["prompt"] or "") for r in got)
        assert len(got) <= most and (sum(sizes) <= room or len(got) == 1)
        order = lambda n: (n is not None, n or 0)
        last = max((order(r["n"]) for r in got), default=None)
        if last:  # all before the last order go, and what stays could not have gone next
            before = [k for n, k in rows if order(n) < last]
            assert len([r for r in got if order(r["n"]) < last]) == len(before)
        if len({k for _, k in rows}) == 1:
            assert len(got) == len(budget_by_hand(rows, most, room))
    one_size = spark.createDataFrame([(i % 7, "ab") for i in range(100)], "n int, prompt string")
    for most, room in ((9, 1000), (1000, 31), (1, 1), (3, 4)):
        got = budget.within_budget(one_size, ["n"], Policy(batch_rows=most, batch_bytes=room)).collect()
        assert sorted(r["n"] for r in got) == sorted(n for n, _ in budget_by_hand([(i % 7, 2) for i in range(100)], most, room))
    assert budget.within_budget(one_size.limit(0), ["n"]).count() == 0


def test_budget_moves_no_text_before_the_cut(spark, monkeypatch):
    """3 GB of prompts of a MiB each, in a session of 4 GB: only places and sizes are dealt and summed up."""
    written = []
    save = budget.Scratch.save
    monkeypatch.setattr(budget.Scratch, "save", lambda self, df: written.append(df.columns) or save(self, df))
    df = spark.range(0, 3000, 1, 8).select((3000 - F.col("id")).alias("n"), F.repeat(F.lit("x"), 1 << 20).alias("prompt"))
    taken = budget.within_budget(df, ["n"])
    assert sorted(r["n"] for r in taken.select("n", F.length("prompt")).collect()) == list(range(1, 65))
    assert written and not any("prompt" in c for c in written)
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "TakeOrdered" not in plan


def test_status_shows_zero(spark):
    events = spark.createDataFrame([("a", T0), ("b", T0 - timedelta(days=9))], "tool string, ts timestamp")
    found = reports.status(events, spark.createDataFrame([("a",), ("b",), ("c",)], "tool string"))
    got = {r["tool"]: (r["n"], r["silent"]) for r in reports.silent(found, F.expr("interval 7 days")).collect()}
    assert got == {"a": (1, False), "b": (1, True), "c": (0, True)}


def test_log_is_in_order(spark):
    rows = [(T0 + timedelta(minutes=(7 * i) % 10), f"e{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "ts timestamp, event_id string").repartition(4)
    assert [r["event_id"] for r in reports.listing(df, ["event_id"]).collect()] == [e for _, e in sorted(rows)]
    lines = spark.createDataFrame([(p, i) for p in "ba" for i in (3, 1, 2)], "path string, offset long").repartition(4)
    assert [tuple(r) for r in reports.in_file_order(lines).collect()] == [(p, i) for p in "ab" for i in (1, 2, 3)]


def test_kinds_markers_and_publication(spark):
    rows = spark.createDataFrame([("SessionStart", "t", "u", "r", "m"), ("Other", "t", "u", "r", None), ("UserPromptSubmit", "x", "u", "r", "m")], "hook_event_name string, tool string, identity string, repo string, mark string")
    assert filters.of_kinds(rows).count() == 2 and filters.with_markers(rows, ["mark", "tool"]).count() == 2
    assert filters.publishable(rows, ["t"], "u", "r").count() == 2 and filters.publishable(rows, ["t"], "v", "r").count() == 0
    assert filters.conform(spark.createDataFrame([("x",)], "sessionId string"), {"sessionId": "session_id", "other": "y"}).columns == ["session_id"]
    ids = spark.createDataFrame([("p", "t", "s", T0), (None, "t", "s", T0), (None, None, "s", T0)], "prompt_id string, turn_id string, session_id string, ts timestamp")
    assert [r[0] for r in ids.select(fx.native_id()).collect()] == ["p", "t", "s/2024-01-01 00:00:00"]


def test_manifest(spark):
    m = spark.createDataFrame([(f"p{i}", f"h{i}") for i in range(6)], "path string, sha256 string")
    assert matching.manifest_ok(m, m).first()[0]
    assert not matching.manifest_ok(m, m.where("path <> 'p1'")).first()[0]
    assert not matching.manifest_ok(m.where("path <> 'p1'"), m.where("path <> 'p1'")).first()[0]


def test_files(spark, tmp_path):
    (tmp_path / "SHA256SUMS").write_text("a" * 64 + "  x/y\nbad\n")
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "SHA256SUMS")).collect()] == [("x/y", "a" * 64)]
    (tmp_path / "q").mkdir()
    for i in range(3):
        (tmp_path / f"q/{i}.json").write_text('{"event_id":\n"%d"}' % i)
    assert files.read_pending(spark, str(tmp_path / "q")).count() == 3
    (tmp_path / "t.jsonl").write_text("{}\ntorn")
    torn = filters.torn_tails(files.read_files(spark, str(tmp_path / "t.jsonl"))).first()
    assert (torn["n_bytes"], torn["sha256"]) == (4, hashlib.sha256(b"torn").hexdigest())
    state = spark.createDataFrame([(torn["path"], 3, hashlib.sha256(b"{}\n").hexdigest()), ("gone", 1, "x")], "path string, n_bytes long, sha256 string")
    assert {r["path"]: r["holds"] for r in matching.prefixes_hold(files.read_files(spark, str(tmp_path / "t.jsonl")), state).collect()} == {torn["path"]: True, "gone": False}
    with pytest.raises(ValueError):
        files.write_quarantine(spark.createDataFrame([("x",)], "prompt string"), str(tmp_path / "bad"))
    events = spark.createDataFrame([("1", "t", "u1", T0), ("2", "t", "u2", T0)], "event_id string, tool string, identity string, ts timestamp")
    files.rebuild_registry(events, str(tmp_path / "registry"))
    files.rebuild_registry(events, str(tmp_path / "registry"))
    assert spark.read.json(str(tmp_path / "registry")).count() == 2 and (tmp_path / "registry/user=u1").is_dir()


def test_readers_of_lines_store_and_policy(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r["raw"] for r in files.read_lines(spark, str(tmp_path / "a.jsonl")).collect()) == ["", '{"x": 1}', '{"x": 2}']
    (tmp_path / "policy.json").write_text('{"retention_days": 30, "redact": true}')
    assert files.read_policy(spark, str(tmp_path / "policy.json")) == Policy(retention_days=30)
    files.append_store(spark.createDataFrame([("1",)], "event_id string"), str(tmp_path / "store"))
    files.append_store(spark.createDataFrame([("2",)], "event_id string"), str(tmp_path / "store"), "recovered")
    assert {tuple(r) for r in files.read_store(spark, str(tmp_path / "store")).collect()} == {("1", "direct"), ("2", "recovered")}
    with pytest.raises(ValueError):
        files.append_store(spark.createDataFrame([("3",)], "event_id string"), str(tmp_path / "store"), "other")


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a", 7, 8, 9), (1, "bb", 7, 8, 9)], "n int, prompt string, _rn int, _bytes int, upto int")
    assert [tuple(r) for r in matching.first_per_id(df, ["n"], [F.col("prompt").desc()]).collect()] == [(1, "bb", 7, 8, 9)]
    assert budget.within_budget(df, ["prompt"], Policy(batch_rows=1)).collect()[0].asDict() == {"n": 1, "prompt": "a", "_rn": 7, "_bytes": 8, "upto": 9}


def test_tail_reads_pieces_once(tmp_path, monkeypatch):
    p = tmp_path / "a.jsonl"
    lines = [f"line {i} " + "é" * (i % 30) + "\r" * (i % 3) for i in range(500)]
    p.write_bytes(("\n".join(lines) + "\n" + "torn").encode())
    raw = p.read_bytes()
    reader = TailReader({"path": str(tmp_path / "*.jsonl"), "pieceBytes": "777"})
    to = reader.latestOffset()
    pieces = reader.partitions({}, to)
    assert len(pieces) > 5 and [r[2] for q in pieces for r in reader.read(q)] == lines
    with p.open("a") as f:
        f.write(" no more\nnext\n")
    later = reader.latestOffset()
    assert [r[2] for q in reader.partitions(to, later) for r in reader.read(q)] == ["torn no more", "next"]
    (tmp_path / "link.jsonl").symlink_to(p)
    assert list(reader.latestOffset()) == [str(p)]
    with pytest.raises(ValueError):
        list(reader.read(Piece(str(tmp_path / "link.jsonl"), 0, 5)))
    (tmp_path / "b").write_bytes(b"other\n" + raw)
    os.replace(tmp_path / "b", p)
    assert reader.partitions(later, reader.latestOffset())[0].start == 0

    def refuse(*_, **__):
        raise AssertionError("the driver opened a file")

    with monkeypatch.context() as m:
        m.setattr(tail.os, "open", refuse)
        m.setattr("builtins.open", refuse)
        assert reader.partitions({}, reader.latestOffset())


def test_lines_have_their_digests(tmp_path):
    """The digest up to a line is that of the bytes from the first line on, for pieces that begin within a line, too."""
    p, lines = tmp_path / "a", ["a" * 40, "", "é" * 30, "x" * 100, "end"]
    raw = ("\n".join(lines) + "\n").encode()
    p.write_bytes(raw)
    for start in range(0, len(raw)):
        for path, first, offset, end, text, n, sha, upto in tail.lines_in(str(p), start, len(raw), 90):
            body = raw[offset : end - 1]
            assert (n, sha, upto) == (len(body), hashlib.sha256(body).hexdigest(), hashlib.sha256(raw[first:end]).hexdigest())
            assert text == (body.decode() if n <= 90 else None) and raw[end - 1 : end] == b"\n" and (first == 0 or raw[first - 1 : first] == b"\n")
    halves = [r[2] for a in (0, 75) for r in tail.lines_in(str(p), a, 75 if a == 0 else len(raw), 90)]
    assert halves == [r[2] for r in tail.lines_in(str(p), 0, len(raw), 90)]


def test_tail_fails_rather_than_skips(tmp_path, monkeypatch):
    """A file that can't be read for a moment fails the batch; the retry has its bytes."""
    p = tmp_path / "a.jsonl"
    p.write_text("one\n")
    reader = TailReader({"path": str(tmp_path / "*.jsonl")})
    old = reader.latestOffset()
    with p.open("a") as f:
        f.write("two\n")
    new = reader.latestOffset()

    def refuse(path, *_):
        raise OSError(path)

    assert reader.partitions(new, new) == []
    with monkeypatch.context() as m:
        m.setattr(tail, "_open", refuse)
        with pytest.raises(OSError):
            list(reader.read(reader.partitions(old, new)[0]))
    assert [r[2] for q in reader.partitions(old, new) for r in reader.read(q)] == ["two"]
    cut = Piece(str(p), 0, 100)
    with pytest.raises(ValueError):
        list(reader.read(cut))


def _line(i, **more):
    return json.dumps({k: f"{k}{i}" for k in EVENT_FIELDS if k != "ts"} | {"ts": "2024-01-01T00:00:00Z"} | more)


def test_recovery(spark, tmp_path):
    src, store, bad = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "bad")
    src.mkdir()
    f = src / "a.jsonl"
    f.write_text("\n".join(_line(i) for i in range(5)) + "\n" + _line(5, response="secret") + "\n" + _line(6)[:20])
    run = lambda check: rec.recover(spark, str(src / "*.jsonl"), store, bad, str(tmp_path / check))
    ids = lambda: sorted(r["event_id"] for r in spark.read.parquet(store).collect())
    assert run("c1") and ids() == [f"event_id{i}" for i in range(5)]
    with f.open("a") as out:
        out.write(_line(6)[20:] + "\n" + _line(7) + "\n")
    assert run("c1") and ids() == [f"event_id{i}" for i in (0, 1, 2, 3, 4, 6, 7)]
    assert run("c2") and len(ids()) == 7  # the checkpoint is lost: a full scan adds nothing
    f.write_text(_line(0) + "\n" + _line(8) + "\n")
    assert run("c1") and len(ids()) == 8  # the file was rewritten
    evidence = spark.read.parquet(bad)
    assert evidence.count() == 1 and set(evidence.columns) == {"path", "line_no", "n_bytes", "sha256", "reason"}
    assert not any("secret" in str(r) for r in evidence.collect())


def _pass(spark, tmp_path, rules=rec.Recovery(), health=None):
    return rec.recover_pass(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), rec.State(spark, str(tmp_path / "state")), rules, health)


def _ids(spark, tmp_path):
    return sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "store")).collect())


def _write(tmp_path, name, *lines):
    (tmp_path / "src").mkdir(exist_ok=True)
    with (tmp_path / "src" / name).open("a") as f:
        f.write("".join(x + "\n" for x in lines))


def test_no_raw_secret_is_stored(spark, tmp_path):
    """Neither store, evidence nor state has a secret; other roles are no evidence; what is alarming is in the health log."""
    secret = "token=abcdefghij"
    _write(tmp_path, "a.jsonl", _line(1, prompt=f"my {secret} here"), _line(2, response=secret), _line(3, role="assistant", response=secret), _line(4, role="user"), '{"torn ' + secret)
    got = _pass(spark, tmp_path, health=str(tmp_path / "health"))
    assert (got["appended"], got["refused"]) == (2, 2) and _ids(spark, tmp_path) == ["event_id1", "event_id4"]
    text = [str(r) for part in ("store", "bad") for r in spark.read.parquet(str(tmp_path / part)).collect()]
    assert not any("abcdefghij" in t for t in text) and any("token=[REDACTED]" in t for t in text)
    assert {r["code"] for r in spark.read.parquet(str(tmp_path / "health")).collect()} == {"PARTIAL_TRANSCRIPT", "QUARANTINED"}
    step = rec.append_batch(str(tmp_path / "store2"), str(tmp_path / "bad2"))
    step(spark.createDataFrame([("p", 0, _line(1, prompt=secret), 9, "x")], "path string, offset long, raw string, n_bytes long, sha256 string"), 0)
    assert spark.read.parquet(str(tmp_path / "store2")).first()["prompt"] == "token=[REDACTED]"


def test_noise_does_not_starve(spark, tmp_path):
    """Known ids and direct captures use up no budget; the cursor stays at the first line that waits."""
    noise = [_line(i) for i in range(20)]
    direct = spark.createDataFrame([(f"own{i}", "tool", "session_id", T0 + timedelta(minutes=3), f"said {i}", "u", "r", "b", "c") for i in range(5)], rec.EVENT_SCHEMA)
    files.append_store(direct, str(tmp_path / "store"))
    stored = [_line(i, tool="tool") for i in range(20)]
    files.append_store(spark.createDataFrame([(f"event_id{i}", "tool", "s", T0, "p", "u", "r", "b", "c") for i in range(20)], rec.EVENT_SCHEMA), str(tmp_path / "store"), "recovered")
    echoes = [_line(100 + i, tool="tool", session_id="session_id", prompt=f"said {i}") for i in range(5)]
    _write(tmp_path, "a.jsonl", *stored, *echoes, *[_line(i, tool="tool") for i in range(200, 205)])
    rules = rec.Recovery(policy=Policy(batch_rows=2))
    state = rec.State(spark, str(tmp_path / "state"))
    got = _pass(spark, tmp_path, rules)
    assert got["appended"] == 2 and got["deferred"] == 3 and {"event_id200", "event_id201"} <= set(_ids(spark, tmp_path))
    whole = "\n".join([*stored, *echoes, *[_line(i, tool="tool") for i in range(200, 202)]]).encode() + b"\n"
    assert {r["path"]: r["offset"] for r in tail.cursors(state.read()[0]).collect()} == {str(tmp_path / "src" / "a.jsonl"): len(whole)}
    assert {(r["old_id"], r["event_id"]) for r in state.read()[1].collect()} == {(f"event_id{100 + i}", f"own{i}") for i in range(5)}
    assert [_pass(spark, tmp_path, rules)["appended"] for _ in range(3)] == [2, 1, 0]
    assert len(_ids(spark, tmp_path)) == len(set(_ids(spark, tmp_path))) == 30
    # a direct capture that turns up under its own id voids its alias: all is scanned again, and its echo is an event
    _write(tmp_path, "a.jsonl", json.dumps(json.loads(_line(0)) | {"event_id": "own0", "tool": "tool"}))
    assert _pass(spark, tmp_path, rules)["voided"] == 1 and state.read()[0].count() == 0
    _pass(spark, tmp_path, rules)
    assert "event_id100" in _ids(spark, tmp_path) and noise


def test_unknown_folders_are_deferred(spark, tmp_path):
    """A line without a folder is tried again and holds the cursor; lines of other repositories are done."""
    rules = rec.Recovery(root="/r", nested=("/r/sub",))
    _write(tmp_path, "a.jsonl", _line(1, cwd="/r/x"), _line(2, cwd="/other"), _line(3, cwd="/r/sub/y"), _line(4), _line(5, cwd="/r"))
    got = _pass(spark, tmp_path, rules)
    assert got["deferred"] == 1 and _ids(spark, tmp_path) == ["event_id1", "event_id5"]
    at = [r["offset"] for r in tail.cursors(rec.State(spark, str(tmp_path / "state")).read()[0]).collect()]
    assert at == [len("".join(x + "\n" for x in (_line(1, cwd="/r/x"), _line(2, cwd="/other"), _line(3, cwd="/r/sub/y"))))]
    assert _pass(spark, tmp_path, rules)["deferred"] == 1 and len(_ids(spark, tmp_path)) == 2
    src = tmp_path / "src" / "a.jsonl"
    src.write_text(src.read_text().replace(_line(4), _line(4, cwd="/r/z")))  # now it is known
    assert _pass(spark, tmp_path, rules)["appended"] == 1 and _ids(spark, tmp_path) == ["event_id1", "event_id4", "event_id5"]


def test_crash_before_the_cursor_moves(spark, tmp_path, monkeypatch):
    """The store has the events, the state does not: the next pass appends nothing twice and moves on."""
    _write(tmp_path, "a.jsonl", *[_line(i) for i in range(4)])

    def die(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(rec.State, "write", die)
        with pytest.raises(RuntimeError):
            _pass(spark, tmp_path)
    assert len(_ids(spark, tmp_path)) == 4 and rec.State(spark, str(tmp_path / "state")).versions() == []
    assert _pass(spark, tmp_path)["appended"] == 0 and len(_ids(spark, tmp_path)) == 4
    assert rec.State(spark, str(tmp_path / "state")).read()[0].count() == 1


def test_lines_without_an_id_are_passed_over(spark, tmp_path):
    """A null or nested id is evidence, and recovery ends and goes on behind it; a leak in the prompt's place is not stored."""
    leak = json.dumps({"event_id": "2", "tool": "t", "session_id": "s", "prompt": {"prompt": "a", "response": "leak"}})
    _write(tmp_path, "a.jsonl", _line(1), _line(2, event_id=None), _line(3, event_id={"x": 1}), leak, _line(4))
    run = lambda: rec.recover(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "state"), timeout=120)
    assert run() and _ids(spark, tmp_path) == ["event_id1", "event_id4"]
    _write(tmp_path, "a.jsonl", _line(5))
    assert run() and _ids(spark, tmp_path) == ["event_id1", "event_id4", "event_id5"]
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["null", "type", "type"]
    assert not any("leak" in str(r) for part in ("store", "bad") for r in spark.read.parquet(str(tmp_path / part)).collect())


def test_events_without_an_id_are_not_new_twice(spark):
    e = spark.createDataFrame([("t", None), ("t", "1"), (None, "1")], "tool string, event_id string")
    assert matching.new_events(e, e.limit(0)).count() == 3 and matching.new_events(e, e).count() == 0


def test_rewrites_are_found_by_digest(spark, tmp_path):
    """A file rewritten in place, no shorter and under the same name, is read again from its start."""
    _write(tmp_path, "a.jsonl", _line(1), _line(2))
    _pass(spark, tmp_path)
    src = tmp_path / "src" / "a.jsonl"
    with src.open("r+") as f:
        f.write(_line(7) + "\n" + _line(2) + "\n" + _line(8) + "\n")
    got = _pass(spark, tmp_path)
    assert got["rescanned"] == 1 and got["appended"] == 2 and _ids(spark, tmp_path) == [f"event_id{i}" for i in (1, 2, 7, 8)]


def test_one_runner_and_its_cadence(spark, tmp_path):
    _write(tmp_path, "a.jsonl", _line(1))
    run = lambda **more: rec.recover(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "state"), **more)
    state = rec.State(spark, str(tmp_path / "state"))
    lease = state.lease(300)
    assert lease and not state.lease(300) and not run()
    lease.release()
    assert run() and _ids(spark, tmp_path) == ["event_id1"]
    _write(tmp_path, "a.jsonl", _line(2))
    assert run(throttled=True) and len(_ids(spark, tmp_path)) == 1
    assert run() and len(_ids(spark, tmp_path)) == 2


def test_transcripts_of_three_shapes(spark, tmp_path):
    """Clients whose lines nest their fields otherwise give equal events; what else a line has is not stored."""
    from tallyrook.sources.adapters import Adapter, Place

    P = lambda *paths, **more: Place(paths, **more)
    adapters = (
        Adapter("flat", "/flat[.]jsonl$", "$.kind", ("user",), {"event_id": P("$.id"), "session_id": P("$.session"), "ts": P("$.at"), "prompt": P("$.text"), "cwd": P("$.dir")}),
        Adapter("deep", "/deep[.]jsonl$", "$.type", ("user",), {"event_id": P("$.uuid"), "session_id": P("$.sessionId"), "ts": P("$.timestamp"), "prompt": P("$.message.content"), "cwd": P("$.cwd"), "branch": P("$.git.branch")}),
        Adapter("parts", "/parts[.]jsonl$", "$.payload.type", ("message",), {"session_id": P("$.payload.sid"), "ts": P("$.t"), "prompt": P("$.payload.content", kinds=("input_text",)), "cwd": P("$.payload.cwd")}),
    )
    t = "2024-01-01T00:00:00Z"
    flat = {"kind": "user", "id": "1", "session": "s", "at": t, "text": "hello token=abcdefgh", "dir": "/r", "response": "leak"}
    deep = {"type": "user", "uuid": "2", "sessionId": "s", "timestamp": t, "message": {"role": "user", "content": "hello token=abcdefgh"}, "cwd": "/r/x", "git": {"branch": "main"}, "toolUseResult": "leak"}
    part = lambda kind, text: {"type": kind, "text": text}
    parts = {"t": t, "payload": {"type": "message", "sid": "s", "cwd": "/r", "content": [part("input_text", "hello token=abcdefgh"), part("output", "leak")]}}
    _write(tmp_path, "flat.jsonl", *map(json.dumps, (flat, flat | {"kind": "assistant", "id": "9"}, flat | {"id": "8", "text": {"text": "leak"}}, flat | {"id": "7", "at": "soon"})), "{torn leak")
    _write(tmp_path, "deep.jsonl", *map(json.dumps, (deep, deep | {"type": "tool", "uuid": "9"}, deep | {"uuid": "6", "message": {"content": [part("tool_result", "leak")]}})))
    _write(tmp_path, "parts.jsonl", json.dumps(parts), json.dumps({"t": t, "payload": {"type": "reasoning", "text": "leak"}}))
    _write(tmp_path, "own.jsonl", _line(5, cwd="/r"))
    got = _pass(spark, tmp_path, rec.Recovery(root="/r", adapters=adapters))
    rows = {r["event_id"]: r for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert set(rows) == {"1", "2", f"s/{t}", "event_id5"} and {r["prompt"] for i, r in rows.items() if i != "event_id5"} == {"hello token=[REDACTED]"}
    assert {i: r["tool"] for i, r in rows.items() if i != "event_id5"} == {"1": "flat", "2": "deep", f"s/{t}": "parts"} and rows["2"]["branch"] == "main" and rows["1"]["ts"] == T0
    assert got["refused"] == 4 and sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["malformed", "missing", "missing", "time"]
    assert not any("leak" in str(r) for p in ("store", "bad") for r in spark.read.parquet(str(tmp_path / p)).collect())
    with pytest.raises(ValueError):
        Adapter("x", "y", "$.k", (), {"response": P("$.r")})


def test_the_queue_is_merged_first(spark, tmp_path):
    """Queued events are direct captures: their echo in a transcript is no event of its own; asked again, nothing is added."""
    (tmp_path / "pending").mkdir()
    for i, line in enumerate([_line(1, tool="t", session_id="s", prompt="said token=abcdefgh"), _line(1, tool="t", session_id="s", prompt="said token=abcdefgh"), _line(2, response="leak"), "{torn"]):
        (tmp_path / "pending" / f"{i}.json").write_text(line)
    _write(tmp_path, "a.jsonl", _line(50, tool="t", session_id="s", prompt="said token=abcdefgh"), _line(51, tool="t"))
    run = lambda: rec.recover(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "state"), pending=str(tmp_path / "pending"))
    assert run() and run() and _ids(spark, tmp_path) == ["event_id1", "event_id51"]
    rows = {r["event_id"]: r for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert rows["event_id1"]["origin"] == "direct" and rows["event_id1"]["prompt"] == "said token=[REDACTED]"
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["malformed", "unknown"]
    assert rec.merge_queue(spark, str(tmp_path / "nowhere"), str(tmp_path / "store"), str(tmp_path / "bad")) == 0


def test_leases_exclude(spark, tmp_path):
    """A run whose lease was taken over can't end its successor's, nor write; of many that ask, one gets it."""
    from concurrent.futures import ThreadPoolExecutor

    states = [rec.State(spark, str(tmp_path / "state")) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        got = [x for x in pool.map(lambda s: s.lease(300), states) if x]
    assert len(got) == 1 and got[0].holds()
    os.utime(tmp_path / "state" / "leases" / "1", (1, 1))
    second = states[1].lease(300)
    assert second.holds() and not got[0].holds()
    got[0].release()
    assert second.holds() and states[2].lease(300) is None
    ranges, aliases, backups = states[3].read()
    with pytest.raises(rec.Superseded):
        states[3].write(ranges, aliases, backups, got[0])
    second.release()
    assert states[2].lease(300).holds()


def test_versions_are_compared_and_set(spark, tmp_path):
    """Two runs that began with the same version: the first writes it, the second fails, and nothing is lost."""
    a, b = rec.State(spark, str(tmp_path / "s")), rec.State(spark, str(tmp_path / "s"))
    ranges, aliases, _ = a.read()
    b.read()
    mine = spark.createDataFrame([("p", 0, 1, "x")], ranges.schema)
    a.write(mine, aliases)
    with pytest.raises(rec.Superseded):
        b.write(ranges, aliases)
    assert b.read()[0].count() == 1 and b.base == 1
    b.write(ranges, aliases)
    assert a.read()[0].count() == 0 and a.versions() == [2]
    (tmp_path / "s" / "versions" / "v=3").write_text("")  # a writer died within it
    assert a.read()[0].count() == 0 and a.base == 3
    a.write(mine, aliases)
    assert a.read()[0].count() == 1 and a.versions() == [4]


def test_superseded_run_appends_nothing(spark, tmp_path, monkeypatch):
    _write(tmp_path, "a.jsonl", _line(1))
    monkeypatch.setattr(rec.Lease, "holds", lambda self: False)
    assert not rec.recover(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "state"))
    assert not (tmp_path / "store").exists()


def test_watchdog_stops_between_jobs(spark, tmp_path, monkeypatch):
    """Jobs that begin after the watchdog fail at once, and no step follows."""
    _write(tmp_path, "a.jsonl", *[_line(i) for i in range(3)])
    slow = rec.append_evidence
    monkeypatch.setattr(rec, "append_evidence", lambda *a: time.sleep(8) or slow(*a))
    run = lambda **more: rec.recover(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "state"), **more)
    began = time.time()
    assert not run(timeout=7) and time.time() - began < 25 and not (tmp_path / "store").exists()
    monkeypatch.setattr(rec, "append_evidence", slow)
    assert run() and len(_ids(spark, tmp_path)) == 3


def test_history_is_read_once(spark, tmp_path, monkeypatch):
    """recover() authenticates what was taken once, however many passes it makes; ranges become one for each chunk."""
    for n in range(4):
        _write(tmp_path, "a.jsonl", *[_line(10 * n + i) for i in range(10)])
        _pass(spark, tmp_path)
    src, state = tmp_path / "src" / "a.jsonl", rec.State(spark, str(tmp_path / "state"))
    size, seen, real = src.stat().st_size, [], rec.recover_pass
    assert state.read()[0].count() == 2  # one for all but the last pass
    monkeypatch.setattr(rec, "recover_pass", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    _write(tmp_path, "a.jsonl", *[_line(100 + i) for i in range(5)])
    assert rec.recover(spark, str(src), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "state"), rec.Recovery(policy=Policy(batch_rows=2)))
    assert len(seen) == 4 and sum(d["authenticated"] for d in seen) == size and len(_ids(spark, tmp_path)) == 45
    _pass(spark, tmp_path)
    held = state.read()[0].collect()
    assert [(r["start"], r["end"], r["sha256"]) for r in held] == [(0, src.stat().st_size, hashlib.sha256(src.read_bytes()).hexdigest())]


def test_chunks_are_checked_one_by_one(spark, tmp_path):
    p = tmp_path / "f"
    p.write_bytes(bytes(range(256)) * 40)
    digest = lambda a, b: hashlib.sha256(p.read_bytes()[a:b]).hexdigest()
    cuts = [0, 300, 900, 1000, 2500, 4096, 5000, 9000]
    known = spark.createDataFrame([(str(p), a, b, digest(a, b)) for a, b in zip(cuts, cuts[1:])] + [(str(tmp_path / "gone"), 0, 5, "x")], "path string, start long, `end` long, sha256 string")
    found = lambda: sorted(tuple(r) for r in tail.authenticated(known, 1000).collect() if r["path"] == str(p))
    assert [(a, b, h, n, ok) for _, a, b, h, n, ok in found()] == [(a, b, digest(a, b), b - a, True) for a, b in ((0, 1000), (1000, 2500), (2500, 4096), (4096, 5000), (5000, 9000))]
    assert not any(r["ok"] for r in tail.authenticated(known, 1000).collect() if r["path"] != str(p))
    with p.open("r+b") as f:
        f.seek(3000)
        f.write(b"!")
    assert [ok for *_, ok in found()] == [True, True, False, True, True]


def test_a_store_that_was_replaced_is_scanned_against_again(spark, tmp_path):
    """Files of the store that repeats were told by are gone: what was scanned is forgotten, and missing events come back."""
    import shutil

    _write(tmp_path, "a.jsonl", _line(1), _line(2))
    _pass(spark, tmp_path)
    assert _pass(spark, tmp_path)["appended"] == 0
    shutil.rmtree(tmp_path / "store")
    got = _pass(spark, tmp_path, health=str(tmp_path / "health"))
    assert got["appended"] == 2 and got["backup_moved"] == 1 and _ids(spark, tmp_path) == ["event_id1", "event_id2"]
    assert "BACKUP_CHANGED" in {r["code"] for r in spark.read.parquet(str(tmp_path / "health")).collect()}
    assert _pass(spark, tmp_path)["backup_moved"] == 0


def test_follow_reads_a_rewritten_file_again(spark, tmp_path):
    run = lambda: rec.follow(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "check"), every=()).awaitTermination()
    _write(tmp_path, "a.jsonl", _line(1), _line(2))
    _write(tmp_path, "b.jsonl", _line(3), _line(4))
    run()
    with (tmp_path / "src" / "a.jsonl").open("r+") as f:  # rewritten in place, and longer
        f.write(_line(7) + "\n" + _line(2) + "\n" + _line(8) + "\n")
    run()
    assert _ids(spark, tmp_path) == [f"event_id{i}" for i in (1, 2, 3, 4, 7, 8)]
    with (tmp_path / "src" / "b.jsonl").open("r+") as f:  # rewritten in place, no longer
        f.write(_line(9) + "\n")
    os.utime(tmp_path / "src" / "b.jsonl", (2e9, 2e9))
    run()
    assert _ids(spark, tmp_path) == [f"event_id{i}" for i in (1, 2, 3, 4, 7, 8, 9)]


def test_follow(spark, tmp_path):
    """The streaming query appends what files gain, each id once, and redacted."""
    run = lambda: rec.follow(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "check"), every=()).awaitTermination()
    _write(tmp_path, "a.jsonl", _line(1, prompt="secret=abcdefgh"), _line(2))
    run()
    _write(tmp_path, "a.jsonl", _line(2), _line(3))
    run()
    assert _ids(spark, tmp_path) == ["event_id1", "event_id2", "event_id3"]
    assert "abcdefgh" not in str(spark.read.parquet(str(tmp_path / "store")).collect())


def test_registry_is_read_strictly_and_rebuilt(spark, tmp_path):
    """A line with another field is left out, with its digest as evidence; rebuilding from the private store brings it back."""
    events = spark.createDataFrame([(str(i), "t", "s", T0 + timedelta(minutes=i), f"p{i}", f"u{i % 2}", "r", "b", "c") for i in range(8)], rec.EVENT_SCHEMA)
    path = str(tmp_path / "registry")
    files.rebuild_registry(events, path)
    found, bad = files.read_registry(spark, path)
    assert found.count() == 8 and bad.count() == 0
    part = next((tmp_path / "registry" / "user=u1").glob("*.json"))
    part.write_text(part.read_text() + json.dumps({"event_id": "9", "tool": "t", "prompt": "x", "response": "hidden"}) + "\n")
    (tmp_path / "registry" / "user=u1" / f".{part.name}.crc").unlink(missing_ok=True)
    found, bad = files.read_registry(spark, path)
    assert found.count() == 8 and [r["reason"] for r in bad.collect()] == ["unknown"] and "hidden" not in str(bad.collect())
    assert matching.compare(events, found, "event_id", "prompt").count() == 0
    files.rebuild_registry(events, path)
    assert files.read_registry(spark, path)[1].count() == 0 and not (tmp_path / "registry.new").exists() and not (tmp_path / "registry.old").exists()
    with pytest.raises(ValueError):
        files.rebuild_registry(events.withColumn("identity", F.lit("../x")), path)
    with pytest.raises(Exception, match="not a health code"):
        files.write_health(spark.createDataFrame([(T0, "free text")], "ts timestamp, code string"), str(tmp_path / "health"))


def test_crash_between_append_and_cursor(spark, tmp_path):
    """The batch is appended, then the query dies before its commit: the retry adds nothing."""
    store, bad = str(tmp_path / "store"), str(tmp_path / "bad")
    lines = spark.createDataFrame([("p", 0, _line(1), 9, "x"), ("p", 9, "{", 1, "y")], "path string, offset long, raw string, n_bytes long, sha256 string")
    step = rec.append_batch(store, bad, lambda df: df)
    step(lines, 0)
    step(lines, 0)
    assert spark.read.parquet(store).count() == 1 and spark.read.parquet(bad).count() == 1


@pytest.mark.parametrize("gone", [["tallyrook/llm", "tests/llm"], ["tallyrook/llm", "tests/llm", "corpus_pipeline.py"], ["tallyrook/llm/*.py", "tests/llm"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    """A copy without the corpus operators imports, lists the other queries, and pytest collects its tests."""
    import shutil
    import subprocess
    import sys

    home, to = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "copy"
    shutil.copytree(home, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        for path in to.glob(g):
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    code = "import __spark_entry__ as e; q = set(e.queries()); assert 'status_by_tool' in q and set(e.oracle_sql()) <= q; print(sorted(x for x in q if x.startswith('op') or x == 'pipeline'))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # else the copy's modules would come from here
    out = subprocess.run([sys.executable, "-W", "error", "-c", code], check=True, cwd=to, capture_output=True, text=True, env=env).stdout
    assert ("op1_secret_scan" in out) == (gone == ["corpus_pipeline.py"]) and "pipeline" not in out
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], check=True, cwd=to, capture_output=True, env=env)


def test_imports_without_optional_parts():
    """The library does not import its llm part."""
    import subprocess
    import sys

    code = "import sys, tallyrook.plans.registry, tallyrook.streaming.recover; assert not any(m.startswith('tallyrook.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
