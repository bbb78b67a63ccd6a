"""Envelopes of clients become direct captures."""

import json
from datetime import datetime, timezone

from tallyrook.streaming import recover as rec
from tallyrook.streaming.capture import Capture, capture_batch

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
RULES = Capture(floors={"one": "1.0.58"}, markers={"one": ("marker", "project")}, root="/repo", nested=("/repo/inner",))
KIND = "path string, line_no long, raw string, tool string, version string, marker string, project string, received timestamp, cwd string"


def _envelope(i, **more):
    return {"session_id": "s", "turn_id": f"t{i}", "cwd": "/repo/x", "permission_mode": "ask", "prompt": f"p{i}"} | more


def _lines(spark, rows):
    """(envelope, tool, version, marker, project)"""
    return spark.createDataFrame([("f", n, e if isinstance(e, str) or e is None else json.dumps(e), tool, v, m, p, T0, "clashes") for n, (e, tool, v, m, p) in enumerate(rows)], KIND)


def test_a_capture_step(spark, tmp_path):
    fine = ("one", "1.0.60", "m", "p")
    rows = [
        (_envelope(1), *fine), (_envelope(1), *fine), (_envelope(2, cwd="/repo/inner/y"), *fine), (_envelope(3, cwd="/repo/../etc"), *fine), (_envelope(4), "one", "1.0.57", "m", "p"),
        (_envelope(5), "one", "1.0.60", None, "p"), (_envelope(6), "two", None, None, None), (_envelope(7, agent_id="a"), *fine), (_envelope(8, response="leak"), *fine), (_envelope(9, hook_event_name="SessionStart"), *fine),
        (_envelope(10, prompt="token=abcdefgh", ts="2024-01-02T00:00:00Z", hook_event_name="UserPromptSubmit"), *fine), (_envelope(11, prompt=5), *fine), ("{", *fine), (None, *fine), (_envelope(12), None, "1", "m", "p"), (_envelope(13, prompt="x " * 900_000), *fine),
    ]
    store, bad, health = (str(tmp_path / n) for n in ("store", "bad", "health"))
    step = capture_batch(store, bad, RULES, health)
    lines = _lines(spark, rows)
    step(lines, 0)
    step(lines, 0)
    found = {r["event_id"]: r for r in spark.read.parquet(store).collect()}
    assert sorted(found) == ["t1", "t10", "t13", "t6"] and spark.read.parquet(store).count() == 4
    assert found["t10"]["prompt"] == "token=[REDACTED]" and found["t10"]["ts"].day == 2 and found["t1"]["ts"] == T0.replace(tzinfo=None) and found["t1"]["origin"] == "direct"
    assert len(found["t13"]["prompt"].encode()) <= 1 << 20
    evidence = spark.read.parquet(bad).collect()
    assert len(evidence) == 5 and "leak" not in str(evidence)
    assert {r["code"] for r in spark.read.parquet(health).collect()} == {"QUARANTINED", "PROMPT_TRUNCATED", "CLIENT_REFUSED"}


def test_captures_into_a_store_in_buckets(spark, tmp_path):
    store = rec.indexed_store(spark, str(tmp_path / "store"))
    step = capture_batch(store, str(tmp_path / "bad"), Capture(), writer="capture")
    step(_lines(spark, []), 0)
    step(_lines(spark, [(_envelope(1), "two", None, None, None)]), 1)
    step(_lines(spark, [(_envelope(1), "two", None, None, None), (_envelope(2), "two", None, None, None)]), 2)
    assert sorted(r["event_id"] for r in store.rows().collect()) == ["t1", "t2"]
