"""The registry that is brought up to the store, what it isolates, and the codes of a run that fails."""

import json
import time
from datetime import datetime, timedelta

import pytest

from tallyrook.operators import matching
from tallyrook.sources import files
from tallyrook.streaming import recover as rec

T0 = datetime(2024, 1, 1)


def _events(spark, rows):
    """(id, user, prompt, minute)"""
    return spark.createDataFrame([(i, "t", "s", T0 + timedelta(minutes=m, microseconds=7), p, u, "r", "b", "c") for i, u, p, m in rows], rec.EVENT_SCHEMA)


def _files(folder):
    return {(p.parent.name, p.name): p.stat().st_mtime_ns for p in folder.glob("user=*/*.json")}


def _public(spark, path):
    return sorted((r["event_id"], r["prompt"]) for r in files.read_registry(spark, path)[0].collect())


def test_only_changed_users_are_written(spark, tmp_path):
    path, at = str(tmp_path / "registry"), tmp_path / "registry"
    rows = [(str(i), f"u{i % 3}", f"p{i}", i) for i in range(30)] + [("x", "123", "digits for a name", 1)]
    assert files.rebuild_registry(_events(spark, rows), path) == ["123", "u0", "u1", "u2"]
    first = _files(at)
    assert files.rebuild_registry(_events(spark, rows[::-1]), path) == [] and _files(at) == first
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert files.rebuild_registry(_events(spark, rows), path) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    rows.append(("30", "u1", "more", 31))
    assert files.rebuild_registry(_events(spark, rows), path) == ["u1"]
    now = _files(at)
    assert {k: v for k, v in now.items() if k[0] != "user=u1"} == {k: v for k, v in first.items() if k[0] != "user=u1"}
    assert _public(spark, path) == sorted((i, p) for i, _, p, _ in rows)
    rows = [r for r in rows if r[1] != "u2"]  # a user who is gone from the store goes from the registry
    assert files.rebuild_registry(_events(spark, rows), path) == ["u2"] and _public(spark, path) == sorted((i, p) for i, _, p, _ in rows)
    assert files.rebuild_registry(_events(spark, []), path) == ["123", "u0", "u1"] and _public(spark, path) == []


def test_a_crash_between_new_files_and_old_ones(spark, tmp_path, monkeypatch):
    """Old files stay until the new ones are there, so nothing is ever missing; the next run mends the repeats."""
    path = str(tmp_path / "registry")
    rows = [(str(i), f"u{i % 2}", f"p{i}", i) for i in range(10)]
    files.rebuild_registry(_events(spark, rows), path)
    rows.append(("10", "u0", "new", 11))
    real = files._files_of

    class Stuck:
        def delete(self, *_):
            raise OSError("crash")

    monkeypatch.setattr(files, "_files_of", lambda *a: (Stuck(), real(*a)[1]))
    with pytest.raises(OSError):
        files.rebuild_registry(_events(spark, rows), path, health=str(tmp_path / "health"))
    assert {i for i, _ in _public(spark, path)} == {i for i, *_ in rows} and len(_public(spark, path)) == 16
    assert [r["code"] for r in spark.read.parquet(str(tmp_path / "health")).collect()] == ["PUBLICATION_FAILED"]
    monkeypatch.setattr(files, "_files_of", real)
    assert files.rebuild_registry(_events(spark, rows), path) == ["u0"] and len(_public(spark, path)) == 11


def test_what_collides_is_isolated(spark, tmp_path):
    path, side, health = (str(tmp_path / n) for n in ("registry", "side", "health"))
    rows = [("1", "u0", "first", 1), ("1", "u0", "second", 2), ("1", "u1", "third", 3), ("2", "u0", "same", 4), ("2", "u0", "same", 4), (None, "u0", "no id", 5), ("3", None, "no user", 6), ("4", "u1", "later", 7)]
    assert files.rebuild_registry(_events(spark, rows), path, isolated=side, health=health) == ["u0", "u1"]
    assert _public(spark, path) == [("1", "first"), ("2", "same"), ("4", "later")]
    told = lambda: sorted((r["reason"], r["event_id"] or "") for r in spark.read.parquet(side).collect())
    assert told() == [("collision", "1"), ("collision", "1"), ("null", ""), ("null", "3")]
    assert set(spark.read.parquet(side).columns) == {"tool", "event_id", "sha256", "reason"}
    assert files.rebuild_registry(_events(spark, rows), path, isolated=side) == [] and len(told()) == 4
    part = next((tmp_path / "registry" / "user=u1").glob("*.json"))
    part.write_text(part.read_text().replace("later", "forged"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert files.rebuild_registry(_events(spark, rows), path, isolated=side, health=health) == ["u1"]
    assert _public(spark, path) == [("1", "first"), ("2", "same"), ("4", "later")] and told()[2] == ("modified", "")
    assert {r["code"] for r in spark.read.parquet(health).collect()} == {"ID_COLLISION", "UNPUBLISHED", "REGISTRY_DRIFT"}


def test_multiset_digest_counts_repeats(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("c", "x"), ("d", "x"), (None, None)], "k string, v string")
    d = {r["k"]: r for r in matching.multiset_digest(df, ["k"], "v").collect()}
    assert d["a"]["digest"] == d["b"]["digest"] and len({d[k]["digest"] for k in "acd"}) == 3 and d[None]["n_rows"] == 1 and d[None]["n_bytes"] == 0
    assert matching.multiset_digest(df.limit(0), ["k"], "v").count() == 0


def test_files_of_a_user_by_size(spark, tmp_path):
    rows = [(str(i), "u0", "x" * 200, i) for i in range(50)]
    files.rebuild_registry(_events(spark, rows), str(tmp_path / "registry"), file_bytes=2000)
    parts = list((tmp_path / "registry" / "user=u0").glob("*.json"))
    assert len(parts) >= 1 and sum(len(p.read_text().splitlines()) for p in parts) == 50
    for p in parts:
        assert len({json.loads(x)["event_id"] for x in p.read_text().splitlines()}) == len(p.read_text().splitlines())


def _line(i):
    return json.dumps({"event_id": f"e{i}", "tool": "t", "session_id": "s", "ts": "2024-01-01T00:00:00Z", "role": "user", "prompt": f"p{i}"})


@pytest.mark.parametrize("code", ["LOCKED", "WRITE_FAILED", "RECOVERY_FAILED", "TIMEOUT"])
def test_codes_of_runs_that_end_early(spark, tmp_path, monkeypatch, code):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.jsonl").write_text(_line(1) + "\n")
    at = lambda n: str(tmp_path / n)
    run = lambda **more: rec.recover(spark, at("src/*.jsonl"), at("store"), at("bad"), at("state"), health=at("health"), **more)

    def broken(*_):
        raise OSError("disk full")

    if code == "LOCKED":
        rec.State(spark, at("state")).lease(300)
        assert not run()
    elif code == "TIMEOUT":
        monkeypatch.setattr(rec, "append_evidence", lambda *a: time.sleep(6))
        assert not run(timeout=4)
    else:
        monkeypatch.setattr(rec, "put" if code == "WRITE_FAILED" else "correlate", broken)
        with pytest.raises(rec.WriteFailed if code == "WRITE_FAILED" else OSError):
            run()
    assert [r["code"] for r in spark.read.parquet(at("health")).collect()] == [code]


def test_counts_need_no_jobs(spark, tmp_path):
    """Counts of a pass come with the tables it writes."""
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.jsonl").write_text("".join(_line(i) + "\n" for i in range(5)) + "{\n" + '{"event_id": null}\n')
    done = rec.recover_pass(spark, str(tmp_path / "src" / "*.jsonl"), str(tmp_path / "store"), str(tmp_path / "bad"), rec.State(spark, str(tmp_path / "state")), health=str(tmp_path / "health"))
    assert done == {"appended": 5, "deferred": 0, "refused": 2, "truncated": 0, "rescanned": 0, "authenticated": 0, "voided": 0, "backup_moved": 0}
    assert {r["code"] for r in spark.read.parquet(str(tmp_path / "health")).collect()} == {"PARTIAL_TRANSCRIPT", "QUARANTINED"}
