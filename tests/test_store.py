"""The store in buckets: ids against plain sets, commits that crash at each step, races, and recovery into it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyrook.operators.matching import new_events
from tallyrook.streaming import recover as rec
from tallyrook.streaming import store as st

SCHEMA = "tool string, event_id string, n long"
SMALL = st.Layout(buckets=4, blocks=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(((r["tool"], r["event_id"]) for r in df.collect()), key=repr)


def test_ids_are_told_as_by_a_whole_join(spark, tmp_path):
    """Random ids, null parts included, in several commits, also with a filter that is so full that it tells nothing."""
    rng = random.Random(5)
    draw = lambda n: [(rng.choice(["a", "b", None]), rng.choice([None, str(rng.randrange(3000))]) if rng.random() < 0.02 else str(rng.randrange(3000)), i) for i in range(n)]
    for name, layout in (("plain", SMALL), ("full", st.Layout(buckets=1, blocks=1, probes=1))):
        store, have = st.Store(spark, str(tmp_path / name), SCHEMA, layout), set()
        for _ in range(3):
            rows = draw(400)
            fresh = {(t, e) for t, e, _ in rows} - have
            assert store.append(frame(spark, rows)) == len(fresh)
            have |= fresh
        asked = frame(spark, draw(500))
        want = ids(new_events(asked, store.rows()))
        assert ids(store.new(asked)) == want == sorted(((t, e) for t, e in ids(asked) if (t, e) not in have), key=repr)
        assert sorted(ids(store.rows()), key=repr) == sorted(have, key=repr)


def test_only_buckets_hit_are_read(spark, tmp_path, monkeypatch):
    store = st.Store(spark, str(tmp_path), SCHEMA, st.Layout(buckets=16, blocks=64))
    store.append(frame(spark, [("t", str(i), i) for i in range(2000)]))
    read, plain = [], store._buckets
    monkeypatch.setattr(store, "_buckets", lambda at, hit=None: read.append(hit) or plain(at, hit))
    assert store.new(frame(spark, [("t", str(i), i) for i in range(5000, 5040)])).count() == 40
    assert not read or len(read[0]) <= 3  # what the filter lets through by chance
    read.clear()
    assert store.new(frame(spark, [("t", "7", 0), ("t", "x", 0)])).count() == 1
    assert len(read) == 1 and len(read[0]) <= 2
    plan = plain(store.manifest(), read[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_a_filter_lets_few_through(spark, tmp_path):
    layout = st.Layout(buckets=1, blocks=1)
    held = frame(spark, [("t", str(i), i) for i in range(3000)])
    bits = st.filter_of(held, layout)
    assert bits.count() == 1 and bits.select(F.length("bits")).first()[0] == 4096
    passes = lambda lo, hi: frame(spark, [("t", str(i), i) for i in range(lo, hi)]).crossJoin(bits).where(F.forall(layout.bits(), lambda i: st._is_set(F.col("bits"), i))).count()
    assert passes(0, 3000) == 3000 and passes(10_000, 14_000) < 60


@pytest.mark.parametrize("step", ["_write", "create", "after"])
def test_crash_at_each_step(spark, tmp_path, monkeypatch, step):
    """Rows and cursors appear together or not at all, and a batch that runs again changes nothing twice."""
    store = st.Store(spark, str(tmp_path), SCHEMA, SMALL)
    at = lambda n: spark.createDataFrame([("f", n)], "path string, offset long")
    cursor = lambda: [tuple(r) for r in store.cursors("w", "path string, offset long").collect()]
    store.append(frame(spark, [("t", "1", 1)]), "w", 0, at(10))

    class Crash(RuntimeError):
        pass

    plain = {"_write": store._write, "create": store.create}

    def fails(*args, **kw):
        if step == "_write":
            plain["_write"](*args, **kw)
        raise Crash

    def late(*args, **kw):
        plain["create"](*args, **kw)
        raise Crash

    monkeypatch.setattr(store, "create" if step == "after" else step, late if step == "after" else fails)
    with pytest.raises(Crash):
        store.append(frame(spark, [("t", "1", 9), ("t", "2", 2)]), "w", 1, at(20))
    monkeypatch.undo()
    done = step == "after"
    assert ids(store.rows()) == ([("t", "1"), ("t", "2")] if done else [("t", "1")]) and cursor() == [("f", 20 if done else 10)]
    assert store.append(frame(spark, [("t", "1", 9), ("t", "2", 2)]), "w", 1, at(20)) == (0 if done else 1)
    assert ids(store.rows()) == [("t", "1"), ("t", "2")] and cursor() == [("f", 20)]
    assert store.append(frame(spark, [("t", "3", 3)]), "w", 1, at(30)) == 0  # that batch is over
    store.clean(-1)
    assert ids(store.rows()) == [("t", "1"), ("t", "2")] and cursor() == [("f", 20)]
    assert len(list((tmp_path / "rows").iterdir())) == 2 and len(list((tmp_path / "cursors").iterdir())) == 1


def test_commits_that_race(spark, tmp_path, monkeypatch):
    """One that finds its version taken looks again what is new."""
    one, two = (st.Store(spark, str(tmp_path), SCHEMA, SMALL) for _ in range(2))
    plain, between = one._write, []

    def write(*args):
        if not between:
            between.append(two.append(frame(spark, [("t", "1", 1), ("t", "2", 2)])))
        return plain(*args)

    monkeypatch.setattr(one, "_write", write)
    assert one.append(frame(spark, [("t", "2", 5), ("t", "3", 3)])) == 1 and between == [2]
    assert ids(two.rows()) == [("t", "1"), ("t", "2"), ("t", "3")]
    assert len(list((tmp_path / "rows").iterdir())) == 2  # what lost is gone


def test_compaction_grows_the_filter(spark, tmp_path):
    store = st.Store(spark, str(tmp_path), SCHEMA, SMALL)
    for i in range(3):
        store.append(frame(spark, [("t", str(j), j) for j in range(50 * i, 50 * i + 60)]), "w", i)
    before = ids(store.rows())
    assert store.compact(blocks=16) == 160 and len(store.manifest().parts) == 1
    again = st.Store(spark, str(tmp_path), SCHEMA)  # its layout is the folder's own
    assert again.manifest().layout.blocks == 16 and again.manifest().applied == {"w": 2}
    assert ids(again.rows()) == before and again.append(frame(spark, [("t", "3", 0), ("u", "3", 0)])) == 1
    again.clean(-1)
    assert len(again.rows().collect()) == 161


def test_empty_and_torn(spark, tmp_path):
    store = st.Store(spark, str(tmp_path), SCHEMA, SMALL)
    assert store.rows().count() == 0 and store.append(frame(spark, [])) == 0 and store.manifest().version == 0
    assert store.append(frame(spark, []), "w", 0) == 0 and store.manifest().applied == {"w": 0}
    store.append(frame(spark, [(None, None, 1), (None, None, 2)]))
    (tmp_path / "versions" / "v=3").write_text('{"parts": ["x')  # its writer died within it
    assert store.manifest().version == 2 and store.rows().count() == 1
    with pytest.raises(ValueError):
        st.Layout(buckets=8, blocks=4)
    with pytest.raises(ValueError):
        store.append(frame(spark, []), batch=1)


def test_stream_appends_once(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "store"), SCHEMA, SMALL)
    frame(spark, [("t", str(i), i) for i in range(20)]).write.parquet(str(tmp_path / "in"))
    step = st.sink(store, "w", lambda b: b.groupBy("tool").agg(F.max("n").alias("n")))
    for _ in range(2):
        s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "check"))
        s.trigger(availableNow=True).start().awaitTermination(120)
    step(frame(spark, [("t", "99", 99)]), 0)  # a batch that runs again after a crash
    assert store.rows().count() == 20 and [tuple(r) for r in store.cursors("w", "tool string, n long").collect()] == [("t", 19)]


def test_recovery_into_buckets(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    line = lambda i: json.dumps({"event_id": f"e{i}", "tool": "t", "session_id": "s", "ts": f"2024-01-01T00:{i:02d}:00Z", "role": "user", "prompt": f"p{i}"})
    (src / "a.jsonl").write_text("".join(line(i) + "\n" for i in (1, 2, 2, 3)))
    store = rec.indexed_store(spark, str(tmp_path / "store"), layout=SMALL)
    run = lambda check: rec.recover(spark, str(src / "*.jsonl"), store, str(tmp_path / "bad"), str(tmp_path / check), timeout=240)
    assert run("state")
    assert sorted(r["event_id"] for r in store.rows().collect()) == ["e1", "e2", "e3"]
    with open(src / "a.jsonl", "a") as f:
        f.write(line(4) + "\n")
    assert run("state") and run("lost") and store.rows().count() == 4
    rec.follow(spark, str(src / "*.jsonl"), store, str(tmp_path / "bad"), str(tmp_path / "follow"), every=()).awaitTermination(120)
    assert sorted(r["event_id"] for r in store.rows().collect()) == ["e1", "e2", "e3", "e4"]
