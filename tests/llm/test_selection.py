"""Decontamination, importance resampling and the conversation trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyrook.llm import conversation_trie, decontaminate, pii, resample
from tallyrook.llm.common import Scratch

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return RUN.findall((text or "").translate(AZ))


# decontamination


def overlaps_by_hand(docs, items, span=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        t = min(span, len(w))
        for i in range(len(w) - t + 1 if item is not None and w else 0):
            windows[tuple(w[i : i + t])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for t in {len(x) for x in windows}:
            for i in range(len(w) - t + 1):
                if own := windows.get(tuple(w[i : i + t])):
                    hit |= set(range(i, i + t))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def decontamination_tables(seed, letters="abc"):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, some(rng.randint(1, 25))) for i in range(12)] + [(50, "Ünë deux, TROIS!"), (51, None), (52, ""), (53, "?!"), (None, "zz zz"), (54, "q " * 9), (55, "q " * 9)]
    items += [(60 + i, items[i][1]) for i in range(3)]  # items of one text
    docs = [(i, some(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{some(7)} x {items[i % 12][1]} y {some(12)}") for i in range(24)]
    docs += [(200, None), (201, ""), (202, "ünë DEUX trois"), (202, "ünë DEUX trois"), (None, "q " * 30), (203, "w " * 20_000 + items[3][1] + " v" * 20_000), (204, "x" * 300_000)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps(spark, seed):
    docs, items = decontamination_tables(seed, "abc" if seed == 1 else "abcdefghij")
    found = decontaminate.report(decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == overlaps_by_hand(docs, items)


def test_overlap_spans_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten eleven y", "o", "k", "b")], "doc_id long, text string, overlap string, _key string, _bucket string")
    items = spark.createDataFrame([("i", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    row = decontaminate.find_overlaps(docs, items).first()
    assert [tuple(s) for s in row["overlap"]["spans"]] == [(1, 12)] and row["overlap"]["items"] == ["i"] and (row["_key"], row["_bucket"]) == ("k", "b")
    assert decontaminate.decontaminated(decontaminate.find_overlaps(docs, items)).count() == 0
    for span in (3, 11, 12):
        hit = decontaminate.report(decontaminate.find_overlaps(docs, items, decontaminate.Winnow(span))).first()["n_hit"]
        assert hit == 11


def test_overlaps_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.report(decontaminate.find_overlaps(docs.limit(0), items)).count() == 0
    assert decontaminate.report(decontaminate.find_overlaps(docs, items.limit(0))).first()["contaminated"] is False
    assert decontaminate.report(decontaminate.find_overlaps(docs, items)).first()["n_hit"] == 2


def test_only_kept_grams_are_joined(spark):
    """A run of ten words keeps about two of seven grams, and no window is without one."""
    text = " ".join(f"w{random.Random(i).randint(0, 999)}" for i in range(3000))
    df = spark.createDataFrame([(text,)], "text string").select(decontaminate.item_words(F.col("text")).alias("w"))
    at = [p["at"] for p in df.select(decontaminate.kept_grams(F.col("w"), 10, 5).alias("p")).first()["p"]]
    assert 0.2 < len(at) / 3000 < 0.4 and max(b - a for a, b in zip(at, at[1:])) <= 6


# resampling


def resampled_by_hand(docs, target, rule):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i : i + n]) for n in range(1, rule.width + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % rule.buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc, text in docs:
        own = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + rule.buckets) / ((s[b] + 1) * (t_all + rule.buckets)))) for b in map(bucket, own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{rule.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= rule.least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: len(able) * rule.percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("rule", [resample.Resample(), resample.Resample(width=2, buckets=97, head=5, least_words=3, percent=35), resample.Resample(width=4, buckets=50, head=3, seed="x")])
def test_resampling(spark, rule, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 7)
    rng = random.Random(7)
    some = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    texts = [some(rng.randint(0, 60), ["The", "of", "Ä", "zeta", "x1", "a-b"]) for _ in range(60)] + [None, "", "!!", "z" * 5000, "word " * 3000, "same text of some words"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "one two three four"), (3, texts[3]), (-5, texts[4])]
    target = [some(30, ["of", "zeta", "new"]) for _ in range(5)] + [None]
    df, goal = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.report(resample.draw(resample.weigh(df, goal, rule).drop("text"), rule)).collect()
    want = resampled_by_hand(docs, target, rule)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_resampling_of_empty_tables_and_clashing_columns(spark):
    docs, none = spark.createDataFrame([(1, "a b", 9, 9)], "doc_id long, text string, weight int, n_words int"), spark.createDataFrame([], "text string")
    weighed = resample.weigh(docs, none)
    assert weighed.columns == ["doc_id", "text", "n_words", "n_features", "weight"] and weighed.first()["n_words"] == 2
    assert resample.draw(resample.weigh(docs.limit(0), none)).count() == 0
    assert resample.draw(weighed.withColumn("rank", F.lit(1))).first()["rank"] is None  # too few words


def test_head_decides_speed_alone(spark):
    text = b"the cat the dog " * 50
    rule = resample.Resample(width=2)
    head = resample.frequent(spark.createDataFrame([(text.decode(),)], "text string"), rule)
    assert head.states[b"the"] == zlib.crc32(b"the") and head.pairs[b"the", b"cat"] == zlib.crc32(b"the cat")
    lists = [sorted(x for _, b in resample.bucket_lists(text, rule, h) for x in b) for h in (head, resample.Head())]
    assert lists[0] == lists[1]


# conversations


def trie_by_hand(rows, rule):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % rule.heads
        built[c] = own.get(c - int(math.fmod(c, rule.every)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children), sum(map(leaf, below)), saved, digest))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string"


def some_conversations(seed, n=45):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 200), n):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t if t or rng.random() < 0.7 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello there", "", None, "a b c"])))
    rows += [(400, i, "user", f"t{i}") for i in range(120)] + [(401, i, "user", f"t{i}") for i in range(120)]  # long, alike
    rows += [(None, 0, "user", "x"), (420, 5, "user", "hi"), (420, 5, "user", "hi"), (421, None, None, None)]
    return rows


@pytest.mark.parametrize("rule", [conversation_trie.Trie(), conversation_trie.Trie(members=1, queue=3), conversation_trie.Trie(members=5, queue=1, every=7, heads=3)])
def test_trie(spark, rule):
    rows = some_conversations(3)
    got = conversation_trie.report(conversation_trie.conversation_trie(spark.createDataFrame(rows, CONV).repartition(5), rule)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == trie_by_hand(rows, rule)


def test_trie_of_one_first_turn(spark):
    """A first turn that all share, with many different second turns, is no single shard."""
    rows = [(c, t, "user", "go" if t == 0 else f"{t} {c % 50 if t == 1 else c}") for c in range(0, 4000, 20) for t in range(3)]
    rule = conversation_trie.Trie(members=3)
    got = conversation_trie.report(conversation_trie.conversation_trie(spark.createDataFrame(rows, CONV), rule)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == trie_by_hand(rows, rule)


def test_trie_without_turns_or_rows(spark):
    assert conversation_trie.conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    scratch = Scratch(spark)
    turns = conversation_trie.turns_of(spark.createDataFrame([], CONV)).withColumn("depth", F.lit(1).cast("long"))
    convs = spark.createDataFrame([(3,), (12,)], "conv_id long")
    root = conversation_trie.prefix_trie(turns, convs, scratch).collect()
    assert len(root) == 1 and tuple(root[0])[:7] == (3, 0, None, 2, 0, 1, 0) and root[0]["ends_sha256"] == hashlib.sha256(b"3,12").hexdigest()


def test_spilling_queue():
    rng = random.Random(5)
    queue, held, popped = conversation_trie.SpillingQueue(16, 2), [], []
    for _ in range(5000):
        if held and rng.random() < 0.4:
            held.sort()
            assert queue.first() == held[0]
            popped.append(queue.pop())
            assert popped[-1] == held.pop(0)
        else:
            x = (rng.randint(-50, 50), rng.randint(0, 9))
            held.append(x)
            queue.push(x)
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.first() is None


# personal data in near copies


def test_near_copies_are_one_witness(spark, tmp_path):
    """Fifty near copies of a text with an address: none of its words is told, while a nickname that stands
    with the address in different texts is. The SQL agrees."""
    import duckdb

    from tallyrook.llm import oracles, queries

    rng = random.Random(11)
    fresh = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    base, texts = fresh(90), []
    for i in range(50):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(90)] = fresh(1)[0]
        texts.append(" ".join([*own[:40], "write to someone@hidden.example now", *own[40:]]))
    texts += [" ".join([*fresh(20), "zorblax has z@else.example"]) for _ in range(6)]
    texts += [" ".join(fresh(30)) for _ in range(80)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    told = {r["t"] for r in pii.disclosing_terms(docs).collect()}
    assert "zorblax" in told and not told & set(base)
    groups = pii.near_groups(Scratch(spark), docs.where("doc_id < 56").select(F.md5("text").alias("key"), pii.terms(F.col("text")).alias("terms")), 80).collect()
    assert len({r["key"] for r in groups}) >= 45 and len({r["grp"] for r in groups}) == 1
    got = queries.op3_pii(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(oracles.oracle_sql()["op3_pii"]).df().sort_values("doc_id")
    assert got[want.columns].to_numpy().tolist() == want.to_numpy().tolist()
