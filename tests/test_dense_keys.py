"""One-to-one matching of keys in which both sides are dense, against plain two pointers."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tallyrook.operators import matching

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
W = 600


def plain(direct, recovered):
    """The two earliest pair if near enough, else the earlier one is left."""
    pairs, i, j = set(), 0, 0
    d, r = sorted(direct), sorted(recovered)
    while i < len(d) and j < len(r):
        if abs(d[i][0] - r[j][0]) <= W:
            pairs.add((d[i][1], r[j][1]))
            i, j = i + 1, j + 1
        elif d[i] < r[j]:
            i += 1
        else:
            j += 1
    return pairs


@pytest.mark.parametrize("shape", ["even", "surplus", "bursts", "ties", "far", "turns"])
def test_one_dense_key(spark, monkeypatch, shape):
    rng, n = random.Random(shape), 3000
    at = {
        "even": lambda own: [rng.randrange(n * 30) for _ in range(n)],
        "surplus": lambda own: [rng.randrange(n * 30) for _ in range(n if own else n // 2)],
        "bursts": lambda own: [3000 * rng.randrange(30) + rng.randrange(2900) for _ in range(n)],
        "ties": lambda own: [100 * rng.randrange(n // 4) for _ in range(n)],
        "far": lambda own: [(0 if own else W) + 7 * i for i in range(n)],
        "turns": lambda own: [500 * i + (0 if own else 200) for i in range(n)],
    }[shape]
    sides = {own: [(t, f"{'d' if own else 'r'}{i:05}") for i, t in enumerate(at(own))] for own in (True, False)}
    df = {own: spark.createDataFrame([("k", T0 + timedelta(seconds=t), i) for t, i in rows] + [("other", T0 + timedelta(seconds=5), "x" + str(own))], "k string, ts timestamp, id string") for own, rows in sides.items()}
    used, real = [], matching._pair_ranges
    monkeypatch.setattr(matching, "_pair_ranges", lambda events, *a: used.append(events.select("part").distinct().count()) or real(events, *a))
    got = [tuple(r) for r in matching.correlate(df[True], df[False], ["k"], W * 1_000_000).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(sides[True], sides[False]) | {("xTrue", "xFalse")}
    assert used and used[0] > 3
