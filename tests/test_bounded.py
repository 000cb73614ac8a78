"""Operators that hold a bounded part of a key's rows, against plain loops over all of them."""

import random

import numpy as np
import pandas as pd

from hawser.operators import content
from hawser.streaming import streams


def first_kept(rows, tolerance=1024):
    kept = {}
    for s, o, a, b in sorted(rows, key=lambda r: r[1]):
        mine = kept.setdefault(s, [])
        if a is None or not any(abs(a - x) < tolerance and abs(b - y) < tolerance for _, x, y in mine if x is not None):
            mine.append((o, a, b))
    return {(s, o) for s, mine in kept.items() for o, _, _ in mine}


def test_keep_apart_holds_few_boundaries(spark, monkeypatch):
    monkeypatch.setattr(content, "BOUNDARIES_HELD", 50)
    held = []
    fates = content._fates
    monkeypatch.setattr(content, "_fates", lambda starts, *rest: held.append(len(starts)) or fates(starts, *rest))
    run = random.Random(5)
    rows = []
    for s, (n, wide) in enumerate([(900, 400_000), (900, 60_000), (300, 3000), (1, 1)]):
        ordinals = list(range(n))
        if s % 2:
            run.shuffle(ordinals)
        starts = sorted(run.randrange(wide) for _ in range(n))
        rows += [(s, o, a, a + run.randrange(5000)) for o, a in zip(ordinals, starts, strict=True)]
    rows += [(None, 5, 10, 20), (None, 6, 11, 21), (0, 10_000, None, None), (0, 10_001, None, None)]
    given = spark.createDataFrame(rows, "shard long, ordinal long, start_offset long, end_offset long")

    class Direct:  # the operator's own function over one sorted stream, in this process
        dtypes = given.dtypes
        select = repartition = sortWithinPartitions = lambda self, *_: self

        def mapInPandas(self, keep, _):
            ordered = given.orderBy("shard", "start_offset").toPandas()
            return pd.concat(keep(ordered.iloc[at : at + 20].reset_index(drop=True) for at in range(0, len(ordered), 20)))

    out = content.keep_apart(Direct(), "shard")
    got = [(None if pd.isna(s) else int(s), int(o)) for s, o in zip(out["shard"], out["ordinal"], strict=True)]
    assert len(got) == len(set(got)) and set(got) == first_kept(rows)
    assert len(held) > 20 and max(held) < 400  # 2105 rows, of which the shards hold 900 at most
    assert {(r.shard, r.ordinal) for r in content.keep_apart(given, "shard").collect()} == set(got)


def test_in_order_merges_runs(monkeypatch):
    monkeypatch.setattr(streams, "ROWS_SORTED", 30)
    monkeypatch.setattr(streams, "ROWS_AT_ONCE", 7)
    run = np.random.default_rng(1)
    rows = pd.DataFrame({"x": run.permutation(500), "at": np.where(run.random(500) < 0.1, np.nan, run.integers(0, 40, 500)), "name": [f"r{i}" for i in range(500)]})
    got = list(streams.in_order((rows.iloc[k : k + 11] for k in range(0, 500, 11)), ["x", "at", "name"], ["at", "x"]))
    assert [r[2] for r in got] == rows.sort_values(["at", "x"])["name"].tolist()


def test_likely_periods_hold_all_that_repeat():
    run = random.Random(3)
    least, times = 16, 3
    for _ in range(400):
        parts = [bytes(run.choices(b"ab", k=run.randrange(300))) for _ in range(3)]
        period = run.choice([16, 17, 25, 64, 100, 255, 256])
        block = bytes(run.choices(b"abcdefgh", k=period))
        data = np.frombuffer(parts[0] + block * run.choice([2, 3, 4]) + block[: run.randrange(period)] + parts[1] + b"x" * run.randrange(80) + parts[2], np.uint8)
        most = min(256, len(data) // times)
        repeating = []
        for p in range(least, most + 1):
            same = "".join("1" if x else "0" for x in (data[p:] == data[:-p]))
            if max(map(len, same.split("0"))) >= (times - 1) * p:
                repeating.append(p)
        assert set(repeating) <= set(content._likely_periods(data, least, most, times))
