"""Panes with revisions against a plain version that goes through the batches with dictionaries."""

import datetime as dt
import math
import random
import zlib

from charloom.llm import panes

EPOCH = dt.datetime(1970, 1, 1)
HOUR, DAY = 3_600_000_000, 86_400_000_000
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour int, batch string, record int"


def micros(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def plain(rows):
    low = lambda v: (v is not None, 0 if v is None else v)
    once = {}
    for click, ts, arrived, kind, value in rows:
        if ts is None:
            continue
        row = (micros(arrived or ts), micros(ts), kind, value)
        key = (row[0], row[1], low(kind and kind.encode()), low(value))
        if click not in once or key < once[click][0]:
            once[click] = (key, row)
    batches = {b: [] for b in range(8)}
    for click, (_, (arrived, at, kind, value)) in once.items():
        day = arrived // DAY
        q = day % 8
        batch = min(7, q + max(0, zlib.crc32(("" if click is None else str(click)).encode()) % 30 - 23))
        cents = 0 if value is None or not math.isfinite(value) or abs(value) > 1e13 else math.floor(100 * value + 0.5)
        batches[batch].append((at - (day - q) * DAY, kind or ("none" if kind is None else kind), click, cents))
    out, state, emitted, w = [], {}, set(), -math.inf
    for b in range(8):
        new = {}
        for event, kind, click, cents in batches[b]:
            hour = event // HOUR
            if w >= (hour + 1) * HOUR + 4 * DAY:
                out.append((b, hour, click, 1, cents, "late", kind))
            else:
                n, c = new.get((hour, kind), (0, 0))
                new[hour, kind] = n + 1, c + cents
        for p, (n, c) in new.items():
            old = state.get(p, (0, 0))
            state[p] = old[0] + n, old[1] + c
            if p in emitted:
                out += [(b, p[0], -1, *old, "retract", p[1]), (b, p[0], -1, *state[p], "replace", p[1])]
        for p in list(state):
            end = (p[0] + 1) * HOUR
            if p not in emitted and w >= end + 6 * HOUR:
                out.append((b, p[0], -1, *state[p], "emit", p[1]))
                emitted.add(p)
            if w >= end + 4 * DAY:
                del state[p]
                emitted.discard(p)
        w = max([w, *(r[0] for r in batches[b])])
    out += [(7, p[0], -1, *state[p], "final", p[1]) for p in state if p not in emitted]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(c, t, a, 1, k, v, "{}", 5, "x", 7) for c, t, a, k, v in rows], SCHEMA)


def test_odd_clicks(spark):
    rnd = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        ts = start + dt.timedelta(seconds=rnd.randrange(16 * 86400), microseconds=rnd.randrange(10**6))
        arrived = ts + dt.timedelta(hours=rnd.choice([0, 0, 1, 30, 150]))
        rows.append((rnd.choice([i, i, i - 1]), rnd.choice([ts] * 9 + [None]), rnd.choice([arrived] * 9 + [None]), rnd.choice(["a", "b", None, "none", "é", ""]), rnd.choice([1.005, 2.5, -0.005, None, 10.0, math.inf, math.nan, 1e300])))
    rows += rows[:50] + [(None, start, start, "a", 1.0), (None, start, None, "b", 2.0), (-5, dt.datetime(1969, 12, 1), dt.datetime(1969, 12, 3), "old", 1.0)]
    found = got(panes.revised_panes(frame(spark, rows), shards=5))
    assert found == plain(rows)
    assert {r[5] for r in found} >= {"emit", "final", "late", "retract", "replace"}


def test_no_clicks(spark):
    assert got(panes.revised_panes(frame(spark, []), shards=2)) == []


def test_query_equals_plain(spark, sf):
    src = spark.read.parquet(f"{sf}/clicks.parquet").select("click_id", "ts", "arrived_at", "kind", "value")
    assert got(panes.query(spark, sf)) == plain([tuple(r) for r in src.collect()])
