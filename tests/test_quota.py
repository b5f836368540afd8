"""The quota without a whole day in one task, against a loop."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from paperloom import shared
from paperloom.streaming import quota

START = dt.datetime(2024, 3, 9, 20, 0, 0)
CALLS = "request_id long, ts timestamp, who string, admitted_ boolean, row int, `at` long"


def loop(calls, per_minute, per_day, zone="America/Los_Angeles"):
    """How many of each (id, ts, key) are admitted."""
    state, out = {}, {}
    for i, t, who in sorted((c for c in calls if c[1] is not None), key=lambda c: (c[1], c[0] is not None, c[0] or 0)):
        day = who or "", t.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone)).date()
        recent, count = state.get(day, ([], 0))
        recent = [x for x in recent if t - x < dt.timedelta(seconds=60)]
        yes = len(recent) < per_minute and count < per_day
        state[day] = (recent + [t] if yes else recent, count + yes)
        out[i, t, who] = out.get((i, t, who), 0) + yes
    return out


def crowd(seed, n, gaps):
    rng, t, out = random.Random(seed), START, []
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice(gaps))
        out.append((i if rng.random() < 0.95 else rng.choice([None, 7]), t, rng.choice(["a", "a", "a", "b", None])))
    out += rng.sample(out, 20) + [(n, None, "a"), (None, None, None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("per_minute, per_day, gaps", [(3, 15, [0, 0.001, 5, 40]), (2, 300, [0, 0.02]), (10, 20, [0, 1, 300]), (1, 1000, [0.5, 20, 59, 60, 61]), (4, 9, [0])])
def test_admission_equals_a_loop(spark, per_minute, per_day, gaps, monkeypatch):
    """Crowded and quiet days, equal times, repeated rows, several keys; few segments a round, so that rounds follow rounds."""
    monkeypatch.setattr(quota, "AHEAD", 3)
    monkeypatch.setattr(quota, "DEPTH", 2)
    calls = crowd(per_day, 700, gaps)
    rows = spark.createDataFrame([(*c, True, 1, 2) for c in calls], CALLS).repartition(4)
    got, total = {}, 0
    for r in quota.admitted(rows, per_minute, per_day, "who").collect():
        total += 1
        if r.ts is None:
            assert not r.admitted
            continue
        got[r.request_id, r.ts, r.who] = got.get((r.request_id, r.ts, r.who), 0) + r.admitted
    assert total == len(calls) and got == loop(calls, per_minute, per_day)


def test_a_crowded_day_is_no_task_s(spark):
    """300,000 calls of one day: what is judged in order is a few calls a segment, whatever the day has."""
    from pyspark.sql import functions as F

    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    rows = spark.range(300_000).select(F.col("id").alias("request_id"), F.timestamp_seconds(F.lit(base) + F.col("id") / 50).alias("ts"))
    got = quota.admitted(rows, 10, 500)
    micros = sorted(r.us for r in got.where("admitted").select(F.unix_micros("ts").alias("us")).collect())
    # ten calls at once, then ten at the end of every minute
    assert len(micros) == 500 and all(b - a >= 60_000_000 for a, b in zip(micros, micros[10:]))
    assert [m - micros[0] for m in micros[:10]] == [20_000 * k for k in range(10)] and micros[490] - micros[0] == 49 * 60_000_000


def test_limits_of_zero_and_many_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k, START, f"k{k % 50}") for k in range(200)], "request_id long, ts timestamp, who string")
    assert quota.admitted(rows, 0, 5).where("admitted").count() == 0 == quota.admitted(rows, 5, 0).where("admitted").count()
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    assert quota.admitted(rows, 2, 5, "who").where("admitted").count() == 100
    assert quota.admitted(rows.limit(0), 2, 5).count() == 0
