"""A request quota: at most ``per_minute`` admitted calls in any rolling minute and ``per_day`` per calendar day in
a time zone; a new day starts afresh. Refused calls do not count, so admission is a fold in time order.

``admitted`` judges a table in rounds over all days at once; ``admitted_stream`` is the same as a stateful stream operator, which keeps the
last minute's admitted calls only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import fresh_name, quoted, stored, with_small

PER_MINUTE, PER_DAY = 10, 20
ZONE = "America/Los_Angeles"
WINDOW_MICROS = 60_000_000


def quota_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


#: Minutes of a day that one round of ``admitted`` looks ahead, and calls of a segment that it looks at, as a multiple of the calls of a minute.
AHEAD, DEPTH = 32, 4


def admitted(requests: DataFrame, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, key: str | None = None, zone: str = ZONE) -> DataFrame:
    """``requests`` (request_id, ts timestamp, ...) with ``admitted``. Calls count in the order of time, ties by id; rows are judged one by one, also where they
    share both, in any order. Name a ``key`` where there is more than one quota; null keys share one. A null ts is refused. Columns may have any names.

    No day is one task's. While a quota is used up, the time at which it frees is known, and at which it frees after that nearly: it is a minute after an
    admitted call. So a day is cut into segments at these times and a minute, two ... ``AHEAD - 1`` minutes after them, and only the first calls of every segment are of interest, which
    Spark finds in each task before it exchanges any. They are judged in order by one pass over an array as long as segments allow,
    up to the first place where a call that was not looked at could have been admitted; the next round goes on from there. A round covers ``AHEAD`` minutes of a crowded
    day, all of a quiet one, and at least ``DEPTH`` times ``per_minute`` calls. The requests, and each round's states and admitted rows, are stored; this runs at the call."""
    day, at, group, row, yes = (fresh_name(requests, n) for n in ("day", "at", "group", "row", "yes"))
    name = F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")) if key else F.lit("")
    rows = requests.withColumns({day: quota_day(F.col("ts"), zone), at: F.unix_micros("ts"), row: F.monotonically_increasing_id()})
    rows = stored(rows.withColumn(group, F.concat_ws(" ", F.col(day).cast("string"), name)), "requests")
    calls = rows.where(F.col(at).isNotNull()).select(F.col(group).alias("group"), F.col(at).alias("at"), F.col("request_id").alias("id"), F.col(row).alias("row"))
    found = _rounds(calls, per_minute, per_day) if min(per_minute, per_day) > 0 else calls.select("row").limit(0)
    found = stored(found.select(F.col("row").alias(row), F.lit(True).alias(yes)), "admitted")
    judged = with_small(rows, found, row, row)  # a row's number is no common key
    return judged.select(*(F.col(quoted(c)) for c in requests.columns), F.coalesce(yes, F.lit(False)).alias("admitted"))


def _rounds(calls: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """(row) of the admitted ones of ``calls`` (group, at, id, row)."""
    number = T.StructType([f for f in calls.schema if f.name in ("at", "id", "row")])
    order = F.struct("at", "id", "row")
    nothing = F.expr("cast(array() as array<bigint>)")
    firsts = calls.groupBy("group").agg(F.min("at").alias("first"))
    state = stored(firsts.select("group", F.array("first").alias("anchors"), nothing.alias("recent"), F.lit(0).alias("n"), F.lit(None).cast(number).alias("upto")), "quota")
    done = None
    while True:
        least = _candidates(with_small(calls, state, "group", "row"), order, DEPTH * per_minute + 1)
        ordered = F.array_sort(F.collect_list(F.struct(order.alias("call"), "edge")))
        judged = least.groupBy("group").agg(ordered.alias("calls"), *(F.first(c).alias(c) for c in ("recent", "n")))
        judged = stored(judged.select("group", _judge("calls", per_minute, per_day).alias("s")), "judged")
        some = judged.select(F.explode("s.got").alias("row"))
        done = some if done is None else done.unionByName(some)
        anchors = F.when(F.size("recent") >= per_minute, F.transform("recent", lambda t: t + WINDOW_MICROS)).otherwise(F.array("upto.at"))
        state = judged.where("s.stopped").select("group", "s.*").select("group", anchors.alias("anchors"), "recent", "n", "upto")
        if state.isEmpty():
            return done


def _candidates(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """The first ``most`` calls of every segment that are still to be judged; the last of so many has the ``edge`` at which its segment ends."""
    at, anchors = F.col("at"), F.col("anchors")
    # anchors are in order and less than a window apart; only calls from the first on can be admitted
    todo = rows.where(anchors.isNotNull() & (at >= anchors[0]) & (F.col("upto").isNull() | (order > F.col("upto"))))
    minute = F.least(F.call_function("div", at - anchors[0], F.lit(WINDOW_MICROS)), F.lit(AHEAD - 1))
    todo = todo.withColumn("minute", minute)
    todo = todo.withColumn("phase", F.size(F.filter(anchors, lambda a: a + F.col("minute") * WINDOW_MICROS <= at)))
    turn = F.coalesce(F.get(anchors, F.col("phase")), anchors[0] + WINDOW_MICROS) + F.col("minute") * WINDOW_MICROS
    last = (F.col("minute") == AHEAD - 1) & (F.col("phase") == F.size(anchors))
    place = F.row_number().over(Window.partitionBy("group", "minute", "phase").orderBy("at", "id", "row"))
    ends = F.when(last, F.lit(9223372036854775807)).otherwise(turn)
    return todo.withColumns({"place": place, "ends": ends}).where(F.col("place") <= most).withColumn("edge", F.when(F.col("place") == most, F.col("ends")))


def _judge(calls: str, per_minute: int, per_day: int) -> Column:
    """The fold: (recent, n, upto, got, stopped) after the calls in order, from the columns recent and n."""
    text = f"""
        aggregate({calls},
          named_struct('recent', recent, 'n', n, 'upto', {calls}[0].call, 'got', cast(array() as array<bigint>), 'stopped', false),
          (a, c) -> if(a.stopped, a,
            transform(array(filter(a.recent, t -> c.call.at - t < {WINDOW_MICROS})), live ->
              transform(array(size(live) < {per_minute} and a.n < {per_day}), yes ->
                transform(array(if(yes, concat(live, array(c.call.at)), live)), now -> named_struct(
                  'recent', now,
                  'n', if(yes, a.n + 1, a.n),
                  'upto', c.call,
                  'got', if(yes, concat(a.got, array(c.call.row)), a.got),
                  'stopped', coalesce(if(yes, a.n + 1, a.n) < {per_day} and (size(now) < {per_minute} or now[0] + {WINDOW_MICROS} < c.edge), false) and c.edge is not null
                ))[0])[0])[0]))
    """
    return F.expr(text)


def first_of_day(requests: DataFrame, per_day: int = PER_DAY, zone: str = ZONE) -> DataFrame:
    """``admitted`` where only the day's cap can bind: a rank by day. Spark keeps the first ``per_day`` of a day in every task before it
    exchanges rows, so that a long day is not sorted in one."""
    day = quota_day(F.col("ts"), zone)
    order = Window.partitionBy("_day").orderBy("ts", "request_id")
    least = requests.select(day.alias("_day"), "ts", "request_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_day)
    last = least.groupBy("_day").agg(F.max(F.struct("ts", "request_id")).alias("_last"))
    judged = requests.withColumn("_day", day).join(last, "_day", "left")
    return judged.withColumn("admitted", F.coalesce(F.struct("ts", "request_id") <= F.col("_last"), F.lit(False))).drop("_day", "_last")


def status(admitted_: DataFrame, now: Column, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, zone: str = ZONE) -> DataFrame:
    """One row: what is left in this minute and today."""
    at = F.unix_micros("ts")
    today = quota_day(F.col("ts"), zone) == quota_day(now, zone)
    recent = today & (F.unix_micros(now) - at < WINDOW_MICROS) & (at <= F.unix_micros(now))
    calls = admitted_.where("admitted")
    return calls.agg(
        F.greatest(F.lit(per_minute) - F.count(F.when(recent, 1)), F.lit(0)).alias("remaining_this_minute"),
        F.greatest(F.lit(per_day) - F.count(F.when(today & (at <= F.unix_micros(now)), 1)), F.lit(0)).alias("remaining_today"),
        F.lit(per_minute).cast("long").alias("limit_per_minute"),
        F.lit(per_day).cast("long").alias("limit_per_day"),
    )


def admitted_stream(requests: DataFrame, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, zone: str = ZONE) -> DataFrame:
    """The same for a stream of (request_id long, ts timestamp, key string): state per key, requests in time order within a
    batch; what arrives after later requests is judged at its arrival. Emits (request_id, admitted)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def judge(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, count, recent = state.get if state.exists else ("", 0, [])
        recent = list(recent)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "request_id"])
        local = rows["ts"].dt.tz_localize("UTC").dt.tz_convert(zone).dt.strftime("%Y-%m-%d")
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        verdicts = []
        for at, own_day in zip(micros.tolist(), local.tolist(), strict=True):
            if own_day != day:
                day, count, recent = own_day, 0, []
            recent = [t for t in recent if at - t < WINDOW_MICROS]
            yes = len(recent) < per_minute and count < per_day
            if yes:
                recent.append(at)
                count += 1
            verdicts.append(yes)
        state.update((day, count, recent))
        yield pd.DataFrame({"request_id": rows["request_id"], "admitted": verdicts})

    return requests.groupBy("key").applyInPandasWithState(
        judge, "request_id long, admitted boolean", "day string, count int, recent array<long>", "append", GroupStateTimeout.NoTimeout
    )
