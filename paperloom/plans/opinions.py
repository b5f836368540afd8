"""Second opinions for the records that need one: stored answers first, then a provider within its quota, asked once for each content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.records import ANSWER
from ..options import Options
from ..shared import stored, with_small
from ..ship import ship
from ..streaming import quota

#: content -> the reply as JSON text. One attempt per call; an exception is a failed answer.
Provider = Callable[[bytes], str]


def known_answers(stored_answers: DataFrame) -> DataFrame:
    """(content_key, answer), one row a key: of several answers the least in Spark's order."""
    return stored_answers.where("content_key is not null and answer is not null").groupBy("content_key").agg(F.min("answer").alias("answer"))


def opinions(
    requests: DataFrame, stored_answers: DataFrame, provider: Provider | None, model: str | None = None, version: str = "1", per_minute: int | None = None, per_day: int | None = None,
    spent: DataFrame | None = None, options: Options = Options(),
) -> DataFrame:
    """(doc_id, content_key, answer, code, fresh, asked_at) of ``requests`` (doc_id, content binary, ts timestamp), one row a request.

    A stored answer costs no quota. Of the requests whose content has none, the earliest (ts, then doc_id) of each content asks, and all of them share what comes
    of it: an answer, ``llm_quota_exhausted`` or ``llm_failed``; without a provider, or where ``options`` turn opinions off, ``llm_not_configured``. A refused
    or failed content may ask again in a later call. Calls are admitted in time order together with those that were ``spent`` before (ts timestamp; see ``spent_calls``). code is null
    for an answer. Requests with a fresh answer have ``fresh`` true (see ``remember``); the one that asked has ``asked_at``.

    A null content is an empty one, a null ts is never admitted. Limits and model are those of ``options`` unless given. Provider and quota run once, at the
    call: replies and result are stored, so that reading the result again asks nobody. A task that is lost may repeat its questions.
    """
    ship(requests.sparkSession)
    model, per_minute, per_day = model or options.llm_model, options.llm_rpm if per_minute is None else per_minute, options.llm_rpd if per_day is None else per_day
    content = F.coalesce(F.col("content"), F.lit("").cast("binary"))
    rows = requests.select("doc_id", "ts", content.alias("content"), S.content_key(content, model, version).alias("content_key"))
    known = stored(known_answers(stored_answers).withColumn("hit", F.lit(True)), "known")
    met = with_small(rows.select("doc_id", "ts", "content_key").withColumn("_spread", F.xxhash64("doc_id", "ts")), known, "content_key", "_spread")
    met = stored(met.select("doc_id", "ts", "content_key", "answer", F.coalesce("hit", F.lit(False)).alias("hit")), "requests")
    none, no = F.lit(None).cast("timestamp"), F.lit(False)
    hits = met.where("hit").select("doc_id", "content_key", "answer", F.lit(None).cast("string").alias("code"), no.alias("fresh"), none.alias("asked_at"))
    misses = met.where("not hit")
    if provider is None or options.llm_mode == "off":
        rest = misses.select("doc_id", "content_key", "answer", F.lit("llm_not_configured").alias("code"), no.alias("fresh"), none.alias("asked_at"))
        return stored(hits.unionByName(rest), "opinions")
    order = F.struct(F.col("ts").isNull().alias("late"), "ts", "doc_id")
    asking = stored(misses.groupBy("content_key").agg(F.min(order).alias("first")).select("content_key", "first.ts", "first.doc_id"), "asking")
    judged = stored(_admitted(asking, spent, per_minute, per_day), "judged")
    replies = stored(_asked(rows, judged.where("admitted").select("content_key"), provider), "replies")
    parsed = replies.withColumn("answer", F.from_json("reply", ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("reply").isNotNull() & F.try_parse_json("reply").isNotNull()
    answered = parsed.select("content_key", F.when(good, F.col("answer")).alias("given"), F.coalesce(good, no).alias("good"))
    code = F.when(~F.col("admitted"), "llm_quota_exhausted").when(~F.coalesce("good", no), "llm_failed")
    ended = judged.join(answered, "content_key", "left").select("content_key", "admitted", F.col("ts").alias("first_ts"), F.col("doc_id").alias("first_id"), "given", code.alias("code"))
    shared = with_small(misses.withColumn("_spread", F.xxhash64("doc_id", "ts")), stored(ended, "ended"), "content_key", "_spread")
    asked_at = F.when(F.col("admitted") & F.col("ts").eqNullSafe(F.col("first_ts")) & F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("ts"))
    rest = shared.select("doc_id", "content_key", F.col("given").alias("answer"), "code", F.col("code").isNull().alias("fresh"), asked_at.alias("asked_at"))
    return stored(hits.unionByName(rest), "opinions")


def _admitted(asking: DataFrame, spent: DataFrame | None, per_minute: int, per_day: int) -> DataFrame:
    """``asking`` (content_key, ts, doc_id) with ``admitted``; calls of the past are judged with them and go."""
    calls = asking.select("content_key", "ts", F.col("doc_id").cast("string").alias("request_id"), F.lit(False).alias("past"), "doc_id")
    if spent is not None:
        before = spent.where("ts is not null").select(F.lit(None).cast("string").alias("content_key"), "ts", F.lit(None).cast("string").alias("request_id"), F.lit(True).alias("past"))
        calls = calls.unionByName(before, allowMissingColumns=True)
    return quota.admitted(calls, per_minute, per_day).where("not past").select("content_key", "ts", "doc_id", "admitted")


def _asked(rows: DataFrame, wanted: DataFrame, provider: Provider) -> DataFrame:
    """(content_key, reply): one question for each wanted content."""

    def ask(frames):
        for f in frames:
            replies = []
            for content in f["content"]:
                try:
                    replies.append(provider(bytes(content)))
                except Exception:  # noqa: BLE001  any error is a failed answer, charged to the quota
                    replies.append(None)
            yield pd.DataFrame({"content_key": f["content_key"], "reply": replies})

    one = rows.join(wanted, "content_key", "left_semi").groupBy("content_key").agg(F.first("content").alias("content"))
    return one.mapInPandas(ask, "content_key string, reply string")


def spent_calls(opinions_: DataFrame) -> DataFrame:
    """(ts) of the calls that ``opinions`` made; requests that share doc_id and ts are one call. Keep them and pass them on as ``spent``."""
    return opinions_.where("asked_at is not null").select("doc_id", F.col("asked_at").alias("ts")).distinct().select("ts")


# ---- the store of answers -------------------------------------------------------------------

_STORE = f"content_key string, answer {ANSWER}, prefix string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remembered(spark: SparkSession, path: str) -> DataFrame:
    """(content_key, answer) of a store; empty where there is none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"content_key string, answer {ANSWER}")
    return spark.read.schema(_STORE).parquet(path).drop("prefix")


def remember(opinions_: DataFrame, path: str) -> None:
    """Put fresh answers into a store, one a content: a key that is there already is replaced, so that a rerun adds no row. The store is parted by the first
    two digits of the key, and only the parts that get an answer are written anew."""
    spark = opinions_.sparkSession
    prefix = F.substring("content_key", 1, 2).alias("prefix")
    fresh = stored(known_answers(opinions_.where("fresh")).select("content_key", "answer", prefix), "fresh")
    if fresh.isEmpty():
        return
    if _exists(spark, path):
        touched = fresh.select("prefix").distinct()  # 256 at most
        old = spark.read.schema(_STORE).parquet(path).join(F.broadcast(touched), "prefix", "left_semi")
        fresh = stored(fresh.unionByName(old.join(fresh.select("content_key"), "content_key", "left_anti")), "merged")
    fresh.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)


# ---- streams --------------------------------------------------------------------------------


def single_flight(requests: DataFrame, keep_minutes: int = 60) -> DataFrame:
    """(doc_id string, content_key, ts, leads, leader) of a stream of (doc_id, content_key string, ts timestamp): of the requests for a content the first, by (ts, doc_id) within a batch, leads; later
    ones name it and ask nothing. A content is forgotten once the stream's time is ``keep_minutes`` past its last request, after which it is asked again; that much later
    than the rest a request may be, or Spark leaves it out. Rows without a key lead for themselves."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fly(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "doc_id"], ignore_index=True)
        alone = key[0] is None
        first = not state.exists
        leader = rows["doc_id"].iloc[0] if first else state.get[0]
        if not alone:
            state.update((leader,))
            state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + keep_minutes * 60_000 + 1)
        rows["leads"] = [alone or (first and k == 0) for k in range(len(rows))]
        rows["leader"] = rows["doc_id"] if alone else leader
        yield rows[["doc_id", "content_key", "ts", "leads", "leader"]]

    ship(requests.sparkSession)
    named = requests.select(F.col("doc_id").cast("string").alias("doc_id"), "content_key", "ts").withWatermark("ts", f"{keep_minutes} minutes")
    ddl = "doc_id string, content_key string, ts timestamp, leads boolean, leader string"
    return named.groupBy("content_key").applyInPandasWithState(fly, ddl, "leader string", "append", GroupStateTimeout.EventTimeTimeout)
