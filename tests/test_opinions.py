"""Second opinions: one question per content, a quota that outlives a call, a store that replaces."""

import datetime as dt
import json
import uuid

from pyspark.sql import functions as F

from paperloom.operators.records import ANSWER
from paperloom.options import Options
from paperloom.plans import extract, opinions
from paperloom.ship import ship

START = dt.datetime(2024, 3, 9, 20, 0, 0)
REQUEST = "doc_id string, content binary, ts timestamp"


def requests(spark, rows):
    return spark.createDataFrame([(d, None if c is None else bytearray(c.encode()), None if s is None else START + dt.timedelta(seconds=s)) for d, c, s in rows], REQUEST).repartition(3)


def provider_into(folder):
    """A provider that leaves a file for every question."""
    folder.mkdir()
    where = str(folder)

    def provider(content):
        with open(f"{where}/{uuid.uuid4().hex}", "wb") as f:
            f.write(content)
        if content == b"c1":
            raise TimeoutError
        return "no json" if content == b"c2" else json.dumps({"invoice_number": content.decode(), "items": []})

    return provider, lambda: sorted(p.read_text() for p in folder.iterdir())


def seen(df):
    return {r.doc_id: (r.answer.invoice_number if r.answer else None, r.code, r.fresh) for r in df.collect()}


def test_equal_contents_are_one_question(spark, tmp_path):
    provider, asked = provider_into(tmp_path / "asked")
    none = opinions.remembered(spark, str(tmp_path / "answers"))
    rows = [(f"d{k}", "same", k) for k in range(100)] + [("e1", "c1", 5), ("e2", "c1", 6), ("f", "c2", 7), ("g", None, 8), ("h", "late", None)]
    got = opinions.opinions(requests(spark, rows), none, provider, "m", per_minute=5, per_day=5)
    for _ in range(2):  # reading again asks nobody
        found = seen(got)
    assert asked() == ["", "c1", "c2", "same"]
    assert {found[f"d{k}"] for k in range(100)} == {("same", None, True)}
    assert found["e1"] == found["e2"] == found["f"] == (None, "llm_failed", False) and found["g"] == ("", None, True)
    assert found["h"] == (None, "llm_quota_exhausted", False)
    assert opinions.spent_calls(got).count() == 4 and got.count() == len(rows)
    assert {r.doc_id for r in got.where("asked_at is not null").collect()} == {"d0", "e1", "f", "g"}


def test_answers_are_remembered_once(spark, tmp_path):
    provider, asked = provider_into(tmp_path / "asked")
    path = str(tmp_path / "answers")
    rows = requests(spark, [(f"d{k}", f"c{k % 6}", k) for k in range(12)])
    for round_ in range(3):
        got = opinions.opinions(rows, opinions.remembered(spark, path), provider, "m", per_minute=20)
        opinions.remember(got, path)
        assert opinions.remembered(spark, path).count() == 4
        assert len(asked()) == 6 + 2 * round_  # failed contents ask again, known ones don't
    assert {r.content_key for r in opinions.remembered(spark, path).collect()} == {r.content_key for r in got.where("code is null").collect()}
    known = seen(opinions.opinions(rows, opinions.remembered(spark, path), None, "m"))
    assert {d: c for d, (_, c, _) in known.items()} == {f"d{k}": "llm_not_configured" if k % 6 in (1, 2) else None for k in range(12)}
    # an answer for a known key replaces it; a store with a key twice gives one row a request
    changed = spark.read.parquet(path).select("content_key", F.col("answer").withField("invoice_number", F.lit("new")).alias("answer")).withColumn("fresh", F.lit(True))
    opinions.remember(changed, path)
    again = opinions.remembered(spark, path)
    assert again.count() == 4 and {r.answer.invoice_number for r in again.collect()} == {"new"}
    doubled = again.unionByName(again)
    assert opinions.opinions(rows, doubled, None, "m").count() == 12
    opinions.remember(got.where("false"), path)
    assert opinions.remembered(spark, path).count() == 4


def test_a_quota_outlives_a_call(spark, tmp_path):
    provider, asked = provider_into(tmp_path / "asked")
    none = opinions.remembered(spark, str(tmp_path / "answers"))
    options = Options(llm_rpm=2, llm_rpd=3)
    first = opinions.opinions(requests(spark, [("a", "x1", 0), ("b", "x2", 1), ("c", "x3", 2)]), none, provider, options=options)
    assert {d: c for d, (_, c, _) in seen(first).items()} == {"a": None, "b": None, "c": "llm_quota_exhausted"}
    later = requests(spark, [("c", "x3", 30), ("d", "x4", 61), ("e", "x5", 200)])
    alone = opinions.opinions(later, none, provider, options=options)
    assert {d: c for d, (_, c, _) in seen(alone).items()} == {"c": None, "d": None, "e": None}
    carried = opinions.opinions(later, none, provider, options=options, spent=opinions.spent_calls(first))
    assert {d: c for d, (_, c, _) in seen(carried).items()} == {"c": "llm_quota_exhausted", "d": None, "e": "llm_quota_exhausted"}
    assert len(asked()) == 6
    assert seen(opinions.opinions(later, none, provider, options=Options(llm_mode="off")))["c"] == (None, "llm_not_configured", False)
    assert opinions.opinions(later.limit(0), none, provider).count() == 0


def test_one_answer_a_document(spark):
    rows = [("a", None, "llm_failed"), ("a", None, None), ("b", None, "llm_failed")]
    answers = spark.createDataFrame(rows, f"doc_id string, answer {ANSWER}, code string")
    full = answers.withColumn("answer", F.when(F.col("code").isNull(), F.from_json(F.lit('{"invoice_number": "7"}'), ANSWER)))
    got = {r.doc_id: (r.answer and r.answer.invoice_number, r.code) for r in extract.one_answer(full.unionByName(full)).collect()}
    assert got == {"a": ("7", None), "b": (None, "llm_failed")}


def test_flights_of_a_stream(spark, tmp_path):
    """Within and across batches one request of each content leads, until the content is forgotten."""
    ship(spark)
    hours = 3600
    batches = [
        [("b", "k1", 2), ("a", "k1", 1), ("c", "k2", 3), ("n1", None, 1)],
        [("d", "k1", 9), ("e", "k3", 9), ("n2", None, 4), ("n3", None, 5)],
        [("x", "k9", 9 * hours)],
        [("y", "k9", 9 * hours + 1)],
        [("f", "k1", 9 * hours + 2)],
    ]
    for k, rows in enumerate(batches):
        table = spark.createDataFrame([(d, c, START + dt.timedelta(seconds=s)) for d, c, s in rows], "doc_id string, content_key string, ts timestamp")
        table.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("doc_id string, content_key string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = opinions.single_flight(stream).writeStream.format("memory").queryName("flights").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    got = {r.doc_id: (r.leads, r.leader) for r in spark.table("flights").collect()}
    own = ("n1", "n2", "n3")
    assert got == {"a": (True, "a"), "b": (False, "a"), "c": (True, "c"), "d": (False, "a"), "e": (True, "e"), "x": (True, "x"), "y": (False, "x"), "f": (True, "f"), **{n: (True, n) for n in own}}
