"""Checks, gate, merge policy, quota, sources, evaluation."""

import datetime as dt
import io
import json
import random
import zipfile
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import checks, reconcile
from paperloom.operators.records import ANSWER, INVOICE, ITEM, PARTY, PAYMENT, SUMMARY
from paperloom.plans import evaluate
from paperloom.sources import files, raster
from paperloom.ship import ship
from paperloom.streaming import quota

RECORD = f"doc_id string, invoice {INVOICE}, seller {PARTY}, client {PARTY}, items array<{ITEM}>, summary {SUMMARY}, payment {PAYMENT}, warnings array<string>, trusted boolean, answer {ANSWER}"


def item(line=1, quantity=2.0, unit_price=10.0, net_amount=20.0, **more):
    return {"line": line, "description": "d", "quantity": quantity, "unit_price": unit_price, "net_amount": net_amount, **more}


def record(**more):
    base = {
        "doc_id": "a", "invoice": {"invoice_number": "1", "date": "2020-01-01"}, "seller": {"name": "S"}, "client": {"name": "C"}, "items": [item()],
        "summary": {"subtotal": 20.0, "tax": 2.0, "total": 22.0, "other_charges": []}, "payment": {}, "warnings": [], "trusted": True, "answer": None,
    }
    return {**base, **more}


def frame(spark, *records):
    rows = spark.createDataFrame([(json.dumps(r),) for r in records], "j string")
    return rows.select(F.from_json("j", RECORD_STRUCT).alias("r")).select("r.*")


RECORD_STRUCT = RECORD


def scored(spark, *records):
    none = F.expr("cast(array() as array<string>)")
    return checks.scored(frame(spark, *records), F.lit(0.97), none, none).collect()


def test_checks(spark):
    cases = [
        (record(), [], "ok"),
        (record(items=[]), ["no_line_items"], "needs_review"),
        (record(items=[item(net_amount=25.0)]), ["item_1:qty_x_price_ne_net", "items_sum_ne_subtotal"], "needs_review"),
        (record(items=[item(quantity=2000.0)]), [], "ok"),
        (record(items=[item(net_amount=None)]), [], "ok"),
        (record(items=[item(unit_price=None)]), ["item_1:unit_price_derived"], "ok"),
        (record(items=[item(quantity=None, unit_price=None, net_amount=None)]), ["item_1:no_amount"], "needs_review"),
        (record(items=[item(vat_percent=10.0, gross_amount=30.0)]), ["item_1:net_plus_vat_ne_gross"], "needs_review"),
        (record(summary={"subtotal": 20.0, "tax": 2.0, "total": 30.0, "other_charges": [{"label": "s", "amount": 8.0}]}), [], "ok"),
        (record(summary={"subtotal": 20.0, "total": 30.0, "other_charges": []}), ["subtotal_plus_tax_ne_total"], "needs_review"),
        (record(items=[item(gross_amount=22.0)], summary={"total": 25.0, "other_charges": []}), ["items_gross_sum_ne_total"], "needs_review"),
        (record(summary={"other_charges": []}, invoice={}, seller={}, client={"name": ""}), ["missing:invoice_number", "missing:date", "missing:total", "missing:parties"], "needs_review"),
    ]
    for k, (r, warnings, status) in enumerate(cases):
        (got,) = scored(spark, r)
        assert got.warnings == warnings and got.status == status, k
    got = scored(spark, record(items=[item(quantity=2000.0)]), record(items=[item(net_amount=None)]), record(items=[item(unit_price=None)]))
    assert [(r["items"][0].quantity, r["items"][0].unit_price, r["items"][0].net_amount) for r in got] == [(2.0, 10.0, 20.0)] * 3
    assert got[0].confidence == 0.97 and got[2].confidence == round(0.97 * 0.95, 3)


def test_gate(spark):
    rows = [
        ("ok", record()), ("review", record(items=[item(net_amount=99.0)])), ("number", record(invoice={"date": "d"})), ("date", record(invoice={"invoice_number": "1", "date": ""})),
        ("total", record(summary={"subtotal": 20.0, "other_charges": []})), ("parties", record(seller={}, client={})),
    ]
    got = checks.scored(frame(spark, *[{**r, "doc_id": k} for k, r in rows]), F.lit(1.0), F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<string>)"))
    parts = [F.col(c) for c in ("status", "invoice", "items", "summary", "seller", "client")]
    asked = {r[0]: tuple(r)[1:] for r in got.select("doc_id", *[reconcile.should_ask(m, *parts) for m in reconcile.MODES]).collect()}
    assert asked == {k: (k != "ok", True, False) for k, _ in rows}
    with pytest.raises(ValueError):
        reconcile.should_ask("sometimes", *parts)


def answer(**more):
    return {"items": [], **more}


def test_merge_policy(spark):
    good = [{"description": " x ", "quantity": 2.0, "unit_price": 10.0, "net_amount": 20.0}]
    rows = [
        record(doc_id="conflict kept", answer=answer(invoice_number="2")),
        record(doc_id="gap filled", answer=answer(seller={"email": "e@x.org"})),
        record(doc_id="untrusted", trusted=False, answer=answer(invoice_number="2")),
        record(doc_id="broken items", trusted=False, items=[item(net_amount=99.0)], answer=answer(items=good)),
        record(doc_id="worse items", trusted=False, answer=answer(items=[{**good[0], "net_amount": 77.0}])),
        record(doc_id="bad date", invoice={"invoice_number": "1"}, answer=answer(date="13th Sept", currency=" eur ")),
        record(doc_id="letterhead", warnings=["seller_from_letterhead"], answer=answer(seller={"name": "T"}, client={"name": "D"})),
        record(doc_id="summary", summary={"subtotal": 20.0, "total": 22.0, "tax": 2.0, "other_charges": []}, answer=answer(items=good, amount_due=5.0, total=22.0)),
    ]
    got = {r.doc_id: r for r in reconcile.merge(frame(spark, *rows)).collect()}
    assert got["conflict kept"].invoice.invoice_number == "1" and got["conflict kept"].fields == []
    assert got["gap filled"].seller.email == "e@x.org" and got["gap filled"].fields == ["seller.email"]
    assert got["untrusted"].invoice.invoice_number == "2" and got["untrusted"].fields == ["invoice.invoice_number"]
    assert got["broken items"]["items"][0].net_amount == 20.0 and got["broken items"]["items"][0].description == "x" and "items" in got["broken items"].fields
    assert got["worse items"]["items"][0].net_amount == 20.0
    assert got["bad date"].invoice.date is None and got["bad date"].invoice.currency == "EUR"
    assert got["letterhead"].seller.name == "T" and got["letterhead"].client.name == "C"
    assert got["summary"].summary.amount_due == 5.0 and got["summary"].fields == ["summary.amount_due"]


def test_outcomes(spark):
    rows = spark.createDataFrame([(True, True, True, ["x"]), (True, True, True, []), (True, True, False, []), (True, False, True, []), (False, True, True, [])], "conf boolean, adm boolean, ans boolean, f array<string>")
    out = reconcile.outcome("auto", F.lit(True), F.col("conf"), F.col("adm"), F.col("ans"), F.col("f"))
    got = [tuple(r) for r in rows.coalesce(1).select(out, reconcile.outcome_warning("auto", out), reconcile.outcome_warning("always", out)).collect()]
    assert got == [("used", None, None), ("no_change", None, None), ("failed", "llm_failed", "llm_failed"), ("quota_exhausted", "llm_quota_exhausted", "llm_quota_exhausted"), ("not_configured", None, "llm_not_configured")]


# ---- quota ----------------------------------------------------------------------------------


def plain_quota(times, per_minute, per_day):
    zone, day, count, calls, out = ZoneInfo(quota.ZONE), None, 0, [], []
    for t in times:
        own = t.astimezone(zone).date()
        if own != day:
            day, count, calls = own, 0, []
        calls = [c for c in calls if (t - c).total_seconds() < 60]
        yes = len(calls) < per_minute and count < per_day
        if yes:
            calls.append(t)
            count += 1
        out.append(yes)
    return out


def admitted(spark, times, **limits):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "request_id long, ts timestamp").repartition(3)
    return [r.admitted for r in sorted(quota.admitted(rows, **limits).collect(), key=lambda r: r.request_id)]


START = dt.datetime(2024, 5, 1, 18, tzinfo=dt.timezone.utc)


def test_quota_rules(spark):
    second = dt.timedelta(seconds=1)
    assert admitted(spark, [START] * 12).count(True) == 10
    assert admitted(spark, [START] * 10 + [START + 30 * second, START + 60 * second]) == [True] * 10 + [False, True]
    assert admitted(spark, [START + 61 * k * second for k in range(30)]).count(True) == 20
    late = [START + 61 * k * second for k in range(25)] + [START + dt.timedelta(days=1)]
    assert admitted(spark, late)[-1] and not admitted(spark, late)[24]


def test_quota_equals_a_loop_and_the_stream(spark, tmp_path):
    rng = random.Random(9)
    times, t = [], START
    for _ in range(400):
        t += dt.timedelta(seconds=rng.choice([0, 1, 5, 20, 400]))
        times.append(t)
    expected = plain_quota(times, 3, 15)
    assert admitted(spark, times, per_minute=3, per_day=15) == expected
    ship(spark)
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(times)], "request_id long, ts timestamp, key string")
    rows.where("request_id < 150").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    rows.where("request_id >= 150").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = quota.admitted_stream(stream, 3, 15).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    got = [r.admitted for r in sorted(spark.table("verdicts").collect(), key=lambda r: r.request_id)]
    assert got == expected


# ---- sources, images, evaluation ------------------------------------------------------------


def _docx(extra: bytes = b"") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<x/>")
        z.writestr("[Content_Types].xml", extra)
    return out.getvalue()


def test_uploads(spark, tmp_path):
    ship(spark)
    # Spark's scans leave out files without a byte; the code for them is for tables of uploads
    contents = {"a.pdf": b"%PDF-1.4", "b.docx": _docx(), "c.zip": b"PK\x03\x04junk", "d.txt": b"text", "e": b"", "f.png": b"\x89PNG\r\n\x1a\n1", "g.big": b"%PDF-" + b"x" * 5000}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.filename: (r.kind, r.error_code) for r in files.uploads(spark, str(tmp_path), 4000).collect()}
    assert got == {"a.pdf": ("pdf", None), "b.docx": ("docx", None), "c.zip": (None, 415), "d.txt": (None, 415), "f.png": ("png", None), "g.big": (None, 413)}
    empty = spark.createDataFrame([("e", 0, bytearray())], "doc_id string, length long, content binary")
    assert files.judged(empty).first().error_code == 400


def test_readers_isolate_errors(spark):
    ship(spark)
    rows = spark.createDataFrame([("a", bytearray(b"one two"), "pdf"), ("b", bytearray(b"bad"), "pdf"), ("c", bytearray(b""), "pdf")], "doc_id string, content binary, kind string")

    def reader(content, kind, max_pages):
        if content == b"bad":
            raise ValueError("broken")
        yield 0, 100, [(w, 0, 0, 1, 1, 90.0) for w in content.decode().split()] + [(" ", 0, 0, 1, 1, 90.0), ("x", 0, 0, 1, 1, -1.0)], "ocr"

    got = sorted((r.doc_id, r.text, r.error) for r in files.words_by(rows, reader).collect())
    assert got == [("a", "one", None), ("a", "two", None), ("b", None, "broken"), ("c", None, None)]
    with pytest.raises(files.Unavailable):
        files.words_by(rows, None)


def test_raster_steps():
    page = np.full((400, 300, 3), 255, np.uint8)
    page[100:110, 50:250] = 0
    page[200:210, 50:250, 0] = 255
    page[200:210, 50:250, 1:] = 0  # a red stamp fades
    gray = raster.brightest(page)
    assert gray[105, 100] == 0 and gray[205, 100] == 255
    assert raster.scale_of(1000, 750) == 2.0 and raster.scale_of(1000, 100) == 3.0 and raster.scale_of(8400, 2000) == 0.5 and raster.scale_of(2000, 1600) == 1.0
    y, x = np.mgrid[0:400, 0:600]
    a = np.radians(5)
    u, v = (x - 300) * np.cos(a) + (y - 200) * np.sin(a), -(x - 300) * np.sin(a) + (y - 200) * np.cos(a)
    tilted = np.where((np.abs(u) < 200) & (np.abs(v) < 60), 0, 255).astype(np.uint8)
    assert abs(abs(raster.skew_angle(tilted)) - 5) < 0.5
    assert abs(raster.skew_angle(raster.deskew(tilted))) < 0.7
    corners = np.array([[10, 10], [0, 100], [90, 5], [100, 110]])
    assert raster.order_corners(corners).tolist() == [[10, 10], [90, 5], [100, 110], [0, 100]]
    assert raster.prepare(page).shape == (1200, 900)


def test_latency(spark):
    rows = spark.createDataFrame([(v,) for v in range(1, 41)], "ms long")
    assert tuple(evaluate.latency(rows).first()) == (40, 20.5, 38)
    assert evaluate.latency(rows.limit(1)).first().p95_ms == 1


def test_options(monkeypatch, spark):
    from paperloom.options import Options, engine_info

    assert Options().review_threshold == 0.8
    monkeypatch.setenv("PAPERLOOM_LLM_RPM", "3")
    assert Options.from_environment().llm_rpm == 3
    with pytest.raises(ValueError):
        Options(llm_mode="maybe")
    assert engine_info(spark).where("capability = 'spark' and available").count() == 1


def test_quota_judges_rows_not_ids(spark):
    rows = [(1, START), (1, START), (2, START + dt.timedelta(seconds=1)), (3, None)]
    got = quota.admitted(spark.createDataFrame(rows, "request_id long, ts timestamp"), per_minute=1).collect()
    assert sorted((r.request_id, r.admitted) for r in got) == [(1, False), (1, True), (2, False), (3, False)]
    assert quota.admitted(spark.createDataFrame([], "request_id long, ts timestamp")).count() == 0


def test_batches_and_error_kinds(spark):
    uploads = spark.createDataFrame([(k, f"d{k}", 3, bytearray(b"%PD" if k else b"")) for k in (2, 0, 1)], "n int, doc_id string, length long, content binary")
    uploads = uploads.withColumn("length", F.length("content").cast("long"))
    assert [(r.n, r.error_code) for r in files.batch(uploads, "n", 3).collect()] == [(0, 400), (1, 415), (2, 415)]
    with pytest.raises(ValueError, match="413"):
        files.batch(uploads, "n", 2)

    def reader(content, kind, cap):
        raise TimeoutError("slow") if content == b"t" else ValueError("broken")
        yield

    rows = spark.createDataFrame([("a", bytearray(b"t"), "pdf"), ("b", bytearray(b"x"), "pdf")], "doc_id string, content binary, kind string")
    assert sorted((r.doc_id, r.error, r.error_kind) for r in files.words_by(rows, reader).collect()) == [("a", "slow", "transient"), ("b", "broken", "permanent")]


def test_options_reach_the_record(spark):
    from paperloom.options import Options
    from paperloom.plans import extract

    words = spark.createDataFrame(
        [("d0", 1, k, t, 100 * k, 10, 100 * k + 90, 34, 100.0) for k, t in enumerate(["Date:", "04/05/2020"])],
        "doc_id string, page_no int, word_idx int, text string, x0 int, y0 int, x1 int, y1 int, conf double",
    )
    pages = spark.createDataFrame([(f"d{d}", 1, 1654, "ocr") for d in range(2)], "doc_id string, page_no int, width int, source string")
    got = {r.doc_id: r for r in extract.extract(words, pages, options=Options(date_order="DMY", ocr_version="5.3")).collect()}
    assert got["d0"].data.invoice.date == "2020-05-04" and got["d0"].data.meta.engine == "tesseract-5.3"
    assert (got["d1"].ok, got["d1"].error_kind) == (False, "permanent")
    with pytest.raises(ValueError):
        extract.extract(words, pages, "maybe")


def test_codes_of_second_opinions(spark):
    rows = spark.createDataFrame([(c,) for c in ("llm_quota_exhausted", "llm_failed", "llm_not_configured", None)], "code string")
    from paperloom.plans import extract

    got = {r.code: r.outcome for r in rows.select("code", extract.unanswered("always", F.lit(True), F.col("code"), F.array()).alias("outcome")).collect()}
    assert got == {"llm_quota_exhausted": "quota_exhausted", "llm_failed": "failed", "llm_not_configured": "not_configured", None: "failed"}


def test_answers_reach_the_record(spark):
    from paperloom.plans import extract

    texts = ["Date:", "04/05/2020"]
    words = spark.createDataFrame(
        [(f"d{d}", 1, k, t, 100 * k, 10, 100 * k + 90, 34, 100.0) for d in range(4) for k, t in enumerate(texts)],
        "doc_id string, page_no int, word_idx int, text string, x0 int, y0 int, x1 int, y1 int, conf double",
    )
    pages = spark.createDataFrame([(f"d{d}", 1, 1654) for d in range(5)], "doc_id string, page_no int, width int")
    answers = spark.createDataFrame(
        [("d0", answer(invoice_number="7", total=22.0), None), ("d1", answer(), None), ("d2", None, "llm_quota_exhausted")],
        f"doc_id string, answer {ANSWER}, code string",
    )
    got = {r.doc_id: r for r in extract.extract(words, pages, "always", answers, model="m").collect()}
    used = got["d0"].data
    assert (used.invoice.invoice_number, used.invoice.date, used.summary.total) == ("7", "2020-04-05", 22.0)
    assert used.meta.llm_used and used.meta.engine == "pdf-text-layer+m" and set(used.meta.llm_fields) == {"invoice.invoice_number", "summary.total"}
    assert "llm_filled" in used.meta.warnings and used.meta.status == "needs_review"
    assert {d: r.outcome for d, r in got.items()} == {"d0": "used", "d1": "no_change", "d2": "quota_exhausted", "d3": "failed", "d4": "not_needed"}
    assert "llm_quota_exhausted" in got["d2"].data.meta.warnings and not got["d4"].ok
