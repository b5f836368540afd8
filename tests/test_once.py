"""Costly expressions that stand in a plan once."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import fields, layout, table, totals
from paperloom.plans import queries_more, queries_records, render  # noqa: F401  register their queries
from paperloom.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_currency_lines_prints_once(spark, sf):
    assert plan(QUERIES["currency_lines"](spark, sf)).count("format_string") == 1


def test_similarity_splits_a_text_once(spark, sf):
    """Its words are bound before the shingles are made of them, not split again at each."""
    made = [line for line in plan(QUERIES["document_similarity"](spark, sf)).splitlines() if "slice(" in line]
    assert made and all(line.count("split(") == line.count("slice(") for line in made)


def lines(spark):
    words = "from_json(string(id), 'array<struct<text: string, x0: int, y0: int, x1: int, y1: int, conf: double>>') AS words"
    return spark.range(2).selectExpr("string(id) AS doc_id", "1 AS page_no", "1 AS line_no", "24.0D AS h", "string(id) AS text", words)


def words_in_filters(df):
    """Filters that work out lists of words: what they test is worked out again behind them."""
    return [line for line in plan(df).splitlines() if "Filter" in line and "lambda" in line]


def test_payments_read_cells_once(spark):
    assert not words_in_filters(fields.payments(lines(spark)))


def test_summary_rows_merge_numbers_once(spark):
    assert not words_in_filters(totals.summary_rows(lines(spark)))


def test_words_and_lines_are_sorted_once(spark, sf):
    """Rendered words are numbered without a sort, and lines aren't sorted again by their number."""
    found = table.zoned(layout.page_lines(render.rendered(spark, sf).drop("width")).withColumn("width", F.lit(render.WIDTH)))
    sorts = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [doc_id" in line]
    assert sum("yc#" in line for line in sorts) == 1 and not any("text#" in line or "line_no#" in line for line in sorts)


def test_letterhead_reads_lines_once(spark, sf):
    """Pages with a seller's label are told by a window, not by a join with lines that are worked out again."""
    assert plan(QUERIES["letterhead_extract"](spark, sf)).count("Relation [l_orderkey") == 1


def test_records_keep_nothing(spark, sf):
    """Words and lines are gone through once: they are not persisted, and not read again for each part of a record."""
    found = plan(QUERIES["extraction_metrics"](spark, sf))
    assert "InMemoryRelation" not in found and found.count("Generate posexplode(split(") == 1


def test_reconciled_items_are_repaired_once(spark, sf):
    """Each side's items are a column, repaired before they are held against both summaries."""
    found = plan(QUERIES["reconcile_items"](spark, sf))
    assert "AS _own#" in found and "AS _theirs#" in found


def test_words_of_documents_and_lines_stay_in_place(spark, sf):
    """Texts and lines are dealt out before words are made of them; no later step deals out words."""
    for name in ("lines_cluster", "lines_upright", "nearest_fallback"):
        assert "ENSURE_REQUIREMENTS" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), name


def dealt_above_words(df):
    """Exchanges of words or of what is made of them."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    words = next(k for k, line in enumerate(lines) if "Generate posexplode(split(" in line)
    return [line for line in lines[:words] if "Exchange" in line]


@pytest.mark.parametrize("broadcast", [render.BROADCAST_SUPPLIERS, 0])
def test_suppliers_do_not_deal_out_words(spark, sf, monkeypatch, broadcast):
    """However many suppliers there are: their join leaves lines where they lie by document, and so all words of these."""
    monkeypatch.setattr(render, "BROADCAST_SUPPLIERS", broadcast)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES["payment_extract"](spark, sf)
        assert not dealt_above_words(found)
        assert found.count() == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_rereads_leave_words_in_place(spark, sf):
    """Second readings are a list beside their page: lines and words aren't dealt out for them, nor worked out twice."""
    assert not dealt_above_words(QUERIES["numeric_reread"](spark, sf))


def test_pages_are_put_together_once(spark, sf):
    """Words come in the order of their pages: one aggregate makes a page of them as they come, without a second one over hashed and sorted parts."""
    found = QUERIES["items_extract"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert found.count("SortAggregate(key=[doc_id") == 2 and "HashAggregate" not in found
