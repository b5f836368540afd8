"""Queries over summary rows of every kind, currencies, file kinds, dates in running text and exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fields, layout, table, totals
from ..sources import files
from . import evaluate, render
from .queries import _items, _items_sql, _LINES, _parsed, _query, _table

# ---- summary rows ---------------------------------------------------------------------------

#: What a page below its table says, by o_orderkey % 6: label and amount of each line, in cents of sub (the subtotal), t (sub div 20), u (sub div 50) and d (sub div 10).
_SUMMARIES: list[list[tuple[str, list[str]]]] = [
    [("Subtotal", ["sub"]), ("GST 5%", ["t"]), ("PST", ["u"]), ("Grand total $", ["sub + t + u"])],
    [("", ["sub", "10%", "d", "sub + d"]), ("Total", ["sub", "d", "sub + d"])],
    [("Sub-total", ["sub"]), ("Discount", ["d"]), ("Shipping fee:", ["t"]), ("Handling", ["u"]), ("VAT 20%", ["d"]), ("Total €", ["sub"])],
    [("Amount due", ["sub + t"])],
    [("Amount due", ["sub + t"]), ("Amount paid:", ["u"]), ("Thank you for", ["3", "orders"])],
    [("Sales tax 7%", ["t"]), ("Paid", ["u"]), ("Balance due", ["d"]), ("TOTAL", ["sub", "EUR"])],
]


def _summary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one page for every order: its summary lines, label at the left and amounts at the right."""
    orders = _table(spark, sf_dir, "orders").withColumn("sub", F.round(F.col("o_totalprice") * 100).cast("long"))
    orders = orders.selectExpr("o_orderkey", "sub", "sub div 20 AS t", "sub div 50 AS u", "sub div 10 AS d")

    def printed(what: str) -> Column:
        if what in ("10%", "3", "orders", "EUR"):
            return F.lit(what)
        cents = F.expr(what)
        return F.format_string("%d.%02d", F.call_function("div", cents, F.lit(100)), cents % 100)

    def lines(k: int) -> Column:
        out = []
        for n, (label, amounts) in enumerate(_SUMMARIES[k]):
            out += [render.text_at(100, 40 + 36 * n, F.lit(label))] if label else []
            out += [render.text_at(900 + 200 * m, 40 + 36 * n, printed(a)) for m, a in enumerate(amounts)]
        return F.array(*out)

    chain = F.when(F.col("o_orderkey") % 6 == 0, lines(0))
    for k in range(1, len(_SUMMARIES)):
        chain = chain.when(F.col("o_orderkey") % 6 == k, lines(k))
    return render.words_of(orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), chain.alias("texts")))


@_query("""
    WITH o AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS sub FROM orders),
    v AS (SELECT k, k % 6 AS v, sub, sub // 20 AS t, sub // 50 AS u, sub // 10 AS d FROM o)
    SELECT k AS doc_id, CASE WHEN v < 3 THEN sub / 100.0 END::DOUBLE AS subtotal, CASE v WHEN 0 THEN (t + u) / 100.0 WHEN 1 THEN d / 100.0 WHEN 2 THEN d / 100.0 WHEN 5 THEN t / 100.0 END::DOUBLE AS tax,
           CASE v WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 5 THEN 7 END::DOUBLE AS tax_rate, CASE v WHEN 2 THEN d / 100.0 END::DOUBLE AS discount,
           CASE v WHEN 2 THEN printf('Shipping fee=%d.%02d;Handling=%d.%02d', t // 100, t % 100, u // 100, u % 100) ELSE '' END AS charges,
           CASE v WHEN 0 THEN (sub + t + u) / 100.0 WHEN 1 THEN (sub + d) / 100.0 WHEN 2 THEN sub / 100.0 WHEN 3 THEN (sub + t) / 100.0 WHEN 5 THEN sub / 100.0 END::DOUBLE AS total,
           CASE v WHEN 4 THEN u / 100.0 WHEN 5 THEN u / 100.0 END::DOUBLE AS amount_paid, CASE v WHEN 3 THEN (sub + t) / 100.0 WHEN 4 THEN (sub + t) / 100.0 WHEN 5 THEN d / 100.0 END::DOUBLE AS amount_due,
           CASE v WHEN 0 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 5 THEN 'EUR' END AS currency
    FROM v
""")
def summary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows of every kind: several taxes, an unlabelled rate row, a net, VAT and gross row, discounts, charges, amounts due and paid, a total from the
    amount due, prose with numbers; and the currency of the page."""
    words = _summary_pages(spark, sf_dir)
    found = totals.summaries(layout.page_lines(words)).join(fields.page_currency(words), layout.PAGE)
    s = F.col("summary")
    charge = F.transform(s["other_charges"], lambda c: F.concat(c["label"], F.lit("="), F.format_string("%.2f", c["amount"])))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *(s[c].alias(c) for c in ("subtotal", "tax", "tax_rate", "discount", "total", "amount_paid", "amount_due")),
        F.array_join(charge, ";").alias("charges"), "currency",
    )


# ---- tables that are not as they should be --------------------------------------------------


@_query(_items_sql())
def wrapped_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items below a header whose labels stand on two lines."""
    return _items(_parsed(spark, sf_dir, render.Layout(wrap_header=True)))


@_query(f"""
    WITH {_LINES}
    SELECT l_orderkey AS orderkey, line::BIGINT AS line, q::DOUBLE AS quantity, gross / 100.0::DOUBLE AS gross_amount, CASE WHEN line % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS conflicts FROM m
""")
def column_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one number more than there are columns: the nearest column keeps the first, and the conflict is counted."""
    found = table.items(table.page_rows(_parsed(spark, sf_dir, render.Layout(stray=True))))
    return found.select(F.col("doc_id").cast("long").alias("orderkey"), F.col("line").cast("long").alias("line"), "quantity", "gross_amount", F.col("conflicts").cast("long").alias("conflicts"))


# ---- currencies, kinds of files -------------------------------------------------------------

#: Ways of printing an amount, and the currency that each names.
_PRINTED: list[tuple[str, str | None]] = [
    ("{} EUR", "EUR"), ("USD {}", "USD"), ("£{}", "GBP"), ("Total (CAD) {}", "CAD"), ("Currency: CHF, {}", "CHF"), ("{}", None), ("$ {} ABN 51", "AUD"), ("A${}", "AUD"), ("${}", "USD"), ("{} XXQ", None), ("€ {} GST", "EUR"),
]


@_query(
    "SELECT l_orderkey AS orderkey, l_linenumber::BIGINT AS line, CASE (l_orderkey + l_linenumber) % " + f"{len(_PRINTED)} "
    + " ".join(f"WHEN {k} THEN {'NULL' if code is None else repr(code)}" for k, (_, code) in enumerate(_PRINTED))
    + " END AS currency FROM lineitem"
)
def currency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency of every line's price, each printed in one of several ways."""
    lines = _table(spark, sf_dir, "lineitem")
    # the way is picked before its text is made, and the text is a column of its own: else each of the patterns would print all ways again
    around = F.get(F.array(*[F.struct(*(F.lit(x).alias(c) for c, x in zip(("before", "after"), way.split("{}"), strict=True))) for way, _ in _PRINTED]), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_PRINTED)).cast("int"))
    named = lines.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice", around.alias("w"))
    texts = named.select("orderkey", "line", F.concat("w.before", F.format_string("%.2f", "l_extendedprice"), "w.after").alias("text"))
    return texts.select("orderkey", "line", S.currency_of(F.col("text")).alias("currency"))


@_query("""
    WITH p AS (SELECT page_id, page_id % 9 AS v, coalesce(html, '') AS html FROM pages)
    SELECT page_id, CASE v WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'tiff' WHEN 4 THEN 'tiff' WHEN 5 THEN CASE WHEN strlen(html) >= 0 THEN 'webp' END
                  ELSE CASE WHEN html LIKE '%PDF-%' AND html[1:5] = '%PDF-' THEN 'pdf' END END AS kind
    FROM p
""")
def sniff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every page's whole content behind the leading bytes of several formats, of a ZIP file that is damaged, or none."""
    starts = ["255044462D", "FFD8FF", "89504E470D0A1A0A", "49492A00", "4D4D002A", "524946460000000057454250", "504B0304", "", ""]
    lead = F.unhex(F.get(F.array(*map(F.lit, starts)), (F.col("page_id") % 9).cast("int")))
    rows = _table(spark, sf_dir, "pages").select("page_id", F.concat(lead, F.coalesce("html", F.lit("")).cast("binary")).alias("content"))
    return files.sniffed(rows).select("page_id", "kind")


# ---- dates in text --------------------------------------------------------------------------

_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


@_query("""
    SELECT o_orderkey AS orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, form::BIGINT AS form
    FROM orders, range(8) f(form)
""")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates spelled out in running text in eight ways, and found again."""
    d = F.col("o_orderdate")
    day, year, name = F.dayofmonth(d).cast("string"), F.year(d).cast("string"), F.get(F.array(*map(F.lit, _MONTHS)), F.month(d) - 1)
    short, two = F.substring(name, 1, 3), F.lpad(F.pmod(F.year(d), F.lit(100)).cast("string"), 2, "0")
    suffix = F.when(F.dayofmonth(d).isin(1, 21, 31), "st").when(F.dayofmonth(d).isin(2, 22), "nd").when(F.dayofmonth(d).isin(3, 23), "rd").otherwise("th")
    ways = [
        F.concat(F.lit("Due on "), name, F.lit(" "), day, suffix, F.lit(", "), year), F.concat(day, F.lit("-"), short, F.lit("-"), year), F.concat(F.lit("the "), day, suffix, F.lit(" of "), name, F.lit(", "), year),
        F.concat(year, F.lit(" "), short, F.lit(" "), day), F.concat(F.upper(short), F.lit(". "), day, F.lit(" "), year, F.lit(" at 10:45 pm")), F.concat(F.date_format(d, "EEEE"), F.lit(", "), day, F.lit(" "), name, F.lit(" "), year),
        F.concat(day, F.lit(" "), short, F.lit(" '"), two), F.concat(short, F.lit("-"), year, F.lit("-"), day),
    ]
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.posexplode(F.array(*ways)).alias("form", "text"))
    return rows.select("orderkey", S.parse_date(F.col("text")).alias("iso"), F.col("form").cast("long").alias("form"))


# ---- percentiles ----------------------------------------------------------------------------


@_query("""
    SELECT count(*) AS n, round(avg(v), 6) AS mean_ms, (list_sort(list(v)))[greatest((count(*) * 0.95)::DOUBLE // 1, 1)::BIGINT] AS p95_ms
    FROM (SELECT l_extendedprice * (1 + l_discount) / l_quantity AS v FROM lineitem)
""")
def latency_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and 95th percentile of doubles that are nearly all different."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * (1 + F.col("l_discount")) / F.col("l_quantity")).alias("ms"))
    return evaluate.latency(rows).select("n", F.round("mean_ms", 6).alias("mean_ms"), "p95_ms")


# ---- similarity of near texts ---------------------------------------------------------------

#: Words of a shingle, and texts of a group that one copy of its first text serves.
SHINGLE, SERVED = 5, 256


@_query()
def document_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching blocks' ratio (TXT6) of every document with the first of those that share its least hash of five words: no SQL counterpart; a test holds it against difflib.

    (doc_id, near_id, ratio) over whole normalised texts, without a row for the first of a group itself. Of equal texts the smallest doc_id takes part; texts without words and rows without
    an id don't. A text of fewer than five words is one shingle. Pairs are one row each whatever the size of a group, and a large group's first text is dealt out in copies."""
    rows = _table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", S.truth_text(F.col("text")).alias("t")).where("t <> ''")
    texts = rows.groupBy(F.sha2("t", 256).alias("_d")).agg(F.min(F.struct("doc_id", "t")).alias("r")).select("r.*")

    def shingles(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
        return F.transform(starts, lambda k: F.xxhash64(F.array_join(F.slice(words, k, SHINGLE), " ")))

    # bound once: else a text would be split again at each of its shingles
    least = F.array_min(S.let(F.split("t", " "), shingles))
    keys = texts.select("doc_id", least.alias("_key"))
    groups = keys.groupBy("_key").agg(F.min("doc_id").alias("near_id"), F.ceil(F.count("*") / SERVED).cast("int").alias("_copies"), F.count("*").alias("_n")).where("_n > 1")
    pairs = keys.join(groups, "_key").where("doc_id <> near_id").select("doc_id", "near_id", F.pmod(F.xxhash64("doc_id"), F.col("_copies")).cast("int").alias("_copy"))
    first = groups.join(texts, F.col("near_id") == F.col("doc_id")).select("near_id", F.col("t").alias("u"), F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    met = pairs.join(texts, "doc_id").join(first, ["near_id", "_copy"])
    return met.select("doc_id", "near_id", F.round(S.similarity("u", "t"), 6).alias("ratio"))
