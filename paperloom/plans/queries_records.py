"""Queries over scalars, checks, reconciliation, merging, quota, sources and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..operators import assemble, checks, layout, reconcile, table
from ..operators.records import ANSWER_ITEM, CHARGE, ITEM, PARTY, PARTY_FIELDS, PAYMENT, PAYMENT_FIELDS, SUMMARY
from ..sources import files
from ..streaming import quota
from . import evaluate, extract, render
from .queries import _LINES, _query, _table

# ---- numbers, currencies, dates, text --------------------------------------------------------


@_query("""
    WITH c AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n,
                      round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)
    SELECT n::BIGINT AS n, f AS form, CASE f WHEN 'negative' THEN -1 ELSE 1 END * cents / 100.0::DOUBLE AS value, true AS is_token
    FROM c, (VALUES ('plain'), ('comma'), ('english'), ('german'), ('dollar'), ('negative')) t(f)
""")
def parse_number_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts printed in six ways and parsed again."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = _table(spark, sf_dir, "lineitem").select(*names, cents.alias("cents"))
    # a number for every row without a global sort: ranks within a range of 10,000 orders, raised by the counts of the ranges before;
    # one row per range is all that one task sees
    rows = rows.withColumn("range", F.floor(F.col("l_orderkey") / 10_000))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*names))
    counts = rows.groupBy("range").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("own", own).join(counts.select("range", before.alias("before")), "range")
    whole, rest = F.floor(F.col("cents") / 100).cast("long"), F.lpad(F.pmod(F.col("cents"), F.lit(100)).cast("string"), 2, "0")
    english = F.concat(F.format_number(whole, 0), F.lit("."), rest)
    german = F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(","), rest)
    forms = {
        "plain": F.concat(whole.cast("string"), F.lit("."), rest), "comma": F.concat(whole.cast("string"), F.lit(","), rest), "english": english,
        "german": german, "dollar": F.concat(F.lit("$"), english), "negative": F.concat(F.lit("("), german, F.lit(")")),
    }
    printed = rows.select((F.col("before") + F.col("own")).alias("n"), F.explode(F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), v)])).alias("form", "text"))
    return printed.select("n", "form", S.money(S.parse_number(F.col("text"))).alias("value"), S.is_number_token(F.col("text")).alias("is_token"))


@_query(r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS word FROM documents)
    SELECT doc_id, count(*) AS words, count(*) FILTER (regexp_full_match(word, '\(?-?[$€£]?[0-9][0-9.,]*%?\)?')) AS numbers
    FROM w GROUP BY doc_id
""")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("word"))
    return words.groupBy("doc_id").agg(F.count("*").alias("words"), F.count(F.when(S.is_number_token(F.col("word")), 1)).alias("numbers"))


#: Texts made of a nation's number k and the currency that each has.
_CURRENCY_CASES = [
    ("'Currency ' || k || ' EUR'", "EUR"), ("'Currency: EUR'", "EUR"), ("'Price (GBP) Qty ' || k", "GBP"), ("'Total $ 5 640,' || k", "USD"),
    ("'Total € ' || k", "EUR"), ("'Total £' || k", "GBP"), ("'CA$ ' || k", "CAD"), ("'C$' || k", "CAD"), ("'AU$' || k || ' due'", "AUD"), ("'US$ ' || k", "USD"),
    ("k || ' CHF'", "CHF"), ("'NOK ' || k", "NOK"), ("'ABC ' || k", None), ("'ABN 12 total $' || k", "AUD"), ("'Canada total $' || k", "CAD"), ("'nothing'", None),
    ("'Our CAD team Currency CHF'", "CHF"), ("'XCA$ ' || k", "USD"),
]


@_query(
    "WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_nationkey FROM nation) "
    + " UNION ALL ".join(f"SELECT n_nationkey::BIGINT AS nation, {i}::BIGINT AS form, {'NULL' if code is None else repr(code)}::VARCHAR AS currency FROM n" for i, (_, code) in enumerate(_CURRENCY_CASES))
)
def currency_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    forms = F.array(*[F.struct(F.lit(i).cast("long").alias("form"), F.expr(text.replace("''", "'")).alias("text")) for i, (text, _) in enumerate(_CURRENCY_CASES)])
    rows = nation.select(F.col("n_nationkey").cast("long").alias("nation"), F.explode(forms).alias("c")).select("nation", "c.*")
    return rows.select("nation", "form", S.currency_of(F.col("text")).alias("currency"))


@_query("""
    SELECT o_orderkey AS orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS us,
           strftime(o_orderdate, '%Y-%m-%d') AS eu, strftime(o_orderdate, '%Y-%m-%d') AS named, '20' || strftime(o_orderdate, '%y-%m-%d') AS short,
           CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d')
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS swapped, NULL::VARCHAR AS invalid
    FROM orders
""")
def parse_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed in several ways and parsed again."""
    d = F.col("o_orderdate")

    def again(form: str, order: str = "MDY") -> Column:
        return S.parse_date(F.concat(F.lit(" "), F.date_format(d, form), F.lit(".")), order)

    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), again("yyyy/M/d").alias("iso"), again("MM/dd/yyyy").alias("us"), again("dd.MM.yyyy", "DMY").alias("eu"),
        again("MMMM d, yyyy").alias("named"), again("MM-dd-yy").alias("short"), again("dd/MM/yyyy").alias("swapped"), S.parse_date(F.concat(F.lit("31/02/"), F.date_format(d, "yyyy"))).alias("invalid"),
    )


@_query(r"""
    SELECT doc_id, nullif(regexp_extract(text, '[\pL\pM\p{Nd}\p{Pc}.+-]+@[\pL\pM\p{Nd}\p{Pc}-]+(\.[\pL\pM\p{Nd}\p{Pc}-]+)+'), '') AS email FROM documents
""")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", S.extract(F.col("text"), P.EMAIL, 0).alias("email"))


_LABELS = [
    ("No.", "index"), ("#", "index"), ("Item No", "index"), ("Description", "description"), ("Item", "description"), ("Qty", "quantity"), ("Units sold", "quantity"),
    ("UM", "unit"), ("Gross worth", "gross_amount"), ("Net price", "unit_price"), ("Unit Price", "unit_price"), ("Rate", "unit_price"), ("VAT [%]", "vat_percent"),
    ("Net worth", "net_amount"), ("Amount", "net_amount"), ("Line total", "net_amount"), ("Colour", None), ("Price (EUR)", "unit_price"), ("Item code", "index"),
]


@_query(
    "SELECT r_regionkey::BIGINT AS region, label, kind FROM region, (VALUES "
    + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in _LABELS)
    + ") t(label, kind)"
)
def canon_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*[F.lit(a) for a, _ in _LABELS])
    rows = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("region"), F.explode(labels).alias("label"))
    return rows.select("region", "label", table.column_kind(F.col("label")).alias("kind"))


# ---- layout ---------------------------------------------------------------------------------


#: Characters of a part at most, so that a task sorts the words of its part in memory.
CHARS_A_PART = 2_000_000


def _dealt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id string, text) of documents dealt out by ``doc_id``: words are made where their text lies and are never shuffled."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS_A_PART)), "doc_id")


@_query(r"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(range(len(lines))) AS k, unnest(lines) AS line FROM d),
    w AS (SELECT doc_id, k, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS line_no, array_to_string(ws, ' ') AS text, len(ws)::BIGINT AS n_words
    FROM w WHERE len(ws) > 0
""")
def lines_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents placed by line with jitter, in scrambled order, and clustered into lines again."""
    lines = _dealt_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    words = lines.select("doc_id", "k", F.posexplode(F.filter(F.split("line", " "), lambda x: x != "")).alias("i", "text"))
    y = F.col("k") * 40 + F.pmod(F.xxhash64("doc_id", "k", "i"), F.lit(7)).cast("int")
    boxes = words.select(
        "doc_id", F.lit(1).alias("page_no"), F.xxhash64("doc_id", "k", "i").alias("word_idx"), "text", (F.col("i") * 100).alias("x0"), y.alias("y0"), (F.col("i") * 100 + 90).alias("x1"),
        (y + 24).alias("y1"), F.lit(100.0).alias("conf"),
    )
    return layout.page_lines(boxes).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "text", F.size("words").cast("long").alias("n_words"))


@_query(r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]'), lambda x: x <> '') AS ws FROM documents),
    u AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w)
    SELECT doc_id, (i // 12)::BIGINT AS line_no, string_agg(word, ' ' ORDER BY i) AS text, count(*)::BIGINT AS n_words FROM u GROUP BY ALL
""")
def lines_upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as pages of twelve words a line, each page turned by up to eleven degrees, turned back by their words' boxes and clustered into lines."""
    docs = _dealt_texts(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split("text", "[ \n]"), lambda x: x != "")).alias("i", "text"))
    angle = F.radians(F.pmod(F.col("doc_id").cast("long"), F.lit(23)) - 11)
    column, line = F.col("i") % 12, F.floor(F.col("i") / 12).cast("int")
    # a word is 90 wide and 24 high; its box after the turn about the origin
    x, y, c, s = column * 100 + 45.0, line * 40 + 12.0, F.cos(angle), F.sin(angle)
    xc, yc = c * x - s * y, s * x + c * y
    wide, high = (90 * c + 24 * F.abs(s)) / 2, (24 * c + 90 * F.abs(s)) / 2
    boxes = docs.select(
        "doc_id", F.lit(1).alias("page_no"), F.col("i").alias("word_idx"), "text", *(F.round(v).cast("int").alias(k) for k, v in (("x0", xc - wide), ("y0", yc - high), ("x1", xc + wide), ("y1", yc + high))),
        F.lit(100.0).alias("conf"),
    )
    lines = layout.page_lines(layout.upright(boxes))
    return lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "text", F.size("words").cast("long").alias("n_words"))


@_query(r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]'), lambda x: x <> '') AS ws FROM documents),
    u AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w),
    c AS (SELECT doc_id, i, word, (i // 4)::BIGINT AS cell FROM u)
    SELECT doc_id, cell, string_agg(word, ' ' ORDER BY i) AS text FROM c GROUP BY ALL
""")
def cells_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in lines of sixty words, with a wide gap behind every fourth word."""
    return split_cells(_table(spark, sf_dir, "documents"))


def split_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, cell, text): cells are numbered through a document, fifteen a full line."""
    words = docs.select("doc_id", F.filter(F.split("text", "[ \n]"), lambda x: x != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.size("words"), F.lit(60))
    lines = words.select("doc_id", F.posexplode(F.transform(starts, lambda k: F.slice("words", k, 60))).alias("line", "words"))
    boxed = F.transform("words", lambda t, i: F.struct(t.alias("text"), (i * 100 + F.floor(i / 4).cast("int") * 200).alias("x0"), (i * 100 + F.floor(i / 4).cast("int") * 200 + 90).alias("x1")))
    rows = lines.select("doc_id", "line", boxed.alias("words"))
    found = rows.select("doc_id", "line", F.posexplode(layout.cells(F.col("words"), F.lit(24))).alias("cell", "ws"))
    return found.select("doc_id", (F.col("line") * 15 + F.col("cell")).cast("long").alias("cell"), layout.joined(F.col("ws")).alias("text"))


@_query(f"""
    WITH {_LINES}
    SELECT l_orderkey AS orderkey, line::BIGINT AS line, 1::BIGINT AS n_words, net / 100.0::DOUBLE AS value FROM m
""")
def numbers_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts printed as '1 394,67' behind a lone currency sign, put together again."""
    rows = render.priced_lines(spark, sf_dir).select("l_orderkey", "line", F.concat(F.lit("$ "), render.amount(F.col("net"))).alias("t"))
    word = F.transform(F.split("t", " "), lambda t, i: F.struct(t.alias("text"), (i * 60).alias("x0"), F.lit(0).alias("y0"), (i * 60 + 50).alias("x1"), F.lit(24).alias("y1"), F.lit(90.0).alias("conf")))
    merged = rows.select("l_orderkey", "line", layout.number_words(word).alias("ws"))
    return merged.select(
        F.col("l_orderkey").alias("orderkey"), F.col("line").cast("long").alias("line"), F.size("ws").cast("long").alias("n_words"),
        S.money(S.parse_number(F.get("ws", 0)["text"])).alias("value"),
    )


@_query(f"""
    WITH {_LINES}, n AS (SELECT l_orderkey, max(line) AS n FROM m GROUP BY 1),
    d AS (SELECT l_orderkey, n, unnest(range(2 * n)) AS j FROM n),
    j AS (SELECT d.l_orderkey, d.j, d.n, arg_min(m.line, (abs(60 * (m.line - 1) - 30 * d.j), m.line)) AS line FROM d JOIN m USING (l_orderkey) GROUP BY ALL),
    t AS (SELECT l_orderkey, line, n, string_agg('text' || j, ' ' ORDER BY j) AS description FROM j GROUP BY ALL)
    SELECT l_orderkey AS orderkey, m.line::BIGINT AS line, description, q::DOUBLE AS quantity, net / 100.0::DOUBLE AS net_amount, n > 1 AS fallback
    FROM m JOIN t USING (l_orderkey, line)
""")
def nearest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many evenly spaced description lines as rows: no gap groups them, and each goes to the nearest row, the upper one of two."""
    rows = render.dealt_lines(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "quantity", "net"))).alias("rows"))
    piece = render.text_at
    header = F.array(*[piece(x, F.lit(440), F.lit(label)) for x, label in ((200, "Description"), (700, "Qty"), (1100, "Net worth"))])
    amounts = F.flatten(
        F.transform(
            "rows", lambda r: F.array(piece(700, F.lit(500) + 60 * (r["line"] - 1), render.amount(r["quantity"] * 100)), piece(1100, F.lit(500) + 60 * (r["line"] - 1), render.amount(r["net"])))
        )
    )
    described = F.transform(F.sequence(F.lit(0), 2 * F.size("rows") - 1), lambda j: piece(200, F.lit(500) + 30 * j, F.concat(F.lit("text"), j.cast("string"))))
    words = render.words_of(rows.select("doc_id", F.concat(header, amounts, described).alias("texts")))
    pages = table.page_rows(table.zoned(layout.page_lines(words).withColumn("width", F.lit(render.WIDTH))))
    found = table.items(pages, ("fallback",)).where("line is not null")
    return found.select(F.col("doc_id").cast("long").alias("orderkey"), F.col("line").cast("long").alias("line"), "description", "quantity", "net_amount", "fallback")


@_query(f"""
    WITH {_LINES}
    SELECT l_orderkey AS orderkey, line::BIGINT AS line, q::DOUBLE AS quantity, net / 100.0::DOUBLE AS net_amount FROM m
""")
def numeric_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities printed as noise, with a table of second readings."""
    words = render.rendered(spark, sf_dir).drop("width")
    spoiled = (F.col("x0") == 700) & F.col("text").rlike(r"^\d")
    rereads = words.where(spoiled).select("doc_id", "page_no", "word_idx", "text")
    broken = words.withColumn("text", F.when(spoiled, "l?").otherwise(F.col("text")))
    rows = table.zoned(layout.page_lines(broken).withColumn("width", F.lit(render.WIDTH)))
    found = table.items(table.page_rows(table.with_rereads(rows, rereads)))
    return found.select(F.col("doc_id").cast("long").alias("orderkey"), F.col("line").cast("long").alias("line"), "quantity", "net_amount")


# ---- pages to documents ---------------------------------------------------------------------


@_query(f"""
    WITH {_LINES}, p AS (SELECT l_orderkey AS k, unnest(range(1, 4)) AS p FROM (SELECT DISTINCT l_orderkey FROM m)),
    v AS (SELECT k, p, CASE WHEN (k + p) % 3 <> 0 THEN 'N' || p ELSE '' END AS no, CASE WHEN (k + p) % 4 = 0 THEN 'S' || p END AS seller, (k + p) % 5 < 3 AS has_seller,
                 (k + p) % 2 = 0 AS has_summary, CASE WHEN (k + p) % 4 = 2 THEN p * 10.0::DOUBLE END AS total FROM p WHERE p <= 2 + k % 2),
    g AS (SELECT k, count(*) AS pages, arg_min(no, p) FILTER (no <> '') AS invoice_number, arg_min(struct_pack(s := seller), p) FILTER (has_seller) AS s,
                 max(p) FILTER (has_summary AND total IS NOT NULL) AS with_total, min(p) FILTER (has_summary) AS with_any, string_agg('w' || p, ',' ORDER BY p) AS warnings, bool_or(p = 2) AS table_found
          FROM v GROUP BY k),
    i AS (SELECT l_orderkey AS k, string_agg(line || '/' || p, ',' ORDER BY p, line) AS items
          FROM (SELECT l_orderkey, line, line % (2 + l_orderkey % 2) + 1 AS p FROM m) GROUP BY 1)
    SELECT k AS orderkey, pages::BIGINT AS pages, invoice_number, s.s AS seller_name, coalesce(with_total, with_any)::DOUBLE AS subtotal, with_total * 10.0::DOUBLE AS total, warnings, table_found, items
    FROM g JOIN i USING (k)
""")
def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two or three pages, with gaps by order and page number, merged into documents. Items carry their old number and page in the description."""
    rows = render.priced_lines(spark, sf_dir).select("l_orderkey", "line")
    n = F.lit(2) + F.col("l_orderkey") % 2
    item = F.struct("line", F.concat_ws("/", "line", "page_no").alias("description"), *[F.lit(None).cast("double").alias(c) for c in ("quantity",)], F.lit(None).cast("string").alias("unit"), *[F.lit(None).cast("double").alias(c) for c in ("unit_price", "vat_percent", "net_amount", "gross_amount")])
    items = rows.withColumn("page_no", (F.col("line") % n + 1).cast("int")).groupBy("l_orderkey", "page_no").agg(F.array_sort(F.collect_list(item.cast(ITEM))).alias("items"))
    pages = rows.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("page_no"))
    k = F.col("l_orderkey") + F.col("page_no")
    text, number, p = F.lit(None).cast("string"), F.lit(None).cast("double"), F.col("page_no").cast("string")
    seller = F.struct(F.when(k % 4 == 0, F.concat(F.lit("S"), p)).alias("name"), *[text.alias(f) for f in PARTY_FIELDS[1:]]).cast(PARTY)
    summary = F.struct(
        F.col("page_no").cast("double").alias("subtotal"), *[number.alias(f) for f in ("tax", "tax_rate", "discount")], F.expr("array()").cast(f"array<{CHARGE}>").alias("other_charges"),
        F.when(k % 4 == 2, F.col("page_no") * 10.0).alias("total"), number.alias("amount_paid"), number.alias("amount_due"),
    ).cast(SUMMARY)
    results = pages.join(items, ["l_orderkey", "page_no"], "left").select(
        F.col("l_orderkey").alias("doc_id"), "page_no", F.when(k % 3 != 0, F.concat(F.lit("N"), p)).otherwise("").alias("invoice_number"), *[text.alias(c) for c in ("date", "due_date", "currency")],
        F.when(k % 5 < 3, seller).alias("seller"), F.lit(None).cast(PARTY).alias("client"), F.coalesce("items", F.expr("array()").cast(f"array<{ITEM}>")).alias("items"),
        F.when(k % 2 == 0, summary).alias("summary"), F.lit(None).cast(PAYMENT).alias("payment"), F.array(F.concat(F.lit("w"), p)).alias("warnings"), (F.col("page_no") == 2).alias("table_found"),
    )
    found = assemble.documents(results)
    renumbered = F.forall("items", lambda x: F.get("items", x["line"] - 1)["description"] == x["description"])
    return found.select(
        F.col("doc_id").alias("orderkey"), F.col("pages").cast("long").alias("pages"), "invoice.invoice_number", F.col("seller.name").alias("seller_name"), "summary.subtotal", "summary.total",
        F.concat_ws(",", "warnings").alias("warnings"), "table_found", F.when(renumbered, F.concat_ws(",", F.transform("items", lambda x: x["description"]))).alias("items"),
    )


@_query("""
    WITH p AS (SELECT user_id, ts::DATE AS d, avg(1.0 * (event_id % 101)) / 100 AS c FROM events GROUP BY ALL)
    SELECT user_id, round(avg(c), 9) AS confidence FROM p GROUP BY user_id
""")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as words: users are documents, days are pages."""
    words = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.to_date("ts").alias("page_no"), (F.col("event_id") % 101).cast("double").alias("conf"))
    return assemble.page_confidence(words).select(F.col("doc_id").alias("user_id"), F.round("confidence", 9).alias("confidence"))


# ---- checks ---------------------------------------------------------------------------------

_CLOSE = "abs({a} - {b}) <= greatest(0.03, 0.003 * greatest(abs({a}), abs({b})))"


def _close_sql(a: str, b: str) -> str:
    return _CLOSE.format(a=f"({a})", b=f"({b})")


_WEIGHED = f"""
    WITH {_LINES},
    i AS (SELECT l_orderkey, line, CASE WHEN line % 5 = 0 THEN 1000 ELSE 1 END * q::DOUBLE AS q, CASE WHEN line % 4 = 1 THEN NULL ELSE price / 100.0::DOUBLE END AS p,
                 CASE WHEN line % 7 = 3 THEN 10 ELSE 1 END * net / 100.0::DOUBLE AS n, CASE WHEN line % 6 = 2 THEN NULL ELSE gross / 100.0::DOUBLE END AS g, vat::DOUBLE AS vat FROM m),
    w AS (SELECT *, q >= 1000 AND p IS NOT NULL AND NOT ({_close_sql('q * p', 'n')}) AND {_close_sql('q / 1000 * p', 'n')} AS heavy FROM i),
    r AS (SELECT l_orderkey, line, CASE WHEN heavy THEN q / 1000 ELSE q END AS q, p, n, g, vat FROM w),
    d AS (SELECT l_orderkey, line, q, coalesce(p, format('{{:.2f}}', n / q)::DOUBLE) AS p, p IS NULL AS derived, n, g, vat FROM r)
"""


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with quantities off by 1000, prices and gross amounts missing, and net amounts off by ten, by line number."""
    line = F.col("line")

    def one_in(n: int, k: int) -> Column:
        return F.pmod(line, F.lit(n)) == k

    return render.priced_lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), "line", (F.when(one_in(5, 0), 1000).otherwise(1) * F.col("quantity").cast("double")).alias("quantity"),
        F.when(~one_in(4, 1), F.col("price") / 100.0).alias("unit_price"), (F.when(one_in(7, 3), 10).otherwise(1) * F.col("net") / 100.0).alias("net_amount"),
        F.when(~one_in(6, 2), F.col("gross") / 100.0).alias("gross_amount"), F.col("vat").cast("double").alias("vat_percent"),
    )


@_query(_WEIGHED + "SELECT l_orderkey AS orderkey, line::BIGINT AS line, q AS quantity, p AS unit_price, derived, n AS net_amount FROM d")
def weight_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.line_checks(_weighed(spark, sf_dir))
    return found.select(F.col("doc_id").alias("orderkey"), F.col("line").cast("long").alias("line"), "quantity", "unit_price", "derived", "net_amount")


@_query(
    _WEIGHED
    + f"""SELECT l_orderkey AS orderkey, line::BIGINT AS line, concat_ws(',',
        CASE WHEN NOT ({_close_sql('q * p', 'n')}) THEN 'item_' || line || ':qty_x_price_ne_net' END,
        CASE WHEN g IS NOT NULL AND NOT ({_close_sql('n * (1 + vat / 100)', 'g')}) THEN 'item_' || line || ':net_plus_vat_ne_gross' END) AS faults FROM d"""
)
def validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.line_checks(_weighed(spark, sf_dir))
    return found.select(F.col("doc_id").alias("orderkey"), F.col("line").cast("long").alias("line"), F.concat_ws(",", "faults").alias("faults"))


_INVOICES_SQL = f"""
    WITH {_LINES},
    s AS (SELECT l_orderkey AS k, count(*) AS n, sum(net)::BIGINT AS sub, sum(gross - net)::BIGINT AS tax, sum(gross)::BIGINT AS tot FROM m GROUP BY 1),
    o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_orderkey::VARCHAR END AS no, CASE WHEN o_orderkey % 7 = 2 THEN NULL ELSE 'd' END AS d,
                 CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE 'x' END AS party, CASE WHEN o_orderkey % 5 = 1 THEN 10 ELSE 1 END AS wrong, o_orderkey % 17 = 4 AS no_total FROM orders),
    j AS (SELECT o.*, n, sub * wrong AS sub, tax, CASE WHEN NOT no_total THEN coalesce(tot, 0) END AS tot FROM o LEFT JOIN s USING (k)),
    f AS (SELECT k, n, no, d, tot, party,
                 (n IS NULL)::INT + (n IS NOT NULL AND wrong = 10)::INT + (n IS NOT NULL AND tot IS NOT NULL AND wrong = 10)::INT AS bad,
                 concat_ws(',', CASE WHEN n IS NULL THEN 'no_line_items' END, CASE WHEN n IS NOT NULL AND wrong = 10 THEN 'items_sum_ne_subtotal' END,
                     CASE WHEN n IS NOT NULL AND tot IS NOT NULL AND wrong = 10 THEN 'subtotal_plus_tax_ne_total' END,
                     CASE WHEN no IS NULL THEN 'missing:invoice_number' END, CASE WHEN d IS NULL THEN 'missing:date' END, CASE WHEN tot IS NULL THEN 'missing:total' END,
                     CASE WHEN party IS NULL THEN 'missing:parties' END) AS warnings,
                 (no IS NULL)::INT + (d IS NULL)::INT + (tot IS NULL)::INT + (party IS NULL)::INT AS missing FROM j),
    c AS (SELECT *, format('{{:.3f}}', 0.97::DOUBLE * pow(0.85::DOUBLE, bad) * pow(0.95::DOUBLE, missing))::DOUBLE AS confidence FROM f),
    t AS (SELECT *, CASE WHEN bad > 0 OR confidence < 0.8 THEN 'needs_review' ELSE 'ok' END AS status FROM c)
"""


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made from orders, with gaps and wrong subtotals by order number."""
    k = F.col("o_orderkey")
    lines = render.priced_lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "line", F.col("p_name").alias("description"), F.col("quantity").cast("double").alias("quantity"), F.lit("each").alias("unit"), (F.col("price") / 100.0).alias("unit_price"),
                    F.col("vat").cast("double").alias("vat_percent"), (F.col("net") / 100.0).alias("net_amount"), (F.col("gross") / 100.0).alias("gross_amount"),
                ).cast(ITEM)
            )
        ).alias("items"),
        F.sum("net").alias("sub"), F.sum(F.col("gross") - F.col("net")).alias("tax"), F.sum("gross").alias("tot"),
    )
    rows = _table(spark, sf_dir, "orders").join(lines, k == F.col("l_orderkey"), "left")
    text = F.lit(None).cast("string")
    wrong = F.when(F.pmod(k, F.lit(5)) == 1, 10).otherwise(1)
    name = F.when(F.pmod(k, F.lit(13)) != 5, "x")
    party = F.struct(name.alias("name"), *[text.alias(f) for f in PARTY_FIELDS[1:]]).cast(PARTY)
    none = F.lit(None).cast("double")
    # the wrong subtotal makes both sums wrong; without lines there is no subtotal
    summary = F.struct(
        (F.col("sub") * wrong / 100.0).alias("subtotal"), (F.col("tax") / 100.0).alias("tax"), none.alias("tax_rate"), none.alias("discount"),
        F.expr("array()").cast(f"array<{CHARGE}>").alias("other_charges"), F.when(F.pmod(k, F.lit(17)) != 4, F.coalesce("tot", F.lit(0)) / 100.0).alias("total"), none.alias("amount_paid"), none.alias("amount_due"),
    ).cast(SUMMARY)
    return rows.select(
        k.alias("orderkey"),
        F.struct(F.when(F.pmod(k, F.lit(11)) != 3, k.cast("string")).alias("invoice_number"), F.when(F.pmod(k, F.lit(7)) != 2, "d").alias("date"), text.alias("due_date"), text.alias("currency")).alias("invoice"),
        party.alias("seller"), party.alias("client"), F.coalesce("items", F.expr("array()").cast(f"array<{ITEM}>")).alias("items"), summary.alias("summary"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    return checks.scored(_invoices(spark, sf_dir), F.lit(0.97), none, none)


@_query(_INVOICES_SQL + "SELECT k AS orderkey, bad::BIGINT AS bad, warnings FROM t")
def validate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("orderkey", F.size("bad").cast("long").alias("bad"), F.concat_ws(",", "warnings").alias("warnings"))


@_query(_INVOICES_SQL + "SELECT k AS orderkey, confidence, status FROM t")
def score_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("orderkey", "confidence", "status")


@_query(
    _INVOICES_SQL
    + "SELECT k AS orderkey, status = 'needs_review' OR no IS NULL OR d IS NULL OR tot IS NULL OR n IS NULL OR party IS NULL AS auto, true AS always, false AS off FROM t"
)
def gate_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("status", "invoice", "items", "summary", "seller", "client")]
    return _scored(spark, sf_dir).select("orderkey", *[reconcile.should_ask(m, *parts).alias(m) for m in reconcile.MODES])


# ---- reconciliation -------------------------------------------------------------------------


def _with_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, and answers that fill gaps, contradict, or are wrong, by order number."""
    k = F.col("orderkey")
    rows = _invoices(spark, sf_dir)
    mod = lambda n: F.pmod(k, F.lit(n))
    party = F.struct(F.when(mod(3) == 0, "y").otherwise(" X ").alias("name"), F.when(mod(3) == 1, "road").alias("address"), F.lit("").alias("tax_id"), F.lit(None).cast("string").alias("email"))
    items = F.when(mod(4) == 0, F.slice("items", 1, 0)).otherwise(F.transform("items", lambda x: x.withField("net_amount", F.when(mod(4) == 1, x["net_amount"] * 3).otherwise(x["net_amount"]))))
    answer = F.struct(
        F.when(mod(2) == 0, k.cast("string")).otherwise("other").alias("invoice_number"), F.when(mod(3) == 0, "2020-01-02").otherwise("13th Sept").alias("date"), F.lit(None).cast("string").alias("due_date"),
        F.lit(" usd ").alias("currency"), party.alias("seller"), party.alias("client"),
        F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in ("description", "quantity", "unit", "unit_price", "vat_percent", "net_amount", "gross_amount")])).cast(f"array<{ANSWER_ITEM}>").alias("items"),
        *[F.col(f"summary.{f}").alias(f) for f in ("tax", "tax_rate", "discount")],
        F.when(mod(6) == 1, F.col("summary.subtotal") / 10).otherwise(F.col("summary.subtotal")).alias("subtotal"), F.lit(5.0).alias("amount_due"), F.col("summary.total").alias("total"), F.lit(None).cast("double").alias("amount_paid"),
        F.lit(None).cast(PAYMENT).alias("payment"),
    )
    payment = F.struct(*[F.lit(None).cast("string").alias(f) for f in PAYMENT_FIELDS]).cast(PAYMENT)
    return rows.withColumns({"answer": answer, "payment": payment, "warnings": F.expr("cast(array() as array<string>)"), "trusted": mod(2) == 1})


@_query("""
    WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_orderkey::VARCHAR END AS no, CASE WHEN o_orderkey % 7 = 2 THEN NULL ELSE 'd' END AS d,
                      CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE 'x' END AS name, o_orderkey % 2 = 1 AS trusted FROM orders),
    a AS (SELECT *, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE 'other' END AS a_no, CASE WHEN k % 3 = 0 THEN '2020-01-02' END AS a_d, CASE WHEN k % 3 = 0 THEN 'y' ELSE ' X ' END AS a_name FROM o),
    t AS (SELECT *, no IS NULL OR (no <> a_no AND NOT trusted) AS t_no, a_d IS NOT NULL AND (d IS NULL OR NOT trusted) AS t_d,
                 name IS NULL OR (k % 3 = 0 AND NOT trusted) AS t_name, k % 3 = 1 AS t_address FROM a)
    SELECT k AS orderkey, CASE WHEN t_no THEN a_no ELSE no END AS invoice_number, CASE WHEN t_d THEN a_d ELSE d END AS date, 'USD' AS currency,
           CASE WHEN t_name THEN a_name ELSE name END AS seller_name, CASE WHEN t_address THEN 'road' END AS client_address,
           concat_ws(',', CASE WHEN t_no THEN 'invoice.invoice_number' END, CASE WHEN t_d THEN 'invoice.date' END, 'invoice.currency',
               CASE WHEN t_name THEN 'seller.name' END, CASE WHEN t_address THEN 'seller.address' END, CASE WHEN t_name THEN 'client.name' END, CASE WHEN t_address THEN 'client.address' END) AS fields
    FROM t
""")
def reconcile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = reconcile.merge(_with_answers(spark, sf_dir))
    paths = F.filter("fields", lambda f: f.startswith("invoice.") | f.startswith("seller.") | f.startswith("client."))
    return merged.select(
        "orderkey", "invoice.invoice_number", "invoice.date", "invoice.currency", F.col("seller.name").alias("seller_name"), F.col("client.address").alias("client_address"), F.concat_ws(",", paths).alias("fields")
    )


@_query(f"""
    WITH {_LINES},
    s AS (SELECT l_orderkey AS k, count(*) AS n, sum(net)::BIGINT AS s, sum(gross - net)::BIGINT AS t FROM m GROUP BY 1),
    c AS (SELECT *, k % 2 = 1 AS trusted, k % 4 IN (1, 3) AS r_bad, k % 4 IN (2, 3) AS a_bad, k % 3 = 0 AS r_wrong, k % 5 = 0 AS a_none FROM s),
    p AS (SELECT *, CASE WHEN r_bad THEN n ELSE 0 END + (r_bad OR r_wrong)::INT + r_wrong::INT AS rr, CASE WHEN a_bad THEN n + 1 ELSE 0 END AS aa,
                 CASE WHEN r_bad THEN n + 1 ELSE 0 END AS ra, CASE WHEN a_bad THEN n ELSE 0 END + (a_bad OR r_wrong)::INT + r_wrong::INT AS ar FROM c),
    o AS (SELECT k, 'rr' AS c, rr AS bad, CASE WHEN trusted THEN 0 ELSE 1 END AS place FROM p
          UNION ALL SELECT k, 'aa', aa, CASE WHEN trusted THEN 1 ELSE 0 END FROM p WHERE NOT a_none
          UNION ALL SELECT k, 'ra', ra, CASE WHEN trusted THEN 2 ELSE 3 END FROM p WHERE NOT a_none
          UNION ALL SELECT k, 'ar', ar, CASE WHEN trusted THEN 3 ELSE 2 END FROM p WHERE NOT a_none),
    b AS (SELECT k, arg_min(c, (bad, place)) AS c FROM o GROUP BY k)
    SELECT k AS orderkey, left(c, 1) = 'a' AS answered_items, n::BIGINT AS items, CASE WHEN right(c, 1) = 'r' AND r_wrong THEN 10 ELSE 1 END * s / 100.0::DOUBLE AS subtotal
    FROM b JOIN p USING (k)
""")
def reconcile_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and subtotals of either side wrong by order number: the combination with the fewest problems wins."""
    k = F.col("orderkey")
    rows = _with_answers(spark, sf_dir).where(F.size("items") > 0)
    mod = lambda n: F.pmod(k, F.lit(n))

    def spoiled(test: Column, c: str) -> Column:
        return F.transform(c, lambda x: x.withField("net_amount", F.when(test, x["net_amount"] * 3).otherwise(x["net_amount"])).withField("gross_amount", F.lit(None).cast("double")))

    plain = F.aggregate(F.transform("items", lambda x: F.round(x["net_amount"] * 100).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    tax = F.col("summary.tax")
    total = (plain + F.round(tax * 100).cast("long")) / 100.0
    own = F.col("summary").withField("subtotal", F.when(mod(3) == 0, plain * 10).otherwise(plain) / 100.0).withField("total", total)
    theirs = F.transform(spoiled(mod(4).isin(2, 3), "items"), lambda x: F.struct(*[x[f].alias(f) for f in ("description", "quantity", "unit", "unit_price", "vat_percent", "net_amount", "gross_amount")])).cast(f"array<{ANSWER_ITEM}>")
    answer = F.col("answer").withField("items", F.when(mod(5) == 0, F.slice(theirs, 1, 0)).otherwise(theirs)).withField("subtotal", plain / 100.0).withField("tax", tax).withField("total", total)
    rows = rows.withColumns({"items": spoiled(mod(4).isin(1, 3), "items"), "summary": own, "answer": answer})
    merged = reconcile.merge(rows)
    return merged.select("orderkey", F.array_contains("fields", "items").alias("answered_items"), F.size("items").cast("long").alias("items"), "summary.subtotal")


@_query("""
    SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, '') || '|m|1')) AS answered_by,
           min(doc_id) OVER (PARTITION BY sha256(coalesce(text, '') || '|m|1')) % 3 = 0 AS hit
    FROM documents
""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers stored by content: equal texts share one."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    key = S.content_key(F.col("content"), "m", "1")
    firsts = docs.groupBy(key.alias("content_key")).agg(F.min("doc_id").alias("answer"))
    answers = firsts.where("answer % 3 = 0")
    found = reconcile.cached(docs, answers, key)
    return found.join(firsts.withColumnRenamed("answer", "answered_by"), "content_key").select("doc_id", "answered_by", "hit")


@_query("""
    WITH k AS (SELECT doc_id, sha256(coalesce(text, '') || '|m|1') AS key FROM documents)
    SELECT doc_id FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)
""")
def cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    key = S.content_key(F.col("content"), "m", "1")
    answers = docs.where("doc_id % 3 = 0").select(key.alias("content_key")).distinct()
    return reconcile.missed(docs, answers, key).select("doc_id")


# ---- quota ----------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str, speed: int = 1) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("event_id").alias("request_id"), F.timestamp_micros(F.floor(micros / speed).cast("long")).alias("ts"))


@_query("""
    WITH e AS (SELECT event_id, ts, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS d FROM events)
    SELECT event_id AS request_id, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) <= 20 AS admitted FROM e
""")
def quota_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.first_of_day(_requests(spark, sf_dir)).select("request_id", "admitted")


@_query("""
    WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) // 1000 AS us, ((make_timestamp(epoch_us(ts) // 1000) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS d FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY us, event_id) AS n FROM e),
    f AS (SELECT d, n, event_id, true AS admitted, [us] AS recent, 1 AS c FROM o WHERE n = 1
          UNION ALL
          SELECT d, n, event_id, yes, CASE WHEN yes THEN list_append(live, us) ELSE live END, c + yes::INT
          FROM (SELECT o.d, o.n, o.event_id, o.us, f.c, list_filter(f.recent, lambda t: o.us - t < 60000000) AS live,
                       len(list_filter(f.recent, lambda t: o.us - t < 60000000)) < 3 AND f.c < 60 AS yes
                FROM f JOIN o ON o.d = f.d AND o.n = f.n + 1))
    SELECT event_id AS request_id, admitted FROM f
""")
def quota_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission with both limits over events a thousand times as fast."""
    return quota.admitted(_requests(spark, sf_dir, 1000), per_minute=3, per_day=60).select("request_id", "admitted")


@_query("""
    WITH e AS (SELECT event_id, ts, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS d FROM events),
    a AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) <= 20 AS ok FROM e),
    n AS (SELECT max(ts) AS now, max(d) AS today FROM e)
    SELECT greatest(10 - count(*) FILTER (ok AND d = today AND now - ts < INTERVAL 60 SECOND), 0)::BIGINT AS remaining_this_minute,
           greatest(20 - count(*) FILTER (ok AND d = today), 0)::BIGINT AS remaining_today, 10::BIGINT AS limit_per_minute, 20::BIGINT AS limit_per_day
    FROM a, n
""")
def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    now = requests.agg(F.max("ts")).first()[0]
    return quota.status(quota.first_of_day(requests), F.lit(now))


# ---- sources --------------------------------------------------------------------------------

_STARTS = [
    ("255044462D312E34", "pdf"), ("FFD8FFE000104A46", "jpeg"), ("89504E470D0A1A0A00", "png"), ("49492A0008", "tiff"), ("4D4D002A00", "tiff"),
    ("524946460000000057454250", "webp"), ("5249464600000000574156", None), ("504B030400", None), ("", None), ("68656C6C6F", None),
]


@_query(
    "SELECT r_regionkey::BIGINT AS region, head, kind FROM region, (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in _STARTS) + ") t(head, kind)"
)
def sniff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("region"), F.explode(F.array(*[F.lit(a) for a, _ in _STARTS])).alias("head"))
    return files.sniffed(rows.withColumn("content", F.unhex("head"))).select("region", "head", "kind")


@_query("""
    SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR strlen(coalesce(text, '')) = 0 THEN 400 WHEN strlen(text) > 9000 THEN 413 WHEN doc_id % 10 <> 1 THEN 415 END::INT AS error_code,
           CASE WHEN doc_id % 10 = 1 AND strlen(coalesce(text, '')) BETWEEN 1 AND 9000 THEN 'pdf' END AS kind
    FROM documents
""")
def batch_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: some are empty, too large or of no known type; each has a row."""
    text = F.when(F.col("doc_id") % 10 != 0, F.coalesce("text", F.lit(""))).otherwise("")
    size = F.octet_length(text).cast("long")
    lead = F.when((F.col("doc_id") % 10 == 1) & (size > 0), F.concat(F.lit("%PDF-"), text)).otherwise(text)
    rows = _table(spark, sf_dir, "documents").select("doc_id", size.alias("length"), lead.cast("binary").alias("content"))
    return files.judged(rows, 9000).select("doc_id", F.col("error_code").cast("int").alias("error_code"), "kind")


# ---- whole records and evaluation -----------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = render.rendered(spark, sf_dir).drop("width")
    return extract.extract(words, render.pages(spark, sf_dir))


@_query(f"""
    WITH {_LINES}, s AS (SELECT l_orderkey, count(*) AS items, sum(gross)::BIGINT AS total FROM m GROUP BY 1)
    SELECT l_orderkey AS orderkey, 1::BIGINT AS pages, 'pdf-text-layer' AS engine, 'ok' AS status, 1.0::DOUBLE AS confidence, items::BIGINT AS items, '' AS warnings, 'off' AS llm FROM s
""")
def extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.metrics(_records(spark, sf_dir))
    return found.select(
        F.col("doc_id").cast("long").alias("orderkey"), F.col("pages").cast("long").alias("pages"), "engine", "status", "confidence", F.col("items").cast("long").alias("items"),
        F.concat_ws(",", "warnings").alias("warnings"), "llm",
    )


@_query(f"""
    WITH {_LINES}, s AS (SELECT l_orderkey, count(*) AS n, sum(gross)::BIGINT AS total FROM m GROUP BY 1)
    SELECT l_orderkey AS orderkey, (1000000 + l_orderkey)::VARCHAR AS invoice_number, total / 100.0::DOUBLE AS total, n::BIGINT AS items FROM s
""")
def extraction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON text, read back by path."""
    found = extract.as_json(_records(spark, sf_dir))
    j = F.col("json")
    return found.select(
        F.col("doc_id").cast("long").alias("orderkey"), F.get_json_object(j, "$.invoice.invoice_number").alias("invoice_number"),
        F.get_json_object(j, "$.summary.total").cast("double").alias("total"), F.json_array_length(F.get_json_object(j, "$.items")).cast("long").alias("items"),
    )


@_query("""
    WITH n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
    SELECT field, n::BIGINT AS hits, n::BIGINT AS total, 1.0::DOUBLE AS accuracy
    FROM n, (VALUES ('invoice_number'), ('invoice_date'), ('seller_name'), ('client_name'), ('seller_address'), ('client_address'), ('tax_total'), ('grand_total'), ('item_count')) t(field)
""")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered orders, extracted and held against the orders themselves."""
    return evaluate.accuracy(evaluate.document_hits(_records(spark, sf_dir), _truth(spark, sf_dir)))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = render.priced_lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("s"), F.sum(F.col("gross") - F.col("net")).alias("tax"), F.sum("gross").alias("total"),
        F.array_sort(F.collect_list(F.struct("line", F.col("p_name").alias("description"), F.concat(F.col("quantity").cast("string"), F.lit(",00")).alias("quantity"), render.amount(F.col("net")).alias("total_price")))).alias("items"),
    )
    seller = _table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("s_nation"))
    client = _table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", F.col("n_name").alias("c_nation"))
    rows = lines.join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("s") == F.col("s_suppkey")).join(client, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.struct(
            (F.lit(1_000_000) + F.col("o_orderkey")).cast("string").alias("invoice_number"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("invoice_date"), F.col("s_name").alias("seller_name"),
            F.col("c_name").alias("client_name"), F.col("s_nation").alias("seller_address"), F.col("c_nation").alias("client_address"),
        ).alias("invoice"),
        F.struct(render.amount(F.col("tax")).alias("tax"), render.amount(F.col("total")).alias("total")).alias("subtotal"), "items",
    )


@_query(f"""
    WITH {_LINES}, n AS (SELECT count(*) AS n FROM m)
    SELECT field, n::BIGINT AS hits, n::BIGINT AS total, 1.0::DOUBLE AS accuracy FROM n, (VALUES ('item_quantity'), ('item_amount'), ('item_description')) t(field)
""")
def item_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(evaluate.item_hits(_records(spark, sf_dir), _truth(spark, sf_dir)))


@_query("""
    SELECT count(*) AS n, round(avg(v), 6) AS mean_ms, (list_sort(list(v)))[greatest((count(*) * 0.95)::DOUBLE // 1, 1)::BIGINT]::BIGINT AS p95_ms
    FROM (SELECT (event_id * 7919) % 5003 AS v FROM events)
""")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(((F.col("event_id") * 7919) % 5003).alias("ms"))
    return evaluate.latency(rows).select("n", F.round("mean_ms", 6).alias("mean_ms"), "p95_ms")


@_query()
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratcliff-Obershelp similarity of each benchmark text with the next: no SQL counterpart; tests hold it against difflib."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", S.truth_text(F.col("text")).alias("t"))
    pairs = rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")), "item_id")
    return pairs.select("item_id", F.round(S.similarity("t", "u"), 6).alias("ratio"))
