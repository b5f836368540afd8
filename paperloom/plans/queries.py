"""Registered queries over the reference operators, with SQL for the same rows from the base tables.

Rendered queries print orders as word boxes and read them back; their SQL sees the base tables only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..operators import fields, layout, table, totals
from ..ship import ship
from . import render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of orders in cents, as the renderer prints them.
_LINES = """
    l AS (SELECT l_orderkey, l_suppkey, p_name, l_quantity::BIGINT AS q, round(l_extendedprice * 100)::BIGINT AS net, round(l_tax * 100)::BIGINT AS vat,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line
          FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT *, (2 * net + q) // (2 * q) AS price, (net * (100 + vat) + 50) // 100 AS gross FROM l)
"""


def _parsed(spark: SparkSession, sf_dir: str, shape: render.Layout = render.Layout()) -> DataFrame:
    words = render.rendered(spark, sf_dir, shape)
    return table.zoned(layout.page_lines(words.drop("width")).withColumn("width", F.lit(render.WIDTH)))


def _items_sql(description: str = "p_name", unit: str = "'each'") -> str:
    return f"""
        WITH {_LINES}
        SELECT l_orderkey AS orderkey, line::BIGINT AS line, {description} AS description, q::DOUBLE AS quantity, {unit} AS unit,
               price / 100.0::DOUBLE AS unit_price, vat::DOUBLE AS vat_percent, net / 100.0::DOUBLE AS net_amount, gross / 100.0::DOUBLE AS gross_amount
        FROM m
    """


def _items(rows: DataFrame) -> DataFrame:
    found = table.items(table.page_rows(rows))
    return found.select(
        F.col("doc_id").cast("long").alias("orderkey"), F.col("line").cast("long").alias("line"), "description", "quantity", "unit", "unit_price", "vat_percent", "net_amount", "gross_amount"
    )


@_query(_items_sql())
def items_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(_parsed(spark, sf_dir))


@_query(_items_sql("p_name || ' lot ' || line"))
def block_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of two lines each, grouped into rows by the gap between lines."""
    return _items(_parsed(spark, sf_dir, render.Layout(wrap=True)))


@_query(_items_sql(unit="CASE WHEN line % 2 = 1 THEN 'each' END"))
def slot_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a unit: their words go to the nearest column."""
    return _items(_parsed(spark, sf_dir, render.Layout(drop_unit=True)))


@_query(f"""
    WITH {_LINES}
    SELECT l_orderkey AS orderkey, sum(net)::BIGINT / 100.0::DOUBLE AS subtotal, sum(gross - net)::BIGINT / 100.0::DOUBLE AS tax, sum(gross)::BIGINT / 100.0::DOUBLE AS total
    FROM m GROUP BY l_orderkey
""")
def totals_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = totals.summaries(_parsed(spark, sf_dir).where("zone = 'below'"))
    return found.select(F.col("doc_id").cast("long").alias("orderkey"), *[F.col(f"summary.{c}").alias(c) for c in ("subtotal", "tax", "total")])


@_query("""
    SELECT o_orderkey AS orderkey, (1000000 + o_orderkey)::VARCHAR AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS date
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fields.header_fields(_parsed(spark, sf_dir).where("zone in ('above', 'below', 'all')"))
    return found.select(F.col("doc_id").cast("long").alias("orderkey"), "invoice_number", "date")


def _party_sql(with_client: bool) -> str:
    seller = """
        SELECT f.k AS orderkey, 'seller' AS role, s_name AS name, n_name AS address, s_suppkey::VARCHAR AS tax_id
        FROM f JOIN supplier ON s_suppkey = f.s JOIN nation ON s_nationkey = n_nationkey"""
    client = """
        UNION ALL SELECT f.k, 'client', c_name, n_name, c_custkey::VARCHAR
        FROM f JOIN orders ON o_orderkey = f.k JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey"""
    return f"WITH f AS (SELECT l_orderkey AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1) {seller} {client if with_client else ''}"


@_query(_party_sql(True))
def parties_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = _parsed(spark, sf_dir).where("zone = 'above'")
    found = fields.parties(above)
    return found.select(F.col("doc_id").cast("long").alias("orderkey"), "role", "name", "address", "tax_id")


@_query(_party_sql(False))
def letterhead_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = _parsed(spark, sf_dir, render.Layout(letterhead=True)).where("zone = 'above'")
    return fields.letterhead(above).select(F.col("doc_id").cast("long").alias("orderkey"), F.lit("seller").alias("role"), "name", "address", "tax_id")


@_query("""
    WITH f AS (SELECT l_orderkey AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
    SELECT k AS orderkey, s_name AS beneficiary, 'Bank of ' || n_name AS bank, 'XX00' || lpad(s::VARCHAR, 8, '0') AS iban, 'R' || k AS reference
    FROM f JOIN supplier ON s_suppkey = s JOIN nation ON s_nationkey = n_nationkey
""")
def payment_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = _parsed(spark, sf_dir, render.Layout(payment=True)).where("zone = 'below'")
    found = fields.payments(below)
    return found.select(F.col("doc_id").cast("long").alias("orderkey"), *[F.col(f"payment.{c}").alias(c) for c in ("beneficiary", "bank", "iban", "reference")])


@_query(f"""
    WITH {_LINES}, n AS (SELECT l_orderkey, max(line) AS n FROM m GROUP BY 1)
    SELECT l_orderkey AS orderkey, n::BIGINT AS body_lines, (n + 3)::BIGINT AS outside_lines, 8::BIGINT AS columns FROM n
""".replace("(n + 3)", "(3 + 6)"))
def table_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the table's body, lines outside it, columns of the header."""
    rows = _parsed(spark, sf_dir)
    return rows.groupBy(F.col("doc_id").cast("long").alias("orderkey")).agg(
        F.count(F.when(F.col("body"), 1)).alias("body_lines"),
        F.count(F.when(F.col("zone").isin("above", "below"), 1)).alias("outside_lines"),
        F.max(F.size("slots") + 2).cast("long").alias("columns"),
    )
