import math
import random
import re
from difflib import SequenceMatcher

import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.functions import blocks
from paperloom.functions import scalars as S
from paperloom.operators import table
from paperloom.plans import queries_more
from paperloom.ship import ship


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(rows.select("i", f(F.col("v"))).collect())]


def test_parse_number(spark):
    cases = {
        "1 394,67": 1394.67, "5640,17": 5640.17, "$12.00": 12.0, "1,234.56": 1234.56, "1.234,56": 1234.56, "10%": 10.0, "(12.00)": -12.0, "3,00": 3.0,
        "1,000": 1000.0, "1.350": 1350.0, "1,": 1.0, ",5": 0.5, "1.2.3": 12.3, "12-5": 125.0, "-7": -7.0, " 8 ": 8.0,
        "each": None, "": None, "abc1": None, "$": None, ".": None,
    }
    assert run(spark, list(cases), lambda c: S.parse_number(c).cast("double")) == list(cases.values())


def test_number_tokens(spark):
    cases = {"-$5": True, "$-5": False, "12": True, "1,234.50": True, "(3)": True, "10%": True, "a1": False, "": False, "12\n": False}
    assert run(spark, list(cases), S.is_number_token) == list(cases.values())


def test_money_rounds_half_to_even(spark):
    assert run(spark, ["2.665", "2.675", "-0.005", "1"], lambda c: S.money(c.cast("decimal(38,10)"))) == [2.66, 2.68, 0.0, 1.0]


def test_parse_date(spark):
    month_first = {
        "04/13/2013": "2013-04-13", "13/04/2013": "2013-04-13", "04/05/2020": "2020-04-05", "Mar 13, 2022": "2022-03-13", "2022-03-13": "2022-03-13", "garbage": None,
        "31/02/2020": None, "1.2.21": "2021-01-02", "22.07.2026-28.08.2026": None, "13 March 2022.": "2022-03-13", "March 2022": None, "on 5th May 2021 at": "2021-05-05", "": None,
    }
    assert run(spark, [*month_first, None], S.parse_date) == [*month_first.values(), None]
    assert run(spark, ["04/05/2020", "12/31/2020"], lambda c: S.parse_date(c, "DMY")) == ["2020-05-04", "2020-12-31"]


def test_currency(spark):
    cases = {
        "Currency EUR": "EUR", "Price (GBP) Qty": "GBP", "Total $ 5 640,17": "USD", "Total € 10": "EUR", "nothing": None, "Our CAD team Currency CHF": "CHF", "pay CA$ 5": "CAD",
        "XCA$ 5": "USD", "100 CHF": "CHF", "CHF": None, "ABN 1 $5": "AUD", "Canada $5": "CAD", "(XYZ) (NOK)": "NOK", "currency: usd": "USD",
    }
    assert run(spark, list(cases), S.currency_of) == list(cases.values())


def test_text_functions(spark):
    assert run(spark, ["a/b\\c d?.pdf", "", None, "é" * 300], S.safe_name) == ["c d_.pdf", "upload", "upload", "é" * 200]
    assert run(spark, ["1,000", "1.234,5", "1,234.5", "x", None], S.truth_number) == [1.0, 1234.5, 1234.5, None, None]
    assert run(spark, ["01/02/2020", "1/2/2020", None], S.truth_date) == ["2020-01-02", None, None]
    assert run(spark, [" A-b  Ç ", None], S.truth_text) == ["a b ç", ""]
    ids = run(spark, ["ok-1._", "no space", ""], S.request_id)
    assert ids[0] == "ok-1._" and all(len(x) == 12 for x in ids[1:])
    row = spark.range(1).select(S.same_number(F.lit(1.0), F.lit(1.004)), S.same_number(F.lit(None).cast("double"), F.lit(1.0)), S.same_text(F.lit(" A  b"), F.lit("a B"))).first()
    assert tuple(row) == (True, False, True)


def test_similarity(spark):
    ship(spark)
    pairs = [("one two", "two one"), ("", ""), ("abc", "abd"), (None, "x")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(S.similarity("a", "b")).collect()]
    assert all(math.isclose(g, SequenceMatcher(None, a or "", b or "").ratio()) for g, (a, b) in zip(got, pairs, strict=True))


@pytest.mark.parametrize(
    ("label", "kind"),
    [("No.", "index"), ("Description of goods", "description"), ("Hours", "quantity"), ("Unit", "unit"), ("Gross worth", "gross_amount"), ("Unit price", "unit_price"), ("VAT [%]", "vat_percent"), ("Total", "net_amount"), ("?", None)],
)
def test_column_kind(spark, label, kind):
    assert spark.range(1).select(table.column_kind(F.lit(label))).first()[0] == kind


def test_similarity_of_long_and_random_texts():
    """The same ratio as a scan over all pairs of equal characters, with and without common characters, also where blocks tie."""
    pick = random.Random(11)
    for k in range(1500):
        letters = ("ab", "abcd ", "abcdefghijklmnopqrstuvwxyz ")[k % 3]
        a = "".join(pick.choices(letters, k=pick.choice([0, 1, 9, 60, 199, 200, 420])))
        b = list(a) if k % 2 else pick.choices(letters, k=pick.choice([0, 1, 9, 60, 199, 200, 420]))
        for _ in range(min(len(b), pick.randrange(9))):
            at = pick.randrange(len(b))
            b[at : at + pick.randrange(4)] = pick.choice(letters + "é#")
        b = "".join(b)
        assert blocks.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
    words = [f"w{pick.randrange(4000)}" for _ in range(20_000)]
    changed = words[:7000] + ["new", "words"] + words[7003:15_000] + words[15_500:]
    assert blocks.ratio(" ".join(words), " ".join(changed)) == SequenceMatcher(None, " ".join(words), " ".join(changed)).ratio()


def test_document_similarity(spark, tmp_path):
    pick = random.Random(3)
    base = [" ".join(f"{pick.choice('abcdefgh')}{pick.randrange(60)}" for _ in range(pick.choice([3, 40, 400]))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base * 4):
        w = t.split()
        w[pick.randrange(len(w))] = "Other;"
        rows.append((100 + i, " ".join(w)))
    rows += [(900, base[4]), (901, ""), (902, None), (903, " -- "), (None, base[1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for i, t in rows:
        plain = re.sub(r"\W+", " ", t or "").strip().lower()
        if plain and i is not None:
            texts[plain] = min(i, texts.get(plain, i))
    groups = {}
    for t, i in texts.items():
        w = t.split(" ")
        hashes = [xxhash.xxh64(" ".join(w[k : k + 5]), seed=42).intdigest() for k in range(max(len(w) - 4, 1))]
        groups.setdefault(min(h - (1 << 64) if h >> 63 else h for h in hashes), []).append((i, t))
    want = []
    for g in groups.values():
        near, u = min(g)
        want += [(i, near, round(SequenceMatcher(None, u, t).ratio(), 6)) for i, t in g if i != near]
    for served in (queries_more.SERVED, 1):
        before, queries_more.SERVED = queries_more.SERVED, served
        try:
            got = [tuple(r) for r in queries_more.document_similarity(spark, str(tmp_path)).collect()]
        finally:
            queries_more.SERVED = before
        assert sorted(got) == sorted(want) and len(want) > 30


def test_a_date_is_taken_apart_once(spark):
    """Written out in each place that reads it, the search for names and numbers would run dozens of times a text."""
    plan = spark.createDataFrame([("1 May 2020",)], "t string").select(S.parse_date(F.col("t")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("sept?(?:ember)?") == 1
    assert plan.count("[0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4}") == 4


def test_token_digits_read_as_the_whole_text(spark):
    """A number token's digits give the amounts and numbers that parsing the token gives."""
    tokens = ["1.", "7", "1,000", "1394,67", "$5,640.17", "(12.00)", "-3,5", "10%", "0,125", "2.675", "1.2.3.4", "12345678901234,56", "1234567890123456789,5", "-0", "0,005", "(-7,77)", "€9"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    d, parsed = S.token_digits(F.col("t")), S.parse_number(F.col("t"))
    got = rows.select("t", S.is_number_token(F.col("t")).alias("token"), S.digits_money(d).alias("a"), S.money(parsed).alias("b"), S.digits_number(d).alias("c"), S.number(parsed).alias("d")).collect()
    assert [r for r in got if not r.token or (repr(r.a), repr(r.c)) != (repr(r.b), repr(r.d))] == []
