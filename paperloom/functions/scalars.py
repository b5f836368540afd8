"""Scalar functions as Column expressions: numbers, currencies, dates, text. No Python UDF but
``similarity``, which has no built-in counterpart."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from . import patterns as P

DECIMAL = "decimal(38,10)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Remove the given characters from both ends."""
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: written out, it would be computed in each place that names it."""
    return F.get(F.transform(F.array(value), body), 0)


def empty_null(c: Column) -> Column:
    return F.when(c != "", c)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is no match (a group that took no part is empty)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def parse_number(c: Column) -> Column:
    """Decimal value of a printed number, else null: '1 394,67', '$5,640.17', '(12.00)', '10%', '1,000'."""
    return let(strip(c), lambda s: F.when(~s.rlike("[A-Za-z]") & s.rlike("[0-9]"), let(F.regexp_replace(s, "[^0-9.,]", ""), lambda kept: _signed(s, _decimal(kept)))))


def _negative(s: Column) -> Column:
    return s.startswith("-") | (s.startswith("(") & s.endswith(")"))


def _signed(s: Column, value: Column) -> Column:
    return F.when(_negative(s), -value).otherwise(value)


def _decimal(kept: Column) -> Column:
    return _digits(kept).try_cast(DECIMAL)


def _digits(kept: Column) -> Column:
    """Digits with one sign at most; ``kept`` holds digits, points and commas only, so that no pattern is needed."""
    dotted = F.replace(kept, F.lit(","), F.lit("."))
    fraction, plain = F.substring_index(dotted, ".", -1), F.replace(dotted, F.lit("."), F.lit(""))
    n = F.length(plain) - F.length(fraction)
    return (
        F.when(~dotted.contains("."), kept)
        .when(F.length(fraction) == 3, plain)
        .otherwise(F.concat(F.substring(plain, F.lit(1), n), F.lit("."), fraction))
    )


def token_digits(c: Column) -> Column:
    """What ``parse_number`` reads in a number token, as text: an optional minus, digits, an optional point. Tokens hold no letters and no spaces, so that no pattern is needed."""
    return let(F.translate(c, "()-$€£%", ""), lambda kept: F.when(_negative(c), F.concat(F.lit("-"), _digits(kept))).otherwise(_digits(kept)))


def _short(digits: Column) -> Column:
    """Neither rounded nor signed: such digits are the same number read as a double or as a decimal."""
    return (F.length(digits) <= 15) & ~digits.startswith("-") & (~digits.contains(".") | (F.length(F.substring_index(digits, ".", -1)) <= 2))


def digits_money(digits: Column) -> Column:
    """``money`` of ``token_digits``."""
    return F.when(_short(digits), digits.try_cast("double")).otherwise(money(digits.try_cast(DECIMAL)))


def digits_number(digits: Column) -> Column:
    """``number`` of ``token_digits``."""
    return F.when(_short(digits), digits.try_cast("double")).otherwise(number(digits.try_cast(DECIMAL)))


def is_number_token(c: Column) -> Column:
    # a token of up to 28 characters always fits the decimal; only longer ones are parsed to see
    return F.coalesce(c.rlike(P.NUMBER_TOKEN) & ((F.length(c) <= 28) | parse_number(c).isNotNull()), F.lit(False))


def money(c: Column) -> Column:
    """Two places, half to even."""
    return F.bround(c, 2).cast("double")


def number(c: Column) -> Column:
    return c.cast("double")


def currency_of(c: Column) -> Column:
    """Currency of a text: a named one, one in brackets, a prefixed dollar, a code beside a number, a
    dollar with a country hint, a symbol."""
    codes = F.array(*[F.lit(x) for x in P.CURRENCY_CODES])

    def known(x: Column) -> Column:
        return F.when(F.array_contains(codes, x), x)

    named = known(F.upper(F.regexp_extract(c, r"(?iU)\bcurrency\W{0,3}([A-Z]{3})\b", 1)))
    bracketed = F.get(F.filter(F.regexp_extract_all(c, F.lit(r"\(([A-Z]{3})\)"), F.lit(1)), lambda x: F.array_contains(codes, x)), 0)
    prefixed = F.coalesce(*[F.when(c.rlike(rf"(?U)(?<![A-Za-z])\Q{pre}\E\s?\d"), F.lit(code)) for pre, code in P.CURRENCY_PREFIXES])
    beside = r"(?U)\d\s*([A-Z]{3})\b|\b([A-Z]{3})\s*[$€£]?\d"
    either = F.zip_with(
        F.regexp_extract_all(c, F.lit(beside), F.lit(1)), F.regexp_extract_all(c, F.lit(beside), F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b)
    )
    adjacent = F.get(F.filter(either, lambda x: F.array_contains(codes, x)), 0)
    hinted = F.when(
        c.contains("$"), F.when(c.rlike(r"(?iU)\bABN\b|australia"), F.lit("AUD")).when(c.rlike(r"(?iU)canada|\bGST/HST\b"), F.lit("CAD"))
    )
    symbol = F.coalesce(*[F.when(c.contains(s), F.lit(code)) for s, code in P.CURRENCY_SYMBOLS])
    return F.coalesce(named, bracketed, prefixed, adjacent, hinted, symbol)


# ---- fixed values: names in spelled-out dates -------------------------------------------------
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: Two digits of a year up to this are of this century, as years are within 50 of today's.
LATEST_SHORT_YEAR = 75
# ---------------------------------------------------------------------------------------------


def _spelled(s: Column) -> Column:
    """ISO date of a text with one month's name, a day and a year in any order, whatever stands between them; null if a part is missing, is there twice, or can't be told.

    Of two numbers the one of three digits and more, above 31 or behind an apostrophe is the year; else the day is the one beside the month that comes first: what stands before the
    month, or of two after it the first. Times of day, ordinal endings and other words say nothing. Parts that a text leaves out are never filled from today's date."""
    plain = F.regexp_replace(F.lower(s), r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?\s*(?:[ap]\.?m\.?)?|(?<=[0-9])(?:st|nd|rd|th)\b", " ")
    tokens = F.regexp_extract_all(plain, F.lit(rf"\b{MONTH_NAMES}\b|'?[0-9]+"), F.lit(0))

    def is_name(t: Column) -> Column:
        return t.rlike("^[a-z]")

    def year_like(t: Column) -> Column:
        return t.startswith("'") | (F.length(t) > 2) | (F.replace(t, F.lit("'"), F.lit("")).try_cast("int") > 31)

    # what several places read is bound once: written out, a step would repeat all those before it in each place
    def parts(t: Column) -> Column:
        place = F.array_position(F.transform(t, is_name), True)
        return F.struct(F.filter(t, is_name).alias("names"), F.filter(t, lambda x: ~is_name(x)).alias("numbers"), place.alias("place"))

    def dated(p: Column) -> Column:
        first, second = p["numbers"][0], p["numbers"][1]
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(p["names"][0], 1, 3)).cast("int")
        # one before the month and one after it, or two after: the first is the day; two before: a year, then a day
        likes = F.struct(year_like(first).alias("a"), year_like(second).alias("b"))
        year_first = let(likes, lambda y: F.when(y["a"] != y["b"], y["a"]).otherwise(p["place"] == 3))

        def digits(yes: Column) -> Column:
            return F.struct(*(F.replace(F.when(yes, a).otherwise(b), F.lit("'"), F.lit("")).alias(c) for c, a, b in (("y", first, second), ("d", second, first))))

        def read(d: Column) -> Column:
            full = let(d["y"].try_cast("int"), lambda y: F.when(F.length(d["y"]) > 2, y).when(y <= LATEST_SHORT_YEAR, y + 2000).otherwise(y + 1900))
            return F.when((F.length(d["y"]) <= 4) & (F.length(d["d"]) <= 2), _date(full, month, d["d"].try_cast("int")))

        return F.when((F.size(p["names"]) == 1) & (F.size(p["numbers"]) == 2), let(let(year_first, digits), read))

    return let(let(tokens, parts), dated)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"), "yyyy-MM-dd")


def parse_date(c: Column, order: str = "MDY") -> Column:
    """ISO date of a text, else null. The first form that matches decides, even if its date is invalid."""
    return let(strip_chars(strip(c), ".,:;"), lambda s: _parsed_date(s, order))


def _parsed_date(s: Column, order: str) -> Column:
    iso, short = r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})"

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(s, pattern, k).try_cast("int")

    def ordered(p: Column) -> Column:
        a, b = p["a"], p["b"]
        day_first = F.when(a > 12, True).when(b > 12, False).otherwise(order != "MDY")
        return let(day_first, lambda first: _date(F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"]), F.when(first, b).otherwise(a), F.when(first, a).otherwise(b)))

    return (
        F.when(s.rlike(iso), _date(*(part(iso, k) for k in (1, 2, 3))))
        .when(s.rlike(short), let(F.struct(*(part(short, k).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "y")))), ordered))
        .when(s.rlike("[A-Za-z]{3}"), _spelled(s))
    )


def close(a: Column, b: Column, rel: float = 0.003, least: float = 0.03) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(least), F.lit(rel) * F.greatest(F.abs(a), F.abs(b)))


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.005), F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(squeeze(a)).eqNullSafe(F.lower(squeeze(b)))


def safe_name(c: Column) -> Column:
    """The last part of a path with odd characters replaced, at most 200 long."""
    base = F.element_at(F.split(F.coalesce(c, F.lit("")), r"[/\\]"), -1)
    name = F.substring(F.regexp_replace(base, r"(?U)[^\w.\- ]", "_"), 1, 200)
    return F.when(name != "", name).otherwise("upload")


def content_key(content: Column, model: str, version: str) -> Column:
    return F.sha2(F.concat(content.cast("binary"), F.lit(f"|{model}|{version}").cast("binary")), 256)


def request_id(c: Column) -> Column:
    return F.when(c.rlike(P.REQUEST_ID), c).otherwise(F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 12))


# ---- evaluation only: other rules than above ------------------------------------------------


def truth_number(c: Column) -> Column:
    """A comma is the decimal sign unless a dot follows it."""
    s = F.regexp_replace(c, "[^0-9.,]", "")
    comma, dot = F.length(s) - F.instr(F.reverse(s), ","), F.length(s) - F.instr(F.reverse(s), ".")
    decimal_comma = s.contains(",") & (~s.contains(".") | (comma > dot))
    plain = F.when(decimal_comma, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    return F.when(s != "", plain.try_cast("double"))


def truth_text(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\W+", " ")))


def truth_date(c: Column) -> Column:
    pattern = r"^([0-9]{2})/([0-9]{2})/([0-9]{4})\z"
    return F.when(c.rlike(pattern), F.regexp_replace(c, pattern, "$3-$1-$2"))


def truth_close(a: Column, b: Column, tolerance: float = 0.015) -> Column:
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts (already normalised), whatever their lengths; null counts as empty."""
    return pd.Series([blocks.ratio(x, y) for x, y in zip(a, b, strict=True)])
