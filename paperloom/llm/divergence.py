"""Source divergence audit (operator 12): how far the word distributions of the sources of each language lie apart.

Terms are counted in every task by (lang, source) and meet by (lang, term), where those in too few documents of their language go. What stays
are postings (lang, source, term, count), of which a group has as many as it has terms. The smoothed shares of a group are exact integers that depend on
the count alone, so that the sum of differences between groups A and B over all terms is, by inclusion and exclusion over their supports,

    sum over A's counts of |p(count) - zero of B|  +  the same for B        from histograms of counts
    + sum over terms of both of what these two got wrong                    from postings
    + (terms - A's terms - B's terms) * |zero of A - zero of B|             a constant

Pairs are dealt out as pairs of blocks of some ``BLOCK`` groups and, within these, as slices of terms and counts (``pairs``): a task holds one matrix of at
most about ``BLOCK`` squared sums and streams its rows by term, so that neither a frequent term nor a large group is a single task's, and it passes on
sums, never a row for every pair at a term. The result itself has a row for every ordered pair of groups of a language.

Null text, lang and source are empty texts. Repeated rows count. A group without kept terms has the share of zero everywhere; a language
without kept terms has pairs of value 0 and no terms. A language with one source has no pairs. An empty table gives an empty result. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, byte_texts, ready, shuffle_parts, stored, tidy, with_small

#: Documents of its language that a term is in at least; ranks of a group's terms.
LEAST_DOCS, TOP = 30, 50
#: Counted terms that a task holds; groups of a block, postings and counts of a slice.
HELD, BLOCK, SLICE = 250_000, 256, 200_000
#: A-Z in lower case; all other ASCII but letters parts terms.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


# ---- counts -------------------------------------------------------------------------------

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("c", pa.int64()), ("d", pa.int64())])
_COUNTED_DDL = "lang string, source string, term binary, c long, d long"


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of every term, summed within tasks as far as ``HELD`` allows."""

    def emptied(held):
        for (lang, source), (occurrences, documents) in held.items():
            words = list(occurrences)
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                yield batch(_COUNTED, [lang] * len(part), [source] * len(part), part, [occurrences[w] for w in part], [documents[w] for w in part])
        held.clear()

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        n = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), strict=True):
                occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms_of(text), len(occurrences)
                occurrences.update(words)
                documents.update(set(words))
                n += len(occurrences) - before
                if n >= HELD:
                    yield from emptied(held)
                    n = 0
        yield from emptied(held)

    return ready(docs).select("lang", "source", "text").mapInArrow(tidy(run), _COUNTED_DDL)


def share(c: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (c + 5) / (total + 5 terms)) in long division by thousands, exact while the divisor is below 9 * 10^15; null without terms."""
    whole = F.when(terms > 0, total + 5 * terms)
    left, out = c + 5, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + F.call_function("div", left, whole)
        left = left % whole
    return out + 1


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, c, lang_c, first) of every kept term in every group that has it, stored; ``first`` is true in one row of a term."""
    met = counted(docs).repartition(shuffle_parts(docs.sparkSession), "lang", "term")
    by_group = met.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    both = by_group.withColumns({"_docs": F.sum("d").over(term), "lang_c": F.sum("c").over(term), "first": F.col("source") == F.min("source").over(term)})
    return stored(both.where(F.col("_docs") >= least_docs).select("lang", "source", "term", "c", "lang_c", "first"), "postings")


# ---- pairs of groups ----------------------------------------------------------------------

_ROW_DDL = "lang string, a int, b int, slice int, kind int, source string, block int, term binary, n long, p long, zero long, terms long"
_SUM = pa.schema([("lang", pa.string()), ("one", pa.string()), ("other", pa.string()), ("value", pa.int64())])


class _Pair:
    """The sums of one pair of blocks over one slice."""

    def __init__(self, lang: str, a: int, b: int, slice_: int):
        self.lang, self.a, self.b, self.constants = lang, a, b, slice_ == 0
        self.sources: list[list] = [[], []]  # (source, zero, own terms, all terms) of each side
        self.at: dict[tuple[int, str], tuple[int, int]] = {}
        self.term, self.found = None, []
        self.sums = None

    def group(self, source: str, block: int, zero: int, own: int, terms: int) -> None:
        side = int(block != self.a)
        self.at[block, source] = side, len(self.sources[side])
        self.sources[side].append((source, zero, own, terms))

    def start(self) -> None:
        """All groups are known: lay out the matrix."""
        rows, cols = self.sources[0], self.sources[0] if self.a == self.b else self.sources[1]
        self.rows, self.cols = rows, cols
        self.zero = np.array([r[1] for r in rows], np.int64), np.array([c[1] for c in cols], np.int64)
        self.sums = np.zeros((len(rows), len(cols)), np.int64)
        if self.constants and len(rows) and len(cols):
            own = np.array([r[2] for r in rows], np.int64), np.array([c[2] for c in cols], np.int64)
            self.sums += (rows[0][3] - own[0][:, None] - own[1][None, :]) * np.abs(self.zero[0][:, None] - self.zero[1][None, :])

    def count(self, block: int, source: str, p: int, n: int) -> None:
        """n terms of a group have the share p: their one-sided price against every group of the other side."""
        side, i = self.at[block, source]
        if self.a == self.b:
            price = n * np.abs(p - self.zero[1])
            self.sums[i] += price
            self.sums[:, i] += price
        elif side:
            self.sums[:, i] += n * np.abs(p - self.zero[0])
        else:
            self.sums[i] += n * np.abs(p - self.zero[1])

    def posting(self, block: int, source: str, term: bytes, p: int) -> None:
        if term != self.term:
            self.overlap()
            self.term = term
        self.found.append((*self.at[block, source], p))

    def overlap(self) -> None:
        """What one-sided prices got wrong for pairs of groups that both have the term."""
        if len(self.found) > 1:
            side, at, p = np.array(self.found, np.int64).T
            (i, pi), (j, pj) = ((at, p),) * 2 if self.a == self.b else ((at[side == 0], p[side == 0]), (at[side == 1], p[side == 1]))
            if len(i) and len(j):
                zi, zj, pi, pj = self.zero[0][i][:, None], self.zero[1][j][None, :], pi[:, None], pj[None, :]
                self.sums[np.ix_(i, j)] += np.abs(pi - pj) - np.abs(pi - zj) - np.abs(zi - pj) + np.abs(zi - zj)
        self.found = []

    def result(self) -> pa.RecordBatch:
        if self.sums is None:
            self.start()
        self.overlap()
        i, j = np.triu_indices(len(self.rows), 1) if self.a == self.b else (x.ravel() for x in np.indices(self.sums.shape))
        names = [r[0] for r in self.rows], [c[0] for c in self.cols]
        return batch(_SUM, [self.lang] * len(i), [names[0][x] for x in i.tolist()], [names[1][x] for x in j.tolist()], self.sums[i, j])


def _pair_sums(batches):
    now, key = None, None
    for b in batches:
        for lang, a, c, slice_, kind, source, block, term, n, p, zero, terms in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if key != (lang, a, c, slice_):
                if now:
                    yield now.result()
                key = (lang, a, c, slice_)
                now = _Pair(*key)
            if kind == 0:
                now.group(source, block, zero, n, terms)
                continue
            if now.sums is None:
                now.start()
            if kind == 1:
                now.count(block, source, p, n)
            else:
                now.posting(block, source, term, p)
    if now:
        yield now.result()


def pairs(groups: DataFrame, priced: DataFrame, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """(lang, one, other, value) of every unordered pair of groups. ``groups`` (lang, source, zero, own, terms), ``priced`` (lang, source, term, c, p); both stored."""
    counts = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    rows_of = priced.groupBy("lang").agg(F.count("*").alias("_rows"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).join(rows_of, "lang", "left")
    langs = stored(langs.withColumn("_slices", F.greatest(F.lit(1), F.ceil(F.coalesce("_rows", F.lit(0)) / slice_rows)).cast("int")).drop("_rows"), "langs")
    none = {"term": F.lit(None).cast("binary"), "n": F.lit(0).cast("long"), "p": F.lit(0).cast("long"), "zero": F.lit(0).cast("long"), "terms": F.lit(0).cast("long")}

    def row(df: DataFrame, kind: int, slice_: Column, **given: Column) -> DataFrame:
        own = F.pmod(F.xxhash64("source"), F.col("_blocks")).cast("int")
        # a block meets every block, itself too
        met = with_small(df, langs, "lang", "spread").withColumns({"block": own, "slice": slice_})
        dealt = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        where = {"a": F.least("block", "_other"), "b": F.greatest("block", "_other"), "kind": F.lit(kind)}
        return dealt.select("lang", *(v.alias(k) for k, v in where.items() if k != "kind"), "slice", F.lit(kind).alias("kind"), "source", "block", *(given.get(k, v).alias(k) for k, v in none.items()))

    def sliced(*by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.col("_slices")).cast("int")

    named = row(groups.withColumn("spread", F.xxhash64("source")), 0, F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)), n=F.col("own"), zero=F.col("zero"), terms=F.col("terms"))
    sides = row(counts.withColumn("spread", F.xxhash64("p", "source")), 1, sliced("p"), n=F.col("n"), p=F.col("p"))
    terms = row(priced.withColumn("spread", F.xxhash64("term")), 2, sliced("term"), term=F.col("term"), p=F.col("p"))
    order = ("lang", "a", "b", "slice", "kind", "term")
    dealt = named.unionByName(sides).unionByName(terms).repartition(2 * shuffle_parts(groups.sparkSession), *order[:4]).sortWithinPartitions(*order)
    return dealt.mapInArrow(tidy(_pair_sums), "lang string, one string, other string, value long").groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))


# ---- the audit ----------------------------------------------------------------------------


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows name the other sources of a language by descending distance, ``term`` rows the terms
    of a group that exceed their share in the language most, ``top`` at most."""
    empty = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    docs = docs.select(*empty.values())
    kept = postings(docs, least_docs)
    of_lang = kept.groupBy("lang").agg(F.sum("c").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("c").alias("total"), F.count("*").alias("own"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "own", "lang_total", "terms")))
    groups = groups.withColumn("zero", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0)))
    groups = stored(groups.withColumn("_group", F.to_json(F.struct("lang", "source"))), "groups")
    known = groups.select("_group", "total", "lang_total", "terms")
    priced = with_small(kept.withColumns({"_group": F.to_json(F.struct("lang", "source")), "_spread": F.xxhash64("term")}), known, "_group", "_spread")
    priced = priced.select("lang", "source", "term", "c", share(F.col("c"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_c"), F.col("lang_total"), F.col("terms")).alias("q"))
    priced = stored(priced, "priced")
    each = pairs(groups.select("lang", "source", "zero", "own", "terms"), priced.select("lang", "source", "term", "c", "p"), block, slice_rows)
    both = each.withColumn("_way", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        "lang", F.when(F.col("_way"), F.col("one")).otherwise(F.col("other")).alias("source"), F.lit("pair").alias("part"),
        F.when(F.col("_way"), F.col("other")).otherwise(F.col("one")).alias("item"), "value",
    )
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
