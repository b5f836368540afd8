"""Mixing sources to target weights (operator 11), with DataFrame functions only.

A document's size is the number of its words. Every source has a weight and its target is its share of all sizes by weight, at most ``most``
times its own size; what lies above that is shared again by weight among the others until no target is above (``targets``). A
target is met by whole documents: each is taken ``floor(target / source size)`` times, and those whose hash lies below the source's limit
once more. Limits come from histograms (``limits``): sizes are summed by source and the first bits of the hash, the running total
of at most ``1 << BITS`` sums a source shows the bucket that holds the limit, and only that bucket's documents are summed again by their next bits. Nothing is
sorted by hash. Limits are nested: a larger budget takes all that a smaller one took. The limit is the place nearest to
the target, so that a source misses it by half a document at most.

Hashes depend on the seed, the id and the text. Null texts are empty; a null source is a source of its own, the last; rows without an id
are told apart by their texts. Rows that share both are taken together, as are rows whose 60 bits collide; where their group stands at the limit a source misses its target by half of its
words at most. Without words all targets are 0. An empty table gives an empty result. Columns of ``docs`` may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, quoted, ranked, stored, with_small

#: Weights of the sources in order, over and over; how many times a document is taken at most; bits of a histogram level and of a hash.
WEIGHTS, MOST, SEED, BITS, HASH_BITS = (1, 2, 3), 3, 11, 12, 60
WORDS = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def _hash(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of seed, id and text as a long."""
    parts = F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key, h) of every row, stored."""
    text, source = F.col("text"), F.col("source").cast("string")
    return stored(docs.select("doc_id", source.alias("source"), _size(text).alias("size"), _key(source).alias("key"), _hash(F.col("doc_id"), text, seed).alias("h")), "sizes")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target, times, budget) of every source of ``sizes``, stored: documents are taken ``times`` times, and once more up to ``budget`` words.

    Only the sum of what is shared and of the weights that share it reach the driver, once a round; a source that is above its
    bound in one round stays above it, so that the two numbers say which are."""
    found = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    placed = ranked(stored(found, "sources"), "place", F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    sources = stored(placed.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("place"), "weighed")
    bound = F.col("source_size").cast("decimal(20,0)") * F.lit(most).cast("decimal(10,0)")
    weight = F.col("weight").cast("decimal(10,0)")

    def above(rest: int, shares: int) -> Column:
        return bound * F.lit(shares).cast("decimal(19,0)") < weight * F.lit(rest).cast("decimal(19,0)")

    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = int(first[0] or 0)
    rest, shares = total, int(first[1] or 1)
    while total:
        over = above(rest, shares)
        held, left = sources.agg(F.sum(F.when(over, bound)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (total - int(held or 0), int(left))
        if now == (rest, shares):
            break
        rest, shares = now
    share = (weight * F.lit(rest).cast("decimal(19,0)")).cast("double") / F.lit(float(shares))
    target = F.when(above(rest, shares), bound.cast("double")).otherwise(share) if total else F.lit(0.0)
    size = F.col("source_size").cast("double")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    out = sources.select("key", "source_size", target.alias("target")).withColumn("times", times)
    return stored(out.withColumn("budget", F.col("target") - F.col("times") * size), "targets")


def limits(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, limit) for every ``budget`` above 0 of (key, budget): rows of ``sizes`` with ``h < limit`` have the total nearest to the budget."""
    wanted = stored(budgets.where("budget > 0").select("key", "budget", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix")), "budgets")
    left, shift, done = rows.select("key", "size", "h"), HASH_BITS - BITS, None
    while True:
        # of the rows of the open buckets, the sums of the next bits
        inside = with_small(left, wanted, "key", "h").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        inside = stored(inside.select("key", "size", "h", "budget", "below"), "boundary")
        sums = inside.groupBy("key", F.shiftright("h", shift).alias("prefix")).agg(
            F.sum("size").alias("z"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("budget").alias("budget"), F.first("below").alias("below")
        )
        upto = F.col("below") + F.sum("z").over(Window.partitionBy("key").orderBy("prefix"))
        at = sums.withColumn("upto", upto).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("z") <= F.col("budget")))
        at = stored(at, "levels")
        nearer = F.col("upto") - F.col("budget") < F.col("budget") - (F.col("upto") - F.col("z"))
        ended = at.where("lo = hi").select("key", F.when(nearer, F.col("lo") + 1).otherwise(F.col("lo")).alias("limit"))
        done = ended if done is None else done.unionByName(ended)
        wanted = at.where("lo < hi").select("key", "budget", (F.col("upto") - F.col("z")).alias("below"), "prefix")
        if shift == 0 or wanted.isEmpty():
            return done
        wanted, left, shift = stored(wanted, "budgets"), inside.select("key", "size", "h"), shift - BITS


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(key, source_size, target, times, limit) of every source, stored."""
    goal = targets(rows, weights, most)
    return stored(goal.join(limits(rows, goal), "key", "left").select("key", "source_size", "target", "times", F.coalesce("limit", F.lit(0)).alias("limit")), "mixture")


def _times(h: str) -> Column:
    return F.col("times") + (F.col(h) < F.col("limit")).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of every row: ``taken`` words in ``times`` copies."""
    rows = sizes(docs, seed)
    judged = with_small(rows, _plan(rows, weights, most), "key", "h").withColumn("times", _times("h"))
    return judged.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, each as many times as the mix takes it."""
    rows = sizes(docs, seed)
    row, h, key = fresh_name(docs, "row"), "_h", "key"
    packed = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(row), _hash(F.col("doc_id"), F.col("text"), seed).alias(h), _key(F.col("source").cast("string")).alias(key))
    judged = with_small(packed, _plan(rows, weights, most), key, h).withColumn("times", _times(h)).where("times > 0")
    return judged.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*(F.col(row)[c].alias(c) for c in docs.columns))
