"""The table of a page: header row, columns, body, rows and typed values.

``zoned`` adds to every line what the page's header row says, by windows over the page; ``items`` folds a page's
rows as arrays, which are page-sized.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from .layout import PAGE, joined, merge_numbers, split_where

_CELL = "struct<label: string, x0: int, x1: int>"
_SLOT = "array<struct<label: string, x0: int, x1: int, kind: string>>"


def column_kind(label: Column) -> Column:
    """What a column holds, by its printed label; null if the label is not known."""
    kinds = iter(P.COLUMN_KINDS)

    def first(text: Column) -> Column:
        kind, pattern = next(kinds)
        chain = F.when(text.rlike(pattern), kind)
        for kind, pattern in kinds:
            chain = chain.when(text.rlike(pattern), kind)
        return chain

    return S.let(S.strip(F.lower(label)), first)


def is_header(words: Column) -> Column:
    return F.exists(words, lambda w: w["text"].rlike(P.HEADER_NOUN)) & F.exists(words, lambda w: w["text"].rlike(P.HEADER_KEY))


def header_cells(words: Column, y: Column, h: Column, next_words: Column, next_y: Column) -> Column:
    """struct(cells, bottom) of a header row; a second row of bare words close below is wrapped text of the cells
    that its words stand under. A cell grows with the words it takes."""
    groups = split_where(words, lambda before, w: w["x0"] - before["x1"] >= h)
    first = F.transform(
        groups, lambda g: F.struct(joined(g).alias("label"), g[0]["x0"].alias("x0"), F.element_at(g, -1)["x1"].alias("x1")).cast(_CELL)
    )
    bottom = F.array_max(F.transform(words, lambda w: w["y1"]))
    wraps = F.coalesce((next_y - y < 2.0 * h) & F.forall(next_words, lambda w: w["text"].rlike(P.HEADER_WRAP)), F.lit(False))

    def take(state: Column, w: Column) -> Column:
        middle = (w["x0"] + w["x1"]) / 2.0
        over = F.transform(state["cells"], lambda c: (c["x0"] - h <= middle) & (middle <= c["x1"] + h))
        at = F.array_position(over, True)
        grown = F.transform(
            state["cells"],
            lambda c, i: F.when(
                i + 1 == at,
                F.struct(F.concat(c["label"], F.lit(" "), w["text"]).alias("label"), F.least(c["x0"], w["x0"]).alias("x0"), F.greatest(c["x1"], w["x1"]).alias("x1")).cast(_CELL),
            ).otherwise(c),
        )
        return F.struct(grown.alias("cells"), F.when(at > 0, F.greatest(state["bottom"], w["y1"])).otherwise(state["bottom"]).alias("bottom"))

    start = F.struct(first.alias("cells"), bottom.alias("bottom"))
    more = F.when(wraps, next_words).otherwise(F.slice(words, 1, 0))

    def named(state: Column) -> Column:
        kinds = F.transform(state["cells"], lambda c: F.struct(c["label"].alias("label"), c["x0"].alias("x0"), c["x1"].alias("x1"), column_kind(c["label"]).alias("kind")))
        return F.struct(kinds.cast(_SLOT).alias("cells"), state["bottom"].alias("bottom"))

    return S.let(F.aggregate(more, start, take), named)


def _amounts(words: Column) -> Column:
    return F.filter(merge_numbers(words), lambda w: S.is_number_token(w["text"]) & ~w["text"].endswith("%"))


def is_table_end(text: Column, words: Column, zone_x: Column, n_slots: Column) -> Column:
    """A closing keyword that says summary, stands in the numeric zone, or has fewer amounts than a row of the table."""
    first = words[0]
    early = F.lower(first["text"]).startswith("summary") | (first["x0"] >= zone_x - 1)
    return text.rlike(P.TABLE_END) & (early | (F.size(_amounts(words)) < F.least(F.lit(2), n_slots)))


def zoned(lines: DataFrame) -> DataFrame:
    """Lines (with ``width``) with ``header_line``, ``end_line``, ``zone`` (above, header, table, below; all where a page has no
    header), and of recognised headers ``slots``, ``zone_x``, ``desc_x``; ``body`` marks rows of the table."""
    page = Window.partitionBy(*PAGE)
    # a line's text is its words: where no place in it starts like a word of a header, the words are not looked at
    may_be = F.col("text").rlike(P.HEADER_NOUN.replace("^", "(?:^| )")) & F.col("text").rlike(P.HEADER_KEY.replace("^", "(?:^| )"))
    rows = lines.withColumn("header_line", F.min(F.when(may_be & is_header(F.col("words")), F.col("line_no"))).over(page))
    here = F.col("line_no") == F.col("header_line")
    # the line behind the header's is found by its number: no window here has an order, so that lines aren't sorted
    rows = rows.withColumn("_next", F.max(F.when(F.col("line_no") == F.col("header_line") + 1, F.struct("y", "words"))).over(page))
    own = header_cells(F.col("words"), F.col("y"), F.col("h"), F.col("_next.words"), F.col("_next.y"))

    def columns(head: Column, described: Column) -> Column:
        """What a header row says of its page: its slots if it is recognised, edges, heights."""
        after = F.filter(head["cells"], lambda c: c["x0"] > described["x1"] - 1)
        known = F.exists(after, lambda c: c["kind"].isNotNull() & ~c["kind"].isin("description", "index"))
        edges = (head["bottom"].alias("bottom"), F.col("y").alias("y"), F.col("h").alias("h"), described["x0"].alias("desc"))
        return F.struct(F.when(described.isNotNull() & known, after).alias("slots"), *edges)

    # worked out on the header's own line, then handed to the page's others
    said = S.let(own, lambda head: S.let(F.get(F.filter(head["cells"], lambda c: c["kind"] == "description"), 0), lambda described: columns(head, described)))
    rows = rows.withColumn("_head", F.when(here, said)).drop("_next").withColumn("_head", F.max("_head").over(page))
    rows = rows.withColumns({"slots": F.col("_head.slots"), "table_found": F.col("_head.slots").isNotNull()})
    rows = rows.withColumns({"zone_x": F.col("slots")[0]["x0"] - 0.05 * F.col("width"), "desc_x": F.col("_head.desc") - 0.02 * F.col("width")})
    below_header = F.col("table_found") & (F.col("line_no") > F.col("header_line")) & (F.col("y") > F.col("_head.bottom") + 0.3 * F.col("h"))
    ends = below_header & is_table_end(F.col("text"), F.col("words"), F.col("zone_x"), F.size("slots"))
    last = F.max("line_no").over(page) + 1
    rows = rows.withColumn("_below", below_header).withColumn(
        "end_line", F.when(F.col("table_found"), F.coalesce(F.min(F.when(ends, F.col("line_no"))).over(page), last)).otherwise(F.col("header_line") + 1)
    )
    zone = (
        F.when(F.col("header_line").isNull(), "all")
        .when(F.col("line_no") < F.col("header_line"), "above")
        .when(here, "header")
        .when(F.col("line_no") < F.col("end_line"), "table")
        .otherwise("below")
    )
    return rows.withColumns(
        {"zone": zone, "body": F.col("_below") & (F.col("line_no") < F.col("end_line")), "stop_y": F.col("_head.y") - 0.5 * F.col("_head.h")}
    ).drop("_head", "_below")


def with_rereads(rows: DataFrame, rereads: DataFrame) -> DataFrame:
    """Body lines with doubtful words of the numeric zone replaced by a second reading (doc_id, page_no, word_idx, text), where
    that is another number: single glyphs and words that are no number, whose nearest column is known and not the unit. Of several readings of a word the least counts."""
    # a page's readings are one list, which its lines look into: no word and no line is dealt out for them, if both lie by document
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    second = rereads.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("word_idx", "text"))).alias("_again"))

    def fixed(w: Column) -> Column:
        again = F.get(F.filter("_again", lambda r: r["word_idx"] == w["word_idx"]), 0)["text"]
        doubtful = (w["x0"] >= F.col("zone_x")) & ((F.length(w["text"]) == 1) | ~S.is_number_token(w["text"]))
        kind = nearest_slot(w, F.col("slots"))["kind"]
        use = doubtful & kind.isNotNull() & (kind != "unit") & S.is_number_token(again) & (again != w["text"])
        return F.when(F.coalesce(use, F.lit(False)), w.withField("text", again).withField("conf", F.lit(95.0))).otherwise(w)

    joined_rows = rows.join(second, PAGE, "left")
    return joined_rows.withColumn("words", F.when(F.col("body") & F.col("_again").isNotNull(), F.transform("words", fixed)).otherwise(F.col("words"))).drop("_again")


def nearest_slot(w: Column, slots: Column) -> Column:
    """The slot whose centre or right edge is nearest to the word's; the first of equals. With its place ``k``."""
    middle = (w["x0"] + w["x1"]) / 2.0
    ranked = F.transform(
        slots,
        lambda c, i: F.struct(
            F.least(F.abs(middle - (c["x0"] + c["x1"]) / 2.0), F.abs(w["x1"] - c["x1"]).cast("double")).alias("far"), i.alias("k"), c["kind"].alias("kind")
        ),
    )
    return F.array_min(ranked)


def row_blocks(described: Column, n_anchors: Column) -> Column:
    """Places (from 0) of every description line's block under the first gap that gives as many blocks as there are
    anchors; null if none does."""

    def limit(gaps: Column, middle: Column) -> Column:
        """The least width of a gap between blocks: one count per try, up to the first that fits."""
        return F.coalesce(*[F.when(F.size(F.filter(gaps, lambda g: g > k * middle)) + 1 == n_anchors, k * middle) for k in P.ROW_GAPS])

    def counted(gaps: Column, least: Column) -> Column:
        start = F.expr("cast(array() as array<int>)")
        return F.aggregate(gaps, start, lambda out, g: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + (g > least).cast("int"))))

    def middle(heights: Column) -> Column:
        n = F.size(heights)
        return (heights[F.floor((n - 1) / 2).cast("int")] + heights[F.floor(n / 2).cast("int")]) / 2.0

    gaps = F.transform(described, lambda d, i: F.when(i > 0, d["y"] - F.get(described, i - 1)["y"]).otherwise(0.0))
    heights = F.sort_array(F.transform(described, lambda d: d["h"].cast("double")))
    # each of these is read in several places, so each is bound once
    return S.let(gaps, lambda g: S.let(S.let(S.let(heights, middle), lambda m: limit(g, m)), lambda least: F.when(least.isNotNull(), counted(g, least))))


def body_columns() -> dict[str, Column]:
    """Of lines ``zoned``: ``toks``, the words of the numeric zone, and ``desc``, the text of the description's column; null outside the table's body."""
    numeric = F.filter("words", lambda w: w["x0"] >= F.col("zone_x"))
    text = joined(F.filter("words", lambda w: (w["x0"] >= F.col("desc_x")) & (w["x0"] < F.col("zone_x"))))
    return {"toks": F.when(F.col("body"), merge_numbers(numeric)), "desc": F.when(F.col("body"), text)}


def row_aggregates() -> list[Column]:
    """slots, anchors (y, numeric words merged) and description lines of a page, of lines with ``body_columns``."""
    n_numbers = F.size(F.filter("toks", lambda w: S.is_number_token(w["text"])))
    is_anchor = n_numbers >= F.least(F.lit(2), F.size("slots"))
    described = F.col("desc").rlike("[A-Za-z0-9]")
    anchor = F.when(is_anchor, F.struct("line_no", "y", "toks"))
    line = F.when(described, F.struct("line_no", "y", F.col("desc").alias("text"), "h"))
    # the header's slots stand on every line of its page
    return [F.first("slots").alias("slots"), F.sort_array(F.collect_list(anchor)).alias("anchors"), F.sort_array(F.collect_list(line)).alias("described")]


def page_rows(rows: DataFrame) -> DataFrame:
    """One row per page with a recognised table: anchors (y, numeric words merged), description lines, blocks."""
    body = rows.where("table_found").withColumns(body_columns())
    return grouped_rows(body.groupBy(*PAGE).agg(*row_aggregates()))


def grouped_rows(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``page_rows`` of pages with ``row_aggregates``. Columns named in ``keep`` go along."""
    none = F.size("described") == 0
    first = F.when(~none, row_blocks(F.col("described"), F.size("anchors")))
    fallback = ~none & first.isNull()

    def nearest(d: Column) -> Column:
        ranked = F.transform("anchors", lambda a, i: F.struct(F.abs(a["y"] - d["y"]).alias("far"), i.alias("k")))
        return F.array_min(ranked)["k"]

    block_of = F.when(fallback, F.transform("described", nearest)).otherwise(first)
    pages = pages.withColumns({"_blocks": block_of, "_fallback": fallback, "_none": none})
    n_blocks = F.when(F.col("_none"), 0).when(F.col("_fallback"), F.size("anchors")).otherwise(F.size("anchors"))
    texts = S.let(
        F.arrays_zip(F.col("described.text").alias("text"), F.col("_blocks").alias("b")),
        lambda lines: F.transform("anchors", lambda _, i: F.array_join(F.transform(F.filter(lines, lambda z: z["b"] == i), lambda z: z["text"]), " ")),
    )
    return pages.select(
        *PAGE, *keep, "slots", "anchors", n_blocks.alias("n_blocks"), F.when(~F.col("_none"), texts).alias("texts"),
        F.col("_fallback").alias("fallback"), (F.size("anchors") != n_blocks).alias("mismatch"),
    )


def items(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page_no, line, description, quantity, unit, unit_price, vat_percent, net_amount, gross_amount, conflicts) of
    ``page_rows``. Tokens as many as slots go by position, others to the nearest slot, which keeps the first; of two slots
    of one kind the last wins. Columns of ``pages`` named in ``keep`` go along; then a page without items has one row, whose line is null."""
    some = F.col("n_blocks") > 0
    anchors = F.when(some, F.slice("anchors", 1, F.greatest(F.col("n_blocks"), F.lit(1))))
    rows = (pages if keep else pages.where(some)).select(*PAGE, *keep, "slots", F.posexplode_outer(anchors).alias("_k", "_a"), "texts")
    toks = F.col("_a.toks")
    placed = F.when(F.size(toks) == F.size("slots"), F.transform(toks, lambda t, i: F.struct(i.alias("k"), i.alias("t"), t["text"].alias("text")))).otherwise(
        F.transform(toks, lambda t, i: F.struct(nearest_slot(t, F.col("slots"))["k"].alias("k"), i.alias("t"), t["text"].alias("text")))
    )
    rows = rows.select(*PAGE, *keep, (F.col("_k") + 1).alias("line"), F.col("texts")[F.col("_k")].alias("description"), "slots", placed.alias("placed"))
    first = F.filter("placed", lambda p: ~F.exists("placed", lambda q: (q["k"] == p["k"]) & (q["t"] < p["t"])))
    alone = F.size(F.array_distinct(F.transform("placed", lambda p: p["k"]))) == F.size("placed")
    rows = rows.withColumn("_kept", F.when(alone, F.col("placed")).otherwise(first)).withColumn("conflicts", F.size("placed") - F.size("_kept"))

    # every token is tested once; then the last of a kind is picked and read
    read = F.transform(
        "_kept",
        lambda p: F.struct(
            p["k"].alias("k"), F.get(F.col("slots"), p["k"])["kind"].alias("kind"), p["text"].alias("text"),
            F.when(S.is_number_token(p["text"]), p["text"]).alias("number"),
        ),
    )
    rows = rows.withColumn("_read", F.sort_array(read))

    def last_of(kind: str, field: str) -> Column:
        hits = F.filter("_read", lambda p: (p["kind"] == kind) & p[field].isNotNull())
        return F.try_element_at(hits, F.lit(-1))[field]

    def read_as(kind: str, how: Callable[[Column], Column]) -> Column:
        return S.let(S.let(last_of(kind, "number"), S.token_digits), how).alias(kind)

    return rows.select(
        *PAGE, *keep, "line", "description", read_as("quantity", S.digits_number), last_of("unit", "text").alias("unit"),
        read_as("unit_price", S.digits_money), read_as("vat_percent", S.digits_number), read_as("net_amount", S.digits_money), read_as("gross_amount", S.digits_money), "conflicts",
    )
