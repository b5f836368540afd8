"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown, cuckoo, divergence, importance, mixing, neighbours, packing, quality, simhash, suffixes, warc, windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.digests(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.duplicates(_table(spark, sf_dir, "documents"))


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(_table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_packing, op3_windows, op4_quality, op5_exact_dedup, op6_brown, op7_neighbours, op8_suffixes, op9_bpe, op10_simhash,
        op11_mixing, op12_divergence, op13_importance,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        b AS (SELECT page_id, hex, strlen(html) AS payload_bytes,
                     array_to_string(list_transform(range(40), lambda i: lpad(bin(instr('123456789abcdef', hex[i + 1])), 4, '0')), '') AS bits
              FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                   16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT + 1]), '') AS payload_digest,
               CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
        FROM b WINDOW w AS (PARTITION BY hex)
    """,
    "op3_windows": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS h
              FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d WHERE len(words) >= 50)),
        f AS (SELECT h, min(doc_id) AS first_doc FROM w GROUP BY h HAVING count(*) > 1),
        g AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM w JOIN f USING (h) WHERE doc_id > first_doc),
        r AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 50)))) AS gone FROM g GROUP BY doc_id),
        k AS (SELECT doc_id, words, coalesce(len(gone), 0) AS n_removed,
                     CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END AS kept
              FROM d LEFT JOIN r USING (doc_id))
        SELECT doc_id, len(words) AS n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
    "op8_suffixes": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, md5(x[2 * p + 1:2 * p + 200]) AS h
              FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d WHERE len(x) >= 200)),
        f AS (SELECT h, min((doc_id, p)) AS first_at FROM w GROUP BY h HAVING count(*) > 1),
        g AS (SELECT doc_id, p, p > 100 + lag(p, 1, -1000000) OVER (PARTITION BY doc_id ORDER BY p) AS new
              FROM w JOIN f USING (h) WHERE (doc_id, p) > first_at),
        i AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
        r AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY ALL),
        k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM r),
        c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
                     string_agg(CASE WHEN n = 1 THEN x[1:2 * a] ELSE '' END || CASE WHEN next_a IS NULL THEN x[2 * b + 1:] ELSE x[2 * b + 1:2 * next_a] END, '' ORDER BY a) AS kept
              FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, x))) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)
    """,
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d
    """,
    "op11_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
                   FROM documents),
        s AS (SELECT source, s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w
              FROM (SELECT source, sum(size)::HUGEINT AS s FROM d GROUP BY source)),
        o AS (SELECT *, coalesce(sum(3 * s) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS held,
                     (sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS shares, (sum(s) OVER ())::HUGEINT AS total
              FROM s WINDOW r AS (ORDER BY 3 * s::DOUBLE / w::DOUBLE, source)),
        a AS (SELECT source, s, w, total, 3 * s * shares < w * (total - held) AS above FROM o),
        t AS (SELECT source, s, CASE WHEN above OR total = 0 THEN (3 * s)::DOUBLE
                                     ELSE (w * (total - (sum(CASE WHEN above THEN 3 * s ELSE 0 END) OVER ())::HUGEINT))::DOUBLE / (sum(CASE WHEN above THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
              FROM a),
        b AS (SELECT source, s::BIGINT AS source_size, target, CASE WHEN s = 0 THEN 0 ELSE floor(target / s::DOUBLE) END::BIGINT AS times FROM t),
        c AS (SELECT d.*, source_size, target, b.times, target - b.times * source_size::DOUBLE AS budget,
                     sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS z
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
        m AS (SELECT *, times + (CASE WHEN budget > 0 AND (upto <= budget OR upto - budget < budget - (upto - z)) THEN 1 ELSE 0 END) AS copies FROM c)
        SELECT doc_id, source, size, source_size, target, copies::BIGINT AS times, (size * copies)::BIGINT AS taken FROM m
    """,
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*)::BIGINT AS lang_c FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::BIGINT AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.lang_c,
                     sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n, count(*) OVER (PARTITION BY g.lang, g.source) AS v
              FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        t AS (SELECT lang, sum(lang_c) AS lang_n FROM k GROUP BY lang),
        p AS (SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (lang_c + 5)) // (lang_n + 5 * v))::BIGINT AS q
              FROM f JOIN t USING (lang)),
        x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN (SELECT a.lang, a.source AS one, b.source AS other, sum(abs(a.p - b.p)) AS value
                         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
                     ON s.lang = a.lang AND s.one = a.source AND s.other = b.source),
        y AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM x UNION ALL FROM y))
        WHERE part = 'pair' OR rank <= 50
    """,
    "op13_importance": r"""
        WITH RECURSIVE step AS (SELECT i AS byte, i::UINTEGER AS c, 0 AS n FROM range(256) r(i)
                                UNION ALL SELECT byte, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UINTEGER ELSE 0::UINTEGER END), n + 1 FROM step WHERE n < 8),
        crc AS (SELECT list(c::BIGINT ORDER BY byte) AS tab FROM step WHERE n = 8),
        d AS (SELECT row_number() OVER () AS row, doc_id, true AS own, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark),
        w AS (SELECT row, own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM d),
        h AS (SELECT term, hex(encode(term)) AS x FROM (SELECT DISTINCT term FROM w)),
        b AS (SELECT term, xor(4294967295, list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                                   lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
              FROM h, crc),
        f AS (SELECT row, own, bucket FROM w JOIN b USING (term)),
        n AS (SELECT bucket, (count(*) FILTER (own))::DOUBLE AS s, (count(*) FILTER (NOT own))::DOUBLE AS t FROM f GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((sum(s) OVER ()) + 10000) / ((s + 1) * ((sum(t) OVER ()) + 10000))))::BIGINT AS gain FROM n),
        z AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE own GROUP BY row),
        e AS (SELECT d.row, d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS noise
              FROM d LEFT JOIN z USING (row) WHERE own),
        r AS (SELECT *, weight + floor(-1000 * ln(-ln((noise + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
        q AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM r WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM r LEFT JOIN q USING (row)
    """,
}
