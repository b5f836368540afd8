"""Mixing, divergence and resampling against brute-force versions on small, awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import pytest

from paperloom import shared
from paperloom.llm import common, divergence, importance, mixing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, size int, h long, key string, times int, _group string, rank int"


def prose(rng, vocabulary, n):
    return rng.choice((" ", "\n", "\t ")).join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """One source holds a third of the rows, one a single long text, one nothing; null and repeated rows."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcABZéß😀0-'") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    out = [(k, prose(rng, vocabulary, rng.randint(0, 60)), rng.choice(["en", "de", "", None]), rng.choice([f"s{rng.randint(0, 9)}", "s1", None, ""])) for k in range(400)]
    out += [(1000 + k, prose(rng, vocabulary[: 5 + k % 3], 25), "en", "hot") for k in range(200)]
    out += [(2000, prose(rng, vocabulary, 9000), "en", "long"), (2001, None, "en", "none"), (2002, "", "fr", "alone"), (None, "Äpfel und apples " * 9, "de", "s1"), (None, None, None, None)]
    out += [out[5], out[5], (5, "another text of that id", "en", "s2"), (-3, "x" * 200_000, "en", "😀"), (2003, "y " * 30, "en", "z￿")]
    return [(*r, 1, 2, "k", 3, "g", 4) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 11 -------------------------------------------------------------------------------------


def brute_targets(sizes, weights, most):
    """Shares of the sum of {source: size}, the excess over a bound shared again, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        share = {s: Fraction(weight[s] * rest, sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**held, **share}
        held[over[0]] = most * sizes[over[0]]


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("weights, most, broadcast", [((1, 2, 3), 3, 50_000), ((5, 1), 2, 0), ((1,), 1, 50_000)])
def test_mix_meets_its_targets(docs, rows, weights, most, broadcast, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    got = mixing.mixed(docs, weights, most).collect()
    assert sorted(map(repr, [(r.doc_id, r.source, r["size"]) for r in got])) == sorted(map(repr, [(i, s, size_of(t)) for i, t, _, s, *_ in rows]))
    sizes, longest = Counter(), Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += size_of(t)
        longest[s] = max(longest[s], size_of(t))
    want, taken = brute_targets(sizes, weights, most), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert r.taken == r["size"] * r.times and 0 <= r.times <= most
        taken[r.source] += r.taken
    for s in sizes:
        # half of what stands at the limit: the longest document or the row that is there three times
        assert abs(taken[s] - want[s]) <= max(longest[s], 3 * size_of(rows[5][1]) if s == rows[5][3] else 0) / 2 + 1e-6


def test_mix_takes_the_prefix_of_the_hash_order(docs, rows):
    """The limits are those of running totals over sorted hashes, and a larger budget takes all that a smaller one took."""
    sized = [(r.key, r.h, r.size, r.doc_id) for r in mixing.sizes(docs).collect()]
    spark = docs.sparkSession
    for i, t, _, s, *_ in rows[:40]:
        h = int(hashlib.md5(f"11:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        assert ("" if s is None else "=" + s, h, size_of(t), i) in sized
    before = {}
    for part in (0.05, 0.3, 0.77, 0.999):
        totals = Counter()
        for k, _, z, _ in sized:
            totals[k] += z
        budgets = common.stored(spark.createDataFrame([(k, part * v) for k, v in totals.items()], "key string, budget double"), "test")
        limit = {r.key: r.limit for r in mixing.limits(mixing.sizes(docs), budgets).collect()}
        for k, v in totals.items():
            groups = Counter()
            for key, h, z, _ in sized:
                if key == k:
                    groups[h] += z
            total, want = 0, set()
            for h in sorted(groups):
                if total + groups[h] <= part * v or total + groups[h] - part * v < part * v - total:
                    want.add(h)
                    total += groups[h]
                else:
                    break
            taken = {h for h in groups if h < limit.get(k, 0)}
            assert {h for h in taken if groups[h]} == {h for h in want if groups[h]}
            assert before.get(k, set()) <= taken
            before[k] = taken


def test_mixture_repeats_rows_with_all_their_columns(docs, empty):
    want = Counter()
    for r in mixing.mixed(docs).collect():
        want[r.doc_id, r.source] += r.times
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want
    again = Counter((r.doc_id, r.taken) for r in mixing.mixed(docs.repartition(3)).collect())
    assert again == Counter((r.doc_id, r.taken) for r in mixing.mixed(docs).collect())
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0
    nothing = docs.sparkSession.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.source_size, r.target, r.taken) for r in mixing.mixed(nothing).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_mix_runs_no_python(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("InMemory", ""))


# ---- 12 -------------------------------------------------------------------------------------


def brute_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, ws in mine for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        groups = {s: Counter() for _, s, _ in mine}
        for _, s, ws in mine:
            groups[s].update(w for w in ws if w in kept)
        every = sum(groups.values(), Counter())

        def share(counts, w):
            return 1 + 10**9 * (counts[w] + 5) // (sum(counts.values()) + 5 * len(kept))

        for s, counts in groups.items():
            pairs = [(sum(abs(share(counts, w) - share(groups[x], w)) for w in kept), x) for x in groups if x != s]
            terms = [(share(counts, w) - share(every, w), w) for w in counts if share(counts, w) > share(every, w)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("least, top, block, slices, held, broadcast", [(30, 50, 256, 200_000, 250_000, 50_000), (3, 4, 2, 17, 9, 0), (10**6, 5, 3, 5, 100, 50_000)])
def test_divergence(docs, rows, least, top, block, slices, held, broadcast, monkeypatch):
    """Also with blocks of two groups, small slices, and tasks that empty their counts again and again."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    got = sorted(tuple(r) for r in divergence.audit(docs, least, top, block, slices).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows, least, top)


def test_divergence_without_rows_or_terms(spark, empty):
    assert divergence.audit(empty).count() == 0
    bare = spark.createDataFrame([(None, None, "b"), ("12 3", None, None), ("x", "en", "a")], "text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.audit(bare).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(0, 7, 1), (10**13 - 1, 3 * 10**13, 10**6), (9, 9, 1), (123456789012, 999999999999, 12345)]
    rows = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert {tuple(r) for r in rows.collect()} == {(c, n, v, 1 + 10**9 * (c + 5) // (n + 5 * v)) for c, n, v in cases}


# ---- 13 -------------------------------------------------------------------------------------


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resampled(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, runs(r[1], longest)[1]))
    for x in target:
        t.update(map(bucket, runs(x, longest)[1]))
    every, wanted = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (every + buckets) / ((s[b] + 1.0) * (wanted + buckets)))) for b in s}
    out, able = [], []
    for r in rows:
        n, found = runs(r[1], longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            able.append(out[-1])
    able.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = k
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("longest, buckets, percent, chunk", [(1, 10_000, 10, 1 << 15), (3, 500, 37, 64), (2, 65_536, 100, 1)])
def test_resampling(spark, docs, rows, longest, buckets, percent, chunk):
    """Chunks of 64 bytes and of one word own every feature once, whatever its length."""
    target = [rows[3][1], "Äpfel apples 0 aB" * 40, None, "", prose(random.Random(1), ["zz", "aa"], 9000)]
    table = spark.createDataFrame([(k, t, 9) for k, t in enumerate(target)], "doc_id long, text string, rank int")
    got = importance.resampled(docs, table, longest, buckets, percent, size=chunk).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute_resampled(rows, target, longest, buckets, percent)


def test_resampling_without_rows_or_target(spark, docs, rows, empty):
    assert importance.digests(empty, docs).count() == 0
    got = importance.digests(docs, empty).collect()
    assert sorted(map(tuple, got), key=repr) == brute_resampled(rows, [])


def test_chunks_own_every_word_once():
    rng = random.Random(3)
    for _ in range(200):
        text = importance.clean(bytes(rng.choice(b"ab  .") for _ in range(rng.randint(0, 80))))
        for n in (1, 2, 4):
            size = rng.randint(1, 20)
            found = list(importance.chunks(text, n, size))
            assert b"".join(c[:own] for c, own in found) == text
            got = Counter(x for c, own in found for x in importance.features(c, own, n, 60_000)[1].tolist())
            assert got == Counter(crc32(f.encode()) % 60_000 for f in runs(text.decode(), n)[1])


def test_ranked_is_the_order(spark):
    rng = random.Random(4)
    values = [rng.choice([1, 1, 1, rng.randint(0, 10**6), None]) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "_at long").repartition(7)
    got = common.ranked(table, "place", "_at").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(values) + 1))
    assert [r._at for r in got] == sorted(values, key=lambda v: (v is not None, v or 0))
    assert common.ranked(table.limit(0), "place", "_at").count() == 0
