"""Each operator against a brute-force version on small, awkward tables."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from paperloom.llm import bpe, brown, components, cuckoo, neighbours, packing, quality, simhash, suffixes, warc, windows

DOCS = "doc_id long, text string, lang string, fp string, component_id long, _doc boolean"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = prose(70)
    out = ["", None, " ", "a", prose(3), prose(50), passage, "x " + passage, passage + " y", passage + "\n" + prose(20)]
    out += [prose(400) + " " + passage + "\t" + prose(30), "ab" * 400, "na " * 300, "😀é" * 90, "é" * 150, prose(5000)]
    base = prose(120)
    out += [base, base, base + " end", base.upper(), base.replace("a", "b", 1)]
    out += [prose(rng.randint(1, 200)) for _ in range(30)]
    return out + [out[40], out[40]]


@pytest.fixture(scope="session")
def docs(spark):
    """Ids out of order, ties, a repeated row, extra columns with names that the operators use themselves."""
    rows = [((i * 37) % 101, t, "en", "x", 7, True) for i, t in enumerate(awkward_texts())]
    rows.append(rows[12])
    rows.append((-5, rows[6][1], None, None, None, None))
    return spark.createDataFrame(rows, DOCS).repartition(5).persist()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- 1 --------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(k, f"http://a/{k}\r\n x", t, "extra") for k, t in enumerate(["<p>é</p>", "", None, "same", "same", "x" * 300_000, "same", "<a>\r\n\r\n"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, t, _ in rows:
        raw = (t or "").encode()
        winner = max(k for k, _, u, _ in rows if (u or "") == (t or ""))
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == warc.payload_digest(raw)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if winner == i else ("revisit", winner))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_min_bytes_and_nulls(spark):
    pages = spark.createDataFrame([(1, None, "abc"), (2, "u", "abc"), (None, "v", "abcdef"), (4, None, "abcdef")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload) for r in warc.read(warc.write(pages, min_bytes=5)).collect()}
    assert got == {(1, "response", None, b"abc"), (2, "response", None, b"abc"), (None, "revisit", 4, None), (4, "response", None, b"abcdef")}


def test_zip64_directory_and_scan_without_index():
    writer = warc.PackageWriter()
    for k in range(3):
        writer.add(k, "u", 2, warc.payload_digest(b"ab"), b"ab", None)
    content = writer.close()
    ids = [h["warc-record-id"] for h, _ in warc.PackageReader.of(content).records()]
    assert ids == [f"<urn:page:{k}>" for k in range(3)]
    # the same package with a ZIP64 end record whose 32-bit fields overflow
    at = content.rindex(b"PK\x05\x06")
    n, size, offset = struct.unpack_from("<HII", content, at + 10)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, offset)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at, 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 4) + b"note"
    wide = warc.PackageReader.of(content[:at] + end64 + locator + end)
    assert [h["warc-record-id"] for h, _ in wide.records()] == ids
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("archive/a.warc", writer.warc.getvalue())
    assert [h["warc-record-id"] for h, _ in warc.PackageReader.of(plain.getvalue()).records()] == ids
    with pytest.raises(ValueError):
        warc.PackageReader.of(b"no zip")


def foreign(kind, own, block, **more):
    """A record of another writer."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    """Several archives, gzip, no index, records of all types, ids that are UUIDs, no digests or others, HTTP messages without a length."""
    body = "<p>é</p>".encode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    b32 = lambda name: base64.b32encode(hashlib.new(name, body).digest()).decode()
    plain = [
        foreign("warcinfo", "<urn:uuid:1>", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("response", "<urn:uuid:2>", http, WARC_Target_URI="http://a/", Content_Type="application/http; msgtype=response"),
        foreign("request", "<urn:uuid:3>", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("resource", "<urn:uuid:4>", body, WARC_Target_URI="http://b/", WARC_Payload_Digest=f"sha256:{hashlib.sha256(body).hexdigest()}", Content_Type="text/html"),
        foreign("response", "<urn:page:-7>", http, WARC_Payload_Digest=f"sha1:{b32('sha1')}"),
        foreign("revisit", "<urn:uuid:5>", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", WARC_Refers_To="<urn:page:-7>", WARC_Payload_Digest=f"sha1:{b32('sha1')}"),
        foreign("revisit", "<urn:uuid:6>", b"", WARC_Refers_To="<urn:uuid:2>"),
        foreign("metadata", "<urn:uuid:7>", b"", WARC_Payload_Digest="blake9:abc"),
        foreign("response", "<urn:uuid:8>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nx\r\n0\r\n\r\n", WARC_Payload_Digest=f"sha1:{b32('sha1')}"),
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a.warc", b"".join(plain))
        z.writestr("archive/b.warc.gz", b"".join(gzip.compress(r) for r in plain[:4]))
    packages = spark.createDataFrame([("p.wacz", bytearray(out.getvalue()))], "path string, content binary")
    rows = warc.read(packages).collect()
    assert len(rows) == 13 and [r.record_id for r in rows[9:]] == [f"<urn:uuid:{k}>" for k in range(1, 5)]
    got = [(r.record_type, r.page_id, r.url, r.payload_bytes, r.payload_digest, r.payload, r.refers_to, r.refers_to_id) for r in rows[:9]]
    assert got == [
        ("warcinfo", None, None, 13, None, b"software: x\r\n", None, None), ("response", None, "http://a/", len(body), None, body, None, None), ("request", None, None, 0, None, b"", None, None),
        ("resource", None, "http://b/", len(body), f"sha256:{hashlib.sha256(body).hexdigest()}", body, None, None), ("response", -7, None, len(body), b32("sha1"), body, None, None),
        ("revisit", None, None, 9, b32("sha1"), None, -7, "<urn:page:-7>"), ("revisit", None, None, None, None, None, None, "<urn:uuid:2>"), ("metadata", None, None, 0, "blake9:abc", b"", None, None),
        ("response", None, None, 11, b32("sha1"), b"1\r\nx\r\n0\r\n\r\n", None, None),
    ]
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("archive/a.warc", foreign("response", "<urn:uuid:9>", http, WARC_Payload_Digest=f"md5:{'0' * 32}"))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read(spark.createDataFrame([("p.wacz", bytearray(bad.getvalue()))], "path string, content binary")).collect()


def gzipped_package(n):
    warcs, index = b"", []
    for k in range(n):
        writer = warc.PackageWriter()
        payload = bytes([65 + k % 26]) * (1000 + k)
        writer.add(k, f"http://a/{k}", len(payload), warc.payload_digest(payload), payload, None)
        raw = gzip.compress(writer.warc.getvalue())
        index.append(f'a {k} {json.dumps({"offset": str(len(warcs)), "length": str(len(raw)), "filename": "b.warc.gz"})}')
        warcs += raw
    return warcs, "\n".join(["CDX heading", *index])


def test_files_are_read_by_range(spark, tmp_path):
    """Packages as files: every record comes back, in slices, and a slice reads its own bytes only."""
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k} " * (500 + k)) for k in range(60)], "page_id long, url string, html string").repartition(2)
    for k, r in enumerate(warc.write(pages.coalesce(1), package_bytes=150_000).collect()):
        (tmp_path / f"p {k}.wacz").write_bytes(bytes(r.content))
    warcs, index = gzipped_package(20)
    for name, members in (("gz.wacz", {"archive/b.warc.gz": warcs, "indexes/i.cdx.gz": gzip.compress(index.encode())}), ("scan.wacz", {"archive/b.warc.gz": warcs})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, data in members.items():
                z.writestr(member, data)
    got = warc.read_files(spark, str(tmp_path), slice_bytes=20_000).collect()
    expected = Counter({(k, f"page {k} " * (500 + k)): 1 for k in range(60)})
    expected.update((k, chr(65 + k % 26) * (1000 + k)) for k in range(20) for _ in range(2))
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in got) == expected
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    assert warc.slices(files, 20_000).count() > files.count()
    # bytes read: the tail, the directory, headers and the index for the plan, one record for one record
    content = (tmp_path / "p 0.wacz").read_bytes()
    read = []
    reader = warc.PackageReader(lambda at, n: (read.append(n), content[at : at + n])[1], len(content))
    where = list(reader.ranges())
    assert sum(read) < 65_557 + 20_000 < len(content) and len(where) > 5
    read.clear()
    reader.record(*where[3])
    assert read == [where[3][1]]
    with zipfile.ZipFile(tmp_path / "odd.zip", "w") as z:
        z.writestr("archive/a.arc", b"")
    with pytest.raises(ValueError):
        list(warc.PackageReader.of((tmp_path / "odd.zip").read_bytes()).ranges())


# ---- 2 --------------------------------------------------------------------------------------


def test_packing_against_tokenizer(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=128).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    expected = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 128):
            part = np.array(ids[k : k + 128], "<u4").tobytes()
            expected[(i, k // 128, k, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 128) + 1


def test_word_ids_equal_whole_text_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = random.Random(2)
    alphabet = list("'st.,!?;:|aZé9٣ \n\t") + ["re", "ΑΣ", "İ", "ﬁ", "\x01", "\x1c", "\x85", "́", "　", "😀", "<|endoftext|>"]
    strings = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for s, ids in zip(strings, words.encode([s.encode() for s in strings]), strict=True):
        assert ids.tolist() == tokenizer.encode(s, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for _ in range(20):
        histogram = Counter(rng.randint(1, 60) for _ in range(rng.randint(1, 200)))
        used, bins = Counter(), 0
        for combination, times in packing.plan(dict(histogram), 60):
            assert sum(n * c for n, c in combination) <= 60
            bins += times
            for n, c in combination:
                used[n] += c * times
        assert used == histogram
        assert bins <= math.ceil(sum(n * c for n, c in histogram.items()) / 60) + 2 + sum(c for n, c in histogram.items() if n > 30)


def test_packing_empty(empty):
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# ---- 3 --------------------------------------------------------------------------------------


def brute_windows(rows, window):
    first = {}
    words = [(i, WORDS.findall(t)) for i, t in rows]
    for i, ws in words:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_windows(docs, rows, monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK_WINDOWS", block)
    expected = brute_windows(rows, windows.WINDOW)
    assert found(windows.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    for r in windows.deduplicate(docs).collect():
        assert sum(b - a for a, b in r.intervals) == r.n_removed
        assert (r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) in expected


def test_windows_empty(empty):
    assert windows.digests(empty).count() == 0


# ---- 4 --------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "thing", "order", "stone"]) + rng.choice("abc") for _ in range(80))
    junk = lambda: " ".join(rng.choice(["BUY", "NOW", "CHEAP"]) + "!!" for _ in range(80))
    rows = [(i, good() if i % 3 else junk(), int(i % 3 > 0)) for i in range(300)] + [(300, "", 1), (301, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 302
    for i, _, y in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    held = [i for i in range(300) if got[i].held_out]
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.97
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 302


def test_quality_single_label(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.predicted for r in quality.classify(docs, labels).collect()} == {1}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


# ---- 5 --------------------------------------------------------------------------------------


def test_exact_dedup(docs, rows, empty):
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    expected = sorted((i, max(by[t]), len(by[t]), i == max(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert found(cuckoo.duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected
    assert cuckoo.duplicates(empty).count() == 0
    kept = cuckoo.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {max(v) for v in by.values()}


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = random.Random(4)
    index, live = cuckoo.CuckooIndex(2), {}
    for step in range(6000):
        key = rng.randrange(900)
        digest, content = random.Random(key).getrandbits(64), str(key).encode()
        if key in live and step % 3 == 0:
            assert index.delete(digest, content)
            del live[key]
            assert not index.delete(digest, content)
        else:
            index.fold(digest, content, step, 1)
            live[key] = max(live.get(key, 0), step)
        assert (index.get(digest, content) is not None) == (key in live)
    assert index.size == len(live) and {c: v[0] for _, c, v in index.entries()} == {str(k).encode(): v for k, v in live.items()}
    assert index.get(1, b"other") is None


# ---- 6 --------------------------------------------------------------------------------------


def test_brown_counts_and_scores(docs, rows, empty):
    tokens = [(i, [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(t)] + [None]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, ws in tokens if not held[i] for w in ws)
    total, distinct = sum(count.values()), len(count)
    expected = sorted((i, held[i], len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for i, ws in tokens)
    got = brown.score(docs, classes=8, rounds=2).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    assert brown.score(empty).count() == 0


def test_brown_model_is_a_distribution():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 9, (5, 4)).astype(float)
    chance = brown.smoothed(table)
    assert np.allclose(chance.sum(1), 1)


# ---- 7 --------------------------------------------------------------------------------------


def test_neighbours_recall_ties_and_invalid_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] + [1.0] * 7, 1), (1060, [None] + [1.0] * 7, 1), (1080, [float("inf")] * 8, 1)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    y = x.astype(np.float64)
    hits = 0
    assert set(by) == set(range(0, 600, 20))
    for q, answer in by.items():
        assert [r["rank"] for r in answer] == list(range(1, 21))
        assert all(abs(r.score - y[q] @ y[r.vec_id]) < 1e-9 and r.vec_id != q for r in answer)
        assert [(-r.score, r.vec_id) for r in answer] == sorted((-r.score, r.vec_id) for r in answer)
        scores = y @ y[q]
        best = [k for k in np.lexsort((np.arange(600), -scores)) if k != q][:20]
        hits += len(set(best) & {r.vec_id for r in answer})
    assert hits / (20 * len(by)) >= 0.9


def test_neighbours_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 0.0])]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 3, 0.0)]
    one = spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")
    assert neighbours.nearest(one).count() == 0
    assert neighbours.nearest(one.limit(0)).count() == 0


# ---- 8 --------------------------------------------------------------------------------------


def brute_suffixes(rows):
    n = suffixes.LENGTH
    texts = sorted({(i, t.encode()) for i, t in rows})
    first = {}
    for i, t in texts:
        for p in range(len(t) - n + 1):
            first.setdefault(t[p : p + n], (i, p))
    result = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] != (i, p):
                gone[p : p + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        result[i, t] = (i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted(result[i, t.encode()] for i, t in rows)


def test_suffixes(docs, rows):
    got = found(suffixes.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_suffixes(rows)


def test_suffixes_random_repeats(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool)[rng.randint(0, 40) :] for _ in range(rng.randint(1, 5))]
        rows.append((i * 7 % 61, "".join(parts)))
    got = found(suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_suffixes(rows)


def test_suffixes_deduplicate_keeps_columns(docs, empty):
    got = suffixes.deduplicate(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert suffixes.digests(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_that_share_an_id_keep_what_is_their_own(spark, parts):
    """Different texts of one id, equal rows, rows without an id: no word and no byte goes that isn't a repeat."""
    rng = random.Random(6)
    a, y, z = (" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(120)) for _ in range(3))
    rows = [(1, a), (2, a), (2, y), (2, z + " " + a), (5, y), (5, y), (None, a), (None, a), (None, z)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id int, text string, _own int").repartition(parts)
    cut = Counter((r.doc_id, r.text, r._own) for r in suffixes.deduplicate(docs).collect())
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.digests(docs).collect())
    assert sum(cut.values()) == len(rows) == sum(got.values()) and suffixes.deduplicate(docs).dtypes == docs.dtypes
    assert cut[None, a, 7] == 2 and cut[None, z, 7] == cut[1, a, 7] == cut[2, y, 7] == 1 and cut[2, "", 7] == 1
    assert cut[5, "", 7] == 2 and sum(v for (i, t, _), v in cut.items() if i == 2 and z in t and a[1:] not in t) == 1
    assert got[2, len(y), 0] == got[2, len(a), len(a)] == got[1, len(a), 0] == 1 and got[5, len(y), len(y)] == 2
    words = Counter((r.doc_id, r.n_words, r.n_removed) for r in windows.digests(docs).collect())
    assert words == Counter({(1, 120, 0): 1, (2, 120, 120): 1, (2, 120, 0): 1, (2, 240, 120): 1, (5, 120, 120): 2, (None, 120, 0): 3})


def test_loser_tree_merges_with_common_prefixes():
    rng = random.Random(6)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            n = rng.choice([0, 1, 5, 40])
            runs.append(sorted(bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(n)))
        shared = [[0] + [next((i for i in range(20) if a[i] != b[i]), 20) for a, b in zip(r, r[1:])] for r in runs]
        which, at, prefix = suffixes.merge_runs(runs, [bytes(s) for s in shared])
        merged = [runs[r][i] for r, i in zip(which.tolist(), at.tolist(), strict=True)]
        assert merged == sorted(x for r in runs for x in r)
        for a, b, p in zip(merged, merged[1:], prefix[1:].tolist(), strict=False):
            assert p == next((i for i in range(20) if a[i] != b[i]), 20)


# ---- 9 --------------------------------------------------------------------------------------


def test_bpe_against_tiktoken(docs, rows, empty):
    import base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merger = bpe.merger(path)
    rng = random.Random(1)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "a", "Z", "é", "9", "٣", "!", "　", "😀", "\x1c", "\x00", "​"]
    strings = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + ["a" * 3000, " " * 500, "'" * 50]
    strings += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(100)) for _ in range(100)]
    for s, ids in zip(strings, merger.encode(strings), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(s)
        assert merger.decode(ids) == s.encode()
    got = found(bpe.digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    ids = [(i, t, np.array(reference.encode_ordinary(t), "<u4")) for i, t in rows]
    assert got == sorted((i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, x in ids)
    coded = bpe.encode(docs, path)
    assert sorted((r.doc_id, bytes(r.content)) for r in bpe.decode(coded, path).collect()) == sorted((i, t.encode()) for i, t in rows)
    assert bpe.digests(empty, path).count() == 0


# ---- 10 -------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORDS.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, links):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_simhash(docs, rows, empty):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    least = brute_components(prints, links)
    assert found(simhash.digests(docs), "doc_id", "fingerprint", "component_id") == sorted((i, f"{prints[i]:016x}", least[i]) for i, _ in rows)
    assert simhash.digests(empty).count() == 0
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted(set(least.values()))


def test_vantage_point_tree_finds_every_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = [np.uint64(0)]
    for b in base:
        for _ in range(30):
            flips = rng.integers(0, 64, rng.integers(0, 7))
            points.append(b ^ np.bitwise_xor.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64)), initial=np.uint64(0)))
    points = np.unique(np.array(points, np.uint64))
    root = simhash.tree_links(points, 4)
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 4
    ids = range(len(points))
    least = brute_components(ids, [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    groups = {}
    for i in ids:
        groups.setdefault(least[i], set()).add(int(root[i]))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (20, 21)] + [(100 + k, 101 + k) for k in range(30)]
    got = found(components.components(spark.createDataFrame(links, "u long, v long")), "id", "component_id")
    ids = {x for a, b in links for x in (a, b)}
    least = brute_components(ids, links)
    assert {i: c for i, c in got}.items() >= {(i, c) for i, c in least.items() if i != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def words_lowered(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_near(rows):
    """(id, text) that stay, from plain sets of words: of a component the row with the least id, rows without one last."""
    sets = []
    for _, t in rows:
        ws = words_lowered(t)
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())

    def near(a, b):
        return sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])

    found = brute_components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if near(a, b)])
    groups = {}
    for k, root in found.items():
        groups.setdefault(root, []).append(rows[k])
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=str)


def near_rows():
    """Copies with changed words around the bound, chains of them, a large cluster, common lines, null ids."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = [word() for _ in range(30)]
    texts = ["", None, " ", "one two", "One two"]
    for n in (6, 40, 120, 300):
        for _ in range(6):
            base = [word() for _ in range(n)] + (line if rng.random() < 0.7 else [])
            texts.append(" ".join(base))
            for changes in range(1, n // 12 + 4):
                copy = list(base)
                for k in rng.sample(range(n), min(changes, n)):
                    copy[k] = word()
                texts.append(" ".join(copy))
    base = [word() for _ in range(200)]
    for k in range(80):
        base[(7 * k) % 200] = word()
        texts.append(" ".join(base))
    return [((i * 37) % 1009, t) for i, t in enumerate(texts)] + [(None, "alone without an id"), (None, texts[9]), (3, "alone with a repeated id")]


@pytest.mark.parametrize("key_block, set_bytes, tile", [(simhash.KEY_BLOCK, simhash.SET_BYTES, simhash.TILE), (9, 20_000, 7)])
def test_near_groups_equal_brute_force(spark, key_block, set_bytes, tile, monkeypatch):
    """Exactly the components of a similarity of 0.8, also where keys and groups are dealt out in small blocks."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], "doc_id long, text string, lang string, key int, _n int").repartition(5)
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(docs, width=5, share=0.8, key_block=key_block, set_bytes=set_bytes).collect()), key=str)
    expected = brute_near(rows)
    # of rows with equal ids and equal words any may stay
    assert [i for i, _ in got] == [i for i, _ in expected] and len(set(got) ^ set(expected)) <= 2
    assert len(got) < len(rows) - 80
    assert simhash.deduplicate(docs.limit(0), width=5, share=0.8).count() == 0


def test_pairs_around_the_bound(spark):
    """1200 pairs of a similarity from 0.74 to 0.9: those of 0.8 and more come together, nothing below does."""
    rng, rows, share = random.Random(21), [], []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    while len(share) < 1200:
        base = [word() for _ in range(rng.choice([30, 90, 300]))]
        copy = list(base)
        for k in rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.01, 0.05)))):
            copy[k] = word()
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (base, copy))
        if 0.74 <= len(a & b) / len(a | b) <= 0.9:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
            share.append(5 * len(a & b) >= 4 * len(a | b))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = {r.doc_id for r in simhash.deduplicate(docs, width=5, share=0.8).select("doc_id").collect()}
    assert all(2 * k in kept for k in range(len(share)))
    apart = [2 * k + 1 in kept for k in range(len(share))]
    assert all(x for x, near in zip(apart, share) if not near)
    assert sum(x for x, near in zip(apart, share) if near) <= 2 and sum(share) > 300 < sum(not x for x in share)


@pytest.mark.parametrize("shard,block", [(20, 1 << 20), (60, 16)])
def test_vantage_shards_find_every_link(spark, monkeypatch, shard, block):
    """Many shards, visitors across borders, and shards dealt out in blocks give the components of brute force."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    points = set()
    for b in base:
        for _ in range(12):
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                b ^= np.uint64(1) << np.uint64(k)
            points.add(int(b))
    points = np.array(sorted(points), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    top = simhash.tree(table, 4, shard)
    assert top.shards > 8 and len(top.nodes) == top.shards - 1
    met = simhash.shard_rows(table, 4, shard)
    assert met.where("own").count() == len(points) < met.count()
    got = simhash.links(table, 4, shard, block).collect()
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 4
    ids = points.view(np.int64).tolist()
    expected = brute_components(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near) if a < b])
    found = brute_components(ids, [(r.u, r.v) for r in got])
    assert found == expected


AWKWARD = "doc_id long, text string, score long, _doc boolean, _bucket int, _ids binary, _kept long, _row string, _fp int, label array<int>"


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns with names that operators might use; null ids, an id with two texts, whole rows repeated."""
    long = " ".join(f"w{k}" for k in range(40))
    texts = [(5, "A"), (5, "B"), (9, "B"), (7, "C"), (7, "C"), (None, "D"), (None, "D"), (None, "E"), (3, "E"), (1, None), (2, ""), (4, long), (8, long + " x"), (None, long)]
    rows = [(i, t, 100 + k // 2 * 2, k % 3 == 0, k, bytes([k]), k, f"r{k}", k, [k, None]) for k, (i, t) in enumerate(texts)]
    rows[4] = rows[3]
    return spark.createDataFrame(rows, AWKWARD).repartition(3).persist()


def as_tuples(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


def test_deduplicate_by_row(clashing):
    all_rows = as_tuples(clashing)
    kept = as_tuples(cuckoo.deduplicate(clashing))
    assert cuckoo.deduplicate(clashing).columns == clashing.columns and set(kept) <= set(all_rows)
    assert sorted(((r[0], r[1]) for r in kept), key=str) == sorted(
        [(5, "A"), (9, "B"), (7, "C"), (None, "D"), (3, "E"), (2, ""), (4, kept_text(all_rows, 4)), (8, kept_text(all_rows, 8))], key=str
    )
    assert cuckoo.deduplicate(clashing.limit(0)).count() == 0
    # four-word shingles: the two long texts are near, single words are not
    for options in ({}, {"width": 5, "share": 0.8}):
        near = as_tuples(simhash.deduplicate(clashing, **options))
        assert set(near) <= set(all_rows) and len(near) == len(set(near))
        got = [(r[0], r[1]) for r in near]
        assert {(5, "A"), (7, "C"), (None, "D"), (3, "E"), (5, "B")} <= set(got) and (9, "B") not in got
        assert got.count((7, "C")) == 1 and got.count((None, "D")) == 1 and (1, None) in got and (2, "") not in got
    assert simhash.deduplicate(clashing.limit(0)).count() == 0


def kept_text(rows, i):
    return next(r[1] for r in rows if r[0] == i)


def test_substrings_and_quality_keep_other_columns(spark, clashing):
    cut = suffixes.deduplicate(clashing)
    assert cut.columns == clashing.columns
    # equal but for the text, which loses what an earlier one has
    assert [r[2:] for r in as_tuples(cut)] == [r[2:] for r in as_tuples(clashing)] or sorted(map(str, (r[2:] for r in as_tuples(cut)))) == sorted(map(str, (r[2:] for r in as_tuples(clashing))))
    by = {}
    for r in as_tuples(cut):
        by.setdefault(r[0], []).append(r[1])
    assert by[8] == [" x"] and by[5] == ["A", "B"]
    labels = spark.createDataFrame([(5, 1), (9, 1), (7, 1), (3, 0)], "doc_id long, quality int")
    assert set(as_tuples(quality.accepted(clashing, labels))) <= set(as_tuples(clashing))
    assert as_tuples(quality.accepted(clashing, labels.where("quality = 1"))) == as_tuples(clashing)
    empty = clashing.limit(0)
    assert quality.classify(empty, labels).count() == quality.accepted(empty, labels).count() == suffixes.deduplicate(empty).count() == 0


def test_pipeline_on_an_empty_table(spark, sf, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def thue_morse(n, a, b):
    return b"".join((b if bin(k).count("1") % 2 else a) for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_colliding_words_are_told_apart(spark, n):
    """Words that collide under any polynomial modulo 2^64 with an odd base."""
    path = public_tokenizers.path("word_bpe_49k.json")
    x, y = thue_morse(n, b"a", b"b").decode(), thue_morse(n, b"b", b"a").decode()
    tokenizer, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    strings = [x, y, f"{y} {x} {y}", f"q {x}. {y}, q"]
    for s, ids in zip(strings, words.encode([s.encode() for s in strings]), strict=True):
        assert ids.tolist() == tokenizer.encode(s, add_special_tokens=False).ids
    train, held = ([i for i in range(60) if (zlib.crc32(str(i).encode()) % 7 == 2) == h] for h in (False, True))
    docs = spark.createDataFrame([(train[0], x), (train[1], "q"), (held[0], f"{y} q"), (held[1], x)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in brown.score(docs, classes=4, rounds=1).collect()}
    assert got == {train[0]: (2, 2, 4), train[1]: (2, 2, 4), held[0]: (3, 2, 4), held[1]: (2, 2, 4)}
    distinct, _, places, sizes = brown.tokenise([x.encode(), y.encode(), f"{y} {x}".encode()])
    assert [distinct[p] for p in places] == [x.encode(), b"", y.encode(), b"", y.encode(), x.encode(), b""] and sizes.tolist() == [2, 2, 3]
    assert len(set(distinct)) == len(distinct) == 3


def test_colliding_windows_are_told_apart(spark, monkeypatch):
    """Windows whose Rabin-Karp hashes are all equal, told apart by the second hash alone."""
    monkeypatch.setattr(windows, "mix64", windows.mix64)
    real = windows.window_hashes
    a, b = ["w3765734", "w8229976"]
    thue = [bin(k).count("1") % 2 for k in range(32)]
    first, second = " ".join([(a, b)[t] for t in thue] + ["c"] * 18), " ".join([(b, a)[t] for t in thue] + ["c"] * 18)
    known = windows.WordHashes()
    h = [real(known.of(t.encode().split()), 50) for t in (first, second)]
    assert h[0][1] != h[1][1]
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("pqr") for _ in range(70))) for k in range(30)] + [(40, first), (41, second), (42, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(windows.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows, windows.WINDOW)
    # order and classes where one hash has several seconds
    hashes, seconds = np.array([5, 5, 5, 1, 5], np.uint64), np.array([2, 1, 2, 9, 1], np.uint32)
    order, new = windows.by_hash(hashes, seconds)
    assert order.tolist() == [3, 1, 4, 0, 2] and new.tolist() == [True, True, False, True, False]


def auc(scores, truth):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    yes = np.array(truth) == 1
    return (ranks[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())


def test_quality_held_out_auc(spark):
    """On the labelled documents themselves, those that training never saw."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and auc([r.score for r in rows], [r.quality for r in rows]) > 0.95


def brute_features(text):
    """Words and character n-grams as strings, repeats read as one mark."""
    words, seen, out = WORDS.findall(text), set(), []
    fresh = [True] * len(words)
    for k in range(2, len(words)):
        fresh[k] = tuple(words[k - 2 : k + 1]) not in seen
        seen.add(tuple(words[k - 2 : k + 1]))
    for w, f in zip(words, fresh, strict=True):
        if not f:
            out.append("mark")
            continue
        out.append("w" + w)
        out += [f"3{g}" for k in range(len(w)) if (g := f" {w} "[k : k + 3])]
        out += [f"4{g}" for k in range(len(w) - 1) if (g := f" {w} "[k : k + 4])]
    return Counter(out)


def test_quality_forward_pass_against_brute_force():
    """The same numbers from strings, one feature at a time, and the softmax of an averaged vector."""
    rng = random.Random(2)
    texts_ = ["", " ", "é", "中文 字", "a a a a a a b", "the end the end the end of it", " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(90))]
    for t in texts_:
        assert sorted(Counter(quality.features(t.encode()).tolist()).values()) == sorted(brute_features(t).values())
    samples = [(*np.unique(quality.features(t.encode()), return_counts=True), k % 2) for k, t in enumerate(texts_ * 3)]
    table, bias = quality.train(samples)
    again, bias_again = brute_train(samples)
    assert np.allclose(table, again, rtol=1e-3, atol=1e-2) and abs(bias - bias_again) < 1e-3


def brute_train(samples):
    rng = np.random.default_rng(quality.SEED)
    share = np.mean([y for *_, y in samples])
    vectors = rng.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.BUCKETS, quality.WIDTH)).astype(np.float32).astype(float)
    output, bias = np.zeros((2, quality.WIDTH)), np.array([0.0, np.log(share / (1 - share))])
    steps, step = quality.EPOCHS * len(samples), 0
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(samples)):
            buckets, counts, label = samples[k]
            rate = quality.RATE * (1 - step / steps)
            step += 1
            if not len(buckets):
                continue
            mean = sum(n / counts.sum() * vectors[b] for b, n in zip(buckets, counts, strict=True))
            logits = output @ mean + bias
            e = np.exp(logits - logits.max())
            error = e / e.sum() - np.eye(2)[label]
            back = output.T @ error
            for c in range(2):
                output[c] -= rate * 0.05 * error[c] * mean
            bias -= rate * 0.001 * error
            for b, n in zip(buckets, counts, strict=True):
                vectors[b] -= rate * n / counts.sum() * back
    return vectors @ (output[1] - output[0]), bias[1] - bias[0]


@pytest.fixture(scope="module")
def class_text(spark):
    """Sentences of a class grammar, whose words share contexts."""
    rng = random.Random(12)
    kinds = [[f"{c}{k}" for k in range(12)] for c in "abcde"]
    docs = [(i, " ".join(rng.choice(kinds[(k * 2 + rng.randint(0, 1)) % 5]) for k in range(rng.randint(5, 60)))) for i in range(400)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def test_brown_rounds_raise_likelihood_and_beat_the_base(class_text):
    docs, table = class_text
    model = brown.Model(table, classes=6, rounds=4)
    assert len(model.information) >= 3 and all(a <= b for a, b in zip(model.information, model.information[1:]))
    assert model.information[-1] > 2 * model.information[0]
    held = [r for r in brown.score(table, classes=6, rounds=4).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_brown_scores_against_brute_force(class_text):
    docs, table = class_text
    weight, classes = 0.9, 6
    model = brown.Model(table, classes, 2, with_words=True)
    words = {bytes(r.word).decode(): (r["count"], r["class"]) for r in model.words().collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [*t.split(), ""] for i, t in docs}
    total, distinct = sum(n for n, _ in words.values()), sum(n > 0 for n, _ in words.values())
    move, start, of_class = Counter(), Counter(), Counter()
    for i, ws in tokens.items():
        if not held[i]:
            cls = [words[w][1] for w in ws]
            start[cls[0]] += 1
            move.update(zip(cls, cls[1:]))
            of_class.update(cls)
    share = {c: (of_class[c] + 1) / (total + classes) for c in range(classes)}
    left = Counter()
    for (a, _), n in move.items():
        left[a] += n
    expected = {}
    for i, ws in tokens.items():
        before, out = None, 0.0
        for w in ws:
            n, c = words[w]
            if n == 0:
                p, before = 1 / (total + distinct + 1), "unknown"
            else:
                if before is None:
                    chance = (start[c] + classes * share[c]) / (sum(start.values()) + classes)
                elif before == "unknown":
                    chance = share[c]
                else:
                    chance = (move[before, c] + classes * share[c]) / (left[before] + classes)
                p = weight * chance * n / of_class[c] * (1 - 1 / (total + distinct + 1)) + (1 - weight) * (n + 1) / (total + distinct + 1)
                before = c
            out += math.log10(p)
        expected[i] = out
    got = {r.doc_id: r.score for r in brown.score(table, classes, 2, weight).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-6 for i in got)


def test_exact_dedup_rows_without_an_id(spark):
    rows = [(None, "a"), (4, "a"), (None, "a"), (None, "b"), (None, None), (None, ""), (7, "c"), (9, "c"), (-3, "d"), (None, "d"), (None, "é" * 500)]
    keep = {}
    for i, t in rows:
        keep[t or ""] = max([x for x in (keep.get(t or ""), i) if x is not None], default=None)
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(((r.doc_id, r.text) for r in cuckoo.deduplicate(docs).collect()), key=str)
        # one row of every text; of rows that share id and text the one whose text isn't null
        assert got == sorted({(keep[t or ""], t or "") for _, t in rows}, key=str)
        classed = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in cuckoo.duplicates(docs).collect()), key=str)
        sizes = Counter(t or "" for _, t in rows)
        assert classed == sorted(((i, keep[t or ""], sizes[t or ""], i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def recall(spark, x, **options):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    by = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), **options).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert by.keys() == set(range(0, len(x), options.get("every", 20)))
    hits = 0
    for q, answer in by.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -scores))[:20].tolist()) & answer)
    return hits / (20 * len(by))


def test_neighbours_in_many_groups_and_magnitudes(spark):
    """10,000 vectors in 40 small groups, two random orders only: the descent and the search have to find the rest. Lengths over 12 decades."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 16))
    x = centres[rng.integers(0, 60, 10_000)] + 0.5 * rng.standard_normal((10_000, 16))
    few = {"group": 250, "orders": 2, "every": 100}
    assert recall(spark, x, rounds=0, **few) >= 0.9  # the search alone; the README compares
    lengths = 10.0 ** rng.uniform(-6, 6, (10_000, 1))
    assert recall(spark, x * lengths, **few) >= 0.9


def test_the_descent_finds_what_the_search_alone_does_not(spark):
    """6000 vectors that start from two orders in groups of five: the search alone finds a fifth of the neighbours, after the descent it finds nine in ten and more."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 3.0 * rng.standard_normal((6000, 32))
    poor = {"group": 5, "orders": 2, "every": 100}
    assert recall(spark, x, rounds=0, **poor) < 0.5
    assert recall(spark, x, **poor) > 0.9


def test_neighbours_beside_one_huge_vector(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[7] *= 1e8
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    by = {}
    for r in neighbours.nearest(docs).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(np.float64)
    best = {q: set([k for k in np.lexsort((np.arange(600), -(y @ y[q]))) if k != q][:20]) for q in range(0, 600, 20)}
    assert by.keys() == best.keys()
    assert sum(len(by[q] & best[q]) for q in by) / (20 * len(by)) >= 0.9
