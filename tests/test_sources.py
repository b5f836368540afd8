"""Kinds of files by seek, dates in text, exact ranks."""

import io
import random
import zipfile

import pytest

from paperloom.functions import scalars as S
from paperloom.options import Options
from paperloom.plans import evaluate
from paperloom.sources import files


def archive(names, extra=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(name, b"x" * extra)
    return out.getvalue()


DOCX = ("word/document.xml", "[Content_Types].xml")
CONTENTS = {
    "a.pdf": b"%PDF-1.4", "b.docx": archive(DOCX), "c.zip": b"PK\x03\x04junk", "d.txt": b"text", "f.png": b"\x89PNG\r\n\x1a\n1", "g.jpg": b"\xff\xd8\xff\xe0", "h.tif": b"II*\0....", "i.tif": b"MM\0*",
    "j.webp": b"RIFF....WEBPVP8 ", "k.webp": b"RIFF....WAVE", "l.x": b"%", "m.xlsx": archive(["xl/workbook.xml"]), "n.png": b"\x89PNG\r\n\x1a", "o.webp": b"RIFF....WEB",
}


class Counted(io.BytesIO):
    def __init__(self, raw):
        super().__init__(raw)
        self.got = 0

    def read(self, n=-1):
        raw = super().read(n)
        self.got += len(raw)
        return raw


def test_kinds_are_those_of_whole_contents(spark, tmp_path):
    for name, raw in CONTENTS.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "z.big").write_bytes(b"%PDF-" + b"x" * (2 << 20))
    by_seek = {r.filename: (r.length, r.kind, r.error_code, r.error) for r in files.scanned(spark, str(tmp_path), Options(max_upload_mb=1)).collect()}
    whole = {r.filename: (r.length, r.kind, r.error_code, r.error) for r in files.uploads(spark, str(tmp_path), options=Options(max_upload_mb=1)).collect()}
    assert by_seek == whole and len(whole) == len(CONTENTS) + 1 and whole["z.big"][2] == 413
    assert {k: v[1] for k, v in by_seek.items() if v[1]} == {"a.pdf": "pdf", "b.docx": "docx", "f.png": "png", "g.jpg": "jpeg", "h.tif": "tiff", "i.tif": "tiff", "j.webp": "webp"}

    def broken(path):
        raise OSError("gone")

    lost = files.scanned(spark, str(tmp_path), Options(max_upload_mb=1), broken).where("filename = 'a.pdf'").first()
    assert (lost.error_code, lost.error) == (400, "Could not open file: gone")


def test_a_long_file_is_not_read():
    long = Counted(archive(DOCX, 3_000_000))
    assert files.kind_at(long) == "docx" and long.got < 70_000 < len(long.getvalue())
    image = Counted(b"\x89PNG\r\n\x1a\n" + bytes(1_000_000))
    assert files.kind_at(image) == "png" and image.got == 12


@pytest.mark.parametrize("text, iso", [
    ("Mar 13, 2022", "2022-03-13"), ("2022-03-13", "2022-03-13"), ("garbage", None), ("31/02/2020", None), ("", None), (None, None),
    ("the 5th of March, 2021", "2021-03-05"), ("5-Mar-2021", "2021-03-05"), ("March 2021", None), ("5 March", None), ("31 April 2020", None), ("Sept. 9th 1999 10:30", "1999-09-09"),
    ("2021 March 5", "2021-03-05"), ("Friday, 5 March 2021, about noon", "2021-03-05"), ("5 Mar '99", "1999-03-05"), ("Mar-2003-25", "2003-03-25"), ("5 Mar 21", "2021-03-05"), ("Mar 5 21", "2021-03-05"),
    ("from 1 March 2021 to 5 April 2021", None), ("March 5 6 2021", None), ("marching 5 2021", None), ("Invoice 77 of 12 May 2020", None), ("12MAY2020", None), ("May 12 2020 11:59pm", "2020-05-12"),
])
def test_dates_in_text(spark, text, iso):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_date(S.F.col("t")).alias("d")).first().d == iso


def test_nearest_rank_is_the_sorted_place(spark):
    rng = random.Random(2)
    tables = [
        [rng.expovariate(1e-3) for _ in range(3000)], [5.0] * 40 + [1e300, -1e300, 0.0], [rng.choice([1.0, 2.0, 1e-300]) for _ in range(99)], [7.0], [1e308, -1e308, 3.0, 3.0],
    ]
    for values in tables:
        rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "ms double").repartition(3)
        for rank in {1, len(values), max(1, len(values) * 95 // 100), (len(values) + 1) // 2}:
            assert evaluate.nearest_rank(rows, "ms", rank) == sorted(values)[rank - 1]
        got = evaluate.latency(rows).first()
        assert got.n == len(values) and got.p95_ms == sorted(values)[max(int(0.95 * len(values)), 1) - 1]
    near = [2**60 + k for k in range(9)] + [3]
    longs = spark.createDataFrame([(v,) for v in near], "ms long")
    assert [evaluate.nearest_rank(longs, "ms", k + 1) for k in range(10)] == sorted(near)
    assert tuple(evaluate.latency(longs.limit(0)).first()) == (0, None, None)
