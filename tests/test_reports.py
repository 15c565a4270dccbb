"""Foreign headers, report files, corpus rows and plays."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import corpus, frames, structure
from tessera.sources import foreign, reports


def riff(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind, data=b""):
    return struct.pack(">I", 8 + len(data)) + kind + data


def lossless(w, h):
    return b"\x2f" + struct.pack("<I", w - 1 | h - 1 << 14)


def bits(*fields):
    value = at = 0
    for v, n in fields:
        value, at = value | v << at, at + n
    return value.to_bytes(-(-at // 8) + 4, "little")


def jxl(*metadata):
    return b"\xff\x0a" + bits((0, 1), (1, 2), (299, 13), (0, 3), (1, 2), (399, 13), *metadata)


def avif(av1c=b"\x81\x00\x1c\x00", matrix=0, full=0x80, extra=b""):
    properties = box(b"ispe", struct.pack(">III", 0, 40, 30)) + box(b"av1C", av1c) + box(b"colr", b"nclx" + struct.pack(">HHHB", 1, 13, matrix, full)) + extra
    return box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", properties)))


def tiff(order, large=False, entries=((256, 3, (50,)), (257, 4, (60,)), (258, 3, (8, 8, 8))), chain=1):
    place, count = ("Q", "Q") if large else ("I", "H")
    word, mark = struct.calcsize(f"={place}"), b"II" if order == "<" else b"MM"
    out = bytearray(mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, 16) if large else struct.pack(f"{order}HI", 42, 8)))
    for k in range(chain):
        here = len(out)
        size = struct.calcsize(f"={count}") + len(entries) * (4 + 2 * word) + word
        body, far = struct.pack(f"{order}{count}", len(entries)), b""
        for tag, kind, values in entries:
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            body += struct.pack(f"{order}HH{place}", tag, kind, len(values))
            if len(data) > word:
                body += struct.pack(f"{order}{place}", here + size + len(far))
                far += data
            else:
                body += data.ljust(word, b"\0")
        out += body + struct.pack(f"{order}{place}", here + size + len(far) if k + 1 < chain else 0) + far
    return bytes(out)


def gif(*delays):
    frames_ = b"".join(b"\x21\xf9\x04\0" + struct.pack("<H", d) + b"\0\0\x2c" + struct.pack("<4H", 0, 0, 9, 8) + b"\0\x02\x02\x4c\x01\0" for d in delays)
    return b"GIF89a" + struct.pack("<HH", 9, 8) + b"\x80\0\0" + b"\0" * 6 + frames_ + b"\x3b"


DEPTH8, NO_EXTRA = ((0, 1), (0, 2)), ((0, 2),)
PLAIN = ((0, 1), (0, 1), *DEPTH8, (1, 1), *NO_EXTRA)
FILES = [
    (riff((b"VP8L", lossless(300, 400))), (300, 400)), (riff((b"VP8X", b"\0" * 10), (b"VP8L", lossless(1, 16384))), (1, 16384)), (riff((b"VP8 ", b"\0\0")), "lossy"),
    (riff((b"VP8X", b"\2" + b"\0" * 9), (b"ANIM", b"\0" * 6)), "animated"), (riff((b"ICCP", b"abc")), "invalid"), (riff((b"VP8L", lossless(3, 4)))[:-3], "invalid"),
    (jxl(*PLAIN, (0, 1)), (400, 300)), (jxl(*PLAIN, (1, 1)), "samples in a perceptual space"), (jxl((1, 1)), "samples in a perceptual space"), (jxl((0, 1), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1)), "animated"),
    (jxl((0, 1), (0, 1), (0, 1), (1, 2)), "over 8 bits"), (jxl((0, 1), (0, 1), *DEPTH8, (1, 1), (1, 2), (1, 1), (0, 1)), (400, 300)),
    (jxl((0, 1), (0, 1), *DEPTH8, (1, 1), (1, 2), (0, 1), (0, 2), *DEPTH8, (0, 2), (0, 2), (1, 1)), "premultiplied alpha"), (b"\xff\x0a", "invalid"),
    (box(b"JXL ", b"\r\n\x87\n") + box(b"jxlc", jxl(*PLAIN, (0, 1))), (400, 300)), (avif(), (40, 30)), (avif(b"\x81\0\x5c\0"), "over 8 bits"), (avif(b"\x81\0\x0c\0"), "chroma of fewer samples"),
    (avif(matrix=6), "a matrix other than identity"), (avif(full=0), "a limited range"), (avif(extra=box(b"pixi", b"\0\0\0\0\3\x0a\x0a\x0a")), "over 8 bits"), (avif() + box(b"moov"), "animated"), (avif()[:-4], "invalid"),
    *((tiff(o, large), (50, 60)) for o in "<>" for large in (False, True) if not (large and o == ">")), (tiff("<", chain=3), "several images"), (tiff(">", entries=((256, 3, (5,)), (257, 3, (6,)), (259, 3, (7,)))), "lossy"),
    (tiff("<", entries=((256, 3, (5,)), (257, 3, (6,)), (258, 3, (16,)))), "over 8 bits"), (tiff("<", entries=((256, 3, (5,)), (257, 3, (6,)), (339, 3, (3,)))), "samples with a sign or fractions"),
    (tiff("<", entries=((256, 3, (5,)),)), "invalid"), (b"II*\0\x08\0\0\0\0\0\x08\0\0\0", "invalid"), (gif(0, 5, 100), (9, 8)), (gif(), "invalid"), (gif(3)[:-1], "invalid"),
]


def test_foreign_headers(spark):
    rows = [(str(i), data) for i, (data, _) in enumerate(FILES)] + [("png", b"\x89PNG\r\n\x1a\n"), ("null", None), ("empty", b"")]
    got = {r.path: r for r in foreign.checked(spark.createDataFrame(rows, "path string, content binary").repartition(3)).collect()}
    assert set(got) == {str(i) for i in range(len(FILES))}
    for i, (_, want) in enumerate(FILES):
        r = got[str(i)]
        if isinstance(want, tuple):
            assert r.fit and r.reason is None and (r.width, r.height) == want, (i, r)
        else:
            assert not r.fit and r.reason.startswith(want), (i, r)
    sequence = next(got[str(i)] for i, (d, w) in enumerate(FILES) if d == gif(0, 5, 100))
    assert (sequence.frames, sequence.delays) == (3, [100, 50, 1000])


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("b/2.png", "x", 3, 4, 12, "RGB", "ab", "s"), ("a/1.png", "y|z", 5, 6, 30, "RGBA", None, "s")], reports.MANIFEST)
    reports.append_csv(rows.limit(1), f"{tmp_path}/csv")
    reports.append_csv(rows.filter("Width = 5"), f"{tmp_path}/csv")
    back = reports.read_manifest(spark, f"{tmp_path}/csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert [r.Path for r in corpus.missing(back, spark.createDataFrame([("a/1.png",)], "path string")).collect()] == ["b/2.png"]
    reports.append_csv(rows.limit(1).withColumn("Path", F.lit(None).cast("string")), f"{tmp_path}/csv")
    with pytest.raises(Exception, match="manifest row"):
        reports.read_manifest(spark, f"{tmp_path}/csv").collect()
    reports.write_json(rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2 and '"NormalizedSHA256":null' in "".join(r.value for r in spark.read.text(f"{tmp_path}/json").collect())
    reports.write_text(reports.markdown(rows.select("Path", "Category", "Pixels"), "Path"), f"{tmp_path}/md")
    assert [r.value for r in spark.read.text(f"{tmp_path}/md").collect()] == ["| Path | Category | Pixels |", "|---|---|---:|", "| a/1.png | y\\|z | 30 |", "| b/2.png | x | 12 |"]


def test_corpus_rows(spark):
    sizes = spark.createDataFrame([(5, 5, None), (5, 5, "no header"), (20_000, 1, None), (16_000, 16_000, None)], "w int, h int, why string")
    got = sizes.select(corpus.exclusion(F.col("w"), F.col("h"), failed=F.col("why")).alias("r")).collect()
    assert [r.r for r in got] == [None, "tool failure: no header", "dimension limit", "pixel ceiling"]
    rows = spark.createDataFrame([("B", "b", 0), ("a", "z", 0), ("b", "A", 0), ("B", "a", 1)], "category string, path string, d int")
    assert [(r.category, r.path) for r in corpus.in_report_order(rows, "category", "path").collect()] == [("a", "z"), ("B", "a"), ("b", "A"), ("B", "b")]
    assert [r.path for r in corpus.first_images(rows, 2).collect()] == ["A", "a"]
    assert corpus.exact_or_error(rows.filter("d = 0"), "d").count() == 3
    with pytest.raises(Exception, match="differs from its source: a"):
        corpus.exact_or_error(rows, "d").collect()
    words = spark.createDataFrame([("all",), ("ALL",), ("0",), ("3",), ("99",), ("x",), ("",), (None,)], "t string")
    assert [r.n for r in words.select(scalars.threads(F.col("t"), 8).alias("n")).collect()] == [8, 8, 1, 3, 8, None, None, None]


def test_exact_median(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(v)) for k, n in (("a", 1), ("b", 2), ("c", 999), ("d", 1000)) for v in rng.integers(-90_000, 90_000, n)] + [("e", 7), ("e", None)] + [("f", 5)] * 50 + [("f", 8)] * 50
    got = {r.k: r.median for r in corpus.median(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()}
    for k in "abcdef":
        values = [v for j, v in rows if j == k and v is not None]
        assert got[k] == round(float(np.median(values))), k


def test_played(spark):
    table = frames.timeline(spark.createDataFrame([(1, 0, 0), (1, 1, 50), (2, 0, 30)], "anim long, frame long, delay long"))
    got = sorted(tuple(r) for r in frames.played(table, 2).collect())
    assert got == [(1, 0, 0, 0), (1, 0, 1, 100), (1, 1, 0, 150), (1, 1, 1, 250), (2, 0, 0, 0), (2, 1, 0, 30)]
    assert sorted(r.start for r in frames.played(table, 0, 100).filter("anim = 2").collect()) == [0, 30, 60, 90]
    with pytest.raises(ValueError):
        frames.played(table, 0)


@pytest.mark.parametrize("band", [1, 2, 3])
def test_runs_and_sums_across_bands(spark, monkeypatch, band):
    monkeypatch.setattr(structure, "BAND", band)
    rng = np.random.default_rng(band)
    images = [np.zeros((7, 3), int), rng.integers(0, 2, (9, 2)), np.repeat(rng.integers(0, 2, (8, 1)), 4, 1), np.ones((1, 1), int)]
    images[2][3:6] = 1
    rows = spark.createDataFrame([(i, y, [int(v) for v in line]) for i, a in enumerate(images) for y, line in enumerate(a)], "img int, y long, line array<int>").repartition(4)
    want = set()
    for i, a in enumerate(images):
        flat, start = a.ravel(), 0
        for k in range(1, len(flat) + 1):
            if k == len(flat) or flat[k] != flat[start]:
                want.add((i, start // a.shape[1], start % a.shape[1], int(flat[start]), k - start))
                start = k
    got = [tuple(r) for r in structure.runs(rows).select("img", "y", "x", "v", "n").collect()]
    assert len(got) == len(want) and set(got) == want
    sums = {(r.img, r.y, r.x): r.s for r in structure.prefix_sums(rows).collect()}
    assert sums == {(i, y, x): int(v) for i, a in enumerate(images) for (y, x), v in np.ndenumerate(a.cumsum(0).cumsum(1))}
