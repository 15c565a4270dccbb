"""Scalar functions, registered functions, the data source and the command line."""

import numpy as np
from pyspark.sql import functions as F
from test_codec import fill

from tessera import api
from tessera.functions import scalars as s
from tessera.operators import codec
from tessera.sources import files


def one(spark, column, **values):
    names = ", ".join(f"{v!r} AS {k}" if not isinstance(v, bool) else f"{str(v).lower()} AS {k}" for k, v in values.items())
    return spark.sql(f"SELECT {names}").select(column).first()[0]


def test_scalars(spark):
    n = spark.range(-300, 300).selectExpr("CAST(id AS INT) AS v")
    for v, up, down, mod, far, bits, size in n.select(
        "v", s.unfolded(s.folded(F.col("v"))), s.floor_shift(F.col("v"), 3), s.modulo(F.col("v"), 7), s.circular_distance(F.col("v"), F.lit(5)), s.bit_length(F.abs("v")), s.varint_bytes(F.abs("v"))
    ).collect():
        assert (up, down, mod, far, bits) == (v, v >> 3, v % 7, min((v - 5) & 255, (5 - v) & 255), abs(v).bit_length()) and size == len(codec.varint(abs(v)))
    for v, power, width in spark.range(1, 70_000, 977).select("id", s.next_power_of_two(F.col("id")), s.index_bits(F.col("id"))).collect():
        assert power == 1 << (v - 1).bit_length() and width == codec.index_bits(v)
    assert one(spark, s.lerp15(F.col("a"), F.col("b"), F.col("q")), a=10, b=250, q=4) == (10 * 11 + 250 * 4 + 7) // 15
    assert one(spark, s.value_of(F.col("t"), "mode"), t="w=3 mode=native x") == "native" and one(spark, s.value_of(F.col("t"), "z"), t="w=3") is None
    assert one(spark, s.output_path(F.col("p"), "/out/", "png"), p="/a/b.c/d.e.bmp") == "/out/d.e.png"
    assert one(spark, s.category(F.col("p"), F.lit("src"), F.lit(True)), p="x/y.png") == "src-x" and one(spark, s.category(F.col("p"), F.lit("src"), F.lit(True)), p="y.png") == "src"
    assert one(spark, s.human_size(F.col("n")), n=3 * 1024 * 1024 // 2) == "1.5 MiB" and one(spark, s.human_size(F.col("n")), n=12) == "12 B"
    assert one(spark, s.named(F.col("n"), s.MODE_NAMES), n=9) == "native" and one(spark, s.named(F.col("n"), s.CODEC_NAMES), n=1) == "unknown"
    masks = spark.range(256).selectExpr("CAST(id AS INT) AS v").select("v", s.sample_depth_mask("v").alias("m")).collect()
    assert sum(bool(r.m & 4) for r in masks) == 4 and all(r.m & 2 for r in masks if r.v in (0, 255))


def test_sql_functions_and_table_function(spark):
    api.register(spark)
    image = fill(5, 4, 2)
    spark.createDataFrame([("a", 5, 4, bytearray(image.tobytes()))], "id string, w int, h int, p binary").createOrReplaceTempView("pictures")
    row = spark.sql("SELECT d.status, d.rgba FROM (SELECT decode_rgba(encode_rgba(w, h, p)) AS d FROM pictures)").first()
    assert row.status == "ok" and bytes(row.rgba) == image.tobytes()
    cells = spark.sql("SELECT t.* FROM pictures, LATERAL decode_pixels(encode_rgba(w, h, p)) t").collect()
    assert sorted(tuple(c) for c in cells) == sorted((y, x, *image[y, x].tolist()) for y in range(4) for x in range(5))
    assert spark.sql("SELECT decode_rgba(CAST('junk' AS BINARY)).status").first()[0] != "ok"


def test_data_source_reads_headers(spark, tmp_path):
    api.register(spark)
    (tmp_path / "a.tsr").write_bytes(codec.encode(fill(7, 3, 1))[1])
    (tmp_path / "b.tsr").write_bytes(codec.encode_animation([fill(6, 2, 1)] * 3, [1, 2, 3], 0, ("raw",)))
    (tmp_path / "c.txt").write_text("no")
    got = spark.read.format("container").load(str(tmp_path)).orderBy("path").collect()
    assert [(r.width, r.height, r.frames, r.animated) for r in got] == [(7, 3, 1, False), (6, 2, 3, True)]


def test_command_line(spark, tmp_path, capsys):
    image = fill(9, 8, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(files.png(image))
    (tmp_path / "in/bad.png").write_bytes(b"nothing")
    packed, back = str(tmp_path / "a.tsr"), str(tmp_path / "back.bmp")
    assert api.main(["pack", str(tmp_path / "in/a.png"), packed]) == 0 and api.main(["unpack", packed, back]) == 0
    assert np.array_equal(files.read_bmp((tmp_path / "back.bmp").read_bytes()), image)
    assert api.main(["info", packed]) == 0 and "width=9 height=8" in capsys.readouterr().out
    assert api.main(["unpack", str(tmp_path / "in/bad.png"), back]) == 1
    assert api.main(["batch", str(tmp_path / "in"), str(tmp_path / "out")]) == 1
    assert np.array_equal(codec.decode((tmp_path / "out/a.tsr").read_bytes()), image)
