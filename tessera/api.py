"""Surfaces for SQL and for files: functions to register, a table function, a data source and a command line.

`python -m tessera.api pack|unpack|info|batch ...`
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators import codec
from tessera.sources import files


DECODED = T.StructType([T.StructField("status", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType())])


@F.pandas_udf(T.BinaryType())
def encode_rgba(width: pd.Series, height: pd.Series, rgba: pd.Series) -> pd.Series:
    """The smallest container of each image."""
    return pd.Series([codec.encode(np.frombuffer(p, np.uint8).reshape(h, w, 4))[1] if p is not None else None for w, h, p in zip(width, height, rgba)])


@F.pandas_udf(DECODED)
def decode_rgba(content: pd.Series) -> pd.DataFrame:
    """Pixels of each file, or why there are none."""
    out = []
    for data in content:
        try:
            image = files.read_picture(bytes(data or b""))
            out.append(("ok", image.shape[1], image.shape[0], image.tobytes()))
        except codec.BadFile as e:
            out.append((str(e), None, None, None))
    return pd.DataFrame(out, columns=["status", "width", "height", "rgba"]).astype({"width": "Int32", "height": "Int32"})


class DecodePixels:
    """Table function: a row for each pixel of a file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        image = files.read_picture(bytes(content))
        for y, line in enumerate(image.tolist()):
            for x, (r, g, b, a) in enumerate(line):
                yield y, x, r, g, b, a


def register(spark: SparkSession) -> None:
    """encode_rgba, decode_rgba and decode_pixels for SQL, and the format "container"."""
    spark.udf.register("encode_rgba", encode_rgba)
    spark.udf.register("decode_rgba", decode_rgba)
    spark.udtf.register("decode_pixels", F.udtf(DecodePixels, returnType="y int, x int, r int, g int, b int, a int"))
    spark.dataSource.register(ContainerSource)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ContainerSource(DataSource):
    """spark.read.format("container").load(folder): header fields of files in a folder that tasks share, from 28 bytes of each."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return "path string, width long, height long, mode int, transform int, frames long, animated boolean"

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options["path"])


class _HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        return [_File(str(p)) for p in sorted(Path(self.path).rglob("*")) if p.is_file()]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            head = f.read(28)
        if len(head) < 28 or head[:4] != codec.MARK:
            return
        n = lambda a, b: int.from_bytes(head[a:b], "little")
        animated = head[12] == codec.ANIM
        yield partition.path, n(4, 8), n(8, 12), head[12], head[13], n(16, 20) if animated else 1, animated


def _save(path: str, data: bytes) -> None:
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    Path(part).write_bytes(data)
    os.replace(part, path)


def pack(source: str, target: str) -> int:
    data = codec.encode(files.read_picture(Path(source).read_bytes()))[1]
    _save(target, data)
    return len(data)


def unpack(source: str, target: str) -> None:
    image = codec.decode(Path(source).read_bytes())
    make = {".png": files.png, ".bmp": files.bmp, ".ppm": files.ppm}.get(Path(target).suffix.lower())
    if make is None:
        raise codec.BadFile("the output format is not supported")
    _save(target, make(image))


def info(source: str) -> str:
    data = Path(source).read_bytes()
    h = codec.header(data)
    frames = h.count if h.mode == codec.ANIM else 1
    return f"width={h.width} height={h.height} frames={frames} mode={h.mode} transform={h.transform} bytes={len(data)}"


def batch(spark: SparkSession, folder: str, target: str) -> pd.DataFrame:
    """Every picture of a folder as a container in another: path, status and bytes. Two that would write one file stop the run before it begins."""
    os.makedirs(target, exist_ok=True)
    found = files.scan(spark, folder).withColumn("image_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    images = files.decoded(found)
    good = images.filter("status = 'ok'").select("image_id", "width", "height", "rgba")
    written = files.write(files.encoded(good).select("image_id", "content"), target, "tsr").toPandas()
    bad = images.filter("status <> 'ok'").select("image_id", "status").toPandas()
    return pd.concat([written.assign(status="ok"), bad.rename(columns={"image_id": "path"}).assign(bytes=0)], ignore_index=True)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("pack", "unpack", "batch"):
        command = commands.add_parser(name)
        command.add_argument("source")
        command.add_argument("target")
    commands.add_parser("info").add_argument("source")
    given = parser.parse_args(args)
    try:
        if given.command == "pack":
            print(pack(given.source, given.target))
        elif given.command == "unpack":
            unpack(given.source, given.target)
        elif given.command == "info":
            print(info(given.source))
        else:
            done = batch(SparkSession.builder.getOrCreate(), given.source, given.target)
            print(done.to_string(index=False))
            return int((done.status != "ok").any())
    except (codec.BadFile, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
