"""What the operators share: the shared folder, written tables and table reading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every operator's contract.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str | Column) -> DataFrame:
    """Some columns of a table; a column that the table lacks is an error."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and the session
    is local (tests) a temporary folder is made and set for it, and removed at exit; on a
    cluster, whose executors could not see it, a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base else "file://" + base.removeprefix("file:")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: lineage ends there and
    nothing above runs twice, whichever executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def store(uri: str):
    """The file system of a URI and the path in it, for files that tasks write and read themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, pieces) -> int:
    """Writes a file under a temporary name and renames it when complete, so that a reader never sees half
    a file and a task that runs twice leaves one. Returns its bytes."""
    files, path = store(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    size, temporary = 0, f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary, compression=None) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    files.move(temporary, path)
    return size
