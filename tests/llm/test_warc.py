"""WARC archives: an exact round trip, and the same bytes whatever the tasks."""

import gzip
import hashlib

import pytest

from tessera.llm import warc
from tessera.llm.common import store

HTML = [None, "", "x" * 99, "x" * 99, "é" * 50, "é" * 50, "é" * 50, "\r\n\r\nWARC/1.1\r\n" * 20, "a" * 300_000, "a" * 300_000] + [f"<p>{i % 9}</p>" * 40 for i in range(60)]


def table(spark):
    rows = [(i * 37 % 101, f"http://a/{i}\r\nX: y é" if i % 5 else None, h, 1) for i, h in enumerate(HTML)]
    rows += [(None, "http://n/", "é" * 50, 1), (0, "http://again/", "other", 1), (500, "http://t/", "t" * 100, 1), (500, "http://t/", "t" * 100, 1), (501, "u", "t" * 100, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int").repartition(3)


def want(rows):
    data = [(r.page_id, (r.html or "").encode()) for r in rows]
    first = {}
    for page, payload in data:
        if page is not None and len(payload) >= 100:
            first[payload] = min(first.get(payload, page), page)
    out = []
    for page, payload in data:
        to = first.get(payload, page) if page is not None else page
        to = None if to == page else to
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(map(str, out))


@pytest.mark.parametrize("roll", [1, 2000, 64 << 20])
def test_round_trip(spark, roll):
    manifest = warc.write(table(spark), roll=roll)
    assert sorted(str(tuple(r)) for r in warc.read(manifest).collect()) == want(table(spark).collect())
    files = sorted((r.file.rpartition("/")[2], r.sha256) for r in manifest.collect())
    again = sorted((r.file.rpartition("/")[2], r.sha256) for r in warc.write(table(spark).repartition(7), roll=roll).collect())
    assert files == again
    data = b""
    for r in sorted(manifest.collect(), key=lambda r: r.file):
        files, path = store(r.file)
        data += gzip.decompress(files.open_input_stream(path, compression=None).read())
    assert data.count(b"WARC-Type: ") == table(spark).count() and b"\nX: y" not in data


def test_a_changed_file_is_an_error(spark):
    manifest = warc.write(table(spark))
    files, path = store(manifest.first().file)
    data = files.open_input_stream(path, compression=None).read()
    with files.open_output_stream(path, compression=None) as out:
        out.write(data[:-30])
    with pytest.raises(Exception, match="ends within|whole|names|incorrect|Error"):
        warc.read(manifest).collect()


def test_empty_table(spark):
    assert warc.read(warc.write(table(spark).limit(0))).count() == 0
