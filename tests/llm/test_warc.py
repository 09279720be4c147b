import base64
import hashlib

import pytest

from skyweft.llm import queries, warc


def brute(rows, least=0):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, u, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and p != f
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a", "same"), (3, "http://b\r\nX: y", "same"), (9, None, "same"), (1, "http://é", None), (2, "u", ""),
    (None, "n", "same"), (7, "long", "é" * 5000), (8, "long2", "é" * 5000), (7, "rep", "abc"), (7, "rep", "abc"), (11, "x", "q" * 64), (12, "y", "q" * 65),
]


@pytest.mark.parametrize("least", [0, 5])
def test_records_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame([(*r, "clash", True) for r in ROWS], "page_id long, url string, html string, digest string, last boolean")
    warc.write_archives(pages, str(tmp_path / "w"), least, chunk_bytes=64)
    got = warc.read_archives(spark, str(tmp_path / "w")).drop("url")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS, least)


def test_joined_chunks_are_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 200)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), chunk_bytes=64)
    rows = spark.read.parquet(str(tmp_path / "w")).orderBy("record", "chunk").collect()
    data = b"".join(bytes(r["data"]) for r in rows)
    assert len(rows) == 4 and data.startswith(b"WARC/1.1\r\n") and data.endswith(b"x" * 200 + b"\r\n\r\n")


def test_damage_raises(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a", "x" * 200)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), chunk_bytes=64)
    rows = spark.read.parquet(str(tmp_path / "w")).where("chunk < 3 or not last")
    rows.withColumn("data", F.expr("if(chunk = 1, cast(repeat('y', 64) as binary), data)")).write.partitionBy("oversized").parquet(str(tmp_path / "v"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, str(tmp_path / "v")).collect()


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op3_warc_archive(spark, sf).collect()), key=repr) == brute(rows)
