import base64
import hashlib
import io
import zlib

import pytest

from tidemark.llm import warc
from tidemark.llm.queries import op2_warc


def expected(rows):
    top = {}
    for page, html in rows:
        key = (html or "").encode()
        top[key] = max(top.get(key, (False, 0)), (page is not None, page or 0))
    out, done = [], set()
    for page, html in rows:
        key = (html or "").encode()
        first = top[key] == (page is not None, page or 0) and key not in done
        if first:
            done.add(key)
        out.append((page, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "response" if first else "revisit", None if first or not top[key][0] else top[key][1]))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    assert sorted((tuple(r) for r in op2_warc(spark, sf_dir).collect()), key=str) == expected(rows)


PAGES = [(1, "u", "same"), (2, None, "same"), (3, "x\r\nWARC-Type: revisit", "other"), (4, "u", None), (5, "u", ""), (5, "u", ""), (6, "ü", "ß" * 100_000), (None, "u", "same"), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "other")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, sha1 string").repartition(3)
    back = warc.round_trip(spark, df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in back.collect()), key=str) == expected([(p, h) for p, _, h in PAGES])
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_least_size_of_revisits(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(df, least_bytes=5)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_several_archives_and_payloads(spark):
    df = spark.createDataFrame([(i, "u", "page %d " % i * 500) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(df, archive_bytes=2000)
    assert archives.count() > 1 and sum(r.n_records for r in archives.collect()) == 40
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(archives, keep_payload=True).collect()} == {i: "page %d " % i * 500 for i in range(40)}


class Trickle(io.BytesIO):
    """Reads of a few bytes, as from a slow stream."""

    def read(self, n=-1):
        return super().read(min(7, n) if n > 0 else n)


def test_reader_takes_any_pieces_and_finds_damage():
    one = warc.record(1, "http://a", b"payload " * 50, warc.digest(b"payload " * 50))
    two = warc.record(2, "http://b", b"", warc.digest(b""))
    got = list(warc.records(Trickle(one + two)))
    assert [(r.headers["warc-record-id"], r.length, r.problems) for r in got] == [("<urn:page:1>", 400, []), ("<urn:page:2>", 0, [])]
    bad = list(warc.records(io.BytesIO(warc.record(1, "u", b"payload", warc.digest(b"other")))))
    assert bad[0].problems == ["digest mismatch"]
    text = zlib.decompress(one, 31).replace(b"Content-Length: 400", b"Content-Length: 401")
    pack = zlib.compressobj(wbits=31)
    assert "Content-Length does not frame the record" in next(warc.records(io.BytesIO(pack.compress(text) + pack.flush()))).problems
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(one[:-9])))
