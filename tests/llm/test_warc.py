import gzip
import io
import json
import zlib

import pytest

from sparkloom.llm import warc as A


def monolith(records):
    return gzip.compress(b"".join(records))


def test_normaliser_round_trip_in_small_pieces():
    rs = [A.record(i, f"http://x/{i}?é", "response", (f"<p>{i}\r\n\r\n" * i).encode(), "d", None, "2024-01-01T00:00:00Z") for i in range(30)]
    raw = monolith(rs[:10]) + monolith(rs[10:])  # two members, as some writers append

    class Tiny(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    assert list(A.records(A.inflated(Tiny(raw)))) == rs
    fields, block = A.parse(rs[3])
    assert fields["x-page-id"] == "3" and block.partition(b"\r\n\r\n")[2] == b"<p>3\r\n\r\n" * 3
    with pytest.raises(ValueError):
        list(A.records([rs[0][:-20]]))


def test_archive(spark, tmp_path):
    long = "x" * 200
    rows = [(3, "http://a", long, "k"), (1, "http://b", long, "k"), (2, None, "short", "k"), (4, "u", "short", "k"), (5, "u", None, "k"), (None, "u", long, "k"), (None, "v", "z" * 150, "k"), (1, "http://b", long, "k"), (9, "é\r\nx: y", "é" * 60, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    files, folder = A.archive(df.repartition(3), f"{tmp_path}/w")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in A.read_back(files, folder).collect()), key=str)
    want = [("3", 200, "revisit", "1"), ("1", 200, "response", None), ("1", 200, "response", None), ("2", 5, "response", None), ("4", 5, "response", None), ("5", 0, "response", None), (None, 200, "revisit", "1"), (None, 150, "response", None), ("9", 120, "response", None)]
    assert got == sorted(want, key=str)
    for f in (tmp_path / "w" / "members").glob("*.gz"):
        data = f.read_bytes()
        for line in (f.parent / f"{f.name}.idx").read_text().splitlines():
            x = json.loads(line)
            z = zlib.decompressobj(31)
            raw = z.decompress(data[x["offset"] : x["offset"] + x["length"]])
            assert z.eof and not z.unused_data and raw.startswith(b"WARC/1.1")
    assert not (tmp_path / "w" / "whole").exists()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    files, folder = A.archive(df, f"{tmp_path}/w")
    assert A.read_back(files, folder).count() == 0


def test_inflates_in_bounded_pieces():
    raw = b"\0" * (5 * A.CHUNK + 17)
    pieces = list(A.inflated(io.BytesIO(gzip.compress(raw) + gzip.compress(b"end"))))
    assert max(map(len, pieces)) <= A.CHUNK and b"".join(pieces) == raw + b"end"
