import gzip
import zlib
from hashlib import sha256

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeflow.llm import warc

SCHEMA = "page_id long, url string, html string, mark int, digest string, _salt int"
BIG, SAME = "<p>" + "ß word " * 40_000 + "</p>", "<html>" + "x" * 100 + "</html>"
ROWS = [
    (1, "http://a.example/", SAME), (2, "http://a.example/2", SAME), (9, None, SAME), (0, "http://a.example/\r\nX: y", SAME), (None, "u", SAME),
    (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", BIG), (8, "u", BIG), (10, "u", "é" * 49 + "a"), (11, "u", "é" * 49 + "a"), (12, "u", "é" * 50), (13, "u", "é" * 50),
    (20, "twice", "y" * 200), (20, "twice", "y" * 200), (21, "u", "y" * 200), (None, None, None), (None, "u", "z" * 150), (None, "u", "z" * 150),
]


def plain(rows):
    out, first = [], {}
    for k, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        if len(data) >= 100 and data in first:
            out.append((k, len(data), sha256(data).hexdigest(), "revisit", first[data]))
        else:
            first[data] = k
            out.append((k, len(data), sha256(data).hexdigest(), "response", None))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in ROWS], SCHEMA).repartition(4)


@pytest.mark.parametrize("few", [200_000, -1])
def test_pages_round_trip(spark, pages, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", few)
    warc.write_warc(warc.page_records(pages), str(tmp_path / "a"))
    assert sorted(str(tuple(r)) for r in warc.archived_pages(spark, str(tmp_path / "a")).collect()) == plain(ROWS)
    assert not (tmp_path / "a" / "_temporary").exists()


def test_sql_equals_plain():
    rows = [r for r in {r[0]: r for r in ROWS}.values() if r[0] is not None]
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [list(r) for r in rows])
    assert sorted(str(tuple(r)) for r in con.sql(warc.SQL).fetchall()) == plain(rows)


def test_no_pages(spark, pages, tmp_path):
    warc.write_warc(warc.page_records(pages.limit(0)), str(tmp_path / "none"))
    assert warc.archived_pages(spark, str(tmp_path / "none")).collect() == []


def raw(kind, n, payload, **more):
    return warc.record({"record_type": kind, "record_id": f"<urn:x:{n}>", "date": f"2020-01-0{n}T00:00:00Z", "target_uri": f"http://h{n}.example/", "payload": payload, **more})


def foreign(kinds):
    records = [raw("warcinfo", 1, b"software: none"), raw("response", 2, BIG.encode()), raw("request", 3, b"GET / HTTP/1.1\r\n\r\n", content_type="application/http;msgtype=request"), raw("revisit", 4, None, refers_to="<urn:x:2>"), raw("response", 5, b"last")]
    return {"plain": b"".join(records), "members": b"".join(warc.member(r, 6) for r in records), "unstated": b"".join(gzip.compress(r) for r in records), "one": gzip.compress(b"".join(records))}[kinds]


@pytest.mark.parametrize("kinds", ["plain", "members", "unstated", "one"])
def test_any_packing_reads_alike(spark, tmp_path, kinds):
    (tmp_path / ("x.warc" if kinds == "plain" else "x.warc.gz")).write_bytes(foreign(kinds))
    (tmp_path / "notes.txt").write_text("no archive")
    rows = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert [b"-" if (p := rows[f"<urn:x:{n}>"].payload) is None else bytes(p) for n in range(1, 6)] == [b"software: none", BIG.encode(), b"", b"-", b"last"]
    assert rows["<urn:x:4>"].refers_to == "<urn:x:2>" and rows["<urn:x:2>"].headers["warc-target-uri"] == "http://h2.example/"
    some = warc.read_warc(spark, str(tmp_path), "record_id string, content_length long")
    assert some.count() == 5 and some.filter("content_length > 1000").collect()[0].record_id == "<urn:x:2>"


@pytest.mark.parametrize("kinds", ["plain", "members", "unstated", "one"])
def test_unwanted_blocks_are_not_read(kinds):
    file = pa.BufferReader(foreign(kinds))
    stream = warc.Plain(file) if kinds == "plain" else warc.Inflated(file)
    rows = list(warc.archived(stream, lambda r: r["record_type"] == "revisit", True))
    assert [r["record_id"] for r in rows] == ["<urn:x:4>"]
    assert (stream.skipped > len(BIG) // 2) == (kinds in ("plain", "members"))


def test_filters_reach_the_headers(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(foreign("members"))
    df = warc.read_warc(spark, str(tmp_path))
    for sql, want in (("record_type = 'response'", [2, 5]), ("record_type IN ('revisit', 'warcinfo')", [1, 4]), ("NOT record_type = 'response' AND date > '2020-01-03T00:00:00Z'", [4]), ("target_uri LIKE 'http://h3%'", [3]), ("refers_to IS NOT NULL", [4]), ("refers_to <> 'x'", [4]), ("refers_to <=> NULL", [1, 2, 3, 5]), ("length(payload) = 4 AND content_length < 100", [5])):
        assert sorted(int(r.record_id[7:-1]) for r in df.filter(sql).collect()) == want, sql
    reader = warc.WarcReader(StructType.fromDDL(warc.COLUMNS), {"path": str(tmp_path)})
    kept = list(reader.pushFilters([ds.EqualTo(("record_type",), "revisit"), ds.EqualTo(("payload",), b""), ds.EqualTo(("headers", "x"), "y")]))
    assert [f.attribute for f in kept] == [("payload",), ("headers", "x")]
    assert [b.column("record_id").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [["<urn:x:4>"]]


def test_partitions_hold_whole_files(tmp_path):
    for k, n in enumerate((10, 10, 10, 50, 5)):
        (tmp_path / f"{k}.warc").write_bytes(b"x" * n)
    reader = warc.WarcReader(StructType.fromDDL("record_id string"), {"path": str(tmp_path), "split_bytes": "25"})
    assert [[p.rsplit("/", 1)[1][0] for p in f.paths] for f in reader.partitions()] == [["0", "1"], ["2"], ["3"], ["4"]]


def test_codings_of_the_body():
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    body = gzip.compress(b"hello world")
    parts = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (body[:7], body[7:])) + b"0\r\n\r\n"
    assert warc.entity(chunked + parts) == b"hello world"
    assert warc.entity(b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\n\r\n" + zlib.compress(b"abc")) == b"abc"


def test_broken_archives_are_errors():
    for data in (foreign("plain")[:-10], foreign("members")[:-10], b"no warc at all\r\n\r\n", foreign("plain")[:40]):
        stream = (warc.Inflated if data[:2] == b"\x1f\x8b" else warc.Plain)(pa.BufferReader(data))
        with pytest.raises(ValueError):
            list(warc.archived(stream, lambda r: True, True))
    for kinds, cut in (("plain", 10), ("members", 1)):
        data = foreign(kinds)[:-cut] if kinds == "plain" else b"".join(warc.member(r, 6) for r in [raw("response", 1, BIG.encode())])[:-cut]
        stream = (warc.Plain if kinds == "plain" else warc.Inflated)(pa.BufferReader(data))
        with pytest.raises(ValueError):  # also where what is cut would have been skipped
            list(warc.archived(stream, lambda r: False, True))


def test_files_end_at_the_split_size(spark, pages, tmp_path):
    warc.register(spark)
    records = warc.page_records(pages.filter(F.col("page_id") < 13)).coalesce(1)
    records.write.format("warc").option("split_bytes", 1000).mode("append").save(str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("*.warc.gz"))) > 3 and warc.archived_pages(spark, str(tmp_path / "s")).count() == 13
    records.limit(2).write.format("warc").mode("overwrite").save(str(tmp_path / "s"))
    assert warc.archived_pages(spark, str(tmp_path / "s")).count() == 2
