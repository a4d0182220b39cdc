import gzip
import hashlib
import os

from pyspark.sql import functions as F

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, id int"


def pages():
    body = "x" * 1500
    out = [(i, f"http://e/{i}", f"<p>page {i} é漢</p>" * (i % 50), "p", 0) for i in range(120)]
    out += [(200 + i, "http://copy\r\nX: y", body, "p", 0) for i in range(30)] + [(300, None, None, None, None), (301, "u", "", "p", 0), (302, "u", "small", "p", 0), (303, "u", "small", "p", 0)]
    out += [(None, "u", body, "p", 0), (229, "tie", body, "p", 0), (400, "big", "\r\n\r\nWARC/1.1\r\n" * 40_000, "p", 0), (401, "edge", "y" * 999, "p", 0), (402, "edge", "y" * 999, "p", 0)]
    return out


def expected():
    out, keeper = [], {}
    full = [(i, (h or "").encode()) for i, _, h, *_ in pages()]
    for i, b in full:
        if len(b) >= 1000:
            keeper[b] = max(keeper.get(b, -1), -1 if i is None else i)
    for i, b in full:
        again = len(b) >= 1000 and keeper[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keeper[b] if again else None))
    return sorted(out, key=str)


def table(spark, path):
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    return warc.read(spark, path).select(page("record_id").alias("p"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("n"), F.coalesce(F.sha1("payload"), "payload_digest").alias("d"), "record_type", page("refers_to").alias("r"))


def test_round_trip(spark, tmp_path):
    path = f"file:{tmp_path}/a"
    warc.archive(spark.createDataFrame(pages(), SCHEMA).repartition(6), path)
    assert sorted(map(tuple, table(spark, path).collect()), key=str) == expected()


def test_splits_and_leftovers(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a"
    writer = warc.WarcWriter({"path": path}, False)
    rows = [dict(record_id=f"urn:page:{i}", record_type="response", target_uri="u", date="d", payload_digest="0", payload_length=5000, payload=os.urandom(5000), refers_to=None) for i in range(40)]
    import pyarrow as pa

    monkeypatch.setattr(warc, "SPLIT", 30_000)
    monkeypatch.setattr(warc, "FILE_BYTES", 120_000)
    message = writer.write(iter([pa.RecordBatch.from_pylist(rows)]))
    writer.write(iter([pa.RecordBatch.from_pylist(rows[:3])]))  # an attempt that never commits
    writer.commit([message, None])
    source = warc.WarcSource({"path": path})
    from pyspark.sql.types import _parse_datatype_string

    reader = source.reader(_parse_datatype_string(source.schema()))
    parts = reader.partitions()
    assert len(parts) > 4 and len({p.path for p in parts}) == 2
    ids = [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert ids == [r["record_id"] for r in rows]


def test_pushed_filters_skip_payloads(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a"
    warc.archive(spark.createDataFrame(pages(), SCHEMA), path)
    got = warc.read(spark, path)
    plan = got.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (record_type" not in plan.replace("isnotnull(record_type) AND ", "")
    assert got.filter("record_type = 'revisit'").count() == 30
    assert got.filter("target_uri = 'tie' AND content_length > 10").select("record_id").collect()[0][0] == "urn:page:229"
    assert got.filter("target_uri IS NULL").count() == 1 and got.filter("target_uri LIKE 'http://e/1%'").count() == 31
    assert got.filter("record_type <> 'response' AND payload_length >= 1500").count() == 30 and got.filter("record_id IN ('urn:page:1', 'urn:page:2')").count() == 2
    assert "payload" not in warc.read(spark, path, payload=False).columns
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import _parse_datatype_string

    source = warc.WarcSource({"path": path})
    reader = source.reader(_parse_datatype_string(source.schema()))
    assert list(reader.pushFilters([EqualTo(("record_type",), "metadata"), EqualTo(("payload",), b"")])) == [EqualTo(("payload",), b"")]
    monkeypatch.setattr(warc, "payload_of", None)  # would fail if a payload were decoded
    assert [b for p in reader.partitions() for b in reader.read(p)] == []


def test_foreign_archives(spark, tmp_path):
    """Plain files, and gzip members without the length field; other record types keep their whole block."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"
    page = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:r>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello!\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + page + info)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(page) + gzip.compress(info) + gzip.compress(page))
    got = warc.read(spark, str(tmp_path))
    assert sorted((r.record_id, bytes(r.payload)) for r in got.collect()) == sorted([("urn:i", b"software:")] * 3 + [("urn:r", b"hello!")] * 3)
    assert got.filter("record_type = 'warcinfo'").count() == 3


def test_empty_table(spark, tmp_path):
    warc.archive(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert warc.read(spark, f"{tmp_path}/a").count() == 0
