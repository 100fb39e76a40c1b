import duckdb

from quillon.llm import warc


def test_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(c.sql(warc.OP8_SQL).fetchall())
    got = sorted(tuple(r) for r in warc.op8_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "u", big), (2, "u", big), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (None, "u", big), (2, "u", big)]
    p = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int")
    path = str(tmp_path / "warc")
    warc.write_archives(p, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.kind): r for r in got}
    assert bytes(by["2", "response"].payload).decode() == big
    assert by["1", "revisit"].refers_to == "2" and by["1", "revisit"].payload is None and by["1", "revisit"].payload_bytes == len(big.encode())
    assert by[None, "revisit"].refers_to == "2"
    assert by["5", "response"].payload_bytes == by["6", "response"].payload_bytes == 999
    assert by["3", "response"].payload_bytes == 0 and sum(r.kind == "response" and r.page_id == "2" for r in got) == 2


def test_empty(spark, tmp_path):
    p = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(p, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).collect() == []


def test_chunked():
    for n in (0, 1, 4095, 4096, 4097, 20000):
        body = bytes(i % 251 for i in range(n))
        assert warc.decode_chunked(warc.frame_chunked(body)) == body
        assert warc.http_payload(warc.http_block(body)) == body
