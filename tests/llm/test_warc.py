import hashlib

from nimbusvec.llm import warc
from tests.helpers import same, sql

PAGES = "page_id long, url string, html string, digest string, payload string"
BIG = "ä" * 700


def pages(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], PAGES)


ROWS = [(1, "http://a/", BIG), (2, None, BIG), (3, "http://c/\r\nX: y", BIG), (4, "http://d/", "short"), (5, "http://e/", "short"), (6, "http://f/", None), (None, "http://g/", BIG), (7, "http://h/", "b" * 1000 + "\r\n\r\nx"), (7, "http://h/", "b" * 1000 + "\r\n\r\nx")]


def brute(rows):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        last = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = len(raw) >= 1000 and i != last
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def test_roundtrip(spark):
    got = warc.roundtrip(pages(spark, ROWS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ROWS)
    assert warc.roundtrip(pages(spark, [])).collect() == []


def test_payloads_are_stored_once_and_records_come_back(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(pages(spark, ROWS), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = warc.read_archive(spark, path)
    assert records.where("verified").count() == len(ROWS)
    assert {(r.page_id, bytes(r.payload)) for r in records.collect()} == {(i, (h or "").encode()) for i, _, h in ROWS}


def test_exported_files_parse(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(pages(spark, ROWS), path)
    warc.export_warc(warc.read_archive(spark, path), str(tmp_path / "out"))
    seen = []
    for f in sorted((tmp_path / "out").glob("part-*")):
        raw, at = f.read_bytes(), 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
            assert raw.startswith(b"WARC/1.1\r\n", at)
            block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
            at = end + 4 + len(block)
            assert raw[at : at + 4] == b"\r\n\r\n"
            at += 4
            if head["WARC-Type"] == "response":
                body = block.split(b"\r\n\r\n", 1)[1]
                assert head["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
            seen.append((head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To")))
    assert len(seen) == len(ROWS)
    assert {t for k, _, t in seen if k == "revisit"} <= {i for k, i, _ in seen if k == "response"}


def test_refers_to_comes_from_the_header(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(pages(spark, ROWS), path)
    headers = spark.read.parquet(f"{path}/headers")
    assert "refers_to" not in headers.columns
    ids = [r.id for r in headers.select(warc._field(headers.header, "WARC-Record-ID").alias("id")).collect()]
    assert len(set(ids)) == len(ROWS)
    # where the headers name another record, so does what is read
    other = next(i for i, r in zip(ids, headers.collect(), strict=True) if r.page_id == 4)
    headers.selectExpr("page_id", "digest", rf"encode(regexp_replace(decode(header, 'utf-8'), 'WARC-Refers-To: [^\\r\\n]*', 'WARC-Refers-To: {other}'), 'utf-8') AS header").write.parquet(f"{path}2/headers")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{path}2/payloads")
    assert {r.refers_to for r in warc.read_archive(spark, f"{path}2").collect()} == {None, 4}


def test_exported_files_are_read_back(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(pages(spark, [*ROWS, (9, "http://long/", "<p>\r\n\r\nWARC/1.1\r\n" * 100_000)]), path)
    for kind in ("none", "gzip"):
        warc.export_warc(warc.read_archive(spark, path), str(tmp_path / kind), kind)
        back = warc.import_warc(spark, str(tmp_path / kind)).collect()
        assert len(back) == len(ROWS) + 1 and max(len(r.payload) for r in back) == 1_700_000
        ids = {r.record_id: r for r in back}
        for r in back:
            assert len(ids) == len(back) and (r.refers_to is None) == (r.type == "response")
            if r.type == "response":
                assert r.digest == "sha1:" + hashlib.sha1(r.payload).hexdigest()
            else:
                assert ids[r.refers_to].digest == r.digest and not r.payload


def test_a_payload_of_most_rows(spark):
    rows = [(i, f"http://{i}/", None) for i in range(900)] + [(i, f"http://{i}/", BIG) for i in range(900, 1500)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.roundtrip(pages(spark, rows)).collect()}
    assert got == {i: ("response", None) if i < 900 or i == 1499 else ("revisit", 1499) for i in range(1500)}


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(pages(spark, ROWS[:1]), path)
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "sha1", "bytes", "copies", "encode('other', 'utf-8') AS payload").write.parquet(f"{path}/bad")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/b/headers")
    spark.read.parquet(f"{path}/bad").write.parquet(f"{path}/b/payloads")
    assert not warc.read_archive(spark, f"{path}/b").first().verified


def test_query_matches_its_sql(spark):
    from nimbusvec.llm import queries

    same(queries.op4_warc(spark, "/root/testdata/sf0.001").toPandas(), sql(queries.OP4_SQL))
