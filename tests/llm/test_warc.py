import base64
import hashlib

import pytest

from reelmill.llm import warc
from reelmill.llm.queries import op9_warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(pages, least=0):
    groups = {}
    for page, html in pages:
        groups.setdefault((html or "").encode(), []).append(page)
    out = {}
    for page, html in pages:
        raw = (html or "").encode()
        last = max(groups[raw])
        revisit = len(raw) >= least and page != last
        out[page] = (len(raw), digest(raw), "revisit" if revisit else "response", last if revisit else None)
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op9_warc(spark, sf).collect()}
    assert got == expected(pages)


def test_same_as_sql(spark):
    import duckdb

    from reelmill.llm.queries import ORACLE

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet' UNION ALL SELECT 1000, 'u', html FROM '{sf}/pages.parquet' WHERE page_id < 3")
    rows = con.execute(ORACLE["op9_warc"]).fetchall()
    pages = con.execute("SELECT page_id, html FROM pages").fetchall()
    assert {r[0]: tuple(r[1:]) for r in rows if r[0] != 1000} == {k: v for k, v in expected(pages).items() if k != 1000}


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least, monkeypatch):
    pages = [(i, t) for i, t in enumerate(["", None, "a", "a", "long é page" * 50, "long é page" * 50, "\r\n\r\nWARC/1.1\r\n\r\n", "x" * 300000])]
    pages += [(100 + i, "hot payload") for i in range(400)]
    df = spark.createDataFrame([(p, f"http://x/{p}\r\n q" if p % 2 else None, h, b"?") for p, h in pages], "page_id long, url string, html string, sha1 binary")
    manifest = warc.write_archives(df, str(tmp_path / "out"), least)
    rows = warc.read_archives(manifest).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected(pages, least)
    text = dict(pages)
    for r in rows:
        assert (r.payload is None) if r.record_type == "revisit" else (bytes(r.payload) == (text[r.page_id] or "").encode())
        assert (r.url is None) == (r.page_id % 2 == 0)
    assert manifest.selectExpr("sum(records)").first()[0] == len(pages)


def test_each_record_can_be_read_alone(tmp_path):
    records = [warc.make_record(i, None, f"<html>page {i} of the same site</html>".encode() * 40, None, "D") for i in range(900)]
    (archive,) = warc.write_records(iter(records), str(tmp_path))
    assert list(warc.frames(str(tmp_path), archive.name)) == records
    assert (tmp_path / archive.name).read_bytes()[:4] == warc.DICTIONARY_MAGIC
    assert archive.stored < 0.2 * archive.raw


def test_archives_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    monkeypatch.setattr(warc, "TRAINING_BYTES", 1000)
    records = [warc.make_record(i, "u", b"x" * 100, None, "D") for i in range(100)]
    made = list(warc.write_records(iter(records), str(tmp_path)))
    assert len(made) > 3 and [r for a in made for r in warc.frames(str(tmp_path), a.name)] == records


def test_damage_is_an_error(tmp_path):
    record = warc.make_record(1, None, b"abc", None, digest(b"abc"))
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc", b"abd"))


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, None, "a"), (3, None, "a"), (3, None, "a"), (None, None, "b")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(df, str(tmp_path / "o"))).collect()
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows)
    assert got == [(0, "response", 0), (0, "revisit", 3), (3, "response", 0), (3, "response", 0)]
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0
