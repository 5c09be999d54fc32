from __future__ import annotations

import base64
import hashlib
import io

import pytest

from lattica.llm import warc


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


ROWS = [(4, "http://a/", "<html>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</html>"), (2, "http://b/\n?q", "same é\U0001f600"), (9, None, "same é\U0001f600"), (7, "u", "same é\U0001f600"), (5, "u", None), (6, "u", ""), (1, "u", "x" * 200_000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "y") for r in ROWS], "page_id long, url string, html string, d string").repartition(3)


def test_round_trip(pages, tmp_path):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, f"file://{tmp_path}/w").collect()}
    assert got == {k: (len((h or "").encode()), sha(h or ""), "revisit" if k in (7, 9, 6) else "response", {7: 2, 9: 2, 6: 5}.get(k)) for k, _, h in ROWS}


def test_least_payload(pages, tmp_path):
    warc.write_warc(pages, f"file://{tmp_path}/w", least=5)
    got = {r.page_id: r.record_type for r in warc.read_warc(pages.sparkSession, f"file://{tmp_path}/w").collect()}
    assert got[5] == got[6] == "response" and got[7] == got[9] == "revisit"


def test_many_revisits_join_by_shuffle(pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", -1)
    got = {r.page_id: r.refers_to for r in warc.round_trip(pages, f"file://{tmp_path}/w").collect()}
    assert got[7] == got[9] == 2 and got[6] == 5 and got[2] is None


def test_pushdown_and_skipped_payloads(pages, tmp_path):
    spark = pages.sparkSession
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, rows_per_file=2)
    some = warc.read_warc(spark, path).where("record_type = 'revisit'")
    assert sorted(r.page_id for r in some.collect()) == [6, 7, 9]
    assert [r.page_id for r in warc.read_warc(spark, path, record_types=("response",)).where("target_uri IN ('http://a/', 'none')").collect()] == [4]
    bare = warc.read_warc(spark, path, payload=False).collect()
    assert len(bare) == len(ROWS) and all(r.payload is None and r.read_digest is None for r in bare)
    assert {r.page_id: r.full_length for r in bare}[1] == 200_000
    assert {r.page_id: r.target_uri for r in bare}[2] == "http://b/ ?q" and {r.page_id: r.target_uri for r in bare}[9] == "urn:page:9"


def test_blocks_are_not_read_unless_wanted(spark, pages, tmp_path):
    warc.write_warc(pages.coalesce(1), f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part*"))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counted.taken += max(n, 0)
            return super().read(n)

        def peek(self):
            raise NotImplementedError

    assert len(list(warc.records(Counted(data), {}, False))) == len(ROWS) and Counted.taken == 0
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"junk\r\n\r\n"), {}, True))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc"), {}, True))


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, None, None), (None, "u", "a"), (3, "u", "a"), (3, "u", "a")], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.record_type, r.payload_bytes) for r in warc.round_trip(rows, f"file://{tmp_path}/w").collect())
    assert got == [(0, "response", 0), (0, "response", 1), (3, "response", 1), (3, "response", 1)]
    assert warc.round_trip(rows.where("page_id > 9"), f"file://{tmp_path}/e").count() == 0
