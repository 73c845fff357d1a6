"""Round trips, pushed predicates, restarts, foreign archives and damage."""

import base64
import gzip
import hashlib
import os

import pytest

from brightweir.llm import warc
from brightweir.runtime import new_dir

from .helpers import rows

PAGES = "page_id bigint, url string, html string, sha string"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"http://x.example/{i}\r\nInjected: 1", h, "clash") for i, h in enumerate(htmls)], PAGES).repartition(3)


def written(spark, df, least=0):
    path = new_dir(spark, "warc-test")
    warc.write_warc(warc.page_records(df, least), path)
    return path


HTMLS = ["<p>one</p>", "", None, "<p>two</p>\r\n\r\n", "<p>one</p>", "é" * 70_000, "x", "x", "\r\n\r\nWARC/1.1"]


@pytest.mark.parametrize("least", [0, 5])
def test_every_page_comes_back(spark, least):
    got = warc.read_warc(spark, written(spark, pages(spark, *HTMLS), least), verify=True).where("record_type in ('response', 'revisit')")
    seen = {}
    expected = []
    for i, html in enumerate(HTMLS):
        payload = (html or "").encode()
        first = seen.setdefault(payload, i) if len(payload) >= least else i
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        back = f"urn:page:{first}" if first != i else None
        expected.append((f"urn:page:{i}", "revisit" if back else "response", digest, back, len(payload), None if back else payload))
    cols = ["record_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"]
    assert [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows(got.select(*cols))] == sorted(expected, key=repr)


def test_predicates_are_pushed_and_payloads_skipped(spark):
    df = warc.read_warc(spark, written(spark, pages(spark, *HTMLS)), payload=False)
    one = df.where("record_type = 'revisit' and refers_to in ('urn:page:0', 'urn:page:6') and record_id is not null")
    assert "Filter" not in one._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert sorted(r["record_id"] for r in one.collect()) == ["urn:page:4", "urn:page:7"]
    assert one.where("payload_bytes > 1").count() == 1
    assert df.where("payload is not null").count() == 0
    assert df.where("record_type = 'warcinfo'").count() >= 1
    assert df.where("target_uri like 'http://x.example/3%'").count() == 1


def test_files_are_cut_at_restarts(spark, monkeypatch):
    monkeypatch.setattr(warc, "RESTART_BYTES", 200)
    path = new_dir(spark, "warc-test")
    writer = warc.WarcWriter(path, False)
    import pyarrow as pa

    table = pa.table({"record_id": [f"r{i}" for i in range(50)], "record_type": ["response"] * 50, "payload": [os.urandom(300) for _ in range(50)]})
    writer.commit([writer.write(iter(table.to_batches())), None])
    reader = warc.WarcReader({"path": path, "partition_bytes": "1000"})
    parts = reader.partitions()
    assert len(parts) > 5
    assert sorted(r["record_id"] for p in parts for r in reader.records(p) if r["record_type"] == "response") == sorted(table["record_id"].to_pylist())
    again = warc.WarcReader({"path": path, "payload": "false"})
    assert [r["payload"] for p in again.partitions() for r in again.records(p)] == [None] * 51


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(spark, packed, tmp_path):
    rows_ = [{"record_id": f"r{i}", "record_type": "response", "payload": b"p" * i * 9000} for i in range(4)]
    records = [warc.info_record(), *map(warc.record_bytes, rows_)]
    name = tmp_path / ("a.warc.gz" if packed else "a.warc")
    name.write_bytes(b"".join(gzip.compress(r) if packed else r for r in records))
    got = warc.read_warc(spark, str(tmp_path), verify=True).where("record_type = 'response'")
    assert sorted((r["record_id"], len(r["payload"])) for r in got.collect()) == [(f"r{i}", 9000 * i) for i in range(4)]


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    record = warc.record_bytes({"record_id": "r", "record_type": "response", "payload": b"good"}).replace(b"good", b"evil")
    (tmp_path / "a.warc").write_bytes(record)
    assert warc.read_warc(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_warc(spark, str(tmp_path), verify=True).collect()


def test_no_pages_and_pages_without_id(spark):
    none = pages(spark, "a").where("false")
    assert warc.read_warc(spark, written(spark, none)).where("record_type = 'response'").count() == 0
    odd = spark.createDataFrame([(None, None, "a", ""), (5, None, "a", ""), (5, None, "a", "")], PAGES)
    got = warc.read_warc(spark, written(spark, odd)).where("record_type <> 'warcinfo'")
    got = got.select(warc.page_id_of("record_id").alias("id"), "record_type", warc.page_id_of("refers_to").alias("to"))
    assert rows(got) == sorted([(None, "revisit", 5), (5, "response", None), (5, "response", None)], key=repr)
