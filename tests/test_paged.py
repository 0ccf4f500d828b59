"""The paged source: planned ranges, ends of lists, live clients and streams."""

from __future__ import annotations

import json
import urllib.parse

import pytest

from tallylake.sources import paged, views
from tallylake.specs import spec

ROWS = [{"product_id": str(n), "unit_price": 1.5} for n in range(6)]


def land(root, name, offset, records, more, **header):
    folder = root / f"list={urllib.parse.quote(name, safe='')}" / f"offset={offset}"
    folder.mkdir(parents=True, exist_ok=True)
    envelope = {"data": records, "metadata": {}, "pagination": {"offset": offset, "has_more": more, **header}}
    (folder / "page.json").write_text(json.dumps(envelope))


@pytest.fixture(scope="module")
def record(spark):
    return spec("products").schema


def ids(rows):
    return sorted(r.product_id for r in rows.collect())


def test_a_list_ends_at_its_last_or_at_an_empty_page(spark, record, tmp_path):
    for offset, records, more in ((0, ROWS[:2], True), (2, ROWS[2:4], True), (4, ROWS[4:5], False), (6, ROWS[5:], False)):
        land(tmp_path / "full", "t/e", offset, records, more)
    got = paged.paged_source_read(spark, str(tmp_path / "full"), record, pagesPerTask="2")
    assert ids(got) == ["0", "1", "2", "3", "4"] and got.rdd.getNumPartitions() == 2
    assert got.schema["unit_price"].dataType.simpleString() == "decimal(18,4)"
    land(tmp_path / "empty", "t/e", 0, ROWS[:2], True, record_count=2)
    land(tmp_path / "empty", "t/e", 2, [], True, record_count=0)
    land(tmp_path / "empty", "t/e", 4, ROWS[4:5], False, record_count=1)
    land(tmp_path / "empty", "u/e", 0, ROWS[5:], False)
    assert ids(paged.paged_source_read(spark, str(tmp_path / "empty"), record)) == ["0", "1", "5"]
    assert paged.paged_source_read(spark, str(tmp_path / "none"), record).isEmpty()


def test_changed_since(spark, record, tmp_path):
    land(tmp_path, "t/e", 0, [{"product_id": "a", "updated_at": "2024-01-01"}, {"product_id": "b", "updated_at": "2024-03-01"}], False)
    assert ids(paged.paged_source_read(spark, str(tmp_path), record, since="2024-02-01")) == ["b"]


def test_writer_round_trip_in_one_scan(spark, sf, tmp_path):
    products = views.products(spark, sf)
    paged.paged_source_write(products, str(tmp_path / "p"), "product", 7, ["product_id"])
    back = paged.paged_source_read(spark, str(tmp_path / "p"), products.schema)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Exchange" not in plan and "Join" not in plan
    assert back.exceptAll(products).count() == 0 and back.count() == products.count()


@pytest.mark.parametrize("size, later", [(0, 0), (1, 0), (10, 0), (11, 0), (95, 0), (95, 23), (0, 5)])
def test_a_live_list_is_probed_and_read_to_its_end(spark, record, size, later):
    options = {"client": "tests.page_shop:Shop", "limit": "10", "size": str(size), "later": str(later), "pagesPerTask": "3"}
    got = ids(paged.paged_source_read(spark, None, record, **options))
    assert got == [f"{name}-{n:04d}" for name in ("one", "two") for n in range(size + later)]


def test_probing_asks_for_few_headers():
    asked = []

    def header(offset):
        asked.append(offset)
        return {"record_count": int(offset < 123_456)}

    assert paged.probed_offsets(header, 200)[-1] == 123_400 and len(asked) < 40


def test_stream_reads_every_page_once(spark, record, tmp_path):
    def run():
        stream = paged.paged_source_stream(spark, str(tmp_path / "in"), record)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True).start().awaitTermination()
        return ids(spark.read.schema(record).parquet(str(tmp_path / "out")))

    land(tmp_path / "in", "t/e", 0, ROWS[:2], True)
    land(tmp_path / "in", "u/e", 0, ROWS[2:3], True)
    assert run() == ["0", "1", "2"]
    land(tmp_path / "in", "t/e", 2, ROWS[3:5], True)
    land(tmp_path / "in", "u/e", 1, ROWS[5:], True)
    assert run() == ["0", "1", "2", "3", "4", "5"] and run() == ["0", "1", "2", "3", "4", "5"]
