"""Stored tables: versions, replacement, failures; scans in file order; bodies
that cannot be read; the stream on a catalog that is replaced."""

import json
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from shortlist import schemas as S
from shortlist.operators.requests import BODY_ERROR, split_valid
from shortlist.plans.recommend import rejected_requests, shortlist
from shortlist.session import checkpoint_dir
from shortlist.sources import snapshots
from shortlist.sources import tables as src
from shortlist.streaming.requests_stream import epoch_versions, start_shortlist_stream


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="shortlist-snap-")


def models(df):
    return [r["model"] for r in df.orderBy("catalog_pos").select("model").collect()]


def test_a_failing_write_leaves_the_catalog_readable(spark, tables, folder):
    path, catalog = f"{folder}/catalog", tables.catalog()
    first = src.write_catalog(catalog, path)
    assert (first.version, first.rows) == (1, catalog.count())
    before = models(src.read_catalog(spark, path))
    broken = catalog.withColumn("model", F.when(F.col("catalog_pos") == 7, F.raise_error(F.lit("stop")))
                                .otherwise(F.col("model")))
    with pytest.raises(Exception, match="stop"):
        src.write_catalog(broken, path)
    assert models(src.read_catalog(spark, path)) == before
    assert snapshots.versions(spark, path) == [1]


def test_a_job_may_replace_the_catalog_that_it_reads(spark, tables, folder):
    path = f"{folder}/catalog"
    src.write_catalog(tables.catalog(), path)
    n = src.read_catalog(spark, path).count()
    cheap = src.read_catalog(spark, path).filter("catalog_pos > 50")
    kept = cheap.count()
    assert 0 < kept < n
    src.write_catalog(cheap, path, fmt="jsonl")  # the format belongs to the version
    assert src.read_catalog(spark, path).count() == kept
    assert src.read_catalog(spark, path, version=1).count() == n
    src.write_catalog(src.read_catalog(spark, path).limit(0), path)
    assert src.read_catalog(spark, path).count() == 0
    assert snapshots.expire(spark, path, keep=1) == [1, 2]
    assert snapshots.versions(spark, path) == [3] and src.read_catalog(spark, path).count() == 0
    with pytest.raises(ValueError, match="no version 1"):
        src.read_catalog(spark, path, version=1)


def test_commits_are_taken_once(spark, folder):
    path = f"{folder}/note.json"
    assert snapshots.record_once(spark, path, "é1") == "é1"
    assert snapshots.record_once(spark, path, "2") == "é1"
    assert os.listdir(folder) == ["note.json"] or set(os.listdir(folder)) == {"note.json", ".note.json.crc"}
    taken = snapshots.replace(spark.range(3), f"{folder}/t")
    assert not snapshots.put_if_absent(spark, f"{folder}/t/_commits/{1:010d}.json", "{}")
    assert snapshots.replace(spark.range(4), f"{folder}/t").version == taken.version + 1


def test_rows_lost_on_the_way_are_noticed(spark, folder, monkeypatch):
    snapshots.replace(spark.range(3), f"{folder}/t")
    monkeypatch.setattr(snapshots.Observation, "get", property(lambda self: {"rows": 5}))
    with pytest.raises(OSError, match="3 rows of 5"):
        snapshots.replace(spark.range(3), f"{folder}/t")
    assert snapshots.versions(spark, f"{folder}/t") == [1]


def hand_made(n, first=0):
    return [{"brand": "Nike", "model": f"M{i}", "category": ["daily", "easy"], "price_usd": 99.5 + i, "plate": "none",
             "drop_mm": 8.0, "weight_g": 240, "size_checked": "10", "available_for_size": i % 2 == 0,
             "sale_price_usd": 80.0} for i in range(first, first + n)]


def test_arrays_without_positions_are_numbered_in_file_order(spark, tables, folder):
    for name, rows in (("b.json", hand_made(5, 7)), ("a.json", hand_made(7)), ("c.json", [])):
        with open(f"{folder}/{name}", "w") as f:
            json.dump(rows, f, indent=2)
    catalog = src.read_catalog(spark, folder, fmt="json")
    rows = catalog.orderBy("catalog_pos").collect()
    assert [(r["catalog_pos"], r["model"]) for r in rows] == [(i + 1, f"M{i}") for i in range(12)]
    assert rows[2]["size_checked"] == "10" and rows[2]["available_for_size"] and rows[3]["sale_price_usd"] == 80.0
    best = shortlist(tables.requests(), catalog)
    assert best.count() > 0
    stored = f"{folder}/stored"
    src.write_catalog(catalog, stored)
    assert sorted(map(str, src.read_catalog(spark, stored).collect())) == sorted(map(str, rows))


def test_lines_and_columns_without_positions(spark, folder):
    with open(f"{folder}/x.jsonl", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in hand_made(3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:  # several splits of one file
        lines = src.read_catalog(spark, f"{folder}/x.jsonl", fmt="jsonl")
        assert lines.rdd.getNumPartitions() > 5
        assert [(r[0], r[1]) for r in lines.select("catalog_pos", "model").orderBy("catalog_pos").collect()] == \
            [(i + 1, f"M{i}") for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines.orderBy("catalog_pos").drop("catalog_pos").coalesce(1).write.parquet(f"{folder}/p")
    assert models(src.read_catalog(spark, f"{folder}/p")) == [f"M{i}" for i in range(3000)]


def test_positions_of_the_file_are_kept(spark, folder):
    rows = [{**r, "catalog_pos": 10 - i} for i, r in enumerate(hand_made(4))]
    with open(f"{folder}/a.json", "w") as f:
        json.dump(rows, f)
    assert {r["catalog_pos"] for r in src.read_catalog(spark, folder, fmt="json").collect()} == {10, 9, 8, 7}


def test_only_missing_and_malformed_sources_fall_back(spark, folder, monkeypatch):
    assert src.read_enhanced_catalog(spark, f"{folder}/none").count() == 0
    os.makedirs(f"{folder}/bad")
    with open(f"{folder}/bad/x.parquet", "w") as f:
        f.write("no parquet at all")
    assert src.read_enhanced_catalog(spark, f"{folder}/bad").count() == 0
    spark.createDataFrame([], S.ENHANCED_CATALOG).write.parquet(f"{folder}/good")

    def lost(*_):
        raise src.PySparkException("Lost task 3.0: ExecutorLostFailure")

    monkeypatch.setattr(src, "_scan", lost)
    with pytest.raises(src.PySparkException, match="ExecutorLost"):
        src.read_enhanced_catalog(spark, f"{folder}/good")


def test_unreadable_bodies_are_rejected_with_text_file_and_line(spark, folder):
    good = {"request_id": 1, "intended_use": {"easy_runs": True}, "cost_limiter": {"max_usd": 150.0}}
    lines = [json.dumps(good), "", "no json", json.dumps({**good, "request_id": 2, "num_recommendations": 99}),
             '{"request_id": 3, "cost_limiter": ', json.dumps({**good, "num_recommendations": "many"}), "[]"]
    with open(f"{folder}/r.jsonl", "w") as f:
        f.write("\n".join(lines) + "\n")
    requests = src.read_requests_json(spark, folder)
    valid, rejected = split_valid(requests)
    assert [r["request_id"] for r in valid.collect()] == [1] and "source" not in valid.columns
    out = {r["source"]["line"]: r for r in rejected.collect()}
    assert sorted(out) == [3, 4, 5, 6, 7]
    for line in (3, 5, 6, 7):
        assert out[line]["errors"] == [BODY_ERROR] and out[line]["source"]["text"] == lines[line - 1]
        assert out[line]["source"]["file"].endswith("r.jsonl")
    assert out[4]["request_id"] == 2 and out[4]["source"]["text"] is None and len(out[4]["errors"]) == 1
    column = spark.createDataFrame([(json.dumps(good),), ("x",), (None,), ("",)], "body string")
    assert rejected_requests(src.requests_from_json_column(column)).count() == 3


def _rows(df):
    return sorted(tuple(r) for r in df.select("request_id", "rank", "catalog_pos", "adjusted_score").collect())


def test_a_stream_follows_the_catalog_and_retries_on_the_noted_version(spark, tables):
    base = f"{checkpoint_dir(spark).rstrip('/')}/test-follow-{uuid.uuid4().hex}"
    incoming, sink, ckpt, path = (f"{base}/{x}" for x in ("requests", "out", "ckpt", "catalog"))
    requests, catalog = tables.requests(), tables.catalog()
    halves = [requests.filter(F.col("request_id") % 2 == k) for k in (0, 1)]

    def run():
        query = start_shortlist_stream(spark, incoming, sink, ckpt, path, None)
        query.awaitTermination()
        assert query.exception() is None

    src.write_catalog(catalog, path)
    halves[0].coalesce(1).write.mode("append").parquet(incoming)
    run()
    other = catalog.filter("catalog_pos % 3 != 0").withColumn("price_usd", F.col("price_usd") + 1)
    src.write_catalog(other, path)
    halves[1].coalesce(1).write.mode("append").parquet(incoming)
    run()
    out = spark.read.parquet(sink)
    first, second = sorted(r[0] for r in out.select("epoch").distinct().collect())
    assert _rows(out.filter(F.col("epoch") == first)) == _rows(shortlist(halves[0], catalog))
    assert _rows(out.filter(F.col("epoch") == second)) == _rows(shortlist(halves[1], other))
    # the last epoch is run again after its commit was lost, and the catalog has moved on
    src.write_catalog(catalog, path)
    os.replace(f"{ckpt}/commits/{second}", f"{base}/lost-commit")
    if os.path.exists(f"{ckpt}/commits/.{second}.crc"):
        os.replace(f"{ckpt}/commits/.{second}.crc", f"{base}/lost-commit-crc")
    run()
    assert epoch_versions(spark, ckpt, second, {"catalog": path}) == {"catalog": 2}
    again = spark.read.parquet(sink)
    assert _rows(again.filter(F.col("epoch") == second)) == _rows(shortlist(halves[1], other))
