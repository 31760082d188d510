"""Sources and sinks (S1-S5), the size-check branch (X16/X17), the
first-N limits (W8, W9), the unknown-price fallback (C8) and the nested
response (A10, T18)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from shortlist import schemas as S
from shortlist.operators import catalog as cat
from shortlist.operators import enrich as en
from shortlist.operators import response as resp
from shortlist.operators.candidates import market_flag
from shortlist.plans.recommend import shortlist
from shortlist.sources import tables as src
from shortlist.sources.views import (listing_anchors_view, product_pages_view, search_results_view)


def test_catalog_round_trip_and_enhanced_fallback(spark, tables):
    out = tempfile.mkdtemp(prefix="shortlist-io-")
    c = tables.catalog()
    src.write_catalog(c, f"{out}/catalog")
    back = src.read_catalog(spark, f"{out}/catalog")
    assert back.count() == c.count()
    src.write_catalog(c.limit(5), f"{out}/catalog_jsonl", fmt="jsonl")
    assert src.read_catalog(spark, f"{out}/catalog_jsonl", fmt="jsonl").count() == 5
    os.makedirs(f"{out}/array")
    with open(f"{out}/array/catalog.json", "w") as f:
        json.dump([{"catalog_pos": 0, "brand": "Acme", "model": "Strider", "category": ["tempo"], "price_usd": 99.5},
                   {"catalog_pos": 1, "brand": "Acme", "model": "Glider 2", "plate": "nylon", "weight_g": 240}], f)
    arr = src.read_catalog(spark, f"{out}/array", fmt="json").collect()
    assert [r["model"] for r in arr] == ["Strider", "Glider 2"]
    empty = src.read_enhanced_catalog(spark, f"{out}/does-not-exist")
    assert empty.count() == 0 and empty.schema == S.ENHANCED_CATALOG
    bad = f"{out}/half-broken"
    os.makedirs(bad)
    good = {"catalog_pos": 1, "brand": "Acme", "model": "Strider", "enhanced_data": {"popularity_score": 1.0}}
    for name, text in (("a.json", json.dumps([good])), ("z.json", '[{"catalog_pos": "not a number"')):
        with open(f"{bad}/{name}", "w") as f:
            f.write(text)
    assert src.read_enhanced_catalog(spark, bad, fmt="json").count() == 0
    assert spark.range(1).select(market_flag(en.market_from_enhanced(empty))).first()[0] is False


def test_request_json_source(spark):
    d = tempfile.mkdtemp(prefix="shortlist-req-")
    body = {"request_id": 7, "intended_use": {"easy_runs": True}, "cost_limiter": {"max_usd": 150.0}}
    with open(os.path.join(d, "r.json"), "w") as f:
        f.write(json.dumps(body) + "\n")
    r = src.read_requests_json(spark, d).first()
    assert r["request_id"] == 7 and r["intended_use"]["easy_runs"] is True
    col = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert src.requests_from_json_column(col).first()["cost_limiter"]["max_usd"] == 150.0


def test_size_branch_and_max_products(spark, tables):
    part = tables.raw("part")
    anchors, pages = listing_anchors_view(part), product_pages_view(part)
    sized = cat.build_catalog(anchors, pages, size="10")
    rows = sized.select("plate", "category", "size_checked", "available_for_size").collect()
    assert all(r["plate"] == "none" and list(r["category"]) == ["daily"] for r in rows)
    assert {r["size_checked"] for r in rows} == {"10"}
    assert any(r["available_for_size"] for r in rows) and not all(r["available_for_size"] for r in rows)
    limited = cat.build_catalog(anchors, pages, max_products=25)
    assert limited.count() <= 25
    first = cat.assemble_rows(cat.product_cards(anchors), pages).orderBy("page_no", "anchor_idx").limit(25)
    keys = {(r["brand"], r["model"]) for r in first.collect()}
    assert {(r["brand"], r["model"]) for r in limited.collect()} == keys


def test_enrich_max_items(spark, tables):
    part = tables.raw("part")
    e = en.enrich_catalog(tables.catalog(), search_results_view(part), product_pages_view(part), max_items=10)
    got = sorted(r["catalog_pos"] for r in e.collect())
    want = sorted(r["catalog_pos"] for r in tables.catalog().orderBy("catalog_pos").limit(10).collect())
    assert got == want


def test_unknown_price_scores_half(spark, tables):
    c = tables.catalog().withColumn("price_usd", F.when(F.col("catalog_pos") % 2 == 0, F.lit(None))
                                   .otherwise(F.col("price_usd")))
    out = shortlist(tables.requests(), c, tables.market(), with_tags=False)
    nulls = out.filter(F.col("price_usd").isNull()).select("original_score", "adjustment_multiplier").collect()
    assert nulls and all(r["original_score"] == 0.5 for r in nulls)


def test_nested_response(spark, tables):
    rows = shortlist(tables.requests(), tables.catalog(), tables.market(), with_tags=False)
    nested = resp.nested_response(tables.requests(), rows).collect()
    assert len(nested) == tables.requests().count()
    for r in nested:
        assert len(r["shortlist"]) <= r["inputs_echo"]["num_recommendations"]
        scores = [i["score"] for i in r["shortlist"]]
        assert all(0.0 <= s <= 1.0 for s in scores)
        assert r["notes"]


def test_first_n_distributed_equals_take_ordered(spark):
    from shortlist.operators.dedup import first_n
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"), "id")
    small = sorted(r["k"] for r in first_n(df, [F.col("k")], 1234).collect())
    big = sorted(r["k"] for r in first_n(df, [F.col("k")], 1234, take_ordered_max=10).collect())
    assert small == big == list(range(1234))


def test_market_from_enhanced_catalog(spark, tables):
    part = tables.raw("part")
    e = en.enrich_catalog(tables.catalog(), search_results_view(part), product_pages_view(part))
    m = en.market_from_enhanced(e)
    assert m.count() == tables.catalog().select("brand", "model").distinct().count()
    assert spark.range(1).select(market_flag(m)).first()[0] is True
    assert m.filter(F.col("review_count") > 0).count() > 0


def test_domain_lists(spark):
    from shortlist.operators.requests import domain_lists
    rows = domain_lists(spark).collect()
    assert [r["value"] for r in rows if r["list"] == "race_distance"] == S.RACE_DISTANCES
    assert [r["value"] for r in rows if r["list"] == "use_category"] == S.USE_CATEGORIES
