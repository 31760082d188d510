"""The reference's engine checks, re-expressed on request tables, plus
plan properties (strategy equivalence, partitioning invariance)."""

import random

import pytest
from pyspark.sql import functions as F

from shortlist import schemas as S
from shortlist.functions import scoring as sc
from shortlist.functions import text as T
from shortlist.operators import response as resp
from shortlist.operators.bounds import BLOCK, block_rows, likely_pairs, price_edges, upper_bound, with_blocks
from shortlist.operators.candidates import candidate_pairs, market_flag, with_market
from shortlist.operators.requests import prepare_requests
from shortlist.plans.recommend import SCORING_COLS, scored_candidates, shortlist, shortlist_basic


def requests(spark, rows):
    """rows: (id, brands, easy, tempo, long, races, trail, enabled, max_usd, n)."""
    data = [(i, b, (e, t, lg, r, tr), (en, mx), n, True, None) for i, b, e, t, lg, r, tr, en, mx, n in rows]
    return spark.createDataFrame(data, S.REQUEST)


def test_reference_fixtures(spark, tables):
    reqs = requests(spark, [
        (1, ["Saucony", "Adidas"], True, True, False, ["half_marathon"], False, True, 180.0, 5),  # sample
        (2, None, False, False, False, ["5k"], False, True, 150.0, 5),                          # low budget
        (3, None, False, False, False, [], True, True, 50.0, 5),                                # impossible
        (4, None, True, False, False, [], False, True, 150.0, 5),                               # basic
    ])
    out = shortlist(reqs, tables.catalog(), tables.market())
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["request_id"], []).append(r)
    assert all(r["brand"] in ("Saucony", "Adidas") for r in by.get(1, []))
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert 3 not in by                                              # trail -> nothing
    for rid, items in by.items():
        ranked = sorted(items, key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
        assert all(a["adjusted_score"] >= b["adjusted_score"] for a, b in zip(ranked, ranked[1:]))
    notes = {r["request_id"]: list(r["notes"]) for r in resp.response_notes(reqs, out).collect()}
    assert notes[3] == [S.NO_MATCH_NOTE]
    over2 = sum(1 for r in by.get(2, []) if r["price_usd"] > 150.0)
    assert any("exceed your budget" in n for n in notes[2]) == (over2 > 0)


def test_basic_engine_checks(spark, tables):
    reqs = requests(spark, [
        (1, ["Saucony", "Adidas"], True, False, False, [], False, True, 200.0, 20),
        (2, None, True, False, False, [], False, True, 140.0, 20),
        (3, None, False, False, False, ["5k"], False, True, 250.0, 20),
        (4, None, False, False, False, ["marathon"], False, True, 200.0, 20),
    ])
    out = shortlist_basic(reqs, tables.catalog())
    rows = out.withColumn("why", T.rule_reasons_basic()).collect()
    assert all(r["brand"] in ("Saucony", "Adidas") for r in rows if r["request_id"] == 1)
    assert sum(1 for r in rows if r["request_id"] == 2 and r["price_usd"] > 140.0) <= 2
    assert all("race" in r["category"] for r in rows if r["request_id"] == 3)
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert all(("race" in r["why"].lower()) or ("speed" in r["why"].lower())
               for r in rows if r["request_id"] == 3)


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.select(*cols).collect())


def test_grid_join_equals_broadcast(spark, tables):
    reqs, cat, mk = tables.requests(), tables.catalog(), tables.market()
    a = shortlist(reqs, cat, mk, strategy="broadcast").drop("score_adjustments")
    b = shortlist(reqs, cat, mk, strategy="grid").drop("score_adjustments")
    assert _rows(a) == _rows(b)
    assert _rows(shortlist_basic(reqs, cat, strategy="broadcast")) == \
        _rows(shortlist_basic(reqs, cat, strategy="grid"))


def test_partitioning_does_not_change_results(spark, tables):
    reqs, cat, mk = tables.requests(), tables.catalog(), tables.market()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _rows(shortlist(reqs, cat, mk))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("shortlist.pairsPerTask", "5000")
        b = _rows(shortlist(reqs, cat, mk))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("shortlist.pairsPerTask")
    assert a == b


def test_over_budget_quota_first_two_in_catalog_order(spark):
    from shortlist.operators.ranking import over_budget_quota
    rows = [(5, True), (2, True), (9, False), (3, True), (7, True)]
    scored = spark.createDataFrame([(1, p, 0.5, over) for p, over in rows],
                                   "request_id long, catalog_pos long, score double, _over boolean")
    kept = sorted(r["catalog_pos"] for r in over_budget_quota(scored).collect())
    assert kept == [2, 3, 9]


@pytest.mark.parametrize("seed", [1])
def test_blocks_give_the_same_rows_as_all_pairs(spark, seed):
    """Random products and requests, with nulls, ties, odd weights."""
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.1 else x
    tags = ["daily", "easy", "tempo", "race", "long", "trail"]
    products = [(i, rng.choice(["Nike", "HOKA", "Brooks", "Acme"]), f"M{i // 2}", maybe(rng.sample(tags, rng.randint(0, 3))),
                 maybe(round(rng.uniform(40, 300), rng.choice([0, 2]))), maybe(rng.choice(["carbon", "nylon", "none", "pebax"])),
                 maybe(float(rng.randint(0, 13))), maybe(rng.randint(180, 380))) for i in range(400)]
    catalog = spark.createDataFrame(products, "catalog_pos bigint, brand string, model string, category array<string>, "
                                    "price_usd double, plate string, drop_mm double, weight_g int")
    weight = lambda: rng.choice([0.0, 0.5, 1.0, 2.5, 4.0, -1.0])
    asked = [(i, rng.choice([None, [], ["Nike"], ["HOKA", "Acme"]]),
              (rng.random() < .5, rng.random() < .5, rng.random() < .5, rng.choice([[], ["5k"]]), rng.random() < .05),
              (rng.random() < .7, rng.choice([60.0, 100.0, 150.5, 220.0])), rng.choice([None, 1, 3, 20]), maybe(rng.random() < .5),
              maybe(tuple(weight() for _ in range(6)))) for i in range(60)]
    requests = spark.createDataFrame(asked, S.REQUEST)
    rated = [(b, m, rng.choice([10, 60, 200]), rng.choice([3.9, 4.2, 4.9]), 1.0)
             for b, m in {(p[1], p[2]) for p in products} if rng.random() < .6]
    market = spark.createDataFrame(rated, "brand string, model string, review_count bigint, rating double, popularity_score double")
    cols = ["request_id", "rank", "catalog_pos", "adjusted_score", "original_score", "adjustment_multiplier"]
    for context in (market,):
        every, some = (sorted(map(tuple, shortlist(requests, catalog, context, strategy=s, with_tags=False).select(*cols)
                                  .collect())) for s in ("broadcast", "blocks"))
        assert every == some and len(every) > 100


def test_blocks_score_few_pairs(spark, tables):
    products = sc.product_features(with_market(tables.catalog().select(*SCORING_COLS), tables.market()))
    requests = sc.request_gates(prepare_requests(tables.requests()))
    flag = market_flag(tables.market())
    some = likely_pairs(requests, products, flag).select("request_id", "catalog_pos")
    every = candidate_pairs(requests, products).select("request_id", "catalog_pos")
    assert some.count() == some.distinct().count() < every.count()
    assert some.subtract(every).isEmpty()
    bound = upper_bound(candidate_pairs(requests, block_rows(with_blocks(products, price_edges(products)))), flag)
    pairs = sc.score_pairs(candidate_pairs(requests, with_blocks(products, price_edges(products))), flag)
    over = pairs.join(bound.select("request_id", *BLOCK, "bound"), ["request_id", *BLOCK]).filter("adjusted_score > bound")
    assert over.isEmpty()


def test_blocks_with_repeated_rows(spark, tables):
    """Requests and products that come twice."""
    reqs = tables.requests().filter("request_id < 40")
    twice = reqs.unionByName(reqs.filter("request_id % 3 = 0"))
    catalog = tables.catalog().unionByName(tables.catalog().filter("catalog_pos % 5 = 0"))
    cols = ["request_id", "rank", "catalog_pos", "adjusted_score", "original_score"]
    every, some = (sorted(map(tuple, shortlist(twice, catalog, tables.market(), strategy=s, with_tags=False).select(*cols)
                              .collect())) for s in ("broadcast", "blocks"))
    assert every == some and len(every) > 100


def test_products_that_score_alike_are_ranked_by_their_first_places(spark):
    """Three shoes, each 200 times in the catalog: a request's ranking sees no
    more rows than it wants, however many reach the same score."""
    products = [(n, "Brooks", f"M{n % 3}", ["daily"], 90.0 + n % 3, "none", 8.0, 260) for n in range(600)]
    catalog = spark.createDataFrame(products, "catalog_pos bigint, brand string, model string, category array<string>, "
                                    "price_usd double, plate string, drop_mm double, weight_g int")
    reqs = requests(spark, [(i, None, True, False, False, [], False, True, 150.0, n) for i, n in enumerate([1, 5, 20])])
    prepared = prepare_requests(reqs)
    scored = scored_candidates(reqs, catalog, None, "blocks", prepared=prepared)
    seen = {r["request_id"]: r["count"] for r in scored.groupBy("request_id").count().collect()}
    assert seen == {0: 1, 1: 5, 2: 20}
    every, some = (_rows(shortlist(reqs, catalog, None, strategy=s, with_tags=False)) for s in ("broadcast", "blocks"))
    assert every == some and len(every) == 26


def test_only_the_narrow_ranking_is_written(spark, tables, monkeypatch):
    """Of a shortlist that is read several times ids and scores go to disk, no
    product columns."""
    from shortlist.plans import recommend as plans
    cut, wrote = plans.cut_lineage, []
    monkeypatch.setattr(plans, "cut_lineage", lambda df: (wrote.append(df.columns), cut(df))[1])
    reqs = tables.requests().filter("request_id < 10")
    some = shortlist(reqs, tables.catalog(), tables.market(), with_tags=False, written=True)
    assert plans.recommend(reqs, tables.catalog(), tables.market()).count() == reqs.count()
    narrow = {"request_id", "catalog_pos", "rank", "original_score", "adjustment_multiplier", "adjusted_score"}
    assert [set(x) for x in wrote] == [narrow, narrow]
    assert _rows(some) == _rows(shortlist(reqs, tables.catalog(), tables.market(), with_tags=False))


def test_large_inputs_go_by_blocks(spark, tables):
    reqs = tables.requests().filter("request_id < 10")
    spark.conf.set("shortlist.blocks.minPairs", "1")
    try:
        some = shortlist(reqs, tables.catalog(), tables.market(), with_tags=False)
    finally:
        spark.conf.unset("shortlist.blocks.minPairs")
    assert "_score" in some._jdf.queryExecution().analyzed().toString()
    assert _rows(some) == _rows(shortlist(reqs, tables.catalog(), tables.market(), strategy="broadcast", with_tags=False))


@pytest.mark.parametrize("chunk", ["50000", "40"])
def test_reach_gives_the_same_rows_as_all_pairs(spark, chunk):
    """Random products and requests of the basic engine, with nulls, ties and
    prices at the budget; few products are left."""
    from shortlist.operators.reach import reachable
    rng = random.Random(5)
    maybe = lambda x: None if rng.random() < 0.1 else x
    tags = ["daily", "easy", "tempo", "race", "long", "trail"]
    products = [(i * 7 % 1501, maybe(rng.choice(["Nike", "HOKA", "Brooks"])), f"M{i // 2}", maybe([rng.choice(tags)]),
                 maybe(rng.choice([round(rng.uniform(40, 300), 0), 100.0, float("nan")])),
                 rng.choice(["carbon", "none"]), 8.0, maybe(rng.choice([0, 190, 210, 260]))) for i in range(1500)]
    catalog = spark.createDataFrame(products, "catalog_pos bigint, brand string, model string, category array<string>, "
                                    "price_usd double, plate string, drop_mm double, weight_g int")
    asked = [(i % 55, rng.choice([None, [], ["Nike"], ["HOKA", "Brooks"]]),
              (rng.random() < .5, rng.random() < .5, rng.random() < .5, rng.choice([[], ["5k"]]), rng.random() < .05),
              (rng.random() < .7, rng.choice([45.0, 60.0, 100.0, 150.5, 220.0])), rng.choice([None, 1, 3, 20]), True, None)
             for i in range(60)]
    requests = spark.createDataFrame(asked, S.REQUEST)
    cols = ["request_id", "rank", "catalog_pos", "price_usd", "score"]
    spark.conf.set("shortlist.offersPerChunk", chunk)
    try:
        every, some = (sorted(map(str, shortlist_basic(requests, catalog, strategy=s).select(*cols).collect()))
                       for s in ("broadcast", "reach"))
        left = reachable(sc.product_features(catalog)).filter("_any").count()
    finally:
        spark.conf.unset("shortlist.offersPerChunk")
    assert every == some and len(every) > 300
    assert 0 < left < 1000
