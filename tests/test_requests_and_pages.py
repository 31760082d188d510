"""Hand-computed cases of request validation, pages, links and limits."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shortlist import schemas as S
from shortlist.functions import extract as X
from shortlist.operators import catalog as cat
from shortlist.operators import enrich as en
from shortlist.operators.prompts import technical_lookup, web_context
from shortlist.plans.recommend import recommend, rejected_requests, shortlist, shortlist_basic
from shortlist.session import checkpoint_dir
from shortlist.sources import tables as src
from shortlist.sources.views import listing_anchors_view, product_pages_view, search_results_view, tech_lookups_view


def request(rid, max_usd=150.0, n=3, limiter=True, use=True):
    return (rid, None, (True, False, False, [], False) if use else None, (True, max_usd) if limiter else None, n, True,
            None)


@pytest.fixture
def requests(spark):
    rows = [request(1), request(2, max_usd=0.0), request(3, limiter=False), request(4, n=25), request(5, use=False),
            request(6, n=20)]
    return spark.createDataFrame(rows, S.REQUEST)


def test_invalid_requests_are_rejected_and_stop_no_other(requests, tables):
    catalog = tables.catalog()
    for rows in (shortlist(requests, catalog, tables.market()), shortlist_basic(requests, catalog),
                 recommend(requests, catalog)):
        assert {r["request_id"] for r in rows.collect()} == {1, 6}
    errors = {r["request_id"]: r["errors"] for r in rejected_requests(requests).collect()}
    assert errors == {2: ["cost_limiter.max_usd: must be greater than 0"], 3: ["cost_limiter: field required"],
                      4: ["num_recommendations: must be between 1 and 20"], 5: ["intended_use: field required"]}


def test_no_nested_loop_in_the_pair_join(requests, tables):
    for df in (shortlist(requests, tables.catalog(), tables.market()), shortlist_basic(requests, tables.catalog())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_pair_join_equals_the_filters(spark, tables):
    """The keyed join against the plain predicates, nulls included."""
    from shortlist.functions import scoring as sc
    from shortlist.functions.predicates import basic_ok, enhanced_ok
    from shortlist.operators.candidates import candidate_pairs
    from shortlist.operators.requests import prepare_requests
    rows = []
    for i in range(64):
        use = (bool(i & 1), bool(i & 2), bool(i & 4), ["5k"] if i & 8 else [], bool(i & 16))
        prefs = [None, [], ["Brooks"], ["Hoka", "Brooks", "Hoka"], [None], ["Nobody"]][i % 6]
        rows.append((i, prefs, use, (bool(i & 32), 140.0), 5, i % 3 != 0, None))
    reqs = prepare_requests(spark.createDataFrame(rows, S.REQUEST))
    cols = ["catalog_pos", "brand", "model", "category", "price_usd", "plate", "drop_mm", "weight_g"]
    products = tables.catalog().select(*cols).limit(60)
    odd = products.limit(4).withColumns({"catalog_pos": F.col("catalog_pos") + 10_000,
                                         "brand": F.lit(None).cast("string"),
                                         "category": F.when(F.col("catalog_pos") % 2 == 0, F.array().cast("array<string>"))})
    products = sc.product_features(products.unionByName(odd))
    for enhanced, ok in ((True, enhanced_ok()), (False, basic_ok())):
        want = sorted(map(tuple, reqs.crossJoin(products).filter(ok).select("request_id", "catalog_pos").collect()))
        for strategy in ("broadcast", "grid"):
            got = candidate_pairs(reqs, products, enhanced, strategy).select("request_id", "catalog_pos")
            assert sorted(map(tuple, got.collect())) == want


HITS = "catalog_pos bigint, pos int, url string, content string"


def test_web_context_takes_the_first_hits_whatever_their_positions(spark):
    rows = spark.createDataFrame([(1, 1, 7)], "request_id bigint, rank int, catalog_pos bigint")
    hits = spark.createDataFrame([(7, 2, "u2", " two\nlines "), (7, 5, "u5", "five"), (7, 9, "u9", "nine")], HITS)
    for limit, sources in ((1, ["u2"]), (2, ["u2", "u5"])):
        out = web_context(rows, hits, limit=limit).first()
        assert out["sources"] == sources and out["summaries"][0] == "two lines"


def test_page_match_looks_at_product_links_only(spark):
    catalog = spark.createDataFrame([(1, "Brooks", "Ghost")], "catalog_pos bigint, brand string, model string")
    found = spark.createDataFrame(
        [(1, 1, "https://x/blog/brooks-ghost", "Brooks Ghost"), (1, 2, "https://x/product/brooks-ghost", "brooks ghost 16")],
        "query_pos bigint, pos int, href string, link_text string")
    assert en.page_match(catalog, found).first()["href"] == "https://x/product/brooks-ghost"


PAGE = "url string, body_text string, price_texts array<string>"
CARD = "page_no bigint, anchor_idx int, canonical string, title string, brand string, model string, product_url string"


def test_absolute_links_keep_price_and_specs_and_pages_count_once(spark):
    url = "https://shop.example.com/product/brooks-ghost"
    cards = spark.createDataFrame([(0, 1, url, "t", "Brooks", "Ghost", url), (0, 2, "/product/brooks-ghost", "t", "Hoka", "Bondi", "/p")], CARD)
    pages = spark.createDataFrame([(url, "carbon plate 8 mm drop", ["$150.00"])] * 2, PAGE)
    rows = cat.assemble_rows(cards, pages).collect()
    assert [(r["price_usd"], r["plate"], r["drop_mm"]) for r in rows] == [(150.0, "carbon", 8.0)] * 2


def test_catalog_pos_is_unique_on_a_page_of_millions_of_anchors(spark):
    rows = spark.createDataFrame([(0, 1_000_001, "A", "x"), (1, 1, "B", "y")], "page_no bigint, anchor_idx int, brand string, model string")
    assert len({r["catalog_pos"] for r in cat.dedup_catalog(rows).collect()}) == 2


def test_extraction_stats_count_every_page(spark):
    anchors = spark.createDataFrame([(0, 1), (1, 1)], "page_no bigint, anchor_idx int")
    shape = "page_no bigint, anchor_idx int, brand string, model string, price_usd double, plate string, drop_mm double, weight_g int"
    rows = spark.createDataFrame([(0, 1, "A", "m", 10.0, "none", None, None), (1, 1, "A", "m", 0.0, "carbon", None, None)], shape)
    out = cat.extraction_stats(cat.summary(cat.first_rows(rows)), anchors).first()
    assert tuple(out) == (2, 2, 1, 1, 0, 100.0, 0.0)
    none = cat.summary(cat.first_rows(rows.limit(0)))
    assert tuple(cat.extraction_stats(none, anchors).first()) == (2, 0, 0, 0, 0, None, None)
    assert cat.facets(none).first()["n_brands"] == len(S.FACET_FALLBACK_BRANDS) - 1
    assert cat.plate_breakdown(none).count() == cat.brand_distribution(none).count() == 0


def test_statistics_come_from_one_read(spark, tables):
    part = tables.raw("part")
    anchors, pages = listing_anchors_view(part), product_pages_view(part)
    found = cat.statistics(anchors, pages)
    built = cat.build_catalog(anchors, pages)
    assert found["extraction_stats"].first()["unique_products"] == built.count()
    assert {r["plate"]: r["count"] for r in found["plate_breakdown"].collect()} == {
        r["plate"]: r["count"] for r in built.groupBy("plate").count().collect()}
    own = cat.summary(built)  # a catalog without its crawl
    assert sorted(map(tuple, cat.brand_distribution(own).collect())) == sorted(
        map(tuple, found["brand_distribution"].collect()))
    assert cat.facets(own).first() == found["facets"].first()
    plan = found["plate_breakdown"]._jdf.queryExecution().toString()
    assert "RDD" in plan and "body_text" not in plan


def test_pagination_links_of_every_form(spark):
    html = ("<a href=\"?page=2\">2</a><a class='n' href='list?page=3&amp;s=1'>3</a><a href=\"/q?page=4\">4</a>"
            "<A HREF = '//shop.example.com/?page=5'>5</A><a href=\"https://other.example.net/?page=6\">6</a>"
            "<a href=\"?page=2\">again</a><a href=\"/about\">x</a>")
    df = spark.createDataFrame([(1, "https://shop.example.com/men/shoes?sort=1", html)], "page_id bigint, url string, html string")
    links = src.page_links(df, F.lit("shop.example.com")).first()["links"]
    assert links == ["https://shop.example.com/men/shoes?sort=1", "https://shop.example.com/men/shoes?page=2",
                     "https://shop.example.com/men/list?page=3&s=1", "https://shop.example.com/q?page=4",
                     "https://shop.example.com/?page=5"]


def test_visible_text_decodes_entities_and_keeps_lines(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><!-- no --><p>Drop &lt;8\n mm&gt; &copy; &amp;amp;</p>"
            "<div>a&nbsp;<b>B</b><br/>c &middot; d</div><script>x<y</script></body></html>")
    text = spark.createDataFrame([(html,)], "h string").select(X.visible_text(F.col("h"))).first()[0]
    assert text == "t\ndrop <8 mm> © &amp;\na b\nc · d"


def test_odd_numbers_fail_no_job(spark):
    df = spark.createDataFrame([(["99999999999 reviews"],), (["9" * 40, "12 reviews"],), ([None, "none"],)], "t array<string>")
    assert [r[0] for r in df.select(en.first_parseable_int(F.col("t"))).collect()] == [99999999999, 12, 0]
    heavy = spark.createDataFrame([("9999999999999 oz",), ("9.5 oz",)], "t string")
    assert [r[0] for r in heavy.select(X.weight_g(F.col("t"))).collect()] == [None, 269]


def test_technical_lookup_takes_the_first_of_equal_products(spark, tables):
    lookups = spark.createDataFrame([(i, "A", "m", "x") for i in range(3)], "lookup_id bigint, brand string, model string, focus_area string")
    one = tables.catalog().limit(1)
    many = one.withColumns({"brand": F.lit("A"), "model": F.lit("m")}).withColumn(
        "catalog_pos", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (9, 4, 7)])))
    out = technical_lookup(lookups, many).collect()
    assert [(r["lookup_id"], r["catalog_pos"]) for r in sorted(out)] == [(0, 4), (1, 4), (2, 4)]


def test_unset_checkpoint_folder_on_a_cluster_is_an_error():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d),
                           sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)


def test_views_have_the_landing_schemas_and_operators_run_on_them(spark, tables):
    from shortlist.operators.replies import first_reply
    from shortlist.sources import views as V
    names = lambda schema: [f.name for f in schema.fields]
    part = tables.raw("part")
    landed = [(V.listing_anchors_view(part), S.LISTING_ANCHORS), (V.product_pages_view(part), S.PRODUCT_PAGES),
              (V.search_results_view(part), S.SEARCH_RESULTS), (V.web_hits_view(tables.raw("documents")), S.WEB_HITS),
              (V.llm_replies_view(tables.raw("conversations")), S.LLM_REPLIES),
              (V.raw_forms_view(tables.raw("customer")), S.RAW_FORM)]
    for view, schema in landed:
        assert set(names(schema)) <= set(view.columns), schema
    empty = lambda schema: spark.createDataFrame([], schema)
    catalog = empty(S.CATALOG)
    assert en.enrich_catalog(catalog, empty(S.SEARCH_RESULTS), empty(S.PRODUCT_PAGES)).count() == 0
    assert cat.build_catalog(empty(S.LISTING_ANCHORS), empty(S.PRODUCT_PAGES)).count() == 0
    assert first_reply(empty(S.LLM_REPLIES)).count() == 0
    rows = spark.createDataFrame([], "request_id bigint, rank int, catalog_pos bigint")
    assert web_context(rows, empty(S.WEB_HITS)).count() == 0


def test_landed_pages_give_anchors_and_a_catalog(spark):
    """Anchors and text of real HTML, on to a catalog row."""
    from shortlist.sources.tables import landed_product_pages, page_anchors
    listing = ("<p>x</p><!-- <a href='/no'>no</a> --><A class=\"c\" HREF = '/product/brooks-ghost-17?c=1&amp;d=2' "
               'aria-label="Men&#39;s a > b"><b>Brooks</b> Ghost 17</A> <span>Brooks <i>Ghost</i> 17</span>'
               '<a name="top">none</a><a href=/product/x-1>One</a> <a href="/two">Two</a><img src="i"><a href="/open">Last')
    product = "<h1>Brooks Ghost 17</h1><p>A daily trainer with 12 mm drop.</p><script>drop: 3 mm</script>"
    pages = spark.createDataFrame([(7, "https://s.example/list?page=1", listing), (9, "https://s.example/none", None),
                                   (8, "https://s.example/product/brooks-ghost-17?v=1", product)],
                                  "page_id bigint, url string, html string")
    anchors = page_anchors(pages)
    assert [f.name for f in anchors.schema] == [f.name for f in S.LISTING_ANCHORS]
    assert sorted(tuple(r) for r in anchors.collect()) == [
        (7, 0, "/product/brooks-ghost-17?c=1&d=2", "Men's a > b", "Brooks Ghost 17", "Brooks Ghost 17"),
        (7, 2, "/product/x-1", None, "One", "Two"), (7, 3, "/two", None, "Two", ""), (7, 4, "/open", None, "Last", "")]
    landed = landed_product_pages(pages)
    assert [(f.name, f.dataType) for f in landed.schema] == [(f.name, f.dataType) for f in S.PRODUCT_PAGES]
    rows = cat.assemble_rows(cat.product_cards(anchors.withColumn("aria_label", F.lit(None).cast("string"))), landed,
                             site="https://s.example").collect()
    assert [(r["brand"], r["drop_mm"]) for r in rows] == [("Brooks", 12.0)]


def test_links_of_pagination_blocks_come_first(spark):
    html = ("<p><a href='?page=1'>stray</a><!-- <a href='?page=9'>no</a> --><div class='x pagination'><ul><li><a href=?page=4>4</a>"
            "<li><a href='?page=1'>1</a></ul></div><nav aria-label=\"Pagination\"><b><a href=\"?page=2\">2</a></b></nav>"
            "<span data-testid='pagination'><a href='?page=6'>6</span><a href='?page=5'>5</a>")
    df = spark.createDataFrame([(1, "https://a.example/s", html), (2, "https://a.example/s", None)],
                               "page_id bigint, url string, html string")
    links = {r["page_id"]: r["links"] for r in src.page_links(df, F.lit("a.example")).collect()}
    # the link of the last block is never closed, and the next one starts within
    assert [x[-1] for x in links[1]] == ["s", "2", "4", "1", "6", "5"]
    assert links[2] == ["https://a.example/s"]


def test_landed_pages_fill_every_list(spark, tables):
    html = ("<title>price</title><div class='product-info'><h1>Shoe</h1><b class='price-sale'>$89.95</b>"
            "<b class='was-price'>$120.00</b></div><div class=description>Fast &amp; <i>light</i></div>"
            "<div data-testid='review-count'>145 reviews</div><div class='stars'>4.5 out of 5</div>"
            "<ul class='key-features'><li>A<li> </li><li>B<script>x</script></ul><select><option class='sold disabled'>10"
            "<option>10.5</select>")
    df = spark.createDataFrame([(1, "https://shop.example.com/product/x?c=1", html), (2, None, None)],
                               "page_id bigint, url string, html string")
    row, none = sorted(src.landed_product_pages(df).collect(), key=lambda r: r["url"] is None)
    assert row["price_texts"] == ["$89.95", "$89.95", "$120.00"]
    assert row["description_texts"] == ["Fast & light", "Shoe $89.95$120.00"]
    assert (row["review_count_texts"], row["rating_texts"]) == (["145 reviews"], ["4.5 out of 5"])
    assert row["feature_lists"] == [["A", "B"]]
    assert [(x["text"], x["class"]) for x in row["size_options"]] == [("10", "sold disabled"), ("10.5", None)]
    assert none["price_texts"] == [] and none["feature_lists"] == []
    pages = src.landed_product_pages(df)
    price = pages.select(X.price_pair(F.col("price_texts")).alias("p")).filter("p.price is not null").first()["p"]
    assert (price["price"], price["sale_price"]) == (120.0, 89.95)
    sized = pages.select(X.size_available(F.col("size_options"), F.lit("10.5")), X.size_available(F.col("size_options"), F.lit("10")))
    assert (True, False) in [tuple(r) for r in sized.collect()]
    data = en.enhanced_data(pages).filter("url is not null").first()["enhanced_data"]
    assert (data["reviews"]["count"], data["reviews"]["average_rating"]) == (145, 4.5)


def test_limits_are_taken_before_pages_are_read(spark, tables):
    part = tables.raw("part")
    limited = cat.build_catalog(listing_anchors_view(part), product_pages_view(part), max_products=5)
    plan = limited._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("GlobalLimit")


def test_web_hits_are_reduced_to_the_wanted_products_before_they_are_ranked(spark):
    rows = spark.createDataFrame([(1, 1, 7), (1, 3, 8)], "request_id bigint, rank int, catalog_pos bigint")
    hits = spark.createDataFrame([(7, 1, "u", "text"), (8, 1, "v", "other"), (9, 1, "w", "more")],
                                 "catalog_pos bigint, pos int, url string, content string")
    out = web_context(rows, hits)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 7, ["text"], ["u"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


def test_listing_links_begin_with_the_product_path(spark):
    hrefs = ["/product/a", "https://other.example/blog/product/x", "/shop/product/b", "/product/c?d#e"]
    df = spark.createDataFrame([(0, i, h, "Nike Pegasus 41", "t", None) for i, h in enumerate(hrefs)], S.LISTING_ANCHORS)
    assert sorted(r["canonical"] for r in cat.product_anchors(df).collect()) == ["/product/a", "/product/c"]


def test_listing_links_written_as_whole_addresses_make_products(spark):
    hrefs = ["https://shop.example.com/product/a?v=1", "/product/b", "https://shop.example.com/blog/product/x",
             "https://shop.example.com?to=/product/y", None]
    df = spark.createDataFrame([(0, i, h, f"Nike Pegasus {i}", "t", None) for i, h in enumerate(hrefs)], S.LISTING_ANCHORS)
    assert sorted(r["canonical"] for r in cat.product_anchors(df).collect()) == \
        ["/product/b", "https://shop.example.com/product/a"]
    pages = spark.createDataFrame([("https://shop.example.com/product/a", "Weight 200 g", ["$100.00"], [], [], [], [], [])],
                                  S.PRODUCT_PAGES)
    rows = {r["model"]: r["price_usd"] for r in cat.build_catalog(df, pages).collect()}
    assert rows == {"Pegasus 0": 100.0, "Pegasus 1": 0.0}


def test_enrichment_broadcasts_nothing_through_the_driver(spark, tables):
    """Not even where Spark takes the sides for small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        part = tables.raw("part")
        rich = en.enrich_catalog(tables.catalog(), search_results_view(part), product_pages_view(part))
        for df in (en.enrichment_summary(rich), technical_lookup(tech_lookups_view(part), tables.catalog())):
            df.collect()
            assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_side_is_broadcast_by_its_bytes(spark):
    from shortlist.operators.candidates import broadcastable
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert broadcastable(df) == (True, 100)
    spark.conf.set("shortlist.broadcast.maxBytes", "50000")
    try:
        assert broadcastable(df)[0] is False
        assert broadcastable(df.select("id"))[0] is True
    finally:
        spark.conf.unset("shortlist.broadcast.maxBytes")
    spark.conf.set("shortlist.broadcast.maxRows", "99")
    try:
        assert broadcastable(df.select("id")) == (False, 100)
    finally:
        spark.conf.unset("shortlist.broadcast.maxRows")
