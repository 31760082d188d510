"""Deterministic domain views over the driver's TPC-H-style tables.

The driver tables hold none of the domain text, so each domain table is a
pure projection of a driver table: every row of the driver table becomes a
row of the view (no id subsets), and all choices come from the row's own
columns. The DuckDB oracle (``shortlist.plans.oracle``) restates the same
formulas in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.scoring import popularity_score
from shortlist.operators.dedup import first_per_key
from shortlist.schemas import BRANDS


def _brand_of(n: Column) -> Column:
    """Brand number -> one of the 13 known brands (1-based element_at)."""
    return F.element_at(F.array(*[F.lit(b) for b in BRANDS]), (n % 13) + 1)


def _arr(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def catalog_view(part: DataFrame) -> DataFrame:
    """``catalog`` <- ``part`` (one product per part; duplicates of
    brand+model exist, as in an undeduplicated crawl)."""
    k = F.col("p_partkey")
    bno = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    t = F.col("p_type")
    size = F.col("p_size")
    category = (F.when(t == "ECONOMY", _arr("daily", "easy"))
                .when(t == "LARGE", _arr("long", "daily"))
                .when(t == "MEDIUM", _arr("tempo"))
                .when(t == "PROMO", _arr("race", "tempo"))
                .when(t == "SMALL", _arr("race"))
                .otherwise(_arr("easy", "trail")))
    plate = (F.when(k % 5 == 0, "carbon").when(k % 5 == 1, "nylon").when(k % 5 == 2, "none")
             .when(k % 5 == 3, "composite"))
    heel = F.when(k % 7 != 0, (F.lit(28) + size % 14).cast("double"))
    return part.select(
        k.cast("bigint").alias("catalog_pos"),
        _brand_of(bno).alias("brand"),
        F.col("p_name").alias("model"),
        category.alias("category"),
        F.round((F.col("p_retailprice") - 900.0) * 2.5 + 50.0, 2).alias("price_usd"),
        plate.alias("plate"),
        F.when(k % 17 != 0, (size % 13).cast("double")).alias("drop_mm"),
        F.when(k % 19 != 0, (F.lit(180) + size * 4).cast("int")).alias("weight_g"),
        F.when(k % 4 == 0, "plush").when(k % 4 == 1, "moderate").when(k % 4 == 2, "firm")
        .alias("cushioning_level"),
        F.when(k % 3 == 0, "stability").when(k % 3 == 1, "neutral").alias("support_type"),
        heel.alias("heel_stack_mm"),
        F.when(heel.isNotNull(), (F.lit(20) + size % 9).cast("double")).alias("forefoot_stack_mm"),
        F.when(t == "SMALL", _arr("10k", "5k")).when(t == "PROMO", _arr("half_marathon", "marathon"))
        .when(t == "LARGE", _arr("marathon")).alias("best_for_distances"),
        F.when(k % 6 == 0, F.lit(True)).alias("has_wide_options"),
    )


def requests_view(customer: DataFrame) -> DataFrame:
    """``requests`` <- every ``customer`` row, in the nested request schema."""
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    no_use = k % 7 == 6
    races = (F.when(no_use, F.array().cast("array<string>"))
             .when(seg == "AUTOMOBILE", _arr("5k", "10k"))
             .when(seg == "MACHINERY", _arr("marathon"))
             .otherwise(F.array().cast("array<string>")))
    brands = F.array(*[F.lit(b) for b in BRANDS])
    prefs = F.when(k % 3 == 0, F.array(F.element_at(brands, (k % 13 + 1).cast("int")),
                                       F.element_at(brands, ((k + 5) % 13 + 1).cast("int"))))
    half = F.lit(0.5)
    weights = F.when(k % 6 != 5, F.struct(
        (half * (k % 4 + 1)).alias("brand"),
        (half * ((k + 1) % 5)).alias("budget"),
        (half * ((k + 2) % 4 + 1)).alias("easy_runs"),
        (half * ((k + 3) % 4 + 1)).alias("tempo_runs"),
        (half * (k % 3 + 1)).alias("long_runs"),
        (half * ((k + 1) % 3 + 1)).alias("races"),
    ))
    return customer.select(
        k.cast("bigint").alias("request_id"),
        prefs.alias("brand_preferences"),
        F.struct(
            (~no_use & seg.isin("BUILDING", "HOUSEHOLD")).alias("easy_runs"),
            (~no_use & seg.isin("FURNITURE", "HOUSEHOLD")).alias("tempo_runs"),
            (~no_use & seg.isin("FURNITURE", "MACHINERY")).alias("long_runs"),
            races.alias("races"),
            (k % 11 == 10).alias("trail"),
        ).alias("intended_use"),
        F.struct((k % 5 != 4).alias("enabled"),
                 (F.lit(60.0) + F.floor(F.abs(F.col("c_acctbal")) / 40.0).cast("double")).alias("max_usd")).alias("cost_limiter"),
        (F.lit(1) + (k * 7) % 20).cast("int").alias("num_recommendations"),
        (k % 4 != 3).alias("allow_carbon"),
        weights.alias("weights"),
    )


def market_view(lineitem: DataFrame, catalog: DataFrame) -> DataFrame:
    """``market_context`` <- ``lineitem`` by part: review_count = 4*lines,
    rating from the mean quantity; keyed by (brand, model), the row of the
    highest catalog_pos wins (a later dict entry overwrote an earlier one).

    The aggregation is partial/final (map-side combine), so a part that
    holds a third of all lines costs one row per map task in the shuffle.
    """
    per_part = (lineitem.groupBy("l_partkey")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")))
    rating = F.greatest(F.lit(0.0), F.least(F.lit(5.0), (F.col("q") / F.col("n") - 15.0) / 2.5))
    m = (per_part.join(catalog.select("catalog_pos", "brand", "model"),
                       F.col("l_partkey") == F.col("catalog_pos"))
         .select("catalog_pos", "brand", "model",
                 (F.col("n") * 4).cast("bigint").alias("review_count"),
                 rating.alias("rating")))
    m = m.withColumn("popularity_score", popularity_score(F.col("review_count"), F.col("rating")))
    return first_per_key(m, ["brand", "model"], [F.col("catalog_pos").desc()]).drop("catalog_pos")


def raw_requests_view(customer: DataFrame) -> DataFrame:
    """Request bodies as they arrive: optional fields missing and some
    values out of range, for the default and validation jobs (R1-R3)."""
    k = F.col("c_custkey")
    brands = F.array(*[F.lit(b) for b in BRANDS])
    return customer.select(
        k.cast("bigint").alias("request_id"),
        F.when(k % 4 == 0, F.array(F.element_at(brands, (k % 13 + 1).cast("int"))))
        .when(k % 4 == 1, F.array().cast("array<string>")).alias("brand_preferences"),
        F.when(k % 29 != 0, F.struct(
            F.when(k % 2 == 0, F.lit(True)).alias("easy_runs"),
            F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)).alias("tempo_runs"),
            F.when(k % 5 == 0, F.lit(True)).alias("long_runs"),
            F.when(k % 7 == 0, _arr("5k")).alias("races"),
            F.when(k % 11 == 0, F.lit(True)).alias("trail"))).alias("intended_use"),
        F.when(k % 31 != 0, F.struct(
            F.when(k % 6 == 0, F.lit(False)).when(k % 6 == 1, F.lit(True)).alias("enabled"),
            (F.col("c_acctbal") / 20.0).alias("max_usd"))).alias("cost_limiter"),
        F.when(k % 9 != 0, (k % 23).cast("int")).alias("num_recommendations"),
        F.when(k % 8 != 0, k % 2 == 1).alias("allow_carbon"),
        F.when(k % 6 != 5, F.struct(
            F.when(k % 5 != 0, F.lit(0.5) * (k % 4)).alias("brand"),
            F.lit(None).cast("double").alias("budget"),
            F.lit(2.0).alias("easy_runs"),
            F.when(k % 2 == 0, F.lit(0.0)).alias("tempo_runs"),
            F.lit(None).cast("double").alias("long_runs"),
            F.lit(1.5).alias("races"))).alias("weights"),
    )


def raw_forms_view(customer: DataFrame) -> DataFrame:
    """Submitted web forms (all values are strings; unchecked boxes are
    absent), for the form coercion job (R4)."""
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    brands = F.array(*[F.lit(b) for b in BRANDS])
    one = F.element_at(brands, (k % 13 + 1).cast("int"))
    checked = F.array_compact(F.array(
        F.when(seg.isin("BUILDING", "HOUSEHOLD"), F.lit("easy_runs")),
        F.when(seg.isin("FURNITURE", "HOUSEHOLD"), F.lit("tempo_runs")),
        F.when(seg.isin("FURNITURE", "MACHINERY"), F.lit("long_runs")),
        F.when(k % 11 == 10, F.lit("trail"))))
    def wtxt(shift: int) -> Column:
        m = (k + shift) % 4
        return (F.when(m == 0, F.lit("")).when(m == 1, F.lit("x1")).when(m == 2, F.lit("1.5"))
                .otherwise(F.lit(None).cast("string")))
    return customer.select(
        k.cast("bigint").alias("request_id"),
        F.when(k % 4 == 0, F.array(F.lit("Any"), one)).when(k % 4 == 1, F.array(one))
        .otherwise(F.array().cast("array<string>")).alias("brand_preferences"),
        checked.alias("checked"),
        F.when(k % 5 == 0, _arr("5k", "marathon")).when(k % 5 == 1, _arr("10k"))
        .otherwise(F.array().cast("array<string>")).alias("races"),
        F.when(k % 3 != 0, F.lit("on")).alias("budget_enabled"),
        F.when(k % 10 == 0, F.lit("abc")).when(k % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.floor(F.abs(F.col("c_acctbal")) / 30.0 + 40.0).cast("string")).alias("max_budget"),
        F.when(k % 7 != 0, (k % 25).cast("string")).alias("num_recommendations"),
        F.when(k % 2 == 0, F.lit("on")).alias("allow_carbon"),
        wtxt(0).alias("weight_brand"), wtxt(1).alias("weight_budget"), wtxt(2).alias("weight_easy_runs"),
        wtxt(3).alias("weight_tempo_runs"), wtxt(0).alias("weight_long_runs"),
        wtxt(1).alias("weight_races"),
    )


# --- landed listing and product pages (derived from ``part``) -------------------------

def _brand_text(k: Column, bno: Column) -> Column:
    """Brand as printed on a listing: one of the known brands (sometimes
    upper-cased) or an unknown maker, whose cards are then dropped."""
    brands = F.array(*[F.lit(b) for b in BRANDS])
    known = F.element_at(brands, (bno % 14 + 1).cast("int"))
    name = F.when(bno % 14 == 13, F.lit("Acme")).otherwise(known)
    return F.when(k % 2 == 0, F.upper(name)).otherwise(name)


def _slug(k: Column) -> Column:
    return F.concat(F.lit("/product/"), F.regexp_replace(F.lower(F.col("p_name")), " ", "-"), F.lit("-"),
                    k.cast("string"))


def listing_anchors_view(part: DataFrame) -> DataFrame:
    """Product anchors of listing pages: 40 products per page; every third
    product has a second (image) anchor to the same product with another
    query string; titles come from aria-label, link text, sibling text or
    the slug."""
    k = F.col("p_partkey")
    bno = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    title = F.concat(_brand_text(k, bno), F.lit(" "), F.col("p_name"))
    m = k % 5
    base = part.select(
        (k / 40).cast("bigint").alias("page_no"), (k % 40).cast("int").alias("slot"), k.alias("k"),
        _slug(k).alias("path"), title.alias("title"), m.alias("m"))
    dup = F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    a = base.select("*", F.explode(dup).alias("copy"))
    suffix = (F.when(F.col("copy") == 1, F.lit("?view=image"))
              .when(F.col("k") % 4 == 1, F.concat(F.lit("?color="), (F.col("k") % 3).cast("string")))
              .when(F.col("k") % 4 == 2, F.lit("#reviews")).otherwise(F.lit("")))
    mm = F.col("m")
    return a.select(
        "page_no", (F.col("slot") * 2 + F.col("copy")).cast("int").alias("anchor_idx"),
        F.concat(F.when(F.col("k") % 7 == 6, F.lit("https://shop.example.com")).otherwise(F.lit("")), "path", suffix)
        .alias("href"),
        F.when(mm == 0, F.concat(F.lit("Men's "), F.col("title"))).when(mm == 1, F.lit("Shoe"))
        .alias("aria_label"),
        F.when(mm <= 2, F.col("title")).when(mm == 3, F.lit("")).otherwise(F.lit("New")).alias("text"),
        F.when(mm == 3, F.concat(F.lit("Women's "), F.col("title"), F.lit(" 2")))
        .when(mm == 4, F.lit("Hoka")).alias("sibling_text"),
    )


def _price_text(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.00"))


def product_pages_view(part: DataFrame) -> DataFrame:
    """Product pages keyed by their canonical URL: body text with spec
    phrases, price text nodes, size options, and the review/description/
    feature text nodes in selector order."""
    k, s, t = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    bno = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    n = lambda x: x.cast("string")
    cat = (F.when(t == "ECONOMY", "A daily trainer for everyday miles")
           .when(t == "LARGE", "Built for long runs and marathon training")
           .when(t == "MEDIUM", "A tempo shoe with speed")
           .when(t == "PROMO", "Racing flat for race day competition")
           .when(t == "SMALL", "Fast 5k racer").otherwise("Trail shoe for off-road recovery runs"))
    plate = (F.when(k % 8 == 0, "carbon plate").when(k % 8 == 1, "carbon fiber plate for propulsion")
             .when(k % 8 == 2, "nylon plate").when(k % 8 == 3, "composite plate")
             .when(k % 8 == 4, "pebax plate").when(k % 8 == 5, "no plate")
             .when(k % 8 == 6, "plate technology inside"))
    d = n(s % 13)
    drop = (F.when(k % 4 == 0, F.concat(d, F.lit(" mm drop"))).when(k % 4 == 1, F.concat(F.lit("drop: "), d, F.lit(" mm")))
            .when(k % 4 == 2, F.concat(d, F.lit("mm offset"))))
    weight = (F.when(k % 3 == 0, F.concat(n(s % 5 + 7), F.lit("."), n(s % 10), F.lit(" ounces")))
              .when(k % 3 == 1, F.concat(n(s % 3 + 8), F.lit(" oz"))))
    cushion = (F.when(k % 6 == 0, "max cushioning").when(k % 6 == 1, "balanced ride")
               .when(k % 6 == 2, "snappy feel").when(k % 6 == 3, "super soft foam")
               .when(k % 6 == 4, "responsive ride"))
    support = (F.when(k % 5 == 0, "stability shoe").when(k % 5 == 1, "neutral").when(k % 5 == 2, "guide rails")
               .when(k % 5 == 4, "neutral support shoe"))
    stack = (F.when(k % 4 == 0, F.concat(F.lit("heel stack: "), n(s % 10 + 30), F.lit("mm / "), n(s % 9 + 20),
                                         F.lit("mm forefoot")))
             .when(k % 4 == 1, F.concat(n(s % 10 + 30), F.lit("mm/"), n(s % 7 + 22), F.lit("mm"))))
    dist = (F.when(k % 5 == 0, "5k").when(k % 5 == 1, "10k and half marathon").when(k % 5 == 2, "marathon")
            .when(k % 5 == 3, "half-marathon"))
    wide = F.when(k % 8 == 0, "Available in wide 2E")
    title = F.concat(F.lit("Men's "), _brand_text(k, bno), F.lit(" "), F.col("p_name"))
    body = F.concat_ws(" ", title, cat, plate, drop, weight, cushion, support, stack, dist, wide)
    price = F.round((F.col("p_retailprice") - 900.0) * 2.5 + 50.0, 2)
    p, sale = _price_text(price), _price_text(price - 15.0)
    price_texts = (F.when(k % 4 == 0, F.array(F.concat(F.lit("$"), p)))
                   .when(k % 4 == 1, F.array(F.concat(F.lit("$"), p), F.concat(F.lit("$"), sale)))
                   .when(k % 4 == 2, F.array(F.concat(F.lit("Was "), p, F.lit(" now "), sale)))
                   .otherwise(F.array(F.lit("$19.99 gift card"), F.concat(F.lit("$"), p), F.lit(""))))
    opt = lambda txt, cls, aria, parent: F.struct(
        txt.alias("text"), cls.alias("class"), aria.alias("aria_disabled"), parent.alias("parent_class"))
    none = F.lit(None).cast("string")
    sizes = F.array(
        opt(F.lit("9"), F.lit("btn"), none, F.lit("sizes")),
        opt(F.lit("10"), F.when(k % 3 == 0, F.lit("btn disabled")).otherwise(F.lit("btn")),
            F.when(k % 5 == 0, F.lit("true")), F.when(k % 7 == 0, F.lit("sizes unavailable")).otherwise(F.lit("sizes"))),
        opt(F.when(k % 11 == 0, F.lit(" 10 ")).otherwise(F.lit("10.5")), F.lit("btn"), none, F.lit("sizes")))
    desc = F.array(F.when(k % 3 == 0, F.concat(F.lit("  The "), F.col("p_name"), F.lit(" is a versatile shoe.  "))),
                   F.when(k % 3 != 2, F.lit("Product details")))
    reviews = F.array(none, F.when(k % 4 != 3, F.lit("Reviews")),
                      F.when(k % 4 != 3, F.concat(F.lit("("), n(s * 7 % 400), F.lit(" reviews)"))))
    ratings = F.array(F.when(k % 2 == 0, F.concat(n(s % 5), F.lit("."), n(k % 10), F.lit(" out of 5"))),
                      F.concat(n(s % 6), F.lit("/5")))
    feats = F.array(F.array().cast("array<string>"),
                    F.array(F.lit("  "), F.lit(" Breathable mesh "), F.lit("Foam midsole"), F.lit("Rubber outsole"),
                            F.lit("Reflective details"), F.lit("Padded collar"), F.lit("Extra item")),
                    F.array(F.lit("Other list")))
    return part.select(
        F.concat(F.lit("https://shop.example.com"), _slug(k)).alias("url"),
        body.alias("body_text"), price_texts.alias("price_texts"), sizes.alias("size_options"),
        desc.alias("description_texts"), reviews.alias("review_count_texts"), ratings.alias("rating_texts"),
        F.when(k % 5 != 4, feats).otherwise(F.array(F.array().cast("array<string>"))).alias("feature_lists"))


#: Pagination links of a listing page, in every form that a page may use.
PAGINATION = [
    '<a href="?page=2">2</a>', "<a class='next' href='list?page=3&amp;sort=new'>3</a>",
    '<a href="/shoes?page=4">4</a>', "<A HREF = '//other.example.net/?page=5'>5</A>",
    '<a rel="next" href="https://other.example.net/x?page=6">6</a>', '<a href="#page=7">7</a>']


#: Blocks around links, and a link that is none: (divisor, remainder, markup).
BLOCKS = [(2, 1, '<nav aria-label="Pagination"><ul><li><a href="?page=8">8</a><li><a href="?page=2">2</a></ul></nav>'),
          (3, 1, '<div class="list pagination"><span><a href=?page=9>9</a></span></div>'),
          (5, 1, '<!-- <a href="?page=99">no</a> -->')]


def paginated_view(pages: DataFrame) -> DataFrame:
    """The landed pages, each with some stray links with a page number and some
    pagination blocks (by page_id) before its own HTML."""
    p = F.col("page_id")
    links = [F.when(p % n == 0, F.lit(x)).otherwise(F.lit("")) for n, x in enumerate(PAGINATION, 1)]
    links += [F.when(p % n == k, F.lit(x)).otherwise(F.lit("")) for n, k, x in BLOCKS]
    return pages.select("page_id", "url", F.concat(*links, F.coalesce("html", F.lit(""))).alias("html"))


def marked_pages_view(pages: DataFrame) -> DataFrame:
    """The landed pages, each with the elements of a product page (by page_id)
    before its own HTML; some tags are left open, as on real pages."""
    p, n = F.col("page_id"), F.col("page_id").cast("string")
    parts = [
        '<div class="product-info main"><span data-testid="price">$', (p % 90 + 100).cast("string"),
        '.95</span><p class="price-sale">Now ', (p % 40 + 60).cast("string"), ".50</div>",
        F.when(p % 4 != 0, F.concat(F.lit('<div class="x description">About &amp; <b>sh</b>oe '), n,
                                    F.lit("<br>the end<script>no()</script></div>"))).otherwise(F.lit("")),
        '<ul class="features"><li>F', n, "<li> light <li></ul>",
        F.when(p % 2 == 0, F.lit('<ul class="bullet-points"><li>B1</li></ul>')).otherwise(F.lit("")),
        F.when(p % 3 != 0, F.concat(F.lit('<span class="review-count">('), n, F.lit(" reviews)</span>"))).otherwise(F.lit("")),
        '<i class="stars">4.', (p % 10).cast("string"), " out of 5</i>",
        '<div class="unavailable"><button class="size" aria-disabled="true">10</button></div><button>9.5</button>']
    parts = [F.lit(x) if isinstance(x, str) else x for x in parts]
    return pages.select("page_id", "url", F.concat(*parts, F.coalesce("html", F.lit(""))).alias("html"))


def search_results_view(part: DataFrame) -> DataFrame:
    """Site-search results of each catalog product (``query_pos``): a
    non-product link first (for every fourth product with the full title as
    its text), then (for two of three products) a partial
    title, then the full title; links point to the product page."""
    k = F.col("p_partkey")
    bno = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    brand = _brand_of(bno)
    url = F.concat(F.lit("https://shop.example.com"), _slug(k))
    first_word = F.substring_index(F.col("p_name"), " ", 1)
    rows = F.array(
        F.struct(F.lit(1).alias("pos"),
                 F.when(k % 4 == 0, F.lit("https://shop.example.com/blog/review"))
                 .otherwise(F.lit("https://shop.example.com/sale")).alias("href"),
                 F.when(k % 4 == 0, F.concat(brand, F.lit(" "), F.col("p_name"))).otherwise(F.lit("Sale items"))
                 .alias("link_text")),
        F.struct(F.lit(2).alias("pos"), url.alias("href"),
                 F.when(k % 3 != 0, F.concat(F.lower(brand), F.lit(" "), first_word))
                 .otherwise(F.lit("Gift cards")).alias("link_text")),
        F.struct(F.lit(3).alias("pos"), F.concat(url, F.lit("?ref=search")).alias("href"),
                 F.concat(brand, F.lit(" "), F.col("p_name")).alias("link_text")))
    return part.select(k.cast("bigint").alias("query_pos"), F.explode(rows).alias("r")).select(
        "query_pos", "r.pos", "r.href", "r.link_text")


def web_hits_view(documents: DataFrame) -> DataFrame:
    """Web search hits per product: two hits (positions 1, 2) for the
    products ``doc_id // 2``; content is the document text."""
    d = F.col("doc_id")
    return documents.select(
        (d / 2).cast("bigint").alias("catalog_pos"), (d % 2 + 1).cast("int").alias("pos"),
        F.concat(F.lit("https://reviews.example.org/"), F.col("source"), F.lit("/"), d.cast("string")).alias("url"),
        F.col("text").alias("content"))


def llm_replies_view(conversations: DataFrame) -> DataFrame:
    """Model replies keyed by request (``conv_id``) and turn: each assistant
    turn wrapped by ``conv_id`` as a plain JSON array (sometimes an empty
    one), an array fenced with or without a language tag, an array inside
    prose, bare prose, or an array with a non-string."""
    cv = F.col("conv_id")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x != "")
    js = F.to_json(lines)
    plain = F.transform(lines, lambda x: F.regexp_replace(x, '["\\\\]', ""))
    reply = (F.when(cv % 20 == 15, F.lit("[]")).when(cv % 5 == 0, js)
             .when(cv % 10 == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
             .when(cv % 10 == 6, F.concat(F.lit("```\n"), js, F.lit("\n```")))
             .when(cv % 5 == 2, F.concat(F.lit("Here you go: "), js, F.lit(" Thanks.")))
             .when(cv % 5 == 3, F.col("text"))
             .otherwise(F.concat(F.lit('["'), F.array_join(plain, '", "'), F.lit('", 1]'))))
    return conversations.filter(F.col("role") == "assistant").select(
        cv.cast("bigint").alias("request_id"), F.col("turn").cast("bigint").alias("turn"),
        reply.alias("reply_text"))


def tech_lookups_view(part: DataFrame) -> DataFrame:
    """Technical-analysis lookups (brand, model); one in four asks for a
    model that is not in the catalog."""
    k = F.col("p_partkey")
    bno = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return part.select(
        k.cast("bigint").alias("lookup_id"), _brand_of(bno).alias("brand"),
        F.when(k % 4 == 3, F.concat(F.col("p_name"), F.lit(" X"))).otherwise(F.col("p_name")).alias("model"),
        F.when(k % 3 == 0, F.lit("durability")).otherwise(F.lit("performance")).alias("focus_area"))
