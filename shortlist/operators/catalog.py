"""Catalog build from landed listing anchors and product pages (X3-X17,
W5-W8) and the catalog statistics (A1-A3, A9, A11).

Shape: anchors -> canonical dedup per page (W5) -> titles and brand/model
(X4, X5) -> raw-URL dedup per page (W6) -> join product pages on the
canonical URL -> price and specs (X6-X15) -> row assembly (X17) -> optional
first-N (W8) -> brand+model dedup (W7). Narrow except the two per-page
dedups (partitioned by page) and the page join (a shuffle join on URL; both
sides grow with the crawl, so nothing is broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.functions import extract as X
from shortlist.operators.dedup import first_n, first_per_key
from shortlist.schemas import FACET_FALLBACK_BRANDS, FACET_FALLBACK_MAX_PRICE

c = F.col

DEFAULT_SITE = "https://shop.example.com"


def product_anchors(anchors: DataFrame) -> DataFrame:
    """X3 + W5: links to the product path only (as a path or as a whole address), one per canonical
    URL within a page (first in page order wins, even if its title is unusable later)."""
    prod = anchors.filter(X.is_product_path(c("href"))).withColumn("canonical", X.canonical_url(c("href")))
    return first_per_key(prod, ["page_no", "canonical"], [c("anchor_idx")])


def product_cards(anchors: DataFrame) -> DataFrame:
    """X4 + X5 + W6: cards with a usable title and a known brand, one per raw
    product URL within a page."""
    a = product_anchors(anchors)
    bm = X.with_brand_model(X.with_card_title(a)).filter(c("brand").isNotNull())
    cards = bm.select("page_no", "anchor_idx", "canonical", "title", "brand", "model",
                      c("href").alias("product_url"))
    return first_per_key(cards, ["page_no", "product_url"], [c("anchor_idx")])


def assemble_rows(cards: DataFrame, pages: DataFrame, site: str = DEFAULT_SITE,
                  size: str | None = None) -> DataFrame:
    """Join each card to its product page and build the catalog row
    with defaults (category ['daily'], price 0.0, plate 'none'). Addresses that
    are absolute already are taken as they are; of a page landed more than
    once the first by its text counts. With a ``size``, the size check
    replaces the spec extraction (as the source does), and size columns are
    added."""
    address = F.when(c("canonical").startswith("/"), F.concat(F.lit(site), c("canonical"))).otherwise(c("canonical"))
    once = first_per_key(pages, ["url"], [c("body_text")]).withColumnRenamed("url", "page_url")
    joined = cards.join(once, address == c("page_url"), "left")
    price = X.price_pair(F.coalesce(c("price_texts"), F.array().cast("array<string>")))
    rows = joined.withColumn("_price", price)
    if size is None:
        rows = rows.withColumn("_s", X.specs(F.coalesce(c("body_text"), F.lit(""))))
    else:
        rows = rows.withColumn("_s", F.lit(None).cast(X_SPEC_TYPE))
    out = rows.select(
        "page_no", "anchor_idx", "brand", "model", "product_url",
        F.coalesce(c("_s.category"), F.array(F.lit("daily"))).alias("category"),
        F.coalesce(c("_price.price"), F.lit(0.0)).alias("price_usd"),
        F.coalesce(c("_s.plate"), F.lit("none")).alias("plate"),
        c("_s.drop_mm").alias("drop_mm"), c("_s.weight_g").alias("weight_g"),
        c("_s.cushioning_level").alias("cushioning_level"), c("_s.support_type").alias("support_type"),
        c("_s.heel_stack_mm").alias("heel_stack_mm"), c("_s.forefoot_stack_mm").alias("forefoot_stack_mm"),
        c("_s.best_for_distances").alias("best_for_distances"),
        c("_s.has_wide_options").alias("has_wide_options"),
        *([] if size is None else [
            F.lit(size).alias("size_checked"),
            F.when(c("page_url").isNull(), F.lit(False))
            .otherwise(X.size_available(c("size_options"), F.lit(size))).alias("available_for_size"),
            c("_price.sale_price").alias("sale_price_usd")]))
    return out


X_SPEC_TYPE = ("struct<category:array<string>,plate:string,drop_mm:double,weight_g:int,"
               "cushioning_level:string,support_type:string,heel_stack_mm:double,"
               "forefoot_stack_mm:double,best_for_distances:array<string>,has_wide_options:boolean>")


def build_catalog(anchors: DataFrame, pages: DataFrame, size: str | None = None,
                  max_products: int | None = None, site: str = DEFAULT_SITE) -> DataFrame:
    """The whole crawl-to-catalog job: W8 (first N in crawl order) before
    W7 (first row per brand+model). ``catalog_pos`` is the crawl order. Each
    card makes one row, so the first N cards are taken before their pages are
    joined and read."""
    cards = first_n(product_cards(anchors), [c("page_no"), c("anchor_idx")], max_products)
    return dedup_catalog(assemble_rows(cards, pages, site, size))


def dedup_catalog(rows: DataFrame) -> DataFrame:
    """First row per brand+model in crawl order; ``catalog_pos`` keeps
    the crawl order: the page number above 32 bits of the anchor's place."""
    uniq = first_per_key(rows, ["brand", "model"], [c("page_no"), c("anchor_idx")])
    return uniq.withColumn("catalog_pos", c("page_no") * F.lit(1 << 32) + c("anchor_idx"))


# --- statistics (A1-A3) and facets (A9, A11) ---------------------------------------------

def spec_found() -> F.Column:
    d, w = c("drop_mm"), c("weight_g")
    return (c("plate") != "none") | (d.isNotNull() & (d != 0)) | (w.isNotNull() & (w != 0))


STATISTICS_COLS = ["page_no", "anchor_idx", "brand", "model", "price_usd", "plate", "drop_mm", "weight_g"]


def first_rows(rows: DataFrame) -> DataFrame:
    """W7 for statistics: each brand and model once, with the narrow columns
    of its first row, ``catalog_pos`` and the number of its rows. An
    aggregation, so a task sends one row for each product it has seen."""
    first = F.struct("page_no", "anchor_idx", "price_usd", "plate", "drop_mm", "weight_g")
    best = F.min_by(first, F.struct("page_no", "anchor_idx"))
    return rows.groupBy("brand", "model").agg(best.alias("r"), F.count(F.lit(1)).alias("rows")).select(
        "brand", "model", "r.*", (c("r.page_no") * F.lit(1 << 32) + c("r.anchor_idx")).alias("catalog_pos"), "rows")


def summary(catalog: DataFrame) -> DataFrame:
    """All that the statistics need, from one read of a catalog: one row for
    the whole, one a plate and one a brand (``part`` says which). ``rows`` counts
    the crawl rows where the catalog has them."""
    rows = c("rows") if "rows" in catalog.columns else F.lit(1)
    priced = F.when(F.coalesce(c("price_usd"), F.lit(0.0)) != 0, c("price_usd"))
    return catalog.groupingSets([[c("plate")], [c("brand")], []], "plate", "brand").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("count"), F.min("catalog_pos").alias("first_pos"),
        F.sum(rows).alias("products"), F.count_if(c("price_usd") > 0).alias("price_ok"),
        F.count_if(spec_found()).alias("specs_ok"), F.max(priced).alias("max_price")).select(
        F.when(c("_g") == 1, "plate").when(c("_g") == 2, "brand").otherwise("all").alias("part"), "*").drop("_g")


def _part(s: DataFrame, key: str) -> DataFrame:
    total = F.max(F.when(c("part") == "all", c("count"))).over(Window.partitionBy())  # a row per plate and brand
    return s.withColumn("pct", c("count") * 100.0 / total).filter(c("part") == key).select(
        key, "count", "first_pos", "pct")


def extraction_stats(s: DataFrame, anchors: DataFrame) -> DataFrame:
    """A1: one row from a ``summary`` and the landed anchors, whose pages count
    also without a card. Rates are null on an empty catalog (the source divided
    by zero)."""
    pages = anchors.select(F.countDistinct("page_no")).scalar()
    names = {"products": "products", "unique_products": "count", "price_ok": "price_ok", "specs_ok": "specs_ok"}
    whole = s.agg(*[F.coalesce(F.max(F.when(c("part") == "all", c(x))), F.lit(0)).alias(n) for n, x in names.items()])
    return whole.select(pages.alias("pages"), *names,
                        F.try_divide(c("price_ok") * 100.0, c("unique_products")).alias("price_rate"),
                        F.try_divide(c("specs_ok") * 100.0, c("unique_products")).alias("specs_rate"))


def plate_breakdown(s: DataFrame) -> DataFrame:                          # A2
    """Count and percentage per plate, from a ``summary``."""
    return _part(s, "plate").drop("first_pos")


def brand_distribution(s: DataFrame) -> DataFrame:                       # A3
    """Ordered by count desc; ties keep first-seen order. The position window
    runs over the brands, not over products."""
    return _part(s, "brand").withColumn("position", F.row_number().over(
        Window.orderBy(c("count").desc(), c("first_pos").asc()))).drop("first_pos")


def facets(s: DataFrame) -> DataFrame:                                   # A9 / A11
    """Sorted distinct brands plus "Any", and int(max price + 50); the
    fixed defaults when the catalog has no priced row."""
    named = F.when((c("part") == "brand") & (F.coalesce(c("brand"), F.lit("")) != ""), c("brand"))
    agg = s.agg(F.sort_array(F.collect_set(named)).alias("_brands"),
                F.max(F.when(c("part") == "all", c("max_price"))).alias("_max"))
    ok = c("_max").isNotNull()
    return agg.select(
        F.when(ok, F.array_append(c("_brands"), F.lit("Any")))
        .otherwise(F.array(*[F.lit(b) for b in FACET_FALLBACK_BRANDS])).alias("brands"),
        F.when(ok, (c("_max") + 50).cast("int")).otherwise(F.lit(FACET_FALLBACK_MAX_PRICE)).alias("max_price"),
        F.when(ok, F.size("_brands")).otherwise(F.lit(len(FACET_FALLBACK_BRANDS) - 1)).alias("n_brands"))


def statistics(anchors: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """A1, A2, A3, A9 and A11 of a crawl from one read of it: the summary (a
    row per plate and brand) is written once and the five results read that."""
    from shortlist.session import cut_lineage
    rows = assemble_rows(product_cards(anchors), pages).select(*STATISTICS_COLS)
    s = cut_lineage(summary(first_rows(rows)))
    return {"extraction_stats": extraction_stats(s, anchors), "plate_breakdown": plate_breakdown(s),
            "brand_distribution": brand_distribution(s), "facets": facets(s)}
