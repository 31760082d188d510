"""Registered queries for sources, sinks, limits and branches that the main
queries do not reach: (builder, DuckDB SQL) by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions import text as T
from shortlist.operators import catalog as cat
from shortlist.operators import enrich as en
from shortlist.operators import prompts as pr
from shortlist.operators.ranking import preview
from shortlist.operators.requests import domain_lists, prepare_requests, split_valid, with_defaults
from shortlist.plans import oracle as O
from shortlist.plans.recommend import shortlist
from shortlist.session import checkpoint_dir, cut_lineage
from shortlist.sources import tables as src
from shortlist.sources.views import (catalog_view, listing_anchors_view, llm_replies_view, market_view, product_pages_view,
                                     raw_requests_view, requests_view, search_results_view, tech_lookups_view)
from shortlist.streaming.explanations_stream import explain_to_completion

c = F.col

MAX_PRODUCTS = 100
MAX_ITEMS = 50


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _catalog(spark, sf_dir):
    return catalog_view(src.read_table(spark, sf_dir, "part"))


def _requests(spark, sf_dir):
    return requests_view(src.read_table(spark, sf_dir, "customer"))


def _market(spark, sf_dir):
    """Written once: it aggregates the largest table, and several jobs read it."""
    return cut_lineage(market_view(src.read_table(spark, sf_dir, "lineitem"), _catalog(spark, sf_dir)))


def _enriched(spark, sf_dir, max_items=None):
    part = src.read_table(spark, sf_dir, "part")
    return en.enrich_catalog(catalog_view(part), search_results_view(part), product_pages_view(part), max_items)


def _flat_enriched(e: DataFrame) -> DataFrame:
    d = c("enhanced_data")
    return e.select("catalog_pos", "brand", "model", "web_source_url", d["reviews"]["count"].alias("review_count"),
                    F.round(d["reviews"]["average_rating"], 6).alias("average_rating"),
                    d["description"].alias("description"), F.array_join(d["features"], "|").alias("features"),
                    F.round(d["popularity_score"], 6).alias("popularity_score"))


def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 then S1: the catalog written as JSON lines and scanned again."""
    path = _scratch(spark, "catalog")
    src.write_catalog(_catalog(spark, sf_dir), path, fmt="jsonl")
    return src.read_catalog(spark, path, fmt="jsonl").select(
        "catalog_pos", "brand", "model", F.array_join("category", ",").alias("category"), "price_usd", "plate",
        "drop_mm", "weight_g", "cushioning_level", "heel_stack_mm", "has_wide_options")


def catalog_roundtrip_sql() -> str:
    return O.with_ctes(O.CATALOG) + """
SELECT catalog_pos, brand, model, array_to_string(category, ',') AS category, price_usd, plate, drop_mm, weight_g,
  cushioning_level, heel_stack_mm, has_wide_options FROM catalog"""


ARRAY_ROWS = 500


def catalog_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as hand-made JSON array files (without positions, with
    the size columns), scanned in file order."""
    path = _scratch(spark, "arrays")
    rows = _catalog(spark, sf_dir).select(
        F.expr(f"catalog_pos div {ARRAY_ROWS}").alias("chunk"), "catalog_pos",
        F.to_json(F.struct("brand", "model", "category", "price_usd", "plate", "drop_mm", "weight_g",
                           F.lit("10").alias("size_checked"), (c("catalog_pos") % 3 == 0).alias("available_for_size"),
                           F.round(c("price_usd") * 0.9, 2).alias("sale_price_usd"))).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("catalog_pos", "item"))), lambda x: x["item"])
    files = rows.groupBy("chunk").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("text"))
    files.repartitionByRange("chunk").sortWithinPartitions("chunk").select("text").write.option(
        "maxRecordsPerFile", 1).text(path)
    return src.read_catalog(spark, path, fmt="json").select(
        "catalog_pos", "brand", "model", F.array_join("category", ",").alias("category"), "price_usd", "plate",
        "drop_mm", "weight_g", "size_checked", "available_for_size", "sale_price_usd")


def catalog_array_scan_sql() -> str:
    return O.with_ctes(O.CATALOG) + """
SELECT row_number() OVER (ORDER BY catalog_pos) AS catalog_pos, brand, model,
  array_to_string(category, ',') AS category, price_usd, plate, drop_mm, weight_g, '10' AS size_checked,
  catalog_pos % 3 = 0 AS available_for_size, round(price_usd * 0.9, 2) AS sale_price_usd FROM catalog"""


def catalog_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a catalog that is stored, then replaced by a job that reads it:
    prices fall by a tenth, every seventh product goes. Both versions are
    read."""
    path = _scratch(spark, "replaced")
    src.write_catalog(_catalog(spark, sf_dir), path)
    old = src.read_catalog(spark, path)
    src.write_catalog(old.filter(c("catalog_pos") % 7 != 0).withColumn("price_usd", F.round(c("price_usd") * 0.9, 2)),
                      path, fmt="jsonl")
    before = src.read_catalog(spark, path, version=1).select("catalog_pos", c("price_usd").alias("old_price"))
    return src.read_catalog(spark, path).join(before, "catalog_pos", "full").select(
        "catalog_pos", "brand", "model", "price_usd", "old_price")


def catalog_replace_sql() -> str:
    return O.with_ctes(O.CATALOG) + """
SELECT catalog_pos, CASE WHEN catalog_pos % 7 <> 0 THEN brand END AS brand,
  CASE WHEN catalog_pos % 7 <> 0 THEN model END AS model,
  CASE WHEN catalog_pos % 7 <> 0 THEN round(price_usd * 0.9, 2) END AS price_usd, price_usd AS old_price FROM catalog"""


def unreadable_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as they were landed, some cut off or no JSON at all;
    all rejected ones with their errors, and the text of unreadable ones."""
    path = _scratch(spark, "bodies")
    raw = raw_requests_view(src.read_table(spark, sf_dir, "customer"))
    key = c("request_id").cast("string")
    body = (F.when(c("request_id") % 9 == 4, F.concat(F.lit('{"request_id": '), key))
            .when(c("request_id") % 9 == 5, F.concat(F.lit("not json "), key))
            .otherwise(F.to_json(F.struct(*raw.columns))))
    raw.select(body).write.text(path)
    rejected = split_valid(src.read_requests_json(spark, path))[1]
    return rejected.select("request_id", F.array_join("errors", "; ").alias("errors"), c("source.text").alias("text"),
                           (c("source.line") > 0).alias("has_line"))


def unreadable_requests_sql() -> str:
    return f"""
SELECT CASE WHEN request_id % 9 NOT IN (4, 5) THEN request_id END AS request_id,
  CASE WHEN request_id % 9 IN (4, 5) THEN 'body: not a JSON object that fits the request' ELSE errors END AS errors,
  CASE request_id % 9 WHEN 4 THEN '{{"request_id": ' || request_id WHEN 5 THEN 'not json ' || request_id END AS text,
  TRUE AS has_line
FROM ({O.request_validation()}) WHERE NOT valid OR request_id % 9 IN (4, 5)"""


def enriched_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 then S2: the enriched catalog written and scanned again."""
    path = _scratch(spark, "enriched")
    src.write_catalog(_enriched(spark, sf_dir), path)
    return _flat_enriched(src.read_enhanced_catalog(spark, path))


def request_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies written as JSON lines and read with the schema."""
    path = _scratch(spark, "requests")
    raw = raw_requests_view(src.read_table(spark, sf_dir, "customer"))
    raw.write.json(path)
    d = with_defaults(src.read_requests_json(spark, path))
    iu, cl, w = c("intended_use"), c("cost_limiter"), c("weights")
    return d.select(
        "request_id", F.array_join("brand_preferences", ",").alias("brand_preferences"),
        *[iu[n].alias(n) for n in ("easy_runs", "tempo_runs", "long_runs")], F.array_join(iu["races"], ",").alias("races"),
        iu["trail"].alias("trail"), cl["enabled"].alias("enabled"), F.round(cl["max_usd"], 6).alias("max_usd"),
        "num_recommendations", "allow_carbon",
        *[w[n].alias(f"w_{n}") for n in ["brand", "budget", "easy_runs", "tempo_runs", "long_runs", "races"]])


def domain_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option lists, each with the requests that chose it."""
    races = prepare_requests(_requests(spark, sf_dir)).select(F.explode("r_races").alias("value"))
    chosen = races.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return domain_lists(spark).join(chosen, "value", "left").select(
        "list", "pos", "value", F.coalesce("n", F.lit(0)).alias("n_requests"))


def domain_options_sql() -> str:
    return O.with_ctes(O.REQUESTS) + """
, options(list, pos, value) AS (VALUES ('race_distance', 0, '5k'), ('race_distance', 1, '10k'),
  ('race_distance', 2, 'half_marathon'), ('race_distance', 3, 'marathon'), ('race_distance', 4, 'ultra'),
  ('use_category', 0, 'easy_runs'), ('use_category', 1, 'tempo_runs'), ('use_category', 2, 'long_runs'),
  ('use_category', 3, 'races'), ('use_category', 4, 'trail')),
chosen AS (SELECT value, count(*) AS n FROM (SELECT unnest(r_races) AS value FROM requests) GROUP BY value)
SELECT list, pos, value, coalesce(n, 0) AS n_requests FROM options LEFT JOIN chosen USING (value)"""


def shortlist_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each shortlist."""
    market = _market(spark, sf_dir)
    rows = shortlist(_requests(spark, sf_dir), _catalog(spark, sf_dir), market, with_tags=False)
    return preview(rows).select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos")


def shortlist_preview_sql() -> str:
    return O.with_ctes(*O.ENHANCED_BASE) + """
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos FROM ranked WHERE rank <= 5"""


def use_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 for every request."""
    return prepare_requests(_requests(spark, sf_dir)).select("request_id", T.use_case_text().alias("uses"))


def use_labels_sql() -> str:
    return O.with_ctes(O.REQUESTS) + """
SELECT request_id, coalesce(nullif(array_to_string(list_filter(list_value(CASE WHEN r_easy THEN 'Easy runs' END,
  CASE WHEN r_tempo THEN 'Tempo runs' END, CASE WHEN r_long THEN 'Long runs' END,
  CASE WHEN len(r_races) > 0 THEN 'Racing' END, CASE WHEN r_trail THEN 'Trail' END), lambda x: x IS NOT NULL), ', '),
  ''), 'General running') AS uses FROM requests"""


def first_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl that stops after ``MAX_PRODUCTS`` (the limit is the feature)."""
    part = src.read_table(spark, sf_dir, "part")
    built = cat.build_catalog(listing_anchors_view(part), product_pages_view(part), max_products=MAX_PRODUCTS)
    return built.select("catalog_pos", "brand", "model", "price_usd")


def first_products_sql() -> str:
    rows = O.ROWS.replace("FROM crawl_rows\n",
                          f"FROM (SELECT * FROM crawl_rows ORDER BY page_no, anchor_idx LIMIT {MAX_PRODUCTS})\n")
    return O.with_ctes(O.ANCHORS, O.CARDS, O.PAGES, O.SPECS, rows) + """
SELECT catalog_pos, brand, model, price_usd FROM built"""


def first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enrichment of the first ``MAX_ITEMS`` products (the limit is the
    feature)."""
    return _flat_enriched(_enriched(spark, sf_dir, MAX_ITEMS))


def first_items_sql() -> str:
    return f"SELECT * FROM ({O.enriched_catalog()}) ORDER BY catalog_pos LIMIT {MAX_ITEMS}"


def size_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17 with a size: availability and sale price instead of specs."""
    part = src.read_table(spark, sf_dir, "part")
    built = cat.build_catalog(listing_anchors_view(part), product_pages_view(part), size="10")
    return built.select("catalog_pos", "brand", "model", "price_usd", "sale_price_usd", "size_checked",
                        "available_for_size", "plate", F.array_join("category", ",").alias("category"))


def size_catalog_sql() -> str:
    return f"""
WITH b AS ({O.catalog_dedup()}), s AS ({O.size_availability()}), p AS ({O.price_pairs()}),
a AS ({O.with_ctes(O.ANCHORS, O.CARDS)} SELECT page_no, anchor_idx, CASE WHEN starts_with(canonical, '/')
  THEN 'https://shop.example.com' || canonical ELSE canonical END AS url FROM cards)
SELECT b.catalog_pos, b.brand, b.model, b.price_usd, p.sale_price AS sale_price_usd, '10' AS size_checked,
  coalesce(s.available_for_size, false) AS available_for_size, 'none' AS plate, 'daily' AS category
FROM b JOIN a USING (page_no, anchor_idx) LEFT JOIN s USING (url) LEFT JOIN p USING (url)"""


def unpriced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth product has no price and scores the fixed middle."""
    catalog = _catalog(spark, sf_dir).withColumn("price_usd", F.when(c("catalog_pos") % 9 != 0, c("price_usd")))
    market = _market(spark, sf_dir)
    rows = shortlist(_requests(spark, sf_dir), catalog, market, with_tags=False)
    return rows.select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos",
                       c("price_usd").isNull().alias("unpriced"), F.round("original_score", 6).alias("original_score"))


def _unpriced(cte: str) -> str:
    return cte.replace("catalog AS (", "priced AS (", 1) + """,
catalog AS (
  SELECT * REPLACE (CASE WHEN catalog_pos % 9 <> 0 THEN price_usd END AS price_usd) FROM priced
)"""


def unpriced_scores_sql() -> str:
    return O.with_ctes(_unpriced(O.CATALOG), *O.ENHANCED_BASE[1:]) + """
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos, price_usd IS NULL AS unpriced,
  round(original_score, 6) AS original_score FROM ranked"""


def shortlist_enriched_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10-W13 into the market context and on into the shortlist."""
    market = cut_lineage(en.market_from_enhanced(_enriched(spark, sf_dir)))
    rows = shortlist(_requests(spark, sf_dir), _catalog(spark, sf_dir), market, with_tags=False)
    return rows.select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos", "mk_review_count",
                       F.round("mk_rating", 6).alias("mk_rating"), F.round("adjusted_score", 6).alias("adjusted_score"))


MARKET_OF_ENRICHED = """
market AS (
  SELECT brand, model, review_count, average_rating AS rating, popularity_score FROM enriched
  QUALIFY row_number() OVER (PARTITION BY brand, model ORDER BY catalog_pos DESC) = 1
)"""


def shortlist_enriched_market_sql() -> str:
    return O.with_ctes(O.CATALOG, O.REQUESTS, O.SEARCH, O.PAGES, O.ENHANCED, MARKET_OF_ENRICHED, O.PRODUCTS,
                       O.ENHANCED_SCORED) + """
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos, mk_review_count, round(mk_rating, 6) AS mk_rating,
  round(adjusted_score, 6) AS adjusted_score FROM ranked"""


def tech_lookup_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 with description and features, from the enriched catalog, and the
    T13 text for when no model answers."""
    e = _enriched(spark, sf_dir).withColumns({"description": c("enhanced_data.description"),
                                              "features": c("enhanced_data.features")})
    lookups = tech_lookups_view(src.read_table(spark, sf_dir, "part"))
    out = pr.technical_lookup(lookups, e)
    spare = lookups.join(_catalog(spark, sf_dir).drop("brand", "model").hint("merge"), c("lookup_id") == c("catalog_pos")).select(
        "lookup_id", T.technical_fallback(c("focus_area")).alias("spare"))
    return out.join(spare.hint("merge"), "lookup_id").select("lookup_id", "found", F.md5("text").alias("text_md5"),
                                               F.md5("spare").alias("fallback_md5"))


def tech_lookup_enriched_sql() -> str:
    from shortlist.schemas import TECHNICAL_TEMPLATE
    extra = (f"CASE WHEN coalesce(description, '') <> '' THEN 'Description: ' || substr(description, 1, 200) || '...' END, "
             f"CASE WHEN len(features) > 0 THEN 'Key Features: ' || array_to_string(features[1:3], ', ') END")
    details = O.SHOE_DETAILS.replace("), lambda x: x IS NOT NULL)", f", {extra}), lambda x: x IS NOT NULL)")
    text = (f"CASE WHEN found THEN replace(replace({O.sql_str(TECHNICAL_TEMPLATE)}, '{{shoe_details}}', "
            f"{details}), '{{focus_area}}', focus_area) ELSE 'Shoe ' || l_brand || ' ' || l_model || "
            f"' not found in catalog.' END")
    v = O._v
    spare = (f"'Technical analysis temporarily unavailable. This ' || l_brand || ' ' || l_model || ' features ' || "
             f"coalesce(plate, 'standard') || ' technology with ' || coalesce({v('weight_g')}, 'moderate') || "
             f"'g weight and ' || coalesce({v('drop_mm')}, 'standard') || 'mm drop for ' || focus_area || ' optimization.'")
    return O.with_ctes(O.CATALOG, O.SEARCH, O.PAGES, O.ENHANCED) + f"""
, lookups AS (
  SELECT CAST(p_partkey AS BIGINT) AS lookup_id,
    {O.BRAND_LIST}[CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 13 + 1] AS l_brand,
    CASE WHEN p_partkey % 4 = 3 THEN p_name || ' X' ELSE p_name END AS l_model,
    CASE WHEN p_partkey % 3 = 0 THEN 'durability' ELSE 'performance' END AS focus_area FROM part
),
full_catalog AS (
  SELECT c.*, e.description, e.features FROM catalog c JOIN enriched e USING (catalog_pos)
),
j AS (
  SELECT *, catalog_pos IS NOT NULL AS found FROM lookups l
  LEFT JOIN full_catalog c ON l.l_brand = c.brand AND l.l_model = c.model
  QUALIFY row_number() OVER (PARTITION BY lookup_id ORDER BY catalog_pos NULLS LAST) = 1
),
texts AS (SELECT lookup_id, found, md5({text}) AS text_md5 FROM j),
spares AS (SELECT lookup_id, md5({spare}) AS fallback_md5 FROM lookups JOIN catalog ON lookup_id = catalog_pos)
SELECT lookup_id, found, text_md5, fallback_md5 FROM texts JOIN spares USING (lookup_id)"""


def request_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request summary of the result page."""
    reqs = prepare_requests(_requests(spark, sf_dir))
    return reqs.select("request_id", *[x.alias(n) for n, x in T.request_labels().items()])


def request_labels_sql() -> str:
    return O.with_ctes(O.REQUESTS) + """
SELECT request_id, CASE WHEN coalesce(len(r_prefs) > 0, false) THEN array_to_string(r_prefs, ', ')
    ELSE 'Any brand' END AS brands_label,
  CASE WHEN r_allow_carbon THEN 'Included' ELSE 'Excluded' END AS carbon_label,
  coalesce(nullif(array_to_string(list_filter(list_value(CASE WHEN r_easy THEN 'Easy Runs' END,
    CASE WHEN r_tempo THEN 'Tempo Runs' END, CASE WHEN r_long THEN 'Long Runs' END,
    CASE WHEN len(r_races) > 0 THEN 'Races' END, CASE WHEN r_trail THEN 'Trail' END), lambda x: x IS NOT NULL), ', '),
    ''), 'General running') AS use_label,
  CASE WHEN r_limiter THEN '$' || CAST(r_max_usd AS VARCHAR) ELSE 'No limit' END AS budget_label FROM requests"""


def _late(request_id, turn):
    """Seconds from a request to a reply: some replies are late."""
    return (request_id * 7 + turn) % 6 * 4


def streamed_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 and T15 as replies arrive: each request asked at its own second,
    each reply some seconds later, beyond the limit or never."""
    begin = F.lit("2026-01-01 00:00:00").cast("timestamp")

    def after(seconds):
        return F.timestamp_seconds(F.unix_timestamp(begin) + seconds)

    asked = _requests(spark, sf_dir).select("request_id", after(c("request_id")).alias("asked_at"),
                                            c("num_recommendations").alias("n_items"))
    replies = llm_replies_view(src.read_table(spark, sf_dir, "conversations"))
    replies = replies.withColumn("replied_at", after(c("request_id") + _late(c("request_id"), c("turn"))))
    return explain_to_completion(spark, asked, replies).select(
        "request_id", "rank", "has_reply", F.md5("why_llm").alias("why_llm_md5"))


def streamed_explanations_sql() -> str:
    return O.final_explanations_of(
        O.with_ctes(O.REQUESTS, O.REPLIES, O.PARSED) + """
, ranked AS (SELECT request_id, CAST(unnest(range(1, r_n + 1)) AS INTEGER) AS rank FROM requests)""",
        "(SELECT * FROM parsed WHERE (request_id * 7 + turn) % 6 * 4 <= 12)", "")


def fallback_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a shortlist says when no analysis answers."""
    market = _market(spark, sf_dir)
    rows = shortlist(_requests(spark, sf_dir), _catalog(spark, sf_dir), market, with_tags=False)
    return rows.select("request_id", c("rank").cast("int").alias("rank"),
                       T.rule_explanation(c("rank")).alias("explanation"),
                       F.when(c("rank") >= 2, T.comparison_fallback(c("rank"))).alias("comparison"))


def fallback_explanations_sql() -> str:
    return O.with_ctes(*O.ENHANCED_BASE) + """
SELECT request_id, CAST(rank AS INTEGER) AS rank,
  'This ' || brand || ' ' || model || ' is recommended for your use case based on its ' || coalesce(plate, 'None') ||
  ' construction and [' || array_to_string(list_transform(category, lambda x: chr(39) || x || chr(39)), ', ') ||
  '] design. **RECOMMENDATION #' || CAST(rank AS VARCHAR) || '**: ' ||
  CASE WHEN rank = 1 THEN 'Top choice' ELSE 'Strong alternative option' END || ' with specific advantages.' AS explanation,
  CASE WHEN rank >= 2 THEN 'Comparative analysis temporarily unavailable. All ' || CAST(rank AS VARCHAR) ||
    ' shoes meet your basic requirements with varying strengths in different areas.' END AS comparison
FROM ranked"""


QUERIES = {
    "catalog_roundtrip": (catalog_roundtrip, catalog_roundtrip_sql()),
    "catalog_array_scan": (catalog_array_scan, catalog_array_scan_sql()),
    "catalog_replace": (catalog_replace, catalog_replace_sql()),
    "unreadable_requests": (unreadable_requests, unreadable_requests_sql()),
    "enriched_roundtrip": (enriched_roundtrip, O.enriched_catalog()),
    "request_roundtrip": (request_roundtrip, O.request_defaults()),
    "domain_options": (domain_options, domain_options_sql()),
    "shortlist_preview": (shortlist_preview, shortlist_preview_sql()),
    "use_labels": (use_labels, use_labels_sql()),
    "first_products": (first_products, first_products_sql()),
    "first_items": (first_items, first_items_sql()),
    "size_catalog": (size_catalog, size_catalog_sql()),
    "unpriced_scores": (unpriced_scores, unpriced_scores_sql()),
    "shortlist_enriched_market": (shortlist_enriched_market, shortlist_enriched_market_sql()),
    "request_labels": (request_labels, request_labels_sql()),
    "streamed_explanations": (streamed_explanations, streamed_explanations_sql()),
    "fallback_explanations": (fallback_explanations, fallback_explanations_sql()),
    "tech_lookup_enriched": (tech_lookup_enriched, tech_lookup_enriched_sql()),
}
