"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
whole driver tables. Arrays are flattened to strings and doubles rounded to
6 places in the published projection, identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions import scoring as sc
from shortlist.functions import text as T
from shortlist.operators import response as resp
from shortlist.operators.requests import coerce_form, validation_errors, with_defaults
from shortlist import schemas as S
from shortlist.plans import branches
from shortlist.plans import oracle as O
from shortlist.plans.recommend import shortlist, shortlist_basic
from shortlist.session import cut_lineage
from shortlist.sources.tables import landed_product_pages, page_anchors, page_links, read_table
from shortlist.functions import extract as X
from shortlist.operators import catalog as cat
from shortlist.operators import enrich as en
from shortlist.operators import prompts as pr
from shortlist.operators import replies as rp
from shortlist.operators.requests import prepare_requests
from shortlist.sources.views import (catalog_view, listing_anchors_view, llm_replies_view, market_view,
                                     marked_pages_view, paginated_view,
                                     product_pages_view, raw_forms_view, raw_requests_view, requests_view,
                                     search_results_view, tech_lookups_view, web_hits_view)

c = F.col


class Tables:
    """Lazy access to driver tables and the derived domain views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def catalog(self) -> DataFrame:
        return catalog_view(self.raw("part"))

    def requests(self) -> DataFrame:
        return requests_view(self.raw("customer"))

    def market(self) -> DataFrame:
        """Materialized once (reliable checkpoint): it aggregates the
        largest table, and size checks, the market flag and the plan all
        read it."""
        if not hasattr(self, "_market"):
            self._market = cut_lineage(market_view(self.raw("lineitem"), self.catalog()))
        return self._market


def r6(col: str) -> F.Column:
    return F.round(c(col), 6).alias(col)


def q_shortlist_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    out = shortlist(t.requests(), t.catalog(), t.market())
    return out.select(
        "request_id", c("rank").cast("int").alias("rank"), "catalog_pos", "brand", "model",
        F.array_join("category", ",").alias("categories"), "price_usd", "plate", "drop_mm",
        "weight_g", F.round("score", 6).alias("score"), r6("original_score"),
        r6("adjustment_multiplier"), F.array_join("score_adjustments", "|").alias("score_adjustments"))


def _enhanced(spark, sf_dir, **kw):
    t = Tables(spark, sf_dir)
    return t, shortlist(t.requests(), t.catalog(), t.market(), **kw)


def q_shortlist_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    out = shortlist_basic(t.requests(), t.catalog())
    return out.select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos", "brand", "model",
                      "price_usd", r6("score"), T.rule_reasons_basic().alias("why_rules"))


def q_rule_reasons_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = _enhanced(spark, sf_dir, with_tags=False)
    return out.select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos",
                      T.rule_reasons_enhanced().alias("why_rules"))


COMPONENTS = {"use_case_term": sc.use_case_term, "plate_term": sc.plate_term,
              "weight_term": sc.weight_term, "drop_term": sc.drop_term, "budget_term": sc.budget_term,
              "brand_term": sc.brand_term, "base_compatibility": sc.base_compatibility,
              "technical_advantage": sc.technical_advantage, "specialty_bonus": sc.specialty_bonus}


def q_score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2a-C2f, C3, C4, C5, C6 of every shortlisted pair (computed on the
    pairs, carried through the ranking)."""
    from shortlist.operators.candidates import market_flag
    t = Tables(spark, sf_dir)
    market = t.market()
    extra = {n: f() for n, f in COMPONENTS.items()}
    extra["market_positioning"] = sc.market_positioning(market_flag(market))
    extra["diversity_jitter"] = c("p_jitter")
    out = shortlist(t.requests(), t.catalog(), market, with_tags=False, extra_scores=extra)
    return out.select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos",
                      *[r6(n) for n in extra])


def q_score_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = _enhanced(spark, sf_dir)
    out = out.withColumn("ratio", sc.budget_ratio())
    return out.select(
        "request_id", c("rank").cast("int").alias("rank"), "catalog_pos",
        F.round(F.when(c("r_limiter"), c("ratio")), 6).alias("budget_ratio"),
        F.round(sc.blended_budget_multiplier(), 6).alias("budget_multiplier"),
        F.round(sc.market_multiplier(), 6).alias("market_multiplier"),
        F.round(F.when(c("r_has_races") & (c("plate") == "carbon"), F.lit(1.05)).otherwise(F.lit(1.0)), 6)
        .alias("carbon_multiplier"),
        r6("adjustment_multiplier"), r6("adjusted_score"),
        F.array_join("score_adjustments", "|").alias("score_adjustments"))


def q_response_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, out = _enhanced(spark, sf_dir, with_tags=False)
    notes = resp.response_notes(t.requests(), out)
    return notes.select("request_id", "n_items", "n_over_budget",
                        F.array_join("notes", " || ").alias("notes"))


def q_response_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoint end to end (``recommend``), flattened for comparison."""
    from shortlist.plans.recommend import recommend
    t = Tables(spark, sf_dir)
    nested = recommend(t.requests(), t.catalog(), t.market(), replies=_replies(spark, sf_dir),
                       web_hits=web_hits_view(t.raw("documents")), web_limit=2)
    return nested.select(
        "request_id", F.size("shortlist").alias("n_items"),
        F.array_join(F.transform("shortlist", lambda x: F.concat(x["brand"], F.lit(" "), x["model"])), ";")
        .alias("items"),
        c("inputs_echo.num_recommendations").alias("echo_num_recommendations"),
        F.array_join("notes", " || ").alias("notes"),
        F.array_join(F.transform("shortlist", lambda x: F.concat_ws(
            "/", F.round(x["score"], 4).cast("string"), x["price_usd"].cast("string"),
            F.coalesce(x["plate"], F.lit("-")), F.coalesce(x["drop_mm"].cast("string"), F.lit("-")),
            F.coalesce(x["weight_g"].cast("string"), F.lit("-")), F.array_join(x["category"], "+"))), ";")
        .alias("item_fields"),
        F.md5(F.array_join(F.transform("shortlist", lambda x: F.concat_ws(
            "#", x["why_rules"], x["why_llm"], F.array_join(x["sources"], ","))), "\n")).alias("texts_md5"))


def q_response_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = _enhanced(spark, sf_dir, with_tags=False)
    return resp.display_columns(out).select("request_id", c("rank").cast("int").alias("rank"),
                                            "score_pct", "over_budget_flag", "plate_label", "category_label",
                                            "price_label", "drop_label", "weight_label")


def q_request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_defaults(raw_requests_view(Tables(spark, sf_dir).raw("customer")))
    iu, cl, w = c("intended_use"), c("cost_limiter"), c("weights")
    return d.select(
        "request_id", F.array_join("brand_preferences", ",").alias("brand_preferences"),
        iu["easy_runs"].alias("easy_runs"), iu["tempo_runs"].alias("tempo_runs"),
        iu["long_runs"].alias("long_runs"), F.array_join(iu["races"], ",").alias("races"),
        iu["trail"].alias("trail"), cl["enabled"].alias("enabled"),
        F.round(cl["max_usd"], 6).alias("max_usd"), "num_recommendations", "allow_carbon",
        *[w[n].alias(f"w_{n}") for n in ["brand", "budget", "easy_runs", "tempo_runs", "long_runs",
                                          "races"]])


def q_request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_requests_view(Tables(spark, sf_dir).raw("customer"))
    errs = validation_errors(raw)
    return raw.select("request_id", (F.size(errs) == 0).alias("valid"),
                      F.array_join(errs, "; ").alias("errors"))


def q_rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.plans.recommend import rejected_requests
    out = rejected_requests(raw_requests_view(Tables(spark, sf_dir).raw("customer")))
    return out.select("request_id", F.array_join("errors", "; ").alias("errors"))


def q_form_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = coerce_form(raw_forms_view(Tables(spark, sf_dir).raw("customer")))
    iu, cl, w = c("intended_use"), c("cost_limiter"), c("weights")
    return req.select(
        "request_id", F.array_join("brand_preferences", ",").alias("brand_preferences"),
        iu["easy_runs"].alias("easy_runs"), iu["tempo_runs"].alias("tempo_runs"),
        iu["long_runs"].alias("long_runs"), F.array_join(iu["races"], ",").alias("races"),
        iu["trail"].alias("trail"), cl["enabled"].alias("enabled"), cl["max_usd"].alias("max_usd"),
        "num_recommendations", "allow_carbon",
        *[w[n].alias(f"w_{n}") for n in ["brand", "budget", "easy_runs", "tempo_runs", "long_runs",
                                          "races"]])


def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visible_text(c("html"))
    return Tables(spark, sf_dir).raw("pages").select(
        "page_id", F.length(v).alias("text_chars"), F.md5(v).alias("text_md5"))


def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    found = page_links(paginated_view(Tables(spark, sf_dir).raw("pages")), host)
    return found.select("page_id", F.size("links").alias("n_links"), F.array_join("links", " ").alias("links"))


def q_landed_product_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of element texts of product pages."""
    out = landed_product_pages(marked_pages_view(Tables(spark, sf_dir).raw("pages")))
    sizes = F.transform("size_options", lambda x: F.concat_ws(
        "/", x["text"], *[F.coalesce(x[n], F.lit("-")) for n in ("class", "aria_disabled", "parent_class")]))
    return out.select(
        "url", F.array_join("price_texts", "|").alias("price_texts"), F.array_join(sizes, "|").alias("size_options"),
        F.array_join("description_texts", "|").alias("description_texts"),
        F.array_join("review_count_texts", "|").alias("review_count_texts"),
        F.array_join("rating_texts", "|").alias("rating_texts"),
        F.array_join(F.transform("feature_lists", lambda x: F.array_join(x, ",")), "|").alias("feature_lists"))


def q_landed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_anchors(Tables(spark, sf_dir).raw("pages"))


def q_landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed_product_pages(Tables(spark, sf_dir).raw("pages")).select(
        "url", F.length("body_text").alias("text_chars"), F.md5("body_text").alias("text_md5"))


def _anchors(spark, sf_dir):
    return listing_anchors_view(Tables(spark, sf_dir).raw("part"))


def _pages(spark, sf_dir):
    return product_pages_view(Tables(spark, sf_dir).raw("part"))


def q_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.product_anchors(_anchors(spark, sf_dir)).select("page_no", "anchor_idx", "canonical")


def q_title_brand_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.product_cards(_anchors(spark, sf_dir)).select(
        "page_no", "anchor_idx", "title", "brand", "model", "product_url")


def q_price_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pp = X.price_pair(c("price_texts"))
    return _pages(spark, sf_dir).select("url", pp["price"].alias("price"), pp["sale_price"].alias("sale_price"))


def q_spec_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.specs(c("body_text"))
    return _pages(spark, sf_dir).select(
        "url", F.array_join(F.coalesce(s["category"], F.array(F.lit("daily"))), ",").alias("category"),
        F.coalesce(s["plate"], F.lit("none")).alias("plate"),
        *[s[n].alias(n) for n in ["drop_mm", "weight_g", "cushioning_level", "support_type",
                                  "heel_stack_mm", "forefoot_stack_mm"]],
        F.array_join(s["best_for_distances"], ",").alias("best_for_distances"),
        s["has_wide_options"].alias("has_wide_options"))


def q_size_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        "url", X.size_available(c("size_options"), F.lit("10")).alias("available_for_size"))


def _built(spark, sf_dir):
    return cat.build_catalog(_anchors(spark, sf_dir), _pages(spark, sf_dir))


def _summary(spark, sf_dir):
    rows = cat.assemble_rows(cat.product_cards(_anchors(spark, sf_dir)), _pages(spark, sf_dir))
    return cat.summary(cat.first_rows(rows.select(*cat.STATISTICS_COLS)))


def q_catalog_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).select(
        "catalog_pos", "brand", "model", "page_no", "anchor_idx",
        F.array_join("category", ",").alias("category"), "price_usd", "plate", "drop_mm", "weight_g")


def q_extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = cat.extraction_stats(_summary(spark, sf_dir), _anchors(spark, sf_dir))
    return st.select("pages", "products", "unique_products", "price_ok", "specs_ok", r6("price_rate"),
                     r6("specs_rate"))


def q_plate_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.plate_breakdown(_summary(spark, sf_dir)).select("plate", "count", r6("pct"))


def q_brand_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.brand_distribution(_summary(spark, sf_dir)).select("brand", "count", r6("pct"), "position")


def q_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.facets(_summary(spark, sf_dir)).select(F.array_join("brands", ",").alias("brands"),
                                                    "max_price", "n_brands")


def q_market_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).market().select("brand", "model", "review_count", r6("rating"),
                                                 r6("popularity_score"))


def q_market_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).market().agg((F.count(F.lit(1)) > 0).alias("has_market"),
                                              F.count(F.lit(1)).alias("n_market"))


def _enriched(spark, sf_dir):
    t = Tables(spark, sf_dir)
    part = t.raw("part")
    return en.enrich_catalog(t.catalog(), search_results_view(part), product_pages_view(part))


def q_page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return en.page_match(t.catalog(), search_results_view(t.raw("part")))


def q_enriched_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _enriched(spark, sf_dir)
    d = c("enhanced_data")
    return e.select("catalog_pos", "brand", "model", "web_source_url",
                    d["reviews"]["count"].alias("review_count"),
                    F.round(d["reviews"]["average_rating"], 6).alias("average_rating"),
                    d["description"].alias("description"),
                    F.array_join(d["features"], "|").alias("features"),
                    F.round(d["popularity_score"], 6).alias("popularity_score"))


def q_enrichment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.enrichment_summary(_enriched(spark, sf_dir))


def _short_full(spark, sf_dir):
    """Shortlist rows with every catalog attribute and the flat request."""
    t, out = _enhanced(spark, sf_dir, with_tags=False)
    extra = t.catalog().select("catalog_pos", "cushioning_level", "support_type", "heel_stack_mm",
                               "forefoot_stack_mm")
    return t, out.join(extra, "catalog_pos")


def q_candidate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = _short_full(spark, sf_dir)
    p = pr.candidate_prompts(rows, t.requests())
    return p.select("request_id", "n_candidates", "candidate_table", "inputs_json",
                    F.length("user_prompt").alias("prompt_chars"), F.md5("user_prompt").alias("user_prompt_md5"),
                    F.md5("system_prompt").alias("system_prompt_md5"))


def q_comparison_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = _enhanced(spark, sf_dir, with_tags=False)
    p = pr.comparison_prompts(rows, prepare_requests(t.requests()))
    return p.select("request_id", "n_shoes", "shoes_list", "user_requirements", "gate_text",
                    F.md5("prompt").alias("prompt_md5"))


def _web(spark, sf_dir, rows):
    return pr.web_context(rows, web_hits_view(Tables(spark, sf_dir).raw("documents")), limit=2)


def q_web_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _enhanced(spark, sf_dir, with_tags=False)
    ctx = _web(spark, sf_dir, rows)
    return ctx.select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos",
                      F.size("sources").alias("n_sources"), F.array_join("sources", " ").alias("sources"),
                      F.md5(T.web_findings_text(c("summaries"), c("sources"))).alias("findings_md5"))


def q_detail_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = _enhanced(spark, sf_dir, with_tags=False, written=True)  # read twice: prompts and web context
    reqs = prepare_requests(t.requests())
    d = pr.detail_prompts(rows.drop(*[x for x in rows.columns if x.startswith("r_") or x.startswith("w_")]),
                          reqs, _web(spark, sf_dir, rows))
    return d.select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos",
                    F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


def q_tech_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    out = pr.technical_lookup(tech_lookups_view(t.raw("part")), t.catalog())
    return out.select("lookup_id", "found", "catalog_pos", F.md5("text").alias("text_md5"))


def _replies(spark, sf_dir):
    return llm_replies_view(Tables(spark, sf_dir).raw("conversations"))


def q_reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rp.parse_replies(_replies(spark, sf_dir))
    return p.select("request_id", "turn", "method", F.size("items").alias("n_items"),
                    F.md5(F.array_join("items", " || ")).alias("items_md5"))


def q_reply_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply (turn) of a request aligned to its candidates by rank;
    the generic line where the list is shorter than the shortlist."""
    _, rows = _enhanced(spark, sf_dir, with_tags=False)
    parsed = rp.parse_replies(_replies(spark, sf_dir))
    a = rows.join(parsed.select("request_id", "turn", "items", "method"), "request_id", "left")
    picked = F.try_element_at(c("items"), c("rank").cast("int"))
    reply = F.when(c("items").isNotNull(), F.coalesce(picked, F.lit(S.GENERIC_REPLY)))
    return a.select("request_id", c("rank").cast("int").alias("rank"), "turn", "method", F.md5(reply).alias("reply_md5"),
                    (c("items").isNotNull() & picked.isNull()).alias("generic_fill"))


def q_final_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _enhanced(spark, sf_dir, with_tags=False)
    out = rp.final_explanations(rows, _replies(spark, sf_dir))
    return out.select("request_id", c("rank").cast("int").alias("rank"), "catalog_pos",
                      c("reply").isNotNull().alias("has_reply"), F.md5("why_llm").alias("why_llm_md5"))


def q_explanation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15 on assistant texts; by conv_id one in six is blank, and others end
    with a generic sentence or with one to three technical words."""
    conv = Tables(spark, sf_dir).raw("conversations").filter(c("role") == "assistant")
    kind = c("conv_id") % 6
    text = (F.when(kind == 0, F.lit("  ")).when(kind == 1, F.concat("text", F.lit(" Carbon.")))
            .when(kind == 2, F.concat("text", F.lit(" Carbon, low drop.")))
            .when(kind == 3, F.concat("text", F.lit(" Carbon, low drop, light weight.")))
            .when(kind == 4, F.concat("text", F.lit(" " + S.GENERIC_REPLY))).otherwise(c("text")))
    return conv.select(c("conv_id").cast("bigint").alias("conv_id"), c("turn").cast("bigint").alias("turn"),
                       sc.explanation_quality(text).alias("quality_multiplier"))


def q_explanation_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    conv = t.raw("conversations").filter(c("role") == "assistant").select("conv_id", "turn", "text")
    reqs = prepare_requests(t.requests()).select("request_id", "r_limiter", "r_max_usd")
    j = (conv.join(t.catalog(), c("catalog_pos") == c("conv_id"), "left")
         .join(reqs, c("request_id") == c("conv_id"), "left"))
    norm = rp.collapse_spaces(F.coalesce(c("text"), F.lit("")))
    return j.select(c("conv_id").cast("bigint").alias("conv_id"), c("turn").cast("bigint").alias("turn"),
                    rp.sentence_count(norm).alias("n_sentences"),
                    F.md5(rp.ensure_depth(c("text"))).alias("text_md5"))


def q_shortlist_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the requests streamed in micro-batches through the same plan;
    the result must equal ``shortlist_enhanced``."""
    from shortlist.streaming.requests_stream import run_to_completion
    t = Tables(spark, sf_dir)
    out = run_to_completion(spark, t.requests(), t.catalog(), t.market())
    return out.select(
        "request_id", c("rank").cast("int").alias("rank"), "catalog_pos", "brand", "model",
        F.array_join("category", ",").alias("categories"), "price_usd", "plate", "drop_mm",
        "weight_g", F.round("score", 6).alias("score"), r6("original_score"),
        r6("adjustment_multiplier"), F.array_join("score_adjustments", "|").alias("score_adjustments"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "shortlist_enhanced": (q_shortlist_enhanced, O.shortlist_enhanced()),
    "shortlist_basic": (q_shortlist_basic, O.shortlist_basic()),
    "rule_reasons_enhanced": (q_rule_reasons_enhanced, O.rule_reasons_enhanced()),
    "score_components": (q_score_components, O.score_components()),
    "score_audit": (q_score_audit, O.score_audit()),
    "response_notes": (q_response_notes, O.response_notes()),
    "response_nested": (q_response_nested, O.response_nested()),
    "response_display": (q_response_display, O.response_display()),
    "request_defaults": (q_request_defaults, O.request_defaults()),
    "request_validation": (q_request_validation, O.request_validation()),
    "rejected_requests": (q_rejected_requests, O.rejected_requests()),
    "form_coercion": (q_form_coercion, O.form_coercion()),
    "page_text": (q_page_text, O.page_text()),
    "page_links": (q_page_links, O.page_links()),
    "landed_anchors": (q_landed_anchors, O.landed_anchors()),
    "landed_pages": (q_landed_pages, O.landed_pages()),
    "landed_product_lists": (q_landed_product_lists, O.landed_product_lists()),
    "canonical_urls": (q_canonical_urls, O.canonical_urls()),
    "title_brand_model": (q_title_brand_model, O.title_brand_model()),
    "price_pairs": (q_price_pairs, O.price_pairs()),
    "spec_extraction": (q_spec_extraction, O.spec_extraction()),
    "size_availability": (q_size_availability, O.size_availability()),
    "catalog_dedup": (q_catalog_dedup, O.catalog_dedup()),
    "extraction_stats": (q_extraction_stats, O.extraction_stats()),
    "plate_breakdown": (q_plate_breakdown, O.plate_breakdown()),
    "brand_distribution": (q_brand_distribution, O.brand_distribution()),
    "facets": (q_facets, O.facets()),
    "market_context": (q_market_context, O.market_context()),
    "market_flag": (q_market_flag, O.market_flag()),
    "page_match": (q_page_match, O.page_match()),
    "enriched_catalog": (q_enriched_catalog, O.enriched_catalog()),
    "enrichment_summary": (q_enrichment_summary, O.enrichment_summary()),
    "candidate_prompts": (q_candidate_prompts, O.candidate_prompts()),
    "comparison_prompts": (q_comparison_prompts, O.comparison_prompts()),
    "web_context": (q_web_context, O.web_context()),
    "detail_prompts": (q_detail_prompts, O.detail_prompts()),
    "tech_lookup": (q_tech_lookup, O.tech_lookup()),
    "reply_parsing": (q_reply_parsing, O.reply_parsing()),
    "reply_alignment": (q_reply_alignment, O.reply_alignment()),
    "final_explanations": (q_final_explanations, O.final_explanations()),
    "explanation_quality": (q_explanation_quality, O.explanation_quality()),
    "explanation_depth": (q_explanation_depth, O.explanation_depth()),
    "shortlist_stream": (q_shortlist_stream, O.shortlist_enhanced()),
    **branches.QUERIES,
}
