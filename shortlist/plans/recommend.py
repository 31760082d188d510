"""End-to-end recommendation plans.

``shortlist``: requests (x) catalog -> F6 -> C2..C8 -> C9..C13 -> W2 -> T18.
Ranking runs on narrow rows (ids and scores); product attributes and request
fields are joined back to the at most 20 survivors per request, so the wide
columns never pass through the ranking sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.functions import scoring as sc
from shortlist.functions import text as _text
from shortlist.operators.bounds import likely_alike, reaching_floor
from shortlist.operators.candidates import broadcastable, candidate_pairs, conf_int, market_flag, with_market
from shortlist.operators.ranking import (basic_order, enhanced_order, over_budget_quota,
                                         top_n_per_request)
from shortlist.operators.reach import reachable
from shortlist.operators.requests import prepare_requests, split_valid
from shortlist.session import cut_lineage

c = F.col

SCORING_COLS = ["catalog_pos", "brand", "model", "category", "price_usd", "plate", "drop_mm",
                "weight_g"]
#: Requests times products from which on blocks cost less than all pairs.
MIN_BLOCK_PAIRS = 400_000_000


def _attach(ranked: DataFrame, catalog: DataFrame, cols: list[str]) -> DataFrame:
    """Join product attributes back to ranked rows by catalog_pos; broadcast
    only when the catalog's size is checked to be bounded."""
    right = catalog.select("catalog_pos", *[x for x in cols if x != "catalog_pos"])
    if broadcastable(right)[0]:
        right = F.broadcast(right)
    return ranked.join(right, "catalog_pos")


def _many_pairs(requests: DataFrame, catalog: DataFrame) -> bool:
    return requests.count() * catalog.count() >= conf_int(requests, "shortlist.blocks.minPairs", MIN_BLOCK_PAIRS)


def scored_candidates(requests: DataFrame, catalog: DataFrame, market: DataFrame | None = None,
                      strategy: str | None = None, prepared: DataFrame | None = None) -> DataFrame:
    """Pairs passing F6 with C7/C8 score, C9-C12 multiplier and the
    adjusted score (C13). Keeps request and product columns. The strategy
    ``blocks`` leaves out pairs that cannot be among a request's first ones; it
    is taken from ``shortlist.blocks.minPairs`` requests times products on."""
    reqs = sc.request_gates(prepared if prepared is not None else prepare_requests(requests))
    products = sc.product_features(with_market(catalog.select(*SCORING_COLS), market))
    if strategy is None and _many_pairs(reqs, catalog):
        strategy = "blocks"
    if strategy == "blocks":
        flag = F.lit(market is not None and not market.isEmpty())  # read by several jobs
        return reaching_floor(sc.score_pairs(likely_alike(reqs, products, flag), flag))
    flag = market_flag(market)
    return sc.score_pairs(candidate_pairs(reqs, products, enhanced=True, strategy=strategy), flag)


REQUEST_FLAGS = ["r_limiter", "r_max_usd", "r_has_races", "r_tempo", "r_easy", "w_budget"]


def shortlist(requests: DataFrame, catalog: DataFrame, market: DataFrame | None = None,
              strategy: str | None = None, with_tags: bool = True,
              extra_scores: dict | None = None, written: bool = False) -> DataFrame:
    """The enhanced shortlist: one row per (request, rank), rank <= n.

    Only ids and scores pass through the ranking sort (the only operator
    that sees every candidate pair); request flags, product attributes,
    market columns and the audit tags are joined to the <= 20 survivors.
    ``extra_scores`` (name -> Column over the scored pairs) are carried
    through the ranking, e.g. the score components. Invalid requests (R3) get
    no rows, see ``rejected_requests``. For rows that are read several times the
    ranking can be ``written``: its narrow rows, to which the rest is joined at
    each read."""
    prepared = prepare_requests(split_valid(requests)[0])
    scored = scored_candidates(requests, catalog, market, strategy, prepared=prepared)
    extra = dict(extra_scores or {})
    if extra:
        scored = scored.select("*", *[col.alias(name) for name, col in extra.items()])
    keep = ["request_id", "catalog_pos", "r_n", "original_score", "adjustment_multiplier",
            "adjusted_score"] + list(extra)
    ranked = top_n_per_request(scored.select(*keep), enhanced_order(), c("r_n")).drop("r_n")
    if written:
        ranked = cut_lineage(ranked)
    ranked = ranked.join(prepared.select("request_id", *REQUEST_FLAGS), "request_id")
    products = with_market(catalog.select("catalog_pos", "brand", "model", "category", "price_usd",
                                          "plate", "drop_mm", "weight_g"), market)
    out = _attach(ranked, products, products.columns)
    if with_tags:
        out = (out.withColumn("ratio", sc.budget_ratio())
               .withColumn("score_adjustments", sc.adjustment_tags()).drop("ratio"))
    # Q4: rank on the raw adjusted score, publish it clamped to [0, 1].
    return out.withColumn("score", sc.clamp(c("adjusted_score"), 0.0, 1.0))


def shortlist_basic(requests: DataFrame, catalog: DataFrame, strategy: str | None = None) -> DataFrame:
    """Basic engine: F1 + F3, over-budget quota F5, C1 score, W1 top-N.
    Invalid requests (R3) get no rows, see ``rejected_requests``. The strategy
    ``reach`` leaves out products that no request can keep; it is taken from
    ``shortlist.blocks.minPairs`` requests times products on."""
    reqs = prepare_requests(split_valid(requests)[0])
    products = sc.product_features(catalog.select(*SCORING_COLS))
    if strategy is None and _many_pairs(reqs, catalog):
        strategy = "reach"
    if strategy == "reach":
        pairs = candidate_pairs(reqs, products, enhanced=False, offers=reachable(products.drop("category", "model")))
    else:
        pairs = candidate_pairs(reqs, products, enhanced=False, strategy=strategy)
    pairs = pairs.withColumn("ratio", sc.budget_ratio())
    over = F.coalesce(c("r_limiter") & (c("price_usd") > c("r_max_usd")), F.lit(False))
    scored = pairs.select("request_id", "catalog_pos", "r_n", over.alias("_over"), sc.basic_score().alias("score"))
    ranked = top_n_per_request(over_budget_quota(scored), basic_order(), c("r_n")).drop("r_n")
    ranked = ranked.join(reqs.select("request_id", *REQUEST_FLAGS), "request_id")
    return _attach(ranked, catalog, ["brand", "model", "category", "price_usd", "plate",
                                     "drop_mm", "weight_g"])


def rejected_requests(requests: DataFrame) -> DataFrame:
    """request_id and error codes of the requests that are not answered."""
    return split_valid(requests)[1]


def recommend(requests: DataFrame, catalog: DataFrame, market: DataFrame | None = None,
              replies: DataFrame | None = None, web_hits: DataFrame | None = None,
              strategy: str | None = None, web_limit: int = 1) -> DataFrame:
    """The whole endpoint as one plan: one response row per request with
    the echoed request, the ranked items (``why_rules`` from T2, ``why_llm``
    from the replies table or the fallback text, ``sources`` from the web
    context of ranks <= 2) and the notes (A10, T16, T18). Only valid requests
    are answered; ``rejected_requests`` gives the others with their errors.
    The ranking (at most 20 narrow rows a request) is written once, as
    items, notes and web context all read it."""
    from shortlist.functions.text import rule_reasons_enhanced
    from shortlist.operators import prompts as pr
    from shortlist.operators import replies as rp
    from shortlist.operators.response import nested_response
    requests = split_valid(requests)[0]
    rows = shortlist(requests, catalog, market, strategy=strategy, with_tags=False, written=True)
    rows = rows.withColumn("why_rules", rule_reasons_enhanced())
    if replies is not None:
        rows = rp.final_explanations(rows, replies).drop("reply")
    else:
        rows = rows.withColumn("why_llm", _text.explanation_with_fallback(F.lit(None).cast("string"), c("rank")))
    if web_hits is not None:
        ctx = pr.web_context(rows, web_hits, limit=web_limit).select("request_id", "rank", "sources")
        rows = rows.join(ctx, ["request_id", "rank"], "left").withColumn(
            "sources", F.coalesce(c("sources"), F.array().cast("array<string>")))
    return nested_response(requests, rows)
