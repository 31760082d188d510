"""Top-N without scoring every pair (J1 + W2): score bounds for a tree of
product blocks.

A block holds products that are offered under one brand (or under "any brand")
and have one mask of use tags, kind of plate, market class and band of prices;
its children split it by classes of weight and drop, theirs by finer bands of
prices and by the terms that come from the brand and the price. What a score
takes from a block's keys is exact; of the rest (weight and drop coefficients,
specialty terms, jitter) a block keeps the best and the worst value, and of
prices both ends, as the price terms rise or fall with the price. The sum of the
best terms, in the order of the score's own additions, is no less than any
product's score, to the last bit, since every step is monotone in floating point,
too.

1. Each request meets the upper blocks instead of the products (the same equi
   join) and follows the highest bounds down the tree, at each level as many
   blocks as hold the products it wants and at least ``BEAM``.
2. The products found there are scored; the N-th of them in the ranking's own
   order is the request's floor.
3. From the top again, each request follows all blocks whose bound reaches its
   floor, and the products of the last level are scored. No other product can be
   among the first N: ties go by the original score and the place in the catalog,
   of which a block keeps the best ones, too.

Products that agree in all that a score reads score alike for every request, so
they are scored once and stand for their first rows in the catalog, as many as a
request may want (``scored_alike``).

How many blocks there are depends on the classes, hardly on the number of
products. Each of the two passes is one job over requests dealt by row; the
request's columns are merged in anew at each level, so that the generated methods
stay small enough to be compiled. Blocks and products are broadcast behind a size
check, else joined by a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.functions import scoring as sc
from shortlist.functions.predicates import USE_TAGS, carbon_ok
from shortlist.operators.candidates import KEY, broadcastable, conf_int, product_keys, request_keys
from shortlist.operators.ranking import enhanced_order
from shortlist.schemas import MAX_RECOMMENDATIONS
from shortlist.session import cut_lineage

c = F.col

PRICE_BANDS, FINE_BANDS = 4, 16
#: Blocks that a request follows at least while it looks for its floor.
BEAM = 3
#: Requests that a task takes.
REQUESTS_PER_TASK = 5_000
TIERS = ["p_tier_races", "p_tier_long", "p_tier_easy"]
TOP = ["b_plate", "b_market", "b_band"]
BLOCK = ["b_brand", "b_mask", *TOP]
#: What tells the blocks of each level apart, beside the keys of the level above.
LEVELS = [[*KEY, *TOP], ["b_weight", "b_drop"], ["b_fine", "p_price_term", *TIERS]]


def _zero() -> Column:
    return F.lit(0.0)


def _coefficients() -> dict[str, Column]:
    """What a product's weight and drop are worth, by the request weight that
    they are multiplied with."""
    w, d = c("weight_g"), c("drop_mm")
    firm = d.isNotNull() & (d != 0)
    parts = {
        "weight_races": F.when(w < 200, 0.15).when(w < 220, 0.12).when(w < 240, 0.08).when(w > 280, -0.1),
        "weight_long": F.when((w >= 240) & (w <= 280), 0.08).when(w > 320, -0.05),
        "weight_easy": F.when((w >= 250) & (w <= 320), 0.06).when(w > 350, -0.08),
        "drop_races": F.when(d <= 4, 0.06).when(d <= 6, 0.04).when(d > 10, -0.03),
        "drop_easy": F.when((d >= 8) & (d <= 12), 0.04),
        "tech_races": F.when(firm & (d <= 6), 0.1), "tech_easy": F.when(firm & (d >= 8) & (d <= 12), 0.1),
    }
    return {n: F.coalesce(x, _zero()) for n, x in parts.items()}


def _steps(x: Column, edges: list[Column]) -> Column:
    """How many of the conditions hold; -1 where ``x`` is null."""
    return F.when(x.isNull(), F.lit(-1)).otherwise(
        sum((F.when(e, F.lit(1)).otherwise(F.lit(0)) for e in edges), F.lit(0)))


def with_blocks(products: DataFrame, edges: list[float]) -> DataFrame:
    """Products (``scoring.product_features``) with the keys of their blocks."""
    mask = sum((F.when(c(f"p_{t}"), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(USE_TAGS)), F.lit(0))
    price, w, d = c("price_usd"), c("weight_g"), c("drop_mm")
    per_band = FINE_BANDS // PRICE_BANDS
    return products.withColumns({
        "b_brand": F.coalesce(F.concat(F.lit("="), c("brand")), F.lit("")), "b_mask": mask,
        "b_plate": F.when(c("p_carbon"), "carbon").when(c("p_nylon"), "nylon").otherwise("other"),
        "b_market": sc.market_multiplier(),
        "b_band": _steps(price, [price > e for e in edges[per_band - 1::per_band]]),
        "b_fine": _steps(price, [price > e for e in edges]),
        "b_weight": _steps(w, [w >= 200, w >= 220, w >= 240, w >= 250, w > 280, w > 320, w > 350]),
        "b_drop": _steps(d, [d > 0, d > 4, d > 6, d >= 8, d > 10, d > 12])})


def price_edges(products: DataFrame) -> list[float]:
    """The prices between the fine bands: about as many products in each."""
    shares = [(i + 1) / FINE_BANDS for i in range(FINE_BANDS - 1)]
    found = products.agg(F.percentile_approx("price_usd", F.array(*[F.lit(s) for s in shares]))).first()[0]
    return sorted(set(found or []))


def block_rows(products: DataFrame, keys: list[str] = BLOCK) -> DataFrame:
    """One row per block, with the columns of a product that are the same for
    all of it, and the ends of the others."""
    spans = _coefficients() | {t[2:]: c(t) for t in TIERS}
    ends = [f(x).alias(f"{side}_{n}") for n, x in spans.items() for side, f in (("hi", F.max), ("lo", F.min))]
    best = [F.max(x).alias(f"_{x}") for x in ("p_jitter", "p_price_term")]
    exact = ["brand", *[f"p_{t}" for t in USE_TAGS], "p_carbon", "p_nylon"]
    rows = products.filter("b_mask > 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_products"), F.min("price_usd").alias("lo_price"), F.max("price_usd").alias("hi_price"),
        F.min(_place()).alias("lo_place"),
        *best, *[F.first(x).alias(x) for x in exact], *ends)
    return rows.withColumns({"plate": c("b_plate"), "p_jitter": c("_p_jitter"), "p_price_term": c("_p_price_term")}).drop(
        "_p_jitter", "_p_price_term")


def _place() -> Column:
    """The place in the catalog; rows without one come first."""
    return F.coalesce(c("catalog_pos"), F.lit(-(1 << 63)))


def _best(name: str, weight: str) -> Column:
    return F.greatest(c(f"hi_{name}") * c(weight), c(f"lo_{name}") * c(weight))


def upper_bound(pairs: DataFrame, has_market: Column) -> DataFrame:
    """Request x block rows with ``bound`` and ``original_bound``: no product of
    the block has a higher adjusted or original score for the request."""
    # Both price terms fall with the ratio, or rise if the budget weighs less than nothing (the multiplier is
    # 1 then), so one end of the prices is the best for both.
    cheap = (c("w_budget") >= 0) == (c("r_max_usd") > 0)
    pairs = pairs.withColumn("price_usd", F.when(cheap, c("lo_price")).otherwise(c("hi_price")))
    pairs = pairs.withColumn("ratio", sc.budget_ratio())
    weight = (F.when(c("g_races"), _best("weight_races", "w_races")).when(c("g_long"), _best("weight_long", "w_long"))
              .when(c("g_easy"), _best("weight_easy", "w_easy")).otherwise(_zero()))
    drop = (F.when(c("r_has_races"), _best("drop_races", "w_races")).when(c("r_easy"), _best("drop_easy", "w_easy"))
            .otherwise(_zero()))
    base = sc.clamp(F.lit(0.45) + sc.use_case_term() + sc.plate_term() + weight + drop + sc.budget_term() + sc.brand_term(), 0.1, 1.0)
    tech_drop = F.greatest(F.when(c("r_has_races"), _best("tech_races", "w_races")).otherwise(_zero()),
                           F.when(c("r_easy"), _best("tech_easy", "w_easy")).otherwise(_zero()))
    tech_plate = (F.when(c("p_carbon") & c("r_has_races"), F.lit(0.2) * c("w_races"))
                  .when(c("p_nylon") & c("r_tempo"), F.lit(0.15) * c("w_tempo")).otherwise(_zero()))
    tier = (F.when(c("g_races"), _best("tier_races", "w_races")).when(c("g_long"), _best("tier_long", "w_long"))
            .when(c("g_easy"), _best("tier_easy", "w_easy")).otherwise(_zero()))
    pairs = pairs.withColumns({
        "s_base": base, "s_tech": sc.clamp(F.lit(0.5) + tech_drop + tech_plate, 0.0, 1.0),
        "s_spec": sc.clamp(F.lit(0.45) + tier + c("p_jitter") + c("p_price_term"), 0.1, 1.0)})
    total = c("s_base") * 0.4 + c("s_tech") * 0.3 + sc.market_positioning(has_market) * 0.2 + c("s_spec") * 0.1
    original = F.when(c("price_usd").isNull(), F.lit(0.5)).otherwise(sc.clamp(total, 0.0, 1.0))
    multiplier = F.greatest(sc.blended_budget_multiplier(), _zero()) * c("b_market") * sc.carbon_race_multiplier()
    return pairs.withColumn("original_bound", original).withColumn("bound", c("original_bound") * multiplier)


def _merged(blocks: DataFrame, by: str) -> DataFrame:
    """Block rows of a higher level from those below it."""
    ends = {"lo": F.min, "hi": F.max}
    whole = [F.sum("n_products").alias("n_products"), *[F.max(x).alias(x) for x in ("p_jitter", "p_price_term")]]
    sides = [ends[x[:2]](x).alias(x) for x in blocks.columns if x[:3] in ("lo_", "hi_")]
    same = [x for x in blocks.columns if x in ("brand", "plate", "p_carbon", "p_nylon", *TOP, *[f"p_{t}" for t in USE_TAGS])
            or x in [f"k_{k}" for k in KEY]]
    return blocks.groupBy(by).agg(*whole, *sides, *[F.first(x).alias(x) for x in same])


def block_tree(products: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The block rows of each level with their number ``_id`` and that of the
    block above, ``_up``; and the offered products with ``_up``. The blocks of
    the last level are taken from the products, and number those above by their
    least one. They are broadcast if that is checked to be in bounds."""
    narrow = cut_lineage(products.drop("category", "model"))
    # A null brand is no brand that a request can ask for.
    offers = product_keys(with_blocks(narrow, price_edges(narrow))).filter(c("_brand").isNotNull())
    keys = [k for own in LEVELS for k in own]
    # Spans are taken under the product's own names, so keys that are spans, too, go by others.
    offers = offers.select("*", *[c(k).alias(f"k_{k}") for k in keys])
    last = cut_lineage(block_rows(offers, [f"k_{k}" for k in keys] + TOP).withColumn("_id", F.monotonically_increasing_id()))
    shared, above = [], {}
    for level, own in enumerate(LEVELS[:-1]):
        shared += [f"k_{k}" for k in own]
        above[f"_id{level}"] = F.min("_id").over(Window.partitionBy(*shared))
    last = cut_lineage(last.withColumns(above))
    first = _merged(last, "_id0").withColumnRenamed("_id0", "_id")
    middle = _merged(last, "_id1").withColumnRenamed("_id1", "_id").join(
        last.select(c("_id1").alias("_id"), c("_id0").alias("_up")).distinct(), "_id")
    levels = [first, middle.drop(*[f"k_{k}" for k in KEY]), last.withColumn("_up", c("_id1")).drop(*above, *[f"k_{k}" for k in keys])]
    if broadcastable(last)[0]:  # no level has more blocks
        levels = [F.broadcast(x) for x in levels]
    drop = [f"k_{k}" for k in keys] + KEY + [k for own in LEVELS for k in own if k.startswith("b_")] + ["b_brand", "b_mask"]
    offers = offers.join(last.select(*[f"k_{k}" for k in keys], c("_id").alias("_up")), [f"k_{k}" for k in keys])
    offers = cut_lineage(scored_alike(offers.drop(*drop)))
    return levels, F.broadcast(offers) if broadcastable(offers)[0] else offers


def scored_alike(offers: DataFrame) -> DataFrame:
    """One row for the offers that agree in all columns but ``catalog_pos``, and
    so in every score, with ``places``: the first ones in the catalog, as many as
    a request may want."""
    same = [x for x in offers.columns if x != "catalog_pos"]
    first = offers.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy("catalog_pos"))).filter(
        c("_k") <= MAX_RECOMMENDATIONS)
    return first.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("_k", "catalog_pos"))).alias("_first")).select(
        *same, c("_first.catalog_pos").alias("places"))


def _each_place(scored: DataFrame) -> DataFrame:
    """Scored rows of ``scored_alike`` products as a row per product."""
    return scored.withColumn("catalog_pos", F.explode(F.slice("places", F.lit(1), F.greatest(c("r_n"), F.lit(0))))).drop("places")


def likely_pairs(requests: DataFrame, products: DataFrame, has_market: Column) -> DataFrame:
    """The pairs of prepared requests (with ``request_gates``) and products
    (with ``product_features``) that may be among a request's first r_n, with
    the floor (null: none) that they have to reach."""
    return _each_place(likely_alike(requests, products, has_market))


def likely_alike(requests: DataFrame, products: DataFrame, has_market: Column) -> DataFrame:
    """``likely_pairs`` with one row for products that score alike, and their
    ``places``."""
    levels, offers = block_tree(products)
    per_task = conf_int(requests, "shortlist.requestsPerTask", REQUESTS_PER_TASK)
    parts = max(requests.sparkSession.sparkContext.defaultParallelism, math.ceil(requests.count() / per_task))
    # Request ids may repeat: each row goes by a number of its own.
    asked = cut_lineage(requests.repartition(parts).withColumn("_r", F.monotonically_increasing_id()))

    def with_request(rows: DataFrame, of: DataFrame) -> DataFrame:
        """Narrow rows, dealt by _r, beside their request's columns: a merge, so
        that each level's bounds are a method of their own, small enough to be
        compiled."""
        return rows.join(of.repartition(parts, "_r").hint("merge"), "_r")

    def bounded(of: DataFrame, level: int, rows: DataFrame | None) -> DataFrame:
        """(request row, block) of a level with the bound, below ``rows``."""
        if rows is None:
            met = request_keys(of.repartition(parts, "_r"), True).join(
                levels[0].withColumnsRenamed({f"k_{k}": k for k in KEY}), KEY).filter(carbon_ok()).drop(*KEY)
        else:
            met = with_request(rows, of).join(levels[level], "_up")
        return upper_bound(met, has_market)

    # Of equal bounds the one with the first place is best; a floor among ties is no good unless its place is early, so
    # on the last level as many blocks are followed as a request wants products.
    rows, order = None, Window.partitionBy("_r").orderBy(c("bound").desc(), c("original_bound").desc(), "lo_place", "_id")
    for level in range(len(LEVELS)):
        beam = F.greatest(F.lit(BEAM), c("r_n")) if level == len(LEVELS) - 1 else F.lit(BEAM)
        best = bounded(asked, level, rows).select(
            "_r", "r_n", "_id", "n_products", "bound", "original_bound", "lo_place").withColumn(
            "_k", F.row_number().over(order)).filter(c("_k") <= MAX_RECOMMENDATIONS)
        before = F.coalesce(F.sum("n_products").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        best = best.withColumn("_before", before).filter((c("_k") <= beam) | (c("_before") < c("r_n")))
        rows = best.select("_r", c("_id").alias("_up"))
    scored = sc.score_pairs(with_request(rows, asked).join(offers, "_up"), has_market).select(
        "_r", "places", "r_n", "adjusted_score", "original_score")
    # A row of a repeated request id wants no more than its own first ones, so each row has a floor of its own.
    ranked = _each_place(scored).withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy(*enhanced_order())))
    floors = ranked.filter((c("_k") <= MAX_RECOMMENDATIONS) & (c("_k") == c("r_n"))).select(
        "_r", c("adjusted_score").alias("_floor"), c("original_score").alias("_floor_original"),
        _place().alias("_floor_place"))

    asked = cut_lineage(asked.join(floors, "_r", "left"))
    rows = None
    for level in range(len(LEVELS)):
        # Exploded bounds are columns of their own; else the filter would take the whole sums into the join's condition.
        kept = bounded(asked, level, rows).select(
            "_r", "_id", *FLOOR, F.explode(F.array(F.struct("bound", "original_bound", "lo_place"))).alias("_b"))
        kept = kept.filter(_reaches("_b.bound", "_b.original_bound", c("_b.lo_place")))
        rows = kept.select("_r", c("_id").alias("_up"))
    return with_request(cut_lineage(rows).repartition(parts, "_r"), asked).join(offers, "_up").drop("_r", "_up")


FLOOR = ["_floor", "_floor_original", "_floor_place"]


def _reaches(score: str, original: str, place: Column) -> Column:
    """Whether scores and a place do not rank behind the request's floor."""
    tied = (c(original) > c("_floor_original")) | (
        (c(original) == c("_floor_original")) & (place <= c("_floor_place")))
    return c("_floor").isNull() | (c(score) > c("_floor")) | ((c(score) == c("_floor")) & tied)


def reaching_floor(scored: DataFrame) -> DataFrame:
    """The scored rows of ``likely_alike`` that reach the floor, a row per
    product. Scores are compared as columns of their own, as the bounds are."""
    alone = scored.withColumn("_s", F.explode(F.array(F.struct("adjusted_score", "original_score"))))
    first = F.coalesce(F.get("places", F.lit(0)), F.lit(-(1 << 63)))
    each = _each_place(alone.filter(_reaches("_s.adjusted_score", "_s.original_score", first)))
    return each.filter(_reaches("_s.adjusted_score", "_s.original_score", _place())).drop("_s", *FLOOR)
