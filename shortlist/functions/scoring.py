"""Scoring (C1-C15) as Column expressions.

All functions read a *pair row*: flat request columns (``r_*``, ``w_*``, see
``operators.requests.prepare_requests``) next to product columns (``brand``,
``category``, ``price_usd``, ``plate``, ``drop_mm``, ``weight_g``) and
optional market columns (``mk_review_count``, ``mk_rating``).

Additions are written in the reference's order (left-associative, absent
terms add 0.0), so the doubles equal the reference's bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.schemas import SPECIALTY_TIERS

c = F.col


def _zero() -> Column:
    return F.lit(0.0)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def has_cat(tag: str) -> Column:
    return F.coalesce(F.array_contains(c("category"), tag), F.lit(False))


# --- features computed once per product / once per request -------------------
#
# Everything that depends on one side only is computed on that side, before
# the pair join, so the per-pair work is only the interaction terms (and the
# generated code per operator stays small enough for the JIT).

def product_features(products: DataFrame) -> DataFrame:
    b = F.upper(F.coalesce(c("brand"), F.lit("")))

    def tier(use: str) -> Column:
        out = None
        for names, v in SPECIALTY_TIERS[use]:
            out = F.when(b.isin(*names), F.lit(v)) if out is None else out.when(b.isin(*names), F.lit(v))
        return out.otherwise(_zero())

    p = c("price_usd")
    return products.select(
        "*",
        has_cat("race").alias("p_race"), has_cat("tempo").alias("p_tempo"),
        has_cat("daily").alias("p_daily"), has_cat("easy").alias("p_easy"),
        has_cat("long").alias("p_long"),
        F.coalesce(c("plate") == "carbon", F.lit(False)).alias("p_carbon"),
        F.coalesce(c("plate") == "nylon", F.lit(False)).alias("p_nylon"),
        c("plate").eqNullSafe("none").alias("p_plate_none"),
        diversity_jitter().alias("p_jitter"),
        (F.when(p < 120, F.lit(0.08)).when(p < 150, F.lit(0.05)).when(p > 200, F.lit(-0.03))
         .otherwise(_zero())).alias("p_price_term"),
        tier("races").alias("p_tier_races"), tier("long").alias("p_tier_long"),
        tier("easy").alias("p_tier_easy"),
    )


def request_gates(requests: DataFrame) -> DataFrame:
    """The if/elif use-case gates of the weight, drop and specialty terms."""
    races = c("r_has_races")
    return requests.select(
        "*", races.alias("g_races"), (~races & c("r_long")).alias("g_long"),
        (~races & ~c("r_long") & c("r_easy")).alias("g_easy"))


def budget_ratio() -> Column:
    return F.try_divide(c("price_usd"), c("r_max_usd"))


def brand_in_prefs() -> Column:
    return F.coalesce(F.size(c("r_prefs")) > 0, F.lit(False)) & \
        F.coalesce(F.array_contains(c("r_prefs"), c("brand")), F.lit(False))


# --- C1 basic score ---------------------------------------------------------

def basic_score() -> Column:
    races = c("r_has_races")
    t_race = F.when(races & c("p_race"), F.lit(0.3)).otherwise(_zero())
    t_plate = F.when(races & ~c("p_plate_none"), F.lit(0.2)).otherwise(_zero())
    ratio = c("ratio")
    t_budget = F.when(c("r_limiter") & (ratio > 1.0), -(F.lit(0.3) * (ratio - 1.0))).otherwise(_zero())
    w = c("weight_g")
    truthy_w = w.isNotNull() & (w != 0)
    t_weight = (F.when(races & truthy_w & (w < 200), F.lit(0.1))
                .when(races & truthy_w & (w < 220), F.lit(0.05)).otherwise(_zero()))
    return clamp(F.lit(0.5) + t_race + t_plate + t_budget + t_weight, 0.0, 1.0)


# --- C2 base compatibility --------------------------------------------------

def use_case_term() -> Column:                                         # C2a
    return (F.when(c("r_has_races") & c("p_race"), F.lit(0.28) * c("w_races"))
            .when(c("r_tempo") & c("p_tempo"), F.lit(0.22) * c("w_tempo"))
            .when(c("r_long") & (c("p_long") | c("p_daily")), F.lit(0.20) * c("w_long"))
            .when(c("r_easy") & (c("p_daily") | c("p_easy")), F.lit(0.18) * c("w_easy"))
            .otherwise(_zero()))


def plate_term() -> Column:                                             # C2b
    return (F.when(c("g_races") & c("p_carbon"), F.lit(0.22) * c("w_races"))
            .when(c("g_races") & c("p_nylon"), F.lit(0.12) * c("w_tempo"))
            .when(c("g_long") & c("p_nylon"), F.lit(0.08) * c("w_long"))
            .otherwise(_zero()))


def weight_term() -> Column:                                            # C2c
    w = c("weight_g")
    races = (F.when(w < 200, F.lit(0.15) * c("w_races")).when(w < 220, F.lit(0.12) * c("w_races"))
             .when(w < 240, F.lit(0.08) * c("w_races")).when(w > 280, -(F.lit(0.1) * c("w_races")))
             .otherwise(_zero()))
    long_ = (F.when((w >= 240) & (w <= 280), F.lit(0.08) * c("w_long"))
             .when(w > 320, -(F.lit(0.05) * c("w_long"))).otherwise(_zero()))
    easy = (F.when((w >= 250) & (w <= 320), F.lit(0.06) * c("w_easy"))
            .when(w > 350, -(F.lit(0.08) * c("w_easy"))).otherwise(_zero()))
    return (F.when(w.isNull(), _zero()).when(c("g_races"), races).when(c("g_long"), long_)
            .when(c("g_easy"), easy).otherwise(_zero()))


def drop_term() -> Column:                                              # C2d
    d = c("drop_mm")
    races = (F.when(d <= 4, F.lit(0.06) * c("w_races")).when(d <= 6, F.lit(0.04) * c("w_races"))
             .when(d > 10, -(F.lit(0.03) * c("w_races"))).otherwise(_zero()))
    easy = F.when((d >= 8) & (d <= 12), F.lit(0.04) * c("w_easy")).otherwise(_zero())
    return (F.when(d.isNull(), _zero()).when(c("r_has_races"), races)
            .when(c("r_easy"), easy).otherwise(_zero()))


def budget_term() -> Column:                                            # C2e
    r = c("ratio")
    wb = c("w_budget")
    return (F.when(~c("r_limiter"), _zero())
            .when(r > 1.3, -(F.lit(0.35) * wb))
            .when(r > 1.2, -(F.lit(0.25) * wb))
            .when(r > 1.1, -(F.lit(0.15) * wb))
            .when(r > 1.0, -((F.lit(0.05) * (r - 1.0)) * wb))
            .when(r <= 0.7, F.lit(0.08) * wb)
            .when(r <= 0.8, F.lit(0.05) * wb)
            .otherwise(_zero()))


def brand_term() -> Column:                                             # C2f
    return F.when(brand_in_prefs(), F.lit(0.08) * c("w_brand")).otherwise(_zero())


def base_compatibility() -> Column:                                     # C2
    s = F.lit(0.45) + use_case_term() + plate_term() + weight_term() + drop_term() \
        + budget_term() + brand_term()
    return clamp(s, 0.1, 1.0)


# --- C3 technical advantage ---------------------------------------------------

def technical_advantage() -> Column:
    d = c("drop_mm")
    truthy = d.isNotNull() & (d != 0)
    t_drop = (F.when(truthy & c("r_has_races") & (d <= 6), F.lit(0.1) * c("w_races"))
              .when(truthy & c("r_easy") & (d >= 8) & (d <= 12), F.lit(0.1) * c("w_easy"))
              .otherwise(_zero()))
    t_plate = (F.when(c("p_carbon") & c("r_has_races"), F.lit(0.2) * c("w_races"))
               .when(c("p_nylon") & c("r_tempo"), F.lit(0.15) * c("w_tempo"))
               .otherwise(_zero()))
    return clamp(F.lit(0.5) + t_drop + t_plate, 0.0, 1.0)


# --- C4 market positioning (J7 flag) -----------------------------------------

def market_positioning(has_market: Column) -> Column:
    return F.when(has_market, F.lit(0.5)).otherwise(_zero())


# --- C5/C6 specialty bonus with reproducible jitter --------------------------

def diversity_jitter() -> Column:
    """Uniform(-0.02, 0.02) seeded by md5(model || BRAND): the first 32 bits
    of the digest as a fraction of 2^32."""
    key = F.concat(F.coalesce(c("model"), F.lit("")), F.upper(F.coalesce(c("brand"), F.lit(""))))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.lit(-0.02) + F.lit(0.04) * u


def specialty_bonus() -> Column:
    tier = (F.when(c("g_races"), c("p_tier_races") * c("w_races"))
            .when(c("g_long"), c("p_tier_long") * c("w_long"))
            .when(c("g_easy"), c("p_tier_easy") * c("w_easy")).otherwise(_zero()))
    return clamp(F.lit(0.45) + tier + c("p_jitter") + c("p_price_term"), 0.1, 1.0)


# --- C7/C8 dynamic score --------------------------------------------------------

def score_pairs(pairs: DataFrame, has_market: Column) -> DataFrame:
    """C2..C13 on pair rows, in stages: the ratio once, then the four
    components, then their weighted sum and the re-ranking multiplier."""
    staged = pairs.withColumn("ratio", budget_ratio())
    staged = staged.select("*", base_compatibility().alias("s_base"),
                           technical_advantage().alias("s_tech"),
                           specialty_bonus().alias("s_spec"),
                           adjustment_multiplier().alias("adjustment_multiplier"))
    s = c("s_base") * 0.4 + c("s_tech") * 0.3 + market_positioning(has_market) * 0.2 + c("s_spec") * 0.1
    original = F.when(c("price_usd").isNull(), F.lit(0.5)).otherwise(clamp(s, 0.0, 1.0))
    return (staged.withColumn("original_score", original)
            .withColumn("adjusted_score", c("original_score") * c("adjustment_multiplier")))


# --- C9-C12 re-ranking multiplier ----------------------------------------------------

def budget_multiplier() -> Column:                                       # C9
    r = c("ratio")
    return (F.when(~c("r_limiter") | c("price_usd").isNull(), F.lit(1.0))
            .when(r > 1.2, F.lit(0.7)).when(r > 1.0, F.lit(0.9)).when(r <= 0.8, F.lit(1.1))
            .otherwise(F.lit(1.0)))


def blended_budget_multiplier() -> Column:                               # C10
    m = budget_multiplier()
    wb = c("w_budget")
    return F.when(wb != 1.0, F.lit(1.0) + (m - 1.0) * F.greatest(F.lit(0.0), wb)).otherwise(m)


def market_multiplier() -> Column:                                       # C11
    n, r = c("mk_review_count"), c("mk_rating")
    return (F.when((n > 100) & (r >= 4.5), F.lit(1.1))
            .when((n > 50) & (r >= 4.0), F.lit(1.05)).otherwise(F.lit(1.0)))


def carbon_race_multiplier() -> Column:                                  # C12
    return F.when(c("r_has_races") & c("p_carbon"), F.lit(1.05)).otherwise(F.lit(1.0))


def adjustment_multiplier() -> Column:
    return blended_budget_multiplier() * market_multiplier() * carbon_race_multiplier()


def fmt_fixed(x: Column, decimals: int) -> Column:
    """Python's ``f"{x:.Nf}"``: DecimalFormat rounds half-even on the exact
    binary value, as Python does (``format_string`` rounds the shortest
    decimal half-up instead)."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", x, F.lit(pattern))


def _fmt2(x: Column) -> Column:
    return fmt_fixed(x, 2)


def adjustment_tags() -> Column:                                          # C13
    r = c("ratio")
    lim = c("r_limiter") & c("price_usd").isNotNull()
    budget = (F.when(lim & (r > 1.2), F.format_string("budget_penalty_70%%_(%sx_limit)", _fmt2(r)))
              .when(lim & (r > 1.0), F.format_string("slight_budget_penalty_90%%_(%sx_limit)", _fmt2(r)))
              .when(lim & (r <= 0.8), F.format_string("value_bonus_110%%_(%sx_limit)", _fmt2(r))))
    n, rt = c("mk_review_count"), c("mk_rating")
    market = (F.when((n > 100) & (rt >= 4.5),
                     F.concat(F.lit("high_rating_bonus_110%_("), n.cast("string"), F.lit("_reviews_"),
                              rt.cast("string"), F.lit("_stars)")))
              .when((n > 50) & (rt >= 4.0),
                    F.concat(F.lit("popularity_bonus_105%_("), n.cast("string"), F.lit("_reviews_"),
                             rt.cast("string"), F.lit("_stars)"))))
    carbon = F.when(c("r_has_races") & (c("plate") == "carbon"), F.lit("carbon_plate_racing_bonus_105%"))
    return F.array_compact(F.array(budget, market, carbon))


# --- C14 popularity -----------------------------------------------------------------

def popularity_score(review_count: Column, rating: Column) -> Column:
    norm_reviews = F.least(F.log10(review_count + 1.0) / F.log10(F.lit(1000.0)), F.lit(1.0))
    norm_rating = F.when(rating > 0, rating / 5.0).otherwise(_zero())
    return F.when(review_count > 0, (norm_reviews * 0.6 + norm_rating * 0.4) * 100.0).otherwise(_zero())


# --- C15 explanation quality multiplier ------------------------------------------

def explanation_quality(text: Column) -> Column:
    from shortlist.schemas import DETAIL_INDICATORS, GENERIC_PHRASES
    low = F.lower(text)
    generic = None
    for p in GENERIC_PHRASES:
        hit = low.contains(p)
        generic = hit if generic is None else generic | hit
    count = None
    for w in DETAIL_INDICATORS:
        one = F.when(low.contains(w), F.lit(1)).otherwise(F.lit(0))
        count = one if count is None else count + one
    blank = F.regexp_replace(text, r"^\s+|\s+$", "") == ""
    return (F.when(text.isNull() | blank, F.lit(0.8))
            .when(generic, F.lit(0.9))
            .when(count >= 3, F.lit(1.2)).when(count >= 2, F.lit(1.1)).when(count >= 1, F.lit(1.0))
            .otherwise(F.lit(0.95)))
