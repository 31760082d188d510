"""DuckDB oracle SQL: the same views and queries restated in SQL, run by the
driver against the same parquet tables. Literals are written so that every
arithmetic step has a DOUBLE operand (DuckDB keeps literal-only arithmetic in
DECIMAL)."""

from __future__ import annotations

from shortlist.schemas import BRANDS, ENTITIES
from shortlist.schemas import GENERIC_REPLY as GENERIC_REPLY_TEXT

BRAND_LIST = "list_value(" + ", ".join(f"'{b}'" for b in BRANDS) + ")"

CATALOG = f"""
catalog AS (
  SELECT CAST(p_partkey AS BIGINT) AS catalog_pos,
    {BRAND_LIST}[CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 13 + 1] AS brand,
    p_name AS model,
    CASE p_type WHEN 'ECONOMY' THEN ['daily', 'easy'] WHEN 'LARGE' THEN ['long', 'daily']
      WHEN 'MEDIUM' THEN ['tempo'] WHEN 'PROMO' THEN ['race', 'tempo'] WHEN 'SMALL' THEN ['race']
      ELSE ['easy', 'trail'] END AS category,
    round((p_retailprice - 900.0) * 2.5 + 50.0, 2) AS price_usd,
    CASE p_partkey % 5 WHEN 0 THEN 'carbon' WHEN 1 THEN 'nylon' WHEN 2 THEN 'none'
      WHEN 3 THEN 'composite' END AS plate,
    CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size % 13 AS DOUBLE) END AS drop_mm,
    CASE WHEN p_partkey % 19 <> 0 THEN CAST(180 + p_size * 4 AS INTEGER) END AS weight_g,
    CASE p_partkey % 4 WHEN 0 THEN 'plush' WHEN 1 THEN 'moderate' WHEN 2 THEN 'firm' END
      AS cushioning_level,
    CASE p_partkey % 3 WHEN 0 THEN 'stability' WHEN 1 THEN 'neutral' END AS support_type,
    CASE WHEN p_partkey % 7 <> 0 THEN CAST(28 + p_size % 14 AS DOUBLE) END AS heel_stack_mm,
    CASE WHEN p_partkey % 7 <> 0 THEN CAST(20 + p_size % 9 AS DOUBLE) END AS forefoot_stack_mm,
    CASE p_type WHEN 'SMALL' THEN ['10k', '5k'] WHEN 'PROMO' THEN ['half_marathon', 'marathon']
      WHEN 'LARGE' THEN ['marathon'] END AS best_for_distances,
    CASE WHEN p_partkey % 6 = 0 THEN TRUE END AS has_wide_options
  FROM part
)"""

# Flat, defaulted requests (the prepared form of the nested request rows).
REQUESTS = f"""
req_src AS (
  SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal FROM customer
),
requests AS (
  SELECT CAST(k AS BIGINT) AS request_id,
    CASE WHEN k % 3 = 0 THEN list_value({BRAND_LIST}[k % 13 + 1], {BRAND_LIST}[(k + 5) % 13 + 1])
      END AS r_prefs,
    (k % 7 <> 6) AND seg IN ('BUILDING', 'HOUSEHOLD') AS r_easy,
    (k % 7 <> 6) AND seg IN ('FURNITURE', 'HOUSEHOLD') AS r_tempo,
    (k % 7 <> 6) AND seg IN ('FURNITURE', 'MACHINERY') AS r_long,
    CASE WHEN k % 7 = 6 THEN []::VARCHAR[] WHEN seg = 'AUTOMOBILE' THEN ['5k', '10k']
      WHEN seg = 'MACHINERY' THEN ['marathon'] ELSE []::VARCHAR[] END AS r_races,
    k % 11 = 10 AS r_trail,
    k % 5 <> 4 AS r_limiter,
    60.0 + CAST(floor(abs(c_acctbal) / 40.0) AS DOUBLE) AS r_max_usd,
    CAST(1 + (k * 7) % 20 AS INTEGER) AS r_n,
    k % 4 <> 3 AS r_allow_carbon,
    CASE WHEN k % 6 <> 5 THEN CAST(0.5 * (k % 4 + 1) AS DOUBLE) ELSE 1.0::DOUBLE END AS w_brand,
    CASE WHEN k % 6 <> 5 THEN CAST(0.5 * ((k + 1) % 5) AS DOUBLE) ELSE 1.0::DOUBLE END AS w_budget,
    CASE WHEN k % 6 <> 5 THEN CAST(0.5 * ((k + 2) % 4 + 1) AS DOUBLE) ELSE 1.0::DOUBLE END AS w_easy,
    CASE WHEN k % 6 <> 5 THEN CAST(0.5 * ((k + 3) % 4 + 1) AS DOUBLE) ELSE 1.0::DOUBLE END AS w_tempo,
    CASE WHEN k % 6 <> 5 THEN CAST(0.5 * (k % 3 + 1) AS DOUBLE) ELSE 1.0::DOUBLE END AS w_long,
    CASE WHEN k % 6 <> 5 THEN CAST(0.5 * ((k + 1) % 3 + 1) AS DOUBLE) ELSE 1.0::DOUBLE END AS w_races
  FROM req_src
),
preq AS (
  SELECT *, len(r_races) > 0 AS r_has_races,
    NOT (r_easy OR r_tempo OR r_long OR len(r_races) > 0 OR r_trail) AS r_no_use
  FROM requests
)"""

MARKET = """
per_part AS (
  SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey
),
market_all AS (
  SELECT c.catalog_pos, c.brand, c.model, CAST(n * 4 AS BIGINT) AS review_count,
    greatest(0.0, least(5.0, (q / n - 15.0) / 2.5)) AS rating
  FROM per_part JOIN catalog c ON l_partkey = c.catalog_pos
),
market AS (
  SELECT brand, model, review_count, rating,
    CASE WHEN review_count > 0 THEN
      (least(log10(review_count + 1.0) / log10(1000.0), 1.0) * 0.6
       + (CASE WHEN rating > 0 THEN rating / 5.0 ELSE 0.0 END) * 0.4) * 100.0
      ELSE 0.0 END AS popularity_score
  FROM market_all
  QUALIFY row_number() OVER (PARTITION BY brand, model ORDER BY catalog_pos DESC) = 1
)"""


def has(tag: str) -> str:
    return f"coalesce(list_contains(category, '{tag}'), false)"


USE_HITS = (f"((r_easy AND ({has('daily')} OR {has('easy')})) OR (r_tempo AND ({has('tempo')} OR "
            f"{has('race')})) OR (r_long AND ({has('long')} OR {has('daily')})) OR "
            f"(r_has_races AND {has('race')}) OR (r_no_use AND ({has('daily')} OR {has('easy')})))")
BRAND_OK = "(coalesce(len(r_prefs) = 0, true) OR coalesce(list_contains(r_prefs, brand), false))"
CARBON_OK = "(r_allow_carbon OR NOT (plate IS NOT DISTINCT FROM 'carbon'))"
ENHANCED_OK = f"({BRAND_OK} AND {CARBON_OK} AND NOT r_trail AND {USE_HITS})"
BASIC_OK = f"({BRAND_OK} AND {USE_HITS})"

RATIO = "(price_usd / r_max_usd)"
BRAND_IN_PREFS = "(coalesce(len(r_prefs) > 0, false) AND coalesce(list_contains(r_prefs, brand), false))"

USE_TERM = f"""CASE WHEN r_has_races AND {has('race')} THEN 0.28 * w_races
  WHEN r_tempo AND {has('tempo')} THEN 0.22 * w_tempo
  WHEN r_long AND ({has('long')} OR {has('daily')}) THEN 0.20 * w_long
  WHEN r_easy AND ({has('daily')} OR {has('easy')}) THEN 0.18 * w_easy ELSE 0.0::DOUBLE END"""
PLATE_TERM = """CASE WHEN r_has_races AND coalesce(plate, 'none') = 'carbon' THEN 0.22 * w_races
  WHEN r_has_races AND coalesce(plate, 'none') = 'nylon' THEN 0.12 * w_tempo
  WHEN NOT r_has_races AND r_long AND coalesce(plate, 'none') = 'nylon' THEN 0.08 * w_long
  ELSE 0.0::DOUBLE END"""
WEIGHT_TERM = """CASE WHEN weight_g IS NULL THEN 0.0::DOUBLE
  WHEN r_has_races AND weight_g < 200 THEN 0.15 * w_races
  WHEN r_has_races AND weight_g < 220 THEN 0.12 * w_races
  WHEN r_has_races AND weight_g < 240 THEN 0.08 * w_races
  WHEN r_has_races AND weight_g > 280 THEN -(0.1 * w_races)
  WHEN NOT r_has_races AND r_long AND weight_g >= 240 AND weight_g <= 280 THEN 0.08 * w_long
  WHEN NOT r_has_races AND r_long AND weight_g > 320 THEN -(0.05 * w_long)
  WHEN NOT r_has_races AND NOT r_long AND r_easy AND weight_g >= 250 AND weight_g <= 320
    THEN 0.06 * w_easy
  WHEN NOT r_has_races AND NOT r_long AND r_easy AND weight_g > 350 THEN -(0.08 * w_easy)
  ELSE 0.0::DOUBLE END"""
DROP_TERM = """CASE WHEN drop_mm IS NULL THEN 0.0::DOUBLE
  WHEN r_has_races AND drop_mm <= 4 THEN 0.06 * w_races
  WHEN r_has_races AND drop_mm <= 6 THEN 0.04 * w_races
  WHEN r_has_races AND drop_mm > 10 THEN -(0.03 * w_races)
  WHEN NOT r_has_races AND r_easy AND drop_mm >= 8 AND drop_mm <= 12 THEN 0.04 * w_easy
  ELSE 0.0::DOUBLE END"""
BUDGET_TERM = f"""CASE WHEN NOT r_limiter THEN 0.0::DOUBLE
  WHEN {RATIO} > 1.3 THEN -(0.35 * w_budget)
  WHEN {RATIO} > 1.2 THEN -(0.25 * w_budget)
  WHEN {RATIO} > 1.1 THEN -(0.15 * w_budget)
  WHEN {RATIO} > 1.0 THEN -((0.05 * ({RATIO} - 1.0)) * w_budget)
  WHEN {RATIO} <= 0.7 THEN 0.08 * w_budget
  WHEN {RATIO} <= 0.8 THEN 0.05 * w_budget
  ELSE 0.0::DOUBLE END"""
BRAND_TERM = f"CASE WHEN {BRAND_IN_PREFS} THEN 0.08 * w_brand ELSE 0.0::DOUBLE END"
BASE = (f"greatest(0.1, least(1.0, 0.45::DOUBLE + ({USE_TERM}) + ({PLATE_TERM}) + ({WEIGHT_TERM}) "
        f"+ ({DROP_TERM}) + ({BUDGET_TERM}) + ({BRAND_TERM})))")
TECH = """greatest(0.0, least(1.0, 0.5::DOUBLE
  + (CASE WHEN drop_mm IS NOT NULL AND drop_mm <> 0 AND r_has_races AND drop_mm <= 6 THEN 0.1 * w_races
     WHEN drop_mm IS NOT NULL AND drop_mm <> 0 AND r_easy AND drop_mm >= 8 AND drop_mm <= 12
       THEN 0.1 * w_easy ELSE 0.0::DOUBLE END)
  + (CASE WHEN plate = 'carbon' AND r_has_races THEN 0.2 * w_races
     WHEN plate = 'nylon' AND r_tempo THEN 0.15 * w_tempo ELSE 0.0::DOUBLE END)))"""
UB = "upper(coalesce(brand, ''))"
SPECIALTY_TIER = f"""CASE
  WHEN r_has_races AND {UB} IN ('NIKE', 'SAUCONY', 'HOKA') THEN 0.12 * w_races
  WHEN r_has_races AND {UB} IN ('ASICS', 'NEW BALANCE') THEN 0.10 * w_races
  WHEN r_has_races AND {UB} IN ('BROOKS') THEN 0.08 * w_races
  WHEN NOT r_has_races AND r_long AND {UB} IN ('HOKA', 'BROOKS', 'ASICS') THEN 0.12 * w_long
  WHEN NOT r_has_races AND r_long AND {UB} IN ('NEW BALANCE', 'SAUCONY') THEN 0.10 * w_long
  WHEN NOT r_has_races AND NOT r_long AND r_easy AND {UB} IN ('BROOKS', 'ASICS', 'NEW BALANCE')
    THEN 0.10 * w_easy
  WHEN NOT r_has_races AND NOT r_long AND r_easy AND {UB} IN ('HOKA', 'SAUCONY') THEN 0.08 * w_easy
  ELSE 0.0::DOUBLE END"""
JITTER = (f"(-0.02 + 0.04 * (CAST(CAST('0x' || substr(md5(coalesce(model, '') || {UB}), 1, 8) AS BIGINT)"
          f" AS DOUBLE) / 4294967296.0))")
PRICE_TERM = """CASE WHEN price_usd < 120 THEN 0.08 WHEN price_usd < 150 THEN 0.05
  WHEN price_usd > 200 THEN -0.03 ELSE 0.0 END"""
SPECIALTY = (f"greatest(0.1, least(1.0, 0.45::DOUBLE + ({SPECIALTY_TIER}) + {JITTER} "
             f"+ CAST(({PRICE_TERM}) AS DOUBLE)))")
MARKET_FLAG = "(SELECT count(*) > 0 FROM market)"
DYNAMIC = (f"CASE WHEN price_usd IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0, least(1.0, "
           f"({BASE}) * 0.4 + ({TECH}) * 0.3 + (CASE WHEN {MARKET_FLAG} THEN 0.5 ELSE 0.0 END)::DOUBLE * 0.2"
           f" + ({SPECIALTY}) * 0.1)) END")
BUDGET_MULT = f"""CASE WHEN NOT r_limiter OR price_usd IS NULL THEN 1.0::DOUBLE
  WHEN {RATIO} > 1.2 THEN 0.7::DOUBLE WHEN {RATIO} > 1.0 THEN 0.9::DOUBLE
  WHEN {RATIO} <= 0.8 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END"""
BLENDED = f"CASE WHEN w_budget <> 1.0 THEN 1.0 + (({BUDGET_MULT}) - 1.0) * greatest(0.0, w_budget) ELSE ({BUDGET_MULT}) END"
MARKET_MULT = """CASE WHEN mk_review_count > 100 AND mk_rating >= 4.5 THEN 1.1::DOUBLE
  WHEN mk_review_count > 50 AND mk_rating >= 4.0 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END"""
CARBON_MULT = "CASE WHEN r_has_races AND plate = 'carbon' THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END"
MULT = f"(({BLENDED}) * ({MARKET_MULT}) * ({CARBON_MULT}))"
TAGS = f"""list_filter(list_value(
  CASE WHEN r_limiter AND price_usd IS NOT NULL AND {RATIO} > 1.2
       THEN 'budget_penalty_70%_(' || printf('%.2f', {RATIO}) || 'x_limit)'
     WHEN r_limiter AND price_usd IS NOT NULL AND {RATIO} > 1.0
       THEN 'slight_budget_penalty_90%_(' || printf('%.2f', {RATIO}) || 'x_limit)'
     WHEN r_limiter AND price_usd IS NOT NULL AND {RATIO} <= 0.8
       THEN 'value_bonus_110%_(' || printf('%.2f', {RATIO}) || 'x_limit)' END,
  CASE WHEN mk_review_count > 100 AND mk_rating >= 4.5
       THEN 'high_rating_bonus_110%_(' || CAST(mk_review_count AS VARCHAR) || '_reviews_'
            || CAST(mk_rating AS VARCHAR) || '_stars)'
     WHEN mk_review_count > 50 AND mk_rating >= 4.0
       THEN 'popularity_bonus_105%_(' || CAST(mk_review_count AS VARCHAR) || '_reviews_'
            || CAST(mk_rating AS VARCHAR) || '_stars)' END,
  CASE WHEN r_has_races AND plate = 'carbon' THEN 'carbon_plate_racing_bonus_105%' END),
  lambda x: x IS NOT NULL)"""

PRODUCTS = """
products AS (
  SELECT p.*, m.review_count AS mk_review_count, m.rating AS mk_rating
  FROM catalog p LEFT JOIN market m ON p.brand = m.brand AND p.model = m.model
)"""

ENHANCED_SCORED = f"""
pairs AS (
  SELECT r.*, p.* EXCLUDE (cushioning_level, support_type, heel_stack_mm, forefoot_stack_mm,
                           best_for_distances, has_wide_options)
  FROM preq r JOIN products p ON {ENHANCED_OK}
),
scored AS (
  SELECT *, {DYNAMIC} AS original_score, {MULT} AS adjustment_multiplier FROM pairs
),
ranked AS MATERIALIZED (
  SELECT *, original_score * adjustment_multiplier AS adjusted_score,
    row_number() OVER (PARTITION BY request_id ORDER BY original_score * adjustment_multiplier DESC,
                       original_score DESC, catalog_pos) AS rank
  FROM scored
  QUALIFY rank <= r_n
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def shortlist_enhanced() -> str:
    return with_ctes(CATALOG, REQUESTS, MARKET, PRODUCTS, ENHANCED_SCORED) + f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos, brand, model,
  array_to_string(category, ',') AS categories, price_usd, plate, drop_mm, weight_g,
  round(greatest(0.0, least(1.0, adjusted_score)), 6) AS score,
  round(original_score, 6) AS original_score,
  round(adjustment_multiplier, 6) AS adjustment_multiplier,
  array_to_string({TAGS}, '|') AS score_adjustments
FROM ranked"""


def _nonnull_join(parts: list[str], sep: str) -> str:
    return f"array_to_string(list_filter(list_value({', '.join(parts)}), lambda x: x IS NOT NULL), '{sep}')"


def _or_default(expr: str, default: str) -> str:
    return f"coalesce(nullif({expr}, ''), '{default}')"


REASONS_BASIC = _or_default(_nonnull_join([
    f"CASE WHEN {has('race')} AND r_has_races THEN 'Race-focused design' "
    f"WHEN {has('tempo')} AND r_tempo THEN 'Tempo run optimized' "
    f"WHEN ({has('daily')} OR {has('easy')}) AND r_easy THEN 'Daily training suitable' END",
    "CASE WHEN plate = 'carbon' AND r_has_races THEN 'Carbon plate for speed' "
    "WHEN plate = 'nylon' AND r_tempo THEN 'Nylon plate for tempo' END",
    "CASE WHEN r_limiter AND price_usd > r_max_usd THEN 'Above budget but high-performance' END",
], "; "), "Matches your criteria")

REASONS_ENHANCED = _or_default(_nonnull_join([
    f"CASE WHEN {has('race')} AND r_has_races THEN 'Optimized for racing performance' "
    f"WHEN {has('tempo')} AND r_tempo THEN 'Designed for tempo and threshold training' "
    f"WHEN ({has('daily')} OR {has('easy')}) AND r_easy THEN 'Perfect for daily training and easy runs' END",
    "CASE WHEN coalesce(plate, 'none') = 'carbon' AND r_has_races THEN 'Carbon plate provides racing efficiency' "
    "WHEN coalesce(plate, 'none') = 'nylon' AND r_tempo THEN 'Nylon plate adds responsiveness for speed work' END",
    "CASE WHEN weight_g IS NOT NULL AND weight_g <> 0 AND r_has_races AND weight_g < 220 "
    "THEN 'Lightweight design (' || CAST(weight_g AS VARCHAR) || 'g) for racing speed' "
    "WHEN weight_g IS NOT NULL AND weight_g <> 0 AND r_easy AND weight_g >= 250 AND weight_g <= 320 "
    "THEN 'Balanced weight (' || CAST(weight_g AS VARCHAR) || 'g) for comfortable training' END",
    f"CASE WHEN r_limiter AND {RATIO} <= 0.8 THEN 'Excellent value within budget' "
    f"WHEN r_limiter AND {RATIO} > 1.0 THEN 'Premium option with advanced features' END",
    "CASE WHEN mk_review_count > 50 THEN 'Popular choice with ' || CAST(mk_review_count AS VARCHAR) || ' reviews' END",
    "CASE WHEN mk_rating >= 4.5 THEN 'Highly rated (' || CAST(mk_rating AS VARCHAR) || '/5.0)' END",
], "; "), "Well-suited for your running needs")

ENHANCED_BASE = [CATALOG, REQUESTS, MARKET, PRODUCTS, ENHANCED_SCORED]


def rule_reasons_enhanced() -> str:
    return with_ctes(*ENHANCED_BASE) + f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos, {REASONS_ENHANCED} AS why_rules
FROM ranked"""


def score_components() -> str:
    return with_ctes(*ENHANCED_BASE) + f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos,
  round(({USE_TERM}), 6) AS use_case_term, round(({PLATE_TERM}), 6) AS plate_term,
  round(({WEIGHT_TERM}), 6) AS weight_term, round(({DROP_TERM}), 6) AS drop_term,
  round(({BUDGET_TERM}), 6) AS budget_term, round(({BRAND_TERM}), 6) AS brand_term,
  round({BASE}, 6) AS base_compatibility, round({TECH}, 6) AS technical_advantage,
  round(CASE WHEN {MARKET_FLAG} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS market_positioning,
  round({SPECIALTY}, 6) AS specialty_bonus, round({JITTER}, 6) AS diversity_jitter
FROM ranked"""


def score_audit() -> str:
    return with_ctes(*ENHANCED_BASE) + f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos,
  round(CASE WHEN r_limiter THEN {RATIO} END, 6) AS budget_ratio,
  round(({BLENDED}), 6) AS budget_multiplier, round(({MARKET_MULT}), 6) AS market_multiplier,
  round(({CARBON_MULT}), 6) AS carbon_multiplier,
  round(adjustment_multiplier, 6) AS adjustment_multiplier, round(adjusted_score, 6) AS adjusted_score,
  array_to_string({TAGS}, '|') AS score_adjustments
FROM ranked"""


BASIC_RANKED = f"""
bpairs AS (
  SELECT r.*, p.* FROM preq r JOIN catalog p ON {BASIC_OK}
),
bquota AS (
  SELECT * FROM bpairs WHERE NOT coalesce(r_limiter AND price_usd > r_max_usd, false)
  UNION ALL
  SELECT * EXCLUDE (q) FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY catalog_pos) AS q
    FROM bpairs WHERE coalesce(r_limiter AND price_usd > r_max_usd, false)) WHERE q <= 2
),
bscored AS (
  SELECT *, greatest(0.0, least(1.0, 0.5::DOUBLE
    + (CASE WHEN r_has_races AND {has('race')} THEN 0.3 ELSE 0.0 END)::DOUBLE
    + (CASE WHEN r_has_races AND NOT (plate IS NOT DISTINCT FROM 'none') THEN 0.2 ELSE 0.0 END)::DOUBLE
    + (CASE WHEN r_limiter AND {RATIO} > 1.0 THEN -(0.3 * ({RATIO} - 1.0)) ELSE 0.0::DOUBLE END)
    + (CASE WHEN r_has_races AND weight_g IS NOT NULL AND weight_g <> 0 AND weight_g < 200 THEN 0.1
            WHEN r_has_races AND weight_g IS NOT NULL AND weight_g <> 0 AND weight_g < 220 THEN 0.05
            ELSE 0.0 END)::DOUBLE)) AS score
  FROM bquota
),
branked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, catalog_pos) AS rank
  FROM bscored QUALIFY rank <= r_n
)"""


def shortlist_basic() -> str:
    return with_ctes(CATALOG, REQUESTS, BASIC_RANKED) + f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos, brand, model, price_usd,
  round(score, 6) AS score, {REASONS_BASIC} AS why_rules
FROM branked"""


NOTES = f"""
summary AS (
  SELECT request_id, count(*) AS n_items, count_if(price_usd > r_max_usd) AS n_over_budget
  FROM ranked GROUP BY request_id
),
notes AS (
  SELECT r.request_id, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    CAST(coalesce(n_over_budget, 0) AS BIGINT) AS n_over_budget
  FROM preq r LEFT JOIN summary s ON r.request_id = s.request_id
)"""

NOTES_TEXT = ("CASE WHEN n_items = 0 THEN 'No shoes match your criteria. Try relaxing brand preferences or "
              "budget constraints.' ELSE " + _nonnull_join([
                  "CASE WHEN n_over_budget > 0 THEN 'Note: ' || CAST(n_over_budget AS VARCHAR) || "
                  "' recommendation(s) exceed your budget but offer premium performance features.' END",
                  "CASE WHEN n_items < 3 THEN 'Fewer recommendations than usual - consider relaxing some "
                  "constraints for more options.' END",
                  "'Rankings use advanced AI analysis with dynamic scoring based on technical specs, market "
                  "data, and use-case optimization.'"], " || ") + " END")


def response_notes() -> str:
    return with_ctes(*ENHANCED_BASE, NOTES) + f"""
SELECT request_id, n_items, n_over_budget, {NOTES_TEXT} AS notes FROM notes"""


def response_nested() -> str:
    from shortlist.schemas import UNAVAILABLE_TEXT
    suffix = (f"CASE WHEN r.rank = 1 THEN {NL} || {NL} || '**TOP RECOMMENDATION #' || CAST(r.rank AS VARCHAR) || "
              f"'**: This shoe ranked highest due to optimal alignment with your requirements.' ELSE {NL} || {NL} || "
              f"'**RECOMMENDATION #' || CAST(r.rank AS VARCHAR) || '**: Strong alternative option with specific advantages.' END")
    reply = f"CASE WHEN f.items IS NOT NULL THEN coalesce(f.items[r.rank], {sql_str(GENERIC_REPLY_TEXT)}) END"
    body = (f"CASE WHEN ({reply}) IS NULL THEN {sql_str(UNAVAILABLE_TEXT)} WHEN trim({reply}) = '' THEN "
            f"'This shoe offers solid performance for your running needs with good technical specifications.' "
            f"ELSE {reply} END")
    return with_ctes(*ENHANCED_BASE, NOTES, REPLIES, PARSED, WEB) + f"""
, first_reply AS (
  SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY turn) = 1
),
full_items AS (
  SELECT r.request_id, r.rank, r.brand, r.model, concat_ws('/',
      CAST(round(greatest(0.0, least(1.0, adjusted_score)), 4) AS VARCHAR), CAST(price_usd AS VARCHAR),
      coalesce(plate, '-'), coalesce(CAST(drop_mm AS VARCHAR), '-'),
      coalesce(CAST(CAST(weight_g AS DOUBLE) AS VARCHAR), '-'), array_to_string(category, '+')) AS fields,
    {REASONS_ENHANCED} AS why_rules, ({body}) || ({suffix}) AS why_llm,
    coalesce(x.sources, []::VARCHAR[]) AS sources
  FROM ranked r LEFT JOIN first_reply f ON r.request_id = f.request_id
  LEFT JOIN ctx x ON r.request_id = x.request_id AND r.rank = x.rank
),
items AS (
  SELECT request_id, string_agg(brand || ' ' || model, ';' ORDER BY rank) AS items,
    string_agg(fields, ';' ORDER BY rank) AS item_fields,
    string_agg(why_rules || '#' || why_llm || '#' || array_to_string(sources, ','), {NL} ORDER BY rank) AS texts
  FROM full_items GROUP BY request_id
)
SELECT n.request_id, CAST(n.n_items AS INTEGER) AS n_items, coalesce(i.items, '') AS items,
  r.r_n AS echo_num_recommendations, {NOTES_TEXT} AS notes, coalesce(i.item_fields, '') AS item_fields, md5(coalesce(i.texts, '')) AS texts_md5
FROM notes n JOIN preq r ON n.request_id = r.request_id
LEFT JOIN items i ON n.request_id = i.request_id"""


def response_display() -> str:
    return with_ctes(*ENHANCED_BASE) + """
SELECT request_id, CAST(rank AS INTEGER) AS rank,
  printf('%.1f', greatest(0.0, least(1.0, adjusted_score)) * 100.0) AS score_pct,
  r_limiter AND price_usd > r_max_usd AS over_budget_flag,
  upper(substr(coalesce(plate, 'none'), 1, 1)) || lower(substr(coalesce(plate, 'none'), 2)) AS plate_label,
  array_to_string(list_transform(category, lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ', ') AS category_label,
  '$' || CAST(price_usd AS VARCHAR) AS price_label,
  CASE WHEN drop_mm <> 0 THEN CAST(drop_mm AS VARCHAR) || 'mm' END AS drop_label,
  CASE WHEN weight_g <> 0 THEN CAST(CAST(weight_g AS DOUBLE) AS VARCHAR) || 'g' END AS weight_label
FROM ranked"""


RAW_REQUESTS = f"""
raw AS (SELECT c_custkey AS k, c_acctbal FROM customer),
raw_req AS (
  SELECT CAST(k AS BIGINT) AS request_id,
    CASE WHEN k % 4 = 0 THEN list_value({BRAND_LIST}[k % 13 + 1]) WHEN k % 4 = 1 THEN []::VARCHAR[] END
      AS brand_preferences,
    k % 29 <> 0 AS has_use,
    CASE WHEN k % 2 = 0 THEN TRUE END AS easy_runs,
    CASE WHEN k % 3 = 0 THEN TRUE WHEN k % 3 = 1 THEN FALSE END AS tempo_runs,
    CASE WHEN k % 5 = 0 THEN TRUE END AS long_runs,
    CASE WHEN k % 7 = 0 THEN ['5k'] END AS races,
    CASE WHEN k % 11 = 0 THEN TRUE END AS trail,
    k % 31 <> 0 AS has_limiter,
    CASE WHEN k % 6 = 0 THEN FALSE WHEN k % 6 = 1 THEN TRUE END AS enabled,
    c_acctbal / 20.0 AS max_usd,
    CASE WHEN k % 9 <> 0 THEN CAST(k % 23 AS INTEGER) END AS num_recommendations,
    CASE WHEN k % 8 <> 0 THEN k % 2 = 1 END AS allow_carbon,
    k % 6 <> 5 AS has_weights,
    CASE WHEN k % 5 <> 0 THEN CAST(0.5 * (k % 4) AS DOUBLE) END AS w_brand,
    CASE WHEN k % 2 = 0 THEN 0.0::DOUBLE END AS w_tempo
  FROM raw
)"""


def request_defaults() -> str:
    return with_ctes(RAW_REQUESTS) + """
SELECT request_id,
  CASE WHEN brand_preferences IS NULL THEN NULL ELSE array_to_string(brand_preferences, ',') END AS brand_preferences,
  CASE WHEN has_use THEN coalesce(easy_runs, false) END AS easy_runs,
  CASE WHEN has_use THEN coalesce(tempo_runs, false) END AS tempo_runs,
  CASE WHEN has_use THEN coalesce(long_runs, false) END AS long_runs,
  CASE WHEN has_use THEN array_to_string(coalesce(races, []::VARCHAR[]), ',') END AS races,
  CASE WHEN has_use THEN coalesce(trail, false) END AS trail,
  CASE WHEN has_limiter THEN coalesce(enabled, true) END AS enabled,
  CASE WHEN has_limiter THEN round(max_usd, 6) END AS max_usd,
  coalesce(num_recommendations, 5) AS num_recommendations,
  coalesce(allow_carbon, true) AS allow_carbon,
  CASE WHEN has_weights THEN coalesce(w_brand, 1.0::DOUBLE) END AS w_brand,
  CASE WHEN has_weights THEN 1.0::DOUBLE END AS w_budget,
  CASE WHEN has_weights THEN 2.0::DOUBLE END AS w_easy_runs,
  CASE WHEN has_weights THEN coalesce(w_tempo, 1.0::DOUBLE) END AS w_tempo_runs,
  CASE WHEN has_weights THEN 1.0::DOUBLE END AS w_long_runs,
  CASE WHEN has_weights THEN 1.5::DOUBLE END AS w_races
FROM raw_req"""


def request_validation() -> str:
    return with_ctes(RAW_REQUESTS) + """
SELECT request_id, len(errs) = 0 AS valid, array_to_string(errs, '; ') AS errors FROM (
  SELECT request_id, list_filter(list_value(
    CASE WHEN NOT has_use THEN 'intended_use: field required' END,
    CASE WHEN NOT has_limiter OR max_usd IS NULL THEN 'cost_limiter: field required' END,
    CASE WHEN has_limiter AND max_usd <= 0 THEN 'cost_limiter.max_usd: must be greater than 0' END,
    CASE WHEN num_recommendations IS NOT NULL AND (num_recommendations < 1 OR num_recommendations > 20)
      THEN 'num_recommendations: must be between 1 and 20' END), lambda x: x IS NOT NULL) AS errs
  FROM raw_req)"""


def rejected_requests() -> str:
    return f"SELECT request_id, errors FROM ({request_validation()}) WHERE NOT valid"


def form_coercion() -> str:
    def w(name: str, shift: int) -> str:
        m = f"((k + {shift}) % 4)"
        return f"CASE WHEN {m} = 2 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w_{name}"
    return f"""
WITH raw AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal FROM customer)
SELECT CAST(k AS BIGINT) AS request_id,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN {BRAND_LIST}[k % 13 + 1] ELSE '' END AS brand_preferences,
  seg IN ('BUILDING', 'HOUSEHOLD') AS easy_runs,
  seg IN ('FURNITURE', 'HOUSEHOLD') AS tempo_runs,
  seg IN ('FURNITURE', 'MACHINERY') AS long_runs,
  CASE WHEN k % 5 = 0 THEN '5k,marathon' WHEN k % 5 = 1 THEN '10k' ELSE '' END AS races,
  k % 11 = 10 AS trail,
  k % 3 <> 0 AS enabled,
  CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 200.0::DOUBLE
    ELSE CAST(floor(abs(c_acctbal) / 30.0 + 40.0) AS DOUBLE) END AS max_usd,
  CASE WHEN k % 7 = 0 THEN 5 ELSE CAST(k % 25 AS INTEGER) END AS num_recommendations,
  k % 2 = 0 AS allow_carbon,
  {w('brand', 0)}, {w('budget', 1)}, {w('easy_runs', 2)}, {w('tempo_runs', 3)},
  {w('long_runs', 0)}, {w('races', 1)}
FROM raw"""


# --- extraction, dedup and statistics ---------------------------------------------------

def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def title_case(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


def _any_contains(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


BRAND_TEXT = (f"CASE WHEN p_partkey % 2 = 0 THEN upper(CASE WHEN bno % 14 = 13 THEN 'Acme' "
              f"ELSE {BRAND_LIST}[bno % 14 + 1] END) ELSE CASE WHEN bno % 14 = 13 THEN 'Acme' "
              f"ELSE {BRAND_LIST}[bno % 14 + 1] END END")
SLUG = "'/product/' || replace(lower(p_name), ' ', '-') || '-' || CAST(p_partkey AS VARCHAR)"

ANCHORS = f"""
part_b AS (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS bno FROM part),
anchor_base AS (
  SELECT CAST(p_partkey // 40 AS BIGINT) AS page_no, p_partkey % 40 AS slot, p_partkey AS k,
    {SLUG} AS path, ({BRAND_TEXT}) || ' ' || p_name AS title, p_partkey % 5 AS m
  FROM part_b
),
anchors AS (
  SELECT page_no, CAST(slot * 2 + copy AS INTEGER) AS anchor_idx,
    CASE WHEN k % 7 = 6 THEN 'https://shop.example.com' ELSE '' END || path || CASE WHEN copy = 1 THEN '?view=image' WHEN k % 4 = 1 THEN '?color=' || CAST(k % 3 AS VARCHAR)
                 WHEN k % 4 = 2 THEN '#reviews' ELSE '' END AS href,
    CASE WHEN m = 0 THEN 'Men''s ' || title WHEN m = 1 THEN 'Shoe' END AS aria_label,
    CASE WHEN m <= 2 THEN title WHEN m = 3 THEN '' ELSE 'New' END AS text,
    CASE WHEN m = 3 THEN 'Women''s ' || title || ' 2' WHEN m = 4 THEN 'Hoka' END AS sibling_text
  FROM anchor_base, unnest(CASE WHEN k % 3 = 0 THEN [0, 1] ELSE [0] END) AS u(copy)
)"""


def _brand_case(t: str, what: str) -> str:
    from shortlist.schemas import BRAND_PATTERNS
    arms = []
    for brand, pat in BRAND_PATTERNS:
        rx = "(?i)" + pat
        val = f"'{brand}'" if what == "brand" else collapse(f"regexp_extract({t}, '{rx}', 1)")
        arms.append(f"WHEN regexp_matches({t}, '{rx}') THEN {val}")
    return "CASE " + " ".join(arms) + " END"


CARDS = f"""
prod_anchors AS (
  SELECT *, regexp_replace(href, '[?#].*$', '') AS canonical FROM anchors
  WHERE contains(href, '/product/')
  QUALIFY row_number() OVER (PARTITION BY page_no, canonical ORDER BY anchor_idx) = 1
),
t1 AS (
  SELECT *, CASE WHEN length(coalesce(aria_label, '')) > 10 THEN {strip('aria_label')} END AS t1,
    {strip('sibling_text')} AS sib,
    string_split(regexp_extract(href, '^[^?#]*', 0), '/')[-1] AS slug
  FROM prod_anchors
),
t2 AS (SELECT *, CASE WHEN t1 IS NOT NULL AND t1 <> '' THEN t1 ELSE {strip('text')} END AS t2 FROM t1),
t3 AS (SELECT *, CASE WHEN (t2 IS NULL OR length(t2) < 5) AND length(coalesce(sib, '')) > 5 THEN sib
                      ELSE t2 END AS t3 FROM t2),
t4 AS (SELECT *, CASE WHEN (t3 IS NULL OR length(t3) < 5) AND length(slug) > 5
                      THEN {title_case("replace(slug, '-', ' ')")} ELSE t3 END AS t4 FROM t3),
titled AS (
  SELECT page_no, anchor_idx, canonical, href,
    CASE WHEN t4 IS NOT NULL AND length(t4) >= 5 THEN {collapse('t4')} END AS title FROM t4
),
degendered AS (
  SELECT *, regexp_replace(title, '(?i)^(Men''s|Men|Women''s|Women|Unisex)\\s+', '') AS tt FROM titled
),
cards_all AS (
  SELECT page_no, anchor_idx, canonical, title, {_brand_case('tt', 'brand')} AS brand,
    {_brand_case('tt', 'model')} AS model, href AS product_url
  FROM degendered
),
cards AS (
  SELECT * FROM cards_all WHERE brand IS NOT NULL AND model <> ''
  QUALIFY row_number() OVER (PARTITION BY page_no, product_url ORDER BY anchor_idx) = 1
)"""

_n = "CAST({} AS VARCHAR)"
PAGES = f"""
pages_src AS (
  SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS bno,
    round((p_retailprice - 900.0) * 2.5 + 50.0, 2) AS pr FROM part
),
product_pages AS (
  SELECT 'https://shop.example.com' || {SLUG} AS url,
    concat_ws(' ',
      'Men''s ' || ({BRAND_TEXT}) || ' ' || p_name,
      CASE p_type WHEN 'ECONOMY' THEN 'A daily trainer for everyday miles'
        WHEN 'LARGE' THEN 'Built for long runs and marathon training' WHEN 'MEDIUM' THEN 'A tempo shoe with speed'
        WHEN 'PROMO' THEN 'Racing flat for race day competition' WHEN 'SMALL' THEN 'Fast 5k racer'
        ELSE 'Trail shoe for off-road recovery runs' END,
      CASE p_partkey % 8 WHEN 0 THEN 'carbon plate' WHEN 1 THEN 'carbon fiber plate for propulsion'
        WHEN 2 THEN 'nylon plate' WHEN 3 THEN 'composite plate' WHEN 4 THEN 'pebax plate' WHEN 5 THEN 'no plate'
        WHEN 6 THEN 'plate technology inside' END,
      CASE p_partkey % 4 WHEN 0 THEN CAST(p_size % 13 AS VARCHAR) || ' mm drop'
        WHEN 1 THEN 'drop: ' || CAST(p_size % 13 AS VARCHAR) || ' mm'
        WHEN 2 THEN CAST(p_size % 13 AS VARCHAR) || 'mm offset' END,
      CASE p_partkey % 3 WHEN 0 THEN CAST(p_size % 5 + 7 AS VARCHAR) || '.' || CAST(p_size % 10 AS VARCHAR) || ' ounces'
        WHEN 1 THEN CAST(p_size % 3 + 8 AS VARCHAR) || ' oz' END,
      CASE p_partkey % 6 WHEN 0 THEN 'max cushioning' WHEN 1 THEN 'balanced ride' WHEN 2 THEN 'snappy feel'
        WHEN 3 THEN 'super soft foam' WHEN 4 THEN 'responsive ride' END,
      CASE p_partkey % 5 WHEN 0 THEN 'stability shoe' WHEN 1 THEN 'neutral' WHEN 2 THEN 'guide rails'
        WHEN 4 THEN 'neutral support shoe' END,
      CASE p_partkey % 4 WHEN 0 THEN 'heel stack: ' || CAST(p_size % 10 + 30 AS VARCHAR) || 'mm / '
          || CAST(p_size % 9 + 20 AS VARCHAR) || 'mm forefoot'
        WHEN 1 THEN CAST(p_size % 10 + 30 AS VARCHAR) || 'mm/' || CAST(p_size % 7 + 22 AS VARCHAR) || 'mm' END,
      CASE p_partkey % 5 WHEN 0 THEN '5k' WHEN 1 THEN '10k and half marathon' WHEN 2 THEN 'marathon'
        WHEN 3 THEN 'half-marathon' END,
      CASE WHEN p_partkey % 8 = 0 THEN 'Available in wide 2E' END) AS body_text,
    CASE p_partkey % 4 WHEN 0 THEN ['$' || printf('%.2f', pr)]
      WHEN 1 THEN ['$' || printf('%.2f', pr), '$' || printf('%.2f', pr - 15.0)]
      WHEN 2 THEN ['Was ' || printf('%.2f', pr) || ' now ' || printf('%.2f', pr - 15.0)]
      ELSE ['$19.99 gift card', '$' || printf('%.2f', pr), ''] END AS price_texts,
    [{{'text': '9', 'class': 'btn', 'aria_disabled': NULL::VARCHAR, 'parent_class': 'sizes'}},
     {{'text': '10', 'class': CASE WHEN p_partkey % 3 = 0 THEN 'btn disabled' ELSE 'btn' END,
       'aria_disabled': CASE WHEN p_partkey % 5 = 0 THEN 'true' END,
       'parent_class': CASE WHEN p_partkey % 7 = 0 THEN 'sizes unavailable' ELSE 'sizes' END}},
     {{'text': CASE WHEN p_partkey % 11 = 0 THEN ' 10 ' ELSE '10.5' END, 'class': 'btn',
       'aria_disabled': NULL::VARCHAR, 'parent_class': 'sizes'}}] AS size_options,
    [CASE WHEN p_partkey % 3 = 0 THEN '  The ' || p_name || ' is a versatile shoe.  ' END,
     CASE WHEN p_partkey % 3 <> 2 THEN 'Product details' END] AS description_texts,
    [NULL, CASE WHEN p_partkey % 4 <> 3 THEN 'Reviews' END,
     CASE WHEN p_partkey % 4 <> 3 THEN '(' || CAST(p_size * 7 % 400 AS VARCHAR) || ' reviews)' END]
      AS review_count_texts,
    [CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 5 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR)
       || ' out of 5' END, CAST(p_size % 6 AS VARCHAR) || '/5'] AS rating_texts,
    CASE WHEN p_partkey % 5 <> 4 THEN [[]::VARCHAR[], ['  ', ' Breathable mesh ', 'Foam midsole',
      'Rubber outsole', 'Reflective details', 'Padded collar', 'Extra item'], ['Other list']]
      ELSE [[]::VARCHAR[]] END AS feature_lists
  FROM pages_src
)"""

PRICE_LIST = ("list_distinct(list_filter(flatten(list_transform(list_filter(coalesce(price_texts, []::VARCHAR[]), "
              f"lambda t: {strip('t')} <> ''), lambda t: list_transform(CASE WHEN "
              "len(regexp_extract_all(t, '\\$(\\d+\\.\\d{2})', 1)) > 0 THEN regexp_extract_all(t, "
              "'\\$(\\d+\\.\\d{2})', 1) ELSE regexp_extract_all(t, '(\\d+\\.\\d{2})', 1) END, "
              "lambda x: CAST(x AS DOUBLE)))), lambda p: p >= 50.0 AND p <= 300.0))")


def spec_cols(t: str) -> str:
    from shortlist.schemas import (CATEGORY_WORDS, CUSHION_WORDS, DROP_PATTERN, PLATE_PATTERNS,
                                   STABILITY_WORDS, STACK_PATTERN, WEIGHT_PATTERN, WIDE_WORDS)
    cats = "list_filter(list_value(" + ", ".join(
        f"CASE WHEN {_any_contains(t, ws)} THEN '{tag}' END" for tag, ws in CATEGORY_WORDS) + \
        "), lambda x: x IS NOT NULL)"
    plate = "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{cls}'" for p, cls in PLATE_PATTERNS) + \
        " ELSE 'none' END"
    drop = "CAST(coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{DROP_PATTERN}', {i}), '')"
                                       for i in range(1, 5)) + ") AS DOUBLE)"
    oz = "CAST(coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{WEIGHT_PATTERN}', {i}), '')"
                                     for i in range(1, 3)) + ") AS DOUBLE)"
    cush = "CASE " + " ".join(f"WHEN {_any_contains(t, ws)} THEN '{lv}'" for lv, ws in CUSHION_WORDS) + " END"
    sup = f"CASE WHEN {_any_contains(t, STABILITY_WORDS)} THEN 'stability' WHEN contains({t}, 'neutral') THEN 'neutral' END"
    dists = (f"list_filter(list_value(CASE WHEN regexp_matches({t}, '\\b5k\\b') THEN '5k' END, "
             f"CASE WHEN regexp_matches({t}, '\\b10k\\b') THEN '10k' END, "
             f"CASE WHEN contains({t}, 'half marathon') OR contains({t}, 'half-marathon') THEN 'half_marathon' END, "
             f"CASE WHEN contains({t}, 'marathon') THEN 'marathon' END), lambda x: x IS NOT NULL)")
    return f"""CASE WHEN len({cats}) > 0 THEN {cats} END AS s_category, {plate} AS s_plate, {drop} AS s_drop_mm,
      CAST(round_even({oz} * 28.35, 0) AS INTEGER) AS s_weight_g, {cush} AS s_cushioning_level, {sup} AS s_support_type,
      CAST(nullif(regexp_extract({t}, '{STACK_PATTERN}', 3), '') AS DOUBLE) AS s_heel_stack_mm,
      CAST(nullif(regexp_extract({t}, '{STACK_PATTERN}', 5), '') AS DOUBLE) AS s_forefoot_stack_mm,
      CASE WHEN len({dists}) > 0 THEN list_sort(list_distinct({dists})) END AS s_best_for_distances,
      CASE WHEN {_any_contains(t, WIDE_WORDS)} THEN TRUE END AS s_has_wide_options"""


SPECS = f"""
page_specs AS (
  SELECT url, {PRICE_LIST} AS ps, {spec_cols('lower(body_text)')}, size_options FROM product_pages
)"""

ROWS = f"""
crawl_rows AS (
  SELECT c.page_no, c.anchor_idx, c.brand, c.model, c.product_url,
    coalesce(s.s_category, ['daily']) AS category,
    coalesce(list_max(s.ps), 0.0) AS price_usd,
    coalesce(s.s_plate, 'none') AS plate, s.s_drop_mm AS drop_mm, s.s_weight_g AS weight_g
  FROM cards c LEFT JOIN page_specs s ON CASE WHEN starts_with(c.canonical, '/')
    THEN 'https://shop.example.com' || c.canonical ELSE c.canonical END = s.url
),
built AS (
  SELECT *, page_no * 4294967296 + anchor_idx AS catalog_pos FROM crawl_rows
  QUALIFY row_number() OVER (PARTITION BY brand, model ORDER BY page_no, anchor_idx) = 1
)"""


def _shown(html: str) -> str:
    t = (f"regexp_replace({html}, '(?is)<(script|style)\\b.*?</(script|style)>|(?s)<!--.*?-->', ' ', 'g')")
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    t = (f"regexp_replace({t}, '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|"
         "form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)"
         "(?:\\s[^>]*)?/?>', chr(10), 'g')")
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for name, char in [("nbsp", " "), ("copy", "\u00a9"), ("reg", "\u00ae"), ("trade", "\u2122"),
                       ("middot", "\u00b7"), ("bull", "\u2022"), ("ndash", "\u2013"), ("mdash", "\u2014"),
                       ("hellip", "\u2026"), ("lsquo", "\u2018"), ("rsquo", "\u2019"), ("ldquo", "\u201c"),
                       ("rdquo", "\u201d"), ("laquo", "\u00ab"), ("raquo", "\u00bb"), ("euro", "\u20ac"),
                       ("pound", "\u00a3"), ("#39", "''"), ("apos", "''"), ("quot", '"'), ("lt", "<"), ("gt", ">"),
                       ("amp", "&")]:
        t = f"replace({t}, '&{name};', '{char}')"
    return f"regexp_replace(regexp_replace({t}, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"


def page_text() -> str:
    t = _shown("html")
    return f"""
SELECT page_id, CAST(length(v) AS INTEGER) AS text_chars, md5(v) AS text_md5
FROM (SELECT page_id, lower(trim({t}, ' ' || chr(10))) AS v FROM pages)"""


def landed_pages() -> str:
    return f"""
SELECT regexp_extract(url, '^[^?#]*', 0) AS url, CAST(length(v) AS INTEGER) AS text_chars, md5(v) AS text_md5
FROM (SELECT url, trim({_shown("html")}, ' ' || chr(10)) AS v FROM pages)"""


def landed_product_lists() -> str:
    return """
SELECT regexp_extract(url, '^[^?#]*', 0) AS url,
  '$' || (page_id % 90 + 100) || '.95|Now ' || (page_id % 40 + 60) || '.50|Now ' || (page_id % 40 + 60) || '.50'
    AS price_texts,
  '10/size/true/unavailable|9.5/-/-/-' AS size_options,
  CASE WHEN page_id % 4 <> 0 THEN 'About & shoe ' || page_id || ' the end|' ELSE '' END ||
    '$' || (page_id % 90 + 100) || '.95 Now ' || (page_id % 40 + 60) || '.50' AS description_texts,
  CASE WHEN page_id % 3 <> 0 THEN '(' || page_id || ' reviews)' ELSE '' END AS review_count_texts,
  '4.' || (page_id % 10) || ' out of 5' AS rating_texts,
  'F' || page_id || ',light' || CASE WHEN page_id % 2 = 0 THEN '|B1' ELSE '' END AS feature_lists FROM pages"""


def landed_anchors() -> str:
    def attribute(name: str) -> str:
        pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
        value = f"""regexp_replace(regexp_extract(tag, '{pattern}', 1), '^["'']|["'']$', '', 'g')"""
        for entity, char in ENTITIES:
            value = f"replace({value}, '&{entity};', '{char.replace(chr(39), chr(39) * 2)}')"
        return f"CASE WHEN regexp_matches(tag, '{pattern}') THEN {value} END"

    shown = lambda x: f"trim({_shown(x)}, ' ' || chr(10))"
    return rf"""
WITH b AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|(?s)<!--.*?-->',
    ' ', 'g'), '(?i)<a\s', chr(1) || '<a ', 'g'), chr(1)) AS pieces FROM pages
),
p AS (SELECT page_id, i - 2 AS anchor_idx, pieces[i] AS piece FROM (SELECT *, unnest(range(2, len(pieces) + 1)) AS i FROM b)),
t AS (
  SELECT page_id, anchor_idx, piece,
    regexp_extract(piece, '^<a [^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*>', 0) AS tag FROM p
),
r AS (SELECT *, substr(piece, length(tag) + 1) AS rest FROM t),
s AS (
  SELECT *, regexp_extract(rest, '(?is)^(.*?)(?:</a\s*>|$)', 1) AS inner_html,
    regexp_extract(rest, '(?is)</a\s*>(.*)$', 1) AS after_html FROM r
),
e AS (
  SELECT *, lower(regexp_extract(after_html, '^[^<]*<([A-Za-z][A-Za-z0-9]*)', 1)) AS el,
    regexp_replace(after_html, '^[^<]*', '') AS element FROM s
),
x AS (
  SELECT *, CASE WHEN instr(lower(element), '</' || el) > 0 THEN left(element, instr(lower(element), '</' || el) - 1)
                 ELSE element END AS within FROM e
),
y AS (
  SELECT page_id, anchor_idx, {attribute("href")} AS href, {attribute("aria-label")} AS aria_label, {shown("inner_html")} AS text,
    CASE WHEN el IN ('', 'img', 'br', 'hr', 'input') THEN '' ELSE {shown("within")} END AS sibling,
    NOT contains(after_html, '<') AND regexp_matches(rest, '(?i)</a\s*>') AS follows FROM x
),
z AS (SELECT *, lead(text) OVER (PARTITION BY page_id ORDER BY anchor_idx) AS next_text FROM y)
SELECT page_id AS page_no, CAST(anchor_idx AS INTEGER) AS anchor_idx, href, aria_label, text,
  CASE WHEN follows THEN coalesce(next_text, '') ELSE sibling END AS sibling_text
FROM z WHERE href IS NOT NULL"""


def page_links() -> str:
    return """
WITH p AS (
  SELECT page_id, url,
    CASE WHEN page_id % 1 = 0 THEN '<a href="?page=2">2</a>' ELSE '' END ||
    CASE WHEN page_id % 2 = 0 THEN '<a class=''next'' href=''list?page=3&amp;sort=new''>3</a>' ELSE '' END ||
    CASE WHEN page_id % 3 = 0 THEN '<a href="/shoes?page=4">4</a>' ELSE '' END ||
    CASE WHEN page_id % 4 = 0 THEN '<A HREF = ''//other.example.net/?page=5''>5</A>' ELSE '' END ||
    CASE WHEN page_id % 5 = 0 THEN '<a rel="next" href="https://other.example.net/x?page=6">6</a>' ELSE '' END ||
    CASE WHEN page_id % 6 = 0 THEN '<a href="#page=7">7</a>' ELSE '' END || coalesce(html, '') AS html,
    list_concat(CASE WHEN page_id % 2 = 1 THEN ['?page=8', '?page=2'] ELSE []::VARCHAR[] END,
                CASE WHEN page_id % 3 = 1 THEN ['?page=9'] ELSE []::VARCHAR[] END) AS blocks FROM pages
),
l AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
    regexp_extract(url, '^([a-z]+:)//', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
    regexp_extract(url, '^[^?#]*', 0) AS page,
    list_concat(blocks, list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*("[^"]*"|''[^'']*'')', 1),
                                       lambda q: replace(substr(q, 2, len(q) - 2), '&amp;', '&'))) AS hrefs FROM p
),
f AS (SELECT *, CASE WHEN page = origin THEN origin || '/' ELSE regexp_replace(page, '[^/]*$', '') END AS folder FROM l),
r AS (
  SELECT page_id, list_concat([url], list_filter(
    list_transform(hrefs, lambda h: CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
      WHEN starts_with(h, '//') THEN scheme || h WHEN starts_with(h, '/') THEN origin || h
      WHEN starts_with(h, '?') OR starts_with(h, '#') OR h = '' THEN page || h ELSE folder || h END),
    lambda h: contains(h, host) AND contains(h, 'page='))) AS all_links FROM f
),
d AS (
  SELECT page_id, list_filter(all_links, lambda x, i: list_position(all_links, x) = i) AS links FROM r
)
SELECT page_id, CAST(len(links) AS INTEGER) AS n_links, array_to_string(links, ' ') AS links FROM d"""


def canonical_urls() -> str:
    return with_ctes(ANCHORS, CARDS) + """
SELECT page_no, anchor_idx, canonical FROM prod_anchors"""


def title_brand_model() -> str:
    return with_ctes(ANCHORS, CARDS) + """
SELECT page_no, anchor_idx, title, brand, model, product_url FROM cards"""


def price_pairs() -> str:
    return with_ctes(PAGES, SPECS) + """
SELECT url, list_max(ps) AS price,
  CASE WHEN len(ps) >= 2 AND list_max(ps) - list_min(ps) >= 10.0 THEN list_min(ps) END AS sale_price
FROM page_specs"""


def spec_extraction() -> str:
    return with_ctes(PAGES, SPECS) + """
SELECT url, array_to_string(coalesce(s_category, ['daily']), ',') AS category, coalesce(s_plate, 'none') AS plate,
  s_drop_mm AS drop_mm, s_weight_g AS weight_g, s_cushioning_level AS cushioning_level,
  s_support_type AS support_type, s_heel_stack_mm AS heel_stack_mm, s_forefoot_stack_mm AS forefoot_stack_mm,
  array_to_string(s_best_for_distances, ',') AS best_for_distances, s_has_wide_options AS has_wide_options
FROM page_specs"""


def size_availability() -> str:
    return with_ctes(PAGES) + f"""
SELECT url, coalesce(len(list_filter(size_options, lambda o: {strip('o.text')} = '10'
  AND NOT (contains(lower(coalesce(o.class, '')), 'disabled') OR lower(coalesce(o.aria_disabled, '')) IN ('true', 'aria-disabled'))
  AND NOT (contains(lower(coalesce(o.parent_class, '')), 'disabled') OR contains(lower(coalesce(o.parent_class, '')), 'unavailable')))) > 0, false)
  AS available_for_size
FROM product_pages"""


BUILD = [ANCHORS, CARDS, PAGES, SPECS, ROWS]


def catalog_dedup() -> str:
    return with_ctes(*BUILD) + """
SELECT catalog_pos, brand, model, page_no, anchor_idx, array_to_string(category, ',') AS category,
  price_usd, plate, drop_mm, weight_g FROM built"""


SPEC_FOUND = "(plate <> 'none' OR (drop_mm IS NOT NULL AND drop_mm <> 0) OR (weight_g IS NOT NULL AND weight_g <> 0))"


def extraction_stats() -> str:
    return with_ctes(*BUILD) + f"""
SELECT (SELECT count(DISTINCT page_no) FROM anchors) AS pages, (SELECT count(*) FROM crawl_rows) AS products,
  count(*) AS unique_products, count_if(price_usd > 0) AS price_ok, count_if({SPEC_FOUND}) AS specs_ok,
  round(CASE WHEN count(*) > 0 THEN count_if(price_usd > 0) * 100.0 / count(*) END, 6) AS price_rate,
  round(CASE WHEN count(*) > 0 THEN count_if({SPEC_FOUND}) * 100.0 / count(*) END, 6) AS specs_rate
FROM built"""


def plate_breakdown() -> str:
    return with_ctes(*BUILD) + """
SELECT plate, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM built), 6) AS pct
FROM built GROUP BY plate"""


def brand_distribution() -> str:
    return with_ctes(*BUILD) + """
SELECT brand, count, round(count * 100.0 / (SELECT count(*) FROM built), 6) AS pct,
  row_number() OVER (ORDER BY count DESC, first_pos) AS position
FROM (SELECT brand, count(*) AS count, min(catalog_pos) AS first_pos FROM built GROUP BY brand)"""


def facets() -> str:
    return with_ctes(*BUILD) + """
SELECT array_to_string(list_append(list_sort(list_distinct(list(brand))), 'Any'), ',') AS brands,
  CAST(trunc(max(CASE WHEN price_usd <> 0 THEN price_usd END) + 50) AS INTEGER) AS max_price,
  CAST(count(DISTINCT brand) AS INTEGER) AS n_brands
FROM built"""


# --- market and enrichment ------------------------------------------------------------------

def market_context() -> str:
    return with_ctes(CATALOG, MARKET) + """
SELECT brand, model, review_count, round(rating, 6) AS rating, round(popularity_score, 6) AS popularity_score
FROM market"""


def market_flag() -> str:
    return with_ctes(CATALOG, MARKET) + """
SELECT count(*) > 0 AS has_market, count(*) AS n_market FROM market"""


SEARCH = f"""
search_src AS (
  SELECT p_partkey AS k, p_name, {BRAND_LIST}[CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 13 + 1] AS brand,
    'https://shop.example.com' || {SLUG} AS url FROM part
),
search AS (
  SELECT CAST(k AS BIGINT) AS query_pos, 1 AS pos, CASE WHEN k % 4 = 0
      THEN 'https://shop.example.com/blog/review' ELSE 'https://shop.example.com/sale' END AS href,
    CASE WHEN k % 4 = 0 THEN brand || ' ' || p_name ELSE 'Sale items' END AS link_text
  FROM search_src
  UNION ALL
  SELECT k, 2, url, CASE WHEN k % 3 <> 0 THEN lower(brand) || ' ' || split_part(p_name, ' ', 1)
    ELSE 'Gift cards' END FROM search_src
  UNION ALL
  SELECT k, 3, url || '?ref=search', brand || ' ' || p_name FROM search_src
),
matched AS (
  SELECT c.catalog_pos, s.pos, s.href FROM catalog c JOIN search s ON s.query_pos = c.catalog_pos
    AND contains(s.href, '/product/')
    AND contains(lower(s.link_text), lower(c.brand))
    AND len(list_filter(string_split_regex(lower(c.model), '\\s+'),
                        lambda w: w <> '' AND contains(lower(s.link_text), w))) > 0
  QUALIFY row_number() OVER (PARTITION BY c.catalog_pos ORDER BY s.pos) = 1
)"""

ENHANCED = f"""
enh AS (
  SELECT url,
    coalesce(list_transform(list_filter(review_count_texts, lambda t: t IS NOT NULL AND regexp_matches(t, '\\d')),
      lambda t: CAST(regexp_extract(t, '(\\d+)', 1) AS INTEGER))[1], 0) AS review_count,
    coalesce(list_transform(list_filter(rating_texts,
        lambda t: t IS NOT NULL AND regexp_matches(t, '(\\d+\\.?\\d*)\\s*(?:out of|/)\\s*5')),
      lambda t: CAST(regexp_extract(t, '(\\d+\\.?\\d*)\\s*(?:out of|/)\\s*5', 1) AS DOUBLE))[1], 0.0) AS average_rating,
    coalesce({strip("list_filter(description_texts, lambda t: t IS NOT NULL)[1]")}, '') AS description,
    coalesce(list_filter(list_transform(feature_lists, lambda lst: list_filter(list_transform(lst,
      lambda x: {strip('x')}), lambda x: x <> '')), lambda lst: len(lst) > 0)[1][1:5], []::VARCHAR[]) AS features
  FROM product_pages
),
enriched AS (
  SELECT c.catalog_pos, c.brand, c.model, m.href AS web_source_url,
    coalesce(e.review_count, 0) AS review_count, coalesce(e.average_rating, 0.0) AS average_rating,
    coalesce(e.description, '') AS description, coalesce(e.features, []::VARCHAR[]) AS features,
    CASE WHEN coalesce(e.review_count, 0) > 0 THEN
      (least(log10(e.review_count + 1.0) / log10(1000.0), 1.0) * 0.6
       + (CASE WHEN e.average_rating > 0 THEN e.average_rating / 5.0 ELSE 0.0 END) * 0.4) * 100.0
      ELSE 0.0 END AS popularity_score
  FROM catalog c LEFT JOIN matched m ON c.catalog_pos = m.catalog_pos
  LEFT JOIN enh e ON regexp_replace(m.href, '[?#].*$', '') = e.url
)"""


def page_match() -> str:
    return with_ctes(CATALOG, SEARCH) + """
SELECT catalog_pos, pos, href FROM matched"""


def enriched_catalog() -> str:
    return with_ctes(CATALOG, SEARCH, PAGES, ENHANCED) + """
SELECT catalog_pos, brand, model, web_source_url, review_count, round(average_rating, 6) AS average_rating,
  description, array_to_string(features, '|') AS features, round(popularity_score, 6) AS popularity_score
FROM enriched"""


def enrichment_summary() -> str:
    return with_ctes(CATALOG, SEARCH, PAGES, ENHANCED) + """
SELECT count_if(coalesce(web_source_url, '') <> '') AS enriched, count(*) AS total FROM enriched"""


# --- prompts ------------------------------------------------------------------------------------

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


CANDIDATE_LINE = (f"concat_ws(' | ', '- ' || brand || ' ' || model, 'cat=' || array_to_string(coalesce(category, []::VARCHAR[]), ','), "
                  f"'price=$' || coalesce({_v('price_usd')}, '?'), 'plate=' || coalesce(plate, 'none'), "
                  f"'drop=' || coalesce({_v('drop_mm')}, '?') || 'mm', "
                  f"CASE WHEN weight_g IS NOT NULL THEN 'weight=' || {_v('weight_g')} || 'g' END, "
                  f"CASE WHEN coalesce(cushioning_level, '') <> '' THEN 'cushioning=' || cushioning_level END, "
                  f"CASE WHEN coalesce(support_type, '') <> '' THEN 'support=' || support_type END, "
                  f"CASE WHEN heel_stack_mm IS NOT NULL AND forefoot_stack_mm IS NOT NULL THEN 'stack=' || "
                  f"{_v('heel_stack_mm')} || '/' || {_v('forefoot_stack_mm')} || 'mm' END)")

USES = ("array_to_string(list_filter(list_value(CASE WHEN r_easy THEN 'Easy runs' END, CASE WHEN r_tempo THEN "
        "'Tempo runs' END, CASE WHEN r_long THEN 'Long runs' END, CASE WHEN len(r_races) > 0 THEN 'Racing' END, "
        "CASE WHEN r_trail THEN 'Trail running' END), lambda x: x IS NOT NULL), ', ')")
REQUIREMENTS = (f"coalesce(nullif(array_to_string(list_filter(list_value("
                f"CASE WHEN {USES} <> '' THEN 'Intended Use: ' || {USES} END, "
                f"CASE WHEN coalesce(len(r_prefs) > 0, false) THEN 'Preferred Brands: ' || array_to_string(r_prefs, ', ') END, "
                f"CASE WHEN r_limiter THEN 'Budget: Maximum $' || {_v('r_max_usd')} END), lambda x: x IS NOT NULL), {NL}), ''), "
                f"'General running needs')")
SHOE_DETAILS = (f"array_to_string(list_filter(list_value('Brand: ' || brand, 'Model: ' || model, "
                f"'Price: $' || {_v('price_usd')}, 'Categories: ' || array_to_string(coalesce(category, []::VARCHAR[]), ', '), "
                f"'Plate Technology: ' || coalesce(plate, 'none'), "
                f"CASE WHEN drop_mm IS NOT NULL AND drop_mm <> 0 THEN 'Drop: ' || {_v('drop_mm')} || 'mm' END, "
                f"CASE WHEN weight_g IS NOT NULL AND weight_g <> 0 THEN 'Weight: ' || {_v('weight_g')} || 'g' END), "
                f"lambda x: x IS NOT NULL), {NL})")

SHORT_FULL = """
short_full AS (
  SELECT r.*, c.cushioning_level, c.support_type, c.heel_stack_mm, c.forefoot_stack_mm
  FROM ranked r JOIN catalog c ON r.catalog_pos = c.catalog_pos
)"""


def _json_list(x: str) -> str:
    return (f"coalesce('[' || array_to_string(list_transform({x}, lambda e: '\"' || e || '\"'), ', ') || ']', 'null')")


INPUTS_JSON = ("""'{"brand_preferences": ' || """ + _json_list("r_prefs")
               + """ || ', "intended_use": {"easy_runs": ' || CAST(r_easy AS VARCHAR) || ', "tempo_runs": ' ||
  CAST(r_tempo AS VARCHAR) || ', "long_runs": ' || CAST(r_long AS VARCHAR) || ', "races": ' || """
               + _json_list("r_races")
               + """ || ', "trail": ' || CAST(r_trail AS VARCHAR) || '}, "cost_limiter": {"enabled": ' ||
  CAST(r_limiter AS VARCHAR) || ', "max_usd": ' || CAST(r_max_usd AS VARCHAR) || '}, "num_recommendations": ' ||
  CAST(r_n AS VARCHAR) || ', "allow_carbon": ' || CAST(r_allow_carbon AS VARCHAR) || ', "weights": ' ||
  CASE WHEN request_id % 6 = 5 THEN 'null' ELSE '{"brand": ' || CAST(w_brand AS VARCHAR) || ', "budget": ' ||
  CAST(w_budget AS VARCHAR) || ', "easy_runs": ' || CAST(w_easy AS VARCHAR) || ', "tempo_runs": ' ||
  CAST(w_tempo AS VARCHAR) || ', "long_runs": ' || CAST(w_long AS VARCHAR) || ', "races": ' ||
  CAST(w_races AS VARCHAR) || '}' END || '}'""")


def candidate_prompts() -> str:
    from shortlist.schemas import SYSTEM_PROMPT, USER_TEMPLATE
    return with_ctes(*ENHANCED_BASE, SHORT_FULL) + f"""
, tables AS (
  SELECT request_id, count(*) AS n_candidates, string_agg({CANDIDATE_LINE}, {NL} ORDER BY rank) AS candidate_table
  FROM short_full GROUP BY request_id
),
prompts AS (
  SELECT t.*, {INPUTS_JSON} AS inputs_json FROM tables t JOIN requests USING (request_id)
),
filled AS (
  SELECT *, replace(replace({sql_str(USER_TEMPLATE)}, '{{{{inputs_json}}}}', inputs_json), '{{{{candidate_table}}}}',
    candidate_table) AS user_prompt FROM prompts
)
SELECT request_id, n_candidates, candidate_table, inputs_json, CAST(length(user_prompt) AS INTEGER) AS prompt_chars,
  md5(user_prompt) AS user_prompt_md5, md5({sql_str(SYSTEM_PROMPT)}) AS system_prompt_md5 FROM filled"""


def comparison_prompts() -> str:
    from shortlist.schemas import COMPARATIVE_TEMPLATE
    line = (f"{_v('rank')} || '. ' || brand || ' ' || model || ' - $' || {_v('price_usd')} || ' - [' || "
            f"array_to_string(list_transform(category, lambda x: '''' || x || ''''), ', ') || '] - ' || "
            f"coalesce(plate, 'None') || ' plate'")
    return with_ctes(*ENHANCED_BASE) + f"""
, agg AS (
  SELECT request_id, string_agg({line}, {NL} ORDER BY rank) AS shoes_list, count(*) AS n_shoes
  FROM ranked WHERE rank <= 3 GROUP BY request_id
)
SELECT a.request_id, a.n_shoes, a.shoes_list, {REQUIREMENTS} AS user_requirements,
  CASE WHEN a.n_shoes < 2 THEN 'Comparative analysis requires at least 2 shoes.' END AS gate_text,
  md5(CASE WHEN a.n_shoes >= 2 THEN replace(replace({sql_str(COMPARATIVE_TEMPLATE)}, '{{shoes_list}}', a.shoes_list),
    '{{user_requirements}}', {REQUIREMENTS}) END) AS prompt_md5
FROM agg a JOIN preq p ON a.request_id = p.request_id"""


WEB = f"""
web_hits AS (
  SELECT CAST(doc_id // 2 AS BIGINT) AS catalog_pos, CAST(doc_id % 2 + 1 AS INTEGER) AS pos,
    'https://reviews.example.org/' || source || '/' || CAST(doc_id AS VARCHAR) AS url, text AS content FROM documents
),
hits AS MATERIALIZED (
  SELECT * EXCLUDE (content), substr(replace({strip('content')}, {NL}, ' '), 1, 600) AS snippet FROM web_hits
  WHERE pos <= 2 AND coalesce({strip('content')}, '') <> ''
),
ctx AS (
  SELECT r.request_id, r.rank, r.catalog_pos,
    coalesce(list(h.snippet ORDER BY h.pos) FILTER (WHERE h.url IS NOT NULL), []::VARCHAR[]) AS summaries,
    coalesce(list(h.url ORDER BY h.pos) FILTER (WHERE h.url IS NOT NULL), []::VARCHAR[]) AS sources
  FROM ranked r LEFT JOIN hits h ON r.catalog_pos = h.catalog_pos WHERE r.rank <= 2
  GROUP BY r.request_id, r.rank, r.catalog_pos
)"""

FINDINGS = (f"(CASE WHEN len(summaries) > 0 THEN {NL} || {NL} || 'Web Findings (summarized):' || {NL} || '- ' || "
            f"array_to_string(summaries, {NL} || '- ') ELSE '' END || CASE WHEN len(sources) > 0 THEN {NL} || {NL} || "
            f"'Sources: ' || array_to_string(sources, ', ') ELSE '' END)")


def web_context() -> str:
    return with_ctes(*ENHANCED_BASE, WEB) + f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos, CAST(len(sources) AS INTEGER) AS n_sources,
  array_to_string(sources, ' ') AS sources, md5({FINDINGS}) AS findings_md5
FROM ctx"""


def detail_prompts() -> str:
    from shortlist.schemas import DETAILED_TEMPLATE
    base = (f"replace(replace({sql_str(DETAILED_TEMPLATE)}, '{{shoe_details}}', {SHOE_DETAILS}), "
            f"'{{user_requirements}}', {REQUIREMENTS})")
    return with_ctes(*ENHANCED_BASE, WEB) + f"""
, d AS (
  SELECT r.*, coalesce(x.summaries, []::VARCHAR[]) AS summaries, coalesce(x.sources, []::VARCHAR[]) AS sources
  FROM ranked r LEFT JOIN ctx x ON r.request_id = x.request_id AND r.rank = x.rank
)
, prompts AS MATERIALIZED (SELECT request_id, rank, catalog_pos, {base} || {FINDINGS} AS prompt FROM d)
SELECT request_id, CAST(rank AS INTEGER) AS rank, catalog_pos, md5(prompt) AS prompt_md5,
  CAST(length(prompt) AS INTEGER) AS prompt_chars FROM prompts"""


def tech_lookup() -> str:
    from shortlist.schemas import TECHNICAL_TEMPLATE
    text = (f"CASE WHEN catalog_pos IS NOT NULL THEN replace(replace({sql_str(TECHNICAL_TEMPLATE)}, '{{shoe_details}}', "
            f"{SHOE_DETAILS}), '{{focus_area}}', focus_area) ELSE 'Shoe ' || l_brand || ' ' || l_model || "
            f"' not found in catalog.' END")
    return with_ctes(CATALOG) + f"""
, lookups AS (
  SELECT CAST(p_partkey AS BIGINT) AS lookup_id,
    {BRAND_LIST}[CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 13 + 1] AS l_brand,
    CASE WHEN p_partkey % 4 = 3 THEN p_name || ' X' ELSE p_name END AS l_model,
    CASE WHEN p_partkey % 3 = 0 THEN 'durability' ELSE 'performance' END AS focus_area FROM part
),
j AS (
  SELECT * FROM lookups l LEFT JOIN catalog c ON l.l_brand = c.brand AND l.l_model = c.model
  QUALIFY row_number() OVER (PARTITION BY lookup_id ORDER BY catalog_pos NULLS LAST) = 1
)
SELECT lookup_id, catalog_pos IS NOT NULL AS found, catalog_pos, md5({text}) AS text_md5 FROM j"""


# --- replies, explanation quality and depth -------------------------------------------------

REPLIES = f"""
conv AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
conv_lines AS (
  SELECT *, list_filter(string_split(text, {NL}), lambda x: x <> '') AS ls FROM conv
),
replies AS (
  SELECT CAST(conv_id AS BIGINT) AS request_id, CAST(turn AS BIGINT) AS turn,
    CASE WHEN conv_id % 20 = 15 THEN '[]' WHEN conv_id % 5 = 0 THEN js
      WHEN conv_id % 10 = 1 THEN '```json' || {NL} || js || {NL} || '```'
      WHEN conv_id % 10 = 6 THEN '```' || {NL} || js || {NL} || '```'
      WHEN conv_id % 5 = 2 THEN 'Here you go: ' || js || ' Thanks.' WHEN conv_id % 5 = 3 THEN text
      ELSE '["' || array_to_string(list_transform(ls, lambda x: regexp_replace(x, '["\\\\]', '', 'g')), '", "')
        || '", 1]' END AS reply_text
  FROM (SELECT *, CAST(to_json(ls) AS VARCHAR) AS js FROM conv_lines)
)"""


def string_list(t: str) -> str:
    return (f"(CASE WHEN json_valid({t}) THEN (CASE WHEN json_type({t}) = 'ARRAY' THEN (CASE WHEN "
            f"len(list_filter(json_type({t}, '$[*]'), lambda y: y <> 'VARCHAR')) = 0 THEN "
            f"from_json({t}, '[\"VARCHAR\"]') END) END) END)")


PARSED = f"""
parsed0 AS (
  SELECT request_id, turn, reply_text,
    {string_list('reply_text')} AS whole,
    CASE WHEN contains(reply_text, '```') THEN list_filter(list_transform(list_filter(list_transform(
      string_split(reply_text, '```'), lambda p: {strip('p')}), lambda p: lower(p) <> 'json' AND p <> ''),
      lambda q: {string_list('q')}), lambda a: a IS NOT NULL)[1] END AS fenced,
    {string_list("regexp_extract(reply_text, '(?s)\\[.*?\\]', 0)")} AS bracket
  FROM replies
),
parsed AS (
  SELECT request_id, turn, coalesce(whole, fenced, bracket, [{sql_str(GENERIC_REPLY_TEXT)}]) AS items,
    CASE WHEN whole IS NOT NULL THEN 'json' WHEN fenced IS NOT NULL THEN 'fence'
      WHEN bracket IS NOT NULL THEN 'bracket' ELSE 'fallback' END AS method
  FROM parsed0
)"""


def reply_parsing() -> str:
    return with_ctes(REPLIES, PARSED) + """
SELECT request_id, turn, method, CAST(len(items) AS INTEGER) AS n_items, md5(array_to_string(items, ' || ')) AS items_md5
FROM parsed"""


def final_explanations() -> str:
    return final_explanations_of(with_ctes(*ENHANCED_BASE, REPLIES, PARSED), "parsed", "catalog_pos, ")


def final_explanations_of(ctes: str, replies: str, columns: str) -> str:
    """Explanations of ``ranked`` rows from parsed ``replies``; ``columns`` of
    the ranked rows are kept."""
    from shortlist.schemas import UNAVAILABLE_TEXT
    suffix = (f"CASE WHEN rank = 1 THEN {NL} || {NL} || '**TOP RECOMMENDATION #' || CAST(rank AS VARCHAR) || "
              f"'**: This shoe ranked highest due to optimal alignment with your requirements.' ELSE {NL} || {NL} || "
              f"'**RECOMMENDATION #' || CAST(rank AS VARCHAR) || '**: Strong alternative option with specific advantages.' END")
    body = (f"CASE WHEN reply IS NULL THEN {sql_str(UNAVAILABLE_TEXT)} WHEN trim(reply) = '' THEN "
            f"'This shoe offers solid performance for your running needs with good technical specifications.' ELSE reply END")
    return ctes + f"""
, first_reply AS (
  SELECT * FROM {replies} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY turn) = 1
),
aligned AS (
  SELECT r.*,
    CASE WHEN f.items IS NOT NULL THEN coalesce(f.items[r.rank], {sql_str(GENERIC_REPLY_TEXT)}) END AS reply
  FROM ranked r LEFT JOIN first_reply f ON r.request_id = f.request_id
)
SELECT request_id, CAST(rank AS INTEGER) AS rank, {columns}reply IS NOT NULL AS has_reply,
  md5(({body}) || ({suffix})) AS why_llm_md5
FROM aligned"""


def explanation_quality() -> str:
    from shortlist.schemas import DETAIL_INDICATORS, GENERIC_PHRASES
    low = "lower(text)"
    generic = " OR ".join(f"contains({low}, '{p}')" for p in GENERIC_PHRASES)
    count = " + ".join(f"(CASE WHEN contains({low}, '{w}') THEN 1 ELSE 0 END)" for w in DETAIL_INDICATORS)
    return f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
  CASE WHEN text IS NULL OR {strip('text')} = '' THEN 0.8 WHEN {generic} THEN 0.9
    WHEN ({count}) >= 3 THEN 1.2 WHEN ({count}) >= 2 THEN 1.1 WHEN ({count}) >= 1 THEN 1.0 ELSE 0.95 END::DOUBLE
    AS quality_multiplier
FROM (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN text || ' Carbon.'
    WHEN 2 THEN text || ' Carbon, low drop.' WHEN 3 THEN text || ' Carbon, low drop, light weight.'
    WHEN 4 THEN text || ' Solid fit for the stated use; consider feel and budget tradeoffs.' ELSE text END AS text
  FROM conversations WHERE role = 'assistant')"""


def explanation_depth() -> str:
    norm = collapse("coalesce(text, '')")
    facts = (f"list_filter(list_value("
             f"CASE WHEN coalesce(plate, '') NOT IN ('', 'none') THEN plate || ' plate' END, "
             f"CASE WHEN drop_mm IS NOT NULL THEN {_v('drop_mm')} || 'mm drop' END, "
             f"CASE WHEN weight_g IS NOT NULL THEN '~' || {_v('weight_g')} || 'g weight' END, "
             f"CASE WHEN coalesce(cushioning_level, '') <> '' THEN cushioning_level || ' cushioning' END, "
             f"CASE WHEN coalesce(support_type, '') <> '' THEN support_type || ' support' END, "
             f"CASE WHEN heel_stack_mm IS NOT NULL AND forefoot_stack_mm IS NOT NULL THEN 'stack ' || "
             f"{_v('heel_stack_mm')} || '/' || {_v('forefoot_stack_mm')} || 'mm' END, "
             f"CASE WHEN coalesce(len(category), 0) > 0 THEN 'category: ' || array_to_string(category, ', ') END), "
             f"lambda x: x IS NOT NULL)")
    return with_ctes(CATALOG, REQUESTS) + f"""
, d0 AS (
  SELECT v.conv_id, v.turn, {norm} AS norm, c.*, r.r_limiter, r.r_max_usd
  FROM conversations v LEFT JOIN catalog c ON c.catalog_pos = v.conv_id
  LEFT JOIN preq r ON r.request_id = v.conv_id
  WHERE v.role = 'assistant'
),
d1 AS (
  SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(regexp_extract_all(norm, '[.!?]\\s+')) + 1 END AS n_sentences,
    list_filter(list_value(
      CASE WHEN len({facts}) > 0 THEN 'Specs: ' || array_to_string({facts}[1:3], ', ') || '.' END,
      CASE WHEN r_limiter AND price_usd IS NOT NULL AND price_usd <> 0 AND price_usd > r_max_usd
        THEN 'Priced above budget; consider for performance value.' END), lambda x: x IS NOT NULL) AS adds
  FROM d0
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(n_sentences AS INTEGER) AS n_sentences,
  md5(CASE WHEN n_sentences < 2 AND len(adds) > 0 THEN
    (CASE WHEN norm <> '' THEN norm ELSE brand || ' ' || model || ' fits your ' ||
       array_to_string(coalesce(category, []::VARCHAR[]), ', ') || ' needs.' END) || ' ' || array_to_string(adds, ' ')
    ELSE norm END) AS text_md5
FROM d1"""


def reply_alignment() -> str:
    return with_ctes(*ENHANCED_BASE, REPLIES, PARSED) + f"""
SELECT r.request_id, CAST(r.rank AS INTEGER) AS rank, f.turn, f.method,
  md5(CASE WHEN f.items IS NOT NULL THEN coalesce(f.items[r.rank], {sql_str(GENERIC_REPLY_TEXT)}) END) AS reply_md5,
  f.items IS NOT NULL AND f.items[r.rank] IS NULL AS generic_fill
FROM ranked r LEFT JOIN parsed f ON r.request_id = f.request_id"""
