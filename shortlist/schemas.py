"""Fixed StructTypes of the domain tables (never inferred) and the fixed
values the results depend on."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampType)

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the reference behaviour, in its order).
# ---------------------------------------------------------------------------

# Brands recognised in product titles, in match priority order, with the
# pattern that must follow the gender prefix (case-insensitive, unanchored).
BRAND_PATTERNS = [
    ("Brooks", r"Brooks\s+([A-Za-z0-9\s\-]+)"),
    ("ASICS", r"ASICS\s+([A-Za-z0-9\s\-]+)"),
    ("HOKA", r"HOKA\s+([A-Za-z0-9\s\-]+)"),
    ("Nike", r"Nike\s+([A-Za-z0-9\s\-]+)"),
    ("Adidas", r"Adidas\s+([A-Za-z0-9\s\-]+)"),
    ("Saucony", r"Saucony\s+([A-Za-z0-9\s\-]+)"),
    ("New Balance", r"New\s+Balance\s+([A-Za-z0-9\s\-]+)"),
    ("On", r"On\s+([A-Za-z0-9\s\-]+)"),
    ("Altra", r"Altra\s+([A-Za-z0-9\s\-]+)"),
    ("Mizuno", r"Mizuno\s+([A-Za-z0-9\s\-]+)"),
    ("Under Armour", r"Under\s+Armour\s+([A-Za-z0-9\s\-]+)"),
    ("Puma", r"Puma\s+([A-Za-z0-9\s\-]+)"),
    ("Reebok", r"Reebok\s+([A-Za-z0-9\s\-]+)"),
]
BRANDS = [b for b, _ in BRAND_PATTERNS]

# Gender prefix stripped from titles before the brand search.
GENDER_PREFIX = r"(?i)^(Men's|Men|Women's|Women|Unisex)\s+"

# Category tags and the words that set them (substring match on lower text).
CATEGORY_WORDS = [
    ("race", ["race", "racing", "competition"]),
    ("tempo", ["tempo", "speed", "fast"]),
    ("daily", ["daily", "training", "everyday"]),
    ("easy", ["easy", "recovery", "long"]),
    ("trail", ["trail", "off-road"]),
]

# Plate classes by pattern priority; "no plate"/"without plate" give none.
PLATE_PATTERNS = [
    (r"carbon\s+plate", "carbon"),
    (r"carbon\s+fiber\s+plate", "carbon"),
    (r"nylon\s+plate", "nylon"),
    (r"composite\s+plate", "composite"),
    (r"pebax\s+plate", "pebax"),
    (r"no\s+plate", "none"),
    (r"without\s+plate", "none"),
]

DROP_PATTERN = r"(\d+)\s*mm.*drop|drop.*(\d+)\s*mm|(\d+)\s*mm.*offset|offset.*(\d+)\s*mm"
WEIGHT_PATTERN = r"(\d+\.?\d*)\s*ounces?|(\d+\.?\d*)\s*oz"
OUNCE_GRAMS = 28.35
STACK_PATTERN = (r"(?i)(heel\s*)?(stack\s*)?[:\-]?\s*(\d{2})\s*mm\s*(heel)?\s*[/,\-\s]+\s*"
                 r"(\d{2})\s*mm\s*(forefoot)?")

CUSHION_WORDS = [
    ("plush", ["max cushion", "max cushioning", "plush cushioning", "super soft", "ultra plush"]),
    ("moderate", ["balanced cushion", "moderate cushion", "daily trainer cushion",
                  "medium cushioning", "balanced ride"]),
    ("firm", ["firm ride", "responsive ride", "snappy feel", "racing feel", "stiff ride"]),
]
STABILITY_WORDS = ["stability shoe", "pronation support", "medial post", "guide rails", "stabil",
                   "support shoe"]
WIDE_WORDS = ["wide", "2e", "4e"]

PRICE_MIN, PRICE_MAX, SALE_MIN_GAP = 50.0, 300.0, 10.0

# Brand tiers of the specialty bonus (upper-cased brand), per use case.
SPECIALTY_TIERS = {
    "races": [(["NIKE", "SAUCONY", "HOKA"], 0.12), (["ASICS", "NEW BALANCE"], 0.10), (["BROOKS"], 0.08)],
    "long": [(["HOKA", "BROOKS", "ASICS"], 0.12), (["NEW BALANCE", "SAUCONY"], 0.10)],
    "easy": [(["BROOKS", "ASICS", "NEW BALANCE"], 0.10), (["HOKA", "SAUCONY"], 0.08)],
}

# Explanation-quality phrase lists.
GENERIC_PHRASES = ["solid fit for the stated use", "consider feel and budget tradeoffs",
                   "good fit for your needs", "ai explanation unavailable"]
DETAIL_INDICATORS = ["carbon plate", "nylon plate", "drop", "weight", "cushioning", "responsive",
                     "stable", "lightweight", "durable"]

# Form domain lists.
RACE_DISTANCES = ["5k", "10k", "half_marathon", "marathon", "ultra"]
USE_CATEGORIES = ["easy_runs", "tempo_runs", "long_runs", "races", "trail"]
FACET_FALLBACK_BRANDS = ["Saucony", "Adidas", "Nike", "Hoka", "Brooks", "Any"]
FACET_FALLBACK_MAX_PRICE = 500

MAX_RECOMMENDATIONS = 20          # schema maximum of num_recommendations
OVER_BUDGET_QUOTA = 2             # basic engine: over-budget rows kept
WEB_ENRICH_TOP_K = 2              # web context only for ranks <= K
SNIPPET_CHARS = 600
REPLY_LIMIT_SECONDS = 12          # a model reply that takes longer gives way to the fallback

# Elements of a product page and of a listing page that hold its facts, in the
# order in which they are tried: ("testid" | "class" | "part" of the class, name,
# tag of the elements within it or None for itself); for links the block around
# them.
SELECTORS = {
    "price": [("testid", "price", None), ("class", "product-price", None), ("class", "price-current", None),
              ("class", "price-regular", None), ("class", "price-sale", None), ("part", "price", None)],
    "description": [("testid", "product-description", None), ("class", "product-description", None),
                    ("class", "description", None), ("class", "product-details", None), ("class", "product-info", None)],
    "review_count": [("testid", "review-count", None), ("class", "review-count", None), ("class", "reviews-count", None)],
    "rating": [("testid", "rating", None), ("class", "rating", None), ("class", "stars", None),
               ("class", "star-rating", None)],
    "features": [("class", "product-features", "li"), ("class", "features", "li"), ("class", "bullet-points", "li"),
                 ("class", "key-features", "li")],
    "pagination": [("nav", "Pagination"), ("class", "pagination"), ("testid", "pagination")],
}

# Fixed texts.
NO_MATCH_NOTE = "No shoes match your criteria. Try relaxing brand preferences or budget constraints."
OVER_BUDGET_NOTE = ("Note: %d recommendation(s) exceed your budget but offer premium performance "
                    "features.")
FEW_RESULTS_NOTE = "Fewer recommendations than usual - consider relaxing some constraints for more options."
RANKING_NOTE = ("Rankings use advanced AI analysis with dynamic scoring based on technical specs, "
                "market data, and use-case optimization.")
GENERIC_REPLY = "Solid fit for the stated use; consider feel and budget tradeoffs."
UNAVAILABLE_TEXT = "AI explanation unavailable. Using rules and specs to guide you."

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

CATALOG = StructType([
    StructField("catalog_pos", LongType(), False),
    StructField("brand", StringType(), False),
    StructField("model", StringType(), False),
    StructField("category", ArrayType(StringType()), True),
    StructField("price_usd", DoubleType(), True),
    StructField("plate", StringType(), True),
    StructField("drop_mm", DoubleType(), True),
    StructField("weight_g", IntegerType(), True),
    StructField("cushioning_level", StringType(), True),
    StructField("support_type", StringType(), True),
    StructField("heel_stack_mm", DoubleType(), True),
    StructField("forefoot_stack_mm", DoubleType(), True),
    StructField("best_for_distances", ArrayType(StringType()), True),
    StructField("has_wide_options", BooleanType(), True),
    # only where a size was asked for
    StructField("size_checked", StringType(), True),
    StructField("available_for_size", BooleanType(), True),
    StructField("sale_price_usd", DoubleType(), True),
])

ENHANCED_DATA = StructType([
    StructField("reviews", StructType([
        StructField("count", LongType()),
        StructField("average_rating", DoubleType()),
        StructField("recent_reviews", ArrayType(StringType())),
    ])),
    StructField("description", StringType()),
    StructField("features", ArrayType(StringType())),
    StructField("popularity_score", DoubleType()),
    StructField("availability_score", DoubleType()),
])

ENHANCED_CATALOG = StructType(CATALOG.fields + [
    StructField("enhanced_data", ENHANCED_DATA),
    StructField("web_source_url", StringType()),
    StructField("last_updated", TimestampType()),
])

INTENDED_USE = StructType([
    StructField("easy_runs", BooleanType()),
    StructField("tempo_runs", BooleanType()),
    StructField("long_runs", BooleanType()),
    StructField("races", ArrayType(StringType())),
    StructField("trail", BooleanType()),
])
COST_LIMITER = StructType([
    StructField("enabled", BooleanType()),
    StructField("max_usd", DoubleType()),
])
WEIGHTS = StructType([StructField(n, DoubleType()) for n in
                      ["brand", "budget", "easy_runs", "tempo_runs", "long_runs", "races"]])

REQUEST = StructType([
    StructField("request_id", LongType(), False),
    StructField("brand_preferences", ArrayType(StringType()), True),
    StructField("intended_use", INTENDED_USE, True),
    StructField("cost_limiter", COST_LIMITER, True),
    StructField("num_recommendations", IntegerType(), True),
    StructField("allow_carbon", BooleanType(), True),
    StructField("weights", WEIGHTS, True),
])

RAW_FORM = StructType([
    StructField("request_id", LongType(), False),
    StructField("brand_preferences", ArrayType(StringType())),
    StructField("checked", ArrayType(StringType())),          # checkbox names present
    StructField("races", ArrayType(StringType())),
    StructField("budget_enabled", StringType()),
    StructField("max_budget", StringType()),
    StructField("num_recommendations", StringType()),
    StructField("allow_carbon", StringType()),
    StructField("weight_brand", StringType()),
    StructField("weight_budget", StringType()),
    StructField("weight_easy_runs", StringType()),
    StructField("weight_tempo_runs", StringType()),
    StructField("weight_long_runs", StringType()),
    StructField("weight_races", StringType()),
])

LISTING_ANCHORS = StructType([
    StructField("page_no", LongType()),
    StructField("anchor_idx", IntegerType()),
    StructField("href", StringType()),
    StructField("aria_label", StringType()),
    StructField("text", StringType()),
    StructField("sibling_text", StringType()),
])

SIZE_OPTION = StructType([
    StructField("text", StringType()),
    StructField("class", StringType()),
    StructField("aria_disabled", StringType()),
    StructField("parent_class", StringType()),
])

PRODUCT_PAGES = StructType([
    StructField("url", StringType()),
    StructField("body_text", StringType()),
    StructField("price_texts", ArrayType(StringType())),
    StructField("size_options", ArrayType(SIZE_OPTION)),
    StructField("description_texts", ArrayType(StringType())),
    StructField("review_count_texts", ArrayType(StringType())),
    StructField("rating_texts", ArrayType(StringType())),
    StructField("feature_lists", ArrayType(ArrayType(StringType()))),
])

# Results and hits are keyed by the catalog row whose search gave them, replies
# by request and turn.
SEARCH_RESULTS = StructType([
    StructField("query_pos", LongType()),
    StructField("pos", IntegerType()),
    StructField("href", StringType()),
    StructField("link_text", StringType()),
])

WEB_HITS = StructType([
    StructField("catalog_pos", LongType()),
    StructField("pos", IntegerType()),
    StructField("url", StringType()),
    StructField("content", StringType()),
])

LLM_REPLIES = StructType([
    StructField("request_id", LongType()),
    StructField("turn", LongType()),
    StructField("reply_text", StringType()),
])

# ---------------------------------------------------------------------------
# Fixed prompt texts (must stay equal to the source prompts).
# ---------------------------------------------------------------------------

SYSTEM_PROMPT = """You are an expert running shoe gear assistant.
Constraints:
- Write 2–3 clear sentences per shoe with specific details.
- No medical or injury advice.
- Do not mention internal scoring; use only the provided specs, budget, and intended use.
- If a shoe exceeds budget, explicitly mark "above budget" and briefly justify why it could still be worth it.
- Output must be safe to embed into JSON (avoid stray quotes/newlines that break JSON)."""

USER_TEMPLATE = """User inputs:
{{inputs_json}}

Candidate shoes (from rules filter):
{{candidate_table}}

Task:
For each candidate, write 2–3 sentences that:
- Tie the shoe to the user's intended runs/races (e.g., daily, tempo, race distances if provided),
- Reference at least two concrete specs (e.g., plate type, drop, weight, cushioning level, support/stability, heel/forefoot stack),
- Include budget awareness (mark "above budget" if price > max and give a one-phrase justification).

IMPORTANT: Return ONLY a JSON array of strings, one per candidate, in the exact format:
["explanation for shoe 1", "explanation for shoe 2", "explanation for shoe 3"]

Do not include any other text, code fences, or formatting. Just the JSON array.
"""

DETAILED_TEMPLATE = """Analyze this running shoe for the user's needs in 2-3 sentences:

Shoe: {shoe_details}
User needs: {user_requirements}

Focus on: Why it's good for their use case, key technical advantages, and any limitations."""

COMPARATIVE_TEMPLATE = """You are comparing running shoes to help a runner make the best choice. Compare these shoes across:

1. PERFORMANCE COMPARISON
   - Speed/efficiency differences
   - Comfort and support variations
   - Durability expectations

2. USE CASE OPTIMIZATION
   - Which shoe excels in which scenarios
   - Training vs racing applications
   - Distance-specific recommendations

3. VALUE ANALYSIS
   - Price-to-performance ratio
   - Long-term cost considerations
   - Feature justification

4. RECOMMENDATION RANKING
   - Primary recommendation with strong rationale
   - Alternative options and why
   - Situations where each shoe is optimal

Shoes to Compare: {shoes_list}
User Requirements: {user_requirements}

Rank them 1-N with detailed justification for each ranking."""

TECHNICAL_TEMPLATE = """You are a biomechanics and running technology expert. Analyze this shoe's technical specifications:

1. BIOMECHANICAL ANALYSIS
   - Drop impact on running form
   - Weight effects on efficiency
   - Plate technology performance implications

2. MATERIAL SCIENCE
   - Foam and cushioning technology assessment
   - Upper construction benefits
   - Outsole durability and traction

3. PERFORMANCE ENGINEERING
   - Energy return characteristics
   - Stability and motion control features
   - Breathability and comfort engineering

4. SCIENTIFIC BACKING
   - Research-supported benefits
   - Measurable performance advantages
   - Limitations and trade-offs

Shoe: {shoe_details}
Focus Area: {focus_area}

Provide evidence-based technical analysis with specific examples."""


# Fixed values of HTML: elements that begin a new line, and named entities
# (the ampersand last, so that nothing is decoded twice).
BLOCK_TAGS = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|"
              "li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul")
ENTITIES = [("nbsp", " "), ("copy", "\u00a9"), ("reg", "\u00ae"), ("trade", "\u2122"), ("middot", "\u00b7"),
            ("bull", "\u2022"), ("ndash", "\u2013"), ("mdash", "\u2014"), ("hellip", "\u2026"),
            ("lsquo", "\u2018"), ("rsquo", "\u2019"), ("ldquo", "\u201c"), ("rdquo", "\u201d"),
            ("laquo", "\u00ab"), ("raquo", "\u00bb"), ("euro", "\u20ac"), ("pound", "\u00a3"),
            ("#39", "'"), ("apos", "'"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")]
