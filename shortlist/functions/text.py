"""Text-building column functions.

Inputs are shortlist rows with request fields (``r_*``) and product fields
next to each other. Texts are assembled with ``array_compact`` of optional
parts and ``array_join``/``concat_ws`` - never per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlist.schemas import (FEW_RESULTS_NOTE, NO_MATCH_NOTE, OVER_BUDGET_NOTE, RANKING_NOTE,
                               UNAVAILABLE_TEXT)

c = F.col


def _cat(tag: str) -> Column:
    return F.coalesce(F.array_contains(c("category"), tag), F.lit(False))


def _join(parts: list[Column], sep: str, default: str) -> Column:
    joined = F.array_join(F.array_compact(F.array(*parts)), sep)
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def num_text(x: Column) -> Column:
    """Python ``str()`` of an int or float column (ints stay ints). A large
    double is not written with an exponent, as Spark's own cast would."""
    text = x.cast("string")
    plain = F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    whole = text.contains("E") & (F.abs(x) >= 1e7) & (F.abs(x) < 1e16)
    return F.when(whole, plain).otherwise(text)


# --- T1 / T2 rule reasons -----------------------------------------------------

def rule_reasons_basic() -> Column:
    use = (F.when(_cat("race") & c("r_has_races"), F.lit("Race-focused design"))
           .when(_cat("tempo") & c("r_tempo"), F.lit("Tempo run optimized"))
           .when((_cat("daily") | _cat("easy")) & c("r_easy"), F.lit("Daily training suitable")))
    plate = (F.when((c("plate") == "carbon") & c("r_has_races"), F.lit("Carbon plate for speed"))
             .when((c("plate") == "nylon") & c("r_tempo"), F.lit("Nylon plate for tempo")))
    budget = F.when(c("r_limiter") & (c("price_usd") > c("r_max_usd")),
                    F.lit("Above budget but high-performance"))
    return _join([use, plate, budget], "; ", "Matches your criteria")


def rule_reasons_enhanced() -> Column:
    use = (F.when(_cat("race") & c("r_has_races"), F.lit("Optimized for racing performance"))
           .when(_cat("tempo") & c("r_tempo"), F.lit("Designed for tempo and threshold training"))
           .when((_cat("daily") | _cat("easy")) & c("r_easy"),
                 F.lit("Perfect for daily training and easy runs")))
    p = F.coalesce(c("plate"), F.lit("none"))
    plate = (F.when((p == "carbon") & c("r_has_races"), F.lit("Carbon plate provides racing efficiency"))
             .when((p == "nylon") & c("r_tempo"),
                   F.lit("Nylon plate adds responsiveness for speed work")))
    w = c("weight_g")
    truthy = w.isNotNull() & (w != 0)
    weight = (F.when(truthy & c("r_has_races") & (w < 220),
                     F.concat(F.lit("Lightweight design ("), num_text(w), F.lit("g) for racing speed")))
              .when(truthy & c("r_easy") & (w >= 250) & (w <= 320),
                    F.concat(F.lit("Balanced weight ("), num_text(w),
                             F.lit("g) for comfortable training"))))
    ratio = F.try_divide(c("price_usd"), c("r_max_usd"))
    budget = (F.when(c("r_limiter") & (ratio <= 0.8), F.lit("Excellent value within budget"))
              .when(c("r_limiter") & (ratio > 1.0), F.lit("Premium option with advanced features")))
    n, r = c("mk_review_count"), c("mk_rating")
    popular = F.when(n > 50, F.concat(F.lit("Popular choice with "), num_text(n), F.lit(" reviews")))
    rated = F.when(r >= 4.5, F.concat(F.lit("Highly rated ("), num_text(r), F.lit("/5.0)")))
    return _join([use, plate, weight, budget, popular, rated], "; ", "Well-suited for your running needs")


# --- T4 / T5 / T6 request and product texts ------------------------------------

def use_case_labels(trail_label: str = "Trail") -> Column:
    """T4 (``Trail``) and the requirement list of T5 (``Trail running``)."""
    racing = F.coalesce(F.size(c("r_races")) > 0, F.lit(False))
    return F.array_compact(F.array(
        F.when(c("r_easy"), F.lit("Easy runs")), F.when(c("r_tempo"), F.lit("Tempo runs")),
        F.when(c("r_long"), F.lit("Long runs")), F.when(racing, F.lit("Racing")),
        F.when(c("r_trail"), F.lit(trail_label))))


def use_case_text() -> Column:                                           # T4
    j = F.array_join(use_case_labels(), ", ")
    return F.when(j == "", F.lit("General running")).otherwise(j)


def requirements_text() -> Column:                                       # T5
    uses = F.array_join(use_case_labels("Trail running"), ", ")
    prefs = F.array_join(c("r_prefs"), ", ")
    return _join([
        F.when(uses != "", F.concat(F.lit("Intended Use: "), uses)),
        F.when(F.coalesce(F.size(c("r_prefs")) > 0, F.lit(False)),
               F.concat(F.lit("Preferred Brands: "), prefs)),
        F.when(c("r_limiter"), F.concat(F.lit("Budget: Maximum $"), num_text(c("r_max_usd")))),
    ], "\n", "General running needs")


def shoe_details_text(technical: bool = False) -> Column:               # T6
    d, w = c("drop_mm"), c("weight_g")
    parts = [
        F.concat(F.lit("Brand: "), c("brand")),
        F.concat(F.lit("Model: "), c("model")),
        F.concat(F.lit("Price: $"), num_text(c("price_usd"))),
        F.concat(F.lit("Categories: "), F.array_join(F.coalesce(c("category"), F.array()), ", ")),
        F.concat(F.lit("Plate Technology: "), F.coalesce(c("plate"), F.lit("none"))),
        F.when(d.isNotNull() & (d != 0), F.concat(F.lit("Drop: "), num_text(d), F.lit("mm"))),
        F.when(w.isNotNull() & (w != 0), F.concat(F.lit("Weight: "), num_text(w), F.lit("g"))),
    ]
    if technical:
        desc, feats = c("description"), c("features")
        parts += [
            F.when(F.coalesce(desc, F.lit("")) != "",
                   F.concat(F.lit("Description: "), F.substring(desc, 1, 200), F.lit("..."))),
            F.when(F.coalesce(F.size(feats), F.lit(0)) > 0,
                   F.concat(F.lit("Key Features: "), F.array_join(F.slice(feats, 1, 3), ", "))),
        ]
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


# --- T7 candidate line ------------------------------------------------------------

def candidate_line() -> Column:
    """``- brand model | cat=.. | price=$.. | plate=.. | drop=..mm`` plus the
    optional specs. A missing or null drop prints ``?``."""
    return F.concat_ws(" | ", F.array_compact(F.array(
        F.concat(F.lit("- "), c("brand"), F.lit(" "), c("model")),
        F.concat(F.lit("cat="), F.array_join(F.coalesce(c("category"), F.array()), ",")),
        F.concat(F.lit("price=$"), F.coalesce(num_text(c("price_usd")), F.lit("?"))),
        F.concat(F.lit("plate="), F.coalesce(c("plate"), F.lit("none"))),
        F.concat(F.lit("drop="), F.coalesce(num_text(c("drop_mm")), F.lit("?")), F.lit("mm")),
        F.when(c("weight_g").isNotNull(), F.concat(F.lit("weight="), num_text(c("weight_g")), F.lit("g"))),
        F.when(F.coalesce(c("cushioning_level"), F.lit("")) != "",
               F.concat(F.lit("cushioning="), c("cushioning_level"))),
        F.when(F.coalesce(c("support_type"), F.lit("")) != "", F.concat(F.lit("support="), c("support_type"))),
        F.when(c("heel_stack_mm").isNotNull() & c("forefoot_stack_mm").isNotNull(),
               F.concat(F.lit("stack="), num_text(c("heel_stack_mm")), F.lit("/"),
                        num_text(c("forefoot_stack_mm")), F.lit("mm"))),
    )))


# --- T10-T13 ------------------------------------------------------------------------

def web_findings_text(summaries: Column, sources: Column) -> Column:      # T10
    has_s = F.coalesce(F.size(summaries), F.lit(0)) > 0
    has_u = F.coalesce(F.size(sources), F.lit(0)) > 0
    return F.concat(
        F.when(has_s, F.concat(F.lit("\n\nWeb Findings (summarized):\n- "),
                               F.array_join(summaries, "\n- "))).otherwise(F.lit("")),
        F.when(has_u, F.concat(F.lit("\n\nSources: "), F.array_join(sources, ", "))).otherwise(F.lit("")))


def rank_suffix(rank: Column) -> Column:                                  # T11
    return F.when(rank == 1, F.concat(F.lit("\n\n**TOP RECOMMENDATION #"), rank.cast("string"),
                                      F.lit("**: This shoe ranked highest due to optimal alignment with "
                                            "your requirements."))) \
        .otherwise(F.concat(F.lit("\n\n**RECOMMENDATION #"), rank.cast("string"),
                            F.lit("**: Strong alternative option with specific advantages.")))


def explanation_with_fallback(reply: Column, rank: Column) -> Column:     # T12
    """A missing reply (model down) becomes the unavailable sentence; an
    empty reply the generic one; a reply gets the rank suffix."""
    empty = "This shoe offers solid performance for your running needs with good technical specifications."
    body = (F.when(reply.isNull(), F.lit(UNAVAILABLE_TEXT))
            .when(F.trim(reply) == "", F.lit(empty)).otherwise(reply))
    return F.concat(body, rank_suffix(rank))


def rule_explanation(rank: Column) -> Column:                            # T12
    """The sentence for when the analysis of one shoe fails."""
    kinds = F.concat(F.lit("['"), F.array_join(c("category"), "', '"), F.lit("']"))
    kinds = F.when(c("category").isNull(), F.lit("None")).when(F.size("category") == 0, F.lit("[]")).otherwise(kinds)
    return F.concat(
        F.lit("This "), c("brand"), F.lit(" "), c("model"), F.lit(" is recommended for your use case based on its "),
        F.coalesce(c("plate"), F.lit("None")), F.lit(" construction and "), kinds,
        F.lit(" design. **RECOMMENDATION #"), rank.cast("string"), F.lit("**: "),
        F.when(rank == 1, F.lit("Top choice")).otherwise(F.lit("Strong alternative option")),
        F.lit(" with specific advantages."))


def comparison_fallback(n_shoes: Column) -> Column:                      # T13
    return F.concat(F.lit("Comparative analysis temporarily unavailable. All "), n_shoes.cast("string"),
                    F.lit(" shoes meet your basic requirements with varying strengths in different areas."))


def comparison_gate(n_shoes: Column) -> Column:                          # T13
    return F.when(n_shoes < 2, F.lit("Comparative analysis requires at least 2 shoes."))


def technical_fallback(focus: Column) -> Column:                         # T13
    return F.concat(
        F.lit("Technical analysis temporarily unavailable. This "), c("brand"), F.lit(" "), c("model"),
        F.lit(" features "), F.coalesce(c("plate"), F.lit("standard")), F.lit(" technology with "),
        F.coalesce(num_text(c("weight_g")), F.lit("moderate")), F.lit("g weight and "),
        F.coalesce(num_text(c("drop_mm")), F.lit("standard")), F.lit("mm drop for "), focus,
        F.lit(" optimization."))


# --- T16 / T17 response notes and display columns ----------------------------------

def response_notes(n_items: Column, n_over: Column) -> Column:
    return F.when(n_items == 0, F.array(F.lit(NO_MATCH_NOTE))).otherwise(F.array_compact(F.array(
        F.when(n_over > 0, F.format_string(OVER_BUDGET_NOTE, n_over)),
        F.when(n_items < 3, F.lit(FEW_RESULTS_NOTE)),
        F.lit(RANKING_NOTE))))


def score_percent(score: Column) -> Column:
    """``"%.1f"|format(score * 100)`` with Python's half-even rounding."""
    from shortlist.functions.scoring import fmt_fixed
    return fmt_fixed(score * 100.0, 1)


def title_words(x: Column) -> Column:
    """Every word capitalised; words begin after white space, dashes and
    opening brackets."""
    runs = F.regexp_extract_all(x, F.lit(r"[-\s({\[<]+|[^-\s({\[<]+"), F.lit(0))
    return F.array_join(F.transform(runs, title_word), "")


def request_labels() -> dict[str, Column]:
    """The request summary of the result page."""
    races = F.coalesce(F.size("r_races") > 0, F.lit(False))
    uses = F.array_join(F.array_compact(F.array(
        F.when(c("r_easy"), F.lit("Easy Runs")), F.when(c("r_tempo"), F.lit("Tempo Runs")),
        F.when(c("r_long"), F.lit("Long Runs")), F.when(races, F.lit("Races")),
        F.when(c("r_trail"), F.lit("Trail")))), ", ")
    return {
        "brands_label": F.when(F.coalesce(F.size("r_prefs") > 0, F.lit(False)), F.array_join("r_prefs", ", "))
        .otherwise(F.lit("Any brand")),
        "carbon_label": F.when(c("r_allow_carbon"), F.lit("Included")).otherwise(F.lit("Excluded")),
        "use_label": F.when(uses == "", F.lit("General running")).otherwise(uses),
        "budget_label": F.when(c("r_limiter"), F.concat(F.lit("$"), num_text(c("r_max_usd"))))
        .otherwise(F.lit("No limit"))}


def title_word(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))
