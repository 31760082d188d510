"""Request x product predicates (F1-F6, J8) as Column expressions over a pair
row, plus the per-request set of category tags a product must carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


c = F.col

#: The use tags that filters look at, in the order of their mask bits.
USE_TAGS = ("daily", "easy", "tempo", "race", "long")


def brand_ok() -> Column:                                          # F1 / J8
    prefs = c("r_prefs")
    return F.coalesce(F.size(prefs) == 0, F.lit(True)) | \
        F.coalesce(F.array_contains(prefs, c("brand")), F.lit(False))


def carbon_ok() -> Column:                                         # F2
    return c("r_allow_carbon") | ~c("plate").eqNullSafe("carbon")


def _use_hits() -> Column:
    """Reads the product's category flags (``p_*``, see
    ``scoring.product_features``)."""
    return ((c("r_easy") & (c("p_daily") | c("p_easy")))
            | (c("r_tempo") & (c("p_tempo") | c("p_race")))
            | (c("r_long") & (c("p_long") | c("p_daily")))
            | (c("r_has_races") & c("p_race")))


def use_ok_basic() -> Column:                                      # F3
    return _use_hits() | (c("r_no_use") & (c("p_daily") | c("p_easy")))


def use_ok_enhanced() -> Column:                                   # F4
    return ~c("r_trail") & (_use_hits() | (c("r_no_use") & (c("p_daily") | c("p_easy"))))


def enhanced_ok() -> Column:                                       # F6
    return brand_ok() & carbon_ok() & use_ok_enhanced()


def basic_ok() -> Column:                                          # F1 and F3 (F5 is a window)
    return brand_ok() & use_ok_basic()


def allowed_tags(enhanced: bool) -> Column:
    """Category tags that satisfy the request's intended use: a product
    passes F3/F4 exactly when its category overlaps this set. Used to turn
    the theta join into an equi join on the tag mask."""
    tags = F.array_distinct(F.array_compact(F.array(
        F.when(c("r_easy"), F.lit("daily")), F.when(c("r_easy"), F.lit("easy")),
        F.when(c("r_tempo"), F.lit("tempo")), F.when(c("r_tempo"), F.lit("race")),
        F.when(c("r_long"), F.lit("long")), F.when(c("r_long"), F.lit("daily")),
        F.when(c("r_has_races"), F.lit("race")),
        F.when(c("r_no_use"), F.lit("daily")), F.when(c("r_no_use"), F.lit("easy")),
    )))
    if enhanced:
        return F.when(c("r_trail"), F.array().cast("array<string>")).otherwise(tags)
    return tags
