"""Request preparation (R1-R5): defaults, weight defaults, validation,
form coercion and the domain lists. All narrow (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.schemas import MAX_RECOMMENDATIONS, RACE_DISTANCES, USE_CATEGORIES

c = F.col
WEIGHT_NAMES = [("brand", "w_brand"), ("budget", "w_budget"), ("easy_runs", "w_easy"),
                ("tempo_runs", "w_tempo"), ("long_runs", "w_long"), ("races", "w_races")]


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill every optional field with its schema default, keeping the
    nested request shape (this is the echoed request)."""
    iu = c("intended_use")
    w = c("weights")
    return requests.select(
        "request_id",
        c("brand_preferences"),
        F.when(iu.isNotNull(), F.struct(
            _flag(iu["easy_runs"]).alias("easy_runs"),
            _flag(iu["tempo_runs"]).alias("tempo_runs"),
            _flag(iu["long_runs"]).alias("long_runs"),
            F.coalesce(iu["races"], F.array().cast("array<string>")).alias("races"),
            _flag(iu["trail"]).alias("trail"))).alias("intended_use"),
        F.when(c("cost_limiter").isNotNull(), F.struct(
            F.coalesce(c("cost_limiter.enabled"), F.lit(True)).alias("enabled"),
            c("cost_limiter.max_usd").alias("max_usd"))).alias("cost_limiter"),
        F.coalesce(c("num_recommendations"), F.lit(5)).alias("num_recommendations"),
        F.coalesce(c("allow_carbon"), F.lit(True)).alias("allow_carbon"),
        F.when(w.isNotNull(), F.struct(*[F.coalesce(w[n], F.lit(1.0)).alias(n)
                                         for n, _ in WEIGHT_NAMES])).alias("weights"),
    )


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Flat, defaulted request columns used by filters and scoring
    (``r_*`` flags, ``w_*`` weights, R1/R2)."""
    d = with_defaults(requests)
    iu = c("intended_use")
    has_races = F.size(iu["races"]) > 0
    cols = [
        c("request_id"),
        c("brand_preferences").alias("r_prefs"),
        iu["easy_runs"].alias("r_easy"),
        iu["tempo_runs"].alias("r_tempo"),
        iu["long_runs"].alias("r_long"),
        iu["races"].alias("r_races"),
        has_races.alias("r_has_races"),
        iu["trail"].alias("r_trail"),
        (~(iu["easy_runs"] | iu["tempo_runs"] | iu["long_runs"] | has_races | iu["trail"]))
        .alias("r_no_use"),
        c("cost_limiter.enabled").alias("r_limiter"),
        c("cost_limiter.max_usd").alias("r_max_usd"),
        c("num_recommendations").alias("r_n"),
        c("allow_carbon").alias("r_allow_carbon"),
    ]
    cols += [F.coalesce(c("weights")[n], F.lit(1.0)).alias(alias) for n, alias in WEIGHT_NAMES]
    return d.select(*cols)


#: What a body is told that is no JSON, or whose fields have other types.
BODY_ERROR = "body: not a JSON object that fits the request"


def validation_errors(requests: DataFrame) -> Column:
    """Array of error codes (empty = valid). A body that could not be
    parsed (its text is in ``source``) has this error alone."""
    errors = field_errors()
    if "source" not in requests.columns:
        return errors
    return F.when(c("source.text").isNotNull(), F.array(F.lit(BODY_ERROR))).otherwise(errors)


def field_errors() -> Column:
    n = c("num_recommendations")
    return F.array_compact(F.array(
        F.when(c("intended_use").isNull(), F.lit("intended_use: field required")),
        F.when(c("cost_limiter").isNull() | c("cost_limiter.max_usd").isNull(),
               F.lit("cost_limiter: field required")),
        F.when(c("cost_limiter.max_usd") <= 0, F.lit("cost_limiter.max_usd: must be greater than 0")),
        F.when(n.isNotNull() & ((n < 1) | (n > MAX_RECOMMENDATIONS)),
               F.lit("num_recommendations: must be between 1 and 20")),
    ))


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected-with-errors). Both sides come from one narrow
    projection; nothing is dropped silently. Rejected rows keep their
    ``source`` (file, line, text of an unreadable body) where they have one."""
    checked = requests.withColumn("errors", validation_errors(requests))
    source = [name for name in ("source",) if name in requests.columns]
    return (checked.filter(F.size("errors") == 0).drop("errors", *source),
            checked.filter(F.size("errors") > 0).select("request_id", "errors", *source))


def _num_or(col: str, default: float) -> Column:
    v = c(col)
    return F.when(v.isNull() | (v == ""), F.lit(default)).otherwise(
        F.coalesce(F.expr(f"try_cast({col} as double)"), F.lit(default)))


def coerce_form(raw: DataFrame) -> DataFrame:
    """Form fields -> request rows. "Any" among the brands clears the
    preference; checkboxes are presence tests; weights fall back to 1.0 on
    blank or bad text, while a bad budget or count stays null and is then
    rejected by validation (the form handler failed on those)."""
    checked = c("checked")

    def box(name: str) -> Column:
        return F.coalesce(F.array_contains(checked, name), F.lit(False))

    prefs = F.when(F.coalesce(F.array_contains(c("brand_preferences"), "Any"), F.lit(False)),
                   F.lit(None).cast("array<string>")).otherwise(c("brand_preferences"))
    budget = F.when(c("max_budget").isNull(), F.lit(200.0)).otherwise(
        F.expr("try_cast(max_budget as double)"))
    count = F.when(c("num_recommendations").isNull(), F.lit(5)).otherwise(
        F.expr("try_cast(num_recommendations as int)"))
    return raw.select(
        "request_id",
        prefs.alias("brand_preferences"),
        F.struct(box("easy_runs").alias("easy_runs"), box("tempo_runs").alias("tempo_runs"),
                 box("long_runs").alias("long_runs"),
                 F.coalesce(c("races"), F.array().cast("array<string>")).alias("races"),
                 box("trail").alias("trail")).alias("intended_use"),
        F.struct(F.coalesce(c("budget_enabled") == "on", F.lit(False)).alias("enabled"),
                 budget.alias("max_usd")).alias("cost_limiter"),
        count.alias("num_recommendations"),
        F.coalesce(c("allow_carbon") == "on", F.lit(False)).alias("allow_carbon"),
        F.struct(*[_num_or(f"weight_{n}", 1.0).alias(n) for n, _ in WEIGHT_NAMES]).alias("weights"),
    )


def domain_lists(spark: SparkSession) -> DataFrame:
    """The two fixed option lists as a tiny dimension table."""
    rows = [("race_distance", i, v) for i, v in enumerate(RACE_DISTANCES)] + \
        [("use_category", i, v) for i, v in enumerate(USE_CATEGORIES)]
    return spark.createDataFrame(rows, "list string, pos int, value string")
