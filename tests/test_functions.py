"""Hand-computed cases per column function (extraction, formatting,
replies, quality)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from shortlist.functions import extract as X
from shortlist.functions import scoring as sc
from shortlist.operators import replies as rp


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()["y"]


def test_title_case_keeps_python_rule(spark):
    assert one(spark, X.title_case(F.col("x")), "3d zoom-fly 2") == "3D Zoom-Fly 2"


def test_unanchored_brand_search(spark):
    r = one(spark, X.brand_model(F.col("x")), "Men's Salomon Speedcross 6")
    assert (r["brand"], r["model"]) == ("On", "Speedcross 6")
    r = one(spark, X.brand_model(F.col("x")), "Women's new   balance 1080 v13")
    assert (r["brand"], r["model"]) == ("New Balance", "1080 v13")
    assert one(spark, X.brand_model(F.col("x")), "Acme Runner") is None


def test_card_title_fallbacks(spark):
    df = spark.createDataFrame(
        [("short", "Nike Pegasus 41", None, "/product/x"),
         (None, "", "Brooks Ghost 17", "/product/brooks-ghost"),
         (None, "New", "Hoka", "/product/hoka-clifton-9?c=1"),
         (None, "", None, "/product/abc")],
        "a string, t string, s string, h string")
    got = [r[0] for r in df.select(X.card_title(F.col("a"), F.col("t"), F.col("s"), F.col("h"))).collect()]
    assert got == ["Nike Pegasus 41", "Brooks Ghost 17", "Hoka Clifton 9", None]


def test_greedy_drop_and_weight_rounding(spark):
    assert one(spark, X.drop_mm(F.col("x")), "drop: 10 mm") == 0.0
    assert one(spark, X.drop_mm(F.col("x")), "8 mm drop") == 8.0
    assert one(spark, X.weight_g(F.col("x")), "9.5 oz") == 269
    assert one(spark, X.weight_g(F.col("x")), "30 ounces") == 850


def test_plate_priority(spark):
    assert one(spark, X.plate_class(F.col("x")), "plate technology") == "none"
    assert one(spark, X.plate_class(F.col("x")), "carbon fiber plate and nylon plate") == "carbon"
    assert one(spark, X.plate_class(F.col("x")), "a nylon plate") == "nylon"


def test_price_pair(spark):
    def pair(texts):
        r = spark.createDataFrame([(texts,)], "x array<string>").select(X.price_pair(F.col("x")).alias("p")).first()["p"]
        return (r["price"], r["sale_price"])
    assert pair(["$129.99", "$99.99"]) == (129.99, 99.99)
    assert pair(["$129.99", "$125.00"]) == (129.99, None)
    assert pair(["Now 45.00"]) == (None, None)
    assert pair(["Was 140.00 now 120.00"]) == (140.0, 120.0)


def test_format_like_python(spark):
    for v in [1.225, 12.25, 2.675, 0.125, 73.5 / 60]:
        assert one(spark, sc.fmt_fixed(F.col("x"), 2), v, "x double") == f"{v:.2f}"


@pytest.mark.parametrize("text,method,items", [
    ('["a","b"]', "json", ["a", "b"]),
    ("[]", "json", []),
    ('```json\n["a"]\n```', "bracket", ["a"]),
    ('```\n["a"]\n```', "fence", ["a"]),
    ('Here: ["a", "b"] ok', "bracket", ["a", "b"]),
    ('["a", 1]', "fallback", ["Solid fit for the stated use; consider feel and budget tradeoffs."]),
    ("plain words", "fallback", ["Solid fit for the stated use; consider feel and budget tradeoffs."]),
])
def test_reply_parsing(spark, text, method, items):
    r = one(spark, rp.parse_reply(F.col("x")), text)
    assert (r["method"], list(r["items"])) == (method, items)


def test_explanation_quality(spark):
    q = lambda t: one(spark, sc.explanation_quality(F.col("x")), t)
    assert q("  ") == 0.8
    assert q("A solid fit for the stated use.") == 0.9
    assert q("Carbon plate, low drop and light weight.") == 1.2
    assert q("Nice shoe.") == 0.95


def test_dynamic_score_by_hand(spark):
    row = dict(r_has_races=True, r_tempo=False, r_long=False, r_easy=False, r_limiter=True, r_max_usd=100.0,
               r_prefs=None, w_brand=1.0, w_budget=1.0, w_easy=1.0, w_tempo=1.0, w_long=1.0, w_races=1.0,
               brand="Nike", model="X", category=["race"], price_usd=80.0, plate="carbon", drop_mm=4.0,
               weight_g=190, mk_review_count=None, mk_rating=None)
    schema = ("r_has_races boolean, r_tempo boolean, r_long boolean, r_easy boolean, r_limiter boolean, "
              "r_max_usd double, r_prefs array<string>, w_brand double, w_budget double, w_easy double, "
              "w_tempo double, w_long double, w_races double, brand string, model string, "
              "category array<string>, price_usd double, plate string, drop_mm double, weight_g int, "
              "mk_review_count bigint, mk_rating double")
    df = spark.createDataFrame([tuple(row.values())], schema)
    df = sc.request_gates(sc.product_features(df))
    out = sc.score_pairs(df, F.lit(False)).first()
    u = int(hashlib.md5(b"XNIKE").hexdigest()[:8], 16) / 2 ** 32
    jitter = -0.02 + 0.04 * u
    base, tech, spec = 1.0, 0.8, 0.45 + 0.12 + jitter + 0.08
    assert out["original_score"] == pytest.approx(base * 0.4 + tech * 0.3 + 0.0 + spec * 0.1, abs=1e-12)
    assert out["adjustment_multiplier"] == pytest.approx(1.1 * 1.05, abs=1e-12)
