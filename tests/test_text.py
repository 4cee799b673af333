"""Truth tables of the text expressions."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as t

PACKS = [
    (None, (None, "each", 1, "each", "regex")), ("  ", (None, "each", 1, "each", "regex")), ("box of 100", (100, "each", 1, "box", "regex")), ("case of 10 boxes", (10, "box", 10, "case", "regex")),
    ("case of 5 packs", (5, "box", 5, "case", "regex")), ("pack of 5", (5, "each", 1, "pack", "regex")), ("bags of 50", (50, "each", 1, "bags", "regex")), ("100/Box of 10", (10, "each", 1, "box", "regex")),
    ("100/Case of 10", (10, "each", 10, "case", "regex")), ("5/Pack of 2", (2, "each", 1, "pack", "regex")), ("100/Box", (100, "each", 1, "box", "regex")), ("1,000/cs", (1000, "each", 1, "case", "regex")),
    ("12 pairs", (2, "each", 12, "pair", "regex")), ("Pair", (2, "each", 1, "pair", "regex")), ("100ct", (100, "each", 1, "box", "regex")), ("100 Box", (100, "each", 1, "box", "regex")), ("EA", (1, "each", 1, "each", "regex")),
    ("100", (100, "each", 1, "box", "regex")), ("10 cases", (None, "each", 1, "each", "llm")), ("case of 12", (None, "each", 1, "each", "llm")), ("Slate-Blue", (None, "each", 1, "each", "llm")), ("9/tray of 0", (0, "each", 1, "tray", "regex")),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.r for r in df.select("k", f(F.col("v")).alias("r")).orderBy("k").collect()]


def test_pack(spark):
    assert [tuple(r) for r in column(spark, [p[0] for p in PACKS], t.pack)] == [p[1] for p in PACKS]


@pytest.mark.parametrize("raw,unit", [("Boxes", "box"), ("cs", "case"), ("bags", "bags"), ("pkgs", "pack"), ("EA.", "each"), ("pouches", "pouches")])
def test_units(spark, raw, unit):
    assert column(spark, [raw], t.normal_unit) == [unit]


def test_prices(spark):
    texts = ["$24.99", "24,99", "1,234.56", "1 234", "call", None, ""]
    assert column(spark, texts, t.price_text) == [24.99, 249.0, 123.0, None, None, None, None]
    assert column(spark, texts, lambda c: t.price_text(c, exact=True))[2] == 1234.56
    assert column(spark, ["$1,200.50", "0", "-3", "x", None], t.upsert_price) == [1200.5, None, None, None, None]


def test_variant_pack(spark):
    assert column(spark, ["Default Title", "Slate-Blue", "100/Box", "Box of 100", "50 Gloves", ""], t.variant_pack) == [None, None, "100 Box", "100 Box", "50 Gloves", None]


def test_sku(spark):
    assert column(spark, ["arm KX20417Q new", "see DRAFT-200451", "part 880214 ok", "none"], t.sku_token) == ["KX20417Q", "DRAFT-200451", "880214", None]


def test_line_prices(spark):
    assert column(spark, ["2. X — qty 3 @ $1,402.50 = $4,207.50", "was $10.00 now $8.50", "none"], t.line_prices) == [[1402.5], [10.0, 8.5], []]


def test_reasons(spark):
    reasons = ["Ambiguous: a", "Requested size 'xl' not found among top", "is implausibly low for", "unit-of-measure error or data entry anomaly: price", "has low confidence", "No products in catalog", "has no price on record", "brand/model signal"]
    assert column(spark, reasons, t.reason_category) == ["ambiguous", "size_not_found", "price_anomaly", "price_anomaly", "no_match", "no_match", "ambiguous", "ambiguous"]


def test_content_hash_keeps_fields_apart(spark):
    import hashlib

    df = spark.createDataFrame([(" a ", None, "b")], "x string, y string, z string")
    assert df.select(t.content_hash("x", "y", "z") if False else t.content_hash(F.col("x"), F.col("y"), F.col("z"))).first()[0] == hashlib.sha256(b"a\0\0b").hexdigest()
