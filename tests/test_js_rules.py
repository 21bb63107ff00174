"""Edge rows of FIXTURES B for the JS coercion rules."""

import pytest
from pyspark.sql import functions as F

from consign.functions import js, text
from consign.operators import ingest
from tests.conftest import envelopes


def _eval_num(spark, raws):
    rows = [(i, "sale", None, "{" + (f'"q":{r}' if r is not None else "") + "}") for i, r in enumerate(raws)]
    df = ingest.parsed(envelopes(spark, rows), "sale")
    df, f = js.expand(df, "v", ["q"])
    out = df.select("seq", js.num(f["q"], 1).alias("n"),
                    js.floor_clamp(js.num(f["q"], 1), 0).alias("inv"),
                    js.floor_clamp(js.num(f["q"], 1), 1).alias("sale")).orderBy("seq").collect()
    return [(r.n, r.inv, r.sale) for r in out]


def test_number_coercion_table(spark):
    raws = [None, "null", '""', '"3.9"', '" 12 "', "-4", "true", '"abc"', '"7d"', '"7f"',
            '"Infinity"', '"NaN"', '"1e3"', "false"]
    got = _eval_num(spark, raws)
    want = [(1, 1, 1), (0, 0, 1), (0, 0, 1), (3.9, 3, 3), (12, 12, 12), (-4, 0, 1), (1, 1, 1),
            (1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (1000, 1000, 1000), (0, 0, 1)]
    assert got == want


@pytest.mark.parametrize("usd,cents", [
    (12.5, 1250), (1.23, 123), (19.99, 1999), (4.35, 435), (1.005, 100), (0.285, 28),
    (0.005, 1), (0.015, 2), (0.655, 66), (1.115, 112), (-0.025, -2), (-2.5e-2, -2)])
def test_usd_to_cents_js_rounding(spark, usd, cents):
    got = spark.range(1).select(js.round_half_up_cents(F.lit(usd)).alias("c")).first().c
    assert got == cents


def test_cents_of_missing_and_text(spark):
    rows = [(1, "sale", None, {"x": ""}), (2, "sale", None, {"x": None}), (3, "sale", None, {}),
            (4, "sale", None, {"x": "abc"}), (5, "sale", None, {"x": " 2.5 "})]
    df, f = js.expand(ingest.parsed(envelopes(spark, rows), "sale"), "v", ["x"])
    got = [r.c for r in df.select("seq", js.cents(f["x"]).alias("c")).orderBy("seq").collect()]
    assert got == [0, 0, 0, 0, 250]


def _expense(spark, body):
    base = {"date": "2024-01-02", "category": "fuel"}
    base.update(body)
    acc = ingest.ingest_expenses(envelopes(spark, [(1, "expense", None, base)])).accepted.first()
    return acc


@pytest.mark.parametrize("val,flag", [(0, 0), (0.0, 0), ("0", 0), (False, 1), (None, 1),
                                      ("", 1), ("00", 1), ("missing", 1)])
def test_deductible_flag(spark, val, flag):
    body = {} if val == "missing" else {"deductible": val}
    assert _expense(spark, body).deductible == flag


def test_mileage_rules(spark):
    r = _expense(spark, {"type": "mileage", "miles": 10.9, "rate_usd_per_mile": 0.67})
    assert (r.miles, r.rate_cents_per_mile, r.calc_amount_cents) == (10, 67, 670)
    r = _expense(spark, {"type": "mileage"})
    assert (r.miles, r.rate_cents_per_mile, r.calc_amount_cents) == (0, 0, 0)
    r = _expense(spark, {"type": "mileage ", "miles": 3})
    assert (r.type, r.miles, r.rate_cents_per_mile, r.calc_amount_cents) == ("mileage ", 3, 0, None)
    r = _expense(spark, {})
    assert (r.type, r.miles, r.calc_amount_cents) == ("standard", 0, None)


def test_text_helpers(spark):
    df = spark.createDataFrame([("my photo(1).JPG", "inventory/i1/u_f.jpg", -150)],
                               "name string, key string, n long")
    item, fname = text.key_parts(F.col("key"))
    r = df.select(text.safe_file_name(F.col("name")).alias("safe"),
                  text.file_extension(F.col("name")).alias("ext"), item.alias("item"),
                  fname.alias("fname"), text.money_text(F.col("n")).alias("m"),
                  text.money_text(F.lit(123456)).alias("m2")).first()
    assert (r.safe, r.ext, r.item, r.fname, r.m, r.m2) == (
        "my_photo_1_.JPG", "jpg", "i1", "u_f.jpg", "$-1.50", "$1234.56")
    item, fname = text.key_parts(F.lit("x"))
    r = spark.range(1).select(item.alias("a"), fname.alias("b")).first()
    assert (r.a, r.b) == (None, None)


def test_normalize_status_and_trim(spark):
    df = spark.createDataFrame([("Draft",), ("junk",), (None,)], "s string")
    assert [r.n for r in df.select(js.normalize_status(F.col("s")).alias("n")).collect()] == \
        ["draft", "active", "active"]
    r = spark.range(1).select(js.js_trim(F.lit(" \t x 　\n")).alias("t")).first()
    assert r.t == "x"


def test_strip_cr_bom(spark):
    df = spark.createDataFrame([("\ufeffa\r\nb\r\r\nc\r",)], "t string")
    assert df.select(text.strip_cr_bom(F.col("t")).alias("c")).first().c == "a\nb\r\nc"


def test_error_line_predicate(spark):
    hits = ["POST /inventory failed", "✗ create", "got 404 from api", "GET -> 503 retry", "ERROR x"]
    misses = ["ok 200", "id 4040", "-> 500"]
    df = spark.createDataFrame([(x,) for x in hits + misses], "value string")
    got = {r.value for r in df.where(text.is_error_line(F.col("value"))).collect()}
    assert got == set(hits)


def test_kind_edges_from_variant_type(spark):
    """Kinds come from the VARIANT type name: a huge number is a number (JS reads
    ``1e400`` as Infinity, not finite, so the default), objects and arrays are
    neither, and JSON null is 0."""
    assert _eval_num(spark, ["1e400", "-1e400", "{}", "[1]", "null", "1.5", "12345678901234567890"]) == [
        (1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (0, 0, 1), (1.5, 1, 1),
        (12345678901234567000.0, None, None)]
