from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lamina import functions as fn


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw,want", [("  ab   c ", "AB C"), ("", None), ("   ", None), (None, None)])
def test_std_string(spark, raw, want):
    assert one(spark, raw, fn.std_string) == want


@pytest.mark.parametrize("raw,want", [("k1a-0b1", "K1A0B1"), ("K1A 0B1", "K1A0B1"), ("12345", None), ("K1A0B", None), (None, None)])
def test_postal(spark, raw, want):
    assert one(spark, raw, fn.std_postal_code) == want


@pytest.mark.parametrize("raw,want", [("(613) 555-0199", "+16135550199"), ("1-613-555-0199", "+16135550199"), ("2-613-555-0199", None), ("5550199", None), (None, None)])
def test_phone(spark, raw, want):
    assert one(spark, raw, fn.std_phone) == want


@pytest.mark.parametrize("raw,want", [("4532015112", True), ("4532015113", False), ("4532-015-112", True), ("45320151", False), ("", False), (None, False)])
def test_health_card(spark, raw, want):
    def luhn(s):
        n = [int(c) for c in s]
        return sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(n)) % 10 == 0

    digits = "".join(c for c in raw or "" if c.isdigit())
    assert one(spark, raw, fn.health_card_valid) == (len(digits) == 10 and luhn(digits))


@pytest.mark.parametrize("raw,want", [("2001-02-03", date(2001, 2, 3)), ("03/02/2001", date(2001, 2, 3)), ("02/13/2001", date(2001, 2, 13)), ("31/02/1980", None), ("x", None), (None, None)])
def test_birth_date(spark, raw, want):
    assert one(spark, raw, fn.parse_birth_date) == want


@pytest.mark.parametrize("birth,band", [("2008-06-02", "0-17"), ("2007-06-01", "18-34"), ("1960-06-01", "65-74"), ("1940-06-01", "85+"), (None, "Unknown")])
def test_age_band(spark, birth, band):
    assert one(spark, birth, lambda c: fn.age_band(c.cast("date"), F.lit("2025-06-01").cast("date"))) == band


def test_row_hash_position_and_cosmetics(spark):
    df = spark.createDataFrame([(None, "A"), ("A", None), (" a ", None), ("b", "c")], "x string, y string")
    h = [r.h for r in df.select(fn.row_hash_of(["x", "y"]).alias("h")).collect()]
    assert h[0] != h[1] == h[2] and len(set(h)) == 3


def test_token_needs_salt_and_keeps_null(spark):
    assert one(spark, None, lambda c: fn.token_of(c, "s")) is None
    assert one(spark, " a", lambda c: fn.token_of(c, "s")) == one(spark, "A ", lambda c: fn.token_of(c, "s")) != one(spark, "A", lambda c: fn.token_of(c, "t"))


def test_record_uid_of_null_is_null(spark):
    assert one(spark, None, lambda c: fn.record_uid("EHR", c)) is None and one(spark, "1", lambda c: fn.record_uid("EHR", c)) == "EHR|1"


def test_stay_rules(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 9)), (datetime(2024, 1, 5), datetime(2024, 1, 1)), (datetime(2024, 1, 1), None)], "a timestamp, b timestamp")
    assert [tuple(r) for r in df.select(fn.stay_days("a", "b"), fn.minutes_between("a", "b")).collect()] == [(1, 60.0), (None, None), (None, None)]


def test_small_helpers(spark):
    df = spark.createDataFrame([("3", "1", "x:y", "PENDING", "1,250.00")], "lvl string, f string, p string, c string, m string")
    r = df.select(fn.level_1_to_5("lvl"), fn.flag("f"), fn.split_member("p", ":", 1), fn.split_member("p", ":", 4), fn.without_codes("c", ["PENDING"]), fn.decimal_text("m"), fn.rank_by("lvl", {"3": 7}), fn.rank_by("c", {"3": 7})).first()
    assert (r[0], r[1], r[2], r[3], r[4], float(r[5]), r[6], r[7]) == (3, True, "y", None, None, 1250.0, 7, 99)
    c = fn.cast_columns(df.select("m", "c"), {"m": "decimal(10,2)", "c": "int"}).first()
    assert float(c.m) == 1250.0 and c.c is None
    assert fn.new_batch_id("EHR", "a", datetime(2024, 1, 2, 3, 4, 5)) == "EHR_a_20240102T030405"
    assert rows(df.select(fn.members(F.lit("a|b"))))[0] == ("a",)
    assert df.select(fn.denied_amount(F.lit("4"), F.lit(10), F.lit(3)), fn.denied_amount(F.lit("1"), F.lit(10), F.lit(None))).first()[:] == (10, 0)
    assert df.select(fn.date_key(F.lit(None).cast("date")), fn.time_key(F.lit("2024-01-01 10:05:00").cast("timestamp"))).first()[:] == (-1, 605)


@pytest.mark.parametrize("raw,want", [(" doc1\t", "DOC1"), (" x ", "X"), (" ", None), (None, None)])
def test_plain_id(spark, raw, want):
    assert one(spark, raw, fn.plain_id) == want


def test_plain_attributes(spark):
    assert one(spark, " i10.4 ", fn.plain_code) == "I104" and one(spark, ".", fn.plain_code) == "" and one(spark, " ", fn.plain_code) is None
    assert one(spark, ".50", fn.plain_number) == one(spark, "0.500", fn.plain_number) and one(spark, "half", fn.plain_number) == "HALF"
    assert {one(spark, v, fn.plain_flag) for v in ("1", "Y", "true", "TRUE ")} == {"1"} and one(spark, None, fn.plain_flag) == ""
