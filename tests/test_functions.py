"""Scalar functions against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import dates, keys, numbers, text


def value(spark, column, given):
    return spark.createDataFrame([(given,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("1 234,56", 123456), ("1.234,56", 123456), ("1,234.56", 123456), ("1234.56", 123456), ("32155580.0", 3215558000), ("0.005", 1), ("-0.005", -1),
        ("1.234.567", 123456700), ("12", 1200), ("", None), (None, None), ("abc", None), ("1.2.3,4", 12340), ("-", None),
    ],
)
def test_minor_units(spark, given, wanted):
    got = value(spark, numbers.minor_units, given)
    assert (None if got is None else int(got)) == wanted


@pytest.mark.parametrize(("minor", "wanted"), [("3215558000", 643111600), ("3", 1), ("2", 0), ("-3", -1), ("-2", 0)])
def test_percent_rounds_half_away(spark, minor, wanted):
    assert int(value(spark, lambda c: numbers.percent_of(c.cast("decimal(20,0)"), 20), minor)) == wanted


def test_half_goes_away_from_zero(spark):
    half = lambda c: numbers.percent_of(c.cast("decimal(20,0)"), 50)
    assert [int(value(spark, half, x)) for x in ("5", "-5")] == [3, -3]


@pytest.mark.parametrize(("given", "wanted"), [("1.234,56", 1.234), ("12,5", 12.5), (" 7 ", 7.0), ("12abc", 12.0), ("нет", None), ("-", None), (".5", 0.5)])
def test_loose_number(spark, given, wanted):
    assert value(spark, numbers.loose_number, given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("11.09.2026", datetime.date(2026, 9, 11)), ("2026-09-11", datetime.date(2026, 9, 11)), ("10:15:30 11.09.2026", datetime.date(2026, 9, 11)),
        ("11.09.2026 10:15", datetime.date(2026, 9, 11)), ("31.02.2026", None), ("46276", datetime.date(2026, 9, 11)), ("", None), (None, None), ("01.01.1900", None), ("soon", None),
    ],
)
def test_date(spark, given, wanted):
    assert value(spark, dates.date, given) == wanted


def test_impossible_is_not_missing(spark):
    assert [value(spark, dates.is_impossible, x) for x in ("31.02.2026", "", None, "11.09.2026")] == [True, False, False, False]


def test_loose_dates_do_not_ask_the_calendar(spark):
    assert value(spark, dates.loose_date_text, "31.02.26 x") == "2026-02-31"
    assert value(spark, dates.loose_date, "31.02.26") is None
    assert value(spark, dates.loose_datetime_text, "10:20:30 1.2.2026") == "2026-02-01T10:20:30"
    assert value(spark, dates.loose_datetime_text, "1.2.2026") == "2026-02-01T00:00:00"


def test_banner_time(spark):
    got = value(spark, lambda c: dates.banner_time(c, F.lit(2026)), "as of 19 September, 14:05 h")
    assert got == datetime.datetime(2026, 9, 19, 14, 5)


def test_serial_date(spark):
    assert value(spark, lambda c: dates.serial_date(c.cast("double")), "46276.75") == datetime.date(2026, 9, 11)


@pytest.mark.parametrize("given", ['"POLVON QO_SHAR" FX', "POLVON QO'SHAR FX", "Полвон қўшар", "МЧЖ «Полвон  қўшар»", "Qo`shar polvon"])
def test_party_keys_agree(spark, given):
    assert value(spark, lambda c: text.token_key(text.party_key(c)), given) == "polvon qoshar"


def test_similarity(spark):
    df = spark.createDataFrame([("a b", "b a"), ("abcd", "abcx"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, 0.0]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("1-Qo`l terimi", "HAND"), ("Қўл терими", "HAND"), ("Кул терим", "HAND"), ("ручной", "HAND"), ("Машина терими", "MACHINE"), ("Kombayn", "MACHINE"), ("?", "UNKNOWN"), (None, "UNKNOWN")],
)
def test_method(spark, given, wanted):
    assert value(spark, text.harvest_method, given) == wanted


def test_labels(spark):
    assert [value(spark, text.shipment_status, x) for x in ("Approved", "Отклонён", "Отменено.", None)] == ["ACTIVE", "REJECTED", "CANCELLED", "UNKNOWN"]
    assert [value(spark, text.account_category, x) for x in ("Свободные средства", "Блокировано", "Деньги в пути", None)] == ["FREE", "BLOCKED", "IN_TRANSIT", "OTHER"]
    assert [value(spark, text.truth, x) for x in ("Да", "нет", "", None)] == [True, False, None, None]
    assert [value(spark, text.unit_factor, x) for x in ("кг", "тонна", "шт")] == [1, 1000, None]


def test_clean_and_headers(spark):
    assert value(spark, text.clean, "﻿ a ​ b\t c ") == "a b c"
    assert value(spark, text.header_key, "  ИНН (клиента):  Ёлка ") == "инн клиента елка"
    assert value(spark, text.ledger_header_key, "Брутто, кг.") == "брутто кг"


def test_keys(spark):
    assert value(spark, keys.client_code, "2020 8000 123456789") == "123456789"
    assert value(spark, keys.client_code, "12345") is None
    assert value(spark, lambda c: keys.deal_number(F.lit(None).cast("string"), c), "сд. № 77 оплата") == "77"
    assert value(spark, lambda c: keys.deal_number(c, F.lit("сд. № 77")), "C:5; D: 12;") == "12"
    a, b = (value(spark, lambda c, o=o: keys.fingerprint(c, F.lit(o)), None) for o in ("x", ""))
    assert a != b and len(a) == 32
    assert value(spark, lambda c: keys.fingerprint(c, F.lit("x")), "") != a


def test_display(spark):
    assert value(spark, lambda c: numbers.grouped(c.cast("double")), "1234567.5") == "1 234 567,50"
    assert [value(spark, lambda c: numbers.axis_step(c.cast("double")), x) for x in ("47", "100", "12", "0")] == [10.0, 20.0, 2.5, 1.0]


def test_all_written_forms_of_a_date(spark):
    from tallyfield.functions import dates

    forms = ["11-09-2026", "11.09.26", "11/9/2026", "11.09.2026, 14:05", "11.09.2026T14:05", "14:05:00 11-09-2026", "14:05 11.09.26", "2026-09-11", "11.09.2026 14:05:09"]
    rows = spark.createDataFrame([(x,) for x in [*forms, "31.02.2026", "11.13.2026", "11.09.126", "1.1.1989"]], "t string")
    got = [(r["d"], r["bad"]) for r in rows.select(dates.date(rows.t).cast("string").alias("d"), dates.is_impossible(rows.t).alias("bad")).collect()]
    assert got == [("2026-09-11", False)] * len(forms) + [(None, True)] * 4
    clock = [str(r[0]) for r in spark.createDataFrame([(x,) for x in ("11.09.26, 14:05", "14:05:09 11-09-2026")], "t string").selectExpr("t").transform(lambda x: x.select(dates.datetime(x.t))).collect()]
    assert clock == ["2026-09-11 14:05:00", "2026-09-11 14:05:09"]


def test_parts_of_a_time_that_are_not_written_are_zero(spark):
    texts = ["", None, "11.09.26", "14:05 11/09/2026", "2026-09-11T14:05 and more", "11.09.2026, 24:00", "45000.5", "1.2.999"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", dates.datetime(F.col("t")).cast("string").alias("d")).orderBy("n").collect()
    assert [r.d for r in rows] == [None, None, "2026-09-11 00:00:00", "2026-09-11 14:05:00", "2026-09-11 14:05:00", None, "2023-03-15 12:00:00", None]


def test_years_and_digits_that_are_no_dates(spark):
    no = ("25000", "32873", "79000", "73416", "2024-1-5", "2024-01-5", "01.01.1989", "01.01.2101", "1989-12-31")
    assert [value(spark, dates.date, x) for x in no] == [None] * len(no)
    assert all(value(spark, dates.is_impossible, x) for x in no)
    yes = {"32874": (1990, 1, 1), "73415": (2100, 12, 31), "2024-01-05T9:30": (2024, 1, 5), "5.1.24": (2024, 1, 5)}
    assert {x: value(spark, dates.date, x) for x in yes} == {x: datetime.date(*d) for x, d in yes.items()}


def test_a_date_read_once(spark):
    rows = spark.createDataFrame([(x,) for x in ("11.09.2026 10:15", "31.02.2026", "", None, "25000", "46276")], "t string")
    got = rows.select(dates.read(F.col("t")).alias("r"), dates.datetime(F.col("t")).alias("at"), dates.is_impossible(F.col("t")).alias("bad")).collect()
    assert all((r["r"]["at"], r["r"]["impossible"]) == (r["at"], r["bad"]) for r in got)


def test_latin_of_texts_with_and_without_cyrillic(spark):
    assert [value(spark, text.latin, x) for x in ("Фермер ALFA", "ALFA Ҳўжалик", "ÉALFA x", "", None)] == ["fermer alfa", "alfa ho'jalik", "éalfa x", "", None]


def test_the_clock_of_a_zone(spark):
    now = spark.range(1).select(dates.business_now("Asia/Tashkent").alias("t")).first()["t"]
    utc = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    assert abs((now - datetime.timedelta(hours=5) - utc).total_seconds()) < 120
