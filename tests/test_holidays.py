"""Holidays by rule against days that are known, and reads in order."""

from datetime import date

from tidemark.operators import asof, holidays


def of(spark, currency, year, rules=holidays.RULES):
    return {(r.holiday_date, r.name) for r in holidays.holidays_by_rule(spark, year, year, rules).where(f"currency = '{currency}'").collect()}


def test_easter(spark):
    known = {1818: (3, 22), 1943: (4, 25), 1954: (4, 18), 1981: (4, 19), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2019: (4, 21), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25), 2049: (4, 18), 2076: (4, 19), 2285: (3, 22)}
    found = {r.year: r.easter for r in holidays.years_with_easter(spark, 1818, 2285).collect()}
    assert {y: (found[y].month, found[y].day) for y in known} == known
    assert all(x.weekday() == 6 and date(y, 3, 22) <= x <= date(y, 4, 25) for y, x in found.items())


def test_days_observed_in_place_of_weekends(spark):
    usd = of(spark, "USD", 2021)
    assert (date(2021, 7, 4), "Independence Day") in usd and (date(2021, 7, 5), "Independence Day (observed)") in usd
    assert (date(2021, 12, 24), "Christmas Day (observed)") in usd
    # the next year's first day is a Saturday
    assert (date(2021, 12, 31), "New Year's Day (observed)") in usd and (date(2021, 11, 25), "Thanksgiving Day") in usd and (date(2021, 5, 31), "Memorial Day") in usd
    gbp = of(spark, "GBP", 2021) | of(spark, "GBP", 2022)
    assert {(date(2021, 12, 27), "Christmas Day (observed)"), (date(2021, 12, 28), "Boxing Day (observed)"), (date(2022, 1, 3), "New Year's Day (observed)"), (date(2022, 12, 27), "Christmas Day (observed)")} <= gbp
    assert (date(2022, 12, 28), "Boxing Day (observed)") not in gbp and (date(2022, 8, 29), "Summer bank holiday") in gbp


def test_rules_begin_and_days_can_lack(spark):
    assert not any("Juneteenth" in n for _, n in of(spark, "USD", 2020)) and any(n == "Juneteenth" for _, n in of(spark, "USD", 2021))
    leap = [("XXX", "Leap day", 2, 29, None, None, None, None, None)]
    assert of(spark, "XXX", 2023, leap) == set() and of(spark, "XXX", 2024, leap) == {(date(2024, 2, 29), "Leap day")}
    assert of(spark, "JPY", 2024) == set()


def test_reads_in_order(spark):
    ticks = spark.createDataFrame([("E", t, 1.0, 1.5, s, t) for t in (5, 3, 9, 1) for s in ("b", "a")], "instrument string, ts long, bid double, ask double, source string, seq long")
    assert [(r.ts, r.source) for r in asof.ticks_as_of(ticks, 8, "E", in_order=True).collect()] == [(t, s) for t in (1, 3, 5) for s in ("a", "b")]
    held = spark.createDataFrame([("S", date(2024, m, 1), 10 * m, 1.0, m) for m in (3, 1, 2)], "series_id string, ref_period date, known_at long, value double, vintage_seq long")
    assert [r.ref_period.month for r in asof.macro_as_of(held, 100, in_order=True).collect()] == [1, 2, 3]
    bars = spark.createDataFrame([("E", "a", 60 * m) for m in (2, 0, 1)], "instrument string, source string, minute long")
    assert [r.minute for r in asof.bars_as_of(bars, 1000, "E", "a", in_order=True).collect()] == [0, 60, 120]
