import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryline.functions import dates, zones

D = dt.date
CASES = [
    ("Trip 2001-03-09 x", "exact_day", D(2001, 3, 9), D(2001, 3, 9)), ("a 1999/1/5", "exact_day", D(1999, 1, 5), D(1999, 1, 5)), ("2001-13-45", "year", D(2001, 1, 1), D(2001, 12, 31)),
    ("4th of July 1998", "exact_day", D(1998, 7, 4), D(1998, 7, 4)), ("july 4t 1998", "exact_day", D(1998, 7, 4), D(1998, 7, 4)), ("july 4 2001", "year", D(2001, 1, 1), D(2001, 12, 31)),
    ("xmas 1995", "exact_day", D(1995, 12, 25), D(1995, 12, 25)), ("Easter1999", "exact_day", D(1999, 4, 4), D(1999, 4, 4)), ("easter 19991", "exact_day", D(1999, 4, 4), D(1999, 4, 4)),
    ("Halloween 2000", "exact_day", D(2000, 10, 31), D(2000, 10, 31)), ("Feb. 2000", "month", D(2000, 2, 1), D(2000, 2, 29)), ("september 1997", "month", D(1997, 9, 1), D(1997, 9, 30)),
    ("Winter 1995", "season", D(1995, 1, 1), D(1995, 2, 28)), ("HARVEST 1994", "season", D(1994, 9, 1), D(1994, 11, 30)), ("2001-02", "year_span", D(2001, 1, 1), D(2002, 12, 31)),
    ("1999-00", "year_span", D(1999, 1, 1), D(2000, 12, 31)), ("2002-2001", "year_span", D(2002, 1, 1), D(2001, 12, 31)), ("2001-07", "year", D(2001, 1, 1), D(2001, 12, 31)),
    ("Family 1996", "year", D(1996, 1, 1), D(1996, 12, 31)), ("x19961", "none", None, None), ("", "none", None, None), (None, "none", None, None),
]


def test_folder_dates(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, name string").withColumn("x", dates.folder_date(F.col("name")))
    got = {r["i"]: r["x"] for r in df.collect()}
    for i, (name, kind, start, end) in enumerate(CASES):
        assert (got[i]["date_kind"], got[i]["start_date"], got[i]["end_date"]) == (kind, start, end), name
        assert got[i]["parsed"] == (kind != "none")


def test_easter_by_the_calendar(spark):
    def brute(y):
        a, b, c = y % 19, y // 100, y % 100
        h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        m = (a + 11 * h + 22 * k) // 451
        n = h + k - 7 * m + 114
        return D(y, n // 31, n % 31 + 1)

    got = spark.range(1826, 2400).select("id", dates.easter(F.col("id")).alias("d")).collect()
    assert all(r["d"] == brute(r["id"]) for r in got)
    assert spark.range(1).select(dates.thanksgiving(F.lit(1998))).first()[0] == D(1998, 11, 26)


def test_filetime(spark):
    rows = [(0,), (-5,), (126227808000000000,), (126227808000000015,), (9_000_000_000_000_000_000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t long").select(dates.filetime(F.col("t"))).collect()]
    assert got == [None, None, dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 1, 0, 0, 0, 1), None]


def test_prefixes_are_zero_where_unknown(spark):
    df = spark.createDataFrame([("Winter 1995",), ("Feb 2000",), ("1996",), ("2001-02",), ("x",)], "a string")
    p = df.select(dates.date_prefix(F.lit(None).cast("timestamp_ntz"), dates.folder_date(F.col("a"))).alias("p")).select("p.*").collect()
    assert [r["prefix"] for r in p] == ["1995-01-00_000000", "2000-02-00_000000", "1996-00-00_000000", "0000-00-00_000000", "0000-00-00_000000"] and all(r["is_undated"] for r in p)


def test_zones(spark):
    from zoneinfo import ZoneInfo

    stamps = [dt.datetime(2001, 4, 1, 2, 30), dt.datetime(2001, 10, 28, 1, 30), dt.datetime(2001, 1, 5, 12), dt.datetime(2008, 3, 9, 3), dt.datetime(2008, 11, 2, 1, 59), dt.datetime(1999, 7, 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "i int, t timestamp_ntz")
    got = {r["i"]: r for r in df.select("i", zones.offset_minutes(F.col("t"), F.lit("America/Chicago")).alias("m"), zones.us_offset_hours(F.col("t"), F.lit("america/chicago")).alias("h")).collect()}
    for i, t in enumerate(stamps):
        assert got[i]["m"] == t.replace(tzinfo=ZoneInfo("America/Chicago")).utcoffset().total_seconds() / 60
    assert [got[i]["h"] for i in range(6)] == [-5, -5, -6, -5, -5, -5]
    assert zones.resolve_zone("central") == zones.resolve_zone("AMERICA/chicago") == "America/Chicago" and zones.resolve_zone(" us/central ") == "US/Central"
    with pytest.raises(zones.ZoneError):
        zones.resolve_zone("Mars/Olympus")
    assert [r[0] for r in spark.createDataFrame([(-210,), (330,), (0,)], "m int").select(zones.format_offset(F.col("m"))).collect()] == ["-03:30", "+05:30", "+00:00"]
