"""Dates read from names, and dates made from stamps (DAT-01..05, DAT-12..16): column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names may say.
YEAR = r"(19\d\d|20\d\d)"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
SEASONS = {"winter": (1, 2), "spring": (3, 5), "summer": (6, 8), "fall": (9, 11), "autumn": (9, 11), "harvest": (9, 11)}
ISO = r"\b" + YEAR + r"[-_./](\d{1,2})[-_./](\d{1,2})\b"
MONTH_YEAR = r"\b" + MONTH + r"\.?\s+" + YEAR + r"\b"
SEASON_YEAR = r"\b(" + "|".join(SEASONS) + r")\s+" + YEAR + r"\b"
SPAN = r"(?<!\d)" + YEAR + r"-(?:(\d{2})|" + YEAR + r")(?!\d)"
LONE_YEAR = r"(?<!\d)" + YEAR + r"(?!\d)"
#: Holidays with a fixed day.
HOLIDAYS = {r"(?:4th\s+of\s+july|july\s+4th?)\s+" + YEAR: (7, 4), r"\b(?:christmas|xmas)\s+" + YEAR: (12, 25), r"\bhalloween\s+" + YEAR: (10, 31)}
EASTER = r"\beaster\s*" + YEAR
KIND = "struct<parsed:boolean,date_kind:string,year:int,month:int,day:int,start_date:date,end_date:date>"


def found_int(text: Column, pattern: str, group: int) -> Column:
    """The number a group of the pattern matched, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("9999")).cast("int")


def make_date(y: Column, m: Column | int, d: Column | int) -> Column:
    """The date, or null if there is no such day."""
    parts = [F.lpad(x.cast("string"), n, "0") for x, n in ((y, 4), (F.lit(m) if isinstance(m, int) else m, 2), (F.lit(d) if isinstance(d, int) else d, 2))]
    return F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")


def let(value: Column, use) -> Column:
    """use(value), with value worked out once: it is bound as the element of a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by whole numbers that are never negative."""

    def div(a: Column, n) -> Column:
        return F.floor(a / n).cast("int")

    def epact(y: Column) -> Column:
        century = div(y, 100)
        return (century - div(century, 4) - div(century * 8 + 13, 25) + y % 19 * 19 + 15) % 30

    def moon(e: Column, y: Column) -> Column:
        return e - div(e, 28) * (1 - div(F.lit(29), e + 1) * div(21 - y % 19, 11))

    def offset(m: Column, y: Column) -> Column:
        return m - (y + div(y, 4) + m + 2 - div(y, 100) + div(y, 400)) % 7

    def day(o: Column, y: Column) -> Column:
        return let(3 + div(o + 40, 44), lambda month: F.make_date(y, month, o + 28 - 31 * div(month, 4)))

    return let(year.cast("int"), lambda y: let(epact(y), lambda e: let(moon(e, y), lambda m: let(offset(m, y), lambda o: day(o, y)))))


def thanksgiving(year: Column) -> Column:
    """The fourth Thursday of November."""
    return F.date_add(F.next_day(F.make_date(year.cast("int"), F.lit(10), F.lit(31)), "THU"), 21)


def _dated(kind: str, year: Column, month: Column | None, day: Column | None, start: Column, end: Column) -> Column:
    null = F.lit(None).cast("int")
    return F.struct(F.lit(True).alias("parsed"), F.lit(kind).alias("date_kind"), year.alias("year"), (null if month is None else month).cast("int").alias("month"), (null if day is None else day).cast("int").alias("day"), start.alias("start_date"), end.alias("end_date"))


def folder_date(name: Column) -> Column:
    """What date a folder's name tells (struct of KIND); the first rule that applies decides.

    Each pattern is looked up once; the rules then read the bound findings.
    """
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    looked = {f"iso{k}": found_int(text, ISO, k) for k in (1, 2, 3)} | {f"fixed{k}": found_int(text, p, 1) for k, p in enumerate(HOLIDAYS)}
    looked |= {"easter": found_int(text, EASTER, 1), "month_year": found_int(text, MONTH_YEAR, 2), "month": F.regexp_extract(text, MONTH_YEAR, 1)}
    looked |= {"season_year": found_int(text, SEASON_YEAR, 2), "season": F.regexp_extract(text, SEASON_YEAR, 1), "lone": found_int(text, LONE_YEAR, 1)}
    looked |= {f"span{k}": found_int(text, SPAN, k) for k in (1, 2, 3)}
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in looked.items()])), _decide), F.lit(0))


def _decide(x: Column) -> Column:
    iso = make_date(x["iso1"], x["iso2"], x["iso3"])
    fixed = [make_date(x[f"fixed{k}"], m, d) for k, (m, d) in enumerate(HOLIDAYS.values())]
    exact = F.coalesce(iso, *fixed[:2], F.when(x["easter"].isNotNull(), easter(x["easter"])), fixed[2])
    return let(exact, lambda day: F.when(day.isNotNull(), _dated("exact_day", F.year(day), F.month(day), F.day(day), day, day)).otherwise(_decide_span(x)).cast(KIND))


def _decide_span(x: Column) -> Column:
    """Rules that give more than a day."""
    rules = []
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(x["month"], 1, 3)).cast("int")
    first = make_date(x["month_year"], month, 1)
    rules.append((x["month_year"].isNotNull(), _dated("month", x["month_year"], month, F.lit(1), first, F.last_day(first))))
    y, begin, end = x["season_year"], F.lit(None).cast("int"), F.lit(None).cast("int")
    for word, (a, b) in SEASONS.items():
        begin, end = F.when(x["season"] == word, a).otherwise(begin), F.when(x["season"] == word, b).otherwise(end)
    rules.append((y.isNotNull(), _dated("season", y, None, None, make_date(y, begin, 1), F.last_day(make_date(y, end, 1)))))
    y, tail = x["span1"], x["span2"]
    last = F.when(tail.isNotNull(), F.when(tail == (y + 1) % 100, y + 1)).otherwise(x["span3"])
    rules.append((last.isNotNull(), _dated("year_span", y, None, None, make_date(y, 1, 1), make_date(last, 12, 31))))
    rules.append((x["lone"].isNotNull(), _dated("year", x["lone"], None, None, make_date(x["lone"], 1, 1), make_date(x["lone"], 12, 31))))
    out = F.lit(None)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    nothing = F.struct(F.lit(False).alias("parsed"), F.lit("none").alias("date_kind"), *[F.lit(None).cast(t).alias(n) for n, t in (("year", "int"), ("month", "int"), ("day", "int"), ("start_date", "date"), ("end_date", "date"))])
    return F.coalesce(out, nothing)


def demote(date: Column, coarse: Column) -> Column:
    """A day, month or season is only a year where the name is declared coarse; spans and years stay."""
    year = _dated("year", date["year"], None, None, make_date(date["year"], 1, 1), make_date(date["year"], 12, 31)).cast(KIND)
    return F.when(coarse & date["parsed"] & date["date_kind"].isin("exact_day", "month", "season"), year).otherwise(date)


def with_folder_date(df: DataFrame, album: str = "album", out: str = "folder") -> DataFrame:
    """Adds what albums' names tell; each different name is parsed once, and the few names join back."""
    parsed = df.select(F.col(album).alias("_album")).distinct().withColumn(out, folder_date(F.col("_album")))
    return df.join(parsed, F.col(album).eqNullSafe(F.col("_album")), "left").drop("_album")


def precision(date: Column) -> Column:
    kind = date["date_kind"]
    return F.when(kind == "exact_day", "day").when(kind.isin("month", "season", "year"), kind).when(kind == "year_span", "span").otherwise("none")


def filetime(ticks: Column) -> Column:
    """A count of 100 ns since 1601 as a zone-free timestamp; null if not positive or past the year 9999."""
    good = (ticks > 0) & (ticks < F.lit(2650467744000000000))
    micros = F.when(good, F.call_function("div", ticks, F.lit(10)))
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ '1601-01-01 00:00:00'"))


def resolve(owner: Column, embedded: Column, folder: Column, imported: Column) -> Column:
    """Which date a file gets: the owner's, the embedded scan date, a day in the folder's name; an import stamp gives none."""
    day = F.when(folder["date_kind"] == "exact_day", folder["start_date"])
    ntz = lambda c: c.cast("timestamp_ntz")
    source = F.when(owner.isNotNull(), "owner-supplied").when(embedded.isNotNull(), "embedded-scan-date").when(day.isNotNull(), "folder").when(imported.isNotNull(), "import-stamp").otherwise("none")
    grain = F.when(owner.isNotNull(), "day").when(embedded.isNotNull(), "second").when(day.isNotNull(), "day").otherwise("none")
    original = F.coalesce(ntz(owner), ntz(embedded), ntz(day))
    return F.struct(source.alias("date_source"), grain.alias("precision"), original.alias("original"), ntz(imported).alias("digitized"), F.coalesce(original, ntz(folder["start_date"]), ntz(imported)).alias("sort_key"))


def date_prefix(original: Column, folder: Column) -> Column:
    """The date that a file name begins with; what is unknown is zero."""
    y, m = F.lpad(folder["year"].cast("string"), 4, "0"), F.lpad(F.month(folder["start_date"]).cast("string"), 2, "0")
    rough = F.when(folder["date_kind"].isin("month", "season"), F.concat(y, F.lit("-"), m, F.lit("-00_000000"))).when(folder["date_kind"] == "year", F.concat(y, F.lit("-00-00_000000"))).otherwise("0000-00-00_000000")
    return F.struct(F.when(original.isNotNull(), F.date_format(original, "yyyy-MM-dd_HHmmss")).otherwise(rough).alias("prefix"), original.isNull().alias("is_undated"))


def filing_month(folder: Column, descriptive: Column, sort_key: Column, imported: Column) -> Column:
    """(year, month) to file under: the descriptive album's; a stamp lends its month only if the years agree."""
    stamp = F.coalesce(sort_key, imported)
    year = F.when(descriptive, folder["year"])
    month = F.when(descriptive, folder["month"])
    lent = F.when(F.year(stamp) == year, F.month(stamp))
    return F.struct(F.coalesce(year, F.year(stamp)).alias("file_year"), F.when(year.isNull(), F.month(stamp)).otherwise(F.coalesce(month, lent)).alias("file_month"))


def exif(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy:MM:dd HH:mm:ss")


def mtime_epoch(sort_key: Column, original: Column, imported: Column) -> Column:
    """Seconds since 1970 in the session zone of the first of the stamps; null if there is none."""
    return F.unix_timestamp(F.coalesce(sort_key, original, imported).cast("timestamp"))
