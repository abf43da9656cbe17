"""Queries over the driver's tables, by name, with the SQL that must agree with each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import dates, geometry, names, zones
from quarryline.operators import audit, catalogue, choose, compare, groundtruth, measure
from quarryline.plans.adapters import read, shape, with_shapes
from quarryline.sources import binary, log_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# What a name tells, in DuckDB: no look-behind there, so neighbours are matched instead.
_Y = r"(19\d\d|20\d\d)"
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_PARTS = rf"""parts AS (SELECT *, lower(trim(album)) AS t FROM named),
found AS (SELECT *,
  TRY_CAST(regexp_extract(t, '\b{_Y}[-_./](\d{{1,2}})[-_./](\d{{1,2}})\b', 1) || '-' || lpad(regexp_extract(t, '\b{_Y}[-_./](\d{{1,2}})[-_./](\d{{1,2}})\b', 2), 2, '0') || '-' || lpad(regexp_extract(t, '\b{_Y}[-_./](\d{{1,2}})[-_./](\d{{1,2}})\b', 3), 2, '0') AS DATE) AS iso,
  TRY_CAST(regexp_extract(t, '(?:4th\s+of\s+july|july\s+4th?)\s+{_Y}', 1) AS INTEGER) AS july,
  TRY_CAST(regexp_extract(t, '\b(?:christmas|xmas)\s+{_Y}', 1) AS INTEGER) AS xmas,
  TRY_CAST(regexp_extract(t, '\beaster\s*{_Y}', 1) AS INTEGER) AS eas,
  TRY_CAST(regexp_extract(t, '\bhalloween\s+{_Y}', 1) AS INTEGER) AS hall,
  TRY_CAST(regexp_extract(t, '\b{_MONTH}\.?\s+{_Y}\b', 2) AS INTEGER) AS mon_y,
  CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(regexp_extract(t, '\b{_MONTH}\.?\s+{_Y}\b', 1), 1, 3)) AS INTEGER) AS mon,
  regexp_extract(t, '\b(winter|spring|summer|fall|autumn|harvest)\s+{_Y}\b', 1) AS sea,
  TRY_CAST(regexp_extract(t, '\b(winter|spring|summer|fall|autumn|harvest)\s+{_Y}\b', 2) AS INTEGER) AS sea_y,
  TRY_CAST(regexp_extract(t, '(?:^|[^0-9]){_Y}-(?:(\d{{2}})|{_Y})(?:[^0-9]|$)', 1) AS INTEGER) AS sp1,
  TRY_CAST(regexp_extract(t, '(?:^|[^0-9]){_Y}-(?:(\d{{2}})|{_Y})(?:[^0-9]|$)', 2) AS INTEGER) AS sp2,
  TRY_CAST(regexp_extract(t, '(?:^|[^0-9]){_Y}-(?:(\d{{2}})|{_Y})(?:[^0-9]|$)', 3) AS INTEGER) AS sp3,
  TRY_CAST(regexp_extract(t, '(?:^|[^0-9]){_Y}(?:[^0-9]|$)', 1) AS INTEGER) AS lone
  FROM parts),
span AS (SELECT *, CASE WHEN sp2 IS NOT NULL THEN CASE WHEN sp2 = (sp1 + 1) % 100 THEN sp1 + 1 END ELSE sp3 END AS sp_end FROM found),
eggs AS (SELECT *, eas % 19 AS g, eas // 100 AS c FROM span),
eggs2 AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM eggs),
eggs3 AS (SELECT *, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM eggs2),
eggs4 AS (SELECT *, i - (eas + eas // 4 + i + 2 - c + c // 4) % 7 AS l FROM eggs3),
egg AS (SELECT *, 3 + (l + 40) // 44 AS em, CASE WHEN eas IS NOT NULL THEN make_date(eas, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) END AS easter_day FROM eggs4),
dated AS (SELECT *,
  CASE WHEN iso IS NOT NULL OR july IS NOT NULL OR xmas IS NOT NULL OR eas IS NOT NULL OR hall IS NOT NULL THEN 'exact_day' WHEN mon_y IS NOT NULL THEN 'month' WHEN sea_y IS NOT NULL THEN 'season' WHEN sp_end IS NOT NULL THEN 'year_span' WHEN lone IS NOT NULL THEN 'year' ELSE 'none' END AS date_kind,
  CASE WHEN iso IS NOT NULL THEN iso WHEN july IS NOT NULL THEN make_date(july, 7, 4) WHEN xmas IS NOT NULL THEN make_date(xmas, 12, 25) WHEN eas IS NOT NULL THEN easter_day WHEN hall IS NOT NULL THEN make_date(hall, 10, 31)
    WHEN mon_y IS NOT NULL THEN make_date(mon_y, mon, 1) WHEN sea_y IS NOT NULL THEN make_date(sea_y, CASE sea WHEN 'winter' THEN 1 WHEN 'spring' THEN 3 WHEN 'summer' THEN 6 ELSE 9 END, 1)
    WHEN sp_end IS NOT NULL THEN make_date(sp1, 1, 1) WHEN lone IS NOT NULL THEN make_date(lone, 1, 1) END AS start_date
  FROM egg),
ended AS (SELECT *, CASE date_kind WHEN 'exact_day' THEN start_date WHEN 'month' THEN last_day(start_date) WHEN 'season' THEN last_day(make_date(sea_y, CASE sea WHEN 'winter' THEN 2 WHEN 'spring' THEN 5 WHEN 'summer' THEN 8 ELSE 11 END, 1))
  WHEN 'year_span' THEN make_date(sp_end, 12, 31) WHEN 'year' THEN make_date(lone, 12, 31) END AS end_date FROM dated)"""
_NAMED = with_shapes("album_orders") + ", named AS (SELECT DISTINCT album FROM album_orders), " + _PARTS


def _albums(spark, d):
    return shape(spark, d, "album_orders").select("album").distinct()


@query(_NAMED + "SELECT album, date_kind <> 'none' AS parsed, date_kind, CAST(year(start_date) AS INTEGER) AS year, CASE WHEN date_kind IN ('exact_day', 'month') THEN CAST(month(start_date) AS INTEGER) END AS month, CASE WHEN date_kind IN ('exact_day', 'month') THEN CAST(day(start_date) AS INTEGER) END AS day, start_date, end_date FROM ended")
def folder_date_parse(spark, d):
    return _albums(spark, d).select("album", dates.folder_date(F.col("album")).alias("x")).select("album", "x.*")


@query(_NAMED + "SELECT album, CASE WHEN demoted AND date_kind IN ('exact_day', 'month', 'season') THEN 'year' ELSE date_kind END AS date_kind, CASE WHEN demoted AND date_kind IN ('exact_day', 'month', 'season') THEN make_date(year(start_date), 1, 1) ELSE start_date END AS start_date, CASE WHEN demoted AND date_kind IN ('exact_day', 'month', 'season') THEN 'year' WHEN date_kind = 'exact_day' THEN 'day' WHEN date_kind = 'year_span' THEN 'span' WHEN date_kind = 'none' THEN 'none' ELSE date_kind END AS precision FROM (SELECT *, length(album) % 2 = 0 AS demoted FROM ended)")
def coarse_demotion(spark, d):
    x = _albums(spark, d).withColumn("x", dates.demote(dates.folder_date(F.col("album")), F.length("album") % 2 == 0))
    return x.select("album", F.col("x.date_kind").alias("date_kind"), F.col("x.start_date").alias("start_date"), dates.precision(F.col("x")).alias("precision"))


_EASTER = "WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) + k AS INTEGER) AS eas FROM orders, (SELECT unnest([0, 40, 100, 250]) AS k)), a AS (SELECT *, eas % 19 AS g, eas // 100 AS c FROM y), b AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM a), e AS (SELECT *, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM b), f AS (SELECT *, i - (eas + eas // 4 + i + 2 - c + c // 4) % 7 AS l FROM e) SELECT eas AS year, make_date(eas, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS easter FROM f"


@query(_EASTER)
def easter_by_year(spark, d):
    y = read(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().select("y", F.explode(F.array(*map(F.lit, (0, 40, 100, 250)))).alias("k")).select((F.col("y") + F.col("k")).alias("year")).distinct()
    return y.select("year", dates.easter(F.col("year")).alias("easter"))


_STAMPED = with_shapes("album_orders") + ", pairs AS (SELECT album, CAST(l_shipdate AS DATE) AS day FROM album_orders JOIN lineitem ON o_orderkey = l_orderkey WHERE trim(album) <> ''), a AS (SELECT album, count(*) AS file_count, count(DISTINCT day) AS distinct_days, min(day) AS min_day, max(day) AS max_day FROM pairs GROUP BY album), named AS (SELECT * FROM a), " + _PARTS
_VERDICT = _STAMPED + """, v AS (SELECT album, file_count, distinct_days, date_kind, start_date, end_date, min_day, max_day, CAST(min_day - start_date AS INTEGER) AS delta_min, CAST(max_day - start_date AS INTEGER) AS delta_max, year(end_date) AS ey FROM ended),
verdicts AS (SELECT album, file_count, distinct_days, date_kind, start_date, end_date, min_day, max_day, delta_min, delta_max, CASE
  WHEN date_kind = 'none' OR min_day IS NULL THEN 'UNDATED'
  WHEN date_kind IN ('exact_day', 'month', 'season') AND year(min_day) <> year(start_date) THEN 'FAIL'
  WHEN date_kind = 'exact_day' THEN CASE WHEN delta_min BETWEEN 0 AND 3 AND delta_max BETWEEN 0 AND 3 THEN 'PASS' WHEN delta_min BETWEEN 0 AND 14 AND delta_max <= 7 THEN 'NEAR' ELSE 'FAIL' END
  WHEN date_kind IN ('month', 'season') THEN CASE WHEN min_day BETWEEN start_date AND end_date THEN 'PASS' WHEN min_day - end_date BETWEEN 0 AND 30 THEN 'NEAR' ELSE 'FAIL' END
  WHEN min_day >= start_date AND max_day <= end_date THEN 'PASS' WHEN year(min_day) = year(start_date) OR year(max_day) = ey THEN 'NEAR' ELSE 'FAIL' END AS verdict FROM v) """


def _verdicts(spark, d):
    o = shape(spark, d, "album_orders").select(F.col("o_orderkey").alias("sha256"), F.array("album").alias("albums"))
    return groundtruth.verdicts(o, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha256"), F.col("l_shipdate").alias("import_ts")))


@query(_VERDICT + "SELECT * FROM verdicts")
def ground_truth_verdict(spark, d):
    return _verdicts(spark, d)


@query(_VERDICT + "SELECT count(*) AS albums, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'NEAR') AS near, count(*) FILTER (verdict = 'FAIL') AS failed, count(*) FILTER (verdict = 'UNDATED') AS undated, CAST(coalesce(sum(file_count), 0) AS BIGINT) AS files, count(*) FILTER (verdict = 'FAIL') = 0 AS ok FROM verdicts")
def ground_truth_rollup(spark, d):
    return groundtruth.roll_up(_verdicts(spark, d))


_ZONE_KEYS = ["america/new_york", "america/chicago", "america/denver", "america/phoenix", "america/los_angeles"]
_US = "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN '{z}'" for k, z in enumerate(_ZONE_KEYS)) + " END"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_days(CAST(o_orderkey % 5000 AS INTEGER)) AS local, {_US} AS zone FROM orders),
r AS (SELECT *, CASE WHEN year(local) < 2007 THEN make_date(year(local), 4, 1) + CAST((7 - dayofweek(make_date(year(local), 4, 1))) % 7 AS INTEGER) ELSE make_date(year(local), 3, 8) + CAST((7 - dayofweek(make_date(year(local), 3, 8))) % 7 AS INTEGER) END AS b,
 CASE WHEN year(local) < 2007 THEN make_date(year(local), 10, 25) + CAST((7 - dayofweek(make_date(year(local), 10, 25))) % 7 AS INTEGER) ELSE make_date(year(local), 11, 1) + CAST((7 - dayofweek(make_date(year(local), 11, 1))) % 7 AS INTEGER) END AS e FROM o)
SELECT o_orderkey, local, zone, CASE zone WHEN 'america/new_york' THEN -5 WHEN 'america/chicago' THEN -6 WHEN 'america/denver' THEN -7 WHEN 'america/phoenix' THEN -7 ELSE -8 END
 + CASE WHEN zone <> 'america/phoenix' AND local >= CAST(b AS TIMESTAMP) + to_hours(2) AND local < CAST(e AS TIMESTAMP) + to_hours(2) THEN 1 ELSE 0 END AS hours FROM r""")
def us_dst_offset(spark, d):
    local = F.timestamp_add("DAY", (F.col("o_orderkey") % 5000).cast("int"), F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate").cast("timestamp_ntz")))
    o = read(spark, d, "orders").select("o_orderkey", local.alias("local"), F.expr(_US).alias("zone"))
    return o.withColumn("hours", zones.us_offset_hours(F.col("local"), F.col("zone")))


_TZ = "CASE user_id % 5 WHEN 0 THEN 'America/Chicago' WHEN 1 THEN 'Europe/Paris' WHEN 2 THEN 'Asia/Kolkata' WHEN 3 THEN 'America/St_Johns' ELSE 'UTC' END"


@query(f"""WITH e AS (SELECT event_id, {_TZ} AS zone, date_trunc('day', CAST(ts AS TIMESTAMP)) + to_hours(CAST(9 + event_id % 12 AS INTEGER)) + to_days(CAST(event_id % 400 AS INTEGER)) AS local FROM events),
m AS (SELECT *, CAST(datediff('minute', (local AT TIME ZONE zone) AT TIME ZONE 'UTC', local) AS INTEGER) AS minutes FROM e)
SELECT event_id, zone, minutes, CASE WHEN minutes < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(minutes) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(minutes) % 60 AS VARCHAR), 2, '0') AS shown FROM m""")
def zone_offset(spark, d):
    # By day: in the hour that clocks repeat, DuckDB takes the later offset, Spark and Python the earlier one.
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    local = F.timestamp_add("DAY", (F.col("event_id") % 400).cast("int"), F.timestamp_add("HOUR", (9 + F.col("event_id") % 12).cast("int"), day))
    e = read(spark, d, "events").select("event_id", F.expr(_TZ).alias("zone"), local.alias("local"))
    e = e.withColumn("minutes", zones.offset_minutes(F.col("local"), F.col("zone")))
    return e.select("event_id", "zone", "minutes", zones.format_offset(F.col("minutes")).alias("shown"))


PATTERNS = [("house", "America/Chicago"), ("o", "America/Denver"), ("mach", "Europe/Paris")]


@query("SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'house') THEN 'America/Chicago' WHEN contains(lower(c_mktsegment), 'o') THEN 'America/Denver' WHEN contains(lower(c_mktsegment), 'mach') THEN 'Europe/Paris' ELSE 'UTC' END AS zone FROM customer")
def zone_override(spark, d):
    return compare.first_pattern(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment"), PATTERNS, "UTC").select("c_custkey", "zone")


_RESOLVED_IN = with_shapes("album_orders") + ", named AS (SELECT o_orderkey, album, CASE WHEN o_orderkey % 13 = 0 THEN o_day END AS owner, CASE WHEN o_orderkey % 7 = 0 THEN o_ts + to_hours(5) END AS embedded, CASE WHEN o_orderkey % 3 > 0 THEN o_ts + to_days(40) END AS imported FROM album_orders), " + _PARTS + """,
day AS (SELECT *, CASE WHEN date_kind = 'exact_day' THEN start_date END AS fday FROM ended),
resolved AS (SELECT *, CASE WHEN owner IS NOT NULL THEN 'owner-supplied' WHEN embedded IS NOT NULL THEN 'embedded-scan-date' WHEN fday IS NOT NULL THEN 'folder' WHEN imported IS NOT NULL THEN 'import-stamp' ELSE 'none' END AS date_source,
 CASE WHEN owner IS NOT NULL THEN 'day' WHEN embedded IS NOT NULL THEN 'second' WHEN fday IS NOT NULL THEN 'day' ELSE 'none' END AS precision,
 coalesce(CAST(owner AS TIMESTAMP), embedded, CAST(fday AS TIMESTAMP)) AS original FROM day),
keyed AS (SELECT *, coalesce(original, CAST(start_date AS TIMESTAMP), imported) AS sort_key FROM resolved) """


def _resolved(spark, d):
    o = shape(spark, d, "album_orders")
    k, ts = F.col("o_orderkey"), F.col("o_ts").cast("timestamp_ntz")
    o = o.select("o_orderkey", "album", F.when(k % 13 == 0, F.col("o_day")).alias("owner"), F.when(k % 7 == 0, F.timestamp_add("HOUR", F.lit(5), ts)).alias("embedded"), F.when(k % 3 > 0, F.timestamp_add("DAY", F.lit(40), ts)).alias("imported"))
    o = dates.with_folder_date(o)
    return o.withColumn("r", dates.resolve(F.col("owner"), F.col("embedded"), F.col("folder"), F.col("imported")))


@query(_RESOLVED_IN + "SELECT o_orderkey, date_source, precision, original, imported AS digitized, sort_key FROM keyed")
def timestamp_precedence(spark, d):
    return _resolved(spark, d).select("o_orderkey", "r.*")


@query(_RESOLVED_IN + """SELECT o_orderkey, CASE WHEN original IS NOT NULL THEN strftime(original, '%Y-%m-%d_%H%M%S') WHEN date_kind IN ('month', 'season') THEN strftime(start_date, '%Y-%m') || '-00_000000' WHEN date_kind = 'year' THEN strftime(start_date, '%Y') || '-00-00_000000' ELSE '0000-00-00_000000' END AS prefix, original IS NULL AS is_undated,
 strftime(original, '%Y:%m:%d %H:%M:%S') AS exif, CAST(epoch(coalesce(sort_key, original, imported)) AS BIGINT) AS mtime FROM keyed""")
def date_prefix(spark, d):
    r = _resolved(spark, d)
    o = F.col("r.original")
    return r.select("o_orderkey", dates.date_prefix(o, F.col("folder")).alias("p"), dates.exif(o).alias("exif"), dates.mtime_epoch(F.col("r.sort_key"), o, F.col("imported")).alias("mtime")).select("o_orderkey", "p.*", "exif", "mtime")


_DESCRIPTIVE = "(lower(trim(album)) NOT IN (" + ", ".join(f"'{a}'" for a in names.PLAIN_ALBUMS) + ") AND (NOT regexp_matches(lower(trim(album)), '^[0-9]+$') OR coalesce(TRY_CAST(lower(trim(album)) AS DECIMAL(30, 0)) BETWEEN 1900 AND 2100, false)))"
_FILED = _RESOLVED_IN + f""", filed AS (SELECT *, {_DESCRIPTIVE} AS descriptive, coalesce(sort_key, imported) AS stamp FROM keyed),
fy AS (SELECT *, CASE WHEN descriptive THEN year(start_date) END AS ay, CASE WHEN descriptive AND date_kind IN ('exact_day', 'month') THEN month(start_date) END AS am FROM filed),
files AS (SELECT *, CAST(coalesce(ay, year(stamp)) AS INTEGER) AS file_year, CAST(CASE WHEN ay IS NULL THEN month(stamp) ELSE coalesce(am, CASE WHEN year(stamp) = ay THEN month(stamp) END) END AS INTEGER) AS file_month FROM fy) """


def _filed(spark, d):
    r = _resolved(spark, d).withColumn("descriptive", names.is_descriptive(F.col("album")))
    return r.withColumn("f", dates.filing_month(F.col("folder"), F.col("descriptive"), F.col("r.sort_key"), F.col("imported")))


@query(_FILED + "SELECT o_orderkey, file_year, file_month FROM files")
def filing_year_month(spark, d):
    return _filed(spark, d).select("o_orderkey", "f.*")


_MONTHLY = "CASE WHEN file_year IS NULL THEN 'undated' WHEN file_month IS NULL THEN CAST(file_year AS VARCHAR) ELSE CAST(file_year AS VARCHAR) || '/' || CAST(file_year AS VARCHAR) || ' ' || monthname(make_date(2000, file_month, 1)) END"
_CLEAN = r"""regexp_replace(album, '[<>:"/\\|?*\x00-\x1f]', '-', 'g')"""


@query(_FILED + f"SELECT o_orderkey, '.' AS flat, coalesce(CAST(file_year AS VARCHAR), 'undated') AS by_year, {_MONTHLY} AS by_month, CASE WHEN descriptive AND date_kind <> 'none' AND file_year IS NOT NULL THEN CAST(file_year AS VARCHAR) || '/' || {_CLEAN} WHEN descriptive THEN {_CLEAN} ELSE {_MONTHLY} END AS by_album FROM files")
def output_folder(spark, d):
    f = _filed(spark, d)
    args = (F.col("album"), F.col("descriptive"), F.col("folder.parsed"), F.col("f.file_year"), F.col("f.file_month"))
    return f.select("o_orderkey", *[names.output_folder(s, *args).alias(n) for s, n in (("flat", "flat"), ("year", "by_year"), ("year-month", "by_month"), ("album", "by_album"))])


@query(_FILED + f"SELECT o_orderkey, CASE WHEN len(l) = 0 THEN 'undated' ELSE array_to_string(l, '/') END AS folder FROM (SELECT o_orderkey, list_filter([rtrim(trim(coalesce(CAST(file_year AS VARCHAR), ''))), rtrim(trim({_CLEAN})), '..'], lambda x: x NOT IN ('', '.', '..')) AS l FROM files)")
def custom_folder(spark, d):
    f = _filed(spark, d)
    return f.select("o_orderkey", names.render_folder("{year}/{album}/..", {"year": F.col("f.file_year").cast("string"), "album": F.col("album")}).alias("folder"))


_SOURCES = with_shapes("file_sources")
_PREFERRED = _SOURCES + r""", ranked AS (SELECT *, regexp_matches(regexp_replace(name, '(?i)\.fpx$', ''), '(?i)^(?:dcp|dc|p)[\s_-]?\d+$') AS camera, length(regexp_replace(name, '(?i)\.fpx$', '')) AS n FROM file_sources),
best AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY camera, n DESC, relpath) AS r FROM ranked) """
_MANIFEST = _PREFERRED + """, g AS (SELECT sha256, max(size) AS size, count(*) AS duplicate_count, array_to_string(list_sort(list(DISTINCT split_part(relpath, '/', 2))), '|') AS albums, array_to_string(list_sort(list(DISTINCT split_part(relpath, '/', 1))), '|') AS trees, array_to_string(list_sort(list(relpath)), '|') AS sources FROM file_sources GROUP BY sha256),
m AS (SELECT g.*, name AS preferred_name, b.relpath AS preferred_relpath, NOT camera AS is_human_named FROM g JOIN best b USING (sha256) WHERE r = 1) """


def _manifest(spark, d):
    return catalogue.manifest(shape(spark, d, "file_sources"))


@query(_MANIFEST + "SELECT * FROM m")
def dedup_manifest(spark, d):
    return _manifest(spark, d).withColumns({c: F.array_join(c, "|") for c in ("albums", "trees", "sources")})


@query(_MANIFEST + "SELECT CAST(sum(duplicate_count) AS BIGINT) AS files_seen, count(*) AS files_distinct, CAST(sum(duplicate_count * size) AS BIGINT) AS bytes_seen, CAST(sum(size) AS BIGINT) AS bytes_distinct, count(*) FILTER (is_human_named) AS human_named FROM m")
def manifest_counts(spark, d):
    return catalogue.manifest_counts(_manifest(spark, d))


@query(_PREFERRED + "SELECT sha256, relpath, name, size FROM best WHERE r = 1")
def preferred_record(spark, d):
    return catalogue.preferred(shape(spark, d, "file_sources"))


_GIVEN = """, f AS (SELECT *, row_number() OVER (PARTITION BY {scope} lower(p_name) ORDER BY sha256, p_name) = 1 AS bare FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY {scope} lower(p_name), bare, substr(sha256, 1, 8) ORDER BY sha256, p_name) AS k FROM f),
given AS (SELECT p_partkey, sha256, CASE WHEN bare THEN p_name ELSE p_name || '_' || substr(sha256, 1, 8) || CASE WHEN k > 1 THEN '-' || CAST(k AS VARCHAR) ELSE '' END END AS given FROM t) """
_PARTS_IN = "WITH n AS (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS sha256, p_name, p_brand FROM part)"


def _parts(spark, d):
    return read(spark, d, "part").select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("sha256"), "p_name", "p_brand")


@query(_PARTS_IN + _GIVEN.format(scope="") + "SELECT p_partkey, given FROM given")
def store_names(spark, d):
    return catalogue.assign_names(_parts(spark, d), "p_name").select("p_partkey", "given")


@query(_PARTS_IN + _GIVEN.format(scope="lower(p_brand),") + "SELECT p_partkey, given FROM given")
def output_stems(spark, d):
    return catalogue.assign_names(_parts(spark, d), "p_name", "p_brand").select("p_partkey", "given")


@query(_PARTS_IN + _GIVEN.format(scope="") + "SELECT p_partkey, given FROM given ORDER BY sha256 LIMIT 25")
def limit_after_naming(spark, d):
    return catalogue.first_entries(catalogue.assign_names(_parts(spark, d), "p_name"), 25).select("p_partkey", "given")


_CHOSEN = "WITH c AS (SELECT c_custkey, unnest(['stuff', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'Trip ' || CAST(1990 + c_custkey % 20 AS VARCHAR) ELSE '12' END]) AS album, unnest([1, 2, 3]) AS i FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT *, CASE WHEN " + _DESCRIPTIVE + r" THEN CASE WHEN regexp_matches(album, '(?:^|[^0-9])(19\d\d|20\d\d)(?:[^0-9]|$)') THEN 2 ELSE 1 END ELSE 0 END AS rank FROM c) SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Root' ELSE (SELECT album FROM r WHERE r.c_custkey = x.c_custkey ORDER BY rank DESC, i LIMIT 1) END AS album FROM customer x"


@query(_CHOSEN)
def choose_album(spark, d):
    k = F.col("c_custkey")
    third = F.when(k % 2 == 0, F.concat(F.lit("Trip "), (F.lit(1990) + k % 20).cast("string"))).otherwise("12")
    c = read(spark, d, "customer").select("c_custkey", F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("stuff"), "c_mktsegment", third)).alias("albums"))
    return catalogue.choose_album(c, lambda a: a.rlike(dates.LONE_YEAR)).select("c_custkey", "album")


_TREES = with_shapes("before_tree", "after_tree")


@query(_TREES + "SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'vanished' WHEN b.path IS NULL THEN 'added' ELSE 'modified' END AS kind FROM before_tree b FULL JOIN after_tree a ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.mtime_ns <> b.mtime_ns")
def snapshot_diff(spark, d):
    return compare.snapshot_diff(shape(spark, d, "before_tree"), shape(spark, d, "after_tree"))


@query(_TREES + "SELECT path FROM after_tree EXCEPT SELECT path FROM before_tree")
def added_paths(spark, d):
    return compare.added_paths(shape(spark, d, "before_tree"), shape(spark, d, "after_tree"))


@query("SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS different, CAST(50 AS BIGINT) AS known")
def exact_sample_size(spark, d):
    ids = read(spark, d, "documents").select("doc_id")
    drawn = compare.exact_sample(ids, 50, seed=7)
    there = drawn.join(ids.select(F.col("doc_id").alias("known")), F.col("doc_id") == F.col("known"), "left")
    return there.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("different"), F.count("known").alias("known"))


@query("WITH s AS (SELECT l_orderkey, min(l_linestatus) AS st FROM lineitem GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS store_name, CASE WHEN st IS NULL THEN 'missing' ELSE 'mismatch' END AS problem FROM orders LEFT JOIN s ON o_orderkey = l_orderkey WHERE st IS NULL OR st <> o_orderstatus")
def store_verify(spark, d):
    e = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("store_name"), F.col("o_orderstatus").alias("sha256"))
    s = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("store_name")).agg(F.min("l_linestatus").alias("sha256"))
    return compare.verify_store(e, s)


_DONE = "WITH rec AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), outs AS (SELECT l_orderkey AS k, l_orderkey * 10 + l_linenumber AS path, l_quantity FROM lineitem), have AS (SELECT path FROM outs WHERE l_quantity < 40), gone AS (SELECT DISTINCT k FROM outs WHERE path NOT IN (SELECT path FROM have)), done AS (SELECT k FROM rec WHERE k NOT IN (SELECT k FROM gone)) "


def _resume(spark, d):
    outs = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha256"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path"), "l_quantity")
    done = compare.done_entries(outs, outs, outs.where("l_quantity < 40").select("path").distinct())
    return compare.split_resume(read(spark, d, "orders").select(F.col("o_orderkey").alias("sha256"), "o_orderstatus"), done)


@query(_DONE + "SELECT o_orderkey AS sha256, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT k FROM done)")
def resume_todo(spark, d):
    return _resume(spark, d)[0]


@query(_DONE + "SELECT o_orderkey AS sha256, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT k FROM done)")
def resume_done(spark, d):
    return _resume(spark, d)[1]


@query("SELECT n_nationkey, n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 2 AND (n_nationkey % 4 = 0 OR n_nationkey % 4 = 1) AND n_nationkey % 7 <> 6 AS valid FROM nation")
def run_validity(spark, d):
    k = F.col("n_nationkey")
    n = read(spark, d, "nation")
    stored = F.struct(F.when(k % 5 == 0, 1).otherwise(2).alias("version"), F.when(k % 3 == 2, F.array(F.lit("tiff"))).otherwise(F.array(F.lit("tiff"), F.lit("jpeg"))).alias("specs"), F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "{date}_{name}").otherwise("{name}").alias("template"), F.lit(None).cast("string").alias("folder_key"), F.when(k % 7 == 6, F.array(F.lit("tiff"))).when(k % 7 == 5, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("jpeg"), F.lit("x"))).alias("extras"))
    wanted = F.struct(F.lit(2).alias("version"), F.array(F.lit("jpeg"), F.lit("tiff")).alias("specs"), F.lit("{date}_{name}").alias("template"), F.lit("album").alias("folder_key"), F.array(F.lit("jpeg")).alias("extras"))
    return n.select("n_nationkey", compare.run_is_valid(stored, wanted).alias("valid"))


_RECORDS = with_shapes("records")
_HERE = "status IN ('converted', 'resumed')"


@query(_RECORDS + f"SELECT count(*) AS attempted, count(*) FILTER (status = 'converted') AS converted, count(*) FILTER (status = 'resumed') AS resumed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (n_warnings > 0 AND {_HERE}) AS with_warnings, count(*) FILTER (is_undated AND {_HERE}) AS undated FROM records")
def audit_counts(spark, d):
    return audit.counts(shape(spark, d, "records"))


@query(_RECORDS + f"SELECT axis, value, count(*) AS n FROM (SELECT 'date_source' AS axis, date_source AS value FROM records WHERE {_HERE} UNION ALL SELECT 'transform_status', transform_status FROM records WHERE {_HERE} AND trim(transform_status) <> '' UNION ALL SELECT 'album', album FROM records WHERE {_HERE}) WHERE value IS NOT NULL GROUP BY axis, value")
def audit_frequencies(spark, d):
    return audit.frequencies(shape(spark, d, "records"))


@query(_RECORDS + f"SELECT pixel_sha256, count(*) AS n, min(store_name) AS first_name, max(store_name) AS last_name FROM records WHERE pixel_sha256 IS NOT NULL AND {_HERE} GROUP BY 1 HAVING count(*) > 1")
def identical_groups(spark, d):
    return audit.identical_groups(shape(spark, d, "records"))


@query("SELECT count(*) AS attempted, count(*) = (SELECT count(*) FROM part) AS complete, CAST(greatest(0, (SELECT count(*) FROM part) - count(*)) AS BIGINT) AS not_attempted FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def audit_complete(spark, d):
    handled = read(spark, d, "lineitem").select("l_partkey").distinct()
    return audit.completeness(handled, None, read(spark, d, "part").count(), False)


@query(_RECORDS + "SELECT album, count(*) AS files, count(*) FILTER (is_undated) AS undated_files FROM records GROUP BY 1 HAVING count(*) FILTER (is_undated) > 0")
def needs_date(spark, d):
    return audit.albums_needing_date(shape(spark, d, "records"))


@query(_RECORDS + "SELECT class, count(*) AS n FROM (SELECT CASE WHEN status = 'failed' THEN 'failed' WHEN n_warnings > 0 THEN 'warning' WHEN NOT is_undated THEN 'dated' ELSE 'undated' END AS class FROM records) GROUP BY 1")
def audit_class(spark, d):
    r = shape(spark, d, "records").select(geometry.audit_class(F.col("status") == "failed", F.col("n_warnings"), F.col("is_undated")).alias("class"))
    return r.groupBy("class").agg(F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT p_partkey, '2001-05_' || regexp_replace(p_name || '?', '[<>:"/\\|?*\x00-\x1f]', '-', 'g') || '#' || regexp_replace(p_brand, '[<>:"/\\|?*\x00-\x1f]', '-', 'g') AS rendered, CASE WHEN p_partkey % 3 = 0 THEN 'con' WHEN p_partkey % 3 = 1 THEN 'LPT1.x' ELSE p_name END AS n FROM part)
SELECT p_partkey, rendered, CASE WHEN lower(split_part(n, '.', 1)) IN ('con', 'lpt1') THEN n || '_' ELSE n END AS device FROM r""")
def render_name(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    device = F.when(k % 3 == 0, "con").when(k % 3 == 1, "LPT1.x").otherwise(F.col("p_name"))
    return p.select("p_partkey", names.render("2001-05_{name}#{brand}", {"name": F.concat("p_name", F.lit("?")), "brand": F.col("p_brand")}).alias("rendered"), names.render("{n}", {"n": device}).alias("device"))


@query(r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '-', 'g') AS safe, length(url) > 40 - 13 AS over FROM pages""")
def sanitise_and_budget(spark, d):
    return read(spark, d, "pages").select("page_id", names.sanitise(F.col("url")).alias("safe"), names.over_budget(F.col("url"), 40).alias("over"))


@query("WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || '/' || CAST(c_custkey // 3 AS VARCHAR) AS path FROM customer) SELECT c_custkey, path FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY c_custkey) AS n FROM p) WHERE n > 1")
def path_collision(spark, d):
    k = F.col("c_custkey")
    folder = F.when(k % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return compare.collisions(read(spark, d, "customer").select(k, F.concat(folder, F.lit("/"), F.floor(k / 3).cast("string")).alias("path")), ["c_custkey"])


@query(_SOURCES + r", n AS (SELECT relpath, name, split_part(relpath, '/', 1) AS tree, split_part(relpath, '/', 2) AS album FROM file_sources) SELECT relpath, tree, album, tree || '/' || album AS parent, regexp_replace(name, '(?i)\.fpx$', '') AS stem, regexp_matches(regexp_replace(name, '(?i)\.fpx$', ''), '(?i)^(?:dcp|dc|p)[\s_-]?\d+$') AS camera, " + _DESCRIPTIVE + " AS descriptive FROM n")
def name_classify(spark, d):
    p, n = F.col("relpath"), F.col("name")
    s = shape(spark, d, "file_sources")
    return s.select("relpath", names.tree(p).alias("tree"), names.album(p).alias("album"), names.parent(p).alias("parent"), names.stem(n).alias("stem"), names.is_camera_name(n).alias("camera"), names.is_descriptive(names.album(p)).alias("descriptive"))


_BOXES = with_shapes("frames") + """, c AS (SELECT *, least(m3, m0 * aspect + m3, m1 + m3, m0 * aspect + m1 + m3) AS x0, greatest(m3, m0 * aspect + m3, m1 + m3, m0 * aspect + m1 + m3) AS x1, least(m7, m4 * aspect + m7, m5 + m7, m4 * aspect + m5 + m7) AS y0, greatest(m7, m4 * aspect + m7, m5 + m7, m4 * aspect + m5 + m7) AS y1 FROM frames),
b AS (SELECT *, round_even(x0 * height, 0) AS l, round_even(y0 * height, 0) AS t, round_even((x1 - x0) * height, 0) AS w, round_even((y1 - y0) * height, 0) AS h FROM c),
r AS (SELECT *, CASE WHEN NOT has_matrix THEN 'no usable matrix' WHEN aspect IS NULL OR aspect <= 0 THEN 'no aspect' WHEN w < 1 OR h < 1 THEN 'box under a pixel' WHEN l < -1 OR t < -1 OR l + w > width + 1 OR t + h > height + 1 THEN 'box outside the frame' ELSE '' END AS reason,
 greatest(l, 0) AS bl, greatest(t, 0) AS bt, least(l + w, width) AS br, least(t + h, height) AS bb FROM b),
boxes AS (SELECT *, reason = '' AND NOT (bl <= 1 AND bt <= 1 AND w >= width - 1 AND h >= height - 1) AS boxed FROM r) """


def _frames(spark, d):
    f = shape(spark, d, "frames")
    zero, one = F.lit(0.0), F.lit(1.0)
    c = {n: F.col(n).cast("double") for n in ("m0", "m1", "m3", "m4", "m5", "m7")}
    m = F.array(c["m0"], c["m1"], zero, c["m3"], c["m4"], c["m5"], zero, c["m7"], zero, zero, one, zero, zero, zero, zero, one)
    return f.withColumn("aspect", F.col("aspect").cast("double")).withColumn("m", F.when(F.col("has_matrix"), m))


@query(_BOXES + "SELECT p_partkey, reason, CASE WHEN boxed THEN CAST(bl AS INTEGER) END AS \"left\", CASE WHEN boxed THEN CAST(bt AS INTEGER) END AS top, CASE WHEN boxed THEN CAST(br AS INTEGER) END AS \"right\", CASE WHEN boxed THEN CAST(bb AS INTEGER) END AS bottom FROM boxes")
def crop_box(spark, d):
    f = _frames(spark, d)
    return f.select("p_partkey", geometry.crop_box(F.col("m"), F.col("aspect"), F.col("width"), F.col("height")).alias("c")).select("p_partkey", "c.reason", "c.box.*")


@query(with_shapes("frames") + "SELECT p_partkey, CASE WHEN NOT has_matrix THEN 'unsupported' WHEN p_partkey % 7 IN (0, 6) THEN 'identity' WHEN p_partkey % 7 = 1 THEN 'rotate' WHEN p_partkey % 7 IN (2, 3, 5) THEN 'crop' ELSE 'unsupported' END AS kind FROM frames")
def orientation_class(spark, d):
    return _frames(spark, d).select("p_partkey", geometry.orientation(F.col("m")).alias("kind"))


@query("WITH t AS (SELECT p_partkey, 100 + p_size * 7 AS w, 80 + p_size * 5 AS h FROM part), n AS (SELECT *, CAST(ceil(w / 64.0) * ceil(h / 64.0) AS INTEGER) AS tiles, CAST(ceil(w / 64.0) AS INTEGER) AS across FROM t) SELECT p_partkey, tiles, CAST((tiles - 1) // across AS INTEGER) AS last_row, CAST((tiles - 1) % across AS INTEGER) AS last_col FROM n")
def tile_grid(spark, d):
    f = shape(spark, d, "frames").withColumn("tiles", geometry.tile_count(F.col("width"), F.col("height")))
    f = f.withColumn("p", geometry.tile_place(F.col("tiles") - 1, F.col("width")))
    return f.select("p_partkey", "tiles", F.col("p.tile_row").alias("last_row"), F.col("p.tile_col").alias("last_col"))


_YCC = "WITH y AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 5 AS DOUBLE) AS y, CAST(l_partkey % 256 AS DOUBLE) AS c1, CAST(l_suppkey * 2 % 256 AS DOUBLE) AS c2 FROM lineitem), s AS (SELECT *, y * 1.3584::DOUBLE AS luma, (c1 - 156) * 2.2179::DOUBLE AS b, (c2 - 137) * 1.8215::DOUBLE AS r FROM y)"


@query(_YCC + " SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(greatest(0.0, least(255.0, luma + r))) AS INTEGER) AS red, CAST(floor(greatest(0.0, least(255.0, luma - 0.194::DOUBLE * b - 0.509::DOUBLE * r))) AS INTEGER) AS green, CAST(floor(greatest(0.0, least(255.0, luma + b))) AS INTEGER) AS blue FROM s")
def ycc_to_rgb(spark, d):
    x = read(spark, d, "lineitem")
    y, c1, c2 = ((c).cast("double") for c in (F.col("l_quantity") * 5, F.col("l_partkey") % 256, F.col("l_suppkey") * 2 % 256))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", geometry.rgb(y, c1, c2).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.*")


_PIXELS = "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) * 100 AS x, CAST(avg(CAST(x AS DOUBLE)) OVER (PARTITION BY label, i) AS DOUBLE) * 100 AS y FROM e)"


def _pixels(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("x", F.col("v").cast("double"))
    return e.select("vec_id", "label", "i", (F.col("x") * 100).alias("x"), (F.avg("x").over(Window.partitionBy("label", "i")) * 100).alias("y"))


@query(_PIXELS + " SELECT vec_id, round(corr(x, y), 6) AS corr FROM p GROUP BY 1")
def pearson(spark, d):
    return _pixels(spark, d).groupBy("vec_id").agg(F.round(measure.pearson(F.col("x"), F.col("y")), 6).alias("corr"))


_CHROMA = _PIXELS + ", c AS (SELECT vec_id, corr(x, y) AS cr_corr, stddev_pop(x) / stddev_pop(y) AS cr_scale, avg(x) - avg(y) AS cr_offset FROM p GROUP BY 1)"


def _chroma(spark, d):
    return _pixels(spark, d).groupBy("vec_id").agg(*measure.chroma(F.col("x"), F.col("y"), "cr"))


@query(_CHROMA + " SELECT vec_id, round(cr_corr, 6) AS cr_corr, round(cr_scale, 6) AS cr_scale, round(cr_offset, 6) AS cr_offset FROM c")
def chroma_agreement(spark, d):
    return _chroma(spark, d).select("vec_id", *[F.round(c, 6).alias(c) for c in ("cr_corr", "cr_scale", "cr_offset")])


@query(_CHROMA + " SELECT vec_id, concat_ws(',', CASE WHEN cr_corr < 0.5 THEN 'cr_corr' END, CASE WHEN cr_scale NOT BETWEEN 0.65 AND 1.45 THEN 'cr_scale' END, CASE WHEN abs(cr_offset) > 30 THEN 'cr_offset' END) AS faults FROM c")
def chroma_gates(spark, d):
    return measure.chroma_faults(_chroma(spark, d), ("cr",)).select("vec_id", "faults")


@query(_PIXELS + ", s AS (SELECT vec_id, avg(x) AS mean, stddev_pop(x) AS stdev, corr(x, y) AS corr, avg(x) - avg(y) AS o FROM p GROUP BY 1) SELECT count(*) AS n, round(min(mean), 6) AS least_mean, round(max(mean), 6) AS most_mean, round(min(stdev), 6) AS least_stdev, round(max(stdev), 6) AS most_stdev, round(median(stdev), 6) AS median_stdev, round(min(corr), 6) AS worst_corr, round(max(abs(o)), 6) AS worst_offset FROM s")
def sample_statistics(spark, d):
    s = _pixels(spark, d).groupBy("vec_id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("stdev"), measure.pearson(F.col("x"), F.col("y")).alias("corr"), (F.avg("x") - F.avg("y")).alias("offset"))
    out = measure.sample_extremes(s)
    return out.select(*[c if c == "n" else F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT count(*) FILTER (b > a) AS better, round(avg(b - a), 6) AS mean_delta, round(min(b - a), 6) AS least_delta FROM (SELECT l_extendedprice AS a, l_extendedprice * (1 + l_tax - l_discount) AS b FROM lineitem)")
def improvement_deltas(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("before"), (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("after"))
    out = measure.improvements(p)
    return out.select("better", F.round("mean_delta", 6).alias("mean_delta"), F.round("least_delta", 6).alias("least_delta"))


@query("WITH x AS (SELECT doc_id, lang, source, CASE WHEN n_chars < 500 THEN 's' WHEN n_chars < 5000 THEN 'm' ELSE 'l' END AS band FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY band ORDER BY doc_id) AS c FROM x), i AS (SELECT *, CASE WHEN a <= 4 OR b <= 2 OR c <= 2 THEN 0 ELSE 1 END AS late FROM r), n AS (SELECT *, row_number() OVER (ORDER BY late, doc_id) AS k FROM i) SELECT doc_id, lang, source, band FROM n WHERE late = 0 OR k <= 60")
def stratified_cover(spark, d):
    x = read(spark, d, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") < 500, "s").when(F.col("n_chars") < 5000, "m").otherwise("l").alias("band"))
    return choose.stratified_cover(x, "doc_id", {"lang": 4, "source": 2, "band": 2}, 60)


_LINES = "SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN CAST(event_id % 97 AS INT) END AS done, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 31 AS INT) END AS total, event_type = 'error' AS failed, event_id % 501 = 500 AS interrupted FROM "


@query("WITH l AS (" + _LINES + "events) SELECT user_id, event_id, max(done) OVER w AS done, last_value(total IGNORE NULLS) OVER w AS total, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failed, bool_or(interrupted) OVER w AS interrupted FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_progress(spark, d):
    return choose.running_progress(spark.sql(_LINES + "{e}", e=read(spark, d, "events")), "user_id", ["event_id"])


@query("WITH a AS (SELECT s_suppkey AS path, s_nationkey AS v FROM supplier) SELECT c_custkey AS path, 'nation' AS tag, CASE WHEN c_custkey % 10 = 0 THEN 'forbidden' WHEN v IS NULL AND path IS NULL THEN 'missing' ELSE 'different' END AS problem FROM customer LEFT JOIN a AS b ON c_custkey = path WHERE CASE WHEN c_custkey % 10 = 0 THEN path IS NOT NULL ELSE path IS NULL OR v <> c_nationkey END")
def tag_validation(spark, d):
    e = read(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.lit("nation").alias("tag"), F.col("c_nationkey").alias("value"), (F.col("c_custkey") % 10 == 0).alias("forbidden"))
    a = read(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.lit("nation").alias("tag"), F.col("s_nationkey").alias("value"))
    return compare.check_tags(e, a)


@query("WITH e AS (SELECT l_orderkey AS sha256, l_orderkey * 10 + l_linenumber AS path, CAST(l_quantity AS INT) AS width, l_linenumber AS height FROM lineitem), h AS (SELECT DISTINCT o_orderkey * 10 + 1 + o_orderkey % 6 AS path, 20 AS w, CAST(1 + o_orderkey % 6 AS INTEGER) AS h FROM orders), p AS (SELECT e.sha256, e.path, CASE WHEN h.path IS NULL THEN 'missing' WHEN w <> width OR h.h <> height THEN 'size differs' END AS problem FROM e LEFT JOIN h ON e.path = h.path), g AS (SELECT *, max(CASE WHEN problem = 'missing' THEN 1 ELSE 0 END) OVER (PARTITION BY sha256) AS gone FROM p) SELECT sha256, path, problem FROM g WHERE problem IS NOT NULL AND (problem = 'missing' OR gone = 0)")
def output_set_check(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha256"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path"), F.col("l_quantity").cast("int").alias("width"), F.col("l_linenumber").alias("height"))
    k = F.col("o_orderkey")
    return compare.check_output_set(e, read(spark, d, "orders").select((k * 10 + 1 + k % 6).alias("path"), F.lit(20).alias("width"), (1 + k % 6).cast("int").alias("height")).distinct())


@query(_RECORDS + f", c AS (SELECT count(*) AS attempted, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (n_warnings > 0 AND {_HERE}) AS with_warnings FROM records) SELECT attempted, failed, with_warnings, CASE WHEN failed > 0 THEN 'failed' ELSE 'ok' END AS severity, CASE WHEN failed > 0 THEN CAST(failed AS VARCHAR) || ' of ' || CAST(attempted AS VARCHAR) || ' files failed.' ELSE 'All ' || CAST(attempted AS VARCHAR) || ' files are done, ' || CAST(with_warnings AS VARCHAR) || ' with warnings.' END AS sentence FROM c")
def run_summary(spark, d):
    c = audit.counts(shape(spark, d, "records")).withColumns({"interrupted": F.lit(False), "complete": F.lit(True)})
    return audit.summary(c).select("attempted", "failed", "with_warnings", "severity", "sentence")


@query("WITH e AS (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem) OR o_orderkey % 4 = 0 AS there FROM orders) SELECT count(*) AS entries, count(*) * 2 AS images, count(*) FILTER (NOT there) AS missing, CASE WHEN count(*) FILTER (NOT there) > 0 THEN 2 ELSE 0 END AS exit_code FROM e")
def dry_run_missing(spark, d):
    k = F.col("o_orderkey").cast("string")
    e = read(spark, d, "orders").select(k.alias("store_path"), F.concat(F.lit("s"), k).alias("source_path"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path")).distinct()
    sources = e.where(F.col("store_path").cast("long") % 4 == 0).select(F.col("source_path").alias("path"))
    return audit.dry_run(compare.source_fallback(e, lines.union(sources)), 2)


def _le(value, size: int = 4):
    """Hexadecimal digits of a whole number's bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)])


@query("SELECT c_custkey, CAST(p AS BIGINT) AS pid, CASE p WHEN 1 THEN 'I2' ELSE 'I4' END AS type_name, CASE p WHEN 1 THEN '1252' ELSE CAST(c_custkey AS VARCHAR) END AS value FROM customer, (SELECT unnest([1, 2]) AS p)")
def propset_parse(spark, d):
    head = "FEFF" + "0000" + "00000000" + "00" * 16 + "01000000" + "02" * 16 + "30000000" + "28000000" + "02000000" + "01000000" + "18000000" + "02000000" + "20000000" + "02000000" + "E4040000" + "03000000"
    c = read(spark, d, "customer").select("c_custkey", F.unhex(F.concat(F.lit(head), _le(F.col("c_custkey")))).alias("data"))
    return binary.parse_properties(c, ["c_custkey"], "data").select("c_custkey", "pid", "type_name", "value")


@query("SELECT c_custkey, 1 AS width, 1 AS height, printf('%02X02%02X', c_custkey % 256, c_nationkey) AS rgb FROM customer")
def dib_decode(spark, d):
    head = "FFFFFFFF" + "08000000" + "28000000" + "01000000" * 2 + "0100" + "1800" + "00" * 24
    c = read(spark, d, "customer").select("c_custkey", F.unhex(F.concat(F.lit(head), _le(F.col("c_nationkey"), 1), F.lit("02"), _le(F.col("c_custkey") % 256, 1), F.lit("00"))).alias("data"))
    return binary.parse_thumbnails(c, ["c_custkey"], "data").select("c_custkey", "width", "height", F.hex("rgb").alias("rgb"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(event_id % 97 AS INTEGER) END AS done, CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 31 AS INTEGER) END AS total, event_id % 4 = 1 AS failed, event_id % 4 = 3 AND event_id % 8 = 3 AS interrupted FROM events WHERE event_id % 8 <> 7")
def log_progress(spark, d):
    n, t, k = (F.col("event_id") % m for m in (97, 31, 4))
    line = F.when(k == 0, F.concat(F.lit("12:00 OK ["), n, F.lit("/"), t, F.lit("] a"))).when(k == 1, F.concat(F.lit("FAIL ["), n, F.lit(" / "), t, F.lit("]"))).when(k == 2, F.concat(F.lit("=== run start: "), t, F.lit(" entries"))).when(F.col("event_id") % 8 == 3, "run INTERRUPTED").otherwise("noise")
    return log_lines.progress_events(read(spark, d, "events").select("event_id", line.alias("value"))).drop("value")


@query(with_shapes("frames") + "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN height ELSE width END AS w, CASE WHEN p_partkey % 2 = 0 THEN 7 WHEN p_partkey % 3 = 0 THEN width ELSE height END AS h FROM (SELECT * FROM frames WHERE p_partkey % 2 > 0) UNION ALL SELECT p_partkey, 5, 7 FROM part WHERE p_partkey % 2 = 0")
def geometry_expectation(spark, d):
    f, k = shape(spark, d, "frames"), F.col("p_partkey")
    box = F.struct(F.lit(1).alias("left"), F.lit(2).alias("top"), F.lit(6).alias("right"), F.lit(9).alias("bottom"))
    x = compare.expected_geometry(F.when(k % 3 == 0, F.col("height")), F.when(k % 3 == 0, F.col("width")), F.col("width"), F.col("height"), box, k % 2 == 0)
    return f.select("p_partkey", x.alias("x")).select("p_partkey", F.col("x.width").alias("w"), F.col("x.height").alias("h"))
