"""More queries over the driver's tables: outputs, records, properties, geometry and small functions. Importing registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import dates, geometry, names, properties, zones
from quarryline.operators import audit, images, measure, outputs
from quarryline.plans.adapters import read, shape, with_shapes
from quarryline.plans.bindings import _HERE, _RECORDS, _le, query
from quarryline.sinks import catalogue as sink
from quarryline.sinks import records as record_sink
from quarryline.sources import binary, config
from quarryline.streaming.resume import todo


@query("SELECT p_partkey, s.label, s.tree || '/' || CASE WHEN p_size % 4 = 0 THEN '' ELSE 'size ' || CAST(p_size AS VARCHAR) || '/' END || CAST(p_partkey AS VARCHAR) || '.' || s.suffix AS path FROM part, (SELECT unnest([{'tree': 'archive', 'label': 'archive/tiff/full', 'suffix': 'tif'}, {'tree': 'sharing', 'label': 'sharing/jpeg/cropped', 'suffix': 'jpg'}]) AS s)")
def output_paths(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, ".").otherwise(F.concat(F.lit("size "), "p_size")).alias("folder"), F.col("p_partkey").cast("string").alias("filename"))
    return outputs.expand(p, outputs.outputs()).select("p_partkey", "spec.label", "path")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'sharing' WHEN 1 THEN 'archive' ELSE CASE WHEN p_size % 2 = 0 THEN 'sharing' ELSE 'archive' END END AS tree, CASE p_partkey % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'tiff' ELSE CASE WHEN p_size < 25 THEN 'tiff' ELSE 'jpeg' END END AS fmt, CASE p_partkey % 3 WHEN 0 THEN 'cropped' WHEN 1 THEN 'full' ELSE CASE WHEN p_size % 2 = 0 THEN 'cropped' ELSE 'full' END END AS framing FROM part")
def single_output_mode(spark, d):
    k = F.col("p_partkey") % 3
    mode = F.when(k == 0, "sharing").when(k == 1, "archive").otherwise("custom")
    x = outputs.single_output(mode, F.when(F.col("p_size") < 25, "tiff").otherwise("jpeg"), F.when(F.col("p_size") % 2 == 0, "cropped").otherwise("full"))
    return read(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.*")


@query("""WITH f AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 2 = 0 THEN 'tiff' ELSE 'jpeg' END AS fmt, p_partkey % 3 = 0 AS cropped, p_partkey % 5 AS c, p_partkey % 7 AS j, p_partkey % 11 AS z FROM part),
 w AS (SELECT *, CASE WHEN cropped AND z > 2 THEN 50 WHEN z <> 1 THEN 100 END AS want, CASE z WHEN 4 THEN 100 WHEN 5 THEN 77 ELSE CASE WHEN cropped AND z > 2 THEN 50 ELSE 100 END END AS width FROM f)
 SELECT k AS p_partkey, array_to_string(list_filter([CASE WHEN fmt = 'tiff' AND c NOT IN (0, 1) THEN 'compression is not Deflate' END, CASE WHEN fmt = 'jpeg' AND j = 0 THEN 'chroma sampling could not be verified' END, CASE WHEN fmt = 'jpeg' AND j = 1 THEN 'chroma sampling is not 4:4:4' END,
 CASE WHEN want IS NULL THEN 'no declared size to verify against' END, CASE WHEN want <> width THEN 'size differs from what is declared' END, CASE WHEN cropped AND z > 2 AND width = 100 THEN 'a crop is declared but the frame is still full' END], lambda x: x IS NOT NULL), '; ') AS problems FROM w""")
def image_checks(spark, d):
    k = F.col("p_partkey")
    cropped, z = k % 3 == 0, k % 11
    box = lambda n: F.struct(F.lit(n).alias("width"), F.lit(n).alias("height"))
    pair = lambda h, v: F.struct(F.lit(h).alias("h"), F.lit(v).alias("v"))
    sampling = F.when(k % 7 == 1, F.array(pair(2, 2), pair(1, 1))).when(k % 7 > 1, F.array(pair(1, 1), pair(1, 1)))
    width = F.when(z == 4, 100).when(z == 5, 77).when(cropped & (z > 2), 50).otherwise(100)
    f = read(spark, d, "part").select(
        k, F.when(k % 2 == 0, "tiff").otherwise("jpeg").alias("fmt"), F.when(cropped, "cropped").otherwise("full").alias("framing"), F.when(k % 5 == 0, 8).when(k % 5 == 1, 32946).when(k % 5 == 2, 1).alias("compression"),
        sampling.alias("sampling"), width.alias("width"), width.alias("height"), F.when(z != 1, box(100)).alias("declared"), F.when(z > 2, box(50)).alias("crop"),
    )
    return outputs.image_problems(f).select("p_partkey", F.array_join("problems", "; ").alias("problems"))


@query(_RECORDS + "SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS sha256, store_name, album, 'resumed' AS status, coalesce(date_source, 'none') AS date_source, is_undated, pixel_sha256, CASE WHEN l_linenumber = 2 THEN '1,2,3,4' END AS crop, CAST(l_linenumber % 3 AS INTEGER) AS n_outputs, CASE WHEN l_linenumber % 3 > 0 THEN 'archive/' || store_name END AS first_output, 0 AS n_errors, round(l_linenumber / 8.0, 3) AS seconds FROM records")
def record_round_trip(spark, d):
    n = F.col("l_linenumber")
    r = shape(spark, d, "records").select(
        F.concat_ws("-", "l_orderkey", n).alias("sha256"), "store_name", "album", "status", "date_source", "is_undated", F.lit(None).cast("string").alias("date_original"), "transform_status", F.when(n == 2, F.array(*map(F.lit, (1, 2, 3, 4)))).when(n == 3, F.array().cast("array<int>")).alias("crop_applied"),
        F.when(n % 3 > 0, F.array_repeat(F.concat(F.lit("archive/"), "store_name"), n % 3)).alias("outputs"), "pixel_sha256", F.lit(None).cast("array<string>").alias("errors"), F.array(F.lit("w")).alias("warnings"), (n / 8.0 + 0.00001).alias("seconds"),
    )
    back = record_sink.from_json(record_sink.to_json(r))
    return back.select("sha256", "store_name", "album", "status", "date_source", "is_undated", "pixel_sha256", F.array_join("crop_applied", ",").alias("crop"), F.size("outputs").alias("n_outputs"), F.get("outputs", F.lit(0)).alias("first_output"), F.size("errors").alias("n_errors"), "seconds")


@query(_RECORDS + f"SELECT pixel_sha256, store_name FROM (SELECT *, count(*) OVER (PARTITION BY pixel_sha256) AS n FROM records WHERE pixel_sha256 IS NOT NULL AND {_HERE}) WHERE n > 1")
def identical_members(spark, d):
    return audit.identical_members(shape(spark, d, "records"))


@query(_RECORDS + "SELECT album, store_name, l_orderkey, l_linenumber FROM records")
def album_listing(spark, d):
    return audit.by_album(shape(spark, d, "records")).select("album", "store_name", "l_orderkey", "l_linenumber")


@query(_RECORDS + "SELECT store_name, 'a; ' || album AS errors FROM (SELECT *, row_number() OVER (ORDER BY store_name, album) AS n FROM (SELECT DISTINCT store_name, min(album) OVER (PARTITION BY store_name) AS album FROM records WHERE status = 'failed')) WHERE n <= 20")
def failure_preview(spark, d):
    r = shape(spark, d, "records").where("status = 'failed'").groupBy("store_name", "status").agg(F.min("album").alias("album"))
    return audit.failure_preview(r.withColumn("errors", F.array(F.lit("a"), "album")))


@query(_RECORDS + f", c AS (SELECT count(*) FILTER (status = 'converted') AS a, count(*) FILTER (status = 'resumed') AS b, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (n_warnings > 0 AND {_HERE}) AS w, count(*) AS n FROM records) SELECT stopped, 'converted ' || a || ', resumed ' || b || ', failed ' || f || ' of ' || (n + 5 * stopped) || chr(10) || w || ' with warnings' || CASE WHEN stopped > 0 THEN chr(10) || 'INTERRUPTED: run again to resume' || chr(10) || 'PARTIAL RUN: 5 of ' || (n + 5) || ' entries were not handled' ELSE '' END AS text FROM c, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS stopped)")
def run_report_text(spark, d):
    c = audit.counts(shape(spark, d, "records")).withColumn("stopped", F.explode(F.array(F.lit(0), F.lit(1))))
    c = c.withColumns({"in_manifest": F.col("attempted") + 5 * F.col("stopped"), "interrupted": F.col("stopped") > 0, "complete": F.col("stopped") == 0})
    return audit.run_text(c).select("stopped", "text")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN 'interrupted' WHEN o_orderkey % 3 > 0 THEN 'incomplete' WHEN o_custkey % 4 > 0 THEN 'failed' ELSE 'ok' END AS severity, CASE WHEN o_orderkey % 5 < 2 THEN printf('Stopped after %d files.', o_custkey) WHEN o_orderkey % 3 > 0 THEN printf('Only %d files were attempted.', o_custkey) WHEN o_custkey % 4 > 0 THEN printf('%d of %d files failed.', o_custkey % 4, o_custkey) ELSE printf('All %d files are done, %d with warnings.', o_custkey, o_orderkey % 7) END AS sentence FROM orders")
def run_severities(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    r = read(spark, d, "orders").select(k, (k % 5 < 2).alias("interrupted"), n.alias("attempted"), (n % 4).alias("failed"), (k % 7).alias("with_warnings"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("complete"))
    return audit.summary(r).select("o_orderkey", "severity", "sentence")


@query("WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Root' ELSE ' ' || c_mktsegment END AS album FROM customer) SELECT c_custkey, album, CASE lower(trim(album)) WHEN 'building' THEN DATE '1999-12-24' WHEN 'machinery' THEN DATE '2001-07-04' END AS owner_date FROM a")
def owner_dates(spark, d):
    days = config.album_dates_frame(spark, {"building": config.parse_owner_date("1999-12-24"), "machinery": config.parse_owner_date("2001-07-04"), "root": config.parse_owner_date("1950-01-01")})
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "Root").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("album"))
    return config.with_owner_date(c, days)


_PIDS = "(SELECT unnest([2, 17, 16777218, 33554433, 33619968, 50397185, 268435459, 305419896]) AS pid)"


@query(f"SELECT n_nationkey, pid, CASE WHEN n_nationkey % 2 = 0 AND pid = 2 THEN 'Title' WHEN n_nationkey % 2 = 0 AND pid = 17 THEN 'Thumbnail' WHEN pid = 16777218 THEN 'HighestWidth' WHEN pid = 33554433 THEN 'Res0_SubimageHeight' WHEN pid = 33619968 THEN 'Res1_SubimageWidth' WHEN pid = 50397185 THEN 'JpegTables1' WHEN pid = 268435459 THEN 'SpatialOrientation' ELSE 'PID_0x' || upper(lpad(printf('%x', pid), 8, '0')) END AS name FROM nation, {_PIDS}")
def property_names(spark, d):
    p = F.explode(F.array(*[F.lit(x).cast("long") for x in (2, 17, 16777218, 33554433, 33619968, 50397185, 268435459, 305419896)])).alias("pid")
    n = read(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, properties.SUMMARY).otherwise("00").alias("fmtid"), p)
    return n.select("n_nationkey", "pid", properties.property_name(F.col("fmtid"), F.col("pid")).alias("name"))


def _properties(spark, d):
    """Rows of two sections a supplier: title, width, aspect, matrix, thumbnail, and an error now and then."""
    k = F.col("s_suppkey")
    matrix = F.to_json(F.transform(F.sequence(F.lit(1), F.when(k % 3 == 0, 4).otherwise(16)), lambda i: (i + k).cast("double")))
    row = lambda ix, fmtid, pid, value, raw=None, error=None: F.struct(F.lit(ix).alias("section_ix"), F.lit(fmtid).alias("fmtid"), F.lit(pid).cast("long").alias("pid"), value.cast("string").alias("value"), (F.lit(None) if raw is None else raw).cast("binary").alias("raw"), (F.lit(None) if error is None else error).cast("string").alias("error"))
    late = F.concat(F.lit('"late '), k, F.lit('"'))
    rows = F.array(
        row(1, properties.SUMMARY, 2, late), row(0, properties.SUMMARY, 2, F.when(k % 2 == 0, F.concat(F.lit('"name '), k, F.lit('"'))), error=F.when(k % 2 == 1, "cut")), row(0, "00", 0x01000002, k * 10),
        row(0, "00", 0x10000003, matrix), row(0, "00", 0x10000000, k / 4), row(1, "00", 0x10000000, k / 2), row(0, properties.SUMMARY, 17, F.lit("null"), raw=F.concat(F.lit("t"), k)), row(1, properties.SUMMARY, 17, F.lit("null"), raw=F.lit("other")),
    )
    return read(spark, d, "supplier").select("s_suppkey", F.explode(rows).alias("p")).select("s_suppkey", "p.*")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'name ' ELSE 'late ' END || CAST(s_suppkey AS VARCHAR) AS title FROM supplier")
def first_title(spark, d):
    p = _properties(spark, d).withColumn("name", properties.property_name(F.col("fmtid"), F.col("pid")))
    return properties.first_property(p, ["s_suppkey"], "Title", "string").withColumnRenamed("Title", "title")


@query("SELECT s_suppkey, CAST(s_suppkey * 10 AS INTEGER) AS width, CASE WHEN s_suppkey % 2 = 0 THEN 'name ' ELSE 'late ' END || CAST(s_suppkey AS VARCHAR) AS title, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 16 END AS n_matrix, CASE WHEN s_suppkey % 2 = 1 THEN 'cut' ELSE '' END AS errors FROM supplier")
def derived_metadata(spark, d):
    x = properties.derived(_properties(spark, d), ["s_suppkey"])
    return x.select("s_suppkey", F.col("HighestWidth").alias("width"), F.col("Title").alias("title"), F.size("SpatialOrientation").alias("n_matrix"), F.array_join("errors", ";").alias("errors"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 THEN CAST(1 + s_suppkey AS DOUBLE) END AS m0, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 2.0 END AS aspect, CASE WHEN s_suppkey % 2 = 1 THEN 'cut' END AS error FROM supplier")
def transform_parse(spark, d):
    x = properties.transform_stream(_properties(spark, d), ["s_suppkey"])
    return x.select("s_suppkey", F.get("matrix", F.lit(0)).alias("m0"), "aspect", "error")


@query("SELECT s_suppkey, 't' || CAST(s_suppkey AS VARCHAR) AS thumbnail FROM supplier")
def thumbnail_locate(spark, d):
    return properties.thumbnail_property(_properties(spark, d), ["s_suppkey"]).select("s_suppkey", F.col("thumbnail").cast("string").alias("thumbnail"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN CASE c_custkey % 4 WHEN 0 THEN 'NIF_RGB' ELSE 'PhotoYCC' END ELSE 'NIF_RGB' END AS colour_space, c_custkey % 4 > 1 AS assumed, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'scanner' END AS make FROM customer")
def colour_and_make(spark, d):
    k = F.col("c_custkey")
    colour = properties.colour_space(F.when(k % 4 == 0, "NIF_RGB").when(k % 4 == 1, "PhotoYCC").when(k % 4 == 2, "other"))
    make = properties.make_and_model(F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise(" "), F.when(k % 3 == 1, "scanner").when(k % 3 == 2, ""))
    return read(spark, d, "customer").select(k, colour.alias("c"), make.alias("make")).select("c_custkey", "c.*", "make")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) WHEN 1 THEN TIMESTAMP '2001-02-03 04:05:06' END AS scan_date, CASE WHEN o_orderkey % 4 = 2 THEN 'unreadable date in spring' END AS error FROM orders")
def scan_dates(spark, d):
    k = F.col("o_orderkey") % 4
    x = properties.scan_date(F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 2, "in spring"), F.when(k < 2, "2001-02-03 04:05:06"))
    return read(spark, d, "orders").select("o_orderkey", x.alias("x")).select("o_orderkey", "x.*")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE TIMESTAMP '1601-01-01' + to_seconds(11644473600 + o_orderkey * 3600) END AS stamp FROM orders")
def filetime_stamps(spark, d):
    k = F.col("o_orderkey")
    ticks = F.when(k % 5 == 0, F.lit(0).cast("long")).when(k % 5 == 1, F.lit(9_000_000_000_000_000_000)).otherwise((F.lit(11_644_473_600) + k.cast("long") * 3600) * 10_000_000 + 9)
    return read(spark, d, "orders").select("o_orderkey", dates.filetime(ticks).alias("stamp"))


@query("WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) + k AS INTEGER) AS year FROM orders, (SELECT unnest([0, 40, 100]) AS k)) SELECT year, (SELECT max(x) FROM (SELECT make_date(year, 11, d) AS x FROM (SELECT unnest(generate_series(22, 28)) AS d)) WHERE dayofweek(x) = 4) AS thanksgiving FROM y")
def thanksgiving_by_year(spark, d):
    y = read(spark, d, "orders").select(F.explode(F.array(*[F.year("o_orderdate") + k for k in (0, 40, 100)])).alias("year")).distinct()
    return y.select("year", dates.thanksgiving(F.col("year")).alias("thanksgiving"))


@query(with_shapes("frames") + "SELECT p_partkey, 3 AS \"left\", CAST(width - 9 AS INTEGER) AS top, 11 AS \"right\", CAST(width - 2 AS INTEGER) AS bottom, abs(aspect - width / CAST(height AS DOUBLE)) < 0.01 AS full_frame FROM frames")
def turned_boxes(spark, d):
    f = shape(spark, d, "frames")
    box = F.struct(F.lit(2).alias("left"), F.lit(3).alias("top"), F.lit(9).alias("right"), F.lit(11).alias("bottom"))
    full = geometry.is_full_frame(F.lit(0.0), F.lit(0.0005), F.col("width") / F.col("height"), F.lit(1.0), F.col("aspect"))
    x = f.select("p_partkey", geometry.turned(box, F.col("width")).alias("x"), full.alias("full_frame")).select("p_partkey", "x.*", "full_frame")
    return x.withColumns({c: F.col(c).cast("int") for c in ("left", "top", "right", "bottom")})


_GEOMETRY = "(SELECT p_partkey, p_partkey % 5 AS k, CAST(200 + p_size AS INTEGER) AS w, CAST(100 + p_size AS INTEGER) AS h FROM part)"


@query(f"SELECT p_partkey, CASE k WHEN 0 THEN 'absent' WHEN 1 THEN 'identity' WHEN 2 THEN 'rotate' WHEN 3 THEN 'unsupported' ELSE 'crop' END AS status, CASE WHEN k = 2 THEN 90 ELSE 0 END AS rotation, CASE WHEN k = 2 THEN h ELSE w END AS out_width, CASE WHEN k = 2 THEN w ELSE h END AS out_height FROM {_GEOMETRY}")
def output_geometries(spark, d):
    k, w, h = F.col("p_partkey") % 5, (F.lit(200) + F.col("p_size")).cast("int"), (F.lit(100) + F.col("p_size")).cast("int")
    m = lambda **at: F.array(*[F.lit(float(at.get(f"m{i}", 1.0 if i in (10, 15) else 0.0))) for i in range(16)])
    matrix = F.when(k == 1, m(m0=1, m5=1)).when(k == 2, m(m1=-1, m4=1)).when(k == 3, m(m0=1, m1=0.7, m5=1)).when(k == 4, m(m0=0.5, m5=0.5))
    x = geometry.output_geometry(matrix, F.when(k == 4, w / h), w, h)
    return read(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.status", "x.rotation", "x.out_width", "x.out_height")


@query(r"WITH c AS (SELECT *, c_custkey * 1000.0 AS n FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE '' END AS scope, '&lt;' || c_custkey || '&gt; &amp; &quot;x&quot; &#x27;' AS escaped, CASE WHEN n < 1024 THEN printf('%.0f', n) || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024) || ' KB' ELSE printf('%.1f', n / 1048576) || ' MB' END AS amount FROM c")
def name_helpers(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k, names.stem_scope("album", F.col("c_mktsegment"), k % 2 == 0).alias("scope"), names.html_escape(F.concat(F.lit("<"), k, F.lit("> & \"x\" '"))).alias("escaped"), names.human_bytes(k * 1000).alias("amount"))


_ZONES = {" us/eastern ": "US/Eastern", "eastern": "America/New_York", "EUROPE/london": "Europe/London", "america/new york": "America/New_York", "utc": "UTC"}


@query("SELECT s_suppkey, zone FROM supplier JOIN (VALUES " + ", ".join(f"({k}, '{b}')" for k, b in enumerate(_ZONES.values())) + ") AS t(k, zone) ON s_suppkey % 5 = k")
def zone_names(spark, d):
    # The few spellings that a table holds are resolved once each, then joined.
    asked = F.array(*map(F.lit, _ZONES))
    s = read(spark, d, "supplier").select("s_suppkey", F.get(asked, (F.col("s_suppkey") % 5).cast("int")).alias("asked"))
    found = zones.resolve_zones(r["asked"] for r in s.select("asked").distinct().limit(1000).collect())
    return s.join(F.broadcast(spark.createDataFrame(sorted(found.items()), "asked string, zone string")), "asked").select("s_suppkey", "zone")


@query("SELECT s_suppkey, CAST(t AS BIGINT) AS tile_ix, CAST(64 + s_nationkey AS BIGINT) AS width, CAST(2 AS BIGINT) AS tiles, CAST(t * 1000 AS BIGINT) AS \"offset\", CAST(s_nationkey AS BIGINT) AS size, CAST(2 AS BIGINT) AS compression, CAST(1 + t AS BIGINT) AS table_id FROM supplier, (SELECT unnest([0, 1]) AS t)")
def tile_headers(spark, d):
    n = F.col("s_nationkey")
    tile = lambda t: F.concat(_le(F.lit(t * 1000)), _le(n), _le(F.lit(2)), _le(F.lit(1 + t << 24)))
    head = F.concat(F.lit("FEFF" + "00" * 30), _le(n + 64), _le(F.lit(7)), _le(F.lit(2)), F.lit("00" * 20))
    s = read(spark, d, "supplier").select("s_suppkey", F.unhex(F.concat(head, tile(0), tile(1))).alias("data"))
    return binary.parse_tiles(s, ["s_suppkey"], "data").where("error is null").select("s_suppkey", "tile_ix", "width", "tiles", "offset", "size", "compression", "table_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2) THEN 'own ' || l_linenumber WHEN l_orderkey % 2 = 0 THEN 'shared' END AS tables, CASE WHEN l_linenumber > 2 AND l_orderkey % 2 = 1 THEN 'no JPEG tables' END AS table_error FROM lineitem")
def tile_table_lookup(spark, d):
    t = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("table_id"), F.lit(2).alias("compression"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("file"))
    ids = F.when(F.col("file") % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(254))).otherwise(F.array(F.lit(1), F.lit(2)))
    tables = o.select("file", F.explode(ids).alias("table_id")).withColumn("tables", F.when(F.col("table_id") == 254, "shared").otherwise(F.concat(F.lit("own "), "table_id")))
    return images.tile_tables(t, tables).select(F.col("file").alias("l_orderkey"), F.col("table_id").alias("l_linenumber"), "tables", "table_error")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS stdev, round(avg(CASE WHEN l_quantity <= 5 OR l_quantity >= 45 THEN 1.0 ELSE 0.0 END), 6) AS clipped FROM lineitem GROUP BY 1")
def pixel_statistics(spark, d):
    v = F.col("l_quantity").cast("double")
    x = read(spark, d, "lineitem").groupBy("l_returnflag").agg(*measure.pixel_statistics(v, 5, 45))
    return x.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "clipped")])


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'rotation+crop' WHEN p_partkey % 2 = 0 THEN 'rotation' WHEN p_partkey % 3 = 0 THEN 'crop' ELSE 'identity' END AS outcome, CAST(p_size AS VARCHAR) || 'x7' AS size, p_brand AS colour FROM part")
def sample_profiles(spark, d):
    k = F.col("p_partkey")
    x = images.sample_profile(F.lit("identity"), k % 2 == 0, (k % 4 == 0) | ((k % 3 == 0) & (k % 2 == 1)), F.col("p_size"), F.lit(7), F.col("p_brand"))
    return read(spark, d, "part").select(k, x.alias("x")).select("p_partkey", "x.*")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS BIGINT) ELSE 0 END AS attempted, o_orderkey % 4 = 0 AND o_custkey % 2 = 0 AS complete FROM orders")
def report_tolerance(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit('{"attempted": '), "o_custkey", F.lit(', "complete": '), (F.col("o_custkey") % 2 == 0).cast("string"), F.lit("}"))).when(k == 1, '{"attempted": ').when(k == 2, "[1]")
    o = read(spark, d, "orders").select("o_orderkey", text.alias("value"))
    kept = F.from_json(F.to_json(F.struct("o_orderkey")), "o_orderkey long")["o_orderkey"]
    return images.read_report(o.withColumn("o_orderkey", kept), keep=["o_orderkey"]).select("o_orderkey", "attempted", "complete")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS store_name, CASE WHEN o_orderkey % 3 = 0 THEN 'report' WHEN o_orderkey % 2 = 0 THEN 'sidecar' END AS date_original FROM orders")
def report_sidecar_dates(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders")
    r = o.select(k.cast("string").alias("store_name"), F.when(k % 3 == 0, "report").alias("date_original"))
    return images.report_with_sidecars(r, o.where(k % 2 == 0).select(k.cast("string").alias("store_name"), F.lit("sidecar").alias("date_original")))


@query("SELECT s_suppkey, 16 AS n_keys, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS preferred_name, CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 1 END AS duplicate_count, 'Root Entry' AS stream FROM supplier")
def sidecar_keys(spark, d):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("array<string>")
    e = read(spark, d, "supplier").select(k.cast("string").alias("sha256"), F.lit(7).alias("size"), F.lit(None).cast("string").alias("store_name"), F.when(k % 2 == 0, F.col("s_name")).alias("preferred_name"), F.lit(None).cast("string").alias("preferred_relpath"), F.lit(None).cast("boolean").alias("is_human_named"), none.alias("albums"), none.alias("trees"), none.alias("sources"), F.when(k % 3 == 0, 5).alias("duplicate_count"))
    x = e.select("sha256", F.array(F.lit("Root Entry")).alias("stream_inventory"), F.create_map(F.lit("a"), F.lit("b")).alias("property_sets"), F.lit(None).cast("string").alias("extension_storages"), F.lit(None).cast("string").alias("derived_metadata"), none.alias("extraction_errors"))
    s = sink.sidecar_documents(e, x)
    got = lambda p: F.get_json_object("sidecar", p)
    return s.select(F.col("sha256").cast("long").alias("s_suppkey"), F.size(F.json_object_keys("sidecar")).alias("n_keys"), got("$.preferred_name").alias("preferred_name"), got("$.duplicate_count").cast("int").alias("duplicate_count"), got("$.stream_inventory[0]").alias("stream"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 THEN 'resumed' ELSE 'todo' END AS what FROM orders")
def resumed_conversion(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(k.cast("string").alias("sha256"))
    done = o.where(F.col("sha256").cast("long") % 3 == 0).select("sha256", F.concat(F.lit("out/"), "sha256").alias("path"))
    there = done.where(F.col("sha256").cast("long") % 5 > 0).select("path")
    left, resumed = todo(o, done, there)
    named = lambda x, what: x.select(F.col("sha256").cast("long").alias("o_orderkey"), F.lit(what).alias("what"))
    return named(left, "todo").unionByName(named(resumed, "resumed"))
