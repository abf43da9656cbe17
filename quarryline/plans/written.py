"""Queries over what is written and read back: tags, pixels, claims. Importing registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import compare, outputs
from quarryline.plans.adapters import dealt, read
from quarryline.plans.bindings import query
from quarryline.sinks import catalogue as sink
from quarryline.sinks import image_files
from quarryline.sources import tags


def _hex(text):
    return F.hex(F.encode(text, "UTF-8"))


def _jpeg(*segments, width=None, sampling="11"):
    """A JPEG's header in hex: segments (marker, content in hex), a frame, the begin of a scan."""
    parts = [F.lit("FFD8")]
    for marker, content in segments:
        size = F.lpad(F.hex((F.length(content) / 2 + 2).cast("long")), 4, "0")
        parts.append(F.when(content.isNotNull(), F.concat(F.lit(marker), size, content)).otherwise(""))
    wide = F.lpad(F.hex(F.lit(64) if width is None else width), 4, "0")
    parts += [F.lit("FFC00011080030"), wide, F.lit("0301"), F.lit(sampling) if isinstance(sampling, str) else sampling, F.lit("00021101031101"), F.lit("FFDA0000")]
    return F.unhex(F.concat(*parts))


@query("""WITH c AS (SELECT c_custkey AS k, 'M' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS make, strftime(DATE '1990-01-01' + CAST(c_custkey % 3000 AS INTEGER), '%Y:%m:%d 12:00:00') AS stamp FROM customer)
 SELECT k AS c_custkey, 'exif:Make' AS tag, make AS value FROM c UNION ALL SELECT k, 'exif:DateTimeOriginal', stamp FROM c WHERE k % 3 > 0 UNION ALL SELECT k, 'exif:Software', 'v' || CAST(k % 7 AS VARCHAR) FROM c WHERE k % 2 = 0""")
def exif_read_back(spark, d):
    k = F.col("c_custkey")
    make = F.concat(F.lit("M"), F.lpad((k % 100000).cast("string"), 5, "0"))
    stamp = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (k % 3000).cast("int")), "yyyy:MM:dd 12:00:00")
    # Even keys: TIFF in little-endian order, as it is written here. Odd ones: a JPEG whose directories are big-endian.
    pair = lambda t, v: F.struct(F.lit(t).alias("tag"), v.alias("value"))
    named = F.filter(F.array(pair("exif:Make", make), pair("exif:Software", F.concat(F.lit("v"), k % 7)), pair("exif:DateTimeOriginal", F.when(k % 3 > 0, stamp))), lambda x: x["value"].isNotNull())
    tiff = image_files.encoded("tiff", F.lit(2), F.lit(1), F.unhex(F.lit("0A0B0C0D0E0F")), named)
    dated = F.concat(F.lit("4D4D002A000000080002" + "010F000200000007" + "00000026" + "8769000400000001" + "0000002E" + "00000000"), _hex(make), F.lit("0000" + "0001" + "9003000200000014" + "00000040" + "00000000"), _hex(stamp), F.lit("00"))
    undated = F.concat(F.lit("4D4D002A000000080001" + "010F000200000007" + "0000001A" + "00000000"), _hex(make), F.lit("00"))
    jpeg = _jpeg(("FFE1", F.concat(F.lit("457869660000"), F.when(k % 3 > 0, dated).otherwise(undated))))
    c = dealt(spark, d, "customer", "c_custkey").select(k, F.when(k % 2 == 0, tiff).otherwise(jpeg).alias("content"))
    return tags.tag_rows(tags.read_tags(c), "c_custkey")


_XMP_OPEN, _XMP_SHUT = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/">', "</rdf:RDF></x:xmpmeta>"


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 6 AS j, c_name AS v FROM customer)
 SELECT k AS c_custkey, CASE WHEN j = 3 THEN 'the XMP packet can''t be parsed' END AS error, CASE j WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN 'first' WHEN 4 THEN v || ' & co' END AS title, CASE j WHEN 0 THEN 'one' WHEN 1 THEN v || ',two' WHEN 4 THEN 'a,b,c' ELSE '' END AS subjects FROM c""")
def xmp_read_back(spark, d):
    k, v = F.col("c_custkey"), F.col("c_name")
    li = lambda text, lang=None: F.concat(F.lit(f'<rdf:li xml:lang="{lang}">' if lang else "<rdf:li>"), text, F.lit("</rdf:li>"))
    wrap = lambda *parts: F.concat(F.lit("<?xpacket begin='' id='x'?>" + _XMP_OPEN), *parts, F.lit(_XMP_SHUT + "  <?xpacket end='w'?>"))
    tag = lambda name, kind, *items: F.concat(F.lit(f"<dc:{name}><rdf:{kind}>"), *items, F.lit(f"</rdf:{kind}></dc:{name}>"))
    one = lambda *parts: F.concat(F.lit('<rdf:Description rdf:about="">'), *parts, F.lit("</rdf:Description>"))
    j = k % 6
    packet = (
        F.when(j == 0, wrap(one(tag("title", "Alt", li(F.lit("autre"), "fr"), li(v, "x-default"))), one(tag("subject", "Bag", li(F.lit("one"))))))
        .when(j == 1, wrap(one(tag("subject", "Seq", li(v), li(F.lit("two"))), tag("title", "Alt", li(v, "x-default")))))
        .when(j == 2, wrap(one(tag("title", "Alt", li(F.lit("first"), "de"), li(F.lit("second"), "fr")))))
        .when(j == 3, F.concat(F.lit("<not xml at all "), v))
        .when(j == 4, wrap(F.concat(F.lit('<rdf:Description dc:title="'), v, F.lit(' &amp; co">')), tag("subject", "Bag", li(F.lit("a")), li(F.lit("b")), li(F.lit("c"))), F.lit("</rdf:Description>")))
    )
    content = F.concat(F.lit("687474703A2F2F6E732E61646F62652E636F6D2F7861702F312E302F00"), _hex(packet))
    r = tags.read_tags(dealt(spark, d, "customer", "c_custkey").select(k, _jpeg(("FFE1", content)).alias("content")))
    of = lambda name: F.transform(F.filter("tags", lambda x: x["tag"] == name), lambda x: x["value"])
    return r.select(k, "error", F.get(of("xmp:title"), F.lit(0)).alias("title"), F.array_join(of("xmp:subject"), ",").alias("subjects"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS v FROM part)
 SELECT k AS p_partkey, CASE WHEN k % 4 = 3 THEN 'an IPTC record is cut' END AS error, CASE k % 4 WHEN 0 THEN v || '|' || repeat('x', 40000) WHEN 1 THEN 'Gr' || chr(252) || 'n|' || v WHEN 2 THEN 'é' ELSE '' END AS keywords FROM p""")
def iptc_read_back(spark, d):
    k, v = F.col("p_partkey"), F.col("p_name")
    record = lambda content: F.concat(F.lit("1C0219"), F.lpad(F.hex((F.length(content) / 2).cast("long")), 4, "0"), content)
    long = F.concat(F.lit("1C02198004"), F.lit(f"{40000:08X}"), F.repeat(F.lit("78"), 40000))
    j = k % 4
    block = F.when(j == 0, F.concat(record(_hex(v)), long)).when(j == 1, F.concat(record(F.lit("4772FC6E")), record(_hex(v)))).when(j == 2, record(F.lit("C3A9"))).otherwise(F.concat(F.lit("1C02190100"), _hex(v)))
    resource = F.concat(F.lit("50686F746F73686F7020332E3000" + "3842494D" + "0425" + "0000" + "00000003" + "01020300" + "3842494D" + "0404" + "0161"), F.lpad(F.hex((F.length(block) / 2).cast("long")), 8, "0"), block)
    r = tags.read_tags(dealt(spark, d, "part", "p_partkey").select(k, _jpeg(("FFED", resource)).alias("content")))
    return r.select(k, "error", F.array_join(F.transform("tags", lambda x: x["value"]), "|").alias("keywords"))


@query("""SELECT c_custkey AS path, CAST(NULL AS VARCHAR) AS tag, CASE c_custkey % 10 WHEN 0 THEN 'no such file' ELSE 'tags can''t be read: neither TIFF nor JPEG' END AS problem FROM customer WHERE c_custkey % 10 < 2
 UNION ALL SELECT c_custkey, 'exif:Make', 'different' FROM customer WHERE c_custkey % 10 = 2 UNION ALL SELECT c_custkey, 'exif:DateTimeOriginal', 'forbidden' FROM customer WHERE c_custkey % 10 = 3
 UNION ALL SELECT c_custkey, unnest(['iptc:Keywords', 'iptc:Keywords', 'xmp:subject', 'xmp:subject']), 'missing' FROM customer WHERE c_custkey % 10 = 4""")
def read_back_problems(spark, d):
    k = F.col("c_custkey")
    j = k % 10
    c = dealt(spark, d, "customer", "c_custkey")
    stamp = F.lit("1999-01-02 03:04:05").cast("timestamp_ntz")
    facts = c.select(k.alias("path"), F.col("c_mktsegment").alias("make"), F.when(j == 5, stamp).alias("original"), F.array(F.lit("album"), F.col("c_mktsegment")).alias("keywords"), F.col("c_name").alias("title"))
    done = c.select(k.alias("path"), F.when(j == 2, "other").otherwise(F.col("c_mktsegment")).alias("make"), F.when(j.isin(3, 5), stamp).alias("original"), F.when(j != 4, F.array(F.lit("album"), F.col("c_mktsegment"))).alias("keywords"), F.col("c_name").alias("title"))
    written = sink.tags_to_write(done.where(F.col("path") % 10 > 0))
    content = image_files.encoded("tiff", F.lit(1), F.lit(1), F.unhex(F.lit("010203")), F.col("tags"))
    files = written.select("path", F.when(F.col("path") % 10 == 1, F.lit(b"no image")).otherwise(content).alias("content"))
    return tags.read_back_problems(sink.expected_tags(facts), tags.read_tags(files))


@query("""WITH o AS (SELECT o_orderkey AS k, 'C' || CAST(o_custkey % 9 AS VARCHAR) AS make, strftime(o_orderdate, '%Y:%m:%d 00:00:00') AS stamp, o_orderpriority AS p FROM orders),
 a AS (SELECT k, list_filter(list_concat(CASE WHEN k % 4 = 1 THEN ['-EXIF:Make=scan', '-XMP-tiff:Make=scan'] WHEN k % 4 = 2 THEN [] ELSE ['-EXIF:Make=' || make, '-XMP-tiff:Make=' || make] END, ['-EXIF:CreateDate=' || stamp, '-XMP-xmp:CreateDate=' || stamp, '-EXIF:OffsetTimeDigitized=+01:00'],
   CASE WHEN k % 3 = 0 THEN ['-EXIF:DateTimeOriginal=' || stamp, '-XMP-photoshop:DateCreated=' || stamp, '-EXIF:OffsetTimeOriginal=+02:00'] ELSE [] END, ['-IPTC:Keywords=' || p, '-XMP-dc:Subject=' || p, '-IPTC:Keywords=all', '-XMP-dc:Subject=all'], CASE WHEN k % 5 = 0 THEN ['-XMP-dc:Title=' || p, '-IPTC:ObjectName=' || p, '-EXIF:ImageDescription=' || p] ELSE [] END), lambda x: x IS NOT NULL) AS args FROM o)
 SELECT k AS o_orderkey, array_to_string(args, chr(10)) AS arguments FROM a""")
def tag_assignments(spark, d):
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    o = read(spark, d, "orders").select(
        k, F.when(k % 4 == 2, F.lit(None)).when(k % 4 == 1, "").otherwise(F.concat(F.lit("C"), F.col("o_custkey") % 9)).alias("make"), F.when(k % 4 == 1, "scan").alias("scanner_make"), day.alias("digitized"), F.lit("+01:00").alias("digitized_offset"),
        F.when(k % 3 == 0, day).alias("original"), F.lit("+02:00").alias("original_offset"), F.array(F.col("o_orderpriority"), F.lit("all")).alias("keywords"), F.when(k % 5 == 0, F.col("o_orderpriority")).alias("title"),
    )
    return sink.tag_arguments(o).select(k, F.array_join("arguments", "\n").alias("arguments"))


@query("""SELECT p_partkey AS entry, CASE WHEN p_partkey % 7 = 6 THEN 'Taken/' || CAST(p_partkey // 7 AS VARCHAR) ELSE 'a/' || CAST(p_partkey // 7 AS VARCHAR) || '-' || CAST(p_partkey % 7 // 2 AS VARCHAR) END AS path FROM part WHERE p_partkey % 7 IN (1, 3, 5, 6)""")
def refused_claims(spark, d):
    # In a family of seven the second wants a path of the first, the third one of the second, which has claimed nothing, and so on.
    k = F.col("p_partkey")
    family, j = F.floor(k / 7).cast("string"), k % 7
    own = F.concat(F.when(j % 2 == 0, "A/").otherwise("a/"), family, F.lit("-"), F.floor(j / 2).cast("string"))
    other = F.concat(F.lit("b/"), family, F.lit("-"), F.floor((j + 1) / 2).cast("string"))
    wanted = F.when(j == 6, F.array(F.concat(F.lit("Taken/"), family))).otherwise(F.array(own, other))
    p = read(spark, d, "part")
    return compare.refused_entries(p.select(k.alias("entry"), F.explode(wanted).alias("path")), p.select(F.concat(F.lit("taken/"), family).alias("path")))


@query("""WITH p AS (SELECT p_partkey AS k, CAST(1 + p_size AS INTEGER) AS w, CAST(1 + p_partkey % 9 AS INTEGER) AS h FROM part)
 SELECT k AS p_partkey, fmt, CASE WHEN k % 8 < 7 THEN w END AS width, CASE WHEN k % 8 < 7 THEN h END AS height, CASE WHEN k % 8 < 7 THEN sha256(repeat(chr(CAST(65 + k % 50 AS INTEGER)) || 'z' || chr(CAST(48 + w % 60 AS INTEGER)), w * h)) END AS pixel_sha256 FROM p, (SELECT unnest(['tiff', 'png']) AS fmt)""")
def stored_pixels(spark, d):
    k, w, h = F.col("p_partkey"), (F.col("p_size") + 1).cast("int"), (F.col("p_partkey") % 9 + 1).cast("int")
    rgb = F.encode(F.repeat(F.concat(F.char(k % 50 + 65), F.lit("z"), F.char(w % 60 + 48)), w * h), "UTF-8")
    # Rows whose bytes make no image give no file.
    cut = F.when(k % 8 < 7, rgb).otherwise(F.substring(rgb, 2, 1 << 30))
    p = dealt(spark, d, "part", "p_partkey").select(k, w.alias("w"), h.alias("h"), cut.alias("rgb"))
    both = [p.select(k, F.lit(f).alias("fmt"), image_files.encoded(f, F.col("w"), F.col("h"), F.col("rgb")).alias("content")) for f in ("tiff", "png")]
    return both[0].unionByName(both[1]).select(k, "fmt", image_files.stored_pixels(F.col("content")).alias("x")).select(k, "fmt", "x.width", "x.height", "x.pixel_sha256")


@query("""WITH p AS (SELECT p_partkey AS k, CAST(40 + p_size AS BIGINT) AS w FROM part)
 SELECT k AS p_partkey, w AS width, CASE WHEN k % 2 = 0 THEN '' WHEN k % 3 = 0 THEN 'chroma sampling is not 4:4:4' ELSE '' END || CASE WHEN k % 5 = 0 AND k % 2 = 1 AND k % 3 = 0 THEN '; ' ELSE '' END || CASE WHEN k % 5 = 0 THEN 'size differs from what is declared' ELSE '' END AS problems FROM p""")
def header_checks(spark, d):
    k, w = F.col("p_partkey"), (F.col("p_size") + 40).cast("long")
    tiff = image_files.encoded("tiff", w.cast("int"), F.lit(48), F.unhex(F.repeat(F.lit("01"), (w * 48 * 3).cast("int"))))
    jpeg = _jpeg(width=w, sampling=F.when(k % 3 == 0, "22").otherwise("11"))
    p = dealt(spark, d, "part", "p_partkey").select(k, w.alias("declared_width"), F.when(k % 2 == 0, tiff).otherwise(jpeg).alias("content"))
    facts = tags.read_tags(p)
    size = F.struct((F.col("declared_width") + F.when(k % 5 == 0, 1).otherwise(0)).alias("width"), F.lit(48).cast("long").alias("height"))
    none = F.lit(None).cast("struct<width:bigint,height:bigint>")
    checked = outputs.image_problems(facts.withColumns({"framing": F.lit("full"), "declared": size, "crop": none}))
    return checked.select(k, "width", F.array_join("problems", "; ").alias("problems"))
