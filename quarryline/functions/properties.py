"""Names of properties and what a photograph's properties tell (PRJ-01..05, PRJ-11, PRJ-12, SRC-10, DAT-18): columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Format ids of the standard sets, and property ids in them.
SUMMARY = "e0859ff2f94f6810ab9108002b27b3d9"
SUMMARY_NAMES = {1: "CodePage", 2: "Title", 3: "Subject", 4: "Author", 5: "Keywords", 6: "Comments", 7: "Template", 8: "LastAuthor", 9: "Revision", 10: "EditTime", 11: "LastPrinted", 12: "Created", 13: "LastSaved", 14: "PageCount", 15: "WordCount", 16: "CharCount", 17: "Thumbnail", 18: "Application", 19: "Security"}
IMAGE_NAMES = {0x01000000: "NumberOfResolutions", 0x01000002: "HighestWidth", 0x01000003: "HighestHeight", 0x01000004: "DefaultDisplayHeight", 0x01000005: "DefaultDisplayWidth", 0x01000006: "DisplayUnits"}
TRANSFORM_NAMES = {0x10000000: "ResultAspectRatio", 0x10000001: "RectangleOfInterest", 0x10000002: "Filtering", 0x10000003: "SpatialOrientation", 0x10000004: "ColorTwist", 0x10000005: "Contrast"}
RESOLUTION_NAMES = {0: "Width", 1: "Height", 2: "Color", 3: "NumericalFormat", 4: "DecimationMethod", 5: "DecimationPrefilter"}
INFO_NAMES = {
    0x21000000: "FileSource", 0x2300000A: "ContentDescriptionDate", 0x24000000: "CameraMake", 0x24000001: "CameraModel", 0x27000000: "FilmBrand", 0x27000001: "FilmSize", 0x28000000: "ScannerMake", 0x28000001: "ScannerModel",
    0x28000002: "ScannerSerialNumber", 0x28000003: "ScanSoftware", 0x28000005: "ServiceBureau", 0x28000006: "ScanOperator", 0x28000008: "ScanTime", 0x2800000A: "ScannerPixelSize",
}
ASSUMED = "NIF_RGB"
ASSUMED_CHANNELS = ["0x00030000", "0x00030001", "0x00030002"]


def property_name(fmtid: Column, pid: Column) -> Column:
    """A property's name: by its set and id, by the pattern of a resolution's or a table's ids, else PID_0x and the id."""
    known = F.lit(None).cast("string")
    for k, n in (IMAGE_NAMES | TRANSFORM_NAMES | INFO_NAMES).items():
        known = F.when(pid == k, n).otherwise(known)
    for k, n in SUMMARY_NAMES.items():
        known = F.when((fmtid == SUMMARY) & (pid == k), n).otherwise(known)
    family, level, kind = F.shiftright(pid, 24), F.shiftright(pid, 16).bitwiseAND(0xFF), pid.bitwiseAND(0xFFFF)
    res = F.lit(None).cast("string")
    for k, n in RESOLUTION_NAMES.items():
        res = F.when(kind == k, n).otherwise(res)
    return F.coalesce(
        known, F.when((family == 2) & res.isNotNull(), F.format_string("Res%d_Subimage%s", level, res)), F.when((family == 3) & (kind == 1), F.format_string("JpegTables%d", level)),
        F.format_string("PID_0x%08X", pid),
    )


def first_property(properties: DataFrame, keys: list[str], name: str, kind: str) -> DataFrame:
    """The value of a name in its first section, of each key."""
    own = properties.where((F.col("name") == name) & F.col("error").isNull())
    return own.groupBy(*keys).agg(F.min(F.struct("section_ix", "pid", "value")).alias("v")).select(*keys, F.from_json("v.value", kind).alias(name) if kind.startswith("array") else F.get_json_object(F.concat(F.lit('{"v":'), F.col("v.value"), F.lit("}")), "$.v").cast(kind).alias(name))


def derived(properties: DataFrame, keys: list[str]) -> DataFrame:
    """Property rows -> one row per key with what they tell: size, resolutions, colour, title, stamps, matrix, region, aspect, camera, scanner
    (null without its maker) and errors.

    One aggregation: each wanted property is the minimum of (section, value) among its rows; resolutions are those below their declared number
    that have a width and a height. A file's own word for its colours stays; what it doesn't say is assumed, and said to be.
    """
    p = properties.withColumn("name", property_name(F.col("fmtid"), F.col("pid")))
    wanted = {
        "HighestWidth": "int", "HighestHeight": "int", "ResultAspectRatio": "double", "Title": "string", "Author": "string", "Keywords": "string", "Created": "timestamp_ntz", "LastSaved": "timestamp_ntz",
        "NumberOfResolutions": "int", "Filtering": "double", "Contrast": "double", "Application": "string",
    } | {n: "string" for n in INFO_NAMES.values()}
    good = F.col("error").isNull()
    pick = lambda n: F.min(F.when((F.col("name") == n) & good, F.struct("section_ix", "value")))["value"]
    plain = lambda v: F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    columns = [plain(pick(n)).try_cast(t).alias(n) for n, t in wanted.items()]
    lists = [F.from_json(pick(n), "array<double>").alias(n) for n in ("SpatialOrientation", "RectangleOfInterest", "ColorTwist")]
    errors = F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("error")))).alias("errors")
    # A level has one width and one height, so what is collected is bounded by the file's levels.
    side = F.regexp_extract("name", r"^Res(\d+)_Subimage(Width|Height)$", 2)
    sides = F.collect_set(F.when((side != "") & good, F.struct(F.regexp_extract("name", r"^Res(\d+)_", 1).try_cast("int").alias("level"), side.alias("side"), "section_ix", plain(F.col("value")).try_cast("int").alias("n"))))
    colour = F.from_json(pick("Res0_SubimageColor"), "kind string, uncalibrated boolean, channels int, channel_ids array<string>, colour_space string").alias("_colour")
    d = p.groupBy(*keys).agg(*columns, *lists, errors, F.array_sort(sides).alias("_sides"), colour)

    def of(level: Column, name: str) -> Column:
        return F.get(F.filter("_sides", lambda s: (s["level"] == level) & (s["side"] == name)), F.lit(0))["n"]

    levels = F.when(F.col("NumberOfResolutions") > 0, F.sequence(F.lit(0), F.col("NumberOfResolutions") - 1)).otherwise(F.array().cast("array<int>"))
    resolutions = F.transform(levels, lambda k: F.struct(k.alias("resolution"), of(k, "Width").alias("width"), of(k, "Height").alias("height")))
    told = F.coalesce(F.col("_colour.kind") == "colour", F.lit(False))
    declared = F.when(told, F.col("_colour.colour_space"))
    own = F.struct(
        F.coalesce(declared, F.lit(ASSUMED)).alias("colour_space"), F.when(told, F.col("_colour.uncalibrated")).otherwise(True).alias("uncalibrated"), F.when(told, F.col("_colour.channels")).otherwise(3).alias("channels"),
        F.when(told, F.col("_colour.channel_ids")).otherwise(F.array(*map(F.lit, ASSUMED_CHANNELS))).alias("channel_ids"), colour_space(declared)["colour_space"].alias("decoded_as"), colour_space(declared)["assumed"].alias("assumed"),
    )
    camera = F.struct(F.col("CameraMake").alias("make"), F.col("CameraModel").alias("model"), F.col("Application").alias("software"), F.col("FileSource").alias("file_source"))
    parts = {"make": "ScannerMake", "model": "ScannerModel", "serial": "ScannerSerialNumber", "software": "ScanSoftware", "bureau": "ServiceBureau", "operator": "ScanOperator", "scan_time": "ScanTime", "pixel_size": "ScannerPixelSize", "film_brand": "FilmBrand", "film_size": "FilmSize"}
    scanner = F.when(F.col("ScannerMake") != "", F.struct(*[F.col(c).alias(n) for n, c in parts.items()]))
    d = d.withColumns({"resolutions": F.filter(resolutions, lambda r: r["width"].isNotNull() & r["height"].isNotNull()), "colour": own, "camera": camera, "scanner": scanner})
    return d.drop("_sides", "_colour", "CameraMake", "CameraModel", "Application", "FileSource", *parts.values())


def thumbnail_property(properties: DataFrame, keys: list[str]) -> DataFrame:
    """The bytes of property 17 of the summary, from its first section that has it."""
    own = properties.where((F.col("fmtid") == SUMMARY) & (F.col("pid") == 17) & F.col("error").isNull())
    return own.groupBy(*keys).agg(F.min(F.struct("section_ix", "raw"))["raw"].alias("thumbnail"))


def transform_stream(properties: DataFrame, keys: list[str]) -> DataFrame:
    """matrix (of 16 values) and aspect of a transform set; later sections win. A set with an error has the error and neither."""
    n = F.col("section_ix")
    matrix = F.when(F.col("pid") == 0x10000003, F.from_json("value", "array<double>"))
    aspect = F.when(F.col("pid") == 0x10000000, F.col("value").try_cast("double"))
    last = lambda v: F.max(F.when(v.isNotNull(), F.struct(n.alias("n"), v.alias("v"))))["v"]
    found = properties.groupBy(*keys).agg(last(F.when(F.size(matrix) == 16, matrix)).alias("matrix"), last(aspect).alias("aspect"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"))
    good = F.col("error") == ""
    return found.select(*keys, F.when(good, F.col("matrix")).alias("matrix"), F.when(good, F.col("aspect")).alias("aspect"), F.nullif("error", F.lit("")).alias("error"))


def colour_space(declared: Column) -> Column:
    """struct(colour_space, assumed): what a file doesn't say is assumed, and said to be."""
    known = F.coalesce(declared.isin("NIF_RGB", "PhotoYCC"), F.lit(False))
    return F.struct(F.when(known, declared).otherwise(ASSUMED).alias("colour_space"), (~known).alias("assumed"))


def make_and_model(camera: Column, scanner: Column) -> Column:
    """The scanner's only if the camera's is missing."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(camera), blank(scanner))


def scan_date(scan_time: Column, description_date: Column) -> Column:
    """struct(scan_date, error): the scan's time, else the description's; what can't be read is an error, not a null alone."""
    first = F.coalesce(scan_time, description_date)
    stamp = F.coalesce(*[first.cast("string").try_cast("timestamp_ntz")])
    return F.struct(stamp.alias("scan_date"), F.when(first.isNotNull() & stamp.isNull(), F.concat(F.lit("unreadable date "), first)).alias("error"))
