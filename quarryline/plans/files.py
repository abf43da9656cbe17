"""Queries over files that are written from the given tables: listings, copies, manifests, streams, images. Importing registers them.

The files stand in the session's shared folder, which must be mounted by driver and executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import images
from quarryline.plans.adapters import dealt, read
from quarryline.plans.bindings import _le, query
from quarryline.session import cut, mounted_folder
from quarryline.sinks import catalogue as sink
from quarryline.sinks import records
from quarryline.sources import binary, tree
from quarryline.streaming import progress, resume

_FILES = """files AS (SELECT s_suppkey AS k, CASE s_nationkey % 3 WHEN 0 THEN 'N' || CAST(s_nationkey AS VARCHAR) || '/deep/' WHEN 1 THEN '' ELSE '.hidden/' END || s_name || CASE WHEN s_suppkey % 4 = 0 THEN '.txt' WHEN s_suppkey % 4 = 1 THEN '.FPX' ELSE '.fpx' END AS relpath, s_name || ' ' || CAST(s_suppkey AS VARCHAR) || ' of ' || CAST(s_nationkey AS VARCHAR) AS content FROM supplier)"""


def _write_files(spark: SparkSession, d: str, root: str) -> DataFrame:
    """A file for each supplier below root -> (k, relpath, content), once all stand there."""
    j = F.col("s_nationkey") % 3
    folder = F.when(j == 0, F.concat(F.lit("N"), "s_nationkey", F.lit("/deep/"))).when(j == 1, "").otherwise(".hidden/")
    suffix = F.when(F.col("s_suppkey") % 4 == 0, ".txt").when(F.col("s_suppkey") % 4 == 1, ".FPX").otherwise(".fpx")
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(folder, "s_name", suffix).alias("relpath"), F.concat("s_name", F.lit(" "), "s_suppkey", F.lit(" of "), "s_nationkey").alias("content"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for relpath, content in zip(batch["relpath"], batch["content"], strict=True):
                path = os.path.join(root, relpath)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
            yield batch

    return cut(rows.mapInPandas(write, rows.schema))


@query(f"WITH {_FILES} SELECT relpath, regexp_extract(relpath, '[^/]*$') AS name, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS sha256 FROM (SELECT * FROM files WHERE k % 4 > 0)")
def tree_scan(spark, d):
    root = mounted_folder(spark, "archive")
    _write_files(spark, d, root)
    return tree.in_listing_order(tree.scan_tree(spark, root)).select("relpath", "name", "size", "sha256")


@query(f"WITH {_FILES} SELECT relpath AS path, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM files")
def tree_stat(spark, d):
    root = mounted_folder(spark, "archive")
    _write_files(spark, d, root)
    return tree.tree_snapshot(spark, root).select("path", "size")


@query(f"WITH {_FILES} SELECT CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes, false AS was_capped FROM files")
def tree_size(spark, d):
    root = mounted_folder(spark, "archive")
    _write_files(spark, d, root)
    return tree.size_estimate(tree.tree_snapshot(spark, root))


@query(f"WITH {_FILES} SELECT relpath, sha256(content) AS sha256, false AS is_ole, 'not a compound document' AS ole_error, 0 AS n_streams FROM files WHERE k % 4 > 0")
def assembled_scan(spark, d):
    root = mounted_folder(spark, "archive")
    _write_files(spark, d, root)
    _, files = tree.assemble_scan(spark, root, mounted_folder(spark, "scan"))
    return files.select("relpath", "sha256", "is_ole", "ole_error", F.size("streams").alias("n_streams"))


@query(f"WITH {_FILES}, t AS (SELECT count(*) AS n, sum(octet_length(encode(content))) AS b, count(*) FILTER (k % 10 = 0) AS bad, sum(octet_length(encode(content))) FILTER (k % 10 = 0) AS bb FROM files) SELECT 'first' AS run, CAST(n - bad AS BIGINT) AS copied, CAST(0 AS BIGINT) AS skipped, CAST(bad AS BIGINT) AS failed, CAST(b - bb AS BIGINT) AS bytes FROM t UNION ALL SELECT 'again', 0, CAST(n - bad AS BIGINT), CAST(bad AS BIGINT), 0 FROM t")
def store_copies(spark, d):
    root, store = mounted_folder(spark, "archive"), mounted_folder(spark, "store")
    files = _write_files(spark, d, root)
    wanted = F.when(F.col("k") % 10 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256))
    entries = files.select(wanted.alias("sha256"), F.octet_length("content").cast("long").alias("size"), F.concat(F.lit(root + "/"), "relpath").alias("source_path"), F.concat(F.col("k").cast("string"), F.lit(".fpx")).alias("store_name"))
    first = cut(sink.copy_totals(sink.copy_to_store(entries, store)))
    return first.select(F.lit("first").alias("run"), "copied", "skipped", "failed", "bytes").unionByName(sink.copy_totals(sink.copy_to_store(entries, store)).withColumn("run", F.lit("again")))


@query(f"WITH {_FILES} SELECT sha256(content) AS sha256, count(*) AS outputs FROM files WHERE k % 4 > 0 GROUP BY 1")
def archive_stream(spark, d):
    root, state, out = (mounted_folder(spark, n) for n in ("archive", "state", "out"))
    _write_files(spark, d, root)
    os.makedirs(out, exist_ok=True)

    def convert(row: dict) -> list[str]:
        target = os.path.join(out, row["sha256"])
        with open(target, "w", encoding="utf-8") as f:
            f.write(row["relpath"])
        return [target]

    nothing = spark.createDataFrame([], "path string")
    resume.run_files(tree.arriving_files(spark, root, mounted_folder(spark, "log")), convert, lambda: nothing, state, "run")
    return resume.read_state(spark, state, "run").groupBy("sha256").agg(F.count("*").alias("outputs"))


@query("SELECT sha256(p_name) AS sha256, CAST(p_size AS BIGINT) AS size, p_name AS preferred_name, p_partkey % 2 = 0 AS is_human_named, p_brand || ',' || p_type AS albums, CAST(1 AS BIGINT) AS duplicate_count, p_partkey % 2 = 0 AS verified FROM part")
def manifest_round_trip(spark, d):
    p = read(spark, d, "part")
    none = F.array().cast("array<string>")
    entries = p.select(
        F.sha2("p_name", 256).alias("sha256"), F.col("p_size").cast("long").alias("size"), F.lit(None).cast("string").alias("store_name"), F.col("p_name").alias("preferred_name"), F.col("p_name").alias("preferred_relpath"), (F.col("p_partkey") % 2 == 0).alias("is_human_named"),
        F.array("p_brand", "p_type").alias("albums"), none.alias("trees"), none.alias("sources"), F.lit(1).cast("long").alias("duplicate_count"), F.col("p_partkey").alias("k"),
    )
    out = None
    for verified in (True, False):
        path = mounted_folder(spark, "manifest") + ".json"
        part = entries.where((F.col("k") % 2 == 0) == verified).drop("k")
        sink.export_manifest(part, part.agg(F.count("*").alias("files")), verified, path)
        header, back = sink.read_manifest(spark, path)
        said = header.select(sink.is_verified(header).alias("v")).first()["v"]
        back = back.select("sha256", "size", "preferred_name", "is_human_named", F.array_join("albums", ",").alias("albums"), "duplicate_count", F.lit(said).alias("verified"))
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT CAST(c_nationkey AS VARCHAR) AS run, c_custkey AS at, c_name AS line FROM customer")
def run_log(spark, d):
    path = mounted_folder(spark, "log")
    c = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("run"), F.col("c_custkey").alias("at"), F.col("c_name").alias("line"))
    for part in (0, 1):
        records.append_log(c.where(F.col("at") % 2 == part), path)
    return spark.read.schema("at bigint, line string, run string").parquet(path).select("run", "at", "line")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def report_tables(spark, d):
    path = mounted_folder(spark, "report")
    records.write_report(path, counts=read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return spark.read.schema("o_orderstatus string, n bigint").json(f"{path}/counts")


@query("""WITH o AS (SELECT CAST(o_custkey % 500 AS VARCHAR) AS run, CAST(o_orderkey AS BIGINT) AS seq, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 97 AS INTEGER) END AS done, CASE WHEN o_orderkey % 7 = 3 THEN CAST(o_custkey AS INTEGER) END AS total, o_orderstatus = 'F' AS failed, o_orderkey % 101 = 5 AS interrupted FROM orders)
 SELECT run, seq, max(done) OVER w AS done, last_value(total IGNORE NULLS) OVER w AS total, CAST(count(*) FILTER (failed) OVER w AS BIGINT) AS failed, bool_or(interrupted) OVER w AS interrupted FROM o WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def progress_stream(spark, d):
    given = spark.read.parquet(f"{d}/orders.parquet")
    # A pattern, as a stream takes no single file for a folder.
    stream = spark.readStream.schema(given.schema).parquet(f"{d}/orders.parque[t]")
    k = F.col("o_orderkey")
    events = stream.select(
        (F.col("o_custkey") % 500).cast("string").alias("run"), k.cast("long").alias("seq"), F.when(k % 2 == 0, (k % 97).cast("int")).alias("done"), F.when(k % 7 == 3, F.col("o_custkey").cast("int")).alias("total"),
        (F.col("o_orderstatus") == "F").alias("failed"), (k % 101 == 5).alias("interrupted"),
    )
    out, checkpoint = mounted_folder(spark, "progress"), mounted_folder(spark, "progress-checkpoint")
    # Lines of a run must come in order, so the table comes as one batch.
    progress.track_progress(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(once=True).start().awaitTermination()
    return spark.read.schema(progress.OUT).parquet(out)


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'caf' || chr(233) WHEN 1 THEN 'caf' || chr(920) ELSE 'caf' || chr(1081) END || CAST(c_custkey % 10 AS VARCHAR) AS value FROM customer")
def code_pages(spark, d):
    k = F.col("c_custkey")
    page = F.when(k % 3 == 0, "E404").when(k % 3 == 1, "B501").otherwise("E304")
    body = F.concat(F.lit("02000000"), page, F.lit("0000" + "1E000000" + "06000000" + "636166E9"), F.hex(F.encode((k % 10).cast("string"), "UTF-8")), F.lit("000000"))
    head = F.lit("FEFF" + "0000" + "00000000" + "00" * 16 + "01000000" + "02" * 16 + "30000000" + "30000000" + "02000000" + "01000000" + "18000000" + "02000000" + "20000000")
    c = dealt(spark, d, "customer", "c_custkey").select(k, F.unhex(F.concat(head, body)).alias("data"))
    return binary.parse_properties(c, ["c_custkey"], "data").where("pid = 2").select(k, F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("value"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NIF_RGB' WHEN 1 THEN 'PhotoYCC' ELSE 'UNKNOWN' END AS colour_space, CASE WHEN c_custkey % 3 = 1 THEN 'PhotoYCC' ELSE 'NIF_RGB' END AS decoded_as, c_custkey % 3 = 2 AS assumed, c_custkey % 2 = 1 AS uncalibrated FROM customer")
def colour_descriptors(spark, d):
    from quarryline.functions import properties

    k = F.col("c_custkey")
    channels = F.when(k % 3 == 0, "000003000100030002000300").when(k % 3 == 1, "000002000100020002000200").otherwise("010000000200000003000000")
    blob = F.concat(F.lit("41000000" + "14000000"), _le(k % 2), F.lit("03000000"), channels)
    head = F.lit("FEFF" + "0000" + "00000000" + "00" * 16 + "01000000" + "02" * 16 + "30000000" + "2C000000" + "01000000" + "02000002" + "10000000")
    c = dealt(spark, d, "customer", "c_custkey").select(k, F.unhex(F.concat(head, blob)).alias("data"))
    x = properties.derived(binary.parse_properties(c, ["c_custkey"], "data"), ["c_custkey"])
    return x.select(k, "colour.colour_space", "colour.decoded_as", "colour.assumed", "colour.uncalibrated")


@query("""WITH p AS (SELECT p_partkey AS k, CAST(65 + p_size AS INTEGER) AS w, CAST(60 + p_partkey % 9 AS INTEGER) AS h, chr(CAST(65 + p_partkey % 26 AS INTEGER)) || 'zx' AS c FROM part)
 SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN 'tiles of kind 2 need an image library' END AS error, CASE WHEN k % 5 > 0 THEN sha256(repeat(c, w * h)) END AS pixel_sha256, CASE WHEN k % 2 = 0 THEN h ELSE w END AS width FROM p""")
def stitched_images(spark, d):
    k, w, h = F.col("p_partkey"), (F.col("p_size") + 65).cast("int"), (F.col("p_partkey") % 9 + 60).cast("int")
    first = k % 26 + 65
    down = F.ceil(h / 64).cast("int")
    t = dealt(spark, d, "part", "p_partkey").select(k.alias("file"), w.alias("width"), h.alias("height"), F.lit("NIF_RGB").alias("colour_space"), first.alias("c"), F.explode(F.sequence(F.lit(0), F.ceil(w / 64).cast("int") * down - 1)).alias("tile_ix"))
    kind = F.when((F.col("file") % 5 == 0) & (F.col("tile_ix") == 1), images.CODED).when(F.col("tile_ix") % 2 == 0, images.RAW).otherwise(images.FILL)
    raw = F.encode(F.repeat(F.concat(F.char("c"), F.lit("zx")), images.SIDE * images.SIDE), "UTF-8")
    tiles = t.withColumns({"compression": kind, "subtype": (F.col("c") + ord("z") * 256 + ord("x") * 65536).cast("int"), "data": F.when(F.col("tile_ix") % 2 == 0, raw)})
    whole = images.stitch(tiles.drop("c")).withColumn("rotation", F.when(F.col("file") % 2 == 0, 90).otherwise(0))
    turned = images.turn_images(whole)
    # All pixels are alike, so turning an image leaves its digest.
    return turned.select(F.col("file").alias("p_partkey"), "error", F.when(F.col("error").isNull(), F.sha2("rgb", 256)).alias("pixel_sha256"), "width")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE 8 END AS n_properties, sha256('t' || CAST(s_suppkey AS VARCHAR)) AS blob_sha256 FROM supplier")
def sidecar_texts(spark, d):
    from quarryline.plans.more import _properties

    p = _properties(spark, d).withColumn("type_name", F.when(F.col("pid") == 17, "CF").otherwise("I4")).where("not (error is not null and s_suppkey % 2 = 0) and not (pid = 268435456 and section_ix = 1 and s_suppkey % 2 = 0)")
    text = sink.sidecars(p, ["s_suppkey"])
    doc = F.from_json("sidecar", "properties array<struct<section_ix:int,pid:bigint,blob:struct<base64:string,length:int>>>")["properties"]
    blob = F.get(F.filter(doc, lambda x: (x["pid"] == 17) & (x["section_ix"] == 0)), F.lit(0))["blob"]["base64"]
    return text.select("s_suppkey", F.size(doc).alias("n_properties"), F.sha2(F.unbase64(blob), 256).alias("blob_sha256"))
