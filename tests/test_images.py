import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline import session
from quarryline.operators import audit, images


def test_stitch_turn_and_digest(spark):
    rng = np.random.default_rng(1)
    picture = rng.integers(0, 256, (70, 130, 3), dtype=np.uint8)
    padded = np.zeros((128, 192, 3), np.uint8)
    padded[:70, :130] = picture
    padded[:64, 64:128] = (10, 20, 30)
    rows = []
    for ix in range(6):
        r, c = divmod(ix, 3)
        tile = padded[r * 64 : r * 64 + 64, c * 64 : c * 64 + 64]
        rows.append(("f", 130, 70, "NIF_RGB", ix, 1 if ix == 1 else 0, 10 | 20 << 8 | 30 << 16, None if ix == 1 else bytes(tile.tobytes())))
    rows += [("g", 10, 10, "NIF_RGB", 0, 2, 0, b"\xff\xd8"), ("h", 100, 10, "NIF_RGB", 0, 0, 0, b""), ("k", 2, 1, "PhotoYCC", 0, 0, 0, bytes([100, 156, 137] * 2))]
    df = spark.createDataFrame(rows, "file string, width int, height int, colour_space string, tile_ix int, compression int, subtype int, data binary").repartition(3)
    got = {r["file"]: r for r in images.stitch(df).collect()}
    want = padded[:70, :130]
    assert bytes(got["f"]["rgb"]) == want.tobytes() and got["f"]["pixel_sha256"] == hashlib.sha256(want.tobytes()).hexdigest()
    assert got["g"]["rgb"] is None and "image library" in got["g"]["error"] and "1 tiles" in got["h"]["error"]
    assert bytes(got["k"]["rgb"]) == bytes([135] * 6)
    t = images.turn_images(images.stitch(df).where("file = 'f'").withColumn("rotation", F.lit(90))).first()
    assert (t["width"], t["height"]) == (70, 130) and bytes(t["rgb"]) == np.rot90(want).tobytes()


def test_tables_fall_back(spark):
    tiles = spark.createDataFrame([("f", 3, 2), ("f", 9, 2), ("g", 1, 2), ("g", 1, 0)], "file string, table_id int, compression int")
    tables = spark.createDataFrame([("f", 3, "own"), ("f", 254, "shared")], "file string, table_id int, tables string")
    got = [tuple(r) for r in images.tile_tables(tiles, tables).orderBy("file", "table_id", F.desc("compression")).select("tables", "table_error").collect()]
    assert got == [("own", None), ("shared", None), (None, "no JPEG tables"), (None, None)]


def test_reports_and_profiles(spark):
    texts = spark.createDataFrame([('{"attempted": 2, "failed": 0, "with_warnings": 1, "complete": true}',), ("{cut",), ("[]",), (None,)], "value string")
    got = [r["severity"] for r in audit.summary(images.read_report(texts)).collect()]
    assert got == ["ok", "incomplete", "incomplete", "incomplete"]
    p = spark.range(1).select(images.sample_profile(F.lit("identity"), F.lit(True), F.lit(True), F.lit(3), F.lit(4), F.lit("NIF_RGB")).alias("p"), images.resolution_index(F.lit(None).cast("int"), F.lit(3)).alias("a"), images.resolution_index(F.lit(3), F.lit(3)).alias("b")).first()
    assert tuple(p["p"]) == ("rotation+crop", "3x4", "NIF_RGB") and p["a"]["index"] == 0 and p["b"]["index"] is None and p["b"]["error"]
    r = spark.createDataFrame([("a", None), ("b", "2001")], "store_name string, date_original string")
    s = spark.createDataFrame([("a", "1999"), ("b", "1998")], "store_name string, date_original string")
    assert sorted(tuple(x) for x in images.report_with_sidecars(r, s).collect()) == [("a", "1999"), ("b", "2001")]


def test_files_in_few_bytes_are_dealt_out(spark):
    rows = spark.range(4000).select(F.col("id").alias("file"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.lit("NIF_RGB").alias("colour_space"), F.lit(0).alias("tile_ix"), F.lit(images.FILL).alias("compression"), F.lit(7).alias("subtype"), F.lit(None).cast("binary").alias("data"))
    made = images.stitch(rows.coalesce(1)).select("file", "pixel_sha256", F.spark_partition_id().alias("task")).collect()
    assert len(made) == len({r["file"] for r in made}) == 4000 and {r["pixel_sha256"] for r in made} == {hashlib.sha256(b"\7\0\0" * 4096).hexdigest()}
    assert len({r["task"] for r in made}) >= 8


@pytest.mark.parametrize("step", [images.stitch, images.turn_images])
def test_python_gets_few_bytes_at_once(spark, step):
    tile = F.encode(F.repeat(F.lit("abc"), images.SIDE * images.SIDE), "UTF-8")
    rows = spark.range(0, 2000, 1, 1).select(F.col("id").alias("file"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.lit("NIF_RGB").alias("colour_space"), F.lit(0).alias("tile_ix"), F.lit(images.RAW).alias("compression"), F.lit(0).alias("subtype"), tile.alias("data"), tile.alias("rgb"), F.lit(90).alias("rotation"))
    before = spark.conf.get(session.BATCH_SETTING)
    try:
        for given, kept in (("64m", str(session.BATCH_BYTES)), ("67108864b", str(session.BATCH_BYTES)), ("100kb", "100kb")):
            spark.conf.set(session.BATCH_SETTING, given)
            assert step(rows).count() == 2000 and spark.conf.get(session.BATCH_SETTING) == kept
            sizes = [r["n"] for r in rows.select("data").mapInArrow(lambda it: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in it), "n long").collect()]
            assert sum(sizes) >= 2000 * 3 * 64 * 64 and max(sizes) <= session.BATCH_BYTES + 100_000
    finally:
        spark.conf.set(session.BATCH_SETTING, before)
