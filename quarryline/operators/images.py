"""Pixels from tiles (JON-08, PIX-02..06, AGG-15) and profiles of samples (RUN-07): raw and single-colour tiles.

Coded tiles need an image library that isn't here; they come out as an error of their file, never as guessed pixels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.session import BATCH_BYTES, bounded_batches, many_tasks
from quarryline.sources.binary import ycc_image

# How a tile is stored, and the table that stands in where a file's own is missing.
RAW, FILL, CODED = 0, 1, 2
SHARED_TABLE = 254
SIDE = 64
IMAGE = "width int, height int, rgb binary, pixel_sha256 string, error string"
NAMES = [x.split()[0] for x in IMAGE.split(", ")]
#: Rows of a batch of images.
BATCH_ROWS = 5000


def tile_tables(tiles: DataFrame, tables: DataFrame) -> DataFrame:
    """(file, table_id, ..) with (file, table_id, tables): each coded tile's tables, else the file's shared ones, else an error."""
    own = tables.select(F.col("file").alias("_f"), F.col("table_id").alias("_t"), F.col("tables").alias("_own"))
    shared = tables.where(F.col("table_id") == SHARED_TABLE).select(F.col("file").alias("_g"), F.col("tables").alias("_shared"))
    d = tiles.join(own, (F.col("file") == F.col("_f")) & (F.col("table_id") == F.col("_t")), "left").join(shared, F.col("file") == F.col("_g"), "left")
    found = F.coalesce("_own", "_shared")
    missing = (F.col("compression") == CODED) & found.isNull()
    return d.withColumns({"tables": found, "table_error": F.when(missing, "no JPEG tables")}).drop("_f", "_t", "_own", "_g", "_shared")


def decode_tile(kind: int, data: bytes | None, subtype: int, channels: int = 3) -> np.ndarray:
    """One tile as (SIDE, SIDE, channels); short raw data ends in zeros; raises ValueError for coded ones."""
    if kind == RAW:
        raw = (data or b"")[: SIDE * SIDE * channels].ljust(SIDE * SIDE * channels, b"\0")
        return np.frombuffer(raw, np.uint8).reshape(SIDE, SIDE, channels)
    if kind == FILL:
        colour = np.frombuffer(subtype.to_bytes(4, "little")[:channels], np.uint8)
        return np.broadcast_to(colour, (SIDE, SIDE, channels))
    raise ValueError(f"tiles of kind {kind} need an image library")


def _picture(width: int, height: int, colour_space: str, tiles: list[tuple]) -> bytes:
    """The RGB bytes of (tile_ix, compression, subtype, data); raises ValueError for tiles that make no image."""
    across, down = -(-width // SIDE), -(-height // SIDE)
    if sorted(t[0] for t in tiles) != list(range(across * down)):
        raise ValueError(f"{len(tiles)} tiles for {across} by {down}")
    canvas = np.empty((down * SIDE, across * SIDE, 3), np.uint8)
    for ix, kind, sub, data in tiles:
        r, c = divmod(ix, across)
        canvas[r * SIDE : (r + 1) * SIDE, c * SIDE : (c + 1) * SIDE] = decode_tile(kind, data, sub)
    canvas = canvas[:height, :width]
    return (ycc_image(canvas) if colour_space == "PhotoYCC" else canvas).tobytes()


def stitch(tiles: DataFrame) -> DataFrame:
    """(file, width, height, colour_space, tile_ix, compression, subtype, data) -> one image per file, or its error.

    A file's tiles are one image, so what is held at once is bounded by what a picture holds: batches of tiles and of images are of few
    bytes. Files are dealt out by hash into a number of tasks that doesn't come from bytes, as tiles that compress well would make few of them.
    """
    bounded_batches(tiles.sparkSession)
    kind = dict(tiles.dtypes)["file"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
        done, held = [], 0

        def rows() -> Iterator[tuple]:
            for given in batches:
                types[0] = given.schema.field("file").type
                yield from zip(*(c.to_pylist() for c in given.columns), strict=True)

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["file", *NAMES])

        for file, group in groupby(rows(), key=lambda r: r[0]):
            group = list(group)
            width, height, colour_space = int(group[0][1]), int(group[0][2]), group[0][3]
            rgb, error = None, None
            try:
                rgb = _picture(width, height, colour_space, [r[4:] for r in group])
            except ValueError as e:
                error = str(e)
            done.append((file, width, height, rgb, None if rgb is None else hashlib.sha256(rgb).hexdigest(), error))
            held += len(rgb or b"")
            if held >= BATCH_BYTES or len(done) >= BATCH_ROWS:
                yield batch()
                done, held = [], 0
        if done:
            yield batch()

    d = tiles.select("file", "width", "height", "colour_space", *(F.col(c).cast("int") for c in ("tile_ix", "compression", "subtype")), "data")
    return d.repartition(many_tasks(tiles.sparkSession), "file").sortWithinPartitions("file").mapInArrow(whole, f"file {kind}, {IMAGE}")


def turn_images(images: DataFrame) -> DataFrame:
    """width, height, rgb with rotation 0 or 90 -> turned against the clock; a crop travels as a box and cuts nothing here. Only images that turn go to Python."""
    bounded_batches(images.sparkSession)

    @F.pandas_udf("binary")
    def turned(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
        return pd.Series([None if raw is None else np.rot90(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)).tobytes() for w, h, raw in zip(width, height, rgb, strict=True)], dtype=object)

    swap = F.col("rotation") == 90
    done = images.withColumn("rgb", F.when(swap, turned("width", "height", F.when(swap, F.col("rgb")))).otherwise(F.col("rgb")))
    return done.withColumns({"width": F.when(swap, F.col("height")).otherwise(F.col("width")), "height": F.when(swap, F.col("width")).otherwise(F.col("height"))})


def resolution_index(wanted: Column, count: Column) -> Column:
    """struct(index, error): the top resolution unless one is asked for; one that isn't there is refused, not decoded as another."""
    there = F.coalesce((wanted >= 0) & (wanted < count), F.lit(False))
    refused = F.concat(F.lit("no resolution "), wanted.cast("string"), F.lit(" of "), F.coalesce(count, F.lit(0)).cast("string"))
    return F.struct(F.when(wanted.isNull(), F.lit(0)).when(there, wanted).alias("index"), F.when(wanted.isNotNull() & ~there, refused).alias("error"))


def sample_profile(status: Column, rotated: Column, cropped: Column, width: Column, height: Column, colour: Column) -> Column:
    """struct(outcome, size, colour): the strata that a sample should cover."""
    outcome = F.when(rotated & cropped, "rotation+crop").when(rotated, "rotation").when(cropped, "crop").otherwise(status)
    return F.struct(outcome.alias("outcome"), F.concat(width.cast("string"), F.lit("x"), height.cast("string")).alias("size"), colour.alias("colour"))


def sidecar_dates(texts: DataFrame, column: str = "sidecar") -> DataFrame:
    """store_name and a sidecar's JSON text -> store_name, date_original, sort_date; a text that is cut or says nothing gives nulls."""
    r = F.from_json(F.col(column), "derived_metadata struct<timestamps:struct<datetime_original_exif:string,sort_datetime:string>>", {"mode": "PERMISSIVE"})
    stamp = lambda name: F.nullif(r["derived_metadata"]["timestamps"][name], F.lit(""))
    return texts.select("store_name", stamp("datetime_original_exif").alias("date_original"), stamp("sort_datetime").alias("sort_date"))


def report_with_sidecars(report: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The report's rows: date_original of the report, else of the sidecar; sort_date of the sidecar where it has one; '(no album)' for none. Entries without a sidecar stay."""
    s = sidecars.select("store_name", F.col("date_original").alias("_sidecar"), *(["sort_date"] if "sort_date" in sidecars.columns else []))
    out = report.join(s, "store_name", "left").withColumn("date_original", F.coalesce(F.nullif("date_original", F.lit("")), "_sidecar")).drop("_sidecar")
    return out.withColumn("album", F.coalesce(F.nullif("album", F.lit("")), F.lit("(no album)"))) if "album" in out.columns else out


def read_report(texts: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Reports as JSON texts -> their counts; what is missing, cut or no object reads as unfinished."""
    r = F.from_json(F.col(column), "attempted long, failed long, with_warnings long, interrupted boolean, complete boolean", {"mode": "PERMISSIVE"})
    return texts.select(*(keep or []), r.alias("r")).select(*(keep or []), *[F.coalesce(F.col(f"r.{c}"), F.lit(0).cast("long")).alias(c) for c in ("attempted", "failed", "with_warnings")], *[F.coalesce(F.col(f"r.{c}"), F.lit(False)).alias(c) for c in ("interrupted", "complete")])
