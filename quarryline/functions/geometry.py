"""Viewing transforms, crop boxes, tiles and colours (GEO-01..06, PIX-01, PRJ-05..08): column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<left:int,top:int,right:int,bottom:int>"


def near(a: Column, b: float, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def is_identity(m: Column, tolerance: float = 0.02) -> Column:
    at = lambda k: F.get(m, F.lit(k))
    return near(at(0), 1, tolerance) & near(at(5), 1, tolerance) & near(at(1), 0, tolerance) & near(at(3), 0, tolerance) & near(at(4), 0, tolerance) & near(at(7), 0, tolerance)


def orientation(m: Column) -> Column:
    """identity, rotate, crop or unsupported, of a 4 by 4 matrix given as 16 numbers."""
    at = lambda k: F.get(m, F.lit(k))
    quarter = (F.abs(at(0)) <= 0.05) & (F.abs(at(5)) <= 0.05) & (at(1) < -0.5) & (at(4) > 0.5)
    straight = (F.abs(at(1)) <= 0.02) & (F.abs(at(4)) <= 0.02)
    even = near(at(0) - at(5), 0, 1e-4) & (at(0) > 0)
    return (
        F.when(m.isNull() | (F.size(m) != 16), "unsupported").when(is_identity(m), "identity")
        .when(quarter, F.when(near(-at(1) - at(4), 0, 1e-3), "rotate").otherwise("unsupported"))
        .when(straight & even, "crop").otherwise("unsupported")
    )


def is_full_frame(x: Column, y: Column, w: Column, h: Column, aspect: Column) -> Column:
    return (F.abs(x) < 1e-3) & (F.abs(y) < 1e-3) & (F.abs(h - 1) < 1e-3) & (F.abs(w - aspect) < 1e-2)


def crop_box(m: Column, aspect: Column, width: Column, height: Column) -> Column:
    """struct(box, reason): a null box with an empty reason is the full frame, with a reason it can't be told.

    The unit square of the given aspect goes through the matrix; its bounding box, in heights of the image, becomes pixels
    with origin and size rounded apart, half to even.
    """
    at = lambda k: F.get(m, F.lit(k))
    corners = [(F.lit(0.0), F.lit(0.0)), (aspect, F.lit(0.0)), (F.lit(0.0), F.lit(1.0)), (aspect, F.lit(1.0))]
    xs = [at(0) * x + at(1) * y + at(3) for x, y in corners]
    ys = [at(4) * x + at(5) * y + at(7) for x, y in corners]
    left, top = F.bround(F.least(*xs) * height), F.bround(F.least(*ys) * height)
    w, h = F.bround((F.greatest(*xs) - F.least(*xs)) * height), F.bround((F.greatest(*ys) - F.least(*ys)) * height)
    outside = (left < -1) | (top < -1) | (left + w > width + 1) | (top + h > height + 1)
    l2, t2 = F.greatest(left, F.lit(0)), F.greatest(top, F.lit(0))
    r2, b2 = F.least(left + w, width), F.least(top + h, height)
    full = (l2 <= 1) & (t2 <= 1) & (w >= width - 1) & (h >= height - 1)
    reason = (
        F.when(m.isNull() | (F.size(m) != 16), "no usable matrix").when(aspect.isNull() | (aspect <= 0), "no aspect")
        .when(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), "no size").when((w < 1) | (h < 1), "box under a pixel")
        .when(outside, "box outside the frame").otherwise("")
    )
    box = F.struct(l2.cast("int").alias("left"), t2.cast("int").alias("top"), r2.cast("int").alias("right"), b2.cast("int").alias("bottom"))
    return F.struct(F.when((reason == "") & ~full, box).alias("box"), reason.alias("reason"))


def turned(box: Column, width: Column) -> Column:
    """A box after a quarter turn against the clock."""
    return F.struct(box["top"].alias("left"), (width - box["right"]).alias("top"), box["bottom"].alias("right"), (width - box["left"]).alias("bottom"))


def output_geometry(m: Column, aspect: Column, width: Column, height: Column) -> Column:
    """struct(status, rotation, out_width, out_height, box): rotation and crop are told apart and together."""
    identity16 = F.array(*[F.lit(1.0 if k % 5 == 0 else 0.0) for k in range(16)])
    kind = orientation(m)
    crop = crop_box(F.coalesce(m, identity16), aspect, width, height)
    rotate = F.coalesce(kind == "rotate", F.lit(False))
    usable = aspect.isNotNull()
    status = (
        F.when(m.isNull() & ~usable, "absent").when(m.isNotNull() & is_identity(m, 1e-6) & ~usable, "identity")
        .when(m.isNotNull() & (kind == "unsupported"), "unsupported").when(usable & (crop["reason"] != ""), "unsupported")
        .when(rotate, "rotate").when(usable & crop["box"].isNotNull(), "crop").otherwise("identity")
    )
    turn = (status == "rotate")
    box = F.when(usable & (crop["reason"] == "") & status.isin("rotate", "crop"), F.when(turn, turned(crop["box"], width)).otherwise(crop["box"]))
    return F.struct(status.alias("status"), F.when(turn, 90).otherwise(0).alias("rotation"), F.when(turn, height).otherwise(width).alias("out_width"), F.when(turn, width).otherwise(height).alias("out_height"), F.when(crop["box"].isNotNull(), box).alias("box"))


def tile_count(width: Column, height: Column, side: int = 64) -> Column:
    return (F.ceil(width / side) * F.ceil(height / side)).cast("int")


def tile_place(index: Column, width: Column, side: int = 64) -> Column:
    across = F.ceil(width / side).cast("int")
    return F.struct(F.floor(index / across).cast("int").alias("tile_row"), (index % across).cast("int").alias("tile_col"))


def rgb(y: Column, c1: Column, c2: Column) -> Column:
    """PhotoYCC (0..255 each) to red, green, blue: clipped, then cut to whole numbers."""
    # The scale of luma, the zero of both chromas, and their weights.
    luma, blue, red = y * 1.3584, (c1 - 156) * 2.2179, (c2 - 137) * 1.8215
    whole = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")
    return F.struct(whole(luma + red).alias("red"), whole(luma - 0.194 * blue - 0.509 * red).alias("green"), whole(luma + blue).alias("blue"))


def audit_class(failed: Column, warnings: Column, undated: Column) -> Column:
    return F.when(failed, "failed").when(warnings > 0, "warning").when(~undated, "dated").otherwise("undated")
