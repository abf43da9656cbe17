"""What a run writes, where, and whether it is right (PRJ-09, PRJ-10, STR-09, RUN-06, VAL-06): columns and small tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Output trees, file suffixes of the formats, framings, and TIFF's numbers for Deflate.
TREES = ("archive", "sharing")
SUFFIXES = {"tiff": "tif", "jpeg": "jpg"}
FRAMINGS = ("full", "cropped")
DEFLATE = (8, 32946)
SPEC = "struct<tree string, fmt string, framing string, suffix string, label string>"


class OutputError(ValueError):
    """Outputs that no run can write."""


@dataclass(frozen=True)
class Output:
    """An image that every entry gets."""

    tree: str
    fmt: str
    framing: str

    def __post_init__(self):
        for value, known in ((self.tree, TREES), (self.fmt, tuple(SUFFIXES)), (self.framing, FRAMINGS)):
            if value not in known:
                raise OutputError(f"{value!r} is none of {', '.join(known)}")

    def column(self) -> Column:
        parts = {"tree": self.tree, "fmt": self.fmt, "framing": self.framing, "suffix": SUFFIXES[self.fmt], "label": f"{self.tree}/{self.fmt}/{self.framing}"}
        return F.struct(*[F.lit(v).alias(k) for k, v in parts.items()])


def outputs(archive: tuple[str, str] | None = ("tiff", "full"), sharing: tuple[str, str] | None = ("jpeg", "cropped")) -> list[Output]:
    """The outputs asked for, (format, framing) a tree; none at all is refused."""
    asked = [Output(tree, *how) for tree, how in zip(TREES, (archive, sharing), strict=True) if how]
    if not asked:
        raise OutputError("no output was asked for; a dry run lists without writing")
    return asked


def single_output(mode: Column, fmt: Column, framing: Column) -> Column:
    """struct(tree, fmt, framing) of a mode: the named ones are fixed, another takes what it is given, its tree follows the framing."""
    named = {"sharing": ("sharing", "jpeg", "cropped"), "archive": ("archive", "tiff", "full")}
    given = (F.when(framing == "cropped", "sharing").otherwise("archive"), fmt, framing)
    columns = []
    for k, name in enumerate(("tree", "fmt", "framing")):
        value = given[k]
        for m, fixed in named.items():
            value = F.when(mode == m, fixed[k]).otherwise(value)
        columns.append(value.alias(name))
    return F.struct(*columns)


def relative_path(folder: Column, filename: Column, suffix: Column) -> Column:
    """folder/filename.suffix; the folder '.' is none."""
    return F.concat(F.when(folder.isNull() | folder.isin("", "."), "").otherwise(F.concat(folder, F.lit("/"))), filename, F.lit("."), suffix)


def expand(entries: DataFrame, specs: Sequence[Output], folder: str = "folder", filename: str = "filename") -> DataFrame:
    """A row for each entry and output, with spec and path; the few outputs are literals, so nothing is shuffled."""
    rows = entries.withColumn("spec", F.explode(F.array(*[s.column() for s in specs])))
    return rows.withColumn("path", F.concat_ws("/", F.col("spec.tree"), relative_path(F.col(folder), F.col(filename), F.col("spec.suffix"))))


def image_problems(facts: DataFrame) -> DataFrame:
    """Facts read from image headers against what metadata declare: adds problems, an array of texts.

    fmt, framing, compression (number), sampling (array of struct(h, v)), width, height, declared and crop (struct of width
    and height, or null). What can't be verified is a problem, not a pass.
    """
    size = lambda c: F.struct(F.col(f"{c}.width").alias("w"), F.col(f"{c}.height").alias("h"))
    own = F.struct(F.col("width").alias("w"), F.col("height").alias("h"))
    cropped = (F.col("framing") == "cropped") & F.col("crop").isNotNull()
    want = F.when(cropped, size("crop")).when(F.col("declared").isNotNull(), size("declared"))
    unread = F.col("sampling").isNull() | (F.size("sampling") == 0)
    tests = [
        ((F.col("fmt") == "tiff") & ~F.coalesce(F.col("compression").isin(*DEFLATE), F.lit(False)), "compression is not Deflate"),
        ((F.col("fmt") == "jpeg") & unread, "chroma sampling could not be verified"),
        ((F.col("fmt") == "jpeg") & ~unread & F.exists("sampling", lambda s: (s["h"] != 1) | (s["v"] != 1)), "chroma sampling is not 4:4:4"),
        (want.isNull(), "no declared size to verify against"),
        (want.isNotNull() & (want != own), "size differs from what is declared"),
        (cropped & F.col("declared").isNotNull() & (own == size("declared")), "a crop is declared but the frame is still full"),
    ]
    return facts.withColumn("problems", F.array_compact(F.array(*[F.when(test, text) for test, text in tests])))
