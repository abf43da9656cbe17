"""Where the catalogue goes, and reading it back (SNK-01..03, SNK-05, SRC-06, PRJ-14): tables, one JSON document, sidecars, the deduplicated store."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarryline.session import many_tasks

PIECE = 1 << 20
#: What a manifest's header says of the lines below it.
LAYOUT, BY_LINE = "layout", "an entry a line"
#: Larger blobs stand in a sidecar by digest and length.
INLINE = 64 * 1024


def write_manifest(entries: DataFrame, path: str) -> None:
    """The manifest as Parquet, the form that other jobs read."""
    entries.write.mode("overwrite").parquet(path)


def export_manifest(entries: DataFrame, counts: DataFrame, verified: bool, path: str) -> None:
    """The manifest as one ASCII JSON document for people, an entry a line; the file is put in place whole.

    Tasks write their lines to parts in a folder beside it, then copy them to their places in the document; the driver places the parts
    by their sizes and writes the header and the end. The folder must be mounted by driver and executors.
    """
    spark = entries.sparkSession
    temporary = f"{path}.{uuid.uuid4().hex}"
    folder = f"{temporary}.parts"
    os.makedirs(folder)

    def write(number: int, rows: Iterator[Row]) -> Iterator[tuple[int, str, int]]:
        # A task that runs twice writes another file; the one whose name comes back counts.
        part, size = os.path.join(folder, uuid.uuid4().hex), 0
        with open(part, "wb") as f:
            for row in rows:
                line = json.dumps(row.asDict(recursive=True), default=str).encode("ascii")
                size += f.write(b",\n" + line if size else line)
        yield number, part, size

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for part, at, more in zip(d["part"], d["at"], d["more"], strict=True):
                with open(part, "rb") as a, open(temporary, "r+b") as b:
                    b.seek(at)
                    shutil.copyfileobj(a, b, PIECE)
                    b.write(b",\n" if more else b"\n]}\n")
            yield d[["at"]]

    try:
        parts = [(part, size) for _, part, size in sorted(entries.orderBy("sha256").rdd.mapPartitionsWithIndex(write).collect()) if size]
        head = json.dumps({"manifest_version": 1, LAYOUT: BY_LINE, "verification": {"ok": verified}, "counts": counts.first().asDict()})[:-1] + ', "entries": [\n'
        at, placed = len(head), []
        for k, (part, size) in enumerate(parts, 1):
            placed.append((part, at, k < len(parts)))
            at += size + 2
        with open(temporary, "w", encoding="ascii", newline="") as f:
            f.write(head if parts else head + "]}\n")
        if placed:
            spark.createDataFrame(placed, "part string, at long, more boolean").repartition(min(len(placed), many_tasks(spark))).mapInPandas(place, "at long").count()
        os.replace(temporary, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        with contextlib.suppress(FileNotFoundError):
            os.remove(temporary)


ENTRY = "sha256 string, size long, store_name string, preferred_name string, preferred_relpath string, is_human_named boolean, albums array<string>, trees array<string>, sources array<string>, duplicate_count long"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, entries) of an exported manifest; a header without a verification is unverified.

    A document that says that it holds an entry a line is read by many tasks; any other is read whole, by one.
    """
    head = "manifest_version int, verification struct<ok boolean>, counts map<string, long>"
    entry = f"struct<{ENTRY.replace(' ', ': ').replace(',:', ',')}>"
    first = spark.read.text(path).select(F.substring("value", 1, PIECE).alias("v")).first()
    if first is not None and first["v"].startswith(f'{{"manifest_version": 1, "{LAYOUT}": "{BY_LINE}"') and first["v"].endswith('"entries": ['):
        header = spark.createDataFrame([(first["v"] + "]}",)], "v string").select(F.from_json("v", head).alias("h")).select("h.*")
        # The header is the one line that names the layout first; an entry begins with a name of its own.
        lines = spark.read.text(path).where(~F.startswith("value", F.lit('{"manifest_version": ')) & (F.col("value") != "]}"))
        return header, lines.select(F.from_json(F.regexp_replace("value", ",$", ""), entry).alias("e")).select("e.*")
    whole = spark.read.schema(f"{head}, entries array<{entry}>").option("multiLine", "true").json(path)
    return whole.drop("entries"), whole.select(F.explode("entries").alias("e")).select("e.*")



def sidecar_documents(entries: DataFrame, extracted: DataFrame) -> DataFrame:
    """An entry and what was extracted from its file -> (sha256, sidecar): one JSON document of 16 keys, with defaults.

    ``extracted``: sha256, stream_inventory, property_sets, extension_storages, derived_metadata, extraction_errors.
    """
    none = F.array().cast("array<string>")
    e = extracted.withColumnRenamed("sha256", "_sha256")
    d = entries.join(e, F.col("sha256") == F.col("_sha256"), "left")
    name = F.coalesce("store_name", "sha256")
    keys = {
        "sidecar_version": F.lit(1), "sha256": F.col("sha256"), "size": F.coalesce("size", F.lit(0)), "store_name": name,
        "preferred_name": F.coalesce("preferred_name", name), "preferred_relpath": F.coalesce("preferred_relpath", name), "preferred_name_is_human_authored": F.coalesce("is_human_named", F.lit(False)),
        "albums": F.coalesce("albums", none), "trees": F.coalesce("trees", none), "duplicate_count": F.coalesce("duplicate_count", F.lit(1)), "contributing_sources": F.coalesce("sources", none),
        "stream_inventory": F.coalesce("stream_inventory", none), "property_sets": F.col("property_sets"), "extension_storages": F.col("extension_storages"),
        "derived_metadata": F.col("derived_metadata"), "extraction_errors": F.coalesce("extraction_errors", none),
    }
    return d.select("sha256", F.to_json(F.struct(*[v.alias(k) for k, v in keys.items()]), {"ignoreNullFields": "false"}).alias("sidecar"))


def is_verified(header: DataFrame) -> Column:
    """Whether a manifest's header says that the tree was unchanged; no word of it is no."""
    return F.col("verification.ok").eqNullSafe(F.lit(True)) if "verification" in header.columns else F.lit(False)


def sidecars(properties: DataFrame, keys: list[str]) -> DataFrame:
    """Property rows -> one JSON text per key; blobs in base64, large ones by digest, length and reason."""
    raw = F.col("raw")
    blob = F.when(F.length(raw) <= INLINE, F.struct(F.base64(raw).alias("base64"), F.lit(None).cast("string").alias("sha256"), F.length(raw).alias("length"), F.lit(None).cast("string").alias("reason"))).otherwise(F.struct(F.lit(None).cast("string").alias("base64"), F.sha2(raw, 256).alias("sha256"), F.length(raw).alias("length"), F.lit("larger than 64 KiB").alias("reason")))
    row = F.struct("section_ix", "fmtid", "pid", "type_name", "value", F.when(F.col("type_name").isin("BLOB", "BLOB_OBJECT", "CF"), blob).alias("blob"), "error")
    return properties.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("properties"))).alias("sidecar"))


def _file_system(path: str):
    """The file system of a path or address, and the path in it. Addresses (hdfs://, s3://, file://) need a library that knows theirs."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def copy_to_store(entries: DataFrame, store: str) -> DataFrame:
    """(sha256, size, source_path, store_name) -> (store_name, status, bytes): copied, skipped or failed.

    Store and sources are paths that every executor mounts, or addresses of a file system. A file is skipped if size and hash already match. A
    copy goes to a name of its own beside its target, in pieces, is hashed as it stands there, and is then renamed, so a task that is lost or
    runs twice leaves no half file under a store's name.
    """

    def digest(system: fs.FileSystem, path: str) -> str:
        h = hashlib.sha256()
        with system.open_input_stream(path) as f:
            while piece := f.read(PIECE):
                h.update(piece)
        return h.hexdigest()

    def one(sha: str, size: int, source: str, name: str) -> tuple[str, str, int]:
        target_fs, folder = _file_system(store)
        target = f"{folder.rstrip('/')}/{name}"
        there = target_fs.get_file_info(target)
        if there.type == fs.FileType.File and there.size == size and digest(target_fs, target) == sha:
            return name, "skipped", 0
        source_fs, source = _file_system(source)
        temporary = f"{target}.{uuid.uuid4().hex}.part"
        try:
            target_fs.create_dir(target.rpartition("/")[0], recursive=True)
            with source_fs.open_input_stream(source) as a, target_fs.open_output_stream(temporary) as b:
                while piece := a.read(PIECE):
                    b.write(piece)
            if digest(target_fs, temporary) != sha:
                raise OSError(f"{source} isn't what it was")
            target_fs.move(temporary, target)
            return name, "copied", size
        except OSError:
            if target_fs.get_file_info(temporary).type == fs.FileType.File:
                target_fs.delete_file(temporary)
            return name, "failed", 0

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame([one(*r) for r in d.itertuples(index=False, name=None)], columns=["store_name", "status", "bytes"])

    return entries.select("sha256", "size", "source_path", "store_name").mapInPandas(copy, "store_name string, status string, bytes long")


def copy_totals(copied: DataFrame) -> DataFrame:
    return copied.agg(F.count_if(F.col("status") == "copied").alias("copied"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


#: What each fact of a picture is written as, in the order of the arguments.
ASSIGNED = {
    "make": ("EXIF:Make", "XMP-tiff:Make"),
    "model": ("EXIF:Model", "XMP-tiff:Model"),
    "software": ("EXIF:Software", "XMP-tiff:Software"),
    "digitized": ("EXIF:CreateDate", "XMP-xmp:CreateDate"),
    "digitized_offset": ("EXIF:OffsetTimeDigitized",),
    "original": ("EXIF:DateTimeOriginal", "XMP-photoshop:DateCreated"),
    "original_offset": ("EXIF:OffsetTimeOriginal",),
    "keywords": ("IPTC:Keywords", "XMP-dc:Subject"),
    "title": ("XMP-dc:Title", "IPTC:ObjectName", "EXIF:ImageDescription"),
}
#: Where each is read back, as sources.tags names it.
READ_BACK = {
    "make": ("exif:Make",), "model": ("exif:Model",), "software": ("exif:Software",), "digitized": ("exif:DateTimeDigitized",), "digitized_offset": ("exif:OffsetTimeDigitized",),
    "original": ("exif:DateTimeOriginal",), "original_offset": ("exif:OffsetTimeOriginal",), "keywords": ("iptc:Keywords", "xmp:subject"), "title": ("xmp:title", "iptc:ObjectName", "exif:ImageDescription"),
}


def _facts(facts: DataFrame) -> dict[str, Column]:
    """Values by name, arrays of texts, empty where there is nothing to write. Facts that the table doesn't have are none."""
    col = lambda c: F.col(c) if c in facts.columns else F.lit(None)
    text = lambda c: F.nullif(c.cast("string"), F.lit(""))
    stamp = lambda c: F.date_format(col(c).cast("timestamp_ntz"), "yyyy:MM:dd HH:mm:ss")
    one = {
        # A scanner stands in for a camera that isn't known.
        "make": F.coalesce(text(col("make")), text(col("scanner_make"))), "model": F.coalesce(text(col("model")), text(col("scanner_model"))), "software": text(col("software")),
        "digitized": stamp("digitized"), "digitized_offset": text(col("digitized_offset")), "original": stamp("original"), "original_offset": F.when(stamp("original").isNotNull(), text(col("original_offset"))), "title": text(col("title")),
    }
    none = F.array().cast("array<string>")
    out = {name: F.when(v.isNotNull(), F.array(v)).otherwise(none) for name, v in one.items()}
    return out | {"keywords": F.filter(F.coalesce(col("keywords").cast("array<string>"), none), lambda k: k.isNotNull() & (k != ""))}


def _for_all(values: dict[str, Column], targets: dict[str, tuple[str, ...]], make: Callable[[str, Column], Column]) -> Column:
    """What make gives for each target of each value, in order."""

    def of(names: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda v: F.array(*[make(n, v) for n in names])

    return F.flatten(F.concat(*[F.transform(values[fact], of(names)) for fact, names in targets.items()]))


def tag_arguments(facts: DataFrame, out: str = "arguments") -> DataFrame:
    """Adds the tag assignments of a picture, each only if its value is there; a picture without a date gets no date of its own.

    make, model, software, scanner_make, scanner_model, digitized, digitized_offset, original, original_offset, title, keywords (array).
    """
    values = _facts(facts)
    each = _for_all(values, ASSIGNED, lambda target, v: F.concat(F.lit(f"-{target}="), v))
    return facts.withColumn(out, each)


def expected_tags(facts: DataFrame, path: str = "path") -> DataFrame:
    """(path, tag, value, forbidden): what must be read back of a picture; without a date of its own that tag must not be there."""
    values = _facts(facts)
    row = lambda tag, v, no: F.struct(F.lit(tag).alias("tag"), v.alias("value"), F.lit(no).alias("forbidden"))
    each = _for_all(values, READ_BACK, lambda tag, v: row(tag, v, False))
    undated = F.when(F.size(values["original"]) == 0, F.array(row("exif:DateTimeOriginal", F.lit(None).cast("string"), True)))
    rows = F.concat(each, F.coalesce(undated, F.array().cast("array<struct<tag:string,value:string,forbidden:boolean>>")))
    return facts.select(F.col(path).alias("path"), F.explode(rows).alias("_r")).select("path", "_r.*")


def tags_to_write(facts: DataFrame, out: str = "tags") -> DataFrame:
    """Adds tags as sinks.image_files takes them."""
    values = _facts(facts)
    return facts.withColumn(out, _for_all(values, READ_BACK, lambda tag, v: F.struct(F.lit(tag).alias("tag"), v.alias("value"))))
