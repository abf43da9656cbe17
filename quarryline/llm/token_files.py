"""Operator 4: token ids as length-delimited binary records.

A shard is a file of frames: length (8 bytes, little-endian), masked checksum of the length, the record, masked checksum of
the record. A record is the document's key, the width of an id (2 bytes for vocabularies that fit, else 4) and the ids, all little-endian. Beside each shard stands an
offset index, 16 bytes a record (offset, ids before it in the shard), so that any record can be read alone, in any order.
The checksum is zlib's CRC-32, rotated and shifted by a constant so that a checksum of data with checksums stays sound.

Documents are range-partitioned by doc_id and a hash of the text, so shard k holds a run of the order, and rows without an
id, or of one id, spread too. A task writes to a name of its own and only
the names that the committed manifest lists count, so lost and repeated tasks leave no wrong shard.

Defined results: null text is empty (the end id alone); null doc_ids come last; rows of one doc_id are ordered by the
text's hash, then the text; an empty table writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import materialize, new_path, small_batches, text_or_empty
from quarryline.llm.unit_cache import UnitCache

MASK_DELTA = 0xA282EAD8
HEAD, HEAD_BYTES = "<QI", 12
TAIL, TAIL_BYTES = "<I", 4
#: Before the ids: doc_id, 1 if it is null, bytes of an id.
KEY, KEY_BYTES = "<qBB", 10
END_ID = 0
#: About so many documents and bytes of text to a shard.
SHARD_DOCS, SHARD_BYTES = 20_000, 32 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    length = struct.pack("<Q", len(record))
    return length + struct.pack(TAIL, masked(length)) + record + struct.pack(TAIL, masked(record))


def read_frame(data: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """The record of the frame at a place, and the place after it; raises ValueError where a checksum fails."""
    if len(data) < at + HEAD_BYTES:
        raise ValueError(f"cut frame at byte {at}")
    n, crc = struct.unpack_from(HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != crc:
        raise ValueError(f"damaged length at byte {at}")
    start, end = at + HEAD_BYTES, at + HEAD_BYTES + n
    record = bytes(data[start:end])
    if len(data) < end + TAIL_BYTES or masked(record) != struct.unpack_from(TAIL, data, end)[0]:
        raise ValueError(f"damaged record at byte {at}")
    return record, end + TAIL_BYTES


def filesystem(uri: str):
    """Arrow's file system for a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, shards: int | None = None) -> DataFrame:
    """Write all documents under path in ascending doc_id order; returns the manifest, one row per shard."""
    spark = docs.sparkSession
    small_batches(spark)
    if not shards:
        n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_or_empty()).cast("long"))).first()
        shards = max(spark.sparkContext.defaultParallelism, n // SHARD_DOCS, (size or 0) // SHARD_BYTES)
    order = [F.col("doc_id").asc_nulls_last(), F.col("_hash"), F.col("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_hash", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order).drop("_hash")
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, root = filesystem(path)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        cache = UnitCache.of_tokenizer(tokenizer_file)
        width = 2 if cache.vocabulary <= 1 << 16 else 4
        docs_n = ids_n = at = 0
        data = index = None
        for d in batches:
            if not len(d):
                continue
            if data is None:
                data, index = fs.open_output_stream(f"{root}/{name}.rec"), fs.open_output_stream(f"{root}/{name}.idx")
            for i, ids in zip(d["doc_id"], cache.encode(d["text"].tolist()), strict=True):
                ids = np.append(ids, END_ID).astype(f"<u{width}")
                null = i is None or i != i
                out = frame(struct.pack(KEY, 0 if null else int(i), null, width) + ids.tobytes())
                index.write(struct.pack("<QQ", at, ids_n))
                data.write(out)
                docs_n, ids_n, at = docs_n + 1, ids_n + len(ids), at + len(out)
        if data is not None:
            data.close()
            index.close()
            yield pd.DataFrame({"shard": [shard], "name": [name], "records": [docs_n], "ids": [ids_n], "bytes": [at]})

    manifest = materialize(ordered.mapInPandas(write, "shard int, name string, records long, ids long, bytes long"), "manifest")
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("ids_before", F.coalesce(before, F.lit(0)))


def read_shards(spark: SparkSession, path: str, manifest: DataFrame, run: int = 4000) -> DataFrame:
    """Read the manifest's shards back through their indexes: (doc_id, start, n_tokens, ids) of each record, ids as 32-bit integers.

    Work is dealt out in runs of records, so a large shard is read by several tasks.
    """
    runs = manifest.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(run).cast("long"))))
    runs = runs.repartition(max(spark.sparkContext.defaultParallelism, 8), "name", "first")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        for d in batches:
            for x in d.itertuples(index=False):
                with fs.open_input_file(f"{root}/{x.name}.idx") as f:
                    if f.size() != 16 * x.records:
                        raise ValueError(f"index of {x.name} is not whole")
                    n = min(run, x.records - x.first)
                    f.seek(16 * x.first)
                    offsets = np.frombuffer(f.read(16 * min(n + 1, x.records - x.first)), "<u8").reshape(-1, 2)
                start = int(offsets[0, 0])
                end = int(offsets[n, 0]) if len(offsets) > n else int(x.bytes)
                with fs.open_input_file(f"{root}/{x.name}.rec") as f:
                    f.seek(start)
                    data = f.read(end - start)
                rows = []
                for k in range(n):
                    record, _ = read_frame(data, int(offsets[k, 0]) - start)
                    i, null, width = struct.unpack_from(KEY, record)
                    ids = np.frombuffer(record, f"<u{width}", offset=KEY_BYTES)
                    rows.append((None if null else i, int(x.ids_before + offsets[k, 1]), len(ids), ids.astype("<u4").tobytes()))
                    if len(rows) == 500 or k == n - 1:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})
                        rows = []

    return runs.select("name", "first", "records", "bytes", "ids_before").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write the documents' ids and read them back."""
    path = path or new_path(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, path, write_shards(docs, path, tokenizer_file))
