"""Compound documents read where they lie (SRC-04, SRC-07): chains of sectors are followed by seeks.

A list of names needs the header, the directory's sectors and the parts of the sector table that lead through them; a
stream needs its own sectors besides. So bytes read grow with the directory, not with the pictures in the file. Damaged
documents give what can be read and an error; nothing loops, as a chain may not come back to a sector.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.sources.binary import MAGIC, PROPERTY, PROPERTY_STREAMS, _rows, parse_properties

# The first number that is no sector, entries' kinds and size.
NO_SECTOR = 0xFFFFFFFA
STORAGE, STREAM, ENTRY = 1, 2, 128


class DamagedDocument(ValueError):
    """A document whose structure can't be followed."""


class SectorFile:
    def __init__(self, file: BinaryIO):
        self.file, self.bytes_read = file, 0
        head = self._read(0, 512)
        if head[:8] != MAGIC:
            raise DamagedDocument("not a compound document")
        if len(head) < 512:
            raise DamagedDocument("damaged document: the header is cut")
        shift, mini_shift = struct.unpack_from("<HH", head, 30)
        if not 6 < shift <= 16 or not 0 < mini_shift < shift:
            raise DamagedDocument("damaged document: impossible sector sizes")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        self.first_dir, self.cutoff, self.first_mini = struct.unpack_from("<I4xII", head, 48)
        self.table_sectors = list(struct.unpack_from("<109I", head, 76))
        self.more = struct.unpack_from("<I", head, 68)[0]
        self.table: dict[int, tuple[int, ...]] = {}
        self.mini_table: list[int] | None = None
        self.mini_sectors: list[int] | None = None
        directory = b"".join(map(self.sector, self.chain(self.first_dir)))
        self.entries = [directory[k : k + ENTRY] for k in range(0, len(directory) - ENTRY + 1, ENTRY)]
        if not self.entries:
            raise DamagedDocument("damaged document: no directory")

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        self.bytes_read += len(data)
        return data

    def sector(self, n: int) -> bytes:
        return self._read((n + 1) * self.size, self.size)

    def _following(self, n: int) -> int:
        """The sector after one, from that part of the table that tells of it."""
        part, place = divmod(n, self.size // 4)
        if part not in self.table:
            seen = set()
            while part >= len(self.table_sectors) and self.more < NO_SECTOR and self.more not in seen:
                seen.add(self.more)
                block = self._numbers(self.sector(self.more))
                self.table_sectors += block[:-1]
                self.more = block[-1]
            where = self.table_sectors[part] if part < len(self.table_sectors) else NO_SECTOR
            if where >= NO_SECTOR:
                raise DamagedDocument(f"damaged document: the table has no sector {n}")
            self.table[part] = self._numbers(self.sector(where))
        return self.table[part][place]

    def _numbers(self, data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{self.size // 4}I", data.ljust(self.size, b"\xff"))

    def chain(self, n: int) -> list[int]:
        out, seen = [], set()
        while n < NO_SECTOR:
            if n in seen:
                raise DamagedDocument("damaged document: a chain comes back to itself")
            seen.add(n)
            out.append(n)
            n = self._following(n)
        return out

    def streams(self) -> dict[str, tuple[int, int]]:
        """Path -> (first sector, size)."""
        out: dict[str, tuple[int, int]] = {}
        stack, seen = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")], set()
        while stack:
            k, above = stack.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            e = self.entries[k]
            length = struct.unpack_from("<H", e, 64)[0]
            name = e[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", e, 68)
            stack += [(left, above), (right, above)]
            if e[66] == STORAGE:
                stack.append((child, f"{above}{name}/"))
            elif e[66] == STREAM:
                out[above + name] = struct.unpack_from("<II", e, 116)
        return out

    def content(self, first: int, size: int) -> bytes:
        """The bytes of a stream, small ones from the mini stream."""
        if size >= self.cutoff:
            need = -(-size // self.size)
            data = b"".join(map(self.sector, self.chain(first)[:need]))
        else:
            if self.mini_sectors is None:
                self.mini_sectors = self.chain(struct.unpack_from("<I", self.entries[0], 116)[0])
                self.mini_table = [x for n in self.chain(self.first_mini) for x in self._numbers(self.sector(n))]
            data, n, seen = b"", first, set()
            while n < NO_SECTOR and len(data) < size:
                if n in seen or n >= len(self.mini_table):
                    raise DamagedDocument("damaged document: a small stream's chain is broken")
                seen.add(n)
                place = n * self.mini
                if place // self.size >= len(self.mini_sectors):
                    raise DamagedDocument("damaged document: the mini stream is cut")
                data += self._read((self.mini_sectors[place // self.size] + 1) * self.size + place % self.size, self.mini)
                n = self.mini_table[n]
        if len(data) < size:
            raise DamagedDocument("damaged document: a stream is cut")
        return data[:size]


def _open(path: str):
    return open(path, "rb", buffering=0)


def inventory_of(path: Column) -> Column:
    """struct(is_ole, streams sorted, error, bytes_read) of files that executors can open."""
    kind = "is_ole boolean, streams array<string>, error string, bytes_read long"

    @F.pandas_udf(kind)
    def read(paths: pd.Series) -> pd.DataFrame:
        rows = []
        for p in paths:
            try:
                with _open(p) as f:
                    d = SectorFile(f)
                    rows.append((True, sorted(d.streams()), "", d.bytes_read))
            except DamagedDocument as e:
                rows.append((str(e) != "not a compound document", [], str(e), None))
            except (OSError, TypeError) as e:
                rows.append((None, [], str(e), None))
        return pd.DataFrame(rows, columns=["is_ole", "streams", "error", "bytes_read"]).astype({"bytes_read": "Int64"})

    return read(path)


def property_streams_at(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """keys and paths -> a row a property set: stream, data, error; the standard sets first, then those of extension storages."""

    def sets(where: bytes | None) -> Iterator[tuple]:
        if where is None:
            yield None, None, "no path"
            return
        try:
            with _open(where.decode()) as f:
                d = SectorFile(f)
                streams = d.streams()
                extra = sorted(n for n in streams if n not in PROPERTY_STREAMS and n.rpartition("/")[2].startswith("\x05"))
                for name in [n for n in PROPERTY_STREAMS if n in streams] + extra:
                    try:
                        yield name, d.content(*streams[name]), None
                    except DamagedDocument as e:
                        yield None, None, f"{name}: {e}"
        except (OSError, DamagedDocument) as e:
            yield None, None, str(e)

    own = df.withColumn("_path", F.encode(F.col(path), "UTF-8"))
    return _rows(own, keys, "_path", sets, "stream string, data binary, error string")


def file_properties_at(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """keys and paths -> keys, stream and a row a property (binary.PROPERTY); errors of files and streams as rows."""
    found = property_streams_at(df, keys, path)
    parsed = parse_properties(found.where("stream is not null"), [*keys, "stream"], "data")
    nothing = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in PROPERTY.split(", ")[:-1]]
    return parsed.unionByName(found.where("stream is null").select(*keys, "stream", *nothing, "error"))
