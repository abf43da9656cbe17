"""Settings and owner's dates, checked on the driver before any job starts (SRC-11, SRC-12, FLT-06, DAT-17, STR-12, RUN-01)."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConfigError(ValueError):
    """Settings that are refused rather than guessed at."""


#: A setting: a key, and a value in a pair of quotes or bare, without the space around it.
SETTING = re.compile(r"""\s*(?P<key>[^#=\s][^=]*?)\s*=\s*(?:"(?P<double>.*)"|'(?P<single>.*)'|(?P<bare>.*?))\s*""")


def read_env(paths: list[str], process: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of the first file that exists, the last of a key; the process's own variables win. Other lines say nothing."""
    there = [p for p in map(Path, paths) if p.is_file()]
    lines = there[0].read_text(encoding="utf-8").splitlines() if there else []
    found = {m["key"]: next(m[g] for g in ("double", "single", "bare") if m[g] is not None) for m in map(SETTING.fullmatch, lines) if m}
    return {**found, **(os.environ if process is None else process)}


def refuse_inside(target: str, source: str) -> None:
    """Refuse a target that is the source's root or lies below it."""
    t, s = Path(target).resolve(), Path(source).resolve()
    if t == s or s in t.parents:
        raise ConfigError(f"{t} is inside the source {s}")


def parse_owner_date(text: object) -> datetime.date:
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()):
        raise ConfigError(f"not a day as yyyy-mm-dd: {text!r}")
    try:
        day = datetime.date.fromisoformat(text.strip())
    except ValueError as e:
        raise ConfigError(f"no such day: {text!r}") from e
    if day.year < 1826 or day > datetime.date.today():
        raise ConfigError(f"no photograph is from {day}")
    return day


def read_album_dates(path: str) -> dict[str, datetime.date]:
    """The owner's dates by album, lower-cased and stripped; anything malformed is refused."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    albums = data.get("album dates", data.get("album_dates")) if isinstance(data, dict) else None
    if not isinstance(albums, dict):
        raise ConfigError(f"{path} has no album dates")
    out: dict[str, datetime.date] = {}
    for album, day in albums.items():
        key = album.strip().lower()
        if key in out:
            raise ConfigError(f"{album!r} stands twice")
        out[key] = parse_owner_date(day)
    return out


def album_dates_frame(spark: SparkSession, dates: Mapping[str, datetime.date]) -> DataFrame:
    return spark.createDataFrame(sorted(dates.items()), "album_key string, owner_date date")


def with_owner_date(entries: DataFrame, dates: DataFrame, album: str = "album") -> DataFrame:
    """Adds owner_date, by the album that an entry is filed under, whatever its case; Root is no album."""
    key = F.nullif(F.lower(F.trim(F.col(album))), F.lit("root"))
    return entries.withColumn("_key", key).join(dates.withColumnRenamed("album_key", "_key"), "_key", "left").drop("_key")


def parse_overrides(text: str) -> dict[str, str]:
    """A JSON object of album pattern to zone, in its order; all texts, nothing else."""
    try:
        value = json.loads(text) if text.strip() else {}
    except ValueError as e:
        raise ConfigError(f"not JSON: {text!r}") from e
    if not isinstance(value, dict) or not all(isinstance(v, str) and k.strip() and v.strip() for k, v in value.items()):
        raise ConfigError(f"not an object of pattern to zone: {text!r}")
    return {k.strip().lower(): v.strip() for k, v in value.items()}


def default_zone(explicit: str | None, configured: str | None, machine: str | None) -> str:
    """The first zone that somebody names; without one the run is refused."""
    for zone in (explicit, configured, machine):
        if zone and zone.strip():
            return zone.strip()
    raise ConfigError("no time zone is known: name one, as Europe/London")


def stop_requested(marker: str, since: float) -> bool:
    """Whether a stop marker was left since the run began."""
    try:
        return os.stat(marker).st_mtime >= since
    except OSError:
        return False


def dump_album_dates(dates: Mapping[str, datetime.date]) -> str:
    return json.dumps({"album dates": {k: dates[k].isoformat() for k in sorted(dates)}}, indent=2)


def parse_name_list(text: str) -> list[str]:
    """A JSON list of texts, and of nothing else."""
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not JSON: {text!r}") from e
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"not a list of texts: {text!r}")
    return value


def run_key(specs: list[str], template: str, scheme: str, pattern: str | None, extras: list[str]) -> str:
    """The name of a run's state: what another run must share to resume it."""
    key = {"specs": sorted(specs), "template": template, "folder": f"custom:{pattern}" if pattern else scheme, "extras": sorted(extras)}
    return hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:32]
