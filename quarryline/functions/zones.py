"""Offsets of zone-free local times (DAT-07..10)."""

from __future__ import annotations

from collections.abc import Iterable
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard and daylight hours from UTC where no zone data is at hand, and other names of the zones.
US_HOURS = {"america/new_york": (-5, -4), "america/chicago": (-6, -5), "america/denver": (-7, -6), "america/phoenix": (-7, -7), "america/los_angeles": (-8, -7), "america/anchorage": (-9, -8), "pacific/honolulu": (-10, -10)}
ALIASES = {"eastern": "america/new_york", "us/eastern": "america/new_york", "central": "america/chicago", "us/central": "america/chicago", "mountain": "america/denver", "us/mountain": "america/denver", "arizona": "america/phoenix", "pacific": "america/los_angeles", "us/pacific": "america/los_angeles", "alaska": "america/anchorage", "us/alaska": "america/anchorage", "hawaii": "pacific/honolulu", "us/hawaii": "pacific/honolulu"}


class ZoneError(ValueError):
    """A zone that nobody knows."""


def resolve_zone(name: str) -> str:
    """The zone's own name, whatever its case, spaces or alias; refused on the driver if unknown."""
    key = name.strip().lower().replace(" ", "_")
    zones = {z.lower(): z for z in available_timezones()}
    # A real zone's name goes before an alias of the same spelling.
    found = zones.get(key) or zones.get(ALIASES.get(key, ""))
    if not found:
        raise ZoneError(f"unknown time zone {name!r}")
    return found


def resolve_zones(names: Iterable[str]) -> dict[str, str]:
    return {n: resolve_zone(n) for n in set(names)}


def offset_minutes(local: Column, zone: Column) -> Column:
    """Minutes that the zone is ahead of UTC at a local time; the session zone must be UTC."""
    stamp = local.cast("timestamp")
    return F.timestamp_diff("MINUTE", F.to_utc_timestamp(stamp, zone), stamp).cast("int")


def format_offset(minutes: Column) -> Column:
    size = F.abs(minutes)
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), two(size / 60), F.lit(":"), two(size % 60))


def is_us_summer(local: Column) -> Column:
    """Daylight saving time in the United States, by the rules of 1987 and of 2007."""
    y = F.year(local)
    at = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    sunday = lambda d: F.next_day(F.date_sub(d, 1), "SUN")  # noqa: E731  on or after
    begin = F.when(y < 2007, sunday(at(4, 1))).otherwise(F.date_add(sunday(at(3, 1)), 7))
    end = F.when(y < 2007, sunday(at(10, 25))).otherwise(sunday(at(11, 1)))
    two = lambda d: F.timestamp_add("HOUR", F.lit(2), d.cast("timestamp_ntz"))
    return (local >= two(begin)) & (local < two(end))


def us_offset_hours(local: Column, zone_key: Column) -> Column:
    """Hours from UTC by US_HOURS; null for other zones."""
    out = F.lit(None).cast("int")
    for key, (plain, summer) in US_HOURS.items():
        out = F.when(zone_key == key, F.when(is_us_summer(local), summer).otherwise(plain)).otherwise(out)
    return out
