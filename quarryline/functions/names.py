"""File and folder names (FLT-01..04, STR-01..13, WIN-05): column expressions only."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names that say nothing about what is in them.
PLAIN_ALBUMS = ["", "root", "newzip", "new zip", "stuff", "misc", "miscellaneous", "untitled", "unsorted", "new folder", "images", "image", "photos", "pictures", "temp", "tmp", "output", "scans"]
# Names that some systems keep for devices.
DEVICES = ["con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10))]
# Names that cameras give, the suffix, characters that names can't have.
CAMERA = r"(?i)^(?:dcp|dc|p)[\s_-]?\d+$"
SUFFIX = r"(?i)\.fpx$"
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


class TemplateError(ValueError):
    """A name or folder template that is refused."""


def stem(name: Column) -> Column:
    """The name without its suffix, which goes once."""
    return F.regexp_replace(name, SUFFIX, "")


def is_camera_name(name: Column) -> Column:
    return stem(name).rlike(CAMERA)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def album(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def tree(path: Column) -> Column:
    return F.regexp_extract(path, r"^([^/]*)/", 1)


def is_descriptive(name: Column, more: Iterable[str] = ()) -> Column:
    """Whether an album's name says something; a number does only if it may be a year."""
    low = F.lower(F.trim(name))
    number = F.try_to_number(F.when(F.length(low) <= 30, low), F.lit("9" * 30))
    return ~low.isin(PLAIN_ALBUMS + [m.strip().lower() for m in more]) & (~low.rlike("^[0-9]+$") | F.coalesce(number.between(1900, 2100), F.lit(False)))


def sanitise(value: Column) -> Column:
    return F.regexp_replace(value, FORBIDDEN, "-")


def keep_from_devices(name: Column) -> Column:
    head = F.lower(F.split_part(name, F.lit("."), F.lit(1)))
    return F.when(head.isin(DEVICES), F.concat(name, F.lit("_"))).otherwise(name)


def fields_of(template: str) -> list[str]:
    return re.findall(r"\{([^{}]*)\}", template)


def check_template(template: str, fields: Iterable[str], folders: bool = False) -> None:
    """Refuse a template that is empty, has unknown fields, stray braces, or characters that names can't have."""
    known = set(fields)
    if not template.strip():
        raise TemplateError("the template is empty")
    for f in fields_of(template):
        if f not in known:
            raise TemplateError(f"unknown field {{{f}}}; known are {', '.join(sorted(known))}")
    plain = re.sub(r"\{[^{}]*\}", "", template)
    if "{" in plain or "}" in plain:
        raise TemplateError("a brace stands alone")
    bad = sorted(set(re.findall(FORBIDDEN, plain)) - ({"/", "\\"} if folders else set()))
    if bad:
        raise TemplateError(f"characters that names can't have: {' '.join(bad)}")
    if not fields_of(template):
        raise TemplateError("the template has no field, so all names would be one")
    if not folders and template != template.strip(" ."):
        raise TemplateError("a name can't begin or end with a space or a dot")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A name from a template, checked on the driver; values lose the characters that names can't have."""
    check_template(template, values)
    parts = []
    for k, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if piece:
            parts.append(sanitise(F.coalesce(values[piece], F.lit(""))) if k % 2 else F.lit(piece))
    return keep_from_devices(F.concat(*parts))


def render_folder(template: str, values: Mapping[str, Column]) -> Column:
    """A folder from a template of levels; empty levels and dots go, and without any it is 'undated'."""
    check_template(template, values, folders=True)
    levels = []
    for level in re.split(r"[/\\]", template):
        parts = [sanitise(F.coalesce(values[p], F.lit(""))) if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{([^{}]*)\}", level)) if p]
        levels.append(F.rtrim(F.trim(F.concat(*parts)) if parts else F.lit("")))
    kept = F.filter(F.array(*levels), lambda x: ~x.isin("", ".", ".."))
    return F.when(F.size(kept) == 0, "undated").otherwise(F.array_join(F.transform(kept, keep_from_devices), "/"))


def month_name(month: Column) -> Column:
    names = "January February March April May June July August September October November December".split()
    return F.get(F.array(*map(F.lit, names)), month - 1)


def output_folder(scheme: str, album_name: Column, descriptive: Column, album_dated: Column, year: Column, month: Column) -> Column:
    """The folder of an output under one of the schemes flat, year, year-month and album."""
    y = F.lpad(year.cast("string"), 4, "0")
    monthly = F.when(year.isNull(), "undated").when(month.isNull(), y).otherwise(F.concat(y, F.lit("/"), y, F.lit(" "), month_name(month)))
    if scheme == "flat":
        return F.lit(".")
    if scheme == "year":
        return F.coalesce(y, F.lit("undated"))
    if scheme == "year-month":
        return monthly
    if scheme == "album":
        clean = sanitise(album_name)
        return F.when(descriptive & album_dated & year.isNotNull(), F.concat(y, F.lit("/"), clean)).when(descriptive, clean).otherwise(monthly)
    raise TemplateError(f"unknown scheme {scheme}")


def stem_scope(scheme: str, album_name: Column, descriptive: Column) -> Column:
    return F.when(descriptive, F.lower(album_name)).otherwise("") if scheme == "album" else F.lit("")


def over_budget(path: Column, limit: int, reserve: int = 13) -> Column:
    """Whether a path leaves too little room under a limit; 0 is no limit."""
    return F.length(path) > limit - reserve if limit else F.lit(False)


def human_bytes(n: Column) -> Column:
    value, out = n.cast("double"), None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        # Half to even first: the format alone rounds half up.
        text = F.concat(F.format_string("%.0f" if k == 0 else "%.1f", F.bround(value / 1024**k, min(k, 1))), F.lit(f" {unit}"))
        out = text if out is None else F.when(value >= 1024**k, text).otherwise(out)
    return out


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
