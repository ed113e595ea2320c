"""Column expressions over paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions that count as images, as videos, and as videos of the organizer.
IMAGES = ["bmp", "gif", "heic", "heif", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
VIDEOS = ["3gp", "avi", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "webm", "wmv"]
LIBRARY = ["mkv", "mp4", "avi", "mov", "m4v", "wmv", "ts", "webm"]
SPACE = r"[\s\x1c-\x1f]"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def split_extension(path: Column) -> Column:
    """With its dot, lower-case: from the last dot that follows something other than a dot; else empty."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)[^.].*?(\.[^.]*)$", 1))


def suffix(path: Column) -> Column:
    """With its dot, lower-case: from the last dot, if that is neither the first nor the last character; else empty."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+?(\.[^.]+)$", 1))


def kind(extension: Column) -> Column:
    return F.when(extension.isin(["." + x for x in IMAGES]), "image").when(extension.isin(["." + x for x in VIDEOS]), "video").otherwise("other")


def strip(text: Column) -> Column:
    """Without white space at either end, as Unicode knows it."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def safe_title(title: Column) -> Column:
    cleaned = strip(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|]', ""), rf"(?U){SPACE}+", " "))
    return F.when(cleaned == "", "Unknown").otherwise(cleaned)


def mirrored(path: Column, folder: str) -> Column:
    """The absolute path below another folder; a drive letter becomes a part of it."""
    local = F.regexp_replace(F.regexp_replace(path, r"^([A-Za-z]):[\\/]*", "drive_$1/"), "^/+", "")
    return F.concat(F.lit(folder.rstrip("/") + "/"), local)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once each: a generator keeps later expressions from repeating their code."""
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return rows.select(*[c for c in rows.columns if c not in columns], made)
