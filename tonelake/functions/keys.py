"""Keys that live in file names: base name, episode, source, speed, chunk number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last part of a path with either kind of slash."""
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def source_key(name: Column, rule: str = "name") -> Column:
    """The first two parts of a name; with ``rule='prefix'`` the whole episode prefix."""
    if rule == "prefix":
        return episode_prefix(name)
    parts = F.split(stem(name), "_")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(stem(name))


def episode_prefix(name: Column) -> Column:
    """A name without its four-digit chunk number; null if it has none."""
    found = F.regexp_extract(stem(name), r"^(.+)_(\d{4})$", 1)
    return F.when(found != "", found)


def chunk_index(name: Column) -> Column:
    found = F.regexp_extract(stem(name), r"^(.+)_(\d{4})$", 2)
    return F.when(found != "", found.cast("int"))


def wpm_bucket(name: Column) -> Column:
    """The second part of a source key, else ``unknown``."""
    return F.coalesce(F.try_element_at(F.split(source_key(name), "_"), F.lit(2)), F.lit("unknown"))


def wpm_from_name(name: Column, default: float = 20.0) -> Column:
    found = F.regexp_extract(name, r"(\d+)wpm", 1)
    return F.when(found == "", F.lit(default)).otherwise(found.cast("double"))
