"""How files, logs and selections are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# What stands for an empty log, a user's folder and an unknown size.
NO_OUTPUT, USER_FOLDER, NO_SIZE = "(無輸出)", "[使用者路徑]", "未知大小"


def log_text(c: Column) -> Column:
    """A log with its written-out line ends and tabs as such, without users' folders, trimmed."""
    lines = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\r\\n|\\n|\r\n|\r", "\n")
    plain = F.regexp_replace(F.replace(lines, F.lit("\\t"), F.lit("\t")), r'C:\\Users\\[^\\\s"]+', USER_FOLDER)
    return F.when(strip(plain) != "", strip(plain)).otherwise(NO_OUTPUT)


def display_path(c: Column) -> Column:
    """A path from its data folder on, with forward slashes."""
    plain = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))
    at = F.locate("/data/", plain)
    return F.when(at > 0, F.substring(plain, at + 1, F.length(plain))).otherwise(plain)


def built_name(path: Column) -> Column:
    """The scope that an index folder or a merged file is named after."""
    last = F.regexp_extract(F.replace(strip(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    return F.regexp_replace(last, r"(?i)\.jsonl$", "")


def span_text(a: Column, b: Column) -> Column:
    """Two ordinals as a span, the smaller first; empty if one is missing."""
    return F.coalesce(F.concat(F.least(a, b).cast("string"), F.lit("-"), F.greatest(a, b).cast("string")), F.when(a.isNull() | b.isNull(), ""))


def pick_text(ordinals: Column) -> Column:
    """Ordinals as a pick, ascending."""
    return F.array_join(F.array_sort(ordinals).cast("array<string>"), ",")


def size_text(c: Column) -> Column:
    kb, mb = c / 1024, c / (1024 * 1024)
    return F.when(c.isNull(), NO_SIZE).when(c < 1024, F.concat(c.cast("string"), F.lit(" bytes"))).when(c < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def file_key(path: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws("::", path, size.cast("string"), modified.cast("string"))


def with_new_files(chosen: DataFrame, incoming: DataFrame) -> DataFrame:
    """chosen and those of incoming that it does not hold, each once; both: (path, size, modified)."""
    key = [F.col(c) for c in ("path", "size", "modified")]
    fresh = incoming.select(*key).distinct().join(chosen.select(*key), ["path", "size", "modified"], "left_anti")
    return chosen.select(*key).distinct().unionByName(fresh)
