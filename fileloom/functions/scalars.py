"""Sizes, hashes, times and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .paths import text


def _size(size: Column | str, units: list[str], decimals: int, whole_bytes: bool) -> Column:
    n = F.coalesce(text(size), F.lit(0)).cast("double")
    out = F.when(n == 0, "0 B")
    for k, unit in enumerate(units):
        value = n / 1024.0**k
        form = "%.0f " + unit if whole_bytes and k == 0 else f"%.{decimals}f {unit}"
        shown = F.format_string(form, F.bround(value, decimals))
        out = out.otherwise(shown) if k == len(units) - 1 else out.when(value < 1024, shown)
    return out


def human_size(size: Column | str) -> Column:
    """Two decimals, to TB."""
    return _size(size, ["B", "KB", "MB", "GB", "TB"], 2, False)


def human_size_whole(size: Column | str) -> Column:
    """Whole bytes, else two decimals, to EB."""
    return _size(size, ["B", "KB", "MB", "GB", "TB", "PB", "EB"], 2, True)


def human_size_short(size: Column | str, top: str = "TB") -> Column:
    """One decimal."""
    units = ["B", "KB", "MB", "GB", "TB"]
    return _size(size, units[: units.index(top) + 1], 1, False)


def megabytes(size: Column | str) -> Column:
    return F.bround(text(size) / (1024 * 1024), 1)


def gigabytes(size: Column | str) -> Column:
    return F.bround(text(size) / 1e9, 1)


def fingerprint(content: Column | str) -> Column:
    """SHA-256 of the size and of a quarter megabyte at the start, middle and end."""
    c, n = text(content), F.octet_length(text(content))
    part = fixed.SAMPLE_BYTES
    middle = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - part // 2)
    return F.sha2(F.concat(n.cast("string").cast("binary"), F.substr(c, F.lit(1), F.lit(part)), F.substr(c, middle + 1, F.lit(part)), F.substr(c, F.greatest(F.lit(1), n - part + 1), F.lit(part))), 256)


def smart_hash(content: Column | str, limit: int = fixed.SMALL_FILE) -> Column:
    return F.when(F.octet_length(text(content)) < limit, F.sha2(text(content), 256)).otherwise(fingerprint(content))


def group_signature(key: Column, paths: Column) -> Column:
    return F.md5(F.concat(key, F.array_join(F.array_sort(paths), "|")))


def clock(seconds: Column | str, millis: bool = False) -> Column:
    """HH:MM:SS or HH:MM:SS.mmm."""
    s = text(seconds).cast("double")
    h, m = F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int")
    if millis:
        total = F.floor(s * 1000).cast("long")
        return F.format_string("%02d:%02d:%02d.%03d", h, m, F.floor(s % 60).cast("int"), (total % 1000).cast("int"))
    return F.format_string("%02d:%02d:%02d", h, m, F.floor(s % 60).cast("int"))


def clock_label(seconds: Column | str) -> Column:
    s = text(seconds).cast("double")
    return F.format_string("%02dh%02dm%02ds", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"), F.floor(s % 60).cast("int"))


def epoch(iso: Column | str) -> Column:
    """Seconds of an ISO time, 0 where it is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text(iso))) / 1e6, F.lit(0.0))


def clip_text(c: Column | str, whole: int = 250_000, head: int = 200_000, tail: int = 50_000, mark: str = "\n...\n") -> Column:
    t = text(c)
    return F.when(F.octet_length(t) <= whole, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(mark), F.right(t, F.lit(tail))))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(text(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(text(a), text(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    n = norm(v)
    return F.transform(text(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def strip_fences(c: Column | str) -> Column:
    """A model's JSON answer without its code fences."""
    return F.btrim(F.regexp_replace(F.btrim(text(c)), r"(?s)^```(?:json)?\s*|\s*```$", ""))


def is_rate_limit(c: Column | str) -> Column:
    return F.lower(text(c)).rlike("|".join(fixed.RATE_LIMIT_SIGNS))
