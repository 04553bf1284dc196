"""Path expressions. A path may use either slash; results use '/'."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slashes(c: Column | str) -> Column:
    return F.translate(text(c), "\\", "/")


def normalised(c: Column | str) -> Column:
    """Slashes one way, none at the end, lower case."""
    return F.lower(F.rtrim(slashes(c), F.lit("/")))


def basename(c: Column | str) -> Column:
    return F.substring_index(slashes(c), "/", -1)


def dirname(c: Column | str) -> Column:
    """What comes before the last slash; empty without one."""
    return F.when(slashes(c).contains("/"), F.regexp_replace(slashes(c), "/[^/]*$", "")).otherwise("")


def extension(name: Column | str) -> Column:
    """From the last dot on, dot included; leading dots begin no extension."""
    return F.regexp_extract(text(name), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def stem(name: Column | str) -> Column:
    return F.substr(text(name), F.lit(1), F.length(text(name)) - F.length(extension(name)))


def segments(c: Column | str) -> Column:
    """Lower-case path segments, none empty."""
    return F.filter(F.split(F.lower(slashes(c)), "/"), lambda s: s != "")


def ancestors(c: Column | str) -> Column:
    """All folders above a path, nearest last: '/a/b/c' gives '/a' and '/a/b'."""
    parts = F.split(slashes(c), "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda p: (p != "") & (p != slashes(c)))


def under(c: Column | str, roots: list[str]) -> Column:
    """The path is one of the roots or lies below one; case and slash direction don't matter."""
    found = F.lit(False)
    for root in roots:
        r = root.replace("\\", "/").lower().rstrip("/")
        if r:
            found = found | (normalised(c) == r) | normalised(c).startswith(r + "/")
    return found


def contains_any(c: Column | str, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        if p:
            found = found | F.lower(slashes(c)).contains(p.lower())
    return found


def sanitised(component: Column | str) -> Column:
    """Reserved characters become '_'; no space or dot at the end; never empty."""
    kept = F.regexp_replace(F.translate(text(component), '<>:"|?*', "_______"), "[ .]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("_"))


def sanitised_path(c: Column | str) -> Column:
    return F.array_join(F.transform(F.split(text(c), "/"), sanitised), "/")


def sanitised_name(name: Column | str, spaces: str = "_") -> Column:
    """Reserved and control characters go, spaces become the given text, outer dots and spaces go."""
    kept = F.replace(F.regexp_replace(text(name), r'[<>:"/\\|?*\x00-\x1f]', ""), F.lit(" "), F.lit(spaces))
    return F.btrim(kept, F.lit(". "))


def short_name(name: Column | str, limit: int = 120) -> Column:
    kept = F.regexp_replace(F.coalesce(text(name), F.lit("")), r'[\\/:*?"<>|]', "")
    return F.substring(F.btrim(F.btrim(kept), F.lit(". ")), 1, limit)


def archive_base(name: Column | str) -> Column:
    """An archive's name without its suffix and part numbers."""
    bare = F.regexp_replace(F.regexp_replace(text(name), fixed.ARCHIVE_END, ""), r"-\d+(-\d+)?$", "")
    return F.regexp_replace(bare, r"(?i)\.part\d+$", "")


def project_root(c: Column | str) -> Column:
    """'previous/segment' for the first structural segment; null without one."""
    parts = segments(c)
    names = F.array(*map(F.lit, fixed.STRUCTURAL_SEGMENTS))
    at = F.array_min(F.filter(F.transform(parts, lambda s, i: F.when(F.array_contains(names, s), i)), lambda i: i.isNotNull()))
    return F.when(at.isNotNull(), F.concat_ws("/", F.get(parts, F.greatest(at - 1, F.lit(0))), F.get(parts, at)))
