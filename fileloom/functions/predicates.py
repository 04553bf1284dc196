"""Predicates and classes of paths and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .paths import basename, contains_any, extension, segments, slashes, stem, text


def is_junk(path: Column | str) -> Column:
    """Operating-system, sidecar and partial-download files."""
    name = basename(path)
    return name.startswith("._") | F.lower(name).isin(fixed.JUNK_NAMES) | extension(F.lower(name)).isin(fixed.JUNK_EXTENSIONS)


def junk_kind(path: Column | str) -> Column:
    name = basename(path)
    low = F.lower(name)
    return (
        F.when(name.startswith("._"), "appledouble")
        .when(low == ".ds_store", "ds_store")
        .when(low == "thumbs.db", "thumbs")
        .when(low == "desktop.ini", "desktop_ini")
        .when(extension(low).isin(fixed.JUNK_EXTENSIONS), "temp")
        .otherwise("other")
    )


def is_resolver_junk(path: Column | str) -> Column:
    return F.lower(basename(path)).isin(fixed.RESOLVER_JUNK_NAMES)


def file_type(path: Column | str) -> Column:
    low = F.lower(basename(path))
    ext = extension(low)
    return F.when(low.isin(fixed.TRIVIAL_NAMES) | ext.isin(fixed.TRIVIAL_EXTENSIONS), "trivial").when(ext.isin(fixed.MEDIA_EXTENSIONS), "media").when(ext.isin(fixed.BUSINESS_EXTENSIONS), "business").otherwise("other")


def is_transferred(path: Column | str, people: list[str] = ()) -> Column:
    found = text(path).rlike(fixed.TRANSFER_SEGMENT)
    for p in people:
        if p:
            found = found | F.lower(text(path)).contains(p.lower())
    return found


def route(path: Column | str, kind: Column, signals: list[str], use_cjk: bool) -> Column:
    china = contains_any(path, signals)
    if use_cjk:
        china = china | text(path).rlike(fixed.CJK)
    return F.when(kind == "media", "cpms").when((kind == "business") & china, "sharepoint_china").when(kind == "business", "sharepoint_us").otherwise("unrouted")


def clean_score(name: Column | str) -> Column:
    """10 for ' (N)' before the extension, 5 for a revision stamp; 0 is cleanest."""
    return F.when(text(name).rlike(fixed.PAREN_COPY), 10).otherwise(0) + F.when(text(name).rlike(fixed.REVISION_MARK), 5).otherwise(0)


def is_structural(path: Column | str) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, fixed.STRUCTURAL_SEGMENTS))) | text(path).rlike(fixed.STRUCTURAL_SUFFIX)


def is_clutter(name: Column | str) -> Column:
    low = F.lower(text(name))
    inner = F.when(F.regexp_replace(low, r"\.json$", "").contains("."), F.substring_index(F.regexp_replace(low, r"\.json$", ""), ".", -1))
    return low.isin([*fixed.CLUTTER_NAMES, "shared drive metadata.json"]) | low.endswith("-info.json") | low.endswith("-i.json") | (low.endswith(".json") & F.coalesce(inner.isin(fixed.SIDECAR_INNER), F.lit(False)))


def is_sidecar_name(name: Column | str) -> Column:
    low = F.lower(text(name))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"\.json$", ""), r"-(?:info|inf|in|i)?(?:\(\d+\))?$", ""), r"\(\d+\)$", "")
    inner = F.when(bare.contains("."), F.substring_index(bare, ".", -1))
    return low.isin([*fixed.CLUTTER_NAMES, "shared drive metadata.json"]) | low.endswith("-comments.html") | (low.endswith(".json") & F.coalesce(inner.isin(fixed.SIDECAR_INNER), F.lit(False))) | low.rlike(fixed.SIDECAR_TAIL)


def html_class(html: Column | str, name: Column | str) -> Column:
    """shortcut, comments or keep, from the first 1500 characters."""
    head = F.lower(F.substring(text(html), 1, 1500))
    marks = head.contains(fixed.BOOKMARK_MARKS[0]) & head.contains(fixed.BOOKMARK_MARKS[1])
    comments = F.lower(text(name)).endswith("-comments.html") & (head.contains("comment") | head.contains("drive.google.com"))
    return F.when(marks, "shortcut").when(comments, "comments").otherwise("keep")


def is_ill_named(name: Column | str) -> Column:
    s = F.btrim(stem(name))
    return (s == "") | s.rlike(fixed.ILL_NAMED)


def is_generic(name: Column | str) -> Column:
    return text(name).rlike(fixed.GENERIC_NAME)


def looks_truncated(name: Column | str) -> Column:
    n = F.rtrim(text(name))
    last = F.regexp_extract(n, r"(\S+)$", 1)
    short = F.length(last).between(2, 6) & last.rlike(r"^\p{L}") & ~n.rlike(r"[.)\]]$")
    return n.rlike("[_-]$") | (F.length(text(name)) >= 60) | short


def is_pinned(path: Column | str) -> Column:
    """A pinned artefact of an export."""
    return basename(path).rlike(fixed.PINNED_NAME)


def has_revision(name: Column | str) -> Column:
    s = stem(F.lower(text(name)))
    return s.rlike(fixed.REVISION_TAIL) | s.rlike(fixed.REVISION_STUB)


def type_group(path: Column | str) -> Column:
    ext = F.lower(extension(basename(path)))
    out = None
    for group, exts in fixed.TYPE_GROUPS.items():
        out = F.when(ext.isin(exts), group) if out is None else out.when(ext.isin(exts), group)
    return out.otherwise("default")


def keyword(path: Column | str, words: list[str], whole_word: bool = False) -> Column:
    """The first keyword that the name holds, else null."""
    import re

    name, out = basename(slashes(path)), None
    for w in words:
        hit = name.rlike(rf"(?iU)\b{re.escape(w)}\b") if whole_word else F.lower(name).contains(w.lower())
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return out if out is not None else F.lit(None).cast("string")


def risk_threshold(action: Column | str) -> Column:
    out = None
    for name, t in fixed.RISK_THRESHOLDS.items():
        out = F.when(text(action) == name, t) if out is None else out.when(text(action) == name, t)
    return out.otherwise(0.90)


def auto_approved(is_change: Column, confidence: Column, action: Column | str) -> Column:
    return is_change & (confidence >= risk_threshold(action))


def mime_type(name: Column | str) -> Column:
    """The media type that a name's extension stands for; unknown ones are octet streams."""
    ext = F.lower(extension(basename(name)))
    known = F.create_map(*(F.lit(x) for pair in fixed.MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream"))
