"""Name normalisation and templates, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import fixed
from .paths import basename, dirname, extension, sanitised_name, stem, text


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def export_name(name: Column | str) -> Column:
    """A name as it was before export: no revision stamp, pin mark, (N) or cut end; lower case."""

    def unmarked(low: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(low, "-pinned|-pin", ""), fixed.REVISION_STUB, "")
        return F.when(low.rlike(fixed.REVISION_TAIL), F.concat(F.regexp_replace(low, fixed.REVISION_TAIL, ""), F.regexp_extract(low, fixed.REVISION_TAIL, 1))).otherwise(bare)

    def split(s: Column) -> Column:
        def cut(ext: Column) -> Column:
            kept = F.when(ext.rlike(r"^\.\d+$") | (F.length(ext) > 8), "").otherwise(ext)
            body = F.substr(s, F.lit(1), F.length(s) - F.length(kept))
            body = F.btrim(F.regexp_replace(F.regexp_replace(body, r"\(\d+\)", ""), r"\s+", " "))
            return F.concat(F.btrim(F.regexp_replace(body, "[-_ ]+$", "")), kept)

        return let(extension(s), cut)

    return let(F.lower(text(name)), lambda low: let(unmarked(low), split))


def export_path(rel: Column | str) -> Column:
    """export_name of the base; the folder in lower case."""
    folder = F.lower(dirname(rel))
    return F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), export_name(basename(rel)))


def folder_name(name: Column | str) -> Column:
    s = F.regexp_replace(F.lower(text(name)), r"\(\d+\)\s*$", "")
    s = F.btrim(F.regexp_replace(s, r"\s+", " "))
    return F.btrim(F.regexp_replace(s, r"[_\-. ]+$", ""))


def date_key(name: Column | str) -> Column:
    """Leading date with dots, null without one."""
    return F.nullif(F.translate(F.regexp_extract(text(name), fixed.LEADING_DATE, 1), "-_", ".."), F.lit(""))


def title_after_date(name: Column | str) -> Column:
    s = F.regexp_replace(folder_name(name), r"^\s*\d{2,4}[.\-_]\d{1,2}[.\-_]\d{1,2}[\s.\-_]*", "")
    return F.btrim(F.regexp_replace(s, f"^(?:{fixed.LEAD_INS})+", ""))


def anchor(name: Column | str) -> Column:
    """What sibling folders of one subject share."""
    d = date_key(name)
    return F.when(d.isNotNull(), F.concat(F.lit("d:"), d, F.lit("|"), F.substring(title_after_date(name), 1, 14))).otherwise(F.concat(F.lit("n:"), F.substring(folder_name(name), 1, 24)))


def clean_twin(name: Column | str) -> Column:
    """The name without ' (N)'; null where there is none."""
    pattern = r"^(.*?) \((\d+)\)(\.[^.]+)?$"
    return F.when(text(name).rlike(pattern), F.concat(F.regexp_extract(text(name), pattern, 1), F.regexp_extract(text(name), pattern, 3)))


def unpinned(name: Column | str) -> Column:
    """The name without its revision stamp and pin mark; unchanged if nothing would be left."""
    s = F.regexp_replace(F.regexp_replace(stem(name), fixed.PINNED_STAMP, ""), fixed.PINNED_END, "")
    return F.when(s == "", text(name)).otherwise(F.concat(s, extension(name)))


def correct_name(local: Column | str, remote: Column | str) -> Column:
    """The remote's name made safe, with the local extension where it has none or another; null
    where there is no name to take."""
    safe = F.btrim(F.translate(text(remote), '<>:"/\\|?*', "_________"))
    mine, theirs = extension(local), extension(safe)
    out = F.when(mine == "", safe).when(F.lower(theirs) == F.lower(mine), safe).otherwise(F.concat(stem(safe), mine))
    return F.when(~safe.isin("", ".", ".."), out)


def title_case(c: Column) -> Column:
    """Every letter after a non-letter upper, the others lower."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def _fields(name: Column, values: dict[str, Column], separator: str, spaces: str) -> dict:
    """What a template may name, each as an expression of the file's name and the values at hand."""
    given = lambda key, default: F.coalesce(values[key], default) if key in values else default
    tags = values.get("tags", F.array().cast("array<string>"))
    kind = values.get("mime", F.lit(None).cast("string"))
    return {
        "date": lambda: values.get("date", F.lit("")),
        "category": lambda: given("category", F.lit("unknown")),
        "description": lambda: sanitised_name(F.substring(given("description", F.lit("")), 1, 50), spaces),
        "suggested_name": lambda: sanitised_name(given("suggested_name", stem(name)), spaces),
        "tags": lambda: sanitised_name(F.array_join(F.slice(tags, 1, 3), separator), spaces),
        "ext": lambda: F.ltrim(F.lower(extension(name)), F.lit(".")),
        "original": lambda: stem(name),
        "mime": lambda: F.when(kind.contains("/"), F.substring_index(kind, "/", 1)).otherwise("unknown"),
        "hash": lambda: F.substring(given("hash", F.lit("00000000")), 1, 8),
        "counter": lambda: F.lit("001"),
    }


def template_parts(template: str, known: set[str]) -> list[tuple[str, str]]:
    """A template as ('text' or 'field', value) in order; braces around anything unknown are text."""
    found: list[tuple[str, str]] = []
    for k, piece in enumerate(re.split(r"\{(" + "|".join(sorted(known)) + r")\}", template)):
        if piece:
            found.append(("field" if k % 2 else "text", piece))
    return found


def template_elements(template: Column | str, separator: Column | str) -> Column:
    """A name template as its builder shows it: an array of (kind, value), kind token, sep (a text
    that is the separator) or literal. What follows .{ext} isn't part of it, as names get their
    extension anyway. Null for a null template."""
    body = F.substring_index(F.col(template) if isinstance(template, str) else template, ".{ext}", 1)
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)(\{[a-z_]+\}|(?:(?!\{[a-z_]+\}).)+)"), F.lit(1))
    sep = F.col(separator) if isinstance(separator, str) else separator
    kind = lambda p: F.when(p.rlike(r"\A\{[a-z_]+\}\z"), "token").when(p.eqNullSafe(sep), "sep").otherwise("literal")
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("kind"), p.alias("value")))


def compiled_template(elements: Column | str, separator: Column | str) -> Column:
    """The template of (kind, value) elements, with a separator of its own, and .{ext} at its end."""
    sep = F.col(separator) if isinstance(separator, str) else separator
    parts = F.transform(F.col(elements) if isinstance(elements, str) else elements, lambda e: F.when(e["kind"] == "sep", sep).otherwise(F.coalesce(e["value"], F.lit(""))))
    return F.concat(F.array_join(parts, ""), F.lit(".{ext}"))


_CASES = {"lower": F.lower, "upper": F.upper, "title": title_case}


def templated(
    name: Column, template: str, values: dict[str, Column], separator: str = "_", case: str = "lower", max_length: int = 255, spaces: str = "_"
) -> Column:
    """A new name from a template of {date} {category} {description} {suggested_name} {tags} {ext}
    {original} {mime} {hash} {counter}; missing values take their defaults. The name keeps its
    extension: where the template doesn't place it, it is added, and a cut name ends in it."""
    fields = _fields(name, values, separator, spaces)
    parts = template_parts(template, set(fields))
    joined = F.concat(*(fields[v]() if kind == "field" else F.lit(v) for kind, v in parts)) if parts else F.lit("")

    def normal(made: Column) -> Column:
        spaced = F.replace(_CASES.get(case, lambda c: c)(made), F.lit(" "), F.lit(spaces))
        single = F.regexp_replace(spaced, f"(?:{re.escape(separator)}){{2,}}", separator) if separator else spaced
        return F.btrim(single, F.lit(separator + " ._-"))

    def ended(made: Column) -> Column:
        ext = F.lower(extension(name))
        whole = made if ("field", "ext") in parts else F.concat(made, F.when(F.endswith(made, ext), F.lit("")).otherwise(ext))
        return let(whole, lambda w: F.when(F.length(w) <= max_length, w).otherwise(F.concat(F.substr(w, F.lit(1), F.lit(max_length - 1) - F.length(ext)), ext)))

    return let(normal(joined), ended)
