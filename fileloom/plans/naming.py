"""Queries on names: normal forms, anchors, sidecars, templates, proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, names, paths, predicates, scalars
from ..operators import renaming
from .tables import FILES_SQL, base, ext, files, listed, table

NAMES = [
    "Report-at-2025-01-02T03_04_05.678Z-pinned.pdf", "Clip-at-2025-01-02T03_04", "Budget  (2).XLSX", "pinboard.doc", "Deck-pinned.pptx", "Long Name_-.txt", "v1.2024", "Notes-at-", "photo (12).png",
    "notes (3)", "IMG_20240101.jpg", "Screenshot 2024.png", "Quarterly Presentations.pptx", "untitled.docx", "Report.pdf.json", "clip.mp4-info.json", "x-in.json", "x-info(1).json", "data.json",
    "Shared Drive Metadata.json", "a-comments.html", ".hidden", "..odd.tar.gz", "takeout-20260713T195045Z-001.zip", "takeout-20260713T204653Z-2-001.zip", "a.part1.zip", "x.tar.gz", "deadbeefdeadbeef01.bin",
    "A<b>:c?.txt", "trailing dot. ", "song.m4a", "raw.CR2", "Foo-bar baz.TXT", "copy of plan.doc", "Final2.ai",
]
FOLDERS = [
    "22.01.21 Live Webinar - Stone Setting Basics", "22-01-21 Webinar - Stone Setting Ba_", "Sales Commission 2025_", "Invoices to pay 2022", "Invoices to pay 2024", "2022_3_4 HPL Live: Webinar Enamel (2)",
    "Diagnosing Problems and Pr", "Quarterly Presentations", "Archive (old)", "Sales_", "  1.2.3  ", "22.01.21", "Webinar", "Folder with a name that is far longer than sixty characters in all", "Plan-",
]


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: Ends of the names that are made from rows.
ENDS = [".txt", " (2).docx", "-at-2025-01-02T03_04_05.678Z.pdf", ".JPG", "", "-pinned.mp4", ".json", "_"]


def _pick(spark, sf, values):
    """Names by turns from the list and made from a few characters somewhere in the whole text."""
    n = len(values)
    k = (F.col("doc_id") % n).cast("int")
    end = F.get(F.array(*map(F.lit, ENDS)), (F.col("doc_id") % len(ENDS)).cast("int"))
    made = F.concat(F.regexp_replace(F.substr("text", (F.col("doc_id") * 7919 % F.greatest(F.length("text") - 3, F.lit(1)) + 1).cast("int"), (F.col("doc_id") % 37 + 4).cast("int")), "[^A-Za-z0-9 .,_-]", ""), end)
    named = F.when(F.floor(F.col("doc_id") / n) % 2 == 0, F.get(F.array(*map(F.lit, values)), k)).otherwise(made)
    return table(spark, sf, "documents").select("doc_id", named.alias("name"))


def q_export(spark, sf):
    n = _pick(spark, sf, NAMES)
    return n.select("doc_id", "name", names.export_name("name").alias("export_name"), predicates.has_revision("name").alias("has_revision"), predicates.is_pinned("name").alias("is_pinned"), names.unpinned("name").alias("unpinned"), names.clean_twin("name").alias("twin"), names.export_path(F.concat(F.lit("A/B/"), F.col("name"))).alias("export_path"))


def q_correct(spark, sf):
    n = _pick(spark, sf, NAMES)
    return n.select("doc_id", names.correct_name("name", F.lit("My: Report.docx")).alias("a"), names.correct_name(F.lit("video.mp4"), "name").alias("b"), names.correct_name("name", F.lit("Plain")).alias("c"))


def q_classes(spark, sf):
    n = _pick(spark, sf, NAMES)
    return n.select("doc_id", "name", predicates.is_clutter("name").alias("clutter"), predicates.is_sidecar_name("name").alias("sidecar"), predicates.is_ill_named("name").alias("ill_named"), predicates.type_group("name").alias("type_group"), predicates.is_generic(paths.stem("name")).alias("generic"))


def q_safe(spark, sf):
    n = _pick(spark, sf, NAMES)
    return n.select("doc_id", paths.extension("name").alias("ext"), paths.stem("name").alias("stem"), paths.sanitised("name").alias("sanitised"), paths.sanitised_name("name").alias("sanitised_name"), paths.short_name("name", 12).alias("short"), paths.archive_base("name").alias("archive_base"), paths.sanitised_path(F.concat(F.lit("a:b/c?/"), F.col("name"))).alias("safe_path"))


def q_folders(spark, sf):
    n = _pick(spark, sf, FOLDERS)
    return n.select("doc_id", "name", names.folder_name("name").alias("folder_name"), names.date_key("name").alias("date_key"), names.title_after_date("name").alias("title"), names.anchor("name").alias("anchor"), predicates.looks_truncated("name").alias("truncated"), renaming.folder_prefix(F.col("name")).alias("prefix"))


CONVENTIONS = {"default": {"template": "{date} {category} {original}"}, "document": {"template": "{original}-{hash}", "case": "upper"}, "image": {"template": "{tags}_{counter}.{ext}", "case": "title", "separator": "-"}}


def q_preview(spark, sf):
    n = _pick(spark, sf, NAMES).withColumn("path", F.concat(F.lit("/in box/"), F.col("name")))
    values = {"date": F.lit("2024-01-02"), "category": F.lit("Work"), "hash": F.md5("name"), "tags": F.array(F.lit("red"), F.lit("Old"), F.lit("x"), F.lit("y"))}
    return renaming.preview(n, CONVENTIONS, values).distinct()


def q_titles(spark, sf):
    f = _pick(spark, sf, FOLDERS).withColumnRenamed("name", "folder").withColumn("title", F.get(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES)).cast("int")))
    proposal, confidence = renaming.from_title(F.col("folder"), F.col("title"))
    return f.select("doc_id", "folder", "title", proposal.alias("proposal"), confidence.alias("confidence"), (F.coalesce(confidence, F.lit(0.0)) < 0.8).alias("needs_review"))


TITLES = ["6th Webinar (Diagnosing Problems and Proper Advice).pptx", "Deck.pdf", "Diagnosing Problems and Processes.docx", "Sales Commission 2025 Overview.docx", "final.key", "Quarterly.txt", "Stone Setting Basics for All.pptx"]


def q_risk(spark, sf):
    action = F.get(F.array(*map(F.lit, ["rename", "move", "delete", "other"])), (F.col("doc_id") % 4).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", action.alias("action"), ((F.col("doc_id") % 21) / 20).alias("confidence"))
    return rows.select("doc_id", "action", predicates.risk_threshold("action").cast("double").alias("threshold"), predicates.auto_approved(F.lit(True), F.col("confidence"), "action").alias("approved"))


def q_sidecars(spark, sf):
    f = files(spark, sf)
    other = f.filter("file_id % 6 = 0").select(F.regexp_replace("path", r"\.txt$", ".json").alias("path"))
    lone = f.filter("file_id % 11 = 0").select(F.regexp_replace("path", "doc-", "meta-").alias("path")).select(F.regexp_replace("path", r"\.txt$", ".json").alias("path"))
    return renaming.sidecars(f.select("path").union(other).union(lone))


def q_html(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id") % 5
    html = F.when(k == 0, F.concat(F.lit("<!DOCTYPE NETSCAPE-Bookmark-file-1><!-- It will be read and overwritten -->"), F.col("html"))).when(k == 1, F.concat(F.lit("<p>Comment thread</p>"), F.col("html"))).otherwise(F.col("html"))
    name = F.when(k < 3, F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("-comments.html"))).otherwise("page.html")
    return p.select("page_id", predicates.html_class(html, name).alias("class"))


def q_keywords(spark, sf):
    f = files(spark, sf).select("file_id", "path")
    return f.select("file_id", predicates.keyword("path", ["pinned", "doc-1", "(2)"]).alias("first_keyword"), predicates.keyword("path", ["pinned", "txt"], True).alias("whole_word"))


def q_times(spark, sf):
    s = (F.col("doc_id") * 97.25) % 20000
    return table(spark, sf, "documents").select("doc_id", scalars.clock(s).alias("clock"), scalars.clock(s, True).alias("millis"), scalars.clock_label(s).alias("label"))


def q_hashes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return d.select("doc_id", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), scalars.smart_hash("content", 2000).alias("smart"))


def q_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(scalars.clip_text("text", 3000, 2000, 500)).alias("clipped_md5"))


def q_misc(spark, sf):
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.lit('```json\n{"a": 1}\n```')).when(k == 1, F.lit("Error 429: slow down")).when(k == 2, F.lit(' {"b": 2} ')).otherwise("fine")
    iso = F.when(k == 0, F.lit("2024-03-01T10:20:30")).when(k == 1, F.lit("never")).otherwise(F.lit("2024-03-01"))
    return table(spark, sf, "documents").select("doc_id", scalars.strip_fences(said).alias("json"), scalars.is_rate_limit(said).alias("busy"), scalars.epoch(iso).alias("epoch"), scalars.megabytes(F.col("n_chars") * 4096).cast("double").alias("mb"), scalars.gigabytes(F.col("n_chars") * 50000000).cast("double").alias("gb"))


QUERIES = {
    "fn16_export_names": q_export,
    "fn24_correct_names": q_correct,
    "prj12_name_classes": q_classes,
    "fn12_safe_names": q_safe,
    "fn21_folder_anchors": q_folders,
    "fn33_rename_preview": q_preview,
    "fn37_folder_titles": q_titles,
    "prj24_risk": q_risk,
    "jn30_sidecars": q_sidecars,
    "prj14_html_classes": q_html,
    "prj20_keywords": q_keywords,
    "fn42_clocks": q_times,
    "fn03_hashes": q_hashes,
    "src15_clipped_text": q_text,
    "fn54_answers": q_misc,
}


def _name(values: list[str]) -> str:
    made = f"regexp_replace(substr(text, doc_id * 7919 % greatest(length(text) - 3, 1) + 1, (doc_id % 37)::int + 4), '[^A-Za-z0-9 .,_-]', '', 'g') || ({_listed(ENDS)})[(doc_id % {len(ENDS)})::int + 1]"
    return f"case when (doc_id // {len(values)}) % 2 = 0 then ({_listed(values)})[(doc_id % {len(values)})::int + 1] else {made} end"


def _n(values: list[str], more: str = "") -> str:
    return f"with n as (select doc_id, {_name(values)} as name from documents{more})"


def stem(n: str) -> str:
    return f"substr({n}, 1, length({n}) - length({ext(n)}))"


def export_sql(n: str, given: str, where: str) -> str:
    """CTEs ending in one named e(..., export_name), for rows of given with a name column."""
    tail = fixed.REVISION_TAIL
    return f"""{where}0 as (select *, lower({n}) as low from {given}), {where}1 as (select *, case when regexp_matches(low, '{tail}') then regexp_replace(low, '{tail}', '') || regexp_extract(low, '{tail}', 1) else regexp_replace(regexp_replace(low, '-pinned|-pin', '', 'g'), '-at-?$', '') end as s from {where}0),
{where}2 as (select *, {ext('s')} as x from {where}1), {where}3 as (select *, case when regexp_matches(x, '^\\.\\d+$') or length(x) > 8 then '' else x end as kx from {where}2),
{where}4 as (select *, trim(regexp_replace(regexp_replace(substr(s, 1, length(s)-length(kx)), '\\(\\d+\\)', '', 'g'), '\\s+', ' ', 'g')) as b from {where}3),
{where} as (select * exclude (low, s, x, kx, b), trim(regexp_replace(b, '[-_ ]+$', '')) || kx as export_name from {where}4)"""


_BAD = r"""translate({n}, '<>:"|?*', '_______')"""


def sanitised(n: str) -> str:
    return f"coalesce(nullif(regexp_replace({_BAD.format(n=n)}, '[ .]+$', ''), ''), '_')"


def correct(local: str, remote: str) -> str:
    safe = f"trim(translate({remote}, '<>:\"/\\|?*', '_________'))"
    return f"case when {safe} in ('', '.', '..') then null when {ext(local)} = '' then {safe} when lower({ext(safe)}) = lower({ext(local)}) then {safe} else {stem(safe)} || {ext(local)} end"


def folder_sql(n: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(regexp_replace(lower({n}), '\\(\\d+\\)\\s*$', ''), '\\s+', ' ', 'g')), '[_\\-. ]+$', ''))"


def anchor_ctes(given: str, out: str) -> str:
    return f"""{out}0 as (select *, {folder_sql('name')} as folder_name, nullif(translate(regexp_extract(name, '{fixed.LEADING_DATE}', 1), '-_', '..'), '') as date_key from {given}),
{out}1 as (select *, trim(regexp_replace(regexp_replace(folder_name, '^\\s*\\d{{2,4}}[.\\-_]\\d{{1,2}}[.\\-_]\\d{{1,2}}[\\s.\\-_]*', ''), '^(?:{fixed.LEAD_INS})+', '')) as title from {out}0),
{out} as (select *, case when date_key is not null then 'd:' || date_key || '|' || substr(title, 1, 14) else 'n:' || substr(folder_name, 1, 24) end as anchor from {out}1)"""


_INNER = "case when {s} like '%.%' then regexp_extract({s}, '[^.]*$') else null end"
_J = "regexp_replace(low, '\\.json$', '')"
_J2 = f"regexp_replace(regexp_replace({_J}, '-(?:info|inf|in|i)?(?:\\(\\d+\\))?$', ''), '\\(\\d+\\)$', '')"


def _groups(e: str) -> str:
    return "case " + " ".join(f"when {e} in {listed(x)} then '{g}'" for g, x in fixed.TYPE_GROUPS.items()) + " else 'default' end"


_PRE = r"regexp_extract(folder, '^\s*([\d]{1,4}[.\-/][\d]{1,2}[.\-/][\d]{1,4}\s*[-–]?\s*(?:[A-Za-z ]{0,24}[-–]\s*)?)', 1)"
_CLIP = "(({s} * 97.25) % 20000)"
_GROUPED = "case " + " ".join(f"when x in {listed(e)} then '{g}'" for g, e in fixed.TYPE_GROUPS.items()) + " else 'default' end"
_TIDY = lambda c: f"trim(regexp_replace(replace({c}, ' ', '_'), '_{{2,}}', '_', 'g'), '_ .-')"
_ENDED = lambda c: f"{c} || case when ends_with({c}, x) then '' else x end"
_LOWER, _UPPER = _TIDY("lower('2024-01-02 Work ' || s)"), _TIDY("upper(s || '-' || substr(md5(name), 1, 8))")
SQL = {
    "fn33_rename_preview": _n(NAMES) + f", q as (select distinct name, lower({ext('name')}) as x, {stem('name')} as s from n), g as (select *, {_GROUPED} as type_group from q), t as (select *, case type_group when 'document' then {_ENDED(_UPPER)} when 'image' then 'Red-Old-X_001.' || upper(x[2:2]) || x[3:] else {_ENDED(_LOWER)} end as new_name from g) select '/in box/' || name as original_path, name as original_name, type_group, new_name, '/in box/' || new_name as new_path from t",
    "fn16_export_names": _n(NAMES) + ", " + export_sql("name", "n", "e") + f""", r as (select *, {stem('lower(name)')} as ls, {stem('name')} as st, {ext('name')} as ex from e)
select doc_id, name, export_name, regexp_matches(ls, '{fixed.REVISION_TAIL}') or regexp_matches(ls, '-at-?$') as has_revision, regexp_matches(name, '(?i)-pinned\\.[^.]+$') as is_pinned,
 case when regexp_replace(regexp_replace(st, '{fixed.PINNED_STAMP}', ''), '{fixed.PINNED_END}', '') = '' then name else regexp_replace(regexp_replace(st, '{fixed.PINNED_STAMP}', ''), '{fixed.PINNED_END}', '') || ex end as unpinned,
 case when regexp_matches(name, '^(.*?) \\((\\d+)\\)(\\.[^.]+)?$') then regexp_extract(name, '^(.*?) \\((\\d+)\\)(\\.[^.]+)?$', 1) || regexp_extract(name, '^(.*?) \\((\\d+)\\)(\\.[^.]+)?$', 3) end as twin, 'a/b/' || export_name as export_path from r""",
    "fn24_correct_names": _n(NAMES) + f" select doc_id, {correct('name', chr(39) + 'My: Report.docx' + chr(39))} as a, {correct(chr(39) + 'video.mp4' + chr(39), 'name')} as b, {correct('name', chr(39) + 'Plain' + chr(39))} as c from n",
    "prj12_name_classes": _n(NAMES) + f""", l as (select *, lower(name) as low, {stem('name')} as st, lower({ext('name')}) as ex from n)
select doc_id, name, low in {listed([*fixed.CLUTTER_NAMES, 'shared drive metadata.json'])} or ends_with(low, '-info.json') or ends_with(low, '-i.json') or (ends_with(low, '.json') and coalesce({_INNER.format(s=_J)} in {listed(fixed.SIDECAR_INNER)}, false)) as clutter,
 low in {listed([*fixed.CLUTTER_NAMES, 'shared drive metadata.json'])} or ends_with(low, '-comments.html') or (ends_with(low, '.json') and coalesce({_INNER.format(s=_J2)} in {listed(fixed.SIDECAR_INNER)}, false)) or regexp_matches(low, '{fixed.SIDECAR_TAIL}') as sidecar,
 trim(st) = '' or regexp_matches(trim(st), '{fixed.ILL_NAMED}') as ill_named, {_groups('ex')} as type_group, regexp_matches(st, '{fixed.GENERIC_NAME}') as generic from l""",
    "fn12_safe_names": _n(NAMES) + f""" select doc_id, {ext('name')} as ext, {stem('name')} as stem, {sanitised('name')} as sanitised, trim(replace(regexp_replace(name, '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g'), ' ', '_'), '. ') as sanitised_name,
 substr(trim(trim(regexp_replace(name, '[\\\\/:*?"<>|]', '', 'g')), '. '), 1, 12) as short, regexp_replace(regexp_replace(regexp_replace(name, '{fixed.ARCHIVE_END}', ''), '-\\d+(-\\d+)?$', ''), '(?i)\\.part\\d+$', '') as archive_base, 'a_b/c_/' || {sanitised('name')} as safe_path from n""",
    "fn21_folder_anchors": _n(FOLDERS) + ", " + anchor_ctes("n", "a") + f""", z as (select *, rtrim(name) as rn, regexp_extract(rtrim(name), '(\\S+)$', 1) as last from a)
select doc_id, name, folder_name, date_key, title, anchor, regexp_matches(rn, '[_-]$') or length(name) >= 60 or (length(last) between 2 and 6 and regexp_matches(last, '^\\p{{L}}') and not regexp_matches(rn, '[.)\\]]$')) as truncated, {_PRE.replace('folder', 'name')} as prefix from z""",
    "fn37_folder_titles": f"""with n as (select doc_id, {_name(FOLDERS)} as folder, ({_listed(TITLES)})[(doc_id % {len(TITLES)})::int + 1] as title from documents),
b as (select *, trim(regexp_replace({stem('title')}, '(?i)^\\d+(st|nd|rd|th)?\\s*(webinar)?\\s*[\\(\\-:]?\\s*', ''), ' ()-') as bare, {_PRE} as prefix, lower(regexp_replace(folder, '[_\\-\\s]+$', '')) as trunk from n),
c as (select *, case when length(bare) >= 8 and not regexp_matches(bare, '{fixed.GENERIC_NAME}') then substr(trim(trim(regexp_replace(case when prefix <> '' and not starts_with(lower(bare), lower(prefix)) then prefix || bare else bare end, '[\\\\/:*?"<>|]', '', 'g')), '. '), 1, 180) end as proposal,
 case when prefix = '' then trim(trunk) else trim(replace(trunk, lower(prefix), '')) end as rest from b),
d as (select *, case when proposal is null then null when trunk <> '' and rest <> '' and starts_with(lower(proposal), substr(trunk, 1, greatest(8, length(trunk)-4))) then 0.9 else 0.6 end::double as confidence from c)
select doc_id, folder, title, proposal, confidence, coalesce(confidence, 0) < 0.8 as needs_review from d""",
    "prj24_risk": "select doc_id, (['rename','move','delete','other'])[(doc_id % 4)::int + 1] as action, ([0.80,0.90,0.95,0.90])[(doc_id % 4)::int + 1]::double as threshold, (doc_id % 21)/20.0 >= ([0.80,0.90,0.95,0.90])[(doc_id % 4)::int + 1] as approved from documents",
    "jn30_sidecars": f"with {FILES_SQL}, " + f"""a as (select path from files union all select regexp_replace(path, '\\.txt$', '.json') from files where file_id % 6 = 0 union all select regexp_replace(replace(path, 'doc-', 'meta-'), '\\.txt$', '.json') from files where file_id % 11 = 0),
b as (select path, regexp_replace(path, '/[^/]*$', '') as folder, lower({base()}) as name from a), j as (select *, regexp_replace(name, '\\.json$', '') as base, substr(rtrim(regexp_replace(name, '\\.json$', ''), '( '), 1, 20) as head from b where ends_with(name, '.json'))
select distinct j.path from j join b on b.folder = j.folder and not ends_with(b.name, '.json') and (starts_with(b.name, j.base) or (length(j.head) >= 12 and starts_with(b.name, j.head)))""",
    "prj14_html_classes": """with p as (select page_id, page_id % 5 as k, lower(substr(case page_id % 5 when 0 then '<!DOCTYPE NETSCAPE-Bookmark-file-1><!-- It will be read and overwritten -->' || html when 1 then '<p>Comment thread</p>' || html else html end, 1, 1500)) as h from pages)
select page_id, case when h like '%netscape-bookmark-file%' and h like '%it will be read and overwritten%' then 'shortcut' when k < 3 and (h like '%comment%' or h like '%drive.google.com%') then 'comments' else 'keep' end as class from p""",
    "prj20_keywords": f"with {FILES_SQL} select file_id, case when lower({base()}) like '%pinned%' then 'pinned' when lower({base()}) like '%doc-1%' then 'doc-1' when lower({base()}) like '%(2)%' then '(2)' end as first_keyword, case when regexp_matches({base()}, '(?i)\\bpinned\\b') then 'pinned' when regexp_matches({base()}, '(?i)\\btxt\\b') then 'txt' end as whole_word from files",
    "fn42_clocks": """with s as (select doc_id, ((doc_id * 97.25) % 20000)::double as s from documents), t as (select doc_id, floor(s/3600)::int as h, floor((s % 3600)/60)::int as m, floor(s % 60)::int as x, (floor(s*1000)::bigint % 1000)::int as ms from s)
select doc_id, printf('%02d:%02d:%02d', h, m, x) as clock, printf('%02d:%02d:%02d.%03d', h, m, x, ms) as millis, printf('%02dh%02dm%02ds', h, m, x) as label from t""",
    "src15_clipped_text": "select doc_id, md5(case when strlen(text) <= 3000 then text else substr(text, 1, 2000) || chr(10) || '...' || chr(10) || right(text, 500) end) as clipped_md5 from documents",
    "fn54_answers": """select doc_id, case doc_id % 4 when 0 then '{"a": 1}' when 1 then 'Error 429: slow down' when 2 then '{"b": 2}' else 'fine' end as json, doc_id % 4 = 1 as busy, case doc_id % 4 when 0 then epoch(timestamp '2024-03-01 10:20:30') when 1 then 0.0 else epoch(timestamp '2024-03-01') end::double as epoch,
 round_even((n_chars*4096)/1048576.0, 1)::double as mb, round_even((n_chars*50000000)/1e9, 1)::double as gb from documents""",
    "fn03_hashes": "select doc_id, sha256(text) as sha256, md5(text) as md5, case when strlen(text) < 2000 then sha256(text) else sha256(strlen(text)::varchar || text || text || text) end as smart from documents",
}
