"""Archives: keys, what is already extracted, and how extracted accounts are laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.paths import basename, dirname, extension, segments, slashes, stem
from ..functions.predicates import is_clutter
from .storage import numbered

SAMPLE = 25


def archive_key(path: Column | str, size: Column | str, mtime: Column | str) -> Column:
    """path|size|seconds, the path in lower case."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat_ws("|", F.lower(slashes(path)), c(size).cast("string"), F.floor(c(mtime)).cast("string"))


def extractable(members: DataFrame) -> DataFrame:
    """Members that are files for a user: no folders, system junk or mail exports."""
    low = F.lower("member")
    return members.filter(~F.col("member").endswith("/") & ~F.col("member").contains("__MACOSX") & ~low.endswith(".mbox") & ~low.contains("all mail including spam"))


def sample(members: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Every k-th member of each archive in its own order (seq), k such that about limit are taken."""
    rows = numbered(members, ["archive"], ["seq"], "nth")
    size = members.groupBy("archive").agg(F.count("*").alias("total"))
    return rows.join(size, "archive").filter((F.col("nth") - 1) % F.greatest(F.lit(1), F.floor(F.col("total") / limit)) == 0)


def on_disk(members: DataFrame, files: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Per zip archive of members(archive, seq, member, size): total, and extracted: every sampled
    member lies among files(path, size) as output/member with equal size. An archive without
    anything to extract is done."""
    zips = members.filter(F.lower("archive").endswith(".zip"))
    own = extractable(zips)
    picked = sample(own, limit).select("archive", F.col("target").alias("path"), "size", "total")
    lost = picked.join(files.select("path", "size"), ["path", "size"], "left_anti").select("archive").distinct().withColumn("lost", F.lit(True))
    total = own.groupBy("archive").agg(F.count("*").alias("total"))
    rows = zips.select("archive").distinct().join(total, "archive", "left").join(lost, "archive", "left")
    return rows.select("archive", F.coalesce("total", F.lit(0)).alias("total"), F.col("lost").isNull().alias("extracted"))


def to_extract(archives: DataFrame, ledger: DataFrame, proven: DataFrame) -> DataFrame:
    """Archives(path, size, mtime) that neither the ledger(key) nor the disk shows as extracted."""
    keyed = archives.withColumn("key", archive_key("path", "size", "mtime"))
    left = keyed.join(ledger.select("key"), "key", "left_anti")
    return left.join(proven.filter("extracted").select(F.col("archive").alias("path")), "path", "left_anti").select("path", "size", "key")


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("archives"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def exported_office(members: DataFrame) -> DataFrame:
    """Office archives whose members lack both property parts that office programs always write."""
    office = members.filter(F.lower(extension(basename("archive"))).isin(".docx", ".xlsx", ".pptx")).select("archive").distinct()
    return office.join(members.filter(F.col("member").isin("docProps/app.xml", "docProps/core.xml")).select("archive"), "archive", "left_anti")


def native_match(files: DataFrame, index: DataFrame) -> DataFrame:
    """files(path) with the native document(label, name, id, seq) of their top folder and base name,
    case aside; of several the one listed last."""
    rows = files.select("path", F.lower(F.split(slashes("path"), "/")[0]).alias("top"), F.lower(stem(basename("path"))).alias("base"))
    last = index.groupBy(F.lower("label").alias("top"), F.lower(F.btrim("name")).alias("base")).agg(F.max_by("id", "seq").alias("id"))
    return rows.join(last, ["top", "base"], "left").select("path", "id")


def safe_label(root: Column | str) -> Column:
    """A root's path as a file name."""
    c = F.col(root) if isinstance(root, str) else root
    bare = F.btrim(F.translate(F.regexp_replace(c, r"(.)[\\/]+$", "$1"), "\\/:", "__"), F.lit("_"))
    return F.when(bare == "", "root").otherwise(bare)


def account_and_rel(path: Column | str, root: str) -> tuple[Column, Column]:
    """First component of a path below root and what follows it; empty where it isn't below."""
    c = slashes(path)
    top = root.rstrip("/")
    inside = F.startswith(F.lower(c), F.lit(top.lower() + "/"))
    rel = F.when(inside, F.btrim(F.substr(c, F.lit(len(top) + 2)), F.lit("/"))).otherwise("")
    return F.substring_index(rel, "/", 1), F.when(rel.contains("/"), F.regexp_replace(rel, "^[^/]*/", "")).otherwise("")


def drive_key(path: Column | str, root: str) -> Column:
    """A local folder's key among a drive's folders: its lower-case path below root, null outside."""
    c = slashes(path)
    top = root.rstrip("/")
    return F.when(F.startswith(F.lower(c), F.lit(top.lower() + "/")), F.lower(F.substr(c, F.lit(len(top) + 2))))


def accounts(walked: DataFrame, root: str) -> DataFrame:
    """walked(path, is_dir) below root to rows account, entry, rel: batch folders (named by eight
    digits) and one nested 'extracted' layer are passed through; of an account under several
    batches the first by path counts."""
    top = root.rstrip("/")
    parts = F.split(F.substr(slashes("path"), F.lit(len(top) + 2)), "/")
    rows = walked.filter(F.startswith(slashes("path"), F.lit(top + "/"))).withColumn("p", parts)
    for _ in range(2):  # a batch, then a nested layer with a batch of its own
        is_batch = F.get("p", F.lit(0)).rlike(r"^\d{8}")
        rows = rows.withColumn("p", F.when(is_batch, F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).otherwise(F.col("p")))
        nested = F.lower(F.get("p", F.lit(0))) == "extracted"
        rows = rows.withColumn("p", F.when(nested, F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).otherwise(F.col("p")))
    rows = rows.filter((F.size("p") >= 2) & (F.lower(F.get("p", F.lit(1))) == "drive"))
    rows = rows.withColumn("account", F.get("p", F.lit(0))).withColumn("rel", F.array_join(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), "/"))
    rows = rows.withColumn("base", F.regexp_replace(slashes("path"), r"(?i)/drive(/.*)?$", ""))
    first = rows.groupBy(F.lower("account").alias("key")).agg(F.min("base").alias("base"))
    return rows.join(first, (F.lower("account") == F.col("key")) & (rows.base == first.base)).select("account", "rel", "is_dir").filter("rel != ''")


def organization(walked: DataFrame, mapping: DataFrame, root: str) -> DataFrame:
    """Dry run of the layout of extracted accounts: account, kind (shared, personal, skipped_empty),
    name, items (sorted names). Resources take their mapped name, numbered from the second use
    on; personal accounts list what lies in their My Drive. Clutter, trash and deeper levels are
    left out."""
    rows = accounts(walked, root)
    name, depth = F.substring_index("rel", "/", -1), F.size(F.split("rel", "/"))
    kept = ~F.lower(name).isin(fixed.SKIPPED_CHILDREN) & ((F.col("is_dir") == 1) | ~is_clutter(name))
    resource = F.startswith(F.lower("account"), F.lit("resource"))
    mine = F.startswith(F.col("rel"), F.lit("My Drive/"))
    shown = F.when(resource, (depth == 1) & (F.col("is_dir") == 1)).otherwise(mine & (depth == 2))
    content = kept & F.when(resource, depth == 1).otherwise(F.lit(True))
    per = rows.groupBy("account").agg(F.sort_array(F.collect_set(F.when(kept & shown, name))).alias("items"), F.bool_or(content).alias("content"))
    kinds = per.join(mapping.select(F.col("resource").alias("account"), "display"), "account", "left")
    empty = F.startswith(F.lower("account"), F.lit("resource")) & ~F.col("content")
    kinds = kinds.withColumn("kind", F.when(empty, "skipped_empty").when(F.startswith(F.lower("account"), F.lit("resource")), "shared").otherwise("personal"))
    named = kinds.withColumn("wanted", F.when(F.col("kind") == "shared", F.coalesce("display", "account")).otherwise(F.col("account")))
    ranked = numbered(named.select("kind", "wanted", "account"), ["kind", "wanted"], ["account"], "use")
    label = F.when((F.col("kind") == "shared") & (F.col("use") > 1), F.concat("wanted", F.lit(" ("), F.col("use").cast("string"), F.lit(")"))).otherwise(F.col("wanted"))
    return named.join(ranked, ["kind", "wanted", "account"]).select("account", "kind", label.alias("name"), "items", (F.col("kind") == "shared").__and__(F.col("display").isNull()).alias("unmapped"))


def cleanup(folders: DataFrame, files: DataFrame, drive: DataFrame, root: str) -> DataFrame:
    """folders(path) below root as in_drive, empty_not_in_drive or content_not_in_drive, with the
    files beneath: drive(key) has the drive's folders. Folders that only hold other folders and no
    files are none of these."""
    from ..functions.paths import ancestors

    rows = folders.select("path", drive_key("path", root).alias("key")).filter("key is not null")
    inside = files.select(F.explode(ancestors("path")).alias("path")).groupBy("path").agg(F.count("*").alias("files"))
    parents = folders.select(dirname("path").alias("path")).distinct().withColumn("has_folders", F.lit(True))
    known = drive.select(F.lower("key").alias("key")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "key", "left").join(inside, "path", "left").join(parents, "path", "left")
    n = F.coalesce("files", F.lit(0))
    state = F.when(F.col("known").isNotNull(), "in_drive").when(n > 0, "content_not_in_drive").when(F.col("has_folders").isNull(), "empty_not_in_drive")
    return rows.select("path", n.alias("files"), state.alias("state")).filter("state is not null")


def backfill(empty: DataFrame, files: DataFrame, root: str, other: str, drive: DataFrame) -> DataFrame:
    """Where the content of empty folders could come from: files of the same relative path below
    other (without the account), and files of drive(key, files)."""
    from ..functions.paths import ancestors

    _, rel = account_and_rel("path", root)
    held = files.select(F.explode(ancestors("path")).alias("candidate")).groupBy("candidate").agg(F.count("*").alias("local_files"))
    rows = empty.select("path", F.concat(F.lit(other.rstrip("/") + "/"), rel).alias("candidate"), drive_key("path", root).alias("key"))
    return rows.join(held, "candidate", "left").join(drive.select("key", F.col("files").alias("drive_files")), "key", "left").select("path", F.when(F.col("local_files") > 0, F.col("candidate")).alias("candidate"), F.coalesce("local_files", F.lit(0)).alias("local_files"), "drive_files")


def resolve(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """paths(drive, rel) to the id of the folder there: tree(drive, rel_path, id) joined by the whole
    path, trimmed and without case; of equal names the smallest id; null where there is none."""
    tidy = lambda c: F.array_join(F.transform(F.filter(F.split(F.lower(c), "/"), lambda x: F.btrim(x) != ""), lambda x: F.btrim(x)), "/")
    by = tree.groupBy("drive", tidy("rel_path").alias("tidy")).agg(F.min("id").alias("id"))
    return paths.withColumn("tidy", tidy("rel")).join(by, ["drive", "tidy"], "left").drop("tidy")


def top_folders(nodes: DataFrame) -> DataFrame:
    """Per drive its set of first-level folder names."""
    return nodes.filter((F.size(segments("rel_path")) == 1) & (F.col("is_dir") == 1)).groupBy("drive").agg(F.sort_array(F.collect_set(F.btrim(F.col("rel_path"), F.lit("/")))).alias("folders"))


def moved_to(rows: DataFrame, folder: str) -> DataFrame:
    """Files(path, size) into one folder under their own names: src, dst, size."""
    return rows.select(slashes("path").alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), basename("path")).alias("dst"), "size")
