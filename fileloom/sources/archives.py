"""Members of archives, as rows, digests and extracted files.

Zip archives are read by ranges: a first pass reads only the central directory, record by record, so
that an archive of any number of members takes little memory; the members of all archives are then
dealt over tasks by bytes, and each is read at its own offset. Plain tar archives are dealt likewise
after a pass over their headers. Compressed tar archives and gzip files have no offsets: each is a
stream, read by one task.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import os
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.storage import running, stored
from .files import ARCHIVES, CHUNK, frames

#: Packed bytes of members that one task reads.
TASK_BYTES = 64 << 20
#: Fixed values of the zip format: signatures, and the sizes of what follows them.
ZIP_END, ZIP64_PLACE, ZIP64_END, ZIP_ENTRY, ZIP_LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
#: Members that leave the target, that systems add, and mail exports.
OUTSIDE = r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)"
SYSTEM = r"(^|/)(__MACOSX/|\._|\.DS_Store$)|__MACOSX"
MAIL = r"(?i)\.mbox|\.(eml|pst)$|all mail including spam and trash"
#: What is kept of an account's export if only its drive is wanted.
DRIVE, ACTIVITY = "takeout/drive/", "my activity/"

LISTED = "archive string, member string, size long, seq long, at long, packed long, method int, crc long, locked boolean, error string"
READ = "archive string, member string, size long, bytes long, md5 string, target string, skip string, error string"


class Damaged(Exception):
    pass


class Entry(NamedTuple):
    member: str
    size: int
    at: int
    packed: int
    method: int
    crc: int
    locked: bool


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise Damaged("Truncated")
    return data


def zip_entries(f: BinaryIO) -> Iterator[Entry]:
    """Files of a zip archive, from its central directory, one record at a time. at is the place of
    the local header."""
    end = f.seek(0, os.SEEK_END)
    tail_at = max(0, end - 65_557)
    f.seek(tail_at)
    tail = f.read()
    found = tail.rfind(ZIP_END)
    if found < 0 or len(tail) - found < 22:
        raise Damaged("NotAZip")
    count, size, start = struct.unpack("<H", tail[found + 10 : found + 12])[0], *struct.unpack("<II", tail[found + 12 : found + 20])
    ends_at = tail_at + found
    if tail[found - 20 : found - 16] == ZIP64_PLACE and found >= 20:
        f.seek(struct.unpack("<Q", tail[found - 12 : found - 4])[0])
        record = _exactly(f, 56)
        if record[:4] != ZIP64_END:
            raise Damaged("NotAZip")
        count, size, start = struct.unpack("<Q", record[32:40])[0], *struct.unpack("<QQ", record[40:56])
        ends_at = tail_at + found - 20 - 56
    shift = ends_at - size - start  # bytes before the archive itself
    if shift < 0:
        raise Damaged("Truncated")
    f.seek(start + shift)
    for _ in range(count):
        head = _exactly(f, 46)
        if head[:4] != ZIP_ENTRY:
            raise Damaged("BadDirectory")
        flags, method = struct.unpack("<HH", head[8:12])
        crc, packed, whole = struct.unpack("<III", head[16:28])
        n_name, n_extra, n_note = struct.unpack("<HHH", head[28:34])
        at = struct.unpack("<I", head[42:46])[0]
        name, extra = _exactly(f, n_name), _exactly(f, n_extra)
        f.seek(n_note, os.SEEK_CUR)
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 64-bit values of the fields that are full
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole, packed, at = (wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in (whole, packed, at))
            extra = extra[4 + n :]
        member = name.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        if not member.endswith("/"):
            yield Entry(member, whole, at + shift, packed, method, crc, bool(flags & 1))


def _unpacked(f: BinaryIO, e: Entry) -> Iterator[bytes]:
    """The bytes of a zip member in bounded pieces."""
    f.seek(e.at)
    head = _exactly(f, 30)
    if head[:4] != ZIP_LOCAL:
        raise Damaged("BadMember")
    f.seek(sum(struct.unpack("<HH", head[26:30])), os.SEEK_CUR)
    left = e.packed
    if e.method == 0:
        while left:
            piece = f.read(min(CHUNK, left))
            if not piece:
                raise Damaged("Truncated")
            left -= len(piece)
            yield piece
        return
    if e.method == 8:
        unpack = zlib.decompressobj(-15)
        more = lambda data: unpack.decompress(data, CHUNK)
        rest = lambda: unpack.unconsumed_tail
    elif e.method == 12:
        unpack = bz2.BZ2Decompressor()
        more, rest = (lambda data: unpack.decompress(data, CHUNK)), (lambda: b"" if unpack.needs_input or unpack.eof else None)
    elif e.method == 14:
        props = _exactly(f, 9)
        left -= 9
        unpack = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[lzma._decode_filter_properties(lzma.FILTER_LZMA1, props[4:])])
        more, rest = (lambda data: unpack.decompress(data, CHUNK)), (lambda: b"" if unpack.needs_input or unpack.eof else None)
    else:
        raise Damaged("Method")
    while left and not unpack.eof:
        data = f.read(min(CHUNK, left))
        if not data:
            raise Damaged("Truncated")
        left -= len(data)
        yield more(data)
        while (kept := rest()) != b"" and not unpack.eof:
            yield more(kept or b"")


def _copied(pieces: Iterator[bytes], size: int | None, crc: int | None, target: str | None) -> tuple[int, str]:
    """(bytes, md5) of the pieces, written to the target if one is given, which appears whole. Stops
    where more comes than the archive says."""
    md5, got, check, draft = hashlib.md5(), 0, 0, None
    try:
        if target:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            draft = f"{target}.{uuid.uuid4().hex}"
        with open(draft or os.devnull, "wb") as out:
            for piece in pieces:
                got += len(piece)
                if size is not None and got > size:
                    raise Damaged("Size")
                md5.update(piece)
                check = zlib.crc32(piece, check)
                if draft:
                    out.write(piece)
        if size is not None and got != size:
            raise Damaged("Size")
        if crc is not None and check != crc:
            raise Damaged("Checksum")
        if draft:
            os.replace(draft, target)
            draft = None
        return got, md5.hexdigest()
    finally:
        if draft and os.path.exists(draft):
            os.remove(draft)


_FAILS = (OSError, EOFError, Damaged, tarfile.TarError, zlib.error, lzma.LZMAError, struct.error, ValueError)


def _name(e: Exception) -> str:
    return str(e) if isinstance(e, Damaged) else type(e).__name__


def _kind(path: str) -> str:
    low = path.lower()
    if low.endswith(".zip"):
        return "zip"
    if low.endswith(".tar"):
        return "tar"
    if low.endswith((".tgz", ".tar.gz", ".tar.bz2", ".gz")):
        return "stream"
    return "other"


def archives(walked: DataFrame) -> DataFrame:
    return walked.filter((F.col("is_dir") == 0) & F.col("name").rlike(ARCHIVES))


def _listing(path: str) -> Iterator[tuple]:
    """LISTED rows of an archive; of those that are streams, of others and of damaged ones, one row."""
    try:
        kind = _kind(path)
        if kind == "other":
            raise Damaged("Format")
        if kind == "stream":
            yield (path, None, None, 0, None, os.path.getsize(path), None, None, False, None)
        elif kind == "zip":
            with open(path, "rb") as f:
                for seq, e in enumerate(zip_entries(f)):
                    yield (path, e.member, e.size, seq, e.at, e.packed, e.method, e.crc, e.locked, None)
        else:
            with tarfile.open(path, "r:") as t:
                for seq, m in enumerate(t):
                    t.members = []  # else every header stays in memory
                    if m.isfile():
                        yield (path, m.name, m.size, seq, m.offset_data, m.size, -1, None, False, None)
    except _FAILS as e:
        yield (path, None, None, 0, None, 0, None, None, False, _name(e))


def listing(found: DataFrame) -> DataFrame:
    """What each archive of found(path) says of its members, in its order (seq): LISTED rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from frames((row for path in b.path for row in _listing(path)), LISTED)

    return found.select("path").mapInPandas(run, LISTED)


def skip_of(member: str | None, only_drive: bool = False) -> str | None:
    """Why a member isn't to be extracted: outside, system, mail, not_drive, or null."""
    if member is None:
        return None
    low = member.replace("\\", "/").lower()
    if re.search(OUTSIDE, member):
        return "outside"
    if re.search(SYSTEM, member):
        return "system"
    if re.search(MAIL, member):
        return "mail"
    if only_drive and (f"/{ACTIVITY}" in low or low.startswith(f"takeout/{ACTIVITY}") or DRIVE not in low):
        return "not_drive"
    return None


def folder_of(archive: str) -> str:
    """The folder below the target for an archive's members; archives of one name have their own."""
    return f"{re.sub(ARCHIVES, '', os.path.basename(archive))}-{hashlib.md5(archive.encode()).hexdigest()[:8]}"


def members(found: DataFrame, only_drive: bool = False) -> DataFrame:
    """archive, member, size, skip (why a member isn't to be extracted, else null) and error of the
    archives found(path). Streams are read through for it; nothing is unpacked of the others."""
    return read_members(found, only_drive=only_drive, contents=False).select("archive", "member", "size", "skip", "error")


def read_members(found: DataFrame, target: str | None = None, only_drive: bool = False, contents: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every member of the archives found(path), read whole: READ rows, and with a target extracted to
    target/archive/member, which all executors must reach.

    skip is why a member isn't read: outside (its path leaves the target), system, mail, not_drive,
    or replaced (the archive has a later member of this path, which counts). error is why it couldn't
    be: a wrong checksum or size, an unknown method, a locked or cut member; a damaged archive has one
    row with a null member. Others of the same archive are read all the same. An archive listed twice
    is read twice, into the same files.
    """
    plan = stored(listing(found), "members")
    last = plan.filter("member is not null").groupBy(F.col("archive").alias("a"), F.col("member").alias("m")).agg(F.max("seq").alias("last"))
    plan = plan.join(last, (F.col("archive") == F.col("a")) & (F.col("member") == F.col("m")), "left").drop("a", "m")
    ranged = stored(running(plan.withColumn("cost", F.coalesce("packed", F.lit(0)) + 4096), [], ["archive", "at", "seq"], "cost", "before"), "ranges")
    block = F.floor(F.col("before") / task_bytes)
    total = ranged.agg(F.max(block)).first()[0]
    dealt = ranged.withColumn("block", block).repartition(int(total or 0) + 1, "block").sortWithinPartitions("block", "archive", "at", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from frames((row for b in batches for row in _read(b, target, only_drive, contents)), READ)

    return dealt.select(*(c.split()[0] for c in LISTED.split(", ")), "last").mapInPandas(run, READ)


def _read(rows: pd.DataFrame, target: str | None, only_drive: bool, contents: bool) -> Iterator[tuple]:
    held: tuple[str, BinaryIO] | None = None
    try:
        for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
            if r.error or _kind(r.archive) == "stream":
                yield from _streamed(r.archive, target, only_drive, contents) if not r.error else [(r.archive, None, None, None, None, None, None, r.error)]
                continue
            skip = skip_of(r.member, only_drive) or ("replaced" if r.last != r.seq else None)
            into = os.path.join(target, folder_of(r.archive), r.member) if target and not skip else None
            if skip or not contents:
                yield (r.archive, r.member, int(r.size), None, None, None, skip, None)
                continue
            try:
                if held is None or held[0] != r.archive:
                    if held:
                        held[1].close()
                    held = (r.archive, open(r.archive, "rb"))  # noqa: SIM115  closed with the next archive
                if r.locked:
                    raise Damaged("Locked")
                e = Entry(r.member, int(r.size), int(r.at), int(r.packed), int(r.method), r.crc, False)
                got, md5 = _copied(_ranged(held[1], e) if e.method == -1 else _unpacked(held[1], e), e.size, None if e.crc is None else int(e.crc), into)
                yield (r.archive, r.member, e.size, got, md5, into, None, None)
            except _FAILS as e:
                yield (r.archive, r.member, int(r.size), None, None, None, None, _name(e))
    finally:
        if held:
            held[1].close()


def _ranged(f: BinaryIO, e: Entry) -> Iterator[bytes]:
    f.seek(e.at)
    left = e.packed
    while left:
        piece = f.read(min(CHUNK, left))
        if not piece:
            raise Damaged("Truncated")
        left -= len(piece)
        yield piece


def _pieces(f: BinaryIO) -> Iterator[bytes]:
    while piece := f.read(CHUNK):
        yield piece


def _streamed(path: str, target: str | None, only_drive: bool, contents: bool) -> Iterator[tuple]:
    """Members of a compressed tar archive, or the one of a gzip file, as they come. A member that
    comes again replaces its file; its first row stays, as what follows isn't known yet."""
    low = path.lower()
    try:
        if low.endswith(".gz") and not low.endswith(".tar.gz"):
            member = os.path.basename(path)[:-3]
            into = os.path.join(target, folder_of(path), member) if target else None
            with gzip.open(path) as g:
                got, md5 = _copied(_pieces(g), None, None, into)
            yield (path, member, got, got if contents else None, md5 if contents else None, into, None, None)
            return
        with tarfile.open(path, "r|bz2" if low.endswith("bz2") else "r|gz") as t:
            for m in t:
                t.members = []
                if not m.isfile():
                    continue
                skip = skip_of(m.name, only_drive)
                if skip or not contents:
                    yield (path, m.name, m.size, None, None, None, skip, None)
                    continue
                into = os.path.join(target, folder_of(path), m.name) if target else None
                got, md5 = _copied(_pieces(t.extractfile(m)), m.size, None, into)
                yield (path, m.name, m.size, got, md5, into, None, None)
    except _FAILS as e:
        yield (path, None, None, None, None, None, None, _name(e))
