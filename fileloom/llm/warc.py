"""WARC archives: writing captures of pages, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an earlier equal payload) and a metadata
record, tied by WARC-Concurrent-To. Records are gzip members of their own, so that a reader can
start at any of them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import discard, released, run_dir, slices, store, stored, write_whole

#: Payloads below this many bytes are always written whole.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"

RECORDS = "record_type string, record_id string, concurrent_to array<string>, target_uri string, date string, refers_to string, declared_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def record_id(kind: str, page: int | str, copy: int) -> str:
    return f"<urn:fileloom:{kind}:{page}:{copy}>"


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    body = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(body) + squeeze.flush()


def capture(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, original: tuple[int, int] | None) -> bytes:
    """The three records of one page."""
    uri = None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    page = f"none-{digest}" if page_id is None else page_id
    main, digest = record_id("response", page, copy), f"sha256:{digest}"
    parts = urlsplit(uri) if uri and "[" not in uri else None
    get = f"GET {(parts.path or '/') if parts else '/'}{'?' + parts.query if parts and parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc if parts else ''}\r\n\r\n".encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    out = _record("request", [("WARC-Record-ID", record_id("request", page, copy)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], get)
    if original is None:
        out += _record("response", [("WARC-Record-ID", main), *named, ("Content-Type", "application/http; msgtype=response")], head + payload)
    else:
        refers = record_id("response", *original)
        out += _record("revisit", [("WARC-Record-ID", main), *named, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers), ("Content-Type", "application/http; msgtype=response")], head)
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    return out + _record("metadata", [("WARC-Record-ID", record_id("metadata", page, copy)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields.encode())


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages(page_id, url, html) as WARC files, one per partition; a row per file: uri, captures,
    bytes. html is written in UTF-8, null as an empty payload.

    Of pages with equal payloads of REVISIT_BYTES or more, the one with the smallest page_id is a
    response and the others revisit it. Repeated page_ids are told apart by a copy number, in
    payload order; a page without page_id is a response that nothing refers to, named by its
    digest. Payloads are compared by SHA-256: what decides is grouped from ids and digests alone,
    and payloads are shuffled once, by page_id, digest and url, which spreads a payload that a third
    of the pages share; rows that are equal in all three are one row until they are written.
    """
    spark = pages.sparkSession
    folder = folder or run_dir(spark, "warc")
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # rows of one page_id, digest and url have the copy numbers after before
    groups = keyed.select("page_id", "digest", "url", F.octet_length("payload").alias("size")).groupBy("page_id", "digest", "url").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    earlier = Window.partitionBy("page_id", F.when(F.col("page_id").isNull(), F.col("digest"))).orderBy("digest", "url").rowsBetween(Window.unboundedPreceding, -1)
    groups = stored(groups.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "payloads")
    large = groups.filter((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", (F.col("before") + 1).alias("copy"))).alias("original"), F.sum("n").alias("rows")).filter("rows > 1")
    facts = groups.join(first, "digest", "left").filter("before > 0 or original is not null").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("url").alias("u"), "before", "original")
    # rows that are equal in all three are one row with a count until they are written
    whole = keyed.groupBy("page_id", "digest", "url").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & F.col("url").eqNullSafe(F.col("u"))
    counted = whole.join(facts, same, "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copy = (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("copy")
    planned = counted.select("page_id", copy, "url", "payload", "digest", "original")
    again = F.col("page_id").isNotNull() & (F.col("original") != F.struct("page_id", "copy"))
    planned = planned.withColumn("original", F.when(again, F.col("original")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        captures = size = 0

        def body(out) -> None:
            nonlocal captures, size
            for b in slices(batches, "payload"):
                columns = [c.to_pylist() for c in b.columns]
                for page_id, copy, url, payload, digest, original in zip(*columns):
                    some = capture(page_id, copy, url, payload, digest, original and (original["page_id"], original["copy"]))
                    out.write(some)
                    captures, size = captures + 1, size + len(some)

        write_whole(uri, body)
        yield pa.RecordBatch.from_pydict({"uri": [uri], "captures": [captures], "bytes": [size]})

    files = stored(planned.mapInArrow(released(write), "uri string, captures long, bytes long"), "warc-files")
    discard(groups)
    return files


def _head(f: io.BufferedReader) -> dict[str, list[str]] | None:
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found: dict[str, list[str]] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found.setdefault(name.strip().lower(), []).append(value.strip())
    return found


def parse(stream, with_payload: bool) -> Iterator[tuple]:
    """Records of one archive, in order, one at a time in memory."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
    while (h := _head(f)) is not None:
        one = lambda k: h.get(k, [None])[0]
        block = f.read(int(one("content-length") or 0))
        kind, http = one("warc-type"), (one("content-type") or "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        fields = None
        if (one("content-type") or "") == "application/warc-fields":
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k.strip()]
        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else None
        yield (kind, one("warc-record-id"), h.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-date"), one("warc-refers-to"), (one("warc-payload-digest") or "").removeprefix("sha256:") or None, len(payload) if kind == "response" else None, digest, fields, payload if with_payload and kind in ("response", "request") else None)


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives that files lists by uri; see RECORDS for the columns."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = store(uri)
                held, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for r in parse(stream, with_payload):
                        held.append(r)
                        size += 200 + (len(r[-1]) if r[-1] else 0)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.filter("captures > 0").select("uri").repartition(n).mapInArrow(released(read), RECORDS)


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), request, metadata (array).

    A request or metadata record belongs to the response or revisit that it names in
    WARC-Concurrent-To, that names it, or that it reaches through a request it names. Records
    without such a partner are no capture and are left out; a capture may lack request or
    metadata. Identifiers are joined by key only. Records that name their response, as most archives
    have it, are grouped by that name in one shuffle; only where some name another record, or are
    named, are the owners of all worked out first.
    """
    main, request = F.col("record_type").isin("response", "revisit"), F.col("record_type") == "request"
    mains = records.filter(main)
    sides = records.filter(~main & F.col("record_type").isin("request", "metadata"))
    inside = ["record_id", "record_type", "target_uri", "date", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "fields", *(["payload"] if with_payload else [])]
    whole = F.struct(*inside)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy("capture_id").agg(
            F.first(F.when(main, F.col("r")), ignorenulls=True).alias("response"),
            F.first(F.when(request, F.col("r")), ignorenulls=True).alias("request"),
            F.collect_list(F.when(F.col("record_type") == "metadata", F.col("r"))).alias("metadata"),
        )

    own = mains.select(F.col("record_id").alias("capture_id"), "record_type", whole.alias("r"))
    if mains.filter(F.size("concurrent_to") > 0).isEmpty():
        straight = stored(grouped(own.union(sides.select(F.explode(F.array_distinct("concurrent_to")).alias("capture_id"), "record_type", whole.alias("r")))), "captures")
        if straight.filter("response is null").isEmpty():
            return straight
        discard(straight)
    named = sides.select("record_id", F.explode("concurrent_to").alias("other"))
    names = mains.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id"))
    ids = mains.select(F.col("record_id").alias("capture_id"))
    forward = named.join(ids, named.other == ids.capture_id, "left")
    direct = forward.filter("capture_id is not null").select("record_id", "capture_id").union(names)
    through = forward.filter("capture_id is null").select("record_id", F.col("other").alias("via"))
    hop = through.join(direct.select(F.col("record_id").alias("via"), "capture_id"), "via").select("record_id", "capture_id")
    owner = direct.union(hop).distinct()
    attached = sides.join(owner, "record_id").select("capture_id", "record_type", whole.alias("r"))
    return grouped(own.union(attached))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures as page_id, payload_bytes, payload_digest, record_type, refers_to, capture_id: a
    revisit's payload is that of the response it refers to, found by its id."""
    rows = captures.select(
        "capture_id",
        F.col("metadata")[0]["fields"]["page-id"].cast("long").alias("page_id"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.coalesce("response.payload_digest", "response.declared_digest").alias("payload_digest"),
        F.size("metadata").alias("n_metadata"),
        F.col("request.target_uri").alias("target_uri"),
    )
    rows = stored(rows, "captures")
    found = rows.filter("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("other_bytes"))
    out = ["page_id", F.coalesce("own_bytes", "other_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "capture_id", "target_uri"]
    again = rows.filter("record_type = 'revisit'").join(found, "refers_id", "left").select(*out)
    alone = rows.filter("record_type = 'response'").select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("other_bytes"))
    return alone.select(*out).union(again)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads them back and assembles their captures: one row per row
    of pages, repeated rows and rows without page_id included; null html is an empty payload."""
    records = stored(read_archives(write_archives(pages, folder), with_payload=False), "records")
    found = resolve_revisits(assemble(records, with_payload=False))
    discard(records)
    return found
