"""WARC from legacy ARC archives: header lines by version, declared lengths, synthesised identity.

Pages are written as ARC records (version 1: five fields, version 2: ten), the
archives are parsed by the field list that their version block declares and by
the lengths that records declare, and each record becomes a WARC record with an
identifier, timestamp, type and digest made from what the ARC record holds.
Archives are lists of gzip members, one a record, kept as a binary column in the
shared folder, as only Spark's writers reach a cluster's store. ARC files are
read from any store (``read_arc_files``, plain or gzip), and WARC files written
to any (``write_warc_files``, one gzip stream a task) and read back
(``read_warc_files``, members or one stream).

Identifiers are version 8 UUIDs of page id, payload digest and, where a page id
is repeated, the number of the row: equal input gives equal archives, no two
records share an identifier, and a revisit's ``WARC-Refers-To`` names its page.

Defined cases: null html is an empty payload; a null url becomes ``urn:page``;
white space in urls is percent-encoded; null page ids are never the smallest; of
rows that repeat the smallest id of a payload all are responses; a page longer
than ARCHIVE_BYTES is whole, in an archive that ends with it; an empty table
gives an empty result; other columns are ignored. Archives that break off or
lie about lengths or digests raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, materialise, table

#: Shorter payloads are never revisited (the contract's value).
LEAST_PAYLOAD = 100
#: Field lists by version (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: ARC bytes that one archive may reach before the next begins.
ARCHIVE_BYTES = 4 << 20
#: Parts in which rows of one page id are numbered.
PARTS = 256
#: Pages carry no capture time; the archives say this one unless told otherwise.
CAPTURED = "20000101000000"
#: Header names, which may be written in any case, as used here.
_FIELDS = {x.lower(): x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "Content-Length")}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    content: bytes


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:page"


def write_arc(name: str, records: list[ArcRecord], version: int = 1) -> bytes:
    """An archive with its version block and these records."""
    def line(r: ArcRecord, offset: int) -> bytes:
        fields = [r.url, r.ip, r.date, r.kind]
        if version == 2:
            found = re.match(rb"HTTP/\S+ (\d{3})", r.content)
            fields += [found[1].decode() if found else "200", hashlib.md5(r.content).hexdigest(), "-", str(offset), name]
        return (" ".join([*fields, str(len(r.content))]) + "\n").encode()

    about = ArcRecord(f"filedesc://{name}", "0.0.0.0", records[0].date if records else CAPTURED, "text/plain",
                      f"{version} 0 cinderbox\n{ARC_FIELDS[version]}\n".encode())
    parts, size = [], 0
    for r in [about, *records]:
        parts += (head := line(r, size), r.content, b"\n")
        size += len(head) + len(r.content) + 1
    return b"".join(parts)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block, by the fields that it declares."""
    fields = ARC_FIELDS[1].split()
    at, first = 0, True
    while at < len(data):
        if data[at:at + 1] == b"\n":  # records are set apart by line ends
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line breaks off")
        line = data[at:end].rstrip(b"\r").decode()
        # the version block itself has the fields of the version that it declares
        declared = re.match(rb"([12]) \d+ [^\n]*\n([^\n]*)\n", data[end + 1:end + 400]) if first else None
        if declared:
            version = int(declared[1])
            fields = declared[2].decode().split()
            if fields != ARC_FIELDS[version].split():
                raise ValueError("unknown ARC fields")
        values = line.split(" ")
        if len(values) < len(fields):
            raise ValueError("too few ARC fields")
        spare = len(values) - len(fields)  # of urls with unescaped spaces
        values = [" ".join(values[:spare + 1]), *values[spare + 1:]]
        got = dict(zip(fields, values, strict=True))
        length = int(got["Archive-length"])
        content = data[end + 1:end + 1 + length]
        if len(content) < length:
            raise ValueError("an ARC record is shorter than declared")
        at = end + 1 + length
        if not (first and got["URL"].startswith("filedesc:")):
            yield ArcRecord(got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], content)
        first = False


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """A custom (version 8) UUID: whether there is an id, the id, and 57 bits of the digest, or of it and the row's number."""
    name = hashlib.sha256(f"{digest}:{copy}".encode()).hexdigest() if copy else digest
    bits = (page_id is not None) << 121 | ((page_id or 0) & (1 << 64) - 1) << 57 | int(name[:15], 16) >> 3
    x = bits >> 74 << 80 | 8 << 76 | (bits >> 62 & 0xFFF) << 64 | 2 << 62 | bits & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=x)}>"


def page_of(ident: str) -> int | None:
    """The page id inside a record's identifier."""
    x = uuid.UUID(ident.strip("<>")).int
    bits = x >> 80 << 74 | (x >> 64 & 0xFFF) << 62 | x & (1 << 62) - 1
    if not bits >> 121:
        return None
    page = bits >> 57 & (1 << 64) - 1
    return page - (1 << 64) if page >> 63 else page


def to_warc(r: ArcRecord, page_id: int | None, revisit: tuple[int, str, int] | None = None, copy: int = 0) -> bytes:
    """The WARC record of an ARC record; ``revisit``: page, url and number of the response that it repeats."""
    split = r.content.find(b"\r\n\r\n") + 4 if r.content.startswith(b"HTTP/") else 0
    if split == 3:
        raise ValueError("HTTP headers without end")
    digest = hashlib.sha256(memoryview(r.content)[split:]).hexdigest()
    block = r.content[:split] if revisit else r.content
    d = r.date
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha256:{digest}", f"Content-Type: {'application/http; msgtype=response' if split else r.kind}",
        f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(revisit[0], digest, revisit[2])}", f"WARC-Refers-To-Target-URI: {revisit[1]}"]
    return b"".join(["\r\n".join([*head, "", ""]).encode(), block, b"\r\n\r\n"])


def member(record: bytes) -> bytes:
    """One gzip member; archives are members in a row."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def members(archive: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What the gzip members hold; read in steps, so what follows a member is not copied with it."""
    view, at = memoryview(archive), 0
    while at < len(view):
        c, out = zlib.decompressobj(31), []
        while not c.eof and at < len(view):
            part = view[at:at + step]
            out.append(c.decompress(part))
            at += len(part) - len(c.unused_data)
        if not c.eof:
            raise ValueError("an archive breaks off")
        yield b"".join(out)


def read_warc(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """Headers, HTTP headers and payload of the record that begins here, checked against its length and digest, and where it ends."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at) or end < 0:
        raise ValueError("no WARC record")
    head = {}
    for line in re.sub(r"\r\n[ \t]+", " ", data[at:end].decode()).split("\r\n")[1:]:
        name, _, value = line.partition(":")
        head[_FIELDS.get(name.lower(), name)] = value.strip()
    after = end + 4 + int(head["Content-Length"])
    block = data[end + 4:after]
    if data[after:after + 4] != b"\r\n\r\n" or after > len(data):
        raise ValueError("a WARC record's length is wrong")
    split = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    payload = block[split:]
    declared = head.get("WARC-Payload-Digest", "")
    if head["WARC-Type"] == "response" and declared.startswith("sha256:") and declared[7:] != hashlib.sha256(payload).hexdigest():
        raise ValueError("a payload does not have its digest")
    return head, block[:split], payload, after + 4


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """All records that stand one after the other."""
    at = 0
    while at < len(data):
        head, http, payload, at = read_warc(data, at)
        yield head, http, payload


def numbered(pages: DataFrame) -> DataFrame:
    """page_id, url, html and ``copy``, which tells rows of one page id apart; 0 where the id is not repeated.

    Rows of repeated ids are numbered in parts, so that an id that very many rows share, as null may be, is not one task's.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    again = materialise(pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("page_id").alias("__again")), "again")
    if again.isEmpty():
        return pages.withColumn("copy", F.lit(0).cast("long"))
    same = F.col("page_id").eqNullSafe(F.col("__again"))
    part = F.pmod(F.xxhash64("url", "html"), F.lit(PARTS))
    rows = pages.join(again, same, "left_semi").withColumn("__part", part)
    nth = F.row_number().over(Window.partitionBy("page_id", "__part").orderBy("url", F.xxhash64("html")))
    return pages.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(
        rows.withColumn("copy", (nth.cast("long") - 1) * PARTS + F.col("__part")).drop("__part"))


def first_responses(pages: DataFrame) -> DataFrame:
    """For each payload of LEAST_PAYLOAD bytes or more that occurs again: __digest, __page, __url and __copy of its response."""
    x = pages.where(F.octet_length("html") >= LEAST_PAYLOAD).select(F.sha2(F.encode("html", "UTF-8"), 256).alias("__digest"), "page_id", "url", "copy")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("url"), F.col("copy")))
    return x.groupBy("__digest").agg(least.alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1 AND m.page_id IS NOT NULL").select(
        "__digest", F.col("m.page_id").alias("__page"), F.col("m.url").alias("__url"), F.col("m.copy").alias("__copy"))


def archives(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """Archive rows (name, archive) with a WARC record for each page, by way of ARC."""
    # written, so that the join knows its size: broadcast below Spark's threshold, else shuffled with skew handling
    x = numbered(pages)
    firsts = materialise(first_responses(x), "responses")
    x = x.withColumn("__key", F.when(F.octet_length("html") >= LEAST_PAYLOAD, F.sha2(F.encode("html", "UTF-8"), 256)))
    x = x.join(firsts, F.col("__key") == F.col("__digest"), "left").select(
        "page_id", "url", F.encode("html", "UTF-8").alias("html"), "copy", "__page", "__url", "__copy")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[ArcRecord, int | None, tuple[int, str, int] | None, int]] = []
        size, n = 0, 0

        def flush() -> pa.RecordBatch:
            arc = write_arc(f"part-{n}.arc", [r for r, *_ in held], 1 + n % 2)
            warc = b"".join(member(to_warc(r, page, revisit, copy)) for r, (_, page, revisit, copy) in zip(read_arc(arc), held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f"part-{n}.warc.gz"]), pa.array([warc], pa.binary())], names=["name", "archive"])

        for b in batches:
            for page, url, html, copy, first, first_url, first_copy in zip(*((x.as_py() for x in c) for c in b.columns), strict=True):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
                revisit = None if first is None or first == page else (first, clean_url(first_url), first_copy)
                held.append((ArcRecord(clean_url(url), "0.0.0.0", captured, "text/html", head + html), page, revisit, copy))
                size += len(html)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, n = [], 0, n + 1
        if held:
            yield flush()

    return x.mapInArrow(written, "name string, archive binary")


#: Columns of a record that is read.
RECORD = "page_id bigint, url string, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, date string, payload binary"


def _uuid_page(ident: str | None) -> int | None:
    """The page inside an identifier that is ours."""
    if not ident or "urn:uuid:" not in ident or uuid.UUID(ident.strip("<> ").split("urn:uuid:")[1]).version != 8:
        return None
    return page_of(ident.split("urn:uuid:")[1])


def records(stored: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of archive rows: headers as columns and, if asked for, the payload of responses."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split(" ")[0] for c in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for archive in (x.as_py() for x in b.column(0)):
                rows, size = [], 0
                for data in members(archive) if archive.startswith(b"\x1f\x8b") else [archive]:
                    for head, http, payload in warc_records(data):
                        if head["WARC-Type"] not in ("response", "revisit"):
                            continue
                        length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
                        whole = len(payload) if head["WARC-Type"] == "response" else int(length[1]) if length else None
                        rows.append((_uuid_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Record-ID"], head["WARC-Type"], whole,
                                     head.get("WARC-Payload-Digest", "").split(":")[-1], _uuid_page(head.get("WARC-Refers-To")), head["WARC-Date"], payload if payloads else None))
                        size += len(payload)
                        if size >= ARCHIVE_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return stored.select("archive").mapInArrow(read, RECORD)


# ---------------------------------------------------------------- files

def read_arc_files(spark, path: str) -> DataFrame:
    """The records of ARC files, plain or gzip: file, url, ip, date, kind, content. A file lies in one task's memory."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "url", "ip", "date", "kind", "content"]
        for b in batches:
            for file, content in zip(*((x.as_py() for x in c) for c in b.columns), strict=True):
                data = b"".join(members(content)) if content.startswith(b"\x1f\x8b") else content
                for r in read_arc(data):
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in (file, r.url, r.ip, r.date, r.kind)), pa.array([r.content], pa.binary())], names=names)

    with batch_rows(spark, 1):
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return files.mapInArrow(read, "file string, url string, ip string, date string, kind string, content binary")


def arc_to_warc(arcs: DataFrame) -> DataFrame:
    """A column ``record`` with the WARC record of each row of ``read_arc_files``; identifiers are of url, date and payload."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in (ArcRecord(*x) for x in zip(*((v.as_py() for v in c) for c in b.columns), strict=True)):
                named = int.from_bytes(hashlib.sha256(f"{r.url} {r.date}".encode()).digest()[:8], "big", signed=True)
                out.append(to_warc(ArcRecord(clean_url(r.url), r.ip, r.date, r.kind, r.content), named))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return arcs.select("url", "ip", "date", "kind", "content").mapInArrow(of, "record binary")


def write_warc_files(stored: DataFrame, path: str, column: str = "record") -> None:
    """WARC files (part-*.txt.gz) of records, or of archive rows (``column`` "archive"), in any store that Spark writes to.

    The text writer puts the records' end, two line ends, between them and compresses each file as one stream.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in (v.as_py() for v in b.column(0)):
                for record in members(x) if x.startswith(b"\x1f\x8b") else [x]:
                    yield pa.RecordBatch.from_arrays([pa.array([record.removesuffix(b"\r\n\r\n")], pa.binary())], names=["value"])

    lines = stored.select(column).mapInArrow(of, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_warc_files(spark, path: str, payloads: bool = True) -> DataFrame:
    """The responses and revisits of WARC files, gzip or plain. A file lies in one task's memory."""
    with batch_rows(spark, 1):
        return records(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")), payloads)


def op10_warc(spark, sf_dir):
    stored = materialise(archives(table(spark, sf_dir, "pages")), "warc")
    return records(stored, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
