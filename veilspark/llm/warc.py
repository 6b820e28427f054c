"""WARC archives: writing pages as records, and a reader that salvages what damaged archives still hold.

Writing. Each page is one WARC/1.1 record. Of the pages with equal payloads of at least ``min_bytes`` bytes the one with
the largest id is a ``response``, the others are ``revisit`` records that refer to it and hold no payload. Equal
payloads meet by their SHA-1 in an aggregate; only ids and digests are shuffled when the repeated digests are
few, and the pages themselves only where Spark finds them too many to broadcast. Spark's text writer stores the records, so any file system it knows
will do; archives hold as many records as make about ``archive_bytes`` bytes on average.

Reading. An archive is read whole by one task, so its size, which the writer bounds, bounds the memory. Plain data is parsed
record by record, gzip data member by member, and an archive may hold both. A record must have a version line, a content
length, the closing blank lines, and where it holds a payload its stated digest (a digest of an unknown kind says nothing). When a check
fails the reader looks for the next version line or gzip member, whatever the archive began with, goes on at the first that gives valid
records, and logs the bytes between as a quarantined gap. Later records are recovered wherever they start, and of a
damaged member those before the damage.

Results for odd input: a null html is an empty payload; empty payloads are equal like others; a null page id is written
without an id and never the largest one, and is read back as null; rows equal in id and payload are all
responses; bytes that are not UTF-8 are replaced by U+FFFD; a null or broken url is written as ``about:blank`` or cleaned of line ends; an empty table writes
an archive without records and reads as no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import cut, discard, shared_path, table

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 8_000_000
END = b"\r\n\r\n"
_NEXT = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record. A revisit states the payload's length and digest, but doesn't hold it."""
    revisit = refers_to is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]+', '%20', url) if url else 'about:blank'}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.insert(2, f"WARC-Record-ID: <urn:page:{page_id}>")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # the text writer closes each value with the record's last line end
        yield pd.DataFrame({"value": [
            record(int(i) if i else None, url, html, int(r) if r else None, base64.b32encode(bytes.fromhex(sha)).decode())
            .decode()[:-1] for i, url, html, r, sha in zip(*(batch[c] for c in ("id", "url", "html", "refers_to", "sha")))]})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write every page as a record into archives under ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(url_col).cast("string")).alias("url"),
                        F.coalesce(F.make_valid_utf8(F.col(html_col).cast("string")), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html") + 600).alias("bytes")).first()
    often = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(
        F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "last")
    known = cut(often, "repeated")
    marked = rows.join(known, "sha", "left").withColumn(
        "refers_to", F.when((F.octet_length("html") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last")))
    each = max(1, int((sizes["n"] or 0) * archive_bytes / max(1, sizes["bytes"] or 1)))
    lines = marked.select(F.col("id").cast("string").alias("id"), "url", F.col("html").cast("binary").alias("html"),
                          F.col("refers_to").cast("string").alias("refers_to"), "sha").mapInPandas(_records, "value string")
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", each).text(path)
    discard(known)


def agrees(label: str, payload: bytes) -> bool:
    """Whether a stated digest, in base 32 or 16 of either case, is the payload's; one of an unknown kind says nothing."""
    kind, colon, stated = label.rpartition(":")
    kind = kind.strip().lower().replace("-", "") if colon else "sha1"
    if not stated.strip() or kind not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return True
    own = hashlib.new(kind, payload, usedforsecurity=False)
    given = stated.strip().rstrip("=")
    return given.lower() == own.hexdigest() or given.upper() == base64.b32encode(own.digest()).decode().rstrip("=")


class Broken(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place, and the place after it."""
    if data[at:at + 10] not in (b"WARC/1.1\r\n", b"WARC/1.0\r\n"):
        raise Broken("no version line")
    head_end = data.find(END, at)
    if head_end < 0:
        raise Broken("headers without an end")
    fields, last = {}, None
    for line in data[at + 10:head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and last:  # a folded line
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        if not colon:
            raise Broken("bad header line")
        last = name.strip().lower().decode("latin-1")
        fields[last] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Broken("no content length")
    begin, end = head_end + 4, head_end + 4 + int(length)
    if data[end:end + 4] != END:
        raise Broken("record doesn't end where it says")
    block = data[begin:end]
    payload, stated = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, found, payload = block.partition(END)
        if not found:
            raise Broken("http headers without an end")
        sized = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", head)
        stated = int(sized.group(1)) if sized else len(payload)
    kind = fields.get("warc-type", "")
    label = fields.get("warc-payload-digest", "")
    digest = label.removeprefix("sha1:")
    if kind != "revisit":
        if stated != len(payload) or not agrees(label, payload):
            raise Broken("payload differs from its length or digest")
        digest = digest_of(payload)

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", fields.get(name, ""))
        return int(found.group(1)) if found else None

    return {"page_id": page("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"),
            "payload": None if kind == "revisit" else payload, "payload_bytes": stated, "payload_digest": digest,
            "refers_to": page("warc-refers-to"), "problem": None}, end + 4


def _gap(at: int, end: int, why: str) -> dict:
    return {"record_type": "gap", "offset": at, "length": end - at, "problem": why}


def salvage_plain(data: bytes, base: int = 0) -> Iterator[dict]:
    """Records of plain WARC data, and a gap row for every run of bytes that no record covers."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            found, end = parse_record(data, at)
        except Broken as failed:
            if lost is None:
                lost, why = at, str(failed)
            following = _NEXT.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost is not None:
            yield _gap(base + lost, base + at, why)
            lost = None
        yield found | {"offset": base + at, "length": end - at}
        at = end
    if lost is not None:
        yield _gap(base + lost, base + len(data), why)


def _header_end(data: bytes, at: int) -> int:
    """The place after a gzip member's header."""
    flags, end = data[at + 3] if at + 10 <= len(data) else 0, at + 10
    if flags & 4:
        end += 2 + int.from_bytes(data[end:end + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            zero = data.find(b"\0", end)
            end = zero + 1 if zero >= 0 else len(data)
    return end + (2 if flags & 2 else 0)


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(what the gzip member at a place holds up to any damage, the place reached, what is wrong)."""
    inflater, parts, step = zlib.decompressobj(-15), [], 1 << 16
    body = _header_end(data, at)
    rest = memoryview(data)[body:body + step]
    fed = body + len(rest)
    while not inflater.eof:
        if not len(rest):
            rest = memoryview(data)[fed:fed + (1 << 16)]
            fed += len(rest)
            if not len(rest):
                return b"".join(parts), len(data), "gzip member without an end"
        before = inflater.copy()
        try:
            parts.append(inflater.decompress(rest, step))
            rest = inflater.unconsumed_tail
        except zlib.error as failed:
            # what came before the damage is wanted to the last byte
            inflater, step = before, step // 2
            if not step:
                return b"".join(parts), fed - len(rest), str(failed)
    end = fed - len(inflater.unused_data)
    plain = b"".join(parts)
    if data[end:end + 8] != zlib.crc32(plain).to_bytes(4, "little") + (len(plain) & 0xFFFFFFFF).to_bytes(4, "little"):
        return plain, end, "gzip member differs from its checksum"
    return plain, end + 8, None


class Starts:
    """Places of the next gzip member and of the next version line, each looked for once."""

    def __init__(self, data: bytes):
        self.data, self.member, self.version = data, -1, -1

    def after(self, at: int, plain: int) -> int:
        """The next member from one place on, or version line from another on."""
        if self.member < at:
            found = self.data.find(_MEMBER, at)
            self.member = found if found >= 0 else len(self.data)
        if self.version < plain:
            found = _NEXT.search(self.data, plain)
            self.version = found.start() if found else len(self.data)
        return min(self.member, self.version)


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive, plain, compressed or mixed, and a gap row for every run of bytes that gave no whole record.

    A record in a member has the member's offset and length; gaps are in the bytes of the archive. Of a damaged member the
    whole records before the damage are kept, with what is wrong as their ``problem``, and the member is logged as a gap all the same.
    """
    starts, at, lost, why = Starts(data), 0, None, ""
    while at < len(data):
        found, end, problem, reached = [], None, None, at + 1
        if data[at:at + 3] == _MEMBER:
            plain, end, problem = _inflate(data, at)
            if problem:
                # the damage may also hide where the member ends, so members are looked for from its beginning on; a
                # stored member shows its records' lines, and those kept are not to be read again
                end, reached = None, end
            parts = list(salvage_plain(plain))
            found = [r | {"offset": at, "problem": problem} for r in parts if r["record_type"] != "gap"]
            reached = reached if found else at + 1
            if not found and not problem and plain:
                end, problem = None, "gzip member without records"
            elif not problem:
                found = [r | {"offset": at} for r in parts]
        else:
            try:
                one, end = parse_record(data, at)
                found = [one | {"offset": at}]
            except Broken as failed:
                problem = str(failed)
        after = starts.after(at + 1, reached) if end is None else end
        if lost is not None and (found or not problem):
            yield _gap(lost, at, why)
            lost = None
        for r in found:
            yield r | {"length": after - at}
        if problem and lost is None:
            lost, why = at, problem
        at = after
    if lost is not None:
        yield _gap(lost, len(data), why)


FIELDS = ("page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "offset", "length",
          "problem")
ROW = ("page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, "
       "refers_to long, archive string, offset long, length long, problem string")


def _read(payloads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[dict], path: str) -> pd.DataFrame:
            columns = {f: pd.Series([r.get(f) for r in rows], dtype=object) for f in FIELDS}
            return pd.DataFrame(columns | {"archive": path})

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[dict] = []
                size = 0
                for found in salvage(content):
                    size += len(found.get("payload") or b"") if payloads else 0
                    rows.append(found if payloads else {**found, "payload": None})
                    if len(rows) >= 2000 or size > 4_000_000:
                        yield frame(rows, path)
                        rows, size = [], 0
                yield frame(rows, path)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap (``record_type`` gap, with offset, length and the failed check)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(_read(payloads), ROW)


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives says."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False).where("record_type <> 'gap'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s FROM p),
m AS (SELECT s, max(page_id) AS top FROM d GROUP BY s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(d.s, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31
    AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d JOIN m ON d.s = m.s
"""
