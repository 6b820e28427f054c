import gzip
import hashlib

from pyspark.sql import functions as F

from veilspark.llm import warc
from veilspark.llm.common import shared_path, table

SF = "/root/testdata/sf0.001"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) by the rule on equal payloads."""
    top = {}
    for i, html in rows:
        if i is not None:
            top[html or ""] = max(i, top.get(html or "", i))
    out = []
    for i, html in rows:
        data, first = (html or "").encode(), top.get(html or "")
        revisit = first is not None and i != first
        out.append((-1 if i is None else i, len(data), warc.digest_of(data), "revisit" if revisit else "response",
                    first if revisit else -1))
    return sorted(out)


def got(frame):
    return sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type,
                   -1 if r.refers_to is None else r.refers_to) for r in frame.collect())


def test_query_equals_rule(spark):
    rows = [tuple(r) for r in table(spark, SF, "pages").select("page_id", "html").collect()]
    assert got(warc.op4_warc_salvage(spark, SF)) == plain(rows)


def test_odd_rows_round_trip(spark):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, None), (2, ""), (3, "same"), (4, "same"), (4, "same"), (5, trap), (6, "é\n" * 200000), (None, "same"),
            (None, "lone"), (9, "last\r\n")]
    pages = spark.createDataFrame([(i, None if i == 3 else "http://a/ b\r\nc", h, 1) for i, h in rows],
                                  "page_id long, url string, html string, sha int")
    path = shared_path(spark, "warc")
    warc.write_archives(pages, path, archive_bytes=100)
    found = warc.read_archives(spark, path)
    assert found.where("record_type = 'gap'").count() == 0
    assert got(found) == plain(rows)
    texts = {r.page_id: bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()}
    assert texts == {2: "", 4: "same", 5: trap, 6: "é\n" * 200000, None: "lone", 9: "last\r\n"}
    bounded = shared_path(spark, "warc")
    warc.write_archives(pages.where("page_id in (3, 4)"), bounded, min_bytes=5)
    assert {r.record_type for r in warc.read_archives(spark, bounded).collect()} == {"response"}
    empty = shared_path(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def records(n):
    return [warc.record(i, "http://a", f"page {i} ".encode() * 20, None, warc.digest_of(f"page {i} ".encode() * 20))
            for i in range(n)]


def test_salvage_after_every_damaged_byte():
    """One changed byte in the second of three records costs that record at most, and the log has its bytes."""
    one, two, three = records(3)
    data = one + two + three
    assert [r["page_id"] for r in warc.salvage(data)] == [0, 1, 2]
    for at in range(len(one), len(one) + len(two)):
        harmed = data[:at] + bytes([data[at] ^ 0x15]) + data[at + 1:]
        rows = list(warc.salvage(harmed))
        kept = [r["page_id"] for r in rows if r["record_type"] != "gap"]
        assert kept[0] == 0 and kept[-1] == 2
        assert sum(r["length"] for r in rows) == len(harmed)
        assert [r["offset"] for r in rows] == sorted(r["offset"] for r in rows)


def test_salvage_truncated_and_foreign_bytes():
    parts = records(3)
    data = b"junk" + parts[0] + parts[1][:-40] + b"\r\n" + parts[2] + b"tail"
    rows = list(warc.salvage_plain(data))
    assert [r["page_id"] for r in rows if r["record_type"] == "response"] == [0, 2]
    assert [(r["offset"], r["length"]) for r in rows if r["record_type"] == "gap"] == [
        (0, 4), (4 + len(parts[0]), len(parts[1]) - 38), (len(data) - 4, 4)]
    assert list(warc.salvage(b"")) == []


def test_salvage_gzip_members(spark, tmp_path):
    parts = [gzip.compress(r, mtime=0) for r in records(4)]
    harmed = bytearray(parts[1])
    harmed[len(harmed) // 2] ^= 0xFF
    data = parts[0] + bytes(harmed) + parts[2] + b"noise" + parts[3][:-2]
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("offset").collect()
    # the last member lacks the end of its checksum only, so its record is there
    assert [r.page_id for r in rows if r.record_type == "response"] == [0, 2, 3]
    assert [(r.offset, r.length) for r in rows if r.record_type == "gap"] == [
        (len(parts[0]), len(parts[1])), (len(data) - len(parts[3]) - 3, 5), (len(data) - len(parts[3]) + 2, len(parts[3]) - 2)]
    assert sum(r.length for r in rows if r.page_id != 3) == len(data)
    assert hashlib.sha1(bytes(rows[0].payload)).hexdigest() == hashlib.sha1(b"page 0 " * 20).hexdigest()


def test_null_ids_only_by_their_payload(spark):
    pages = spark.createDataFrame([(None, "a"), (None, "a")], "page_id long, html string").withColumn("url", F.lit("u"))
    path = shared_path(spark, "warc")
    warc.write_archives(pages, path)
    assert got(warc.read_archives(spark, path)) == [(-1, 1, warc.digest_of(b"a"), "response", -1)] * 2


def kept(data):
    return [r["page_id"] for r in warc.salvage(data) if r["record_type"] != "gap"]


def test_salvage_after_every_damaged_byte_of_gzip():
    """A changed byte costs the record of its member at most, wherever it stands, the first byte too."""
    parts = [gzip.compress(r, mtime=0) for r in records(3)]
    data = b"".join(parts)
    assert kept(data) == [0, 1, 2]
    for at in range(len(data)):
        harmed = data[:at] + bytes([data[at] ^ 0x15]) + data[at + 1:]
        hit = next(i for i in range(3) if at < sum(map(len, parts[:i + 1])))
        rows = [r for r in warc.salvage(harmed) if r["record_type"] != "gap"]
        assert [r["page_id"] for r in rows if not r["problem"] and r["page_id"] != hit] == [i for i in range(3) if i != hit], at
        assert len(rows) <= 3


def test_salvage_of_one_member_and_mixed_archives():
    plain_ones = records(5)
    one = gzip.compress(b"".join(plain_ones), mtime=0)
    for bad in (one[:-1], one[:-8] + b"\0" * 8, one[:-8]):  # the checksum is wrong or lacking
        assert kept(bad) == [0, 1, 2, 3, 4]
        assert [r["record_type"] for r in warc.salvage(bad)][-1] == "gap"
    noise = bytes(range(256)) * 40
    big = [warc.record(i, "u", hashlib.sha512(bytes([i])).digest() * 999, None, warc.digest_of(hashlib.sha512(bytes([i])).digest() * 999))
           for i in range(4)]
    cut = gzip.compress(b"".join(big), compresslevel=0, mtime=0)
    assert kept(cut[:len(cut) * 5 // 8]) == [0, 1]
    for start in (b"\x1f\x8b\x08", b"\x1f\x8b\x08" + noise, b"junk"):
        assert kept(start + b"".join(plain_ones)) == [0, 1, 2, 3, 4]
        assert kept(start + one + noise + plain_ones[0] + gzip.compress(plain_ones[1])) == [0, 1, 2, 3, 4, 0, 1]
    inner = gzip.compress(b"no record in here")
    holder = warc.record(7, "u", inner, None, warc.digest_of(inner))
    assert kept(b"x" + holder[:-2] + plain_ones[3]) == [3]


def test_valid_records_of_other_writers():
    body = b"hello"
    for digest in (f"sha256:{hashlib.sha256(body).hexdigest()}", f"sha1:{warc.digest_of(body).lower()}", f"SHA1:{hashlib.sha1(body).hexdigest().upper()}",
                   f"md5:{hashlib.md5(body).hexdigest()}", "blake9:whatever", warc.digest_of(body), "sha-256:" + hashlib.sha256(body).hexdigest()):
        made = (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:4>\r\nX-Long: one\r\n two\r\n\tthree\r\n"
                f"WARC-Payload-Digest: {digest}\r\nContent-Length: 5\r\n\r\n").encode() + body + b"\r\n\r\n"
        rows = list(warc.salvage(made + made))
        assert [r["record_type"] for r in rows] == ["resource", "resource"], digest
        assert {r["payload_digest"] for r in rows} == {warc.digest_of(body)}
        assert kept(made.replace(b"hello", b"hellp")) == ([4] if digest.startswith("blake9") else [])


def test_pages_that_are_not_utf8(spark):
    pages = spark.createDataFrame([(1, bytearray(b"a\xffb")), (2, bytearray("a\ufffdb".encode()))], "page_id long, html binary")
    path = shared_path(spark, "warc")
    warc.write_archives(pages.withColumn("url", F.expr("cast(html as string)")), path)
    want = plain([(1, "a\ufffdb"), (2, "a\ufffdb")])
    assert got(warc.read_archives(spark, path)) == want
