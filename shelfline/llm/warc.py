"""Web pages as WARC archives, and archives back as one nested row per capture.

`write_archives` writes three records a page, each linked to the response by
WARC-Concurrent-To: the request, the response (or, for a payload that a page
with a larger id has too, a revisit that refers to it) and a metadata record
with the page's id. Records are put together by Spark's functions and written
by its text writer, whose line separator is the end of a record: an archive is
one gzip file per partition, by Spark's commit protocol, in any store.

`read_records` frames the records of archives again, by their Content-Length.
Archives are gzip files, as one member or one per record; a file is read line
by line, so a task holds one record, not an archive. `captures` assembles
transactions: requests and metadata records find their response through the
identifiers of WARC-Concurrent-To, in either direction and over one record
between them, on rows without payloads.

A null html is an empty payload, a null url an absent WARC-Target-URI, a null
page_id an absent line of the metadata; white space and control characters of
a url are written as %20. Among equal payloads a null page_id is least; without
any id all of them are responses. Rows equal to the one with the largest id in
id and url are responses, too: repeated rows stay. Payloads of any length are
whole. Records cut short, with a payload that does not match its digest, or
bytes between records come back marked `damaged`. A request or metadata record
without a response makes a capture of its own. Records with one identifier are
one record, but each response keeps its row. An empty table gives empty
archives and results. Only the named columns are read, so others may have any
name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.text import small, stored

END = "\r\n"
RECORD_END = END * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The alphabet of base32, and the digits that `conv` gives.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# Copies of one payload, and references to one response, are dealt over so many keys.
SALTS = 64
# A capture with more linked records than this goes on in further rows.
CAPTURE_RECORDS = 10_000

ROOTS = ("response", "revisit", "resource")
LINKED = ("request", "metadata")


def base32(digest: Column) -> Column:
    """A hex SHA-1 in base32: 160 bits are eight times five hex or four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _record_id(kind: str, *names: Column) -> Column:
    """A name-based identifier, so that a record can be referred to unseen."""
    # A null and an empty name differ, and no name runs over into the next.
    parts = [F.coalesce(F.concat(F.length(name.cast("string")), F.lit(":"), name.cast("string")), F.lit("-")) for name in names]
    digest = F.md5(F.concat_ws(" ", F.lit(kind), *parts))
    part = lambda start, length: F.substring(digest, start, length)
    uuid = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def _record(kind: Column, fields: dict[str, Column], block: Column) -> Column:
    """A record's text without its end; null fields are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    head = F.concat_ws(END, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(head, F.lit(RECORD_END), block)


def _with_last(pages: DataFrame) -> DataFrame:
    """The pages with the id and url of the last page of equal payload, where
    there are several.

    Counting goes by (digest, salt) first and the answer comes back by the same
    key, so a payload that many pages have is not one key. Pages meet only the
    repeated digests; where these are few, Spark broadcasts them by their size.
    """
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    parts = salted.groupBy("digest", "salt").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count(F.lit(1)).alias("n"))
    # At most SALTS entries are collected of a digest.
    whole = parts.groupBy("digest").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    several = whole.where("n > 1 AND last.page_id IS NOT NULL")
    repeated = several.select("digest", F.explode("salts").alias("salt"), F.col("last.page_id").alias("last_id"), F.col("last.url").alias("last_url"))
    return salted.join(stored(repeated, "payloads"), ["digest", "salt"], "left")


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write `pages` (page_id, url, html) as archives; `date` is the capture's."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    page = _with_last(chosen).withColumn("base32", base32(F.col("digest")))
    revisit = F.col("last_id").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("last_id")) & F.col("url").eqNullSafe(F.col("last_url")))
    address = lambda name: F.regexp_replace(name, r"[\x00-\x20\x7F]", "%20")
    own = [F.col("page_id"), F.col("url"), F.col("digest")]
    response_id = _record_id("response", *own)
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": address("url")}
    linked = {**common, "WARC-Concurrent-To": response_id}
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload"), F.lit(RECORD_END))
    host = F.regexp_extract(address("url"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(address("url"), F.lit("/")), F.lit(f" HTTP/1.1{END}Host: "), F.coalesce(host, F.lit("")), F.lit(RECORD_END))
    request = _record(F.lit("request"), {"WARC-Record-ID": _record_id("request", *own), **linked, "Content-Type": F.lit("application/http; msgtype=request")}, asked)
    only_revisit = lambda value: F.when(revisit, value)
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        {
            "WARC-Record-ID": response_id,
            **common,
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("base32")),
            "WARC-Profile": only_revisit(F.lit(PROFILE)),
            "WARC-Refers-To": only_revisit(_record_id("response", F.col("last_id"), F.col("last_url"), F.col("digest"))),
            "WARC-Refers-To-Target-URI": only_revisit(address("last_url")),
            "Content-Type": F.lit("application/http; msgtype=response"),
        },
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    about = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id"), F.lit(END)), F.lit(""))
    metadata = _record(F.lit("metadata"), {"WARC-Record-ID": _record_id("metadata", *own), **linked, "Content-Type": F.lit("application/warc-fields")}, about)
    written = page.select(F.concat_ws(RECORD_END, request, response, metadata).alias("value"))
    written.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


RECORDS = (
    "archive string, record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, "
    "refers_to string, payload_digest string, payload_bytes long, http_head string, block binary, damaged boolean"
)
_FIELDS = pa.schema(
    [("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string())]
    + [("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    + [("http_head", pa.string()), ("block", pa.binary()), ("damaged", pa.bool_())]
)
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")
_ROWS_BYTES = 8 << 20


def _parsed(archive: str | None, head: list[tuple[str, str]], block: bytes, damaged: bool) -> tuple:
    fields = {name.lower(): value for name, value in reversed(head)}
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size, http = None, None
    if kind in ROOTS and fields.get("content-type", "").startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
        if kind == "revisit":
            told = _LENGTH.search(top)
            size = int(told[1]) if told else None
    if kind in ("response", "resource"):
        found = base64.b32encode(hashlib.sha1(block).digest()).decode()
        damaged = damaged or (digest is not None and digest != found and ":" not in digest)
        size, digest = len(block), found
    linked = [value for name, value in head if name.lower() == "warc-concurrent-to"]
    named = (fields.get(name) for name in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date"))
    return archive, *named, linked, fields.get("warc-refers-to"), digest, size, http, block, damaged


def _framed(lines: Iterator[tuple[bytes, str | None]]) -> Iterator[tuple]:
    """The records of a stream of lines; archives end with a whole record, so
    one archive after another is a stream like any."""
    archive, head, parts, size, need = None, None, [], 0, None
    for line, named in lines:
        if head is None:
            if line.startswith(b"WARC/"):
                if parts:
                    yield _parsed(archive, [], b"\n".join(parts), True)
                archive, head, parts = named, [], []
            elif line not in (b"\r", b"") or parts:
                parts.append(line)
            continue
        if need is None:
            if line not in (b"\r", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head.append((name.strip(), value.strip()))
                continue
            told = next((value for name, value in head if name.lower() == "content-length"), "")
            need, size = int(told) if told.isdecimal() else 0, 0
        else:
            parts.append(line)
            size += len(line) + 1
        if size >= need:
            data = b"".join(part + b"\n" for part in parts)
            yield _parsed(archive, head, data[:need], data[need:] not in (b"", b"\r\n", b"\n"))
            head, parts, need = None, [], None
    if head is not None or parts:
        yield _parsed(archive, head or [], b"\n".join(parts), True)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip archives under `path`. `block` is the payload of
    what came over HTTP and the whole block of other records; digests and
    sizes of payloads are those of the bytes read, for revisits those stated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple[bytes, str | None]]:
            for batch in small(batches):
                yield from zip(batch.column("line").to_pylist(), batch.column("archive").to_pylist())

        rows, size = [], 0
        for row in _framed(lines()):
            rows.append(row)
            size += len(row[10]) + 500
            if size > _ROWS_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    named = F.when(F.col("value").startswith("WARC/"), F.col("_metadata.file_path"))
    return raw.select(F.col("value").cast("binary").alias("line"), named.alias("archive")).mapInArrow(run, RECORDS)


# What a capture holds of its requests and metadata records.
PART = ("record_id", "target_uri", "date", "block", "damaged")


def _owners(records: DataFrame) -> DataFrame:
    """record_id, root: linked records and the responses they belong to."""
    of = lambda kinds: records.where(F.col("record_type").isin(*kinds))
    roots = of(ROOTS).select(F.col("record_id").alias("root")).distinct()
    named = of(LINKED).select("record_id", F.explode("concurrent_to").alias("other"))
    naming = of(ROOTS).select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("other"))
    links = stored(named.union(naming).join(roots, F.col("other") == F.col("root"), "left"), "links")
    near = links.where("root IS NOT NULL").select("record_id", "root")
    over = links.where("root IS NULL").select("record_id", "other").join(near.withColumnRenamed("record_id", "other"), "other")
    return near.union(over.select("record_id", "root")).distinct()


def _assembled(records: DataFrame, owners: DataFrame) -> DataFrame:
    sizes = owners.groupBy("root").count().where(F.col("count") > CAPTURE_RECORDS)
    # At most one row for CAPTURE_RECORDS records; Spark broadcasts it by its size.
    sizes = stored(sizes.select("root", F.ceil(F.col("count") / CAPTURE_RECORDS).alias("pieces")), "sizes")
    last_piece = F.coalesce(F.col("pieces"), F.lit(1)) - 1
    dealt = owners.join(sizes, "root", "left").select("record_id", "root", F.pmod(F.xxhash64("record_id"), last_piece + 1).alias("piece"))
    linked = records.where(F.col("record_type").isin(*LINKED)).select("record_type", *PART).join(dealt, "record_id", "left")
    # Equal records are one; they fold before the shuffle.
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("record_type") == kind, F.struct(*PART))))
    own = F.coalesce("root", "record_id").alias("root"), F.coalesce("piece", F.lit(0)).alias("piece")
    around = linked.select(*own, "record_type", *PART).groupBy("root", "piece").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    roots = records.where(F.col("record_type").isin(*ROOTS)).withColumn("root", F.col("record_id")).join(sizes, "root", "left")
    spread = roots.select("root", F.explode(F.sequence(F.lit(0).cast("long"), last_piece)).alias("piece"), *records.columns)
    joined = spread.join(around, ["root", "piece"], "full")
    # A bare struct, so that payloads nobody asks for stay out of the shuffle.
    return joined.select(F.col("root").alias("capture_id"), F.struct(*records.columns).alias("response"), "requests", "metadata")


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: `response` (a record, all fields null if
    there is none), `requests` and `metadata` (arrays of records, null if
    nothing is linked). A capture with more than `CAPTURE_RECORDS` linked records takes further rows that repeat
    the response."""
    return _assembled(records, _owners(records))


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of archives under `path` with the page's id out of their
    metadata and, for revisits, the id of the page they refer to.

    The references are answered by (response, salt), so a response that many
    revisits name is not one key.
    """
    records = stored(read_records(spark, path), "records", compression="zstd")
    owners = stored(_owners(records), "owners")
    page_id = lambda block: F.regexp_extract(block.cast("string"), r"(?m)^page_id: (-?[0-9]+)\r?$", 1).try_cast("long")
    told = records.where("record_type = 'metadata'").select("record_id", page_id(F.col("block")).alias("refers_to_page"))
    pages = told.where("refers_to_page IS NOT NULL").join(owners, "record_id").groupBy(F.col("root").alias("target")).agg(F.max("refers_to_page").alias("refers_to_page"))
    revisits = records.where("refers_to IS NOT NULL").select(F.col("record_id").alias("capture_id"), F.col("refers_to").alias("target"))
    salted = revisits.distinct().withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)))
    answers = salted.select("target", "salt").distinct().join(pages, "target")
    referred = stored(salted.join(answers, ["target", "salt"]).select("capture_id", "refers_to_page"), "references")
    found = _assembled(records, owners).withColumn("page_id", page_id(F.col("metadata")[0]["block"]))
    return found.join(referred, "capture_id", "left")
