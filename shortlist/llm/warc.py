"""WARC archives: written, normalised to one gzip member a record, read back.

``write_archives`` writes one record for each page. Payloads are the pages'
html in UTF-8; of pages with equal payloads of ``MIN_REVISIT`` bytes or more
the one with the smallest id is a ``response`` record, the others are
``revisit`` records that name it and hold no payload. Spark's text writer
compresses each file as one gzip stream, as crawlers often leave them: no
record in it can be reached without inflating all that stands before.

``normalise`` inflates each such stream once, cuts it at the records' lengths
and writes every record as a gzip member of its own, so that a record can be
read from its offset alone. Each archive becomes a folder
``archive=<name>`` with ``part=records`` (the members; between two of them
stands an empty member, the writer's line separator, which inflates to
nothing) and ``part=index`` (the sidecar: one JSON line a record with offset,
length, type, page, digest). Both come from one pass, through Spark's own
committed writer: a lost executor's attempt leaves no file behind, and any
file system that Spark knows will do. ``read_archives`` walks the members and
holds them against the index; ``fetch`` reads single records by offset.

A task holds one archive's compressed bytes and one record, not the inflated
archive; ``RECORDS_PER_ARCHIVE`` bounds the archive that is written.

Defined results: a null html is an empty payload; a null url leaves the
target URI out; null ids come last among equal payloads (where all are null,
each is a response). Repeated rows with the smallest id are all responses: a
record does not revisit its own page. White space in a url is percent-encoded.
An empty table gives no archive and no rows. Extra columns are not read.
A malformed stream, a payload that differs from its digest, or a record that
the index does not have raises an error that names the archive.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm.common import HOT_SHARE, col
from shortlist.session import cut_lineage

#: Payloads of fewer bytes are always stored.
MIN_REVISIT = 100
RECORDS_PER_ARCHIVE = 20_000
#: Up to so many repeated payloads (some 100 bytes each) are broadcast.
BROADCAST_GROUPS = 500_000
LEVEL = 6
#: Pages carry no crawl date; a fixed one keeps archives equal between runs.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
#: A record ends with two line ends, and so does its header.
RECORD_END = END + END
INFLATE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member, equal for equal data (no time stamp)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# -- writing ---------------------------------------------------------------

def with_verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, and refers_to: the id
    of the page whose payload a page repeats, null for responses. Only digests
    and ids are shuffled; the pages meet the repeated digests by broadcast, the
    hot ones always, the others while they are few."""
    text = F.coalesce(col(html), F.lit(""))
    rows = pages.select(col(page_id).alias("page_id"), col(url).alias("url"), text.alias("html"),
                        F.sha2(text, 256).alias("payload_digest"),
                        F.octet_length(text).cast("bigint").alias("payload_bytes"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id")
    groups = cut_lineage(rows.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(
        F.min(order)["page_id"].alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    n, members = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    hot = F.col("n") > (members or 0) * HOT_SHARE
    if n <= BROADCAST_GROUPS:
        found = rows.join(F.broadcast(groups), "payload_digest", "left")
    else:
        at = F.broadcast(groups.filter(hot))
        rest = rows.join(at.select("payload_digest"), "payload_digest", "left_anti")
        found = rows.join(at, "payload_digest").unionByName(
            rest.join(groups.filter(~hot), "payload_digest", "left"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return found.select("page_id", "url", "html", "payload_digest", "payload_bytes", other.alias("refers_to"))


def _record_id(digest: Column, page: Column) -> Column:
    h = F.md5(F.concat_ws(":", digest, page.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _uri(url: Column) -> Column:
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def record(date: str = DATE) -> Column:
    """The record of a row of ``with_verdicts``, without its last line ends."""
    c, again = F.col, F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    c("payload_bytes").cast("string"), F.lit(RECORD_END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(c("html")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    def if_again(value: Column) -> Column:
        return F.when(again, value)

    return F.concat(
        F.lit(f"WARC/1.1{END}"), field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(c("payload_digest"), c("page_id"))), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", _uri(c("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), c("payload_digest"))),
        field("WARC-Profile", if_again(F.lit(REVISIT_PROFILE))),
        field("WARC-Refers-To", if_again(_record_id(c("payload_digest"), c("refers_to")))),
        field("X-Page-ID", F.url_encode(c("page_id").cast("string"))),
        field("X-Refers-To-Page-ID", F.url_encode(c("refers_to").cast("string"))),
        field("X-Payload-Bytes", c("payload_bytes").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Monolithic archives below ``path``: each file is one gzip stream."""
    with_verdicts(pages, page_id, url, html).select(record()).write.mode("overwrite").option(
        "compression", "gzip").option("lineSep", RECORD_END).option(
        "maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


# -- normalising -----------------------------------------------------------

def inflated(data: bytes) -> Iterator[bytes]:
    """The pieces of a gzip stream of one or several members."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the gzip stream ends within a member")
            piece = view[at:at + INFLATE_BYTES]
            out = unpack.decompress(piece, INFLATE_BYTES)
            while True:
                if out:
                    yield out
                if unpack.eof or not unpack.unconsumed_tail:
                    break
                out = unpack.decompress(unpack.unconsumed_tail, INFLATE_BYTES)
            at += len(piece) - len(unpack.unused_data)


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's header; names in lower case."""
    lines = head.decode("utf-8").split(END)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record with its line ends) of a gzip stream; no
    more than one record and one piece are held."""
    end, held, pieces = RECORD_END.encode(), bytearray(), inflated(data)

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        seen = 0
        while (cut := held.find(end, max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("the archive ends within a header")
        head = fields(bytes(held[:cut]))
        size = cut + len(end) + int(head["content-length"])
        if not fill(size + len(end)) or held[size:size + len(end)] != end:
            raise ValueError(f"record {head.get('warc-record-id')} does not end at its length")
        yield head, bytes(held[:size + len(end)])
        del held[:size + len(end)]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, content) of archives -> (archive, part, offset, value)."""
    def batch(name: str, part: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        at, values = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(rows)), pa.array([part] * len(rows)), pa.array(at, pa.int64()),
             pa.array(values, pa.binary())], ["archive", "part", "offset", "value"])

    gap = len(member(b""))
    for given in batches:
        for name, content in zip(given.column(0).to_pylist(), given.column(1)):
            rows, lines, at, held = [], [], 0, 0
            try:
                for head, whole in records(content.as_buffer()):
                    packed = member(whole)
                    lines.append(json.dumps({
                        "offset": at, "length": len(packed), "type": head["warc-type"],
                        "page": head.get("x-page-id"), "url": head.get("warc-target-uri"),
                        "digest": head.get("warc-payload-digest")}))
                    rows.append((at, packed))
                    at += len(packed) + gap
                    held += len(packed)
                    if held >= BATCH_BYTES:
                        yield batch(name, "records", rows)
                        rows, held = [], 0
            except (ValueError, KeyError, zlib.error) as error:
                raise ValueError(f"archive {name}: {error}") from error
            if rows:
                yield batch(name, "records", rows)
            if lines:
                yield batch(name, "index", [(0, member("".join(line + "\n" for line in lines).encode()))])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def normalise(spark: SparkSession, source: str, path: str) -> None:
    """Every gzip stream below ``source`` as an archive of single members with
    its sidecar index below ``path``. Sorted by offset within each archive, so
    that the writer keeps the order; nothing is shuffled."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[a-z]+)*$", 1)
    made = _files(spark, source).select(name.alias("archive"), "content").mapInArrow(
        _members, "archive string, part string, offset bigint, value binary")
    made.sortWithinPartitions("archive", "part", "offset").select(
        "archive", "part", F.col("value").cast("string").alias("value")).write.mode("overwrite").partitionBy(
        "archive", "part").option("encoding", "ISO-8859-1").option(
        "lineSep", member(b"").decode("latin-1")).text(path)


# -- reading ---------------------------------------------------------------

INDEX = "archive string, offset bigint, length bigint, type string, page string, url string, digest string"
RECORDS = ("archive string, offset bigint, length bigint, record_type string, page string, url string, "
           "payload_digest string, payload_bytes bigint, refers string, payload string")


def _part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """archive and content of the files of one kind; none if nothing was
    written. Names come from the path: partition columns would be typed by
    their looks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.filter(F.col("path").contains(f"/part={part}/")).select(
        F.regexp_extract("path", r"/archive=([^/]*)/part=", 1).alias("archive"), "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar rows of all archives below ``path``."""
    names = [f.strip().split(" ")[0] for f in INDEX.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = [json.loads(x) for x in b"".join(inflated(content.as_buffer())).splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(lines), pa.string())] +
                    [pa.array([x[n] for x in lines], pa.int64() if n in ("offset", "length") else pa.string())
                     for n in names[1:]], names)

    return _part(spark, path, "index").mapInArrow(rows, INDEX)


def one_record(packed: memoryview, payloads: bool = True) -> tuple:
    """The values of RECORDS after length, from a record's member. A response's
    payload is held against its digest."""
    (head, whole), = records(packed)
    block = whole[len(whole) - 4 - int(head["content-length"]):-4]
    payload = block.partition(RECORD_END.encode())[2]
    digest, size = head["warc-payload-digest"].partition(":")[2], int(head["x-payload-bytes"])
    if head["warc-type"] == "response":
        if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError(f"the payload of record {head['warc-record-id']} differs from its digest")
    else:
        payload = None
    text = payload.decode("utf-8") if payload is not None and payloads else None
    return (head["warc-type"], head.get("x-page-id"), head.get("warc-target-uri"), digest, size,
            head.get("x-refers-to-page-id"), text)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.strip().split(" ") for f in RECORDS.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, pa.int64() if kind == "bigint" else pa.string()) for v, (_, kind) in zip(zip(*rows), names)],
        [n for n, _ in names])


def walk(payloads: bool):
    """A function over (archive, content) that reads the members in turn."""
    gap = len(member(b""))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, out, held = memoryview(content.as_buffer()), 0, [], 0
                while at < len(data):
                    size = member_size(data[at:])
                    try:
                        out.append((name, at, size, *one_record(data[at:at + size], payloads)))
                    except (ValueError, KeyError, zlib.error) as error:
                        raise ValueError(f"archive {name}, offset {at}: {error}") from error
                    held += len(out[-1][-1] or "") + 200
                    at += size + gap
                    if held >= BATCH_BYTES:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    return rows


def member_size(data: memoryview) -> int:
    """Bytes of the gzip member with which ``data`` begins."""
    unpack, at = zlib.decompressobj(31), 0
    while not unpack.eof:
        if at >= len(data):
            raise ValueError("the archive ends within a member")
        piece = data[at:at + (64 << 10)]
        unpack.decompress(piece)
        at += len(piece) - len(unpack.unused_data)
    return at


def _typed(rows: DataFrame, id_type: str) -> DataFrame:
    def back(name: str) -> Column:
        return F.url_decode(F.col(name)).cast(id_type)

    return rows.select("archive", "offset", "length", back("page").alias("page_id"), "url", "payload_bytes",
                       "payload_digest", "record_type", back("refers").alias("refers_to"), "payload")


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """One row per record: archive, offset, length, page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload (null for
    revisits, or if not asked for). Each must stand in the index and each
    index row must have its record."""
    walked = _part(spark, path, "records").mapInArrow(walk(payloads), RECORDS)
    index = read_index(spark, path).select("archive", "offset", F.col("length").alias("__length"),
                                           F.col("digest").alias("__digest"))
    both = walked.join(index, ["archive", "offset"], "full")
    same = F.col("length").eqNullSafe(F.col("__length")) & F.concat(F.lit("sha256:"), "payload_digest").eqNullSafe(
        F.col("__digest"))
    error = F.raise_error(F.concat(F.lit("archive "), "archive", F.lit(" and its index differ at offset "),
                                   F.col("offset").cast("string")))
    return _typed(both.withColumn("archive", F.when(same, F.col("archive")).otherwise(error)), id_type)


def fetch(spark: SparkSession, path: str, wanted: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records of index rows (archive, offset, length), each read from its
    offset: only its own member is inflated. An archive meets the offsets that
    are wanted of it, at most ``RECORDS_PER_ARCHIVE``."""
    asked = wanted.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("at"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = memoryview(content.as_buffer())
                for x in at:
                    a, n = x["offset"], x["length"]
                    yield _batch([(name, a, n, *one_record(data[a:a + n]))])

    return _typed(_part(spark, path, "records").join(asked, "archive").mapInArrow(rows, RECORDS), id_type)


def round_trip(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
               html: str = "html", payloads: bool = False) -> DataFrame:
    """Writes, normalises and reads back the archives of ``pages``, in new
    folders below ``path``."""
    spark = pages.sparkSession
    kind = pages.select(col(page_id).alias("id")).schema["id"].dataType.simpleString()
    write_archives(pages, f"{path}/monolithic", page_id, url, html)
    normalise(spark, f"{path}/monolithic", f"{path}/normalised")
    return read_archives(spark, f"{path}/normalised", kind, payloads)
