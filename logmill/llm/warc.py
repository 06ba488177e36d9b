"""WARC archives: writing captures, and assembling transactions from records.

A capture is three records: the request, the response, and metadata. Request and
metadata name the response in ``WARC-Concurrent-To``. A response whose payload another
page has as well is written as a revisit that names that page's response instead of
repeating the payload. Records are gzip members of their own, so that archives can be
read from any record on and are read one record at a time.

``assemble`` joins records of any archives that link their records so: a record may name
the response or another record that does.
"""

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm import files
from logmill.llm.common import pieces, read_table, stored
from logmill.sources.shared import shared_folder

# Payloads from this size on are written once.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
# Records handed on at once, by their size; a larger record is handed on alone.
BATCH_BYTES = 4 << 20
_READ = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# Pages have no time of capture of their own.
_DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_FIELDS = (
    "record_id string, type string, target_uri string, concurrent_to array<string>, refers_to string, "
    "payload_digest string, http_head string, payload_bytes long, payload_sha1 string, fields map<string,string>"
)
RECORD = f"{_FIELDS}, payload binary"
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("target_uri", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("http_head", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_sha1", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)


def record_id(kind: str, number: int, page_id: int | None, url: str | None, digest: str) -> str:
    """``number`` tells rows apart that are equal."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, repr((kind, number, page_id, url, digest)))}>"


def one_line(text: str) -> str:
    """A URL with its blanks and control characters escaped."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One compressed record; headers without a value are left out."""
    digest = hashlib.sha1(block).hexdigest()
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None)]
    lines += [f"WARC-Date: {_DATE}", f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def capture_records(page: dict) -> list[bytes]:
    """Request, response or revisit, and metadata of a page row."""
    number, page_id, url, payload, digest = (page[k] for k in ("number", "page_id", "url", "payload", "digest"))
    own = record_id("response", number, page_id, url, digest)
    original = page["original"]
    uri = None if url is None else one_line(url)
    host, _, path = (uri or "").partition("://")[2].partition("/")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    answer = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": own,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if original is not None:
        answer["WARC-Profile"] = _PROFILE
        answer["WARC-Refers-To"] = record_id("response", original["number"], original["page_id"], original["url"], digest)
    linked = {"WARC-Target-URI": uri, "WARC-Concurrent-To": own}
    request = {
        "WARC-Type": "request",
        "WARC-Record-ID": record_id("request", number, page_id, url, digest),
        "Content-Type": "application/http; msgtype=request",
    }
    metadata = {
        "WARC-Type": "metadata",
        "WARC-Record-ID": record_id("metadata", number, page_id, url, digest),
        "Content-Type": "application/warc-fields",
    }
    fields = {"pageId": "" if page_id is None else page_id, "payloadBytes": len(payload)}
    return [
        record(request | linked, f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()),
        record(answer, http.encode() + (payload if original is None else b"")),
        record(metadata | linked, "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()),
    ]


def with_originals(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with ``number``, ``payload``, ``digest`` and, where another page's response has the
    same payload, that page as ``original``.

    ``pages`` is read twice and must have its rows in the same places, as stored tables do:
    ``number`` is a row's place.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("number"),
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    first = (
        rows.filter(large & F.col("page_id").isNotNull())
        .groupBy(F.col("digest").alias("shared"))
        .agg(F.max(F.struct("page_id", "url", "number")).alias("original"))
    )
    # Rows that cannot revisit get keys of their own, so that they spread.
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("number")))
    met = rows.withColumn("wanted", key).join(first, F.col("wanted") == F.col("shared"), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return met.select("number", "page_id", "url", "payload", "digest", F.when(other, F.col("original")).alias("original"))


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Archives of ``with_originals`` rows, as ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = stream = None
        size = 0
        for batch in batches:
            for piece in pieces(batch, "payload"):
                for page in piece.to_pylist():
                    if stream is None:
                        path, stream = files.open_output(folder, f"part-{TaskContext.get().partitionId():06d}")
                        size = 0
                    for data in capture_records(page):
                        stream.write(data)
                        size += len(data)
                    if size > ARCHIVE_BYTES:
                        stream.close()
                        yield pa.RecordBatch.from_pydict({"path": [path]})
                        stream = None
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return stored(captures.mapInArrow(run, "path string"), "archives")


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    data = stream.read(_READ)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise ValueError("archive ends within a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else stream.read(_READ)
        yield b"".join(parts)
        data = data or stream.read(_READ)


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, sep, v in (line.partition(":") for line in lines) if sep]


def parse_record(data: bytes) -> dict:
    """One record as a row of RECORD."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers: dict[str, list[str]] = {}
    for key, value in _fields(lines):
        headers.setdefault(key.lower(), []).append(value)
    one = lambda key: headers.get(key, [None])[0]
    block = rest[: int(one("content-length"))]
    kind, content = one("warc-type"), one("content-type") or ""
    digest = one("warc-payload-digest")
    row = dict.fromkeys(_ARROW.names) | {
        "record_id": one("warc-record-id"),
        "type": kind,
        "target_uri": one("warc-target-uri"),
        "concurrent_to": headers.get("warc-concurrent-to", []),
        "refers_to": one("warc-refers-to"),
        "payload_digest": digest and digest.partition(":")[2],
    }
    if content.startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        row["http_head"] = http.decode("utf-8", "replace")
        if kind == "response":
            row |= {"payload": payload, "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest()}
    elif content.startswith("application/warc-fields"):
        row["fields"] = _fields(block.decode("utf-8", "replace").split("\r\n"))
    else:
        row |= {"payload": block, "payload_bytes": len(block), "payload_sha1": hashlib.sha1(block).hexdigest()}
    return row


def read_records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the archives at ``path``; their payloads if wanted, else only what is
    told of them: ``payload_bytes`` and ``payload_sha1`` of what was read."""
    schema = _ARROW if payload else _ARROW.remove(_ARROW.get_field_index("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with files.open_input(path) as stream:
                    for data in members(stream):
                        row = parse_record(data)
                        rows.append({name: row[name] for name in schema.names})
                        size += len(data)
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    count = max(1, archives.count())
    return archives.repartition(count, "path").mapInArrow(run, RECORD if payload else _FIELDS)


def _roots(records: DataFrame, answers: DataFrame) -> DataFrame:
    """``linked``, ``root``: the response of every record from which links lead to one.

    A link counts both ways, whichever of the two records it is written in. Records that are
    as many links away from several responses belong to that of the smallest id. A round
    takes all records one link further; there are as many as the longest chain has links.
    """
    links = records.select(F.col("record_id").alias("one"), F.explode("concurrent_to").alias("other")).filter("one <> other")
    links = stored(links.union(links.select("other", "one")).distinct(), "links")
    known = front = answers.select(F.col("root").alias("linked"), "root")
    while True:
        near = links.join(front, F.col("other") == F.col("linked")).groupBy("one").agg(F.min("root").alias("root"))
        new = near.join(known.select("linked"), F.col("one") == F.col("linked"), "left_anti")
        front = stored(new.select(F.col("one").alias("linked"), "root"), "linked")
        if front.isEmpty():
            return known
        known = known.union(front)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id``, ``response``, ``request``, ``metadata``, ``others``.

    A capture is a response, revisit or resource record. The records that links by
    ``concurrent_to`` connect with it, over other records too and whichever side names the
    other, join it; of several requests or metadata records the one of the smallest id is
    taken, as a struct; further ones are counted in ``others``. A capture without them has
    NULL there, and records that lead to no capture are left out. Records of one id are one
    record: of several contents, the one whose fields come first in order. Payloads are in
    ``response`` if ``records`` has them.
    """
    answer = F.col("type").isin("response", "revisit", "resource")
    # Everything but the payloads, which are read only where they are handed on.
    slim = stored(records.drop("payload"), "records")
    small = slim.filter(~answer)
    answers = slim.filter(answer).select(F.col("record_id").alias("root")).distinct()
    roots = _roots(slim, answers)
    whole = F.struct("record_id", "target_uri", "http_head", "type", "concurrent_to", "fields_text")
    kinds = (
        small.withColumn("fields_text", F.to_json("fields"))
        .select("record_id", "type", whole.alias("it"))
        .join(roots, F.col("record_id") == F.col("linked"))
        .groupBy(F.col("root").alias("of"))
        .agg(
            F.min(F.when(F.col("type") == "request", F.col("it"))).alias("request"),
            F.min(F.when(F.col("type") == "metadata", F.col("it"))).alias("metadata"),
            F.countDistinct("record_id").alias("linked"),
        )
    )
    found = F.when(F.col("request").isNotNull(), 1).otherwise(0)
    found = found + F.when(F.col("metadata").isNotNull(), 1).otherwise(0)
    told = ["type", "target_uri", "refers_to", "payload_digest", "http_head", "payload_bytes", "payload_sha1"]
    if "payload" in records.columns:
        response = F.struct("record_id", *told, "payload").alias("response")
        once = records.filter(answer).select("record_id", response, F.struct(*told).alias("order"))
        once = once.groupBy("record_id").agg(F.min_by("response", "order").alias("response"))
    else:
        response = F.struct("record_id", *told).alias("response")
        once = slim.filter(answer).select("record_id", response).groupBy("record_id").agg(F.min("response").alias("response"))
    joined = once.join(kinds, F.col("record_id") == F.col("of"), "left")
    part = lambda name: F.when(
        F.col(name).isNotNull(),
        F.col(name).withField("fields", F.from_json(F.col(f"{name}.fields_text"), "map<string,string>")).dropFields(
            "fields_text"
        ),
    )
    return joined.select(
        F.col("record_id").alias("capture_id"),
        "response",
        part("request").alias("request"),
        part("metadata").alias("metadata"),
        (F.coalesce("linked", F.lit(0)) - found).alias("others"),
    )


def _field(name: str) -> Column:
    return F.col("metadata.fields")[name].try_cast("bigint")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say about each page.

    Every row is a capture of its own, also of those that are equal. A NULL id never is the
    response that others revisit. Size and digest of a response are those of the payload as
    it was read back, taken where it is read, so that payloads are shuffled once.
    """
    folder = shared_folder(spark, "warc")
    archives = write_archives(with_originals(read_table(spark, sf_dir, "pages")), folder)
    captures = assemble(read_records(archives, payload=False))
    held = F.col("response.type") == "response"
    narrow = stored(
        captures.select(
            "capture_id",
            _field("pageId").alias("page_id"),
            F.when(held, F.col("response.payload_bytes")).otherwise(_field("payloadBytes")).cast("bigint").alias("payload_bytes"),
            F.when(held, F.col("response.payload_sha1")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("named"),
        ),
        "captures",
    )
    # Only named responses are wanted; the others keep their own key and spread.
    wanted = F.coalesce("named", F.concat(F.lit("-"), F.col("capture_id")))
    responses = narrow.filter(F.col("record_type") == "response").select(
        F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to")
    )
    return narrow.withColumn("wanted", wanted).join(responses, F.col("wanted") == F.col("target"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# DuckDB's own SHA-1 of the UTF-8 bytes; equal digests are equal payloads.
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d),
r AS (SELECT *, payload_bytes >= {REVISIT_BYTES} AND last <> page_id AS again FROM w)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN last END AS refers_to FROM r
"""
