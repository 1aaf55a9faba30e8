"""A converter from legacy ARC archives to WARC, with a writer and readers for both.

An ARC file is a series of records: a header line, a body of the length that the line
declares, a newline. A ``filedesc:`` record names the version, and the version the fields
of the lines behind it. The converter makes of each record what WARC 1.1 has in its place:
a record identifier, an ISO timestamp, a type, and digests of block and payload.

Archives are written with Spark's text writer, one row per record and the record separator
of the format as line separator, and read as whole files of bounded size, so they can lie
in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.session import work_dir

#: Payload bytes per archive file, about; a single larger record makes a larger file.
ARCHIVE_BYTES = 16 << 20
#: Bytes of parsed records that a task hands over at a time.
BATCH_BYTES = 8 << 20

# The fields of a header line, by version of the format.
V1_FIELDS = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2_FIELDS = (
    "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum",
    "Location", "Offset", "Filename", "Archive-length",
)
FIELDS = {1: V1_FIELDS, 2: V2_FIELDS}
_DATE = "20240101000000"
#: Archives are packed for speed.
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


# -- writing ARC ---------------------------------------------------------------------


def http_block(page_id: Column, html: Column) -> Column:
    """An HTTP response that carries the page, its id as a header."""
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
    )


def write_arc(pages: DataFrame, path: str, version: int, files: int) -> None:
    """Write ``page_id, url, html`` as ARC files of one version. NULL html is empty.

    White space in URLs is percent-encoded, a NULL or empty URL becomes ``about:blank``.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\s\x00-\x1f]", "%20")
    url = F.when(url == "", "about:blank").otherwise(url)
    block = http_block(F.col("page_id"), F.coalesce("html", F.lit("")))
    between = {1: "", 2: " 200 - - 0 -"}[version]
    line = F.concat(
        F.col("url"), F.lit(f" 0.0.0.0 {_DATE} text/html{between} "),
        F.octet_length("block").cast("string"), F.lit("\n"),
    )
    records = (
        pages.select("page_id", url.alias("url"), block.alias("block"))
        .withColumn("file", F.pmod(F.xxhash64("page_id", "url"), F.lit(files)).cast("int"))
        .select("file", F.lit(1).alias("at"), F.concat(line, "block").alias("record"))
    )
    body = f"{version} 0 tidings\n{' '.join(FIELDS[version])}\n"
    heads = pages.sparkSession.range(files).select(
        F.col("id").cast("int").alias("file"),
        F.lit(0).alias("at"),
        F.concat(
            F.lit("filedesc://"), F.col("id"),
            F.lit(f".arc 0.0.0.0 {_DATE} text/plain{between} {len(body)}\n{body}"),
        ).alias("record"),
    )
    (
        heads.unionByName(records)
        .repartitionById(files, F.col("file"))
        .sortWithinPartitions("at")
        .select("record")
        .write.options(lineSep="\n", **_GZIP)
        .text(path)
    )


# -- reading -------------------------------------------------------------------------


def unpack(content: bytes) -> bytes:
    """The bytes of a file, gzip members of which are inflated one after another."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        inflater = zlib.decompressobj(31)
        parts.append(inflater.decompress(content))
        content = inflater.unused_data
    return b"".join(parts) + content


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: the header fields by name, ``version`` and ``body``.

    The version block sets the fields of the lines behind it and is a record too. A line
    whose number of fields is another, or a body shorter than declared, raises: what lies
    behind a wrong length cannot be trusted.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        values = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        body = data[end + 1 : end + 1 + int(values[-1])]
        if len(body) != int(values[-1]):
            raise ValueError("an ARC record is shorter than its header declares")
        if values[0].startswith("filedesc:"):
            version = int(body.split(b" ", 1)[0])
        fields = FIELDS.get(version)
        if fields is None or len(values) != len(fields):
            raise ValueError(f"not a header line of ARC version {version}: {values}")
        yield dict(zip(fields, values)) | {"version": version, "body": body}
        at = end + 1 + len(body)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of every record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("not the start of a WARC record")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a WARC record is shorter than its header declares")
        yield fields, block
        at = end + 4 + size


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and payload of an HTTP response, or all as payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {n.strip().lower().decode(): v.strip().decode("utf-8", "replace") for n, _, v in pairs}, payload


def _files(spark, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("content")
    )


def _by_size(rows: Iterator[dict], schema: pa.Schema, size: str) -> Iterator[pa.RecordBatch]:
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += len(row[size] or b"") + 500
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


# -- converting ----------------------------------------------------------------------

_CONVERTED = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("uri", pa.string()),
        ("date", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("head_bytes", pa.int64()),
        ("block", pa.binary()),
    ]
)
_CONVERTED_SQL = (
    "page_id long, record_id string, uri string, date string, payload_bytes long,"
    " payload_digest string, head_bytes long, block binary"
)


def _equivalent(record: dict) -> dict:
    """What a WARC record of an ARC record has in its header."""
    d = record["Archive-date"].ljust(14, "0")
    fields, payload = _http(record["body"])
    page = fields.get("x-page-id", "")
    is_file = record["URL"].startswith("filedesc:")
    digest = sha1(payload)
    name = f"{record['URL']} {d} {page} {digest}"
    return {
        "page_id": int(page) if re.fullmatch(r"-?\d+", page) else None,
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        "uri": record["URL"],
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "payload_bytes": None if is_file else len(payload),
        "payload_digest": None if is_file else digest,
        "head_bytes": len(record["body"]) - len(payload),
        "block": record["body"],
    }


def read_arc(spark, path: str, blocks: bool = True) -> DataFrame:
    """Records of ARC files with their WARC equivalents; version blocks have no digest.

    Without ``blocks`` the column ``block`` is NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = (_equivalent(r) for r in parse_arc(unpack(content.as_py())))
                if not blocks:
                    rows = (row | {"block": None} for row in rows)
                yield from _by_size(rows, _CONVERTED, "block")

    return _files(spark, path).mapInArrow(run, _CONVERTED_SQL)


def convert(spark, source: str, target: str, files: int, min_bytes: int = 0) -> None:
    """Convert the ARC files below ``source`` to WARC files in ``target``.

    Of records with equal payloads of ``min_bytes`` or more, the one with the smallest page
    id becomes the response and the others revisits of it, which keep the HTTP header only.
    Smaller ones are all responses. Records that share the smallest id are all responses.
    """
    records = read_arc(spark, source)
    first = (
        read_arc(spark, source, blocks=False)
        .where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(
            # a record without a page id is never the one that others refer to
            F.min(
                F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "uri", "date"))
            ).alias("first"),
        )
        .withColumnsRenamed({"payload_digest": "_digest", "payload_bytes": "_bytes"})
    )
    same = (records["payload_digest"] == first["_digest"]) & (
        records["payload_bytes"] == first["_bytes"]
    )
    # one row per payload is hashed, so that the blocks need no sort
    joined = records.join(first.hint("shuffle_hash"), same, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    typed = joined.select(
        "page_id", "record_id", "uri", "date", "payload_digest",
        F.when(F.col("payload_digest").isNull(), "warcinfo")
        .when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("first.record_id")).alias("refers_to"),
        F.when(revisit, F.col("first.uri")).alias("refers_uri"),
        F.when(revisit, F.col("first.date")).alias("refers_date"),
        F.when(revisit, F.substr("block", F.lit(1), F.col("head_bytes").cast("int")))
        .otherwise(F.col("block")).alias("block"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = batch.schema.names, batch.columns
            rows = (
                {"record": warc_record({n: c[i].as_py() for n, c in zip(names, columns)})}
                for i in range(batch.num_rows)
            )
            yield from _by_size(rows, pa.schema([("record", pa.binary())]), "record")

    (
        typed.mapInArrow(run, "record binary")
        .select(F.col("record").cast("string"))
        .write.options(lineSep="\r\n\r\n", **_GZIP)
        .text(target)
    )


def warc_record(row: dict) -> bytes:
    """One WARC 1.1 record, without the separator behind it."""
    block = row["block"]
    kinds = {"warcinfo": "application/warc-fields", "revisit": "application/http;msgtype=response"}
    fields = [
        ("WARC-Type", row["type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["uri"] if row["type"] != "warcinfo" else None),
        ("WARC-Filename", row["uri"] if row["type"] == "warcinfo" else None),
        ("WARC-Payload-Digest", row["payload_digest"] and f"sha1:{row['payload_digest']}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Refers-To-Target-URI", row["refers_uri"]),
        ("WARC-Refers-To-Date", row["refers_date"]),
        (
            "WARC-Profile",
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
            if row["type"] == "revisit"
            else None,
        ),
        ("Content-Type", kinds.get(row["type"], "application/http;msgtype=response")),
        ("Content-Length", str(len(block))),
    ]
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields if value is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


_READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)
_READ_SQL = (
    "record_id string, record_type string, refers_to string, page_id long,"
    " payload_bytes long, payload_digest string, payload binary"
)


def read_warc(spark, path: str) -> DataFrame:
    """Responses and revisits of WARC files. Digests of blocks and payloads are checked.

    ``payload_bytes`` is the length of the full payload, also of a revisit, which holds
    none itself.
    """

    def rows(data: bytes) -> Iterator[dict]:
        for fields, block in parse_warc(data):
            if fields["warc-type"] not in ("response", "revisit"):
                continue
            if fields["warc-block-digest"] != f"sha1:{sha1(block)}":
                raise ValueError("a block differs from its digest")
            http, payload = _http(block)
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            response = fields["warc-type"] == "response"
            if response and sha1(payload) != digest:
                raise ValueError("a payload differs from its digest")
            page = http.get("x-page-id", "")
            yield {
                "record_id": fields["warc-record-id"],
                "record_type": fields["warc-type"],
                "refers_to": fields.get("warc-refers-to"),
                "page_id": int(page) if page else None,
                "payload_bytes": len(payload) if response else int(http["content-length"]),
                "payload_digest": digest,
                "payload": payload if response else None,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _by_size(rows(unpack(content.as_py())), _READ, "payload")

    return _files(spark, path).mapInArrow(run, _READ_SQL)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC of both versions and the converter, read back from the WARC files.

    Per row of ``page_id, url, html``: ``page_id``, ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to``, the page id of the response that a revisit names.
    NULL html is an empty payload, NULL ids and URLs are kept as such; a NULL id is never the
    smallest, and rows without an id are responses unless a row with one has their payload. Rows
    that repeat the smallest id of a payload are all responses. Other columns are not read; an empty table
    gives no row. Archives lie in the shared folder.
    """
    spark = pages.sparkSession
    base = work_dir(spark, "archives")
    pages = pages.select("page_id", "url", "html")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(1, -(-total // (2 * ARCHIVE_BYTES)))
    odd = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2)) == 1
    write_arc(pages.where(~odd), f"{base}/arc/v1", 1, files)
    write_arc(pages.where(odd), f"{base}/arc/v2", 2, files)
    convert(spark, f"{base}/arc", f"{base}/warc", 2 * files, min_bytes)
    read = read_warc(spark, f"{base}/warc").drop("payload")
    responses = (
        read.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to"))
        .agg(F.min("page_id").alias("first"))
    )
    return read.join(responses, "refers_to", "left").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("first").alias("refers_to"),
    )
