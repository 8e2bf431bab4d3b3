"""Operator 5: WARC files, read by a PySpark Python data source.

The writer is Spark's text writer with records as lines, so archives can go to any file system that Spark writes to. The source
plans a partition for each file, takes predicates on record type, record id and target, parses a
record's headers first and seeks over payloads that nobody asked for.
"""

from __future__ import annotations

import gzip
import io
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from quern.llm.storage import Workspace, small

EOL = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal string of a multiple of five digits: each five digits are four characters."""
    parts = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def payload_digest(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def plan_records(spark: SparkSession, pages: DataFrame, least_bytes: int, work: Workspace) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for a response).

    Of rows with equal payloads of at least `least_bytes`, those with the largest page_id are responses and the others revisit it;
    rows that repeat that page_id are all responses. Rows without a page_id revisit too; if none of equal rows has one, all
    are responses. A null html is an empty payload. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("n_bytes", F.octet_length("payload"))
    groups = rows.where(F.col("n_bytes") >= least_bytes).groupBy(F.col("digest").alias("kept_digest"), F.col("n_bytes").alias("kept_bytes")).agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n"))
    repeated = work.table(groups.where("n > 1 AND kept_id IS NOT NULL").drop("n"), "repeated")
    same = (F.col("digest") == F.col("kept_digest")) & (F.col("n_bytes") == F.col("kept_bytes"))
    joined = rows.join(small(repeated, repeated.count()), same, "left")
    revisits = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("kept_id")).alias("refers_to"))


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC record, without the line break that ends it, as text."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    safe = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(EOL + EOL))
    response = refers_to.isNull()
    body = F.when(response, F.concat(http, payload)).otherwise(http)
    head = [
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit(f"{EOL}WARC-Record-ID: "), urn(page_id),
        F.lit(f"{EOL}WARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit(f"{EOL}WARC-Target-URI: "), safe), F.lit("")),
        F.lit(f"{EOL}WARC-Payload-Digest: sha1:"), digest,
        F.when(response, "").otherwise(F.concat(F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), urn(refers_to))),
        F.lit(f"{EOL}Content-Type: application/http; msgtype=response{EOL}Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(EOL + EOL),
    ]
    return F.concat(*head, body, F.lit(EOL))


def write_warc(spark: SparkSession, pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "none") -> None:
    """One record for each row of `pages` (page_id, url, html), in files under `path`. An empty table gives no records."""
    planned = plan_records(spark, pages, least_bytes, Workspace(spark, "warc-plan"))
    lines = planned.select(record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers_to")).alias("value"))
    lines.write.option("lineSep", EOL).option("compression", compression).text(path)


SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, http_length long, block_length long, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("http_length", pa.int64()), ("block_length", pa.int64()), ("payload", pa.binary())])
#: Columns that a predicate is pushed down to, with the header each is from.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri"}
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
#: Bytes read at a time from a block to find the end of its HTTP headers when its payload isn't wanted.
HEAD_BYTES = 4096


@dataclass
class WarcFile(InputPartition):
    uri: str
    path: str


def _headers(stream) -> dict[str, str] | None:
    """The headers of the next record; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _http_head(stream, length: int) -> bytes:
    """The start of a block of `length` bytes, with the blank line that ends its HTTP headers; all of the block if there is none."""
    block = bytearray()
    while len(block) < length and (more := stream.read(min(HEAD_BYTES, length - len(block)))):
        seen = max(0, len(block) - 3)
        block += more
        if block.find(b"\r\n\r\n", seen) >= 0:
            break
    return bytes(block)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value}
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = set(f.value)
            else:
                yield f
                continue
            header = HEADERS[f.attribute[0]]
            self.wanted[header] = self.wanted.get(header, values) & values

    def partitions(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [WarcFile(self.uri, f.path) for f in found if f.is_file and f.size and not re.match(r"[._]", f.base_name)]

    def read(self, partition):
        from pyarrow import fs

        if partition is None:
            return
        system, _ = fs.FileSystem.from_uri(partition.uri)
        rows, held = [], 0
        with system.open_input_file(partition.path) as raw:
            stream = gzip.open(raw) if partition.path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            while (head := _headers(stream)) is not None:
                length = int(head.get("content-length", 0))
                if any(head.get(name, "") not in values for name, values in self.wanted.items()):
                    stream.seek(length, io.SEEK_CUR)
                    continue
                block = stream.read(length) if self.with_payload else _http_head(stream, length)
                if len(block) < length:
                    stream.seek(length - len(block), io.SEEK_CUR)
                http, _, payload = block.partition(b"\r\n\r\n")
                size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
                rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("warc-refers-to"), int(size[1]) if size else None, length, payload if self.with_payload else None))
                held += len(block)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcSource(DataSource):
    """Format `warc`. Options: path (of a folder; any file system that pyarrow opens), payload ("false": payloads stay null, unread)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under `path`. Equality and IN on record_id, record_type and target_uri are applied to the headers in the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def page_of(urn: Column) -> Column:
    """The page id in a record id; null if there is none."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op5_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "warc").new_path("archives")
    write_warc(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    responses = read_warc(spark, path).where("record_type = 'response'")
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    page = page_of(F.col("record_id")).alias("page_id")
    kept = responses.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), payload_digest(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = revisits.select(page, F.col("http_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"))
    return kept.unionByName(again)


_CHARS = " || ".join(f"substr('{ALPHABET}', (((('0x' || substr(d, {5 * k + 1}, 5))::BIGINT >> {s}) & 31) + 1)::INT, 1)" for k in range(8) for s in (15, 10, 5, 0))
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT html, max(page_id) AS kept FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM kept OR kept IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM kept OR kept IS NULL THEN NULL ELSE kept END AS refers_to
FROM p JOIN k ON p.html = k.html
"""
