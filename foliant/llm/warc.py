"""WARC archives: writing, reading back, and resolving repeated payloads to revisit records.

Archives are WARC/1.1 with a gzip member for each record, written and read by
Spark's own sources, so any store that Spark reaches will do and lost tasks are
simply run again. Repeated payloads are resolved on headers alone: headers are
shuffled by digest, revisit records are written from them, and a payload moves
once, by its record's own id, to be left out if its record is a revisit. So a
payload that many pages share is never a join key of payloads. A null payload counts as empty.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import batched, cut, look_up

#: Date of records for which none is given.
DATE = "2024-01-01T00:00:00Z"
#: An archive file ends with the record that takes it to so many bytes.
ARCHIVE_BYTES = 32 << 20
END = "\r\n\r\n"


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are 8 groups of 20, each 5 hex or 4 base32 digits."""
    digest = F.sha1(content)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """record_id, url, payload (bytes), payload_bytes and payload_digest of every row."""
    payload = F.coalesce(pages[payload_col].cast("string").cast("binary"), F.lit(b""))
    return pages.select(pages[id_col].cast("long").alias("record_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload")).select(
        "record_id", "url", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )


def resolve(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """records with record_type and refers_to. Records are read several times, so give headers without payloads.

    Of records with one digest and length, of `least_bytes` at least, that with the least
    record_id is the response and the others revisit it; all smaller ones are
    responses. Records without an id, and repeats of the first id, are responses too.
    The first ids are combined before the shuffle, and digests that very many
    records share are looked up where the records are.
    """
    key = ["payload_digest", "payload_bytes"]
    first = (
        records.where((F.col("payload_bytes") >= least_bytes) & F.col("record_id").isNotNull())
        .groupBy(*key)
        .agg(F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
        .where("first_id < last_id")
        .select(*key, "first_id")
    )
    revisits = F.coalesce(F.col("first_id") < F.col("record_id"), F.lit(False))
    return look_up(records, first, key).select(
        *records.columns,
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def deduplicated(spark: SparkSession, records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers() rows with record_type and refers_to; payload is null for revisits.

    Rows of one id and payload are of one type, so revisits are told by both.
    Headers are kept in the shared folder; of payloads nothing is kept.
    """
    known = cut(spark, records.drop("payload"))
    revisits = resolve(known, least_bytes).where("record_type = 'revisit'")
    same = ["record_id", "payload_digest", "payload_bytes"]
    # The list of revisits grows with the corpus, so it is never broadcast, whatever its size here.
    responses = records.join(revisits.select(*same).hint("merge"), same, "left_anti").select(*records.columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits, allowMissingColumns=True)


def record_uri(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(record_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(r: DataFrame, date: str = DATE) -> Column:
    """A record with fresh headers, without the line ends after it: a revisit's block is empty, its digest and length are those of the full payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    # A line end within a url would end its header.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_uri(F.col("record_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_uri(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(END),
        F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")),
    )


def member(record: bytes) -> bytes:
    return gzip.compress(record, mtime=0)


def info(date: str = DATE) -> bytes:
    """The record that an archive begins with."""
    block = "format: WARC File Format 1.1\r\nsoftware: foliant\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}{END}{block}{END}".encode()


def write_archives(resolved: DataFrame, path: str, date: str = DATE, most_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records, as UTF-8, to archive files under `path`, each a warcinfo and records until it holds `most_bytes`.

    Each row that reaches Spark's text writer is one file. The writer ends it with
    `lineSep`, here the zero byte that ends a gzip member of under 16 MB;
    an empty member follows a last record whose own last byte differs.
    """

    def run(batches):
        archive = bytearray()

        def closed():
            if archive[-1]:
                archive.extend(member(b""))
            return pa.RecordBatch.from_arrays([pa.array([bytes(archive[:-1])], pa.binary())], names=["archive"])

        for batch in batches:
            for record in batch.column(0):
                archive.extend(b"" if archive else member(info(date)))
                archive.extend(member(record.as_py()))
                if len(archive) >= most_bytes:
                    yield closed()
                    archive.clear()
        if archive:
            yield closed()

    records = resolved.select(F.concat(record_text(resolved, date), F.lit(END)).cast("binary").alias("record"))
    archives = records.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of an archive, gzipped or not; one record is unpacked at a time."""
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {first[:20]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != END.encode():
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


_SCHEMA = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """record_id, url, record_type, refers_to, payload_digest, payload_bytes and, if asked for, block of every record under `path` but warcinfo."""
    schema = _SCHEMA if blocks else pa.schema(list(_SCHEMA)[:-1])

    def number(uri: str | None) -> int | None:
        found = (uri or "").rpartition(":")[2].rstrip(">")
        return int(found) if found.lstrip("-").isdigit() else None

    def run(batches):
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    for fields, block in parse(content.as_py()):
                        if fields.get("warc-type") == "warcinfo":
                            continue
                        row = (
                            number(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-type"), number(fields.get("warc-refers-to")),
                            fields.get("warc-payload-digest", "").rpartition(":")[2], int(fields.get("x-payload-length", fields["content-length"])),
                        )
                        yield (*row, block) if blocks else row

        yield from batched(rows(), schema, lambda row: 200 + (len(row[6]) if blocks else 0))

    ddl = "record_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", block binary" * blocks
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def payloads(records: DataFrame) -> DataFrame:
    """Records read back, with payload: a revisit's is that of the response that it refers to (null if there is none)."""
    same = [F.col("record_id").alias("original"), F.col("payload_digest").alias("original_digest")]
    responses = records.where("record_type = 'response'").select(*same, F.col("block").alias("original_block")).dropDuplicates(["original", "original_digest"])
    return records.join(responses, (records["refers_to"] == responses["original"]) & (records["payload_digest"] == responses["original_digest"]), "left").select(
        *(records[c] for c in records.columns if c != "block"),
        F.when(F.col("record_type") == "revisit", F.col("original_block")).otherwise(F.col("block")).alias("payload"),
    )
