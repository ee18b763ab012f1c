"""WARC archives: written by Spark, read by a Python data source.

The source plans partitions of whole files. It takes predicates on the record type, the other header
fields and the content length from Spark, parses each header first, and skips the content of records that
do not pass without reading or decoding it; with the option `payload=false` it skips all contents.

A record is damaged if its content ends early, its length is no number, or what follows the record before does
not begin one. `damaged=fail`, the default, ends the read with an error that names the file. With `damaged=keep` it
becomes a row whose `fault` says what is wrong, and reading goes on at the next line that begins a record.
Header bytes that are not UTF-8 are read as replacement characters.

Writing: of records with equal payloads of at least `least` bytes, that with the largest id becomes the
response and the others revisit it without a payload. Payloads count as equal when SHA-1 and length are.
Only digest, length and id are shuffled to find them.

Edge cases: a null payload is empty; rows that repeat the largest id of their payload are responses, too;
a null id is smaller than any other, and rows with null ids alone are responses; a null or empty address
is left out; an empty table gives an archive without records.
"""

import gzip
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
                                    LessThanOrEqual, StringStartsWith)

from tidewatch.plans.durable import written

SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, "
          "payload_digest string, content_length long, headers map<string,string>, payload binary, "
          "fault string")
# The header field behind each column.
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
          "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
ARROW = pa.schema([*[(c, pa.string()) for c in FIELDS], ("content_length", pa.int64()),
                   ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
                   ("fault", pa.string())])
_NONE = dict.fromkeys(ARROW.names)
ID = "urn:record:"
#: What one Arrow batch holds at most: records, and bytes of payload.
BATCH_RECORDS, BATCH_BYTES = 1000, 8 << 20

_TESTS = {
    EqualTo: lambda value, wanted: value == wanted, In: lambda value, wanted: value in wanted,
    GreaterThan: lambda value, wanted: value > wanted, LessThan: lambda value, wanted: value < wanted,
    GreaterThanOrEqual: lambda value, wanted: value >= wanted,
    LessThanOrEqual: lambda value, wanted: value <= wanted,
    StringStartsWith: lambda value, wanted: value.startswith(wanted)}


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


def _filesystem(path: str):
    from pyarrow.fs import FileSystem
    if path.startswith("file:/"):
        path = "file:///" + path[len("file:"):].lstrip("/")
    return FileSystem.from_uri(path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.decode = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", 32 << 20))
        self.keep_damaged = options.get("damaged", "fail").lower() == "keep"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = len(f.attribute) == 1 and (
                f.attribute[0] in FIELDS or f.attribute[0] == "content_length")
            if known and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType
        system, top = _filesystem(self.path)
        found = sorted((f.path, f.size) for f in system.get_file_info(FileSelector(top, recursive=True))
                       if f.type == FileType.File and not f.base_name.startswith(("_", ".")))
        out, names, size = [], [], 0
        for name, bytes_ in found:
            if names and size + bytes_ > self.partition_bytes:
                out.append(Files(tuple(names)))
                names, size = [], 0
            names.append(name)
            size += bytes_
        return [*out, Files(tuple(names))]

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if value is None or (type(f) in _TESTS and not _TESTS[type(f)](value, f.value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        rows, size = [], 0
        for name in partition.names:
            with system.open_input_file(name) as raw:
                if name.endswith(".gz"):
                    stream, skip = gzip.open(raw), _skip_packed
                else:
                    stream, skip = io.BufferedReader(raw, 1 << 20), partial(_skip_plain, raw.size())
                for row in self.records(stream, skip):
                    if row["fault"] and not self.keep_damaged:
                        raise ValueError(f"{name}: {row['fault']}")
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def records(self, stream, skip=None) -> Iterator[dict]:
        """Records that are wanted, and damaged ones. `skip(stream, length)` passes over the content of others
        and says whether all of it was there."""
        skip, lost = skip or partial(_skip_plain, math.inf), False
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip() and not lost:
                    lost = True  # once for all lines up to the next record
                    yield from self._damaged(_NONE, f"no record begins with {line[:40]!r}")
                continue
            lost, headers = False, {}
            while (line := stream.readline()).strip():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                headers[key.strip().lower()] = value.strip()
            row = _NONE | {c: headers.get(h) for c, h in FIELDS.items()} | {"headers": list(headers.items())}
            size = headers.get("content-length", "0")
            if not (size.isascii() and size.isdigit()):
                yield from self._damaged(row, f"the length is {size!r}")
                continue
            row["content_length"] = length = int(size)
            wanted = self.wanted(row)
            if wanted and self.decode:
                content = stream.read(length)
                whole = len(content) == length
                if headers.get("content-type", "").startswith("application/http"):
                    content = content.partition(b"\r\n\r\n")[2]
                row["payload"] = content
            else:
                whole = skip(stream, length)
            if not whole:
                yield from self._damaged(row, f"the content ends before {length} bytes")
            elif wanted:
                yield row

    def _damaged(self, row: dict, fault: str) -> Iterator[dict]:
        """Filters see it like any other row, unless damage ends the read."""
        if not self.keep_damaged or self.wanted(row):
            yield row | {"fault": fault}


def _skip_plain(size: float, stream, length: int) -> bool:
    return (stream.seek(length, io.SEEK_CUR) or 0) <= size


def _skip_packed(stream, length: int) -> bool:
    start = stream.tell()
    return stream.seek(length, io.SEEK_CUR) == start + length


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, damaged: str = "fail") -> DataFrame:
    """The records under `path`. Turns on filter push-down for Python sources in this session. With
    `damaged="keep"` a damaged record has nulls where its header says nothing, and filters treat it like any row."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return (spark.read.format("warc").option("payload", str(payload).lower()).option("damaged", damaged)
            .load(path))


def marked(pages: DataFrame, least: int = 1000) -> DataFrame:
    """`pages(doc_id, text, uri)` with `digest`, `bytes`, and `target`: the id that a revisit refers to."""
    keyed = pages.withColumns({"digest": F.sha1("text"), "bytes": F.octet_length("text")})
    repeated = (keyed.filter(F.col("bytes") >= least).groupBy("digest", "bytes")
                .agg(F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1").select("digest", "bytes", "largest"))
    joined = keyed.join(written(repeated, "warc-repeated"), ["digest", "bytes"], "left")
    return joined.withColumn("target", F.when(~F.col("doc_id").eqNullSafe(F.col("largest")),
                                              F.col("largest"))).drop("largest")


def record(date: str) -> Column:
    """One record without the line breaks that end it."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(number: Column) -> Column:
        return F.concat(F.lit(f"<{ID}"), number.cast("string"), F.lit(">"))

    revisit = F.col("target").isNotNull()
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    content = F.concat(http, F.when(revisit, "").otherwise(F.col("text")))
    profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    return F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("uri") != "", line("WARC-Target-URI", F.col("uri"))).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("target"))),
                                 line("WARC-Profile", F.lit(profile)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(content).cast("string")), F.lit("\r\n"), content)


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
               uri_col: str = "url", least: int = 1000, date: str = "1970-01-01T00:00:00Z",
               records_per_file: int = 100_000) -> None:
    """Archives under `path`. Files end between records and hold `records_per_file` of them at most."""
    uri = F.coalesce(F.regexp_replace(F.col(uri_col).cast("string"), "\\s+", " "), F.lit(""))
    pages = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("text"), uri.alias("uri"))
    # Two line breaks end a record, so they are what the text writer puts between lines.
    (marked(pages, least).select(record(date).alias("value")).write
     .option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path))


def number(urn: Column) -> Column:
    """The id in a record's name; `null` reads as null."""
    return F.regexp_extract(urn, f"^<{ID}(-?[0-9]+)>$", 1).try_cast("long")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` of every record: digests of
    responses are taken of the payload that was read, those of revisits are in their headers."""
    responses = read_warc(spark, path).filter("record_type = 'response'")
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    length = F.element_at("headers", "x-payload-length").cast("long")
    digest = F.regexp_replace("payload_digest", "^sha1:", "")
    return (responses.select(
        number(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"))
        .unionByName(revisits.select(
            number(F.col("record_id")).alias("page_id"), length.alias("payload_bytes"),
            digest.alias("payload_digest"), "record_type",
            number(F.col("refers_to")).alias("refers_to"))))
