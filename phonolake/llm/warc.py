"""WARC archives: written with Spark's text sink, read by a Python data source.

The writer makes one record per page. Records are text lines ended by the two line breaks that end a WARC record, so
any store Spark can write to will do. Of pages with one payload of at least ``revisit_from`` bytes the largest id keeps
it; the others become revisit records, which carry the digest and the HTTP head but no payload.

The source ``warc`` plans partitions from file sizes, takes predicates on record type, ids, URI and lengths, reads the
head of each record first, and seeks past the block of every record that no one wants. With ``payload=false`` no block
is read beyond its HTTP head.

Edge cases: a null page is an empty payload; a null id gives a record without a page id and is never referred to; rows
that repeat the largest id of a group are all responses; line breaks in a URI are percent-encoded; an empty table gives
an empty archive and no rows; further columns of the pages are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from phonolake.llm.files import file_system
from phonolake.session import stage

BREAK = "\r\n"
SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "http_length long, content_length long, payload binary"
)
HEADS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_length": "content-length",
}


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records(pages: DataFrame, revisit_from: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages(page_id, url, html) -> value: the text of one record, without the breaks that end it."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("body")).select(
        "*", F.sha1(F.col("body")).alias("digest"), F.octet_length("body").alias("bytes"))
    shared = stage(
        rows.filter(F.col("bytes") >= revisit_from).groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared-payloads")
    rows = rows.join(shared, ["digest", "bytes"], "left")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(BREAK * 2))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    return rows.select(F.concat(
        F.lit(f"WARC/1.1{BREAK}"), _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:none>"))),
        _line("WARC-Target-URI", uri), _line("WARC-Date", F.lit(date)),
        _line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(again, urn(F.col("keep")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK), block,
    ).alias("value"))


def write(pages: DataFrame, path: str, revisit_from: int = 1000, records_per_file: int = 100_000) -> None:
    records(pages, revisit_from).write.option("lineSep", BREAK * 2).option(
        "maxRecordsPerFile", records_per_file).mode("overwrite").text(path)


@dataclass
class Files(InputPartition):
    paths: list[str]


_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


def parse_head(lines: list[bytes]) -> dict[str, str]:
    """Header names in lower case; the first line (version or status) is skipped."""
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.split_bytes = int(options.get("splitBytes", 64 << 20))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADS:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self):
        """Whole files, gathered up to splitBytes: a record is found by the length of the one before it."""
        from pyarrow import fs

        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        groups, held = [], 0
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if not f.size:
                continue
            if not groups or held + f.size > self.split_bytes:
                groups.append(Files([]))
                held = 0
            groups[-1].paths.append(f.path)
            held += f.size
        return groups or [Files([])]

    def wanted(self, row: dict) -> bool:
        return all(row[name] is not None and _TESTS[kind](row[name], value) for name, kind, value in self.tests)

    def read(self, partition) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                import io

                yield from self.scan(io.BufferedReader(raw, 1 << 20))

    def scan(self, file) -> Iterator[tuple]:
        while True:
            line = file.readline()
            if not line:
                return
            if not line.strip():
                continue  # the breaks after a record
            lines = [line]
            while (line := file.readline()).strip():
                lines.append(line)
            head = parse_head(lines)
            row = {name: head.get(key) for name, key in HEADS.items()}
            length = row["content_length"] = int(head.get("content-length", 0))
            if not self.wanted(row):
                file.seek(length, 1)
                continue
            left, http = length, []
            if head.get("content-type", "").startswith("application/http"):
                while left and (line := file.readline(left)):
                    left -= len(line)
                    if not line.strip():
                        break
                    http.append(line)
            size = parse_head(http).get("content-length") if http else None
            if self.payload and row["record_type"] != "revisit":
                body = file.read(left)
            else:
                body = None
                file.seek(left, 1)
            yield (row["record_id"], row["record_type"], row["target_uri"], row["refers_to"], row["payload_digest"],
                   int(size) if size else None, length, body)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("path", …)``, options ``payload`` (true) and ``splitBytes`` (64 MB)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(name: str) -> Column:
    """The page id in a record id; null for records of pages without one."""
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: lengths and digests of responses come from the payload, those of revisits from their head."""
    full = read(spark, path).filter("record_type = 'response'").select(
        page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = read(spark, path, payload=False).filter("record_type = 'revisit'").select(
        page_of("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        page_of("refers_to").alias("refers_to"))
    return full.unionByName(heads)
