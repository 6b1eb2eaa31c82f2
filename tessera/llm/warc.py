"""WARC archives as a Spark data source, written and read in Python."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from tessera.llm.common import scratch, with_values, written

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, content_type string, content_length bigint, headers map<string,string>, payload binary"
#: Columns that are a header of the record itself; filters on them are settled before the record's block is read.
HEADER = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
ARROW = pa.schema([(c, pa.string()) for c in HEADER] + [("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Bytes after which a writer starts another file, so that archives make partitions of even size.
FILE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:", uri) else f"file://{uri}")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class ArchivePart(InputPartition):
    path: str


def record_head(stream) -> dict[str, str] | None:
    """Headers of the record that begins here, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    head: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    return head


def wanted(head: dict[str, str], filters: list[Filter]) -> bool:
    for f in filters:
        value = head.get(HEADER[f.attribute[0]])
        if isinstance(f, StringStartsWith):
            ok = value is not None and value.startswith(f.value)
        else:
            ok = value is not None and value in (f.value if isinstance(f, In) else (f.value,))
        if not ok:
            return False
    return True


class WarcReader(DataSourceReader):
    """A partition for each archive file. Header predicates are pushed down: of a record that fails them, only the
    head is parsed and the block is stepped over; `payload` false steps over every block."""

    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADER and (isinstance(f, (In, StringStartsWith)) or f.value is not None):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
        found = [x for x in found if not re.search(r"/[_.]", "/" + x.path[len(path) :].lstrip("/"))]  # what a write in progress or a failed one has left
        return [ArchivePart(x.path) for x in sorted(found, key=lambda x: (-x.size, x.path))] or [ArchivePart("")]

    def read(self, partition: ArchivePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        packed = partition.path.endswith(".gz")
        import gzip
        import io

        with fs.open_input_file(partition.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 18)
            rows, held = [], 0
            while (head := record_head(stream)) is not None:
                length = int(head.get("content-length", 0))
                payload = None
                if not wanted(head, self.filters):
                    stream.seek(length, 1)
                    continue
                if self.payload and head.get("warc-type") != "revisit":
                    block = stream.read(length)
                    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                else:
                    stream.seek(length, 1)
                rows.append((*(head.get(h) for h in HEADER.values()), length, list(head.items()), payload))
                held += 500 + len(payload or b"")
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with the columns of SCHEMA that the writer knows: warc_type, record_id, target_uri, warc_date,
    refers_to, payload_digest, headers (further ones) and payload. Files appear under their name once the job commits, so a task that is
    lost and run again leaves no half or second copy."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = file_system(self.path)
        folder = posixpath.join(path, "_temporary_warc")
        fs.create_dir(folder, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for rows in iterator:
            names = rows.schema.names
            for row in zip(*(rows.column(i) for i in range(rows.num_columns)), strict=True):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(posixpath.join(folder, f"{uuid.uuid4().hex}.warc"))
                    out, size = fs.open_output_stream(files[-1]), 0
                size += out.write(record({n: v.as_py() for n, v in zip(names, row, strict=True)}))
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        new = {posixpath.join(path, posixpath.basename(f)): f for m in messages if m for f in m.files}
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(path)):
                if x.is_file:
                    fs.delete_file(x.path)
        for to, f in new.items():
            fs.move(f, to)
        self.clear(fs, path)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*file_system(self.path))

    def clear(self, fs: pafs.FileSystem, path: str) -> None:
        folder = posixpath.join(path, "_temporary_warc")
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


def record(row: dict) -> bytes:
    """One record; a revisit has no payload in its block. Line ends within a header's value become spaces."""
    payload, kind = row.get("payload") or b"", row.get("warc_type") or "response"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if kind == "revisit" else payload)
    head = {"WARC-Type": kind, "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("warc_date") or "1970-01-01T00:00:00Z", "WARC-Target-URI": row.get("target_uri"), "WARC-Refers-To": row.get("refers_to"), "WARC-Payload-Digest": row.get("payload_digest")}
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head |= dict(row.get("headers") or ()) | {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A record for each row of `pages` (page_id, url, html), ready for the writer.

    The payload is the html in UTF-8, a null one empty. Of rows with equal payloads of `least_bytes` or more, those
    with the largest page_id are responses and the others revisit it; among null ids only, all are responses.
    Equality is that of the SHA-1 and the length. The html is shuffled once at most, and only if too many different
    payloads repeat for a broadcast; a payload of very many pages is no one task's then.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("sha"), F.length("payload").cast("bigint").alias("size"))
    again = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null").select("sha", "size", "first")
    joined = with_values(rows, written(again, "warc-again"), ["sha", "size"])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # SHA-1's 40 hex digits are 4 lots of 10, each 8 base32 digits: 5 bits at a time.
    lot = lambda k: F.lpad(F.conv(F.substring("sha", 10 * k + 1, 10), 16, 32), 8, "0")
    base32 = F.translate(F.concat(*map(lot, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"), page_urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.when(revisit, page_urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha1:"), base32).alias("payload_digest"),
        F.create_map(F.lit("X-Payload-Length"), F.col("size").cast("string")).alias("headers"), F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Writes `pages` as WARC files and returns their folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    page_records(pages, least_bytes).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """archived_pages() of an archive: responses with their payloads, and revisits by their heads alone. Both predicates
    on the record type are pushed down, so no revisit's block and no other kind of record is read or decoded."""
    full = read_archive(spark, path).where(F.col("warc_type") == "response")
    heads = read_archive(spark, path, payload=False).where(F.col("warc_type") == "revisit")
    return archived_pages(full).unionByName(archived_pages(heads))


def archived_pages(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. What a response says of its payload
    is computed from the payload itself; a revisit has it in its headers."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    own = F.col("payload").isNotNull()
    base = F.regexp_replace("payload_digest", "^sha1:", "")
    return records.select(
        number("record_id").alias("page_id"), F.when(own, F.length("payload")).otherwise(F.col("headers")["x-payload-length"].try_cast("bigint")).cast("bigint").alias("payload_bytes"),
        base.alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"),
    )
