"""WARC archives with a two-level capture index.

``write_archives`` writes one record per page with Spark's text writer, so any
store that Spark writes to can hold the archives. Of records with equal
payloads of at least ``min_revisit`` bytes the one with the smallest id is a
response with the payload, the others are revisits that name it.

``index_lines`` walks the archives record by record from a bounded buffer and
skips the blocks. ``build_index`` sorts the captures by reversed-host URL key, packs
runs of lines into compressed blocks, and keeps a sparse directory with the first
and last key of each block (at most ``MAX_BLOCKS`` and one a partition: blocks grow
beyond that). ``lookup`` takes a table of keys: each is binary-searched in the
directory and goes to the blocks that can hold it, is binary-searched in these, and
the records found are read from the archives by offset and length alone, inside the
tasks. ``captures`` returns what these reads hold; every payload is checked against
its digest.

Only digests, ids, keys and index blocks are shuffled. The payloads are joined with
the repeated digests, a table that is staged first, so that the planner knows its
size. Records are written in classes of size, each four times the one before with a
quarter of the records per file, so an archive has ``ARCHIVE_BYTES`` and headers at
most, or one record. The folder of the archives must be one that pyarrow.fs opens
(local or mounted, hdfs, s3, gs).

Defined results: a null payload is empty; a null URL has no target URI and the
key ``)``; CR and LF in a URL are percent-encoded in the header; a null id is
written as an empty id and read back as null, and is the response of its group
only if no other id is there; rows with equal id and equal payload are all
responses or all revisits of the same id; an empty table gives no archive and
an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import ASCII_LOWER, by_value, shared_path, stage

by_value(__name__)

MIN_REVISIT = 100
BLOCK_LINES = 1000
DATE = "1970-01-01T00:00:00Z"  # the tables carry no crawl time
MAX_BLOCKS, KEY_PREFIX = 65_536, 256
ARCHIVE_BYTES, SMALL_RECORD = 256 << 20, 64 << 10
BUFFER = 1 << 20
OPEN_FILES = 64
ENTRY = "url_key string, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.org/b?c`` -> ``org,a,www)/b?c``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return ")" + (url or "")
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].translate(ASCII_LOWER).split("."))) + ")" + rest[end:]


def _one_line(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def mark_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, n_bytes, refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"),
                        F.octet_length(html).cast("long").alias("n_bytes"))
    first = rows.filter(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("digest").alias("f_digest"), "first_id")
    first = stage(first, "repeated")
    refers = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))
    refers = F.when(F.col("page_id").isNull(), F.col("first_id")).otherwise(refers)
    return rows.join(first, F.col("digest") == F.col("f_digest"), "left").withColumn("refers_to", refers).drop(
        "f_digest", "first_id")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    rows = mark_revisits(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                                      F.col(html_col).alias("html")), min_revisit)
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = _one_line(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    header = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),  # left out where null
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    rows = rows.withColumn("block", block)
    size = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit("")))
    largest = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).agg(F.max(size)).first()[0] or 0
    own = F.octet_length("html") + F.octet_length(F.coalesce("url", F.lit("")))
    low, step = -1, min(SMALL_RECORD, archive_bytes)
    while low < largest:        # one pass for each class that a record is large enough for
        high = step if step < largest else largest
        rows.filter((own > low) & (own <= high)).select(F.concat(header, F.lit("\r\n\r\n"), F.col("block")).alias("value")).write.mode(
            "append").option("lineSep", "\r\n\r\n").option("compression", "none").option(
            "maxRecordsPerFile", max(1, archive_bytes // step)).text(path)
        low, step = high, 4 * step


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")
    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    start = end + 4
    stop = start + int(head["content-length"])
    return head, data[start:stop], stop + 4


def payload_of(head: dict[str, str], block: bytes) -> tuple[bytes, int, str]:
    """Payload (empty for a revisit), full payload size, digest. The digest of a
    payload that is there is computed and must equal the header's."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return payload, size, digest


def _id(urn: str | None, whole: bool) -> int | str | None:
    text = (urn or "")[len("<urn:page:"):-1]
    return None if not text else int(text) if whole else text


# --- reading archives inside tasks ------------------------------------------------------

class Archives:
    """Archives opened for reading, the last OPEN_FILES of a task."""

    def __init__(self):
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def open(self, path: str) -> pa.NativeFile:
        if path not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close()
            local = re.fullmatch(r"(?:file:/*)?(/.*)", re.sub(r"^file:/+", "/", path))
            store, name = (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(path)
            self.files[path] = store.open_input_file(name)
        self.files.move_to_end(path)
        return self.files[path]

    def read(self, path: str, offset: int, length: int) -> bytes:
        return self.open(path).read_at(length, offset)


def heads(file: pa.NativeFile, size: int) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, headers) of each record. Only what the buffer holds is kept;
    blocks beyond it are skipped."""
    at, base, buffer, step = 0, 0, b"", BUFFER
    while at < size:
        end = buffer.find(b"\r\n\r\n", at - base) if base <= at < base + len(buffer) else -1
        if end < 0:
            if base == at and base + len(buffer) >= size:
                raise ValueError(f"no end of the headers at {at}")
            step = 2 * step if base == at and buffer else BUFFER
            base, buffer = at, file.read_at(min(step, size - at), at)
            continue
        lines = buffer[at - base:end].decode("utf-8").split("\r\n")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        length = end + 4 - (at - base) + int(head["content-length"])
        yield at, length, head
        at += length + 4


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """url_key, archive, offset, length of every record of all archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives()
        for b in batches:
            for archive, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                rows = []
                for offset, length, head in heads(archives.open(archive), size):
                    rows.append((url_key(head.get("warc-target-uri")), archive, offset, length))
                    if len(rows) == 10_000:
                        yield _entries(rows)
                        rows = []
                yield _entries(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    return files.mapInArrow(run, ENTRY)   # an archive is read by one task


def build_index(lines: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Blocks and directory of staged index lines, under ``path``."""
    spark = lines.sparkSession
    block_lines = max(block_lines, -(-lines.count() // MAX_BLOCKS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows):
            text = "\n".join(json.dumps(r) for r in rows).encode()
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([rows[-1][0]]),
                                               pa.array([len(rows)], pa.int64()), pa.array([zlib.compress(text)])],
                                              names=["first_key", "last_key", "n_lines", "block"])
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= block_lines:
                yield block(held[:block_lines])
                held = held[block_lines:]
        if held:
            yield block(held)
    # offset breaks ties, so that one much-captured URL spreads over partitions too
    blocks = lines.repartitionByRange("url_key", "archive", "offset").sortWithinPartitions(
        "url_key", "archive", "offset").mapInArrow(
        pack, "first_key string, last_key string, n_lines long, block binary")
    blocks.withColumn("block_id", F.monotonically_increasing_id()).write.parquet(f"{path}/blocks")
    # first and last key alone: the sparse directory
    spark.read.parquet(f"{path}/blocks").select("block_id", "first_key", "last_key").write.parquet(f"{path}/directory")


def _lines(block: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(block).decode().split("\n")]


def _entries(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(),
                                                                            pa.int64()))],
                                      names=["url_key", "archive", "offset", "length"])


def find(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """The index lines (url_key, archive, offset, length) of all captures of the
    distinct keys in the column url_key."""
    # one row a block, at most MAX_BLOCKS and one a partition; a prefix of each key
    # bounds their size, and finds no block too few
    directory = spark.read.parquet(f"{index}/directory").select(
        "block_id", F.substring("first_key", 1, KEY_PREFIX).alias("first"), F.substring("last_key", 1, KEY_PREFIX).alias("last")).orderBy(
        "block_id").collect()
    known = spark.sparkContext.broadcast(tuple(zip(*directory)) or ((), (), ()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, firsts, lasts = known.value
        for b in batches:
            own, where = [], []
            for key in b.column("url_key").to_pylist():
                short = key[:KEY_PREFIX]
                for k in range(bisect.bisect_left(lasts, short), bisect.bisect_right(firsts, short)):
                    own.append(key)
                    where.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(where, pa.int64())], names=["url_key", "k_block"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, wanted in zip(b.column("block"), b.column("keys")):
                lines = _lines(block.as_py())
                firsts = [x[0] for x in lines]
                rows = []
                for k in wanted.as_py():
                    rows += lines[bisect.bisect_left(firsts, k):bisect.bisect_right(firsts, k)]
                yield _entries(rows)
    wanted = keys.select("url_key").distinct().mapInArrow(search, "url_key string, k_block long").groupBy("k_block").agg(
        F.collect_list("url_key").alias("keys"))
    blocks = spark.read.parquet(f"{index}/blocks").select("block_id", "block")
    return blocks.join(wanted, F.col("block_id") == F.col("k_block")).select("block", "keys").mapInArrow(inside, ENTRY)


def url_keys(urls: DataFrame, column: str) -> DataFrame:
    """The column as index keys, in a column url_key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["url_key"])
    uri = F.col(column).cast("string")
    return urls.select(_one_line(uri)).mapInArrow(run, "url_key string")


def lookup(spark: SparkSession, index: str, urls: DataFrame, column: str = "url") -> DataFrame:
    """url_key, archive, offset, length, record (its bytes) for every capture of the URLs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives()
        for b in batches:
            for row in b.to_pylist():
                data = archives.read(row["archive"], row["offset"], row["length"])
                yield pa.RecordBatch.from_arrays([*(pa.array([v]) for v in row.values()), pa.array([data])], names=[*row, "record"])
    return find(spark, index, url_keys(urls, column)).mapInArrow(run, ENTRY + ", record binary")


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the pages to archives, index them, look up every URL of the pages, and
    return what the records hold that the index leads to."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    whole = kind != "string"
    root = shared_path(spark, "warc")
    write_archives(pages, f"{root}/archives", id_col, url_col, html_col, min_revisit)
    build_index(stage(index_lines(spark, f"{root}/archives"), "index-lines"), f"{root}/index")
    schema = T._parse_datatype_string(
        f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    id_type = {"bigint": pa.int64(), "string": pa.string()}.get(kind, pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives()
        for b in batches:
            rows = []
            # neighbours in an archive are read one after the other
            for archive, offset, length in sorted(zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")))):
                head, block, _ = parse_record(archives.read(archive, offset, length))
                _, size, digest = payload_of(head, block)
                rows.append((_id(head["warc-record-id"], whole), size, digest, head["warc-type"], _id(head.get("warc-refers-to"), whole)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (id_type, pa.int64(), pa.string(), pa.string(), id_type))],
                    names=schema.names)
    return find(spark, f"{root}/index", url_keys(pages, url_col)).mapInArrow(run, schema)
