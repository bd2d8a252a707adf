"""WARC archives and the monolithic gzip normaliser (operator 6).

Pages are written where they are read, each task one archive compressed as a single gzip stream: of
such a file no record can be reached without inflating all before it. The normaliser inflates each
stream once, writes every record as a gzip member of its own, and notes in a sidecar index where
each begins. Which records are revisits of others with the same payload is decided on digests
alone; the decisions are few bytes a page and go to the task that normalises the page's file, so
payloads are never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmill.llm.common import slices, written
from fleetmill.session import scratch_path

#: Compression level, and bytes read or inflated at a time.
LEVEL, CHUNK = 4, 1 << 18
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 27
#: Most tasks that archives are dealt to, for each core.
TASKS_PER_CORE = 8
#: All records bear one date: pages have none, and a task that runs again writes the same bytes.
DATE = "1970-01-01T00:00:00Z"

INDEX = (
    "page_id bigint, path string, ordinal int, offset bigint, length bigint, "
    "payload_bytes bigint, payload_digest string"
)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, local or not, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(
    page_id: int | None,
    url: str | None,
    payload: bytes | None,
    digest: str,
    size: int,
    refers_to: int | None = None,
) -> bytes:
    """One WARC record with its trailing blank lines; without a payload, a revisit.

    The block of a revisit is the response's header alone, which tells the size of the payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + (payload or b"")
    kind = "revisit" if payload is None else "response"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if payload is None:
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(7, f"WARC-Refers-To: {_record_id(refers_to)}")
        head.insert(8, f"X-Refers-To-Page: {'' if refers_to is None else refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _one_line(text: str | None) -> str:
    return "".join(c for c in text or "" if c.isprintable()).replace(" ", "%20")


def parse(data: bytes | bytearray, start: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record at ``start``; none if it is not all there."""
    split = data.find(b"\r\n\r\n", start)
    if split < 0:
        return None
    lines = bytes(data[start:split]).decode("utf-8", "replace").split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    end = split + 4 + int(headers["Content-Length"])
    if len(data) < end + 4:
        return None
    return headers, bytes(data[split + 4 : end]), end + 4


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page as a response; ``(page_id, path, ordinal, payload_bytes, payload_digest)``.

    A file has a new name at each attempt of a task; those of failed attempts are in no result.
    """
    schema = "page_id bigint, path string, ordinal int, payload_bytes bigint, payload_digest string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out = deflate = None
        size = 0
        for batch in slices(batches, "html"):
            rows = []
            columns = (batch.column(n).to_pylist() for n in ("page_id", "url", "html"))
            for page_id, url, html in zip(*columns, strict=True):
                if out is not None and size > ARCHIVE_BYTES:
                    out.write(deflate.flush())
                    out.close()
                    out = None
                if out is None:
                    name = f"crawl-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    size = ordinal = 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                out.write(deflate.compress(record(page_id, url, payload, digest, len(payload))))
                rows.append((page_id, f"{folder}/{name}", ordinal, len(payload), digest))
                ordinal += 1
                size += len(payload)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("page_id", "path", "ordinal", "payload_bytes", "payload_digest"), r, strict=True)) for r in rows],
                pa.schema(
                    [
                        ("page_id", pa.int64()),
                        ("path", pa.string()),
                        ("ordinal", pa.int32()),
                        ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()),
                    ]
                ),
            )
        if out is not None:
            out.write(deflate.flush())
            out.close()

    own = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        pages["html"].cast("string").alias("html"),
    )
    return own.mapInArrow(write, schema)


def decide(records: DataFrame, least_bytes: int) -> DataFrame:
    """``path, ordinal, revisit, refers_to``: of equal payloads the largest page id is the response."""
    large = records.where(F.col("payload_bytes") >= least_bytes)
    first = written(
        large.groupBy("payload_digest", "payload_bytes").agg(
            F.max("page_id").alias("refers_to"), F.count("*").alias("copies")
        ),
        "payloads",
    ).where("copies > 1")
    joined = records.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select(
        "path", "ordinal", revisit.alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to")
    )


def spread_over(records: DataFrame) -> int:
    """So many partitions that tasks get about one archive of ``records``, or a few per core.

    The rows that name the records are few bytes, so that their size would put all archives into one
    task, which reads and writes them whole.
    """
    archives = records.select("path").distinct().count()
    cores = records.sparkSession.sparkContext.defaultParallelism
    return max(1, min(2 * archives, TASKS_PER_CORE * cores))


def normalise(decisions: DataFrame, folder: str, archives: int) -> DataFrame:
    """Rewrites each archive of ``decisions`` record by record; ``INDEX`` rows of what was written.

    ``archives`` is the number of tasks they are dealt to.

    ``decisions (path, ordinal, revisit, refers_to)`` has a row for every record. The rows of a file
    are streamed in order along with its records; neither is held whole.
    """
    decided = decisions.select("path", "ordinal", "revisit", "refers_to")
    ordered = decided.repartition(archives, "path").sortWithinPartitions("path", "ordinal")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = records = out = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if out is not None:
                        out.close()
                    path, at = row["path"], 0
                    store, _ = open_store(path)
                    records = inflate(path)
                    name = f"{folder}/{uuid.uuid4().hex}-{path.rsplit('/', 1)[1]}"
                    out = store.open_output_stream(open_store(name)[1], compression=None)
                headers, block = next(records)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                page_id = int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None
                data = record(
                    page_id,
                    headers["WARC-Target-URI"],
                    None if row["revisit"] else payload,
                    digest,
                    len(payload),
                    row["refers_to"],
                )
                deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = deflate.compress(data) + deflate.flush()
                out.write(member)
                rows.append((page_id, name, row["ordinal"], at, len(member), len(payload), digest))
                at += len(member)
            names = [x.split(" ")[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _INDEX)
        if out is not None:
            out.close()

    return ordered.mapInArrow(rewrite, INDEX)


_INDEX = pa.schema(
    [
        ("page_id", pa.int64()),
        ("path", pa.string()),
        ("ordinal", pa.int32()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def inflate(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive from one pass over its stream, of one gzip member or of many."""
    store, name = open_store(path)
    with store.open_input_stream(name, compression=None) as source:
        held, at = bytearray(), 0
        inflater = zlib.decompressobj(31)
        pending = b""
        while True:
            if not pending and not (pending := source.read(CHUNK)):
                break
            held += inflater.decompress(pending, CHUNK)
            pending = inflater.unconsumed_tail
            if inflater.eof:
                pending = inflater.unused_data
                inflater = zlib.decompressobj(31)
            while found := parse(held, at):
                headers, block, at = found
                yield headers, block
            if at > CHUNK:
                del held[:at]
                at = 0


def read_archives(index: DataFrame, archives: int | None = None) -> DataFrame:
    """Reads records by their places: one row each, with what its own headers and payload say.

    Of a response, size and digest are those of the payload that was read; a payload that does not
    have the digest its header tells is an error. A revisit has those of the payload it stands for.
    """
    schema = (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint"
    )
    ordered = index.select("path", "offset", "length")
    ordered = ordered.repartition(archives or spread_over(index), "path")
    ordered = ordered.sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = source = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if source is not None:
                        source.close()
                    path = row["path"]
                    store, name = open_store(path)
                    source = store.open_input_file(name)
                member = source.read_at(row["length"], row["offset"])
                headers, block, _ = parse(zlib.decompress(member, 31))
                http, payload = block.split(b"\r\n\r\n", 1)
                told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                if headers["WARC-Type"] == "response" and (
                    payload_digest(payload) != told or len(payload) != size
                ):
                    raise ValueError(f"damaged record in {path} at {row['offset']}")
                number = [headers.get(x) for x in ("X-Page-ID", "X-Refers-To-Page")]
                page_id, refers_to = (int(x) if x else None for x in number)
                rows.append((page_id, size, told, headers["WARC-Type"], refers_to))
            names = [x.split(" ")[0] for x in schema.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(names, r, strict=True)) for r in rows], pa.schema(list(zip(names, types, strict=True)))
            )
        if source is not None:
            source.close()

    return ordered.mapInArrow(read, schema)


def archive(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes, normalises and indexes ``pages``; the index, a written table, and the folder.

    Null and empty html is an empty payload, and null urls are empty. Rows that repeat a page id
    are records of their own; with equal payloads and the largest page id, all of them are
    responses. A null page id never is what others refer to unless all are null; then all are
    responses. No pages, no records. Other columns are not read.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    store, root = open_store(folder)
    for part in ("raw", "records"):
        store.create_dir(f"{root}/{part}", recursive=True)
    records = written(write_archives(pages, f"{folder}/raw"), "records")
    decisions = decide(records, least_bytes)
    index = normalise(decisions, f"{folder}/records", spread_over(records))
    index.write.parquet(f"{folder}/index")
    store.delete_dir(f"{root}/raw")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index"), folder


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read from the archives."""
    index, _ = archive(pages, least_bytes)
    return read_archives(index)
