"""WARC archives written from and read into a chunked record table.

A payload is a run of rows (record, chunk number, bytes), at most ``chunk_bytes`` each, and every row read
back carries the length and SHA-256 of the payload up to its end. Digests, compression and parsing are all
incremental, so writer and reader hold one chunk, whatever the size of the record (the table the payloads
come from does hold each as one value).

Archives are gzip members, one per record, in files of about ``file_bytes``. A task gives its files new
names and returns them; only the files of tasks that ended well are in the manifest, so a repeated or lost
task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace

CHUNK_BYTES = 1 << 20
FILE_BYTES = 256 << 20
MIN_REVISIT_BYTES = 100
RECORD = "page_id bigint, record_id string, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
MANIFEST = "file string, records bigint, bytes bigint"
CHUNKS = RECORD + ", chunk_no bigint, last boolean, bytes_so_far bigint, digest_so_far string, data binary"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def chunk_table(pages: DataFrame, keep: list[str], payload: str, chunk_bytes: int) -> DataFrame:
    """The ``keep`` columns with one row per chunk of the binary column ``payload``, in order: ``chunk_no``,
    ``last``, ``data``; an empty or null payload is one empty chunk."""
    whole = F.coalesce(F.col(payload), F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length(whole) / chunk_bytes), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: whole.substr(i * chunk_bytes + 1, F.lit(chunk_bytes)))
    cut = pages.select(*keep, n.alias("chunks"), F.posexplode(cut).alias("chunk_no", "data"))
    return cut.withColumn("last", F.col("chunk_no") == F.col("chunks") - 1).drop("chunks")


def payload_digests(pages: DataFrame, keep: list[str], payload: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``keep`` columns with ``payload_bytes`` and ``payload_digest`` of every row, chunk by chunk."""
    cut = chunk_table(pages, keep, payload, chunk_bytes)
    width = len(keep)

    def kernel(batches):
        digest, size = hashlib.sha256(), 0
        for batch in batches:
            ends, sizes, digests = [], [], []
            last = batch.column(width + 2).to_pylist()
            for r in range(batch.num_rows):
                piece = batch.column(width + 1)[r].as_buffer()
                digest.update(piece)
                size += piece.size
                if last[r]:
                    ends.append(r)
                    sizes.append(size)
                    digests.append(digest.hexdigest())
                    digest, size = hashlib.sha256(), 0
            kept = batch.select(range(width)).take(pa.array(ends, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                                             [*keep, "payload_bytes", "payload_digest"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return cut.mapInArrow(kernel, f"{kinds}, payload_bytes bigint, payload_digest string")


def plan_records(digests: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``digests`` with ``record_type`` and ``refers_to``: of equal payloads of at least ``least`` bytes the
    smallest ``page_id`` is the response and the others revisit it. Rows that repeat that ``page_id`` are
    responses too; where no row of a payload has a ``page_id``, all are."""
    first = digests.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return digests.join(first, "payload_digest", "left").select(
        *digests.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record_id(page_id, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}"


def _header(row: dict) -> bytes:
    """All that stands before the payload of a record."""
    clean = " ".join((row["url"] or "").split())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    length = len(http) + (row["payload_bytes"] if row["record_type"] == "response" else 0)
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_record_id(row['page_id'], row['payload_digest'])}>",
        f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{_record_id(row['refers_to'], row['payload_digest'])}>", f"X-Refers-To-Page: {row['refers_to']}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode() + http


class _Writer:
    """Files of one task: gzip members written as chunks arrive."""

    def __init__(self, folder: str, file_bytes: int):
        self.fs, self.folder = _filesystem(folder)
        self.uri, self.file_bytes, self.out, self.done = folder, file_bytes, None, []
        self.fs.create_dir(self.folder, recursive=True)

    def begin(self, row: dict):
        if self.out is None:
            self.name, self.records = f"part-{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.member = zlib.compressobj(2, zlib.DEFLATED, 31)
        self.out.write(self.member.compress(_header(row)))

    def data(self, piece: bytes):
        self.out.write(self.member.compress(piece))

    def end(self):
        self.out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.records += 1
        if self.out.tell() >= self.file_bytes:
            self.close()

    def close(self):
        if self.out is not None:
            self.done.append((f"{self.uri}/{self.name}", self.records, self.out.tell()))
            self.out.close()
            self.out = None


def write(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row below ``work`` and return the manifest ``file, records, bytes``.

    A null payload is empty, a null URL an empty one, a null id has no id header. Repeated rows are records
    of their own and share their type. Other columns are not read. An empty table has an empty manifest.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("mark", F.xxhash64("payload"))
    digests = work.stage("digests", payload_digests(rows, ["page_id", "mark"], "payload", chunk_bytes))
    plan = plan_records(digests).dropDuplicates(["page_id", "mark"]).withColumnsRenamed({"page_id": "plan_id", "mark": "plan_mark"})
    told = rows.join(plan, rows.page_id.eqNullSafe(plan.plan_id) & (rows.mark == plan.plan_mark))
    told = told.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    keep = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    folder = work.path("archives")

    def kernel(batches):
        writer = _Writer(folder, file_bytes)
        for batch in batches:
            meta = batch.select([*keep, "chunk_no", "last"]).to_pylist()
            data = batch.column(batch.schema.get_field_index("data"))
            for r, row in enumerate(meta):
                if row["chunk_no"] == 0:
                    writer.begin(row)
                writer.data(data[r].as_buffer())
                if row["last"]:
                    writer.end()
        writer.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "records", "bytes"), x)) for x in writer.done],
            pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    return work.stage("manifest", chunk_table(told, keep, "payload", chunk_bytes).mapInArrow(kernel, MANIFEST))


class _Stream:
    """Decompressed bytes of an archive of gzip members, read forward."""

    def __init__(self, file, block: int):
        self.file, self.block, self.member, self.held = file, block, None, b""
        self.raw = b""

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(self.block)
                if not self.raw:
                    return False
            if self.member is None:
                self.member = zlib.decompressobj(31)
            piece = self.member.decompress(self.raw, self.block)
            self.raw = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = None
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends inside a header")
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        """1 to ``most`` bytes."""
        if not self.held and not self._more():
            raise ValueError("archive ends inside a record")
        found, self.held = self.held[:most], self.held[most:]
        return found

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            parts.append(self.take(n))
            n -= len(parts[-1])
        return b"".join(parts)


def records(file, chunk_bytes: int) -> Iterator[dict]:
    """The rows of :data:`CHUNKS` of one archive."""
    stream = _Stream(file, min(chunk_bytes, 1 << 18))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        left = int(field["Content-Length"])
        http = stream.until(b"\r\n\r\n")
        left -= len(http) + 4
        number = lambda name: int(field[name]) if name in field else None
        row = {
            "page_id": number("X-Page-Id"), "record_id": field["WARC-Record-ID"].strip("<>"), "url": field["WARC-Target-URI"],
            "record_type": field["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload_bytes": number("X-Payload-Length"),
            "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha256:"),
        }
        digest, size, chunk = hashlib.sha256(), 0, 0
        while True:
            data = stream.exactly(min(left, chunk_bytes))
            left -= len(data)
            size += len(data)
            digest.update(data)
            yield row | {"chunk_no": chunk, "last": left == 0, "bytes_so_far": size, "digest_so_far": digest.hexdigest(), "data": data}
            chunk += 1
            if not left:
                break
        if row["record_type"] == "response" and (digest.hexdigest(), size) != (row["payload_digest"], row["payload_bytes"]):
            raise ValueError(f"payload of {row['record_id']} does not match its digest")
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError(f"{row['record_id']} does not end where its length says")


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of every record in the manifest's files (a file is read by one task, forward).

    The last chunk of a response carries the digest and length of what was read; a response whose payload
    does not match its header raises. A revisit is one empty chunk.
    """

    def kernel(batches):
        schema = None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = _filesystem(name)
                held, size = [], 0
                with fs.open_input_stream(path, compression=None) as file:
                    for row in records(file, chunk_bytes):
                        held.append(row)
                        size += len(row["data"]) + 500
                        if size >= 4 * chunk_bytes:
                            yield pa.RecordBatch.from_pylist(held, schema or _chunk_schema())
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema or _chunk_schema())

    files = manifest.select("file")
    # the number is given, or the short list of names would be merged into one task
    return files.repartitionByRange(max(files.count(), 1), "file").mapInArrow(kernel, CHUNKS)


def _chunk_schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in CHUNKS.split(", "))])


def read_records(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per record: identity, type, and length and digest of the payload, from the bytes read for
    responses and from the header for revisits."""
    response = F.col("record_type") == "response"
    return read_chunks(manifest, chunk_bytes).where("last").select(
        "page_id", "record_id", "url", "record_type", "refers_to",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )
