"""Operator 5: WARC archives, written record by record and read back by a reader that salvages what it can.

Each record is a gzip member of its own. The reader checks members, headers and payload digests; after a failed check it looks for the next place where a
member or a version line begins, goes on there, and logs the bytes between as quarantined.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir

#: Payloads of at least so many bytes are stored once; equal later ones are revisits.
LEAST_SHARED = 100
#: Bytes (compressed) after which a new archive file begins.
FILE_BYTES = 16 << 20
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: The date of every record, so that archives are the same whenever they are written.
_FIXED_DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(id, url, html, digest, size, first): ``first`` is the smallest id with the same payload if that is another row's and the payload is shared.

    Payloads are compared by their SHA-256 (null: empty). Only digests move for it, and only repeated ones come back; then they join by id, so that a payload that many rows have
    fills no task. Rows that repeat an id and a payload revisit nothing: all of them are responses.
    """
    rows = pages.select(F.col(id).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    large = rows.filter(F.col("size") >= LEAST_SHARED).select("id", "digest")
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = large.join(firsts, "digest").filter(F.col("id") != F.col("first")).select("id", "digest", "first").distinct()
    return rows.join(later, ["id", "digest"], "left").select("id", "url", "html", "digest", "size", "first")


def record(id, url: str, payload: bytes, digest: str, size: int, first) -> bytes:
    """One WARC record; a revisit has no payload but its length, its digest and the record that has it."""
    kind = "response" if first is None else "revisit"
    body = payload if first is None else b""
    url = re.sub(r"[\r\n]", " ", url)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {_FIXED_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def open_output(path: str):
    """A new file by URI, on any file system that pyarrow knows."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_output_stream(at, compression=None)


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Writes ``plan_records`` rows as archive files under ``path`` (a URI) and returns their list (file, records, bytes), written as a table.

    File names carry the task attempt, so a task that runs again never writes to a file that another attempt has open; only files in the list count.
    """
    run_id = uuid.uuid4().hex[:12]

    def run(batches):
        task = TaskContext.get()
        name = f"{path}/{run_id}-{task.partitionId():06d}-{task.taskAttemptId()}"
        k, out, n, size, done = 0, None, 0, 0, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "size", "first")), strict=True):
                if out is None:
                    file = f"{name}-{k}.warc.gz"
                    out, n, size, k = open_output(file), 0, 0, k + 1
                data = member(record(r[0], r[1], r[2].encode(), r[3], r[4], r[5]))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((file, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((file, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["file", "records", "bytes"])

    listed = f"{path}/files"
    records.mapInArrow(run, "file string, records bigint, bytes bigint").write.parquet(listed)
    return records.sparkSession.read.schema("file string, records bigint, bytes bigint").parquet(listed)


def parse(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """(headers, body, end) of the record at a place in plain bytes, or None if it fails a check."""
    if not _VERSION_LINE.match(data, at):
        return None
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        return None
    head = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        return None
    begin = split + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    body = data[begin:end]
    want = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and want.startswith("sha256:") and hashlib.sha256(body).hexdigest() != want[7:]:
        return None
    return head, body, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """(content, end, whole) of the gzip member at a place; of one that is damaged or cut off, what it inflates to before that, and where that is."""
    z, out, step, begin = zlib.decompressobj(31), [], 1 << 14, at
    view = memoryview(data)
    while at < len(data) and not z.eof:
        try:
            out.append(z.decompress(view[at : at + step]))
        except zlib.error:
            return *_inflate_to(view, begin, at), False
        at += min(step, len(data) - at)
        step = min(2 * step, 1 << 20)
    return b"".join(out), at - len(z.unused_data), z.eof


def _inflate_to(view: memoryview, begin: int, good: int) -> tuple[bytes, int]:
    """What a damaged member gives up to the byte that fails, which is behind ``good``."""
    z = zlib.decompressobj(31)
    out = [z.decompress(view[k : min(k + (1 << 20), good)]) for k in range(begin, good, 1 << 20)]
    for at in range(good, len(view)):
        try:
            out.append(z.decompress(view[at : at + 1]))
        except zlib.error:
            return b"".join(out), at
    return b"".join(out), len(view)


def plain_parts(data: bytes) -> list[tuple]:
    """(place, length, headers, body) of the records in plain bytes, and of the gaps between them (headers and body None), that together cover all bytes."""
    at, gap, out = 0, 0, []
    while at < len(data):
        if one := parse(data, at):
            if gap < at:
                out.append((gap, at - gap, None, None))
            out.append((at, one[2] - at, *one[:2]))
            at = gap = one[2]
        else:
            at = data.find(VERSION, at + 1)
            if at < 0:
                break
    if gap < len(data):
        out.append((gap, len(data) - gap, None, None))
    return out


def salvage(data: bytes):
    """Yields ("record", place, length, headers, body, inner) and ("gap", place, length, None, None, inner) that together cover all bytes.

    Members may hold several records, plain records may follow members, and what follows a damaged part is found by searching for the next start that passes.
    The parts of a member have its place and length, and as ``inner`` their own (place, length) in what it inflates to, which they cover; ``inner`` is None for
    plain records and for gaps in the file. A damaged or cut-off member with good records reaches to the next start that passes, and ends with a gap:
    the part that the damage reaches, even if it is a record whose bytes are all there.
    """
    at, gap, n = 0, 0, len(data)
    broken, failed = [], 0  # parts of a damaged member that begins at ``gap``, and the place where it fails

    def left(end):
        if broken:
            for place, length, head, body in broken:
                yield "gap" if head is None else "record", gap, end - gap, head, body, (place, length)
        elif gap < end:
            yield "gap", gap, end - gap, None, None, None

    while at < n:
        found, end, member_end, plain = [], at, 0, False
        if data.startswith(MEMBER, at):
            content, stop, whole = inflate(data, at)
            parts = plain_parts(content)
            if not whole and parts:
                # The part that the damage reaches has no end or check behind it.
                parts[-1] = (*parts[-1][:2], None, None)
            good = any(p[2] is not None for p in parts)
            if whole and good:
                found, end = parts, stop
            elif whole:
                member_end = stop
            elif good:
                yield from left(at)
                gap, failed = at, stop
                broken = parts
        elif one := parse(data, at):
            # Stored blocks show the records of a damaged member a second time.
            if at < failed and any(p[2:] == one[:2] for p in broken):
                member_end = one[2]
            else:
                found, end, plain = [(0, one[2] - at, *one[:2])], one[2], True
        if found:
            yield from left(at)
            broken, failed = [], 0
            for place, length, head, body in found:
                yield "gap" if head is None else "record", at, end - at, head, body, None if plain else (place, length)
            at = gap = end
        elif member_end:
            at = member_end
        else:
            nexts = [p for p in (data.find(MEMBER, at + 1), data.find(VERSION, at + 1)) if p >= 0]
            at = min(nexts) if nexts else n
    yield from left(n)


_READ = "file string, place bigint, length bigint, gap boolean, page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload string, inner_place bigint, inner_length bigint"


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """All records and quarantined gaps of archive contents (columns path, content, as the binaryFile source gives): one row each, with place and length in bytes,
    and with inner_place and inner_length where it is a part of what a member inflates to.

    A damaged file gives its other records; an empty one gives none. ``payloads`` adds the payload of responses.
    """

    def number(uri: str):
        m = re.search(r"urn:page:(-?\d+)>", uri or "")
        return int(m[1]) if m else None

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for kind, place, length, head, body, inner in salvage(content.as_py() or b""):
                    h = head or {}
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    size = h.get("x-payload-length", "")
                    rows.append((path, place, length, kind == "gap", number(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), digest if head is None or h.get("warc-type") == "revisit" else hashlib.sha256(body).hexdigest(), (int(size) if size.isdigit() else None) if h.get("warc-type") == "revisit" else (None if head is None else len(body)), number(h.get("warc-refers-to")), body.decode("utf-8", "replace") if payloads and body is not None else None, *(inner or (None, None))))
                    if len(rows) == 2000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    # One file a batch: contents are large.
    return files.select("path", "content").mapInArrow(run, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [f.strip().split()[0] for f in _READ.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


#: Tasks that read archives, at most.
READERS = 20_000


def archive_contents(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The listed files' contents (path, content). The list is dealt to tasks, which open the files; an archive has about ``FILE_BYTES``, and each is a batch of its own."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    return listed.select("file").repartition(max(1, min(listed.count(), READERS))).mapInArrow(run, "path string, content binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at)
    listed = write_archives(plan_records(pages), path)
    records = read_archives(archive_contents(spark, listed)).filter("not gap")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> f THEN f END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
"""
