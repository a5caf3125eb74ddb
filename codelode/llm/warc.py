"""WARC archives: a writer of deduplicated records and a reader that salvages damaged files.

Archives are .warc.gz files with one gzip member a record. The reader takes any archive, with records of any kind and any number of
them in a member. It takes a member only if its gzip checksum holds, and a record only if its version line, Content-Length and block
digest do. After a failed check it searches for the next place where a member (or, in plain archives and within members, a version
line) starts and passes these checks, goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm._common import shared_dir, slabs

#: Bytes after which a writer starts another archive.
ROLL_BYTES = 16 << 20
_MAGIC = b"\x1f\x8b\x08"
_FEED = 1 << 15
_VERSION, _VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"\nWARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_READ = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long, gap_bytes long, gap_reason string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:codelode:page:{'null' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    """The page_id in a record id of this writer; null for other ids."""
    tail = (uri or "").strip("<>").removeprefix("urn:codelode:page:")
    return page if re.fullmatch("-?[0-9]{1,19}", tail) and -1 << 63 <= (page := int(tail)) < 1 << 63 else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only and names the record with the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(ValueError):
    """A record that fails a check."""


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The checked record at a position of uncompressed data, and where it ends."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    following = _VERSION_LINE.search(data, at)  # headers end before it: lines that only look like versions are left at the next
    split = data.find(b"\r\n\r\n", at, following.start() + 1 if following else len(data))
    if split < 0:
        raise Damaged("no end of headers")
    head = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data[at:split]).split(b"\r\n")[1:]:  # folded lines are one
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        head[name.strip().lower().decode("latin1")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not re.fullmatch("[0-9]+", size):
        raise Damaged("no Content-Length")
    size = size.lstrip("0") or "0"
    if len(size) > 18:
        raise Damaged("Content-Length does not fit")
    begin, end = split + 4, split + 4 + int(size)
    block = data[begin:end]
    if len(block) < int(size) or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("Content-Length does not fit")
    if not fits(head.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    return head | {"block": block}, end + 4


def fits(want: str | None, block: bytes) -> bool:
    """Whether a labelled digest, in base 32 or 16, is that of a block; there is nothing to check without one or by other methods."""
    name, _, value = (want or "").partition(":")
    if name.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return True
    raw = hashlib.new(name.lower().replace("-", ""), block).digest()
    return value.upper().rstrip("=") in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


Found = tuple[int, int, dict | None, str | None]


def _member(data: bytes, at: int) -> tuple[list[Found], int]:
    """What is in the gzip member at a position, and where the member ends. One with no good record is damaged."""
    z, view, fed, parts = zlib.decompressobj(31), memoryview(data), at, []
    while not z.eof and fed < len(data):  # piece by piece: what follows a member would be copied each time
        try:
            parts.append(z.decompress(view[fed : fed + _FEED]))
        except zlib.error as e:
            raise Damaged("gzip: " + str(e)) from None
        fed = min(fed + _FEED, len(data))
    if not z.eof:
        raise Damaged("gzip: cut off")
    end = fed - len(z.unused_data)
    inner = list(_walk(b"".join(parts), _plain, _next_version))
    if all(got is None for _, _, got, _ in inner):
        raise Damaged(inner[0][3] if inner else "empty member")
    return [(at, end, got, why) for _, _, got, why in inner], end


def _plain(data: bytes, at: int) -> tuple[list[Found], int]:
    got, end = parse(data, at)
    return [(at, end, got, None)], end


def _next_version(data: bytes, at: int) -> int:
    return m.start() if (m := _VERSION.search(data, at)) else -1


def _walk(data: bytes, read, following) -> Iterator[Found]:
    """All that read finds, and the gaps between, over which following leads to the next place to try."""
    at, gap, why = 0, None, None
    while at < len(data):
        try:
            found, end = read(data, at)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            if (at := following(data, at + 1)) < 0:
                break
            continue
        if gap is not None:
            yield gap, at, None, why
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield gap, len(data), None, why


def salvage(data: bytes) -> Iterator[Found]:
    """(start, end, record, None) for each good record and (start, end, None, reason) for each quarantined gap, in order.

    What shares a gzip member has the start and end of the member.
    """
    zipped = data[:2] == _MAGIC[:2] or (not _VERSION.match(data) and _MAGIC in data)
    return _walk(data, _member, lambda x, at: x.find(_MAGIC, at)) if zipped else _walk(data, _plain, _next_version)


def payload_of(got: dict) -> tuple[bytes | None, int | None]:
    """A record's payload (None for a revisit) and the full payload's size (None where a revisit does not tell).

    The payload is what follows the HTTP header, and the whole block of records that have none.
    """
    block, revisit = got["block"], got.get("warc-type") == "revisit"
    head, split, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    if not revisit:
        return body, len(body)
    told = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})", head)
    return None, int(told[1]) if told else None


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload (UTF-8), refers_to and revisit. Equal payloads are those of one SHA-256 and length.

    Hot payloads cost nothing: the group's largest page_id is pre-aggregated before it is shuffled, and the join that brings it
    back is one that AQE splits. Only groups of two rows or more are joined.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    base = base.withColumn("key", F.sha2("payload", 256))
    groups = base.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("key", "last")
    return base.join(groups, "key", "left").select("page_id", "url", "payload", "key", F.when(F.col("last") != F.coalesce(F.col("page_id"), F.col("last") - 1), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages as archives below folder and return a row per archive: archive, records.

    folder is a URI that all executors reach (file:// on a shared mount, hdfs://, s3://). A partition's rows are sorted, so another
    attempt at it makes the same archives; each is written aside and renamed, so attempts replace one another's archives by
    equal ones and never leave half of one or a record twice.
    """
    rows = decide(pages, min_bytes).sortWithinPartitions("page_id", "url", "key")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt, k, out, size, n, done = task.partitionId(), task.taskAttemptId(), 0, None, 0, 0, []

        def close():
            nonlocal out, k, size, n
            out.close()
            name = f"{root}/part-{part:06d}-{k:04d}.warc.gz"
            if store.get_file_info(name).type != fs.FileType.NotFound:  # of an earlier attempt; renaming does not replace everywhere
                store.delete_file(name)
            store.move(f"{root}/.tmp-{part:06d}-{k:04d}-{attempt}", name)
            done.append((name.rpartition("/")[2], n))
            out, k, size, n = None, k + 1, 0, 0

        for batch in slabs(batches, "payload"):
            for page, url, payload, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    out = store.open_output_stream(f"{root}/.tmp-{part:06d}-{k:04d}-{attempt}", compression=None)
                raw = gzip.compress(record(page, url, payload, to, revisit=to is not None), 4, mtime=0)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["archive", "records"])

    return rows.mapInArrow(f, "archive string, records long")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record salvaged from the archives at path, and one per quarantined gap (with gap_bytes and gap_reason).

    Files come through Spark's binaryFile source, so path can be in any store; a file is held in memory as a whole, so archives
    should be rolled (the writer does at 16 MB). Defined cases: records of other writers have a null page_id and refers_to and
    their own record_id; records without an HTTP block have it whole as payload; a revisit whose size or digest is not told has
    null there; an empty file has no rows; very long headers and payloads are read whole.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("gap_bytes", pa.int64()), ("gap_reason", pa.string())])
        for batch in batches:
            for i in range(len(batch)):
                name, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                rows, held = [], 0
                for at, end, got, why in salvage(data):
                    if got is None:
                        rows.append((*[None] * 8, name, at, end - at, why))
                        continue
                    body, size = payload_of(got)
                    url = got.get("warc-target-uri")
                    if url and got.get("warc-record-id", "").startswith("<urn:codelode:page:"):  # as this writer escapes it
                        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    own = digest(body) if body is not None else (got.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    rows.append((got.get("warc-record-id"), _page(got.get("warc-record-id")), url, got.get("warc-type"), _page(got.get("warc-refers-to")), size, own, body if payloads else None, name, at, None, None))
                    held += len(body or b"") * payloads
                    if held > 8 << 20:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInArrow(f, _READ)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in folder (a new one in the shared folder if None), read them back: a row per page.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to. Defined cases: null html counts as empty; a null
    page_id is the smallest; rows that repeat the largest page_id of their payload are all responses; equal empty payloads are
    equal; a record that cannot be read back fails the job; an empty table gives an empty result; extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    wrote = write_archives(pages, folder, min_bytes).where("archive is not null").agg(F.count("*").alias("archives"), F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()
    if not wrote["n"]:
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select("path").count()
    if there < wrote["archives"]:
        raise RuntimeError(f"{wrote['archives']} archives were written to {folder}, {there} are there")
    whole = F.when(F.col("gap_bytes").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a record just written cannot be read: "), "gap_reason", F.lit(", in "), "archive")).cast("boolean"))
    return read_archives(spark, folder, payloads=False).where(whole).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
