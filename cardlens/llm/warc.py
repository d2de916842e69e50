"""WARC archives: a writer with revisit records and a splittable reader.

The writer makes one gzip member a record, so an archive can be cut at any member.
The reader deals byte ranges of the archives out over the tasks. A task looks for
gzip magic inside its range, accepts a candidate only if it decodes to a WARC
header and the members that follow it run gaplessly to the range's end, and owns
the records that start inside the range; the last one may be read past the end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._util import materialize, prepare, scratch_path, shuffle_partitions, table

REVISIT_BYTES = 0        # equal payloads of at least so many bytes become revisits
ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond this size
RANGE_BYTES = 4 << 20     # bytes of a reading task's range
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder or file that all executors see."""
    local = re.match(r"file:/*(/.*)", uri)
    return (pyarrow.fs.LocalFileSystem(), local[1]) if local else pyarrow.fs.FileSystem.from_uri(uri)


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http;msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES,
               archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``folder``.

    Returns the manifest, one row an archive: path, bytes, records. It names only
    what the attempts that succeeded have written (names carry the attempt), so a
    task that is run again does no harm.

    Of equal payloads of at least ``revisit_bytes`` bytes, the record with the
    largest page_id is a response and the others revisit it; all smaller ones are
    responses. Rows that repeat the largest id are all responses; a null id counts
    as the smallest and, where no equal payload has an id, its rows are responses.
    A null html is the empty payload; a null url leaves out the target.
    """
    spark = pages.sparkSession
    prepare(spark)
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         body.alias("payload"))
    key = F.sha2("payload", 256)
    # payloads that occur twice or more; written, so that the join reads plain shuffles and
    # AQE can split a payload that a third of all pages have
    again = materialize(pages.groupBy(key.alias("key")).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
                        .where("n > 1").select("key", "refers_to"), "copies")
    rows = (pages.withColumn("key", key).join(again, "key", "left")
            .withColumn("revisit", F.col("refers_to").isNotNull() & (F.octet_length("payload") >= revisit_bytes)
                        & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("page_id", "url", "payload", "refers_to", "revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        stream, done = None, {"path": [], "bytes": [], "records": []}

        def close():
            done["bytes"].append(stream.tell())
            stream.close()

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit")]
            for row in zip(*cols):
                if stream is not None and stream.tell() >= archive_bytes:
                    close()
                    stream = None
                if stream is None:
                    name = f"pages-{context.partitionId():05d}-{context.taskAttemptId()}-{len(done['path']):03d}.warc.gz"
                    stream = fs.open_output_stream(f"{at}/{name}", compression=None)
                    done["path"].append(f"{folder}/{name}")
                    done["records"].append(0)
                stream.write(_record(*(x.as_py() for x in row)))
                done["records"][-1] += 1
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pydict(done, schema=pa.schema(
            [("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return materialize(rows.mapInArrow(write, "path string, bytes long, records long"), "manifest")


class _Window:
    """The bytes of a file from ``start`` on, read as far as they are asked for."""

    def __init__(self, file, start: int, stop: int, size: int):
        self.file, self.start, self.size = file, start, size
        self.data = bytearray(file.read_at(min(stop + len(_MAGIC) - 1, size) - start, start))

    def more(self) -> bool:
        at = self.start + len(self.data)
        got = self.file.read_at(min(1 << 20, self.size - at), at) if at < self.size else b""
        self.data += got
        return bool(got)

    def member(self, at: int, whole: bool = True) -> tuple[bytes, int] | None:
        """(content, end) of the gzip member at ``at`` if it holds a WARC record."""
        unpack, out, done = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if done >= len(self.data) and not self.more():
                return None  # cut off
            part = bytes(self.data[done:done + (1 << 16)])
            try:
                out.append(unpack.decompress(part))
            except zlib.error:
                return None
            done += len(part)
            if len(out) == 1 or sum(map(len, out)) < 16:
                seen = b"".join(out)[:7]
                if not b"WARC/1.".startswith(seen):
                    return None
                if not whole and len(seen) == 7:
                    return seen, done
        content = b"".join(out)
        return (content, done - len(unpack.unused_data)) if content.startswith(b"WARC/1.") else None


def _records(file, start: int, stop: int, size: int) -> list[bytes]:
    """The records that start in ``start:stop`` of an archive of ``size`` bytes.

    A candidate counts if the members that follow it without a gap reach the range's
    end, and over 64 KiB or the archive's end. Members of an archive that is itself
    stored in a record without compression look like candidates, but their chain breaks
    where deflate's stored blocks end, every 64 KiB at least. Where candidates were seen
    and none counts, the archive is walked from its first byte, which settles it.
    """
    stop = min(stop, size)
    window, scan, seen = _Window(file, start, stop, size), 0, False
    while True:
        at = 0 if start == 0 and scan == 0 else window.data.find(_MAGIC, scan, stop - start + len(_MAGIC) - 1)
        if at < 0 or at >= stop - start:
            return _walk(file, start, stop, size) if seen or start == 0 else []
        chain, here = [], at
        while start + here < size and (here < stop - start or here - at < 1 << 16):
            got = window.member(here)
            if got is None:
                break
            if here < stop - start:
                chain.append(got[0])
            here = got[1]
        else:
            if start + here >= size or window.member(here, whole=False):
                return chain
        seen = seen or bool(chain)
        scan = at + 1


def _walk(file, start: int, stop: int, size: int) -> list[bytes]:
    """The same from the archive's first byte on, member by member."""
    out, at = [], 0
    while at < stop:
        got = _Window(file, at, min(at + (1 << 16), size), size).member(0)
        if got is None:
            raise ValueError(f"no whole member at byte {at}")
        if at >= start:
            out.append(got[0])
        at += got[1]
    return out


def _parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[:int(fields["content-length"])]
    out = {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"),
           "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
           "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2] or None,
           "payload_bytes": len(block), "payload": block}
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        out["payload"], out["payload_bytes"] = payload, len(payload)
        if out["record_type"] == "revisit":
            length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            out["payload"], out["payload_bytes"] = None, int(length[1]) if length else None
    if out["record_type"] == "response":
        digest = base64.b32encode(hashlib.sha1(out["payload"]).digest()).decode()
        if out["payload_digest"] not in (None, digest):
            raise ValueError(f"payload of {out['record_id']} does not have its digest")
        out["payload_digest"] = digest
    return out


def read_warc(archives: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path, bytes): record_id, record_type, target_uri,
    refers_to, payload_digest, payload_bytes and, if asked for, payload.

    Empty archives and an empty list give no rows. Damage (a cut or altered member, a
    payload without its digest) fails the read instead of losing records.
    """
    prepare(archives.sparkSession)
    ranges = (archives.where("path is not null and bytes > 0")
              .select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {int(range_bytes)}L)")).alias("start"))
              .repartition(shuffle_partitions(archives.sparkSession)))
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes"]
    kinds = [pa.string()] * 5 + [pa.int64()]
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = _open(row["path"])
                with fs.open_input_file(at) as file:
                    found = _records(file, row["start"], row["start"] + range_bytes, row["bytes"])
                for i in range(0, len(found), 100):
                    parsed = [_parse(r) for r in found[i:i + 100]]
                    yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in parsed], k) for n, k in zip(names, kinds)], names=names)

    return ranges.mapInArrow(read, ", ".join(f"{n} {'long' if k == pa.int64() else 'binary' if k == pa.binary() else 'string'}"
                                             for n, k in zip(names, kinds)))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    prepare(pages.sparkSession)
    manifest = write_warc(pages, scratch_path(pages.sparkSession, "warc"))
    number = lambda c: F.expr(f"try_cast(nullif(substr({c}, {len(_URN) + 1}), '') as bigint)")
    return read_warc(manifest, with_payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the whole ``pages`` table, read back."""
    return archive_pages(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x,
             max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT *, array_to_string(flatten([
        [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * g + 1, 5))::INT >> s) & 31) + 1, 1)
         FOR s IN [15, 10, 5, 0]] FOR g IN range(8)]), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
