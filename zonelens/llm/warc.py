"""WARC archives: writer with revisit records, splittable reader.

Writer: every partition writes files of one gzip member per record into a shared
folder.  Of records with equal payloads of at least ``REVISIT_FROM`` bytes, the one
with the smallest page_id is a ``response``; the others are ``revisit`` records that
carry the payload's digest and length but not the payload.  The list of finished
files is checkpointed, so a retried task's half-written file is never read and the
archives are not written twice.

Reader: files are cut into byte ranges and dealt out as rows.  A task searches its
range for the gzip magic, and takes a candidate as a member only if it inflates to a
WARC header and, read to its end, keeps its checksum and its record length.  A task
owns the records that *start* in its range and reads past the end of the range to
finish the last one, so every record is read once and no index is needed.

Defined results: null html is an empty payload; null url leaves out the target URI;
a null page_id is a response of its own (record id without a number); pages repeated
with the same page_id and payload are all responses; an empty table writes no file
and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelens.llm.common import buckets, cut, fresh_folder, table
from zonelens.session import prepare_workers

REVISIT_FROM = 100
#: Bytes of a file after which a task begins the next, of a byte range, and of one read.
FILE_BYTES, RANGE_BYTES, READ_BYTES = 256 << 20, 8 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
_BARE = re.compile(r"[^\x21-\x7e]")


def open_fs(uri: str):
    """(file system, path) of a folder or file in any store pyarrow can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^(\w+):/+", r"\1:///", uri))


def _uri(url: str) -> str:
    """The url as a header value: bytes other than printable ASCII escaped."""
    return _BARE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        body = http + payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        body = http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    all_pages = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"),
                             F.sha2(payload, 256).alias("digest"))
    digests = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(
        f"n >= {REVISIT_FROM} AND page_id IS NOT NULL")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where(
        "k > 1").select(F.col("digest").alias("d"), "refers_to")
    again = (digests.join(first, (F.col("digest") == F.col("d")) & (F.col("page_id") != F.col("refers_to")))
             .select(F.col("page_id").alias("r_id"), "d", "refers_to").distinct())
    return all_pages.join(again, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("d")), "left").select(
        "page_id", "url", "payload", "digest", "refers_to")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns path and size of each finished file."""

    def write(batches) -> Iterator:
        import pandas as pd

        store, top = open_fs(folder)
        store.create_dir(top, recursive=True)
        out, path, size, done = None, "", 0, []
        for batch in batches:
            cols = [batch.column(c) for c in range(batch.num_columns)]
            for i in range(batch.num_rows):
                data = _member(record(*(c[i].as_py() for c in cols)))
                if out is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    out, size = store.open_output_stream(f"{top}/{path.rsplit('/', 1)[1]}", compression=None), 0
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        import pyarrow as pa

        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["path", "size"]).astype({"path": object, "size": "int64"}),
                                         schema=pa.schema([("path", pa.string()), ("size", pa.int64())]), preserve_index=False)

    prepare_workers(pages.sparkSession)
    return cut(with_revisits(pages).mapInArrow(write, "path string, size long"))


class _Source:
    """Reads on from a position of an open file, as far as needed."""

    def __init__(self, file, start: int) -> None:
        self.file, self.base, self.data = file, start, b""
        file.seek(start)

    def fill(self, upto: int) -> bool:
        """Has the byte before ``upto``, if the file has."""
        while self.base + len(self.data) < upto:
            more = self.file.read(READ_BYTES)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, before: int) -> None:
        if before > self.base:
            self.data, self.base = self.data[before - self.base:], before


def _inflate(src: _Source, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and its end, or None if none does."""
    z, pos, out = zlib.decompressobj(31), at, []
    try:
        while not z.eof:
            if not src.fill(pos + 1):
                return None
            chunk = src.data[pos - src.base:]
            out.append(z.decompress(chunk))
            if len(out) == 1 and not out[0].startswith(b"WARC/"[:len(out[0])]):
                return None
            pos += len(chunk) - len(z.unused_data)
    except zlib.error:
        return None
    return b"".join(out), pos


def _parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = fields.get("content-length", "")
    if not n.isdigit() or len(rest) != int(n) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return fields, rest[:-4]


def records_in(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose member starts in [start, end)."""
    src, at = _Source(file, start), start
    while at < end:
        src.drop(at)
        src.fill(at + 3)
        if not src.data.startswith(MAGIC):
            here = src.data.find(MAGIC)
            if here < 0:
                seen = src.base + len(src.data)
                at = max(at + 1, seen - 2)
                if not src.fill(seen + 1):
                    return
                continue
            at += here
            continue
        found = _inflate(src, at)
        parsed = found and _parse(found[0])
        if parsed:
            yield parsed
            at = found[1]
        else:
            at += 1


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the files (path, size): record_id, record_type, target_uri,
    refers_to, payload_digest (bare hex), payload_bytes, payload (null for revisits,
    or if ``payloads`` is off).  Digest and length of a response are taken from the
    payload read, and must be those its header states."""
    ranges = files.where("size > 0").select("path", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(buckets(files.sparkSession), "path", "start")

    def read(batches):
        import pandas as pd

        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                store, inner = open_fs(path)
                rows, held = [], 0
                with store.open_input_file(inner) as file:
                    for head, block in records_in(file, int(start), int(start) + range_bytes):
                        kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").rpartition(":")[2]
                        n, payload = int(head.get("x-payload-length", 0)), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, n):
                                raise ValueError(f"{path}: payload of {head.get('warc-record-id')} is not what its header states")
                        rows.append((head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-refers-to"),
                                     digest, n, payload if payloads else None))
                        held += len(payload or b"") if payloads else 100
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return ranges.mapInPandas(read, "record_id string, record_type string, target_uri string, refers_to string, "
                                    "payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, spark: SparkSession, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per page, as
    read back from the archives written."""
    kind = dict(pages.dtypes)["page_id"]
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    files = write_warc(pages, fresh_folder(spark, "warc"))
    return read_warc(files, range_bytes, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))


def op9_warc_ranges(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"), spark)


OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to FROM f
"""
