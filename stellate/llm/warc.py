"""WARC archives, read back through an index that is written first.

`write` puts one record per page into archives, one archive per partition, each record
compressed by itself, and returns the index: archive, offset, length, URL and digest of
each record. `read` selects records by that index, sorts the byte ranges of each
archive, joins those that lie close, and reads each joined range once. Archives lie in
the folder that the driver and all executors share.

Of pages with equal payloads of at least 100 bytes, the one with the smallest id is
written as a response, the others as revisits that name it and hold no payload; equal
payloads share a SHA-256 digest. Groups of any size are met by partial aggregation and
a join with one row per digest.

Defined cases: null html is an empty payload, a null URL an empty one; rows without an
id are written as responses and are never referred to; rows that repeat an id are
written each on its own, and as the smallest of their group are all responses; an empty
table gives an empty index. An archive of a task that failed is left behind without an
entry in the index.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, shared_dir

#: Fixed value: payloads under this many bytes are never revisits.
LEAST_REVISIT = 100
#: Ranges with at most this gap are read at once, up to this many bytes.
GAP, MOST_RANGE = 64 << 10, 8 << 20
#: Compressed bytes that a reading task takes, ranges by which archives are dealt to tasks, and payload bytes of a batch it hands on.
TASK_BYTES, DEALT, BATCH_BYTES = 32 << 20, 1 << 20, 8 << 20
#: Ids of revisits, of about 60 bytes each with what they refer to, that may be broadcast.
BROADCAST_IDS = 200_000
VERSION = b"WARC/1.1\r\n"
#: One fixed date, so that equal tables give equal archives.
DATE = "2020-01-01T00:00:00Z"


def _opened(folder: str):
    """The file system of a folder and the folder's path there."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", folder):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """One record. A revisit holds the headers of the payload it stands for, and no payload."""
    kind = "response" if refers_to is None else "revisit"
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, by name, and the payload of one record."""
    if not record.startswith(VERSION):
        raise ValueError("no WARC record begins here")
    head, _, rest = record[len(VERSION) :].partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its end")
    return headers, rest[:size]


def _packed(record: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def plan(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and refers_to of the pages that are revisits, one row per id."""
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.octet_length(payload).alias("size"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    rows = checkpointed(rows.where(f"size >= {LEAST_REVISIT} and page_id is not null").select("page_id", "digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "digest").where("page_id <> refers_to").select("page_id", "refers_to", F.hex("digest").alias("for")).distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives of `pages` under `folder`; returns the index, already computed:
    archive, offset, length (both in bytes), page_id, url, digest."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("for", F.sha2("payload", 256))
    revisits = checkpointed(plan(pages, id_col, html_col).withColumn("for", F.lower("for")))
    # Few revisits go to every task, and no payload is shuffled.
    few = revisits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(revisits) if few else revisits, ["page_id", "for"], "left").select("page_id", "url", "payload", "for", "refers_to")

    def run(batches):
        system, path = _opened(folder)
        archive, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = system.open_output_stream(f"{path}/{archive}", compression=None)
                packed = _packed(record_bytes(page_id, url, payload, digest, refers_to, len(payload)))
                out.write(packed)
                index.append((archive, at, len(packed), page_id, url, digest))
                at += len(packed)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), types)], names=names)
        if out is not None:
            out.close()

    names = ["archive", "offset", "length", "page_id", "url", "digest"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return checkpointed(map_batches(rows, run, "archive string, offset bigint, length bigint, page_id bigint, url string, digest string"))


def joined_ranges(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST_RANGE) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) ranges joined where they lie close: (offset, length, how many)."""
    out: list[list[int]] = []
    for offset, length in ranges:
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length - out[-1][0])
            out[-1][2] += 1
        else:
            out.append([offset, length, 1])
    return [tuple(x) for x in out]


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index's rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response's payload is checked against its digest; a revisit's payload is null."""
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT)))
    wanted = index.select("archive", "offset", "length").repartition(tasks, "archive", F.expr(f"offset div {DEALT}")).sortWithinPartitions("archive", "offset")

    def records(batch):
        system, path = _opened(folder)
        archive, offset, length = (batch.column(k).to_pylist() for k in range(3))
        done = 0
        while done < len(archive):
            end = done
            while end < len(archive) and archive[end] == archive[done]:
                end += 1
            with system.open_input_file(f"{path}/{archive[done]}") as f:
                for start, size, n in joined_ranges(list(zip(offset[done:end], length[done:end]))):
                    f.seek(start)
                    data = f.read(size)
                    for k in range(done, done + n):
                        yield parse_record(zlib.decompress(data[offset[k] - start : offset[k] - start + length[k]], 31))
                    done += n

    def number(text):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text)
        return int(found[1]) if found else None

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for head, payload in records(batch):
                digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} does not fit its digest")
                refers = number(head["WARC-Refers-To"]) if revisit else None
                out.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["WARC-Payload-Length"]), digest, head["WARC-Type"], refers, None if revisit else payload))
                held += len(payload)
                if held > BATCH_BYTES:
                    yield rows(out)
                    out, held = [], 0
            yield rows(out)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) if out else [()] * 7, types)], names=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return map_batches(wanted, run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary", rows=8192)


def new_folder(spark) -> str:
    """A folder of its own for archives, under the shared one."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    return folder


ORACLE_SQL = """
with t as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from t)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
