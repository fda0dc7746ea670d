"""WARC archives, index first.

Writing: every task writes one archive of gzip members, a member a record, under a name of its own
attempt, and returns the index of what it wrote: file, offset, length, URL, digest.  The index is a table;
an archive that no index row names (a lost or repeated attempt) is never read.

Reading: index rows are selected first, sorted by file and offset, and neighbouring records are
coalesced into ranges of bounded size and small gaps.  Only these ranges are read, one read each.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is a
response, the others are revisits that refer to it and hold its HTTP head without the payload.

Ids are written percent-encoded, so whatever they hold they come back as they were; of URLs only control
characters are, so no URL can end its line or start another field, and the index keeps the exact URL.

Defined results: null payloads are empty; null URLs are written as an empty target; a null id is written as
``urn:page-null`` and comes back null; rows that share
their id and payload with the chosen response are all responses; a page with a null id never
becomes the target of a revisit unless all of its group are null, which then are all responses; an empty table
gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plainread.llm.common import type_of
from plainread.session import materialize, new_path

MIN_REVISIT = 1000
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Bytes of archives that a task reads.
TASK_BYTES = 128 << 20
CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
NO_PAGE = "urn:page-null"
#: A fixed date keeps archives of equal pages equal.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def name_of(page: str | None) -> str:
    return NO_PAGE if page is None else f"urn:page:{quote(page, safe='')}"


def page_of(name: str) -> str | None:
    return None if name == NO_PAGE else unquote(name.removeprefix("urn:page:"))


def one_line(url: str) -> str:
    return CONTROL.sub(lambda c: quote(c[0]), url)


def record(page: str | None, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One uncompressed record."""
    digest = hashlib.sha1(payload).hexdigest()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{name_of(page)}>", f"WARC-Target-URI: {one_line(url)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{name_of(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; the payload as it stands there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (x.partition(b": ") for x in http.split(b"\r\n"))
                if k.lower() == b"content-length")
    target = fields.get("warc-refers-to")
    return {"page": page_of(fields["warc-record-id"][1:-1]), "url": fields["warc-target-uri"],
            "type": fields["warc-type"], "digest": fields["warc-payload-digest"][5:],
            "refers_to": target and page_of(target[1:-1]),
            "payload": payload, "payload_bytes": size}


def revisit_targets(pages: DataFrame, min_revisit: int) -> DataFrame:
    """``pages`` (_id, _url, _payload) with _refers_to, null for responses."""
    keyed = pages.select("_id", F.sha2("_payload", 256).alias("_same"),
                         F.octet_length("_payload").alias("_size")).filter(F.col("_size") >= min_revisit)
    best = keyed.groupBy("_same").agg(F.max("_id").alias("_target"), F.count("*").alias("_n")).filter(
        "_n > 1 and _target is not null").select("_same", "_target")
    # Narrow rows meet here; a group of copies is one hot key, which Spark splits.
    other = keyed.join(best, "_same").filter(~F.col("_id").eqNullSafe(F.col("_target"))).select(
        F.col("_id").alias("_other"), "_same", "_target").distinct()
    whole = pages.withColumn("_key", F.sha2("_payload", 256))
    return whole.join(other, whole["_id"].eqNullSafe(other["_other"]) & (whole["_key"] == other["_same"]), "left"
                      ).select("_id", "_url", "_payload", F.col("_target").alias("_refers_to"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes archives below ``path`` (a URI that every executor reaches) and returns their index:
    (file, offset, length, <page_id>, url, digest)."""
    rows = pages.select(F.col(page_id).alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("_payload"))
    kind = type_of(rows, "_id")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            index = []
            for i in range(batch.num_rows):
                page, url_, payload, target = (batch.column(c)[i].as_py() for c in (
                    "_id", "_url", "_payload", "_refers_to"))
                member = gzip.compress(record(None if page is None else str(page), url_, payload,
                                              None if target is None else str(target)), 6, mtime=0)
                out = out or store.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(member)
                index.append((f"{path}/{name}", at, len(member), page, url_, hashlib.sha1(payload).hexdigest()))
                at += len(member)
            if index:
                types = [pa.string(), pa.int64(), pa.int64(), batch.column("_id").type, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), types)],
                                                 ["file", "offset", "length", page_id, "url", "digest"])
        if out is not None:
            out.close()

    made = revisit_targets(rows, min_revisit).mapInArrow(
        archive, f"file string, offset bigint, length bigint, `{page_id}` {kind}, url string, digest string")
    return materialize(made, "warc-index")


def ranges(index: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """(file, begin, end, records): coalesced reads of the index rows, records as (offset, length).

    A read ends where the gap to the next record is wide or the next multiple of ``range_bytes`` in
    the file begins, so reads are bounded whatever the file's size.
    """
    rows = index.select("file", "offset", "length").distinct().withColumn(
        "_part", F.floor(F.col("offset") / range_bytes))
    order = Window.partitionBy("file", "_part").orderBy("offset")
    last = F.lag(F.col("offset") + F.col("length")).over(order)
    opens = F.when(F.col("offset") - last <= gap_bytes, 0).otherwise(1)
    numbered = rows.withColumn("_opens", opens).withColumn("_read", F.sum("_opens").over(order))
    return numbered.groupBy("file", "_part", "_read").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")
    ).select("file", "begin", "end", "records")


def read(index: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records the index rows name: (file, offset, record_id, url, record_type, refers_to,
    payload, payload_bytes, payload_digest).

    Digests of responses are computed from the payload read and must agree with the record's head; a
    revisit has the digest and size of the payload it refers to.
    """
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "record_id", "url", "record_type", "refers_to", "payload",
                 "payload_bytes", "payload_digest"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(),
                 pa.int64(), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["file"])
                with store.open_input_file(name) as source:
                    data = source.read_at(row["end"] - row["begin"], row["begin"])
                out = []
                for r in row["records"]:
                    begin = r["offset"] - row["begin"]
                    got = parse(zlib.decompress(data[begin:begin + r["length"]], 31))
                    digest = got["digest"]
                    if got["type"] == "response" and hashlib.sha1(got["payload"]).hexdigest() != digest:
                        raise ValueError(f"{row['file']} at {r['offset']}: the payload is damaged")
                    out.append((row["file"], r["offset"], got["page"], got["url"], got["type"], got["refers_to"],
                                got["payload"], got["payload_bytes"], digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    # As many tasks as the bytes ask for, and on a small archive as many as there are cores.
    total = index.agg(F.sum("length")).first()[0] or 0
    few = min(index.sparkSession.sparkContext.defaultParallelism, -(-total // range_bytes))
    tasks = max(1, few, -(-total // TASK_BYTES))
    reads = ranges(index, range_bytes, gap_bytes).repartition(tasks, "file", "begin").sortWithinPartitions("file", "begin")
    return reads.mapInArrow(fetch, "file string, offset bigint, record_id string, url string, record_type string, "
                            "refers_to string, payload binary, payload_bytes bigint, payload_digest string")


def new_archive(pages: DataFrame) -> str:
    """A fresh folder for archives, in the shared folder of the session, as a URI."""
    path = new_path(pages.sparkSession, "warc")
    if path.startswith("/"):  # a path of the cluster's default file system
        default = pages.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        path = "file:" + path if default.startswith("file:") else default.rstrip("/") + path
    return path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path
