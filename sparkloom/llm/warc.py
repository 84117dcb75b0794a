"""WARC archives: writing, normalising monolithic gzip, reading by index.

A *monolithic* archive is one gzip stream around all records, so nothing in it
can be reached without inflating everything before it. The normaliser inflates
that stream once, piece by piece, rewrites every record as a gzip member of its
own, and writes a sidecar index (JSON lines: offset, length, id, type). Readers
then seek to members.

Archives are written by tasks, one for each input partition, into the folder
that all executors share, under a name of the task's attempt first and renamed
when whole, so a lost executor leaves no half archive under a final name. Only
file names and index entries are rows.

Deduplication: of records with equal payloads of at least ``MIN_BYTES`` bytes,
those with the smallest id are responses, all others are revisits of it without
a stored payload. Digests are grouped by aggregation, so a payload that a third
of all pages share meets no single task.

Edge cases: a null payload is empty; shorter payloads are never deduplicated;
rows that repeat the smallest id are each a response; null ids are written
without an id, rank after all others and cannot be referred to; if all ids of a payload are null its rows are
responses; null URLs are written as ``about:blank``; a record is in memory whole,
whatever its length, an archive never; an empty table gives no
archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, goes_at_exit, shared_dir, small_batches, table

MIN_BYTES = 100
CHUNK = 1 << 20
LEVEL = 4


def record(page_id, url: str | None, kind: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record as bytes; a revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def records(chunks):
    """Records of an inflated stream that arrives in pieces of any size."""
    held = bytearray()
    for c in chunks:
        held += c
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = next(int(x[15:]) for x in bytes(held[:end]).split(b"\r\n") if x[:15].lower() == b"content-length:")
            if len(held) < end + 8 + size:
                break
            yield bytes(held[: end + 8 + size])
            del held[: end + 8 + size]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflated(stream):
    """Pieces of a gzip stream's content (of all its members)."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = z.decompress(data, CHUNK)  # never more at once, however well it was packed
            yield out
            while len(out) == CHUNK and not z.unconsumed_tail and not z.eof:
                out = z.decompress(b"", CHUNK)
                yield out
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _publish(fs, made: str, name: str) -> None:
    """Gives a whole file its final name; a file of that name is an earlier attempt's, with the same content."""
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)
    fs.move(made, name)


def _attempt() -> tuple[str, str]:
    t = TaskContext.get()
    return f"{t.partitionId():06d}", f"{t.taskAttemptId()}"


def write_monolithic(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``page_id, url, payload, digest, kind, refers_to`` as one gzip stream for each partition; ``file`` of each."""

    def run(batches):
        part, attempt = _attempt()
        fs, base = _open(folder)
        out, z = None, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for b in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{base}/.{part}-{attempt}")
                out.write(z.compress(record(page_id, url, kind, payload or b"", digest, refers_to, date)))
        if out is not None:
            out.write(z.flush())
            out.close()
            _publish(fs, f"{base}/.{part}-{attempt}", f"{base}/{part}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}.warc.gz"])], names=["file"])

    return rows.select("page_id", "url", "payload", "digest", "kind", "refers_to").mapInArrow(run, "file string")


def normalise(files: DataFrame, folder: str, target: str, keep_source: bool = True) -> DataFrame:
    """Rewrites each ``file`` record by record, with a sidecar index; ``file, n_records`` of each."""

    def run(batches):
        _, attempt = _attempt()
        (fs, base), (to, there) = _open(folder), _open(target)
        for b in batches:
            for name in b.column(0).to_pylist():
                index, at = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source, to.open_output_stream(f"{there}/.{name}-{attempt}", compression=None) as out:
                    for raw in records(inflated(source)):
                        fields, _ = parse(raw)
                        member = gzip.compress(raw, LEVEL, mtime=0)
                        out.write(member)
                        index.append({"offset": at, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "uri": fields["warc-target-uri"]})
                        at += len(member)
                with to.open_output_stream(f"{there}/.{name}.idx-{attempt}", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                _publish(to, f"{there}/.{name}.idx-{attempt}", f"{there}/{name}.idx")
                _publish(to, f"{there}/.{name}-{attempt}", f"{there}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], names=["file", "n_records"])

    return files.select("file").mapInArrow(run, "file string, n_records bigint")


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the normalised archives, by their index, with digests computed from what is stored."""

    def run(batches):
        fs, base = _open(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")}
                with fs.open_input_file(f"{base}/{name}") as f:
                    for x in index:
                        f.seek(x["offset"])
                        fields, block = parse(gzip.decompress(f.read(x["length"])))
                        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                        if fields["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                                raise ValueError(f"{name} at {x['offset']}: payload and digest differ")
                        refers_to, page_id = fields.get("x-refers-to-page-id"), fields.get("x-page-id")
                        for k, v in zip(out, (page_id, size, digest, fields["warc-type"], refers_to, fields["warc-target-uri"])):
                            out[k].append(v)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return files.select("file").mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, uri string")


def plan_records(pages: DataFrame, small: int = 500_000) -> DataFrame:
    """``page_id, url, payload, digest, kind, refers_to`` of every row."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    twice = cut(groups.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    out = rows.join(F.broadcast(twice) if twice.count() <= small else twice, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes and normalises the archives of ``page_id, url, html``; their ``file`` names, and their folder.

    Without a ``folder`` they are written to the shared one, and go when the application ends.
    """
    own = folder is None
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).makeQualified(path).toString()  # without a scheme: the cluster's own file system
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    for sub in ("whole", "members"):
        fs, base = _open(f"{folder}/{sub}")
        fs.create_dir(base, recursive=True)
    if own:
        goes_at_exit(pages.sparkSession, folder)
    files = cut(write_monolithic(plan_records(pages), f"{folder}/whole"))
    done = cut(normalise(files, f"{folder}/whole", f"{folder}/members"))
    fs, base = _open(f"{folder}/whole")
    fs.delete_dir(base)  # every archive has been rewritten whole
    return done, f"{folder}/members"


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: what the archives hold for every page."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages")
    files, folder = archive(pages)
    kind = pages.schema["page_id"].dataType
    out = read_back(files, folder)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM r
"""
