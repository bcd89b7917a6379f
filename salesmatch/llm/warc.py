"""Operator 12: a deterministic, sharded writer of WARC archives, and their reader.

Records are sorted by page_id and cut into shards of like payload size; the cuts
follow from the exact running sum of sizes, so they do not depend on how the input
is partitioned. A shard is written by one task, which regenerates headers, digests
and record ids, compresses every record as gzip members of its own and starts the
next file when the compressed size is reached. Of equal payloads only the one with
the largest page_id is stored; the others become revisit records without payload.

Spark's text writer puts the members into files, so archives can lie in any file
system that Spark writes to: a row is a record's members without their last byte,
which is always 0 (the high byte of a length below 16 MB), and the line end is that
byte. Files are written under a temporary name, renamed, and listed with their
sizes in a manifest that is renamed last; readers take what the manifest lists.
Lost tasks are run again by Spark before anything is renamed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmatch.llm.common import join_hot_keys, shuffle_width, written
from salesmatch.session import scratch_path

#: Payload bytes of a shard (one task), and compressed bytes after which a shard goes on in a new file.
SHARD_BYTES, FILE_BYTES = 64 << 20, 16 << 20
#: Smallest payload that is replaced by a revisit record.
LEAST_REVISIT = 1000
#: Bytes of a record beside its payload, about; and the content of one gzip member at most.
HEADER_BYTES, MEMBER = 700, (1 << 24) - 1
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "manifest.tsv"


def record_id(page_id: int | None, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{repeat}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, name: str, fields: list[tuple[str, str | None]], content: str, block: bytes, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *fields,
            ("WARC-Block-Digest", _sha1(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, repeat: int, url: str | None, payload: bytes, revisits: bool, refers_to: int | None,
                date: str = DATE) -> bytes:
    """A response record with the payload, or a revisit record of the response of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None),
              ("WARC-Payload-Digest", _sha1(payload)), ("X-Page-Id", None if page_id is None else str(page_id))]
    if revisits:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record("revisit" if revisits else "response", record_id(page_id, repeat), fields,
                   "application/http; msgtype=response", http if revisits else http + payload, date)


def members(record: bytes, level: int = 6) -> bytes:
    """The record as gzip members of less than 16 MB of content each; the last byte is 0."""
    out = []
    for at in range(0, len(record), MEMBER):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += [c.compress(record[at:at + MEMBER]), c.flush()]
    return b"".join(out)


def contents(data: bytes, size: int = 1 << 14):
    """The content of every gzip member of ``data``, which is read in small slices: what follows a member's end
    in a slice is read again for the next one."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at == len(view):
                raise ValueError("the archive ends within a gzip member")
            part = view[at:at + size]
            out.append(d.decompress(part))
            at += len(part)
        at -= len(d.unused_data)
        yield b"".join(out)


def records(data: bytes):
    """(headers, block) of every record of an archive; a record may span several members."""
    held = bytearray()
    for content in contents(data):
        held += content
        while True:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            lines = held[:end].decode().split("\r\n")
            head = dict(line.split(": ", 1) for line in lines[1:])
            size = end + 4 + int(head["Content-Length"])
            if len(held) < size + 4:
                break
            if lines[0] != "WARC/1.1" or held[size:size + 4] != b"\r\n\r\n":
                raise ValueError("not a WARC record")
            yield head, bytes(held[end + 4:size])
            del held[:size + 4]
    if held:
        raise ValueError("the archive ends within a record")


def shard_cuts(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """First page_id of every shard but the first, from the exact running sum of ``bytes`` in page_id order. There
    are at most as many as shards of the whole table."""

    def run(batches):
        total, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column(1).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(before), b.column(1), pa.array(np.full(len(n), part))],
                                             ["page_id", "before", "bytes", "part"])

    spark = sizes.sparkSession
    ordered = sizes.select("page_id", "bytes").repartitionByRange(shuffle_width(spark), "page_id").sortWithinPartitions("page_id")
    placed = written(ordered.mapInArrow(run, "page_id long, before long, bytes long, part long"), "sizes")
    parts = placed.groupBy("part").agg(F.sum("bytes").alias("n")).orderBy("part").collect()  # one row for each range
    offsets = spark.createDataFrame([(r.part, int(o)) for r, o in zip(parts, np.cumsum([0, *(r.n for r in parts)]))],
                                    "part long, offset long")
    shard = F.floor((F.col("before") + F.col("offset")) / F.lit(shard_bytes))
    first = placed.join(F.broadcast(offsets), "part").groupBy(shard.alias("shard")).agg(F.min("page_id").alias("first"))
    cuts = first.where("shard > 0 and first is not null").select("first").toArrow().column(0).to_numpy()
    return np.unique(cuts)


def revisits(rows: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, digest and ``refers_to`` of every row whose payload an equal one with a larger page_id stands for."""
    long = written(rows.where(F.col("bytes") >= least).select("page_id", "digest"), "digests")
    groups = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1")
    return join_hot_keys(long, groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least: int = LEAST_REVISIT,
                   date: str = DATE) -> str:
    """Write the pages as WARC files into the new folder ``path`` and return it.

    A null html counts as empty. A null page_id is sorted first and named by no
    X-Page-Id; it stands for equal payloads only if none of them has an id. Rows that
    share a page_id are all written, in the order of their payloads and urls, with record ids of their own;
    copies of the response under its own id are responses too. A null or empty url
    has no WARC-Target-URI; other characters than those of a URI are percent-encoded.
    A long record is spread over several gzip members. Extra columns are ignored;
    an empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    fs = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(files.Path(f"{path}/{MANIFEST}")):
        raise ValueError(f"{path} already holds archives")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    narrow = written(rows.select("page_id", F.octet_length("payload").cast("long").alias("bytes"),
                                 F.unhex(F.sha2("payload", 256)).alias("digest")), "payloads")
    cuts = spark.sparkContext.broadcast(shard_cuts(narrow.select("page_id", (F.col("bytes") + HEADER_BYTES).alias("bytes")),
                                                   shard_bytes))
    none = F.lit(None)
    decided = revisits(narrow, least).select("page_id", none.cast("string").alias("url"), F.col("digest").alias("payload"),
                                             F.lit(0).alias("kind"), "refers_to")
    both = decided.union(rows.select("page_id", "url", "payload", F.lit(1), none.cast("long")))

    def deal(batches):
        for b in batches:
            ids = b.column(0).fill_null(-(1 << 63)).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(cuts.value, ids, "right").astype(np.int32))],
                                             [*b.schema.names, "shard"])

    dealt = both.mapInArrow(deal, "page_id long, url string, payload binary, kind int, refers_to long, shard int")
    dealt = dealt.repartitionById(len(cuts.value) + 1, "shard").sortWithinPartitions("page_id", "kind", "payload", "url")

    def write(batches):
        out, held, seq, name, size, files_, repeat, last, known = [], 0, 0, None, 0, 0, 0, (), {}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.binary()))], ["file", "seq", "value"])

        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "payload", "kind", "refers_to", "shard")]
            for i in range(b.num_rows):
                page, link, payload, kind, refers, shard = (c[i].as_py() for c in columns)
                if (page,) != last:
                    last, repeat, known = (page,), 0, {}
                if not kind:
                    known[payload] = refers
                    continue
                refers = known.get(hashlib.sha256(payload).digest()) if known else None
                data = members(page_record(page, repeat, link, payload, refers is not None, refers, date))
                repeat += 1
                if name is None or size + len(data) > file_bytes:
                    name, size, files_ = f"pages-{shard:06d}-{files_:04d}", 0, files_ + 1
                    info = _record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
                                   [("WARC-Filename", name + ".warc.gz")], "application/warc-fields", b"format: WARC File Format 1.1\r\n", date)
                    out.append((name, seq, members(info)[:-1]))
                    size += len(out[-1][2]) + 1
                    seq += 1
                out.append((name, seq, data[:-1]))
                size, seq, held = size + len(data), seq + 1, held + len(data)
                if held > 4 << 20:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    temporary = f"{path}/_temporary-{uuid.uuid4().hex}"
    (dealt.mapInArrow(write, "file string, seq long, value binary").sortWithinPartitions("file", "seq")
     .select("file", F.col("value").cast("string")).write.partitionBy("file").option("lineSep", "\0").text(temporary))
    done = []
    for folder in fs.listStatus(files.Path(temporary)):
        name = folder.getPath().getName()
        if name.startswith("file="):
            [part] = [f for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            final = files.Path(f"{path}/{name[5:]}.warc.gz")
            fs.delete(final, False)  # of a try that ended before its manifest
            if not fs.rename(part.getPath(), final):
                raise OSError(f"could not rename {final}")
            done.append(f"{name[5:]}.warc.gz\t{part.getLen()}\n")
    stream = fs.create(files.Path(f"{temporary}/{MANIFEST}"))
    stream.write("".join(sorted(done)).encode())
    stream.close()
    if not fs.rename(files.Path(f"{temporary}/{MANIFEST}"), files.Path(f"{path}/{MANIFEST}")):
        raise OSError(f"could not rename {path}/{MANIFEST}")
    fs.delete(files.Path(temporary), True)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to and file of every page record, with
    ``payload`` the bytes too (null for revisits). Digests of blocks and payloads are recomputed; a difference, a
    damaged file or a size that the manifest does not name stops the job."""
    listed = {r.value.split("\t")[0]: int(r.value.split("\t")[1]) for r in spark.read.text(f"{path}/{MANIFEST}").collect()}
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "file string" + (", payload binary" if payload else ""))
    if not listed:
        return spark.createDataFrame([], schema)
    names = spark.sparkContext.broadcast(listed)  # a line for each file

    def parse(batches):
        for b in batches:
            for place, length, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                name = place.rsplit("/", 1)[1]
                if names.value[name] != length:
                    raise ValueError(f"{name}: {length} bytes, the manifest says {names.value[name]}")
                rows, held = [], 0
                for head, block in records(content.as_py()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    if _sha1(block) != head["WARC-Block-Digest"]:
                        raise ValueError(f"{name}: block digest of {head['WARC-Record-ID']}")
                    http, body = block.split(b"\r\n\r\n", 1)
                    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
                    response = head["WARC-Type"] == "response"
                    digest = head["WARC-Payload-Digest"]
                    if response and (len(body) != size or _sha1(body) != digest):
                        raise ValueError(f"{name}: payload digest of {head['WARC-Record-ID']}")
                    refers = head.get("X-Refers-To-Page-Id")
                    page = head.get("X-Page-Id")
                    rows.append((int(page) if page else None, head.get("WARC-Target-URI"), size,
                                 base64.b32decode(digest[5:]).hex(), head["WARC-Type"], int(refers) if refers else None, name,
                                 *([body if response else None] if payload else [])))
                    held += len(body) if payload else 0
                    if len(rows) == 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
                        *([("payload", pa.binary())] if payload else [])])
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    there = {r.path.rsplit("/", 1)[1] for r in found.select("path").collect()}
    if there != set(listed):
        if not there.issuperset(listed):
            raise ValueError(f"missing archives: {sorted(set(listed) - there)[:5]}")
        found = spark.read.format("binaryFile").load([f"{path}/{n}" for n in sorted(listed)])
    return found.select("path", "length", "content").mapInArrow(parse, schema)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages to a new folder (by default in the shared folder) and read the archives back."""
    path = path or scratch_path(pages.sparkSession, "archives")
    return read_archives(pages.sparkSession, write_archives(pages, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The contract in DuckDB SQL.
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT page_id, payload, octet_length(payload)::BIGINT AS n,
      CASE WHEN octet_length(payload) >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload) END AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM g
"""
