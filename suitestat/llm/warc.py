"""Operator 10: a deterministic, sharded WARC writer, and a reader.

Records are range-sorted by page_id.  The bounds of the ranges come from sums of bytes
over the rows, so reruns cut alike; a page_id with more than a range's share, and rows
without one, are cut further by payload digest.  Each task writes its range to archives that
roll at a compressed size; every record is a gzip member of its own, with headers
and digests made anew from the payload.  A file is written under a temporary name
and renamed when it is whole; names come from the range and a running number,
so a task that runs again writes the same bytes to the same names.  A manifest,
written last and also by rename, lists the files that tasks reported: readers take
only those, so leavings of lost tasks are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitestat.llm.common import materialize, shared_dir

#: Fixed values of the format (ISO 28500).
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records have no capture time in the pages table; one fixed time keeps archives deterministic.
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "manifest.json"
BINS = 4096  # ranges of ids that are summed at once
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, offset long"


def filesystem(uri: str):
    """The store of a path, as tasks reach it: local and shared folders, and what pyarrow knows (hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else ("file://" + uri.removeprefix("file:")))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def one_line(value: str | None) -> str:
    """A header value can't hold line ends."""
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One record, its block an HTTP response.  A revisit keeps the digest and the size of the full payload, not the payload."""
    revisit = refers_to is not None
    body = HTTP if revisit else HTTP + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("WARC-Block-Digest", "sha1:" + digest32(body)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(body))),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if url is None:
        headers.append(("X-No-Target", "1"))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url)), ("WARC-Refers-To-Target-URI", one_line(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; its digests and lengths are checked against its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first[:40]!r}")
    h = dict(line.decode().split(": ", 1) for line in lines)
    body = rest[: int(h["Content-Length"])]
    if len(body) != int(h["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if h["WARC-Block-Digest"] != "sha1:" + digest32(body):
        raise ValueError("a record's block digest is wrong")
    revisit = h["WARC-Type"] == "revisit"
    payload = body.partition(b"\r\n\r\n")[2]
    if not revisit and h["WARC-Payload-Digest"] != "sha1:" + digest32(payload):
        raise ValueError("a response's payload digest is wrong")
    return {
        "page_id": int(h["X-Page-Id"]) if "X-Page-Id" in h else None,
        "url": None if "X-No-Target" in h else h["WARC-Target-URI"],
        "record_type": h["WARC-Type"],
        "refers_to": int(h["X-Refers-To-Page-Id"]) if revisit else None,
        "payload_bytes": int(h["X-Payload-Length"]),
        "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": None if revisit else payload,
    }


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds sha, size, and for records that are not the smallest page_id of their payload, refers_to: that page_id, and refers_url: its url.

    Counting by digest combines before it shuffles; only digests with two or more
    records are joined back, through a written table, so that a payload that a third
    of all pages share is a join whose large side Spark may split.  Rows that repeat
    the smallest page_id are all responses.  A null page_id is larger than any number.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.withColumn("sha", F.sha1(payload)).withColumn("size", F.octet_length(payload))
    first = keyed.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).select("sha", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    first = materialize(first, "warc-first")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(first, "sha", "left").select("page_id", "url", "html", "sha", "size", F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"))


def ranges(rows: DataFrame, n: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """About n ranges of like bytes, the same on every run: (least page_id, number, shards) of each, and number and shards of the rows without a page_id.

    rows: page_id, size.  Bytes are summed by the high bits of page_id, and by more
    bits within bins of more than a range's share, so the driver gets BINS sums at
    first and 64 for each such bin, of which there are at most n, in each later step.
    """
    weight = F.col("size").cast("long") + 400
    lo, hi, total, bare = rows.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), weight)), F.lit(0))).first()
    share = max(1, total / n)
    leaves: list[tuple[int, int, bool]] = []
    bits, open_ = 0, rows.filter("page_id is not null")
    while lo is not None and (hi >> bits) - (lo >> bits) >= BINS:
        bits += 1
    while lo is not None:
        found = open_.groupBy(F.shiftright("page_id", bits).alias("bin")).agg(F.sum(weight).alias("w")).collect()
        heavy = [r["bin"] for r in found if r["w"] > share and bits]
        deep = set(heavy)
        leaves += [(r["bin"] << bits, r["w"], not bits) for r in found if r["bin"] not in deep]
        if not heavy:
            break
        open_ = open_.filter(F.shiftright("page_id", bits).isin(heavy))
        bits -= min(bits, 6)
    out: list[tuple[int, int, int]] = []
    number, held = 0, share
    for least, w, one in sorted(leaves):
        shards = -int(-w // share) if one else 1
        if shards > 1 or held + w > share:
            out.append((least, number, shards))
            number, held = number + shards, share if shards > 1 else 0
        held += w
    return out, number, max(1, -int(-bare // share))


def numbered(rows: DataFrame, found: tuple[list[tuple[int, int, int]], int, int]) -> tuple[DataFrame, int]:
    """rows with the number of their range, and how many there are."""
    cuts, bare, bare_shards = found
    least, first, shards = (np.array([c[i] for c in cuts], np.int64) for i in range(3))

    @F.pandas_udf("int")
    def number(has: pd.Series, page_id: pd.Series, part: pd.Series) -> pd.Series:
        if not len(least):
            return (bare + (part * bare_shards >> 30)).astype("int32")
        i = np.maximum(np.searchsorted(least, page_id.to_numpy(), "right") - 1, 0)
        of = np.where(has, first[i] + (part.to_numpy() * shards[i] >> 30), bare + (part.to_numpy() * bare_shards >> 30))
        return pd.Series(of.astype("int32"))

    # 30 bits of the digest deal out what one page_id has.
    part = F.shiftright(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), 2)
    return rows.withColumn("range", number(F.col("page_id").isNotNull(), F.coalesce(F.col("page_id").cast("long"), F.lit(0)), part)), bare + bare_shards


def write(pages: DataFrame, target: str, roll_bytes: int = 256 << 20, min_bytes: int = 0, level: int = 6, partitions: int | None = None) -> str:
    """Write pages (page_id, url, html; other columns are ignored) as archives below target; returns the manifest's path.

    Null html is an empty payload, a null url an empty target, a null page_id no id.
    Rows that repeat are records that repeat.  An empty table gives a manifest
    without files.  A payload of any length is one record: a file exceeds roll_bytes
    by one record at most.  Two runs with as many partitions (by default those of a
    shuffle) write the same files, whatever order the rows come in.
    """
    spark = pages.sparkSession
    rows = mark_revisits(pages.select("page_id", "url", "html"), min_bytes)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = pages.select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    rows, n = numbered(rows, ranges(sizes, n))
    rows = rows.repartitionById(n, "range").sortWithinPartitions("range", F.asc_nulls_last("page_id"), "sha", "url").select("range", "page_id", "url", "html", "refers_to", "refers_url")

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = filesystem(target)
        fs.create_dir(root, recursive=True)
        done: list[tuple] = []
        out, at = None, (None, 0)

        def close() -> None:
            nonlocal out
            out["stream"].close()
            fs.move(out["temp"], f"{root}/{out['name']}")
            done.append((out["name"], out["records"], out["bytes"], out["sha"].hexdigest()))
            out = None

        for batch in batches:
            for part, page_id, url, html, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and part != at[0]:
                    close()
                if out is None:
                    at = (part, at[1] + 1 if part == at[0] else 0)
                    name = f"part-{part:06d}-{at[1]:05d}.warc.gz"
                    temp = f"{root}/.{name}.{ctx.taskAttemptId()}.tmp"
                    out = {"name": name, "temp": temp, "stream": fs.open_output_stream(temp, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                raw = member(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, refers_url), level)
                out["stream"].write(raw)
                out["sha"].update(raw)
                out["bytes"] += len(raw)
                out["records"] += 1
                if out["bytes"] >= roll_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes", "sha256"), x, strict=True)) for x in done])

    # A row for each file, not for each record: what comes to the driver is a list of file names.
    files = sorted(rows.mapInArrow(put, "file string, records long, bytes long, sha256 string").collect())
    fs, root = filesystem(target)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/.{MANIFEST}.tmp", compression=None) as f:
        f.write(json.dumps({"format": VERSION.decode(), "files": [r.asDict() for r in files]}, indent=1).encode())
    fs.move(f"{root}/.{MANIFEST}.tmp", f"{root}/{MANIFEST}")
    return f"{target.rstrip('/')}/{MANIFEST}"


def member(raw: bytes, level: int) -> bytes:
    """A gzip member without a time, so equal records are equal bytes."""
    buf = io.BytesIO()
    with gzip.GzipFile(fileobj=buf, mode="wb", compresslevel=level, mtime=0) as z:
        z.write(raw)
    return buf.getvalue()


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, one in memory at a time."""
    offset, rest = 0, b""
    while True:
        z, parts, start = zlib.decompressobj(31), [], offset
        while not z.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    if parts or offset != start:
                        raise ValueError("an archive ends within a record")
                    return
            parts.append(z.decompress(rest))
            offset += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield start, b"".join(parts)


def read(spark: SparkSession, target: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists: one task a file or less, one record in memory at a time."""
    fs, root = filesystem(target)
    with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
        files = [x["file"] for x in json.loads(f.read())["files"]]
    columns = [x.split(" ")[0] for x in READ.split(", ")]

    def get(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, root = filesystem(target)
        schema = pa.schema([(c, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for c, t in (x.split(" ") for x in READ.split(", "))])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, raw in members(stream):
                        row = parse(raw) | {"file": name, "offset": offset}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, len(files))).mapInArrow(get, READ).select(*columns)


def round_trip(pages: DataFrame, target: str | None = None, **options) -> DataFrame:
    """Write the archives and read them back; without a target, into the shared folder."""
    spark = pages.sparkSession
    target = target or f"{shared_dir(spark)}/suitestat-warc-{uuid.uuid4().hex}"
    write(pages, target, **options)
    return read(spark, target, with_payload=False)
