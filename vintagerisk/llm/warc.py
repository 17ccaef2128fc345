"""WARC archives: whole-file gzip streams, their normalisation to a member per record, and reading by offset.

`write_monolithic` writes a crawl as it comes, one gzip stream per file. `normalise` inflates each such stream once, record
by record, writes every record as a gzip member of its own, turns repeated payloads into revisit records on the way, and
puts a sidecar index beside the file: a line per record with page number, offset and length. `read_archives` opens files
through their index, inflates the one member at each offset, and takes everything from the record itself.

Page texts do not travel: a page's text is read once, into the first file; what is shuffled is a line of numbers and the
digest per page. Files are written under an attempt's own name and moved into place, so a repeated task leaves one
whole file. Memory is one record, and one line per record of a file.

Null html: empty payload. Null url: `urn:page:` and the number. Null page_id: a record without number; it loses against
any number when a group's response is chosen, so refers_to is null only in a group without any number. Rows that repeat
a page_id are a record each; of equal largest numbers one is the response. No rows: no files. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.llm.files import opened, replacing
from vintagerisk.llm.frames import land, pick

LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "file string, record long, page_id long, payload_bytes long, digest string"
SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return "".join(c if "!" <= c and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def response(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Type", "response"), ("WARC-Target-URI", uri(url, page_id)), ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if page_id is not None:
        headers.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    return block(headers, http(len(payload)) + payload)


def revisit(headers: dict[str, str], body: bytes, refers_to: int | None) -> bytes:
    """The response as a revisit: its headers and its HTTP head stay, the payload goes."""
    kept = [(k, v) for k, v in headers.items() if k not in ("WARC-Type", "Content-Length")]
    own = [("WARC-Type", "revisit"), *kept, ("WARC-Profile", PROFILE)]
    if refers_to is not None:
        own.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    return block(own, body[: body.index(b"\r\n\r\n") + 4])


def parsed(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def number(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def inflated(source: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file in parts, however many members it has."""
    work = zlib.decompressobj(31)
    for part in source:
        while part:
            yield work.decompress(part)
            part = work.unused_data
            if part:
                work = zlib.decompressobj(31)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records of an uncompressed stream."""
    held, parts, size = bytearray(), iter(stream), 0
    while True:
        end = held.find(b"\r\n\r\n", max(0, size))
        if end < 0:
            size = len(held) - 3
            more = next(parts, None)
            if more is None:
                if held.strip():
                    raise ValueError("the stream ends inside a record")
                return
            held += more
            continue
        headers = parsed(bytes(held[:end]))
        whole = end + 4 + int(headers["Content-Length"]) + 4
        while len(held) < whole:
            held += next(parts)  # a missing rest of a record is an error
        yield headers, bytes(held[end + 4 : whole - 4])
        del held[:whole]
        size = 0


def parts_of(path: str, step: int = 1 << 20) -> Iterator[bytes]:
    with opened(path) as f:
        while part := f.read(step):
            yield part


def write_monolithic(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = 6) -> DataFrame:
    """Write response records, one gzip stream per task; returns a line per record (file, record, page_id, payload_bytes, digest)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        name, lines = f"crawl-{TaskContext.get().partitionId():08d}.warc.gz", 0
        with replacing(f"{folder}/{name}") as out:
            pack = zlib.compressobj(level, wbits=31)
            while batch is not None:
                told = []
                for number_, url_, html_ in zip(*(batch.column(k) for k in range(3)), strict=True):
                    payload = (html_.as_py() or "").encode()
                    out.write(pack.compress(response(number_.as_py(), url_.as_py(), payload)))
                    told.append((name, lines, number_.as_py(), len(payload), hashlib.sha1(payload).hexdigest()))
                    lines += 1
                if told:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(told, columns=["file", "record", "page_id", "payload_bytes", "digest"]).astype({"page_id": "Int64"}), preserve_index=False)
                batch = next(batches, None)
            out.write(pack.flush())

    rows = pick(pages, page_id=page_id, url=url, html=html).withColumn("page_id", F.col("page_id").cast("long"))
    rows.mapInArrow(write, WRITTEN).write.mode("overwrite").parquet(f"{folder}/lines")
    return pages.sparkSession.read.schema(WRITTEN).parquet(f"{folder}/lines")


def revisits(lines: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Per line: file, record, revisit (boolean), refers_to."""
    place = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("order"), "file", "record", "page_id")
    keyed = lines.withColumn("place", place)
    groups = keyed.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes")
    heads = land(groups.agg(F.max("place").alias("head"), F.count(F.lit(1)).alias("of")).where("of > 1"), "heads")
    chosen = keyed.join(heads, ["digest", "payload_bytes"], "left")
    again = F.col("head").isNotNull() & ((F.col("head.file") != F.col("file")) | (F.col("head.record") != F.col("record")))
    return chosen.select("file", "record", again.alias("revisit"), F.when(again, F.col("head.page_id")).alias("refers_to"))


def normalise(spark: SparkSession, source: str, decisions: DataFrame, target: str, level: int = 6) -> DataFrame:
    """Rewrite each file of `source` with a member per record and an index beside it; returns file, records, bytes.

    decisions: file, record, revisit, refers_to. The numbers of one file's records come together, its texts do not.
    """

    def rewrite(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["file"].iloc[0]
        marked = rows[rows["revisit"]]
        again = {int(r): None if pd.isna(t) else int(t) for r, t in zip(marked["record"], marked["refers_to"], strict=True)}
        at, count = 0, 0
        with replacing(f"{target}/{name}") as out, replacing(f"{target}/{name}.idx") as index:
            for count, (headers, body) in enumerate(records(inflated(parts_of(f"{source}/{name}"))), 1):
                whole = revisit(headers, body, again[count - 1]) if count - 1 in again else block([(k, v) for k, v in headers.items() if k != "Content-Length"], body)
                pack = zlib.compressobj(level, wbits=31)
                member = pack.compress(whole) + pack.flush()
                out.write(member)
                index.write((json.dumps([number(headers.get("WARC-Record-ID")), at, len(member)]) + "\n").encode())
                at += len(member)
        return pd.DataFrame({"file": [name], "records": [count], "bytes": [at]})

    # refers_to travels as text: pandas would turn a column with nulls into floats, which do not hold every number
    plain = land(decisions.withColumn("refers_to", F.col("refers_to").cast("string")), "decisions")
    # a stated number of partitions: the lines are few, and Spark would otherwise put all files into one task
    plain.repartition(max(1, plain.select("file").distinct().count()), "file").groupBy("file").applyInPandas(rewrite, "file string, records long, bytes long").write.mode("overwrite").parquet(f"{target}/files")
    return spark.read.schema("file string, records long, bytes long").parquet(f"{target}/files")


def read_archives(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every record through the index: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with opened(f"{folder}/{name}.idx") as f:
                entries = [json.loads(line) for line in f.read().splitlines()]
            with opened(f"{folder}/{name}") as f:
                for k in range(0, len(entries), 500):
                    own = entries[k : k + 500]
                    yield pa.RecordBatch.from_pylist([one(f, at, size) for _, at, size in own], SCHEMA)

    def one(f: pa.NativeFile, at: int, size: int) -> dict:
        f.seek(at)
        (headers, body), = records(inflated(iter([f.read(size)])))
        head, payload = body.split(b"\r\n\r\n", 1)
        told = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        stated = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        if headers["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != told or len(payload) != stated):
            raise ValueError(f"the payload at {at} differs from its digest")
        return {"page_id": number(headers.get("WARC-Record-ID")), "payload_bytes": stated, "payload_digest": told, "record_type": headers["WARC-Type"], "refers_to": number(headers.get("WARC-Refers-To")), "url": headers["WARC-Target-URI"]}

    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(read, READ)
