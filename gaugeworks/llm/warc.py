"""WARC archives, index first.

Records are gzip members of .warc.gz files, so each can be read alone. A task writes its archive under a name that no
other attempt uses and returns index rows (archive, offset, length, url, digest, ...); only index rows of tasks that
succeeded are kept, so what a lost or repeated task left behind is never read. Readers select index rows, sort them by
place, and fetch neighbours in one byte range of up to READ_BYTES.

Of records with equal payloads of at least `least_revisit` bytes, the one with the largest page_id is a response and the
others are revisits of it, without the payload; smaller payloads are always responses.

Defined cases: a null html is an empty payload; a null url is written as an empty target; null page_ids are written as
such and never chosen over others as response; repeated rows with the largest page_id are all responses; extra columns
are left out; an empty table gives no archive and an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import files_freed

READ_BYTES, GAP = 8 << 20, 64 << 10
#: An archive is closed at this size and the next begun.
ARCHIVE_BYTES = 256 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The date of all records: archives of the same rows are equal.
DATE = b"2026-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, url string, digest string, page_id {kind}, record_type string"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: header, HTTP header, and for responses the payload."""
    block = HTTP if revisit else HTTP + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % ("" if page_id is None else str(page_id)).encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + (url or "").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode(), b"X-Payload-Length: %d" % len(payload)]
    lines += [b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its header")
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, path: str, least_revisit: int = 1000, level: int = 6) -> DataFrame:
    """Writes archives below path/archives and their index to path/index; returns the index."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    kind = p.schema["page_id"].dataType.simpleString()
    light = pages.select("page_id", F.sha1(payload).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_revisit)
    shared = light.groupBy("d").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("d", "chosen")
    # shares of equal payloads are split by AQE where one is very large
    p = p.join(shared, p["digest"] == shared["d"], "left").drop("d")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(f"{path}/archives")
        out, name, offset = None, "", 0
        for b in batches:
            rows = []
            for page_id, url, body, digest, chosen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    fs.create_dir(folder, recursive=True)
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                revisit = chosen is not None and page_id != chosen
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, body, digest, chosen, revisit)) + z.flush()
                out.write(member)
                rows.append((name, offset, len(member), url, digest, page_id, "revisit" if revisit else "response"))
                offset += len(member)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4]), b.column(0), pa.array(cols[6])], names=["archive", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    schema = INDEX.format(kind=kind)
    with files_freed(spark):
        p.mapInArrow(write, schema).write.option("compression", "zstd").parquet(f"{path}/index")
    return read_index(spark, path, kind)


def read_index(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(INDEX.format(kind=kind)).parquet(f"{path}/index")


def ranges(offset: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Cuts sorted places into runs (first, last + 1) that one read of up to READ_BYTES covers, over gaps of up to GAP."""
    out, a = [], 0
    for i in range(1, len(offset) + 1):
        if i == len(offset) or offset[i] - (offset[i - 1] + length[i - 1]) > GAP or offset[i] + length[i] - offset[a] > READ_BYTES:
            out.append((a, i))
            a = i
    return out


def read_records(selected: DataFrame, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of the selected index rows.

    A revisit has its payload's length and digest from its own header, and no payload. A response's payload is checked
    against the digest in its header and in the index.
    """
    kind = selected.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(f"{path}/archives")
        for b in batches:
            if not b.num_rows:
                continue
            archive = np.array(b.column(0).to_pylist(), object)
            offset, length, digest = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
            begins = np.flatnonzero(np.concatenate([[True], archive[1:] != archive[:-1]]))
            for x, y in zip(begins, [*begins[1:], len(archive)], strict=True):
                with fs.open_input_file(f"{folder}/{archive[x]}") as f:
                    for i, j in ranges(offset[x:y], length[x:y]):
                        i, j = x + i, x + j
                        base = int(offset[i])
                        raw = f.read_at(int(offset[j - 1] + length[j - 1]) - base, base)
                        rows = []
                        for k in range(i, j):
                            fields, body = parse(zlib.decompress(raw[int(offset[k]) - base : int(offset[k] + length[k]) - base], 31))
                            said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            revisit = fields["WARC-Type"] == "revisit"
                            if said != digest[k] or not revisit and hashlib.sha1(body).hexdigest() != said:
                                raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
                            name = lambda f: fields.get(f, "").removeprefix("<urn:page:").removesuffix(">") or None  # noqa: B023, E731
                            rows.append((name("WARC-Record-ID"), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]) if revisit else len(body), said, fields["WARC-Type"], name("WARC-Refers-To"), None if revisit else body))
                        cols = list(zip(*rows, strict=True))
                        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4]), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.binary())], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    place = selected.select("archive", "offset", "length", "digest")
    near = place.repartition("archive", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("archive", "offset")
    got = near.mapInArrow(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return got.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
