"""WARC archives with a Zstandard dictionary and record-wise compression.

A dictionary is trained on a bounded sample of the records (``SAMPLE_ROWS``
rows of smallest id hash, ``SAMPLE_BYTES`` bytes). Every archive starts with a
skippable frame (magic 0x184D2A5D) that holds it; each record follows as a
frame of its own, so one record can be read without the others. Of records
with equal payloads of at least ``min_bytes`` bytes the one with the largest
page id is a response; the others are revisits that name it and carry the
HTTP header, with the full length, but no payload.

Archives are closed at ``ARCHIVE_BYTES``, written under the shared folder
through Arrow file systems under a temporary name and moved at the end. Their
names hold a digest of their contents, and the returned table names the archives
of one attempt of every task; those of a lost attempt are never read.

Null html is an empty payload. Rows that share the largest id of their group
(repeated rows) are all responses; a null id is never the largest unless all
are null, and then all rows of the group are responses. Null urls have no
target header; line ends in urls are escaped. An empty table gives no archive.
Other columns are ignored. A record must fit its task some times over, however
long its payload is; an archive with one long record is as long as that.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import common
from shelfwise.llm.token_files import get, put

ARCHIVE_BYTES = 16 << 20
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
MIN_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of the samples; empty where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, n: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}{n}')}>"


def record(page_id, url, payload: bytes, kind: str, refers_to=None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != found):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": found, "record_type": kind,
            "refers_to": number("X-Refers-To-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload}


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def records_of(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """Records of an archive, each decompressed alone."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary frame")
    words = zstandard.ZstdCompressionDict(data[8:8 + size]) if size else None
    reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(data):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a record")
            parts.append(one.decompress(data[at:at + step]))
            at += step
        at = min(at, len(data)) - len(one.unused_data)
        yield b"".join(parts)


def _writer(folder: str, dictionary: bytes, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zip_ = zstandard.ZstdCompressor(level=3, dict_data=words) if words else zstandard.ZstdCompressor(level=3)
        task, number, parts, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def close():
            # Rows come in the order of a shuffle, so a second attempt may deal them otherwise:
            # the name says what the archive holds, and the table names those of one attempt.
            data = archive_head(dictionary) + b"".join(parts)
            name = f"pages-{task:08d}-{number:06d}-{hashlib.blake2b(data, digest_size=8).hexdigest()}.warc.zst"
            put(folder, name, data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n_records"])

        for batch in batches:
            for part in common.slices(batch, "html"):
                for r in part.to_pylist():
                    parts.append(zip_.compress(record(
                        r["page_id"], r["url"], (r["html"] or "").encode(), r["record_type"], r["refers_to"])))
                    size, n = size + len(parts[-1]), n + 1
                    if size >= limit:
                        yield close()
                        number, parts, size, n = number + 1, [], 0, 0
        if n:
            yield close()

    return run


def plan(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, record_type, refers_to of every row."""
    d = pages.select("page_id", "url", "html").withColumn("sha", F.sha1(F.coalesce("html", F.lit(""))))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    groups = common.cut(d.where(large).groupBy("sha").agg(
        F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last"), "warc-groups")
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return d.join(common.broadcast_if_small(groups, 64), "sha", "left").select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"))


def sample(pages: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[bytes]:
    """Payloads the dictionary is trained on; their number and bytes are bounded.
    Rows are picked by hashes and lengths; html is read for those picked only."""
    key = F.xxhash64("html").alias("k")
    small = pages.where(F.octet_length("html").between(1, most // 16)).select("page_id", "html")
    picked, size = [], 0
    for r in small.select(F.xxhash64("page_id").alias("h"), "page_id", key, F.octet_length("html").alias("b")).orderBy(
            "h", "page_id", "k").limit(rows).collect():
        if size >= most:
            break
        size += r["b"]
        picked.append((r["page_id"], r["k"]))
    chosen = pages.sparkSession.createDataFrame(list(set(picked)), "page_id bigint, k bigint").withColumnRenamed("page_id", "id")
    found = small.select("page_id", "html", key).join(
        F.broadcast(chosen), ["k"]).where(F.col("page_id").eqNullSafe(F.col("id"))).dropDuplicates(["page_id", "k"]).collect()
    html = {(r["page_id"], r["k"]): r["html"] for r in found}
    return [record(p, None, html[p, k].encode(), "response") for p, k in picked]


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns their table: name, n_records."""
    dictionary = train(sample(pages))
    return common.cut(plan(pages, min_bytes).mapInArrow(
        _writer(folder, dictionary, limit), "name string, n_records bigint"), "warc-files")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                for data in records_of(get(folder, row["name"])):
                    r = parse(data)
                    found.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
                if len(found) != row["n_records"]:
                    raise RuntimeError(f"{row['name']} holds {len(found)} records, its table says {row['n_records']}")
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_back(files: DataFrame, folder: str) -> DataFrame:
    return common.one_by_one(files, "name").mapInArrow(
        _reader(folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_folder(spark, "warc")
    return read_back(write(common.read(spark, sf_dir, "pages"), folder), folder)
