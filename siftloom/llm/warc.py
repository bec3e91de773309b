"""Dictionary-compressed WARC archives: writer and reader.

A Zstandard dictionary is trained on a bounded sample of the records to be archived and stands, as the
web-archive convention for Zstandard has it, in a skippable frame at the head of every archive; each record is a frame of its own, so that a
reader can start at any of them. Payloads that were seen before become revisit records. Archives are written with
Spark's own file writer, so that they reach whatever store the cluster shares, and read back with its binary reader.

The writer ends every row with a line feed; so that this byte doesn't break the stream of frames, each row closes with the
head of a skippable frame of one byte, which that line feed fills.

Defined results: null html is an empty payload; null urls are archived as `about:blank`; of rows with equal payloads, those with the smallest
page_id are responses (all of them, if that page_id repeats) and the others revisits, each row of a repeated page_id by its own payload; null page_ids count as larger than any other and are archived
with no id; an empty table gives no archive and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm.common import batch_of, cut, parts, scratch

#: Frame formats that must be as the Zstandard format and the archive convention state them.
DICTIONARY_FRAME = 0x184D2A5D
LINE_FEED_FRAME = struct.pack("<II", 0x184D2A50, 1)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit of `refers_to` without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    target = re.sub(r"[\r\n]+", " ", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, records: int = 1500, size: int = 65_536, sample_bytes: int = 4 << 20) -> bytes:
    """A dictionary from the `records` pages with the smallest hash of the id, `sample_bytes` of them at most; empty if there is too little to train on."""
    chosen = pages.select("page_id").orderBy(F.xxhash64("page_id", F.lit(5)), "page_id").limit(records).distinct()
    cut_html = F.substring(F.coalesce("html", F.lit("")), 1, sample_bytes // records * 4)
    rows = pages.select("page_id", "url", cut_html.alias("html")).join(F.broadcast(chosen), "page_id").limit(records).collect()
    rows.sort(key=lambda r: (r["page_id"], r["url"] or "", r["html"]))
    samples, total = [], 0
    for r in rows:
        sample = record(r["page_id"], r["url"], r["html"].encode(), None)
        if total + len(sample) > sample_bytes:
            break
        samples.append(sample)
        total += len(sample)
    if len(samples) < 16:
        return b""
    try:
        return zstd.train_dictionary(min(size, total // 4), samples).as_bytes()
    except zstd.ZstdError:
        return b""


#: A payload with more than one in so many of all pages is hot; so there are fewer hot payloads than this.
HOT_SHARE = 2000


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, key, refers_to) of rows whose payload (known by its key) belongs to a smaller page_id; narrow rows only, pre-aggregated by payload.

    Rows of the few hot payloads are recognised where they are read and dealt by page, so that no payload that very many pages share meets in one task.
    """
    rows = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("key")).where(F.col("page_id").isNotNull())
    counted = cut(rows.groupBy("key").agg(F.min("page_id").alias("least"), F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > total
    hot = counted.where((F.col("n") > 1) & is_hot).select("key", F.col("least").alias("hot_least"))
    rest = counted.where((F.col("n") > 1) & ~is_hot).select(F.col("key").alias("rest_key"), "least")
    met = rows.join(F.broadcast(hot), "key", "left").withColumn("deal", F.when(F.col("hot_least").isNull(), F.col("key")).otherwise(F.col("page_id").cast("string")))
    met = met.join(rest, F.col("deal") == F.col("rest_key"), "left").withColumn("refers_to", F.coalesce("hot_least", "least"))
    return met.where(F.col("page_id") > F.col("refers_to")).select("page_id", "key", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, archives: int, dictionary: bytes, level: int = 3) -> None:
    """Write every page's record to one of about `archives` files below `path`."""
    compressed = zstd.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    lead = struct.pack("<II", DICTIONARY_FRAME, len(compressed)) + compressed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.binary())])
        data = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstd.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)
        begun, marked, marks = False, None, {}
        for batch in batches:
            out, held = [], 0
            for page, url, html, ref, key in zip(*(batch.column(i) for i in range(5)), strict=True):
                if ref.is_valid:
                    if marked != page.as_py():
                        marked, marks = page.as_py(), {}
                    marks[key.as_py()] = ref.as_py()
                    continue
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                # only the payloads that smaller pages have are revisits, where a page comes with several
                refers_to = marks.get(hashlib.sha256(payload).hexdigest()) if marks and page.as_py() == marked else None
                frame = press.compress(record(page.as_py(), url.as_py(), payload, refers_to)) + LINE_FEED_FRAME
                out.append(frame if begun else lead + frame)
                begun, held = True, held + len(frame)
                if held > 1 << 22:
                    yield batch_of(schema, [out])
                    out, held = [], 0
            if out:
                yield batch_of(schema, [out])

    # revisit marks travel with the pages and sort before them, so payloads are shuffled once and joined with nothing
    types = {"page_id": "long", "url": "string", "html": "string", "refers_to": "long", "key": "string"}
    shaped = lambda df: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    rows, marks = shaped(pages.select("page_id", "url", "html")), shaped(revisits(pages))
    both = rows.unionByName(marks).withColumn("deal", F.coalesce("page_id", F.xxhash64("url", "html")))
    dealt = both.repartition(archives, "deal").sortWithinPartitions("page_id", F.col("refers_to").asc_nulls_last())
    frames = dealt.select(*types).mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (header fields, block) of an uncompressed archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        fields = {"version": line.strip().decode()}
        for raw in iter(stream.readline, b"\r\n"):
            name, _, value = raw.decode().partition(":")
            fields[name.lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def open_archive(content: bytes) -> io.BufferedReader:
    """The uncompressed stream of an archive with its dictionary in the leading frame."""
    magic, size = struct.unpack_from("<II", content)
    data = None
    if magic == DICTIONARY_FRAME:
        raw = content[8 : 8 + size]
        data = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(raw)) if raw else None
        content = memoryview(content)[8 + size :]
    return io.BufferedReader(zstd.ZstdDecompressor(dict_data=data).stream_reader(content, read_across_frames=True), 1 << 20)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: (page_id, url, payload_bytes, payload_digest, record_type, refers_to). Payloads of response records are digested anew."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for fields, block in parse(open_archive(content.as_buffer())):
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    told = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response":
                        size, name = len(body), digest(body)
                        if name != told:
                            raise ValueError(f"record {fields['warc-record-id']}: payload doesn't match its digest")
                    else:
                        size, name = int(fields["x-payload-length"]), told
                    page, ref = fields.get("x-page-id"), fields.get("x-refers-to-page")
                    out.append((int(page) if page else None, fields["warc-target-uri"], size, name, fields["warc-type"], int(ref) if ref else None))
                if out:
                    yield batch_of(schema, [list(c) for c in zip(*out, strict=True)])

    files = spark.read.format("binaryFile").load(f"{path}/part-*").select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, path: str, archives: int | None = None) -> DataFrame:
    """Write `pages` below `path` and return what the archives hold."""
    spark = pages.sparkSession
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    if archives is None:
        bytes_in = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 600)).first()[0]
        archives = max(1, min(int(bytes_in // (24 << 20)) + 1, 100_000))
        archives = max(archives, min(parts(spark), 12))
    write_archives(pages, path, archives, train_dictionary(pages))
    return read_archives(spark, path)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages and read the archives back."""
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
