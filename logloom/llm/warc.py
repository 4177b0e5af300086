"""WARC archives compressed with Zstandard: writer and reader.

An archive begins with a skippable frame that holds the dictionary; then comes one frame
per record, compressed with it.  The reader finds the frames from their headers, decodes
one record at a time and checks magic, version, header lines, content length, digests
and the end of the record.

Defined cases: a null payload is empty; a null page_id is written as ``null`` and read back as null, and
refers to nothing; of equal payloads the smallest page_id is the response (all rows with
that same page_id are), null ids count as largest; an empty table gives no archive and an empty result; other columns
are not written.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 32 << 10
DICT_RECORDS = 256
DICT_SAMPLE_BYTES = 4 << 20
LEVEL = 3
DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class ArchiveError(ValueError):
    """An archive that does not follow the format."""


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(value: str) -> int | None:
    inner = value.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "null" else int(inner)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of its payload but not the payload."""
    revisit = refers_to is not None
    block = HTTP_OK.format(len(payload)).encode() + (b"" if revisit else payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple:
    """The row of `RECORD`; raises `ArchiveError` where header, length or digest is wrong."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ArchiveError("a record without a WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"not a header line: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    try:
        length = int(fields["content-length"])
        kind, record_id = fields["warc-type"], fields["warc-record-id"]
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
    except (KeyError, ValueError) as why:
        raise ArchiveError(f"a header is missing or wrong: {why}") from why
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{record_id}: content length {length}, {len(rest) - 4} bytes found")
    if hashlib.sha256(block).hexdigest() != fields.get("warc-block-digest", "").removeprefix("sha256:"):
        raise ArchiveError(f"{record_id}: the block digest does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ArchiveError(f"{record_id}: the payload does not match its length or digest")
    if kind not in ("response", "revisit") or (kind == "revisit" and "warc-refers-to" not in fields):
        raise ArchiveError(f"{record_id}: record type {kind!r}")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    return _page(record_id), fields.get("warc-target-uri"), size, digest, kind, refers, payload if kind == "response" else None


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the first records of an archive; those themselves if they are too few."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n"


def encode_archive(records: list[bytes]) -> bytes:
    samples, total = [], 0
    for record in records[:DICT_RECORDS]:
        samples.append(record[: DICT_SAMPLE_BYTES // DICT_RECORDS])
        total += len(record)
    dictionary = _dictionary(samples)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    out = [struct.pack("<II", DICT_MAGIC, len(dictionary)), dictionary]
    out += [packer.compress(record) for record in records]
    return b"".join(out)


def _frame_end(data: memoryview, at: int) -> int:
    """The end of the frame at `at`, from its header and the headers of its blocks."""
    params = zstandard.get_frame_parameters(data[at : at + 32])
    end = at + zstandard.frame_header_size(data[at : at + 32])
    while True:
        if end + 3 > len(data):
            raise ArchiveError("an archive ends inside a frame")
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * params.has_checksum
    if end > len(data):
        raise ArchiveError("an archive ends inside a frame")
    return end


def decode_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    data, at, unpacker = memoryview(content), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise ArchiveError("an archive ends inside a frame header")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ArchiveError("an archive ends inside a skippable frame")
            if at == 0 and magic == DICT_MAGIC:
                dictionary = bytes(data[8 : 8 + size])
                if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
                    dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        end = _frame_end(data, at)
        unpacker = unpacker or zstandard.ZstdDecompressor()
        try:
            yield unpacker.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as why:
            raise ArchiveError(f"the frame at byte {at} cannot be decoded: {why}") from why
        at = end


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add payload, digest and `refers_to` (null: the page is a response).

    Digests are counted with map-side combine; only those found twice are kept, so that
    the join is with a small table, and Spark may split its hot keys.
    """
    page = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.octet_length("payload") >= min_bytes)
    seen = page.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = stored(seen.where("n > 1").select(F.col("digest").alias("d"), "first"), "repeated")
    key = F.when(F.col("large"), F.col("digest"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return page.join(again, key == F.col("d"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(classified: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one or more archives for each partition below `folder`.

    A task writes to a folder of its own and moves it to its final name at the end; if an
    earlier attempt of the same partition got there first, that one stands.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        own, final = f"{base}/_open-{part:06d}-{uuid.uuid4().hex}", f"{base}/part-{part:06d}"
        records: list[bytes] = []
        size = count = 0

        def flush() -> None:
            nonlocal size, count
            if records:
                fs.create_dir(own, recursive=True)
                with fs.open_output_stream(f"{own}/{count:05d}.warc.zst", compression=None) as out:
                    out.write(encode_archive(records))
                records.clear()
                size, count = 0, count + 1

        for batch in batches:
            for row in batch.itertuples(index=False):
                page_id = None if pd.isna(row.page_id) else int(row.page_id)
                refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                record = encode_record(page_id, row.url, bytes(row.payload), row.digest, refers)
                if records and size + len(record) > archive_bytes:
                    flush()
                records.append(record)
                size += len(record)
        flush()
        if count:
            if fs.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
                try:
                    fs.move(own, final)
                except OSError:
                    if fs.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
                        raise
            if fs.get_file_info(own).type != pyarrow.fs.FileType.NotFound:
                fs.delete_dir(own)
        yield pd.DataFrame({"archives": [count]})

    typed = classified.select(
        F.col("page_id").cast("decimal(20,0)").cast("string").alias("page_id"),
        "url",
        "payload",
        "digest",
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    typed.mapInPandas(run, "archives long").write.format("noop").mode("overwrite").save()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Read all ``*.warc.zst`` files below `folder` as rows of `RECORD`."""
    files = (
        spark.read.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.warc.zst")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for record in decode_archive(bytes(content)):
                    rows.append(decode_record(record))
                    size += len(record)
                    if size > 8 << 20:
                        yield _frame(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    return files.select("content").mapInPandas(run, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for name in ("page_id", "refers_to", "payload_bytes"):
        out[name] = out[name].astype("Int64")
    return out


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html) to archives and return what is read back."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    pyarrow_uri = uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    fs, base = pyarrow.fs.FileSystem.from_uri(pyarrow_uri)
    fs.create_dir(base, recursive=True)
    write_archives(classify(pages), pyarrow_uri)
    return read_archives(spark, uri)
