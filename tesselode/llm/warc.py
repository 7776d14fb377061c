"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, or with no
such frame; then each record is a frame of its own, so that any record can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import _batch
from .runtime import materialise, partitions, shared_dir, tune

DICT_MAGIC = 0x184D2A5D
#: Compressed bytes after which a writer starts another archive; a record longer than that has one of its own.
ARCHIVE_BYTES = 4 << 20
#: Bytes a reader asks for at a time.
READ_BYTES = 1 << 16
#: The dictionary is trained on this many payloads, of which this many bytes count.
SAMPLES, SAMPLE_BYTES, DICT_BYTES = 256, 8192, 32768
WARC_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    x = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if x == "none" else int(x)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", WARC_DATE)]
    if url:
        head.append(("WARC-Target-URI", "".join(c for c in url if c > " ")))
    head.append(("WARC-Payload-Digest", "sha1:" + payload_digest(payload)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def parse(raw: bytes) -> dict:
    """A record's fields and payload, after checks of the version line, the headers and both lengths."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line or no end of headers")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or not k or k != k.strip():
            raise WarcError(f"not a header line: {line[:80]!r}")
        fields[k.lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise WarcError(f"{k} is missing")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length is not a number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}; the frame holds {len(rest) - 4} bytes")
    out = {"fields": fields, "block": rest[:n], "payload": None, "payload_bytes": None}
    if fields["warc-type"] in ("response", "revisit"):
        http, mark, body = out["block"].partition(b"\r\n\r\n")
        lengths = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not mark or not http.startswith(b"HTTP/") or len(lengths) != 1:
            raise WarcError("no HTTP header, or not one length in it")
        out["payload_bytes"] = lengths[0]
        if fields["warc-type"] == "response":
            if len(body) != lengths[0]:
                raise WarcError(f"the HTTP length is {lengths[0]}; the payload has {len(body)} bytes")
            want = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            if want and want != payload_digest(body):
                raise WarcError("the payload digest differs")
            out["payload"] = body
        elif "warc-refers-to" not in fields or body:
            raise WarcError("a revisit without WARC-Refers-To, or with a payload")
    return out


class _Source:
    """A file read forward in small steps."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.held, self.at = f, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.f.read(max(n - len(self.held), READ_BYTES))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.held, self.at = self.held[len(out) :], self.at + len(out)
        return out

    def frame(self, reader: zstandard.ZstdDecompressor) -> bytes:
        """What the next Zstandard frame holds."""
        d, out, begin = reader.decompressobj(), [], self.at
        try:
            while not d.eof:
                chunk = self.take(READ_BYTES)
                if not chunk:
                    raise WarcError(f"the frame at byte {begin} is cut short")
                out.append(d.decompress(chunk))
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {begin} is damaged: {e}") from e
        self.held, self.at = d.unused_data + self.held, self.at - len(d.unused_data)
        return b"".join(out)


def read_stream(f: BinaryIO) -> Iterator[dict]:
    """The records of an archive, one frame at a time; no more than a frame and a step is held."""
    source, loaded = _Source(f), None
    while len(head := source.peek(8)) == 8 and (magic := struct.unpack("<I", head[:4])[0]) & 0xFFFFFFF0 == 0x184D2A50:
        first, size = source.at == 0, struct.unpack("<I", head[4:])[0]
        source.take(8)
        body = source.take(size)
        if len(body) < size:
            raise WarcError("a skippable frame is cut short")
        if magic == DICT_MAGIC and first:
            loaded = body
            if loaded[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                loaded = zstandard.ZstdDecompressor().decompress(loaded, max_output_size=1 << 27)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(loaded) if loaded else None)
    while source.peek(1):
        yield parse(source.frame(reader))


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of an archive in memory."""
    return read_stream(io.BytesIO(content))


def train_dictionary(pages: DataFrame, id_col: str, html_col: str) -> bytes:
    """A dictionary from a bounded sample, the same for the same rows; empty if the rows are too few."""
    some = pages.where(F.length(html_col) > 0).select(F.xxhash64(F.col(id_col).cast("string"), F.substring(html_col, 1, 64)).alias("h"), F.substring(html_col, 1, SAMPLE_BYTES).alias("x"))
    # hashes are chosen alone, so that tasks send the driver no texts but those of the sample
    chosen = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(SAMPLES).collect()]
    texts = some.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("x").alias("x")).collect() if chosen else []
    samples = [record(r["h"], None, r["x"].encode(), None, False) for r in sorted(texts, key=lambda r: r["h"])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # the samples are too short or too alike to train on
        return b""


def _writer(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=True, write_checksum=True, write_dict_id=True)
        press = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, buf, n, size, made = TaskContext.get().partitionId(), [archive_head(dictionary)], 0, 0, []

        def close() -> None:
            name = f"{part:05d}-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(b"".join(buf))
            made.append((name, n))

        for batch in batches:
            for page_id, url, html, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = best is not None and best != page_id
                buf.append(press.compress(record(page_id, url, (html or "").encode(), best, revisit)))
                n, size = n + 1, size + len(buf[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    buf, n, size = [archive_head(dictionary)], 0, 0
        if n:
            close()
        yield _batch(made, ["archive", "records"], [pa.string(), pa.int64()])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row into archives in folder; returns the manifest (archive, records).

    Of rows with equal payloads of min_bytes or more, those with the largest id are responses and the others
    revisits of it; shorter payloads are all responses. Null html: an empty payload. A null id counts as smaller than
    any other. The manifest names the archives of tasks that ended well; files it lacks are not part of the result.
    """
    dictionary = train_dictionary(pages, id_col, html_col)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    best = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("best"))
    joined = rows.join(best, "digest", "left").select("page_id", "url", "html", "best")
    spark = pages.sparkSession
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    tune(spark)
    return materialise(joined.mapInArrow(_writer(folder, dictionary), "archive string, records long"))


def _read_rows(folder: str):
    """Task over names of archives in folder, which it opens one after the other."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    out, size = [], 0
                    for r in read_stream(f):
                        x = r["fields"]
                        refers = x.get("warc-refers-to")
                        out.append((_page(x["warc-record-id"]), x.get("warc-target-uri"), r["payload_bytes"], x.get("warc-payload-digest", "").removeprefix("sha1:"), x["warc-type"], _page(refers) if refers else None, r["payload"]))
                        size += len(r["block"])
                        if size >= 8 << 20:
                            yield _batch(out, names, kinds)
                            out, size = [], 0
                    yield _batch(out, names, kinds)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of all archives.

    Those the manifest names, or all *.warc.zst files of folder. A task reads an archive frame by frame, whatever its length.
    """
    if manifest is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
        manifest = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"))
    rows = manifest.select("archive").repartition(partitions(spark))
    return rows.mapInArrow(_read_rows(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages(page_id, url, html) to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if not pages.take(1):
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    manifest = write_archives(pages, folder)
    return read_archives(spark, folder, manifest)
