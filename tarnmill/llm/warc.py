"""Dictionary-compressed WARC archives.

A Zstandard dictionary is trained on a bounded sample of the records as they are archived. Each archive begins with
a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one frame per record, so that any record
can be read by itself. Archives are rows of a table in the shared folder (archive, records, content); `content` is the
file's bytes, and export_archives() writes the files themselves.

Of records with equal payloads of at least `least` bytes, that with the smallest page_id is a response and the
others are revisits that refer to it. The digests are grouped with a partial minimum before the shuffle, and joined
back by a join whose large side Spark can split, so a payload that a third of all pages share is no hot key.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, materialize

MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
#: Bounds of the training sample and of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 400, 32_768, 65_536
ARCHIVE_BYTES = 1 << 20
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _uri(url: str) -> str:
    """Line ends would end the header."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _url(uri: str) -> str:
    return uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id, url, html, digest: str, kind: str, refers_to, n: int, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its length and digest stand in the header."""
    payload = (html or "").encode("utf-8", "surrogatepass") if kind == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """The records of a decompressed archive, as dictionaries of headers, the HTTP headers and the payload."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        block = data[start : start + size]
        split = block.index(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in block[:split].decode("latin-1").split("\r\n")[1:])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("the record does not end where its length says")
        yield head, http, block[split + 4 :]
        at = start + size + 4


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """The dictionary's bytes; with too few or too small samples, their contents serve as a raw dictionary."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def compressor(dictionary: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def open_archive(content: bytes) -> bytes:
    """All records of an archive, decompressed with the dictionary of its leading frame."""
    import zstandard

    magic, n = struct.unpack_from("<II", content)
    if magic != MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    d = content[8 : 8 + n]
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)
    with unpack.stream_reader(content[8 + n :], read_across_frames=True) as r:
        return r.read()


def _writer(dictionary: bytes, level: int, most: int):
    def run(batches):
        pack, lead = compressor(dictionary, level), leading_frame(dictionary)
        frames: list[bytes] = []
        size = 0

        def archive():
            content = lead + b"".join(frames)
            name = hashlib.sha256(content).hexdigest()[:32]
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.zst"]), pa.array([len(frames)], pa.int64()), pa.array([content], pa.binary())], names=["archive", "records", "content"])

        for b in batches:
            for row in b.to_pylist():
                f = pack.compress(record_bytes(row["page_id"], row["url"], row["html"], row["digest"], row["kind"], row["first"], row["bytes"]))
                frames.append(f)
                size += len(f)
                if size >= most:
                    yield archive()
                    frames, size = [], 0
        if frames:
            yield archive()

    return run


def _reader(payloads: bool):
    def run(batches):
        for b in batches:
            for content in b.column(0):
                out: list[tuple] = []
                for head, http, payload in parse_records(open_archive(content.as_py())):
                    kind, n, digest = head["WARC-Type"], int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    own, ref = head["WARC-Record-ID"][10:-1], head.get("WARC-Refers-To")
                    uri = head.get("WARC-Target-URI")
                    out.append((None if own == "null" else int(own), None if uri is None else _url(uri), n, digest, kind, int(ref[10:-1]) if ref else None, payload if payloads and kind == "response" else None))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    return run


def write_archives(pages: DataFrame, least: int = 100, level: int = 3, sample_records: int = SAMPLE_RECORDS, sample_bytes: int = SAMPLE_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per page and returns the written table of archives (archive, records, content).

    pages: page_id long, url string, html string; other columns are ignored. A null html is an empty payload. A
    null url has no target header. Pages with a null page_id are archived, but no other page refers to them; if
    all copies of a payload have a null page_id, all are responses. Rows that repeat the page_id of a response are
    responses too. An empty table gives no archive. The dictionary is trained on at most sample_records records, of the
    pages with the smallest hashes of their page_id, and of these on the first characters that fit into sample_bytes.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    slim = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    firsts = slim.where("copies > 1 and first is not null").select("digest", "first")
    kind = F.when(F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), "response").otherwise("revisit")
    marked = rows.join(firsts, "digest", "left").withColumn("kind", kind)
    ids = bounded_sample(pages.select(F.col("page_id").cast("long").alias("page_id")).where("page_id is not null"), sample_records, "page_id").distinct()
    picked = rows.join(F.broadcast(ids), "page_id", "left_semi").orderBy("page_id", "digest").limit(sample_records)  # at most sample_records numbers
    picked = picked.withColumn("html", F.substring("html", 1, sample_bytes // 4)).collect()
    dictionary = train_dictionary([record_bytes(r["page_id"], r["url"], r["html"], r["digest"], "response", None, r["bytes"]) for r in picked])
    archives = marked.select("page_id", "url", "html", "digest", "bytes", "kind", "first").mapInArrow(_writer(dictionary, level, archive_bytes), "archive string, records long, content binary")
    return materialize(archives, "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    Lengths and digests of responses are checked against the payload that was read.
    """
    return archives.select("content").mapInArrow(_reader(payloads), RECORD)


def _exporter(uri: str):
    def run(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        for b in batches:
            for row in b.to_pylist():
                at = f"{folder.rstrip('/')}/{row['archive']}"
                part = f"{at}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(row["content"])
                store.move(part, at)
            yield b.drop_columns(["content"])

    return run


def export_archives(archives: DataFrame, uri: str) -> DataFrame:
    """Writes each archive as a file (name.warc.zst) into a folder that all executors reach; returns archive and records.

    archives: a written table, as of write_archives(). uri: what Arrow's file systems open (file, hdfs, s3, gs).
    Names are digests of the contents and files are moved into place when they are whole, so a task that is run again
    writes the same files; what a lost task leaves ends in .part. Without archives the folder is empty.
    """
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(folder, recursive=True)
    return materialize(archives.select("archive", "records", "content").mapInArrow(_exporter(uri), "archive string, records long"), "exported")


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """The archives of a folder, for read_archives(): archive and content; files that are not whole are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
