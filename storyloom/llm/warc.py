"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or itself compressed;
every record is one frame of its own. Archives are files, which tasks write and Spark's binaryFile source reads. The reader
takes its (path, content) rows, loads the dictionary, decodes frame by frame, and checks the record's version line, its headers, that the block
has Content-Length bytes, and the digest of its payload. A bad record is reported with its error and reading goes on
at the next frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint_dir, durable, slices
from .files import read_files, write_files

SUFFIX = ".warc.zst"
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"
#: Equal payloads of fewer bytes are stored again, not revisited.
LEAST = 100
#: Bytes of payload in an archive (one longer payload is an archive of its own), and of its dictionary.
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 8 << 10
#: A value in Spark holds no more; a frame that says it does is rejected, so that a bad length can't take a task's memory.
MOST_BYTES = (1 << 31) - 1
#: Repeated payloads whose digests are sent to all tasks at once (about 100 bytes each); and the salts of a payload beyond.
SENT, SALTS = 500_000, 64


def dictionary_of(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the archive's own first payloads; from raw content where they are too few to train on."""
    samples = [s[:4096] for s in samples if s][:128]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, n_bytes: int, first) -> bytes:
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in url))
    head += ["Content-Type: text/html", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {n_bytes}"]
    block = payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
        block = b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], samples: list[bytes]) -> bytes:
    words = dictionary_of(samples)
    kept = zstandard.ZstdCompressor(level=3).compress(words.as_bytes())
    pack = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(kept)), kept, *map(pack.compress, records)])


def frames(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of each frame after the leading one, from the block headers, without decoding."""
    at = 0
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME:
            end = at + zstandard.frame_header_size(data[at : at + 18])
            last = False
            while not last:
                (block,) = struct.unpack("<I", data[end : end + 3] + b"\0")
                last = bool(block & 1)
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 * zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
            if end > len(data):
                raise ValueError("truncated frame")
            yield at, end
        else:
            raise ValueError(f"no frame at byte {at}")
        at = end


def dictionary_in(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None
    held = data[8 : 8 + struct.unpack_from("<I", data, 4)[0]]
    if held[:4] == struct.pack("<I", FRAME):
        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=16 << 20)
    return zstandard.ZstdCompressionDict(held)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one decoded record; ValueError where it isn't valid."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("not a record")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or not k.strip():
            raise ValueError("bad header line")
        headers[k.strip().decode()] = v.strip().decode()
    if missing := [k for k in NEEDED if k not in headers]:
        raise ValueError(f"no {missing[0]}")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't hold")
    block = rest[:n]
    if headers["WARC-Type"] != "revisit" and (d := headers.get("WARC-Payload-Digest")) and d != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("payload digest doesn't hold")
    return headers, block


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Rows (path, content): archives with a record for each row of pages.

    Of rows with equal payloads of LEAST bytes or more, those with the smallest key are responses and the others revisit
    that key; shorter ones are all responses. A null body is an empty payload. A null key counts as no candidate for the
    smallest; a group in which all keys are null is all responses. Repeated rows are written as often as they occur. A payload
    of more than ARCHIVE_BYTES is whole in an archive of its own; an empty table gives no archive.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{body}`"), F.lit("")).alias("body"))
    digest = F.sha2(F.encode("body", "UTF-8"), 256)
    rows = rows.withColumns({"digest": digest, "n": F.octet_length("body").cast("long")})
    # Bodies stay where they are: what moves is a row for each payload that occurs under two keys or more. While these are
    # few they are sent to all tasks; else bodies move by digest and a salt, so that no payload's rows meet in one task.
    again = rows.filter(F.col("n") >= LEAST).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("times")).filter("times > 1 and first is not null").drop("times")
    again = durable(again)
    if again.count() <= SENT:
        rows = rows.join(F.broadcast(again), "digest", "left")
    else:
        salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    rows = rows.select("key", "url", "body", "digest", "n", "first")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "body", ARCHIVE_BYTES):
                got = part.to_pydict()
                records, samples = [], []
                for k, u, b, d, n, first in zip(got["key"], got["url"], got["body"], got["digest"], got["n"], got["first"], strict=True):
                    payload = b.encode()
                    revisit = first is not None and n >= LEAST and k != first
                    records.append(record("revisit" if revisit else "response", k, u, payload, d, n, first))
                    if not revisit:
                        samples.append(payload)
                name = hashlib.sha256("".join(f"{k}:{d};" for k, d in zip(got["key"], got["digest"], strict=True)).encode()).hexdigest()[:24]
                yield pa.RecordBatch.from_pydict({"path": [f"{name}.warc.zst"], "content": pa.array([archive(records, samples)], pa.binary())})

    return rows.mapInArrow(run, "path string, content binary")


READ = "path string, offset long, record_type string, page_id long, url string, payload binary, payload_digest string, payload_bytes long, refers_to long, error string"


def read_archives(files: DataFrame) -> DataFrame:
    """One row a record of archives given as (path, content): its headers, its payload (null for a revisit) and its error.

    Of a record with an error only path, offset and error are filled. A file that isn't framed rightly ends with one error
    row at the byte where it broke. Null or empty content gives no row.
    """
    bound_batches(files.sparkSession)
    names = [x.split()[0] for x in READ.split(", ")]

    def ident(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x.lstrip("-").isdigit() else None

    def rows(path: str, data: bytes):
        at = 0
        try:
            words = dictionary_in(data)
            unpack = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
            for at, end in frames(data):
                try:
                    if (size := zstandard.frame_content_size(data[at : at + 18])) > MOST_BYTES:
                        raise ValueError(f"a record of {size} bytes")
                    h, block = parse(unpack.decompress(data[at:end], max_output_size=MOST_BYTES if size < 0 else 0))
                    n = h.get("WARC-Payload-Length")
                    revisit = h["WARC-Type"] == "revisit"
                    digest = h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
                    yield path, at, h["WARC-Type"], ident(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), None if revisit else block, digest, int(n) if n else len(block), ident(h.get("WARC-Refers-To")), None
                except (ValueError, zstandard.ZstdError) as e:
                    yield (path, at, *[None] * 7, str(e) or "bad record")
        except (ValueError, struct.error, zstandard.ZstdError) as e:
            yield (path, at, *[None] * 7, str(e) or "bad archive")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]

        def pack(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, held = [], 0
                for x in rows(path, data.as_py() or b""):
                    out.append(x)
                    held += len(x[5] or b"")
                    if held > ARCHIVE_BYTES:
                        yield pack(out)
                        out, held = [], 0
                if out:
                    yield pack(out)

    from pyspark.sql import types as T

    schema = T._parse_datatype_string(READ)
    return files.select("path", "content").mapInArrow(run, schema)


def save(archives: DataFrame, folder: str) -> None:
    """Write archives (path, content) as files under folder, a place that all tasks and the driver reach by one address.

    Names hold the task's attempt, and the manifest says which attempts count: a task that runs again, with its rows in another order or in
    fewer files, leaves nothing that is read twice. The folder is the caller's; nothing here removes it.
    """

    def contents(batches):
        for batch in batches:
            for content in batch.column(0):
                yield content.as_py(), 1

    write_files(archives.select("content"), folder, SUFFIX, contents)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the archives that save put under folder; no row where there are none. Others come by Spark's binaryFile source."""
    return read_files(spark, folder, SUFFIX).select("path", "content")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """What read_archives gives for the files of write_archives, in a new folder of the shared checkpoint folder."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    save(write_archives(pages, key, url, body), folder)
    return read_archives(load(spark, folder))
