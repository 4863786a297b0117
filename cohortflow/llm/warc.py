"""WARC archives, one Zstandard frame per record, with a dictionary in a leading skippable frame.

Writer: every task trains a dictionary on its first records (a bounded sample; raw content where training is not
possible) and writes archives through the file system of the shared folder: magic 0x184D2A5D, length, dictionary, then
one frame per record.  File names hold the task attempt, and only archives listed by successful tasks are read, so a
retried task leaves at most an unread file.  Reader: loads the dictionary, decodes one frame at a time from a stream,
and checks the version line, required headers, block length, record end, one record per frame and payload digest.

Records with equal payloads of at least `least` bytes: the one with the smallest id is a response, the others are
revisits that refer to it; smaller ones are all responses.

Edge cases: a null payload is empty; a null id is a response and never referred to; rows that repeat the smallest id
are responses; control characters in a url are percent-encoded, a null url has no header; extra columns are ignored;
an empty table gives no archive and an empty result; a payload of any length is one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import shuffle_width, stored
from cohortflow.session import scratch_path

DICT_MAGIC = 0x184D2A5D
_SAMPLE_BYTES, _DICT_BYTES = 2 << 20, 64 << 10
_CHUNK = 1 << 20
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_DATE = "1970-01-01T00:00:00Z"


class BadRecord(ValueError):
    """An archive or record that breaks the format."""


def _files(uri: str):
    from pyarrow.fs import FileSystem

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{int(page_id)}>"


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    ident = _urn(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {ident}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """Headers (lower-case names), payload and HTTP headers of one record; raises BadRecord."""
    top, found, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise BadRecord(f"version line {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadRecord(f"header {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    if lost := [h for h in _REQUIRED if h not in headers]:
        raise BadRecord(f"no {lost[0]}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    if not found:
        raise BadRecord("no HTTP head")
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    if headers["warc-type"] == "response":
        if inner.get("content-length") != str(len(payload)):
            raise BadRecord(f"payload of {len(payload)} bytes, HTTP length {inner.get('content-length')}")
        if headers.get("warc-payload-digest") != "sha1:" + payload_digest(payload):
            raise BadRecord("payload digest")
    elif headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise BadRecord("revisit with a payload or without a reference")
    return headers, payload, inner


def _dictionary(samples: list[bytes]):
    import zstandard as z

    try:
        return z.train_dictionary(min(_DICT_BYTES, sum(map(len, samples)) // 8), samples)
    except (z.ZstdError, ValueError):
        raw = b"".join(samples)[-_DICT_BYTES:]
        return z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def write_archive(out, records: Iterator[bytes], level: int = 3) -> tuple[int, int]:
    """Write one archive to a binary file object; returns records and bytes."""
    import itertools

    import zstandard as z

    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= _SAMPLE_BYTES:
            break
    d, n, wrote = _dictionary(sample), 0, 0
    if d is not None:
        body = d.as_bytes()
        wrote += out.write(struct.pack("<II", DICT_MAGIC, len(body)) + body)
    comp = z.ZstdCompressor(level=level, dict_data=d, write_checksum=True, write_content_size=True)
    for r in itertools.chain(sample, records):
        wrote += out.write(comp.compress(r))
        n += 1
    return n, wrote


def read_archive(f) -> Iterator[bytes]:
    """Records of an archive, one frame each, from a binary file object."""
    import zstandard as z

    buf = f.read(8)
    dictionary = None
    if len(buf) == 8 and struct.unpack("<I", buf[:4])[0] == DICT_MAGIC:
        size = struct.unpack("<I", buf[4:])[0]
        body = f.read(size)
        if len(body) != size:
            raise BadRecord("cut dictionary")
        if body[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            body = z.ZstdDecompressor().decompress(body)
        kind = z.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else z.DICT_TYPE_RAWCONTENT
        dictionary, buf = z.ZstdCompressionDict(body, dict_type=kind), b""
    dec = z.ZstdDecompressor(dict_data=dictionary)
    while buf := buf or f.read(_CHUNK):
        frame, parts = dec.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buf))
            except z.ZstdError as e:
                raise BadRecord(f"frame: {e}") from e
            if frame.eof:
                buf = frame.unused_data
                break
            buf = f.read(_CHUNK)
            if not buf:
                raise BadRecord("cut frame")
        yield b"".join(parts)


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write all pages as archives under `folder`; returns the stored list (path, records, bytes).

    Payloads move once, to meet the smallest id of their digest."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    first = p.groupBy("digest", "n").agg(F.min("page_id").alias("first_id"))
    p = p.join(first, ["digest", "n"])
    other = (F.col("n") >= least) & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    p = p.select("page_id", "url", "payload", F.when(other, F.col("first_id")).alias("refers_to"))

    def run(batches):
        fs, root = _files(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()

        def rows():
            for b in batches:
                for page, url, body, ref in zip(*(b.column(i) for i in range(4))):
                    yield record(page.as_py(), url.as_py(), body.as_py(), ref.as_py())

        def until_full(it, first):
            size = len(first)
            yield first
            while size < archive_bytes and (r := next(it, None)) is not None:
                size += len(r)
                yield r

        import pyarrow as pa

        it, k = rows(), 0
        while (r := next(it, None)) is not None:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{k}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}") as out:
                n, wrote = write_archive(out, until_full(it, r))
            k += 1
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": wrote}])

    return stored(p.mapInArrow(run, "path string, records long, bytes long"), "warc-list")


def read_pages(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the listed archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    def run(frames):
        for pdf in frames:
            for path in pdf["path"]:
                fs, at = _files(path)
                out, size = [], 0
                with fs.open_input_stream(at) as f:
                    for raw in read_archive(f):
                        h, payload, http = parse(raw)
                        number = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", v or "")) else None
                        row = (number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")),
                               int(http["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"))
                        out.append((*row, payload) if with_payload else row)
                        size += len(payload) if with_payload else 200
                        if size >= 8 << 20:
                            yield frame(out)
                            out, size = [], 0
                if out:
                    yield frame(out)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload

    def frame(out):
        pdf = pd.DataFrame(out, columns=names)
        for c in ("page_id", "refers_to"):
            pdf[c] = pdf[c].astype("Int64")
        return pdf

    dealt = archives.select("path").repartition(shuffle_width(archives.sparkSession), "path")
    return dealt.mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder for archives under the shared checkpoint folder."""
    return scratch_path(spark, "warc")
