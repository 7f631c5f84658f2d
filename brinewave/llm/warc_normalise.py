"""WARC archives: whole-file gzip rewritten as one gzip member per record, with an offset index.

1. ``write_archives`` writes pages as response records in files that are a single gzip
   stream each, and a table of their records (file, position, key, payload digest, size).
2. ``repeats`` finds, among records of equal payloads of at least ``min_bytes``, those that
   are to be revisits of the one with the smallest key.
3. ``normalise`` inflates each file once, as a stream, rewrites every record as its own
   member, records in the repeats as revisits without payload, and writes a sidecar
   index of (offset, length, type, record id, key) in lines of JSON.
4. ``read_archives`` reads each record back alone by its index entry and checks its payload
   against its digest.

A task handles a file at a time, with one record in memory; files hold about
``archive_bytes`` of payload. Payloads are never shuffled, only keys and digests. Files are
written under a name of the attempt and then renamed, so a repeated task replaces its own
file. Folders may be in any file system that Arrow knows.

A null payload is empty. A null key has no header; it is preferred last as a response and a
revisit of it has a null key. Of equal keys with equal payloads the first written is the
response. Empty tables write no files and give no rows. A truncated or broken stream is an
error that names the file. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from brinewave.llm.common import arrow_map, fresh_path, stored

ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 18
_ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


# -- records ----------------------------------------------------------------------------


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record with its closing blank lines."""
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def http_block(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


class Inflater:
    """Reads a gzip stream of one or many members a piece at a time."""

    def __init__(self, source, name: str):
        self.source, self.name = source, name
        self.held = bytearray()
        self.z = zlib.decompressobj(31)
        self.ended = False

    def _more(self) -> bool:
        raw = self.z.unconsumed_tail or self.source.read(CHUNK)
        if not raw:
            if not self.z.eof and not self.ended:
                raise ValueError(f"{self.name}: the gzip stream ends early")
            return False
        while raw:
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            try:
                self.held += self.z.decompress(raw)
            except zlib.error as broken:
                raise ValueError(f"{self.name}: {broken}") from broken
            raw = self.z.unused_data if self.z.eof else b""
        self.ended = self.z.eof
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held.strip():
                    raise ValueError(f"{self.name}: a record ends early")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError(f"{self.name}: a record ends early")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(source, name: str) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers without the length, block) of each record of a stream."""
    stream = Inflater(source, name)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no WARC record where one should begin")
        headers = [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]]
        size = int(next(v for k, v in headers if k.lower() == "content-length"))
        block = stream.take(size)
        stream.take(4)
        yield [(k, v) for k, v in headers if k.lower() != "content-length"], block


# -- files ------------------------------------------------------------------------------


class Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        context = TaskContext.get()
        self.part = f"{self.path}.{context.taskAttemptId() if context else 0}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.part, compression=None)
        self.write = self.stream.write

    def close(self) -> None:
        self.stream.close()
        try:
            self.fs.move(self.part, self.path)
        except OSError:
            # some file systems do not replace: an earlier attempt's file gives way
            self.fs.delete_file(self.path)
            self.fs.move(self.part, self.path)


def _open(path: str):
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write the pages; (file, position, key, digest, size) for each record."""
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))

    def run(batches):
        task = TaskContext.get().partitionId()
        out = squeeze = None
        made, held, seq, position = [], 0, 0, 0

        def close():
            out.write(squeeze.flush())
            out.close()

        def listed():
            return pa.RecordBatch.from_arrays(
                [pa.array([m[i] for m in made], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                names=["file", "position", "key", "digest", "size"])

        for batch in batches:
            for name, link, text in zip(*[batch.column(c) for c in range(3)]):
                if out is None:
                    path, position = f"{folder}/raw/part-{task:06d}-{seq:05d}.warc.gz", 0
                    out, squeeze = Output(path), zlib.compressobj(level, zlib.DEFLATED, 31)
                name, link, body = name.as_py(), link.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(body).hexdigest()
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_ID_SPACE, f'{path[-24:]}#{position}')}>"),
                           ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
                           ("WARC-Payload-Digest", f"sha256:{digest}")]
                headers += [("WARC-Target-URI", link)] * (link is not None) + [("X-Page-ID", name)] * (name is not None)
                out.write(squeeze.compress(record(headers, http_block(body))))
                made.append((path, position, name, digest, len(body)))
                held, position = held + len(body), position + 1
                if held >= archive_bytes:
                    close()
                    out, held, seq = None, 0, seq + 1
            if made:
                yield listed()
                made = []
        if out is not None:
            close()

    return stored(arrow_map(rows, run, "file string, position bigint, key string, digest string, size bigint"), "warc-records")


def repeats(listed: DataFrame, key_type: str, min_bytes: int = 100) -> DataFrame:
    """(file, position, refers_to, refers_id) of the records that repeat an earlier key's payload."""
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key").cast(key_type).alias("k"), "file", "position", "key")
    large = listed.where(F.col("size") >= min_bytes)
    first = large.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return large.join(first, "digest").where("file <> first.file OR position <> first.position").select(
        "file", "position", F.col("first.key").alias("refers_to"), F.col("first.file").alias("first_file"), F.col("first.position").alias("first_position"))


def normalise(listed: DataFrame, revisits: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each raw file; (file, index, records) for each one written."""
    files = stored(listed.select("file").distinct(), "warc-names")
    revisits = stored(revisits, "warc-repeats")
    # names are few bytes: without a number of their own, partitions would be merged into a few tasks
    tasks = max(1, files.count())

    def rewrite(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        again = {int(r.position): r for r in right.itertuples(index=False)}
        done = []
        for source in left["file"]:
            target = f"{folder}/members/{source.rsplit('/', 1)[1]}"
            out, side = Output(target), Output(f"{target}.idx")
            offset = n = 0
            with _open(source) as stream:
                for n, (headers, block) in enumerate(records(stream, source), 1):
                    known = dict(headers)
                    if (r := again.get(n - 1)) is not None:
                        body = payload_of(block)
                        block = block[:len(block) - len(body)]
                        headers = [(k, "revisit" if k == "WARC-Type" else v) for k, v in headers] + [
                            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(_ID_SPACE, f'{r.first_file[-24:]}#{r.first_position}')}>"),
                            ("X-Payload-Length", str(len(body)))]
                        headers += [("X-Refers-To-Page", r.refers_to)] * (r.refers_to is not None)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(record(headers, block)) + z.flush()
                    out.write(member)
                    entry = {"offset": offset, "length": len(member), "type": dict(headers)["WARC-Type"], "id": known["WARC-Record-ID"], "key": known.get("X-Page-ID")}
                    side.write((json.dumps(entry) + "\n").encode())
                    offset += len(member)
            out.close()
            side.close()
            done.append((target, f"{target}.idx", n))
        return pd.DataFrame(done, columns=["file", "index", "records"])

    written = files.repartition(tasks, "file").groupBy("file").cogroup(revisits.repartition(tasks, "file").groupBy("file")).applyInPandas(
        rewrite, "file string, index string, records bigint")
    return stored(written, "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every indexed record."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                system, inner = pafs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as source, _open(index) as entries:
                    for line in _lines(entries):
                        entry = json.loads(line)
                        source.seek(entry["offset"])
                        with pa.BufferReader(source.read(entry["length"])) as member:
                            (headers, block), = records(member, path)
                        head = dict(headers)
                        digest = head["WARC-Payload-Digest"].partition(":")[2]
                        body = payload_of(block)
                        size = int(head.get("X-Payload-Length", len(body)))
                        if head["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{path}: payload at {entry['offset']} does not have its digest")
                        rows.append((head.get("X-Page-ID"), size, digest, head["WARC-Type"], head.get("X-Refers-To-Page")))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=names)

    return arrow_map(files.select("file", "index").repartition(max(1, files.count()), "file"), run,
                     "key string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while piece := stream.read(CHUNK):
        *whole, held = (held + piece).split(b"\n")
        yield from whole
    if held:
        yield held


def round_trip(pages: DataFrame, folder: str | None = None, key: str = "page_id", min_bytes: int = 100) -> DataFrame:
    """Write, normalise and read back the pages: (key, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    kind = pages.schema[key].dataType.simpleString()
    listed = write_archives(pages, folder, key)
    files = normalise(listed, repeats(listed, kind, min_bytes), folder)
    return read_archives(files).select(
        F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
