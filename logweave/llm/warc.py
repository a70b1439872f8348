"""WARC archives, Zstandard-compressed: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes its rows to archives of bounded size in a folder that all machines share, each with a
dictionary trained on its first records. An archive appears under its final name only when complete, and the name
depends on the task alone, so a repeated task replaces its own archives. Reading: tasks stream archives frame by frame
and check lengths, headers and digests; nothing but one record is held at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder

# fixed: magic numbers of the formats
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive ends after so many payload bytes; a dictionary is trained on so many records and bytes at its start.
ARCHIVE_BYTES, TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 64 << 20, 200, 2 << 20, 32 << 10
CHUNK = 64 << 10


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    fields.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; ValueError if its version, headers, lengths or digest are wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        fields[key.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"record without {', '.join(sorted(missing))}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest) - 4} bytes says it has {length}")
    http, sep, payload = rest[:length].partition(b"\r\n\r\n")
    says = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or len(says) != 1:
        raise ValueError("record without an HTTP head")
    kind, of = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (says[0] != len(payload) or digest(payload) != of):
        raise ValueError("payload doesn't match its length or digest")
    return {
        "page_id": _number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": says[0],
        "payload_digest": of,
        "refers_to": _number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload if kind == "response" else None,
    }


def write_archive(out, records: Iterable[bytes]) -> int:
    """Write records to a binary file; returns how many there were."""
    import zstandard

    records = iter(records)
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if len(first) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
            break
    try:
        learnt = zstandard.train_dictionary(DICTIONARY_BYTES, first)
    except zstandard.ZstdError:  # too few records to learn from
        learnt = None
    if learnt:
        raw = learnt.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    pack = zstandard.ZstdCompressor(level=3, dict_data=learnt, write_content_size=True, write_checksum=True)
    n = 0
    for part in (first, records):
        for r in part:
            out.write(pack.compress(r))
            n += 1
    return n


def read_archive(source) -> Iterator[bytes]:
    """The records of a binary file, one for each frame."""
    import zstandard

    head = source.read(8)
    known = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut off")
        if raw[:4] == ZSTD_FRAME:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        known, head = zstandard.ZstdCompressionDict(raw), b""
    context = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    data = head
    while data or (data := source.read(CHUNK)):
        frame, parts = context.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = source.read(CHUNK)
            if not data:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, html, revisit, refers_to): of equal payloads of ``least`` bytes and more the largest id responds."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("html")), "size": F.octet_length("html")})
    owners = cut(rows.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND owner IS NOT NULL").drop("n"))
    few = owners.count() <= 1_000_000
    joined = rows.join(F.broadcast(owners) if few else owners, ["sha", "size"], "left")
    revisit: Column = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("owner")).alias("refers_to"))


def write_warc(classified: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder`` (a path or URI on all machines); returns (path, records), materialised."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        rows = ([x.as_py() for x in row] for batch in batches for row in zip(*batch.columns, strict=True))
        row = next(rows, None)
        paths, sizes = [], []
        while row is not None:
            path = f"{base}/part-{task.partitionId():06d}-{len(paths):04d}.warc.zst"
            draft = f"{base}/.{task.taskAttemptId()}-{len(paths)}"
            left = row

            def some() -> Iterator[bytes]:
                nonlocal left
                done = 0
                while left is not None and done < ARCHIVE_BYTES:
                    page_id, url, html, revisit, refers_to = left
                    payload = html.encode()
                    done += len(payload)
                    yield record(page_id, url, payload, refers_to, revisit)
                    left = next(rows, None)

            with store.open_output_stream(draft, compression=None) as out:
                n = write_archive(out, some())
            store.move(draft, path)
            paths.append(path)
            sizes.append(n)
            row = left
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], ["path", "records"])

    return cut(classified.mapInArrow(run, "path string, records long"))


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_warc(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of the archives in column ``path``; those that are damaged raise an error.

    ``folder`` names their file system. With ``payload``, a binary column has each response's payload.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        want = [*names, *["payload"] * payload]

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in want], want)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                with store.open_input_stream(path, compression=None) as source:
                    for raw in read_archive(source):
                        rows.append(parse(raw))
                        if len(rows) >= (64 if payload else 4096):
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

    return archives.select("path").mapInArrow(run, RECORD + ", payload binary" * payload)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives to the shared folder, read them back: one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url. A null html is an empty payload, and
    equal payloads include empty ones. Rows that repeat the largest id of their payload are all responses; rows without
    an id revisit their payload's owner, or are responses if no row with it has an id. A null url has no header.
    An empty table writes no archive. The archives stay in the folder.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_warc(classify(pages), folder)
    count = archives.count()
    spread = archives.repartition(min(count, 10_000)) if count > 1 else archives
    return read_warc(spread, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
