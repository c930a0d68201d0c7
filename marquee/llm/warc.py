"""WARC archives: one gzip member per record, written and read sequentially."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import identified, join_groups
from marquee.session import durable, new_folder

#: A writer begins a new archive when one has reached this size.
ARCHIVE_BYTES = 256 << 20
#: The reader takes this much of an archive at once.
CHUNK = 1 << 16
#: Records carry the date of the crawl; without one, this.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that does not hold what its headers say."""


def files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    local = re.fullmatch(r"(?:file:)?/+(.*)", uri)
    return pyarrow.fs.FileSystem.from_uri("file:///" + local[1] if local else uri)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member.

    A response holds HTTP headers and payload, a revisit the headers alone; both give digest
    and length of the full payload.
    """
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        escaped = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
        head.append(f"WARC-Target-URI: {escaped}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def members(stream) -> Iterator[bytes]:
    """The decompressed parts of the gzip members of a stream; b'' ends a member."""
    unpack, data = zlib.decompressobj(31), b""
    begun = False
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                if begun:
                    raise WarcError("the archive ends inside a member")
                return
        begun = True
        try:
            part = unpack.decompress(data, CHUNK)
        except zlib.error as error:
            raise WarcError(f"bad gzip member: {error}") from None
        if part:
            yield part
        if unpack.eof:
            yield b""
            data, unpack, begun = unpack.unused_data, zlib.decompressobj(31), False
        else:
            data = unpack.unconsumed_tail


def records(stream) -> Iterator[Record]:
    """Records of an archive, read in one pass: headers, then Content-Length bytes, then the end.

    Lengths and digests are checked.  Memory holds one record.
    """
    held = bytearray()
    headers: dict[str, str] | None = None
    for part in members(stream):
        held += part
        if headers is None and (at := held.find(b"\r\n\r\n")) >= 0:
            headers = _headers(bytes(held[:at]).decode("utf-8", "surrogatepass"), "WARC/")
            del held[: at + 4]
        if part:
            continue
        if headers is None:
            raise WarcError("a member without record headers")
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError("a record without a length") from None
        if len(held) != size + 4 or held[size:] != b"\r\n\r\n":
            raise WarcError(f"a record of {size} bytes holds {len(held) - 4}")
        block = bytes(held[:size])
        if headers.get("warc-block-digest", "") not in ("", "sha1:" + digest(block)):
            raise WarcError(f"{headers.get('warc-record-id')}: the block does not match its digest")
        yield Record(headers, block)
        held.clear()
        headers = None


def _headers(text: str, first: str) -> dict[str, str]:
    lines = text.split("\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"{lines[0][:40]!r} begins no headers")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def payload_of(found: Record) -> tuple[bytes, int, str]:
    """Stored payload (b'' of a revisit), full length and digest; a stored payload is checked."""
    head, _, payload = found.block.partition(b"\r\n\r\n")
    size = int(_headers(head.decode("latin-1"), "HTTP/").get("content-length", len(payload)))
    named = found.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if found.headers.get("warc-type") == "response" and (len(payload) != size or digest(payload) != named):
        raise WarcError(f"{found.headers.get('warc-record-id')}: the payload does not match its digest")
    return payload, size, named


def write_archives(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_revisit_bytes: int = 0,
    folder: str | None = None,
) -> DataFrame:
    """Write a record per page and return the archives: path, records, bytes.

    Of pages with equal payloads of at least ``least_revisit_bytes`` bytes, the one with the
    largest key (of several, one of them) becomes a response and the others revisit it; all
    others are responses.  Null payloads are empty, a null key is the smallest, a null URL is left
    out, control characters and blanks in one are escaped.

    Each attempt of a task writes under a name of its own, and only the names that successful
    tasks return count, so lost executors and repeated tasks leave no record twice.  The folder
    must be one that all executors reach; default is a new one under the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit(""))
    kept = durable(
        identified(
            pages,
            F.col(key).alias("_key"),
            F.col(url).alias("_url"),
            body.alias("_body"),
            F.sha1(body.cast("binary")).alias("_sha"),
        )
    )
    total = kept.count()
    groups = (
        kept.where(F.octet_length("_body") >= least_revisit_bytes)
        .groupBy("_sha")
        .agg(F.max(F.struct("_key", "_row")).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    rows = join_groups(kept, groups, "_sha", "_n", total).select(
        "_key", "_url", "_body", "_row",
        F.col("_facts._first._key").alias("_to_key"),
        F.col("_facts._first._row").alias("_to_row"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = files(folder)
        system.create_dir(root, recursive=True)
        out, path, count, size = None, None, 0, 0
        for batch in batches:
            values = (batch[c] for c in ("_key", "_url", "_body", "_row", "_to_key", "_to_row"))
            for page, address, text, row, to_page, to_row in zip(*values, strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = system.open_output_stream(path, compression=None), 0, 0
                revisit = pd.notna(to_row) and to_row != row
                data = record(
                    "revisit" if revisit else "response",
                    record_name(page, row),
                    address,
                    text.encode("utf-8", "surrogatepass"),
                    record_name(to_page, to_row) if revisit else None,
                )
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [count], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [count], "bytes": [size]})

    written = rows.mapInPandas(write, "path string, records long, bytes long")
    # Names as the file system of the folder has them; the folder's own name finds it again.
    return durable(written.select(F.lit(folder).alias("folder"), "path", "records", "bytes"))


def record_name(key, row) -> str:
    return f"urn:page:{'' if pd.isna(key) else int(key)}:{int(row)}"


def page_of(name: str | None) -> int | None:
    """The page that a record name of :func:`record_name` stands for."""
    match = re.match(r"<urn:page:(-?\d+):", name or "")
    return int(match[1]) if match else None


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives (folder, path): page_id, url, record_type, payload_bytes, payload_digest,
    refers_to and, if wanted, payload; every length and digest is checked, a mismatch fails."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, path in zip(batch["folder"], batch["path"], strict=True):
                system, _ = files(folder)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for found in records(stream):
                        payload, size, named = payload_of(found)
                        rows.append(
                            {
                                "page_id": page_of(found.headers.get("warc-record-id")),
                                "url": found.headers.get("warc-target-uri"),
                                "record_type": found.headers["warc-type"],
                                "payload_bytes": size,
                                "payload_digest": named,
                                "refers_to": page_of(found.headers.get("warc-refers-to")),
                                "payload": payload if with_payload else None,
                            }
                        )
                        held += len(payload)
                        if held >= CHUNK * 128 or len(rows) >= 10_000:
                            yield _frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows)

    count = max(1, archives.count())
    schema = (
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, payload binary"
    )
    found = archives.select("folder", "path").repartition(count).mapInPandas(read, schema)
    return found if with_payload else found.drop("payload")


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
