"""WARC archives: write pages with identical payloads as revisits, and read damaged archives back.

Each written record is a gzip member of its own. The salvage reader takes what any
writer makes: plain records or members of one or more records, of all types. It
checks gzip's checksums, lengths, line ends and those digests that a record states
in an algorithm it knows. After a failed check it looks for the next valid member or
version line, goes on from there, and reports the bytes in between as a gap. It reads
through a window, so an archive of any size takes the memory of its longest record;
one beyond ``MAX_RECORD_BYTES`` is a gap.

Defined results
* A null payload is empty. Payloads are equal if digest and length are.
* Of equal payloads of at least ``min_payload`` bytes the largest page_id is the response and the others revisit it;
  rows that share the largest id are all responses. A null id is smaller than any other; where no row has one, all are responses.
* A null address writes no target line; line breaks in an address are percent-encoded. An empty table gives no archives.
* Of responses the payload's own SHA-1 is returned, of revisits the digest that is stated, of other types none: their payload fields are null.
* A damaged archive never loses records without a word: :func:`read_archives` lists its gaps, and :func:`archived` raises if fewer records came back than were written.
* Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import bound_batches, same_key, small_side
from tidepanel.session import pinned, scratch_path

ARCHIVE_BYTES = 16 << 20
_GZIP, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
MAX_RECORD_BYTES = 1 << 30
_WINDOW = 1 << 16
# Names that Spark has for file systems, and Arrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: object, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit holds the headers of the reply only."""
    full = digest(payload)
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = reply if refers_to is not None else reply + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, full)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, full)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{full}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Source:
    """Bytes that are read by place: of memory, or of a file through a window."""

    def __init__(self, data):
        self.data, self.size = data, len(data) if isinstance(data, bytes) else data.size()
        self.window, self.begin = b"", 0

    def read(self, at: int, n: int) -> bytes:
        if isinstance(self.data, bytes):
            return self.data[at : at + n]
        n = max(0, min(n, self.size - at))
        if not self.begin <= at <= at + n <= self.begin + len(self.window):
            self.data.seek(at)
            self.begin, self.window = at, self.data.read(max(n, 16 * _WINDOW))
        return self.window[at - self.begin : at - self.begin + n]

    def search(self, at: int) -> int:
        """The next place where a member or record may start, or the end."""
        while at < self.size:
            # Parts overlap by what a start may need.
            found = _START.search(part := self.read(at, _WINDOW))
            if found:
                return at + found.start()
            at += max(1, len(part) - len(_VERSION))
            if len(part) <= len(_VERSION):
                break
        return self.size


def stated_digest_differs(stated: str | None, *data: bytes) -> bool:
    """Whether a digest in a known algorithm, in base 32 or hexadecimal, is that of none of ``data``."""
    algorithm, _, value = (stated or "").partition(":")
    made = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "md5": hashlib.md5}.get(algorithm.lower())
    if made is None or not value:
        return False
    for d in data:
        own = made(d)
        if value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=") or value.lower() == own.hexdigest():
            return False
    return True


def unchunked(payload: bytes) -> bytes | None:
    """A payload without its chunk sizes, None if it isn't chunked."""
    out, at = [], 0
    while True:
        line = payload.find(b"\r\n", at)
        size = payload[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return None
        n, begin = int(size, 16), line + 2
        if n == 0:
            return b"".join(out)
        if payload[begin + n : begin + n + 2] != b"\r\n":
            return None
        out.append(payload[begin : begin + n])
        at = begin + n + 2


def parsed(source: Source | bytes, at: int = 0) -> tuple[dict, int]:
    """(fields of the record at ``at``, where it ends); ValueError if any check fails."""
    source = Source(source) if isinstance(source, bytes) else source
    start = source.read(at, _WINDOW)
    head_end = start.find(b"\r\n\r\n")
    if head_end < 0 or not start.startswith(_VERSION):
        raise ValueError("no record header")
    lines = start[:head_end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines) if sep}
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    begin, length = at + head_end + 4, int(head["content-length"])
    if length > MAX_RECORD_BYTES:
        raise ValueError("too long")
    end = begin + length + 4
    whole = source.read(begin, length + 4)
    block = whole[:length]
    if len(whole) < length + 4 or whole[length:] != b"\r\n\r\n":
        raise ValueError("cut short")
    if stated_digest_differs(head.get("warc-block-digest"), block):
        raise ValueError("block digest differs")
    kind = head.get("warc-type", "unknown").lower()
    found = dict.fromkeys(("payload_bytes", "payload_digest", "payload"))
    if kind in ("response", "revisit"):
        reply, sep, payload = block.partition(b"\r\n\r\n")
        http = block[:5].upper() == b"HTTP/"
        if not http:
            reply, payload = b"", block
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", reply)
        if kind == "revisit":
            found |= {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        else:
            if http and not sep:
                raise ValueError("no reply header")
            plain = unchunked(payload) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", reply) else None
            if stated_digest_differs(head.get("warc-payload-digest"), payload, *([] if plain is None else [plain])):
                raise ValueError("payload digest differs")
            payload = payload if plain is None else plain
            found |= {"payload_bytes": len(payload), "payload_digest": digest(payload), "payload": payload}
    number = lambda k: int(head[k]) if re.fullmatch(r"-?\d+", head.get(k, "")) else None
    return {"page_id": number("x-page-id"), "url": head.get("warc-target-uri"), **found, "record_type": kind, "refers_to": number("x-refers-to-page-id")}, end


def _at(source: Source, at: int) -> tuple[list[dict], str | None, int]:
    """(the records that start at ``at``, plain or in one gzip member; why others in it were lost; where they end)."""
    if source.read(at, len(_GZIP)) != _GZIP:
        found, end = parsed(source, at)
        return [found], None, end
    unpacker = zlib.decompressobj(31)
    plain, size, pos = [], 0, at
    while not unpacker.eof:
        part = source.read(pos, _WINDOW)
        if not part:
            raise ValueError("member cut short")
        pos += len(part)
        while part and not unpacker.eof:
            plain.append(unpacker.decompress(part, 16 * _WINDOW))
            part = unpacker.unconsumed_tail
            size += len(plain[-1])
            if size > MAX_RECORD_BYTES:
                raise ValueError("too long")
    records, reason = [], None
    for kind, _, _, what in salvage(b"".join(plain)):
        if kind == "record":
            records.append(what)
        else:
            reason = reason or what
    if not records:
        raise ValueError(reason or "an empty member")
    return records, reason, pos - len(unpacker.unused_data)


def salvage(data) -> Iterator[tuple[str, int, int, object]]:
    """("record", from, to, fields) and ("gap", from, to, reason) in the order of ``data`` (bytes or an open file), which they cover together.

    Records of one member share its range; what is lost inside a member that is whole otherwise is a gap of that range.
    """
    source = Source(data)
    at, gap, reason = 0, None, ""
    while at < source.size:
        try:
            records, lost, end = _at(source, at)
        except (ValueError, zlib.error) as failed:
            if gap is None:
                gap, reason = at, str(failed)
            at = source.search(at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        for found in records:
            yield "record", at, end, found
        if lost is not None:
            yield "gap", at, end, lost
        at = end
    if gap is not None:
        yield "gap", gap, source.size, reason


def arrow_uri(uri: str) -> str:
    scheme, sep, rest = uri.partition("://")
    return _SCHEMES.get(scheme, scheme) + sep + rest if sep else uri


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0, max_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes the pages as ``*.warc.gz`` files below ``path`` (a URI all executors reach); returns (file, size, records).

    Each attempt of a task writes files of its own names, and only those of the
    attempt that succeeded are listed: a lost executor leaves nothing wrong behind.
    Payloads are not shuffled as long as the list of revisits is short.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("n"))
    same = rows.filter(F.col("n") >= min_payload).groupBy("sha1", "n").agg(F.count("*").alias("k"), F.max("page_id").alias("first"))
    same = pinned(same.filter("k > 1 and first is not null").select(F.col("sha1").alias("__sha1"), F.col("n").alias("__n"), "first"))
    marked = rows.join(small_side(same), same_key([F.col("sha1"), F.col("n")], [F.col("__sha1"), F.col("__n")]), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, folder = _place(path)
        place.create_dir(folder, recursive=True)
        name, out, size, count, done = "", None, 0, 0, []
        try:
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                    if out is None:
                        name, size, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = place.open_output_stream(f"{folder}/{name}")
                    size += out.write(member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())))
                    count += 1
                    if size >= max_bytes:
                        out.close()
                        done.append((name, size, count))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, size, count))
        yield pa.record_batch([pa.array([f"{path}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["file", "size", "records"])

    listed = marked.select("page_id", "url", "payload", refers.alias("refers_to"))
    return pinned(listed.mapInArrow(written, "file string, size bigint, records bigint"))


def read_archives(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of the listed files (column ``file``): kind, file, from, to, reason and the record's fields."""
    fields = [
        ("kind", pa.string()), ("file", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if keep_payload else []),
    ]
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                place, name = _place(file)
                rows, size = [], 0
                with place.open_input_file(name) as opened:
                    for kind, begin, end, what in salvage(opened):
                        row = {"kind": kind, "file": file, "from": begin, "to": end} | ({"reason": what} if kind == "gap" else what)
                        if not keep_payload:
                            row.pop("payload", None)
                        rows.append(row)
                        size += len(row.get("payload") or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"string": "string", "int64": "bigint", "binary": "binary"}
    ddl = ", ".join(f"`{n}` {kinds[str(t)]}" for n, t in fields)
    return files.select("file").mapInArrow(read, ddl)


def archived(pages: DataFrame) -> DataFrame:
    """The pages after a trip through archives in the shared folder: what ``read_archives`` recovers."""
    files = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    read = pinned(read_archives(files, keep_payload=False))
    written = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    told = {r["kind"]: r["n"] for r in read.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if told.get("record", 0) != written or told.get("gap", 0):
        raise ValueError(f"of {written} records {told.get('record', 0)} came back, with {told.get('gap', 0)} gaps")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
