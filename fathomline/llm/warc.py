"""WARC archives: a writer that deduplicates payloads, and a reader that salvages.

The reader checks every record (gzip member and its checksum, version line, lengths, closing lines,
block and payload digests).  After a failed check it doesn't stop: it searches on for the next gzip
member that holds a version line, or the next version line of an uncompressed archive, carries on
there, and logs the bytes between as a quarantined gap.  A member may hold several records; those
before and after a broken one are read, and the member's place is logged.  Files are read through positioned reads of
a few megabytes, whatever their size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fan_out, file_system, materialise, put_file, slices, work_dir

CHUNK = 1 << 20
#: Bytes of a member that are unpacked at once, and of a record in which its head must end.
PORTION, HEAD = 64 << 10, 64 << 10
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
#: A version line, or what there is of it at the end of the data.
VERSION_START = re.compile(rb"WARC/1\.[01]\r?\n|(?:W|WA|WAR|WARC|WARC/|WARC/1|WARC/1\.|WARC/1\.[01]\r?)\Z")
#: Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are stored each time.
REVISIT_BYTES = 100
FILE_BYTES = 64 << 20


def _sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One uncompressed record.  A revisit holds the HTTP head alone, which still tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {_sha256(block)}", f"WARC-Payload-Digest: {_sha256(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers and body of an HTTP block."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _headers(head.split(b"\r\n")[1:]), body

    @property
    def payload(self) -> bytes:
        return self.http()[1] if self.headers.get("content-type", "").startswith("application/http") else self.block


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Salvage:
    """What a pass over one archive has met: records go out one by one, gaps stay here."""

    gaps: list[Gap] = field(default_factory=list)


class Broken(ValueError):
    """A record that fails a check."""


def _headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Broken("a header line without a name")
        found[name.strip().decode("latin1").lower()] = value.strip().decode("utf-8", "replace")
    return found


def _digest_holds(said: str, data: bytes) -> bool:
    """Whether a labelled digest fits; labels that can't be computed here are not checked."""
    label, _, value = said.partition(":")
    if label.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(label.lower(), data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def check(record: Record) -> Record:
    if said := record.headers.get("warc-block-digest"):
        if not _digest_holds(said, record.block):
            raise Broken("block digest")
    if record.kind != "revisit" and (said := record.headers.get("warc-payload-digest")) and not _digest_holds(said, record.payload):
        raise Broken("payload digest")
    return record


def _head(data: bytes) -> tuple[dict[str, str], int, int]:
    """Headers, length of the head, and length of the block, of a record's first bytes."""
    if not (version := VERSION.match(data)):
        raise Broken("no version line")
    end, skip = data.find(b"\r\n\r\n"), 4
    if end < 0:
        raise Broken("headers don't end")
    headers = _headers(data[version.end() : end].split(b"\r\n")) if end > version.end() else {}
    if not re.fullmatch(r"\d{1,15}", headers.get("content-length", "")):
        raise Broken("no content length")
    return headers, end + skip, int(headers["content-length"])


def split_records(data: bytes, whole: bool) -> tuple[list[Record], bytes, str]:
    """Records off the front of a member's data, what is left of it, and why something was skipped; ``whole``: nothing follows."""
    found, at, damage = [], 0, ""
    while at < len(data):
        try:
            headers, start, length = _head(data[at : at + HEAD])
        except Broken as broken:
            if not whole and len(data) - at < HEAD and VERSION_START.match(data, at):
                break  # the head may still come
            damage, at = damage or str(broken), _next_version(data, at + 1, whole)
            continue
        end = at + start + length
        if len(data) < end + 4 and not whole:
            break
        if data[end : end + 4] == b"\r\n\r\n":
            try:
                found.append(check(Record(headers, data[end - length : end])))
            except Broken as broken:
                damage = damage or str(broken)
            at = end + 4
        else:
            damage = damage or ("block shorter than its length" if len(data) < end + 4 else "record doesn't close after its length")
            at = _next_version(data, at + 1, whole)
    return found, data[at:], damage


def _next_version(data: bytes, at: int, whole: bool) -> int:
    """Where the next version line starts, or may start with what is still to come."""
    found = VERSION.search(data, at)
    return found.start() if found else len(data) if whole else max(at, len(data) - 10)


class ArchiveReader:
    """Records of one archive, compressed by member or plain, in order; see the module's text for what happens to damage."""

    def __init__(self, file, salvage: Salvage | None = None):
        self.file, self.size = file, file.size()
        self.salvage = salvage if salvage is not None else Salvage()
        self.after = 0

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(max(0, min(n, self.size - offset)))

    def _opening(self, offset: int) -> bytes:
        """As much of a member's data as shows a version line."""
        unpack, data, at = zlib.decompressobj(31), b"", offset
        while len(data) < 10 and not unpack.eof:
            if not (chunk := self._at(at, 512)):
                raise Broken("member is cut off")
            try:
                data += unpack.decompress(chunk, 16)
            except zlib.error as error:
                raise Broken(f"member: {str(error)[:60]}") from None
            at += len(chunk)
        return data

    def _member(self, offset: int) -> Iterator[Record]:
        """The records of a member, usually one; ``self.after`` is then the offset after it.

        A record goes out once the next one has been read or the member's checksum holds.  Damage in
        a sound member is searched for the next version line, and logged with the member's place.
        """
        unpack, data, at, held, damage = zlib.decompressobj(31), b"", offset, None, ""
        while not unpack.eof:
            if not (portion := self._at(at, PORTION)):
                raise Broken("member is cut off")
            try:
                data += unpack.decompress(portion)
            except zlib.error as error:
                raise Broken(f"member: {str(error)[:60]}") from None
            at += len(portion)
            found, data, broken = split_records(data, unpack.eof)
            damage = damage or broken
            for record in found:
                if held:
                    yield held
                held = record
        self.after = at - len(unpack.unused_data)
        if not held:
            raise Broken(damage or "no record")
        yield held
        if damage:
            self.salvage.gaps.append(Gap(offset, self.after, f"within a member: {damage}"))

    def _plain(self, offset: int) -> tuple[Record, int]:
        data = self._at(offset, HEAD)
        headers, at, length = _head(data)
        end = offset + at + length
        if end + 4 > self.size or self._at(end, 4) != b"\r\n\r\n":
            raise Broken("record doesn't close after its length")
        return check(Record(headers, self._at(offset + at, length))), end + 4

    def _valid_start(self, offset: int) -> bool:
        try:
            if self._at(offset, 3) != GZIP:
                return bool(_head(self._at(offset, HEAD)))
            return bool(VERSION.match(self._opening(offset)))
        except Broken:
            return False

    def _next_start(self, offset: int) -> int:
        """The next offset with a member that opens with a version line, or a version line that a whole head follows."""
        while offset < self.size:
            window = self._at(offset, CHUNK + 16)
            for found in re.finditer(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n", window):
                at = offset + found.start()
                if found.start() >= CHUNK:
                    break
                if self._valid_start(at):
                    return at
            offset += CHUNK
        return self.size

    def __iter__(self) -> Iterator[tuple[int, Record]]:
        offset = 0
        while offset < self.size:
            try:
                if self._at(offset, 3) == GZIP:
                    for record in self._member(offset):
                        yield offset, record
                    offset = self.after
                else:
                    record, after = self._plain(offset)
                    yield offset, record
                    offset = after
            except Broken as broken:
                start, offset = offset, self._next_start(offset + 1)
                if self.salvage.gaps and self.salvage.gaps[-1].end == start:
                    self.salvage.gaps[-1].end = offset
                else:
                    self.salvage.gaps.append(Gap(start, offset, str(broken)))


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def plan_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, html, first_id: first_id is the page whose record holds the payload, null where the own record does.

    The least page_id of each payload is aggregated before the shuffle; only payloads that occur
    twice are joined, and a payload that a third of all pages share is dealt over salts.  Payloads
    too small to be referred to get a key of their own row, so that they spread over all tasks.
    """
    salts = 16
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha2(F.encode("html", "UTF-8"), 256))
    keyed = own.withColumn("digest", digest).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    firsts = keyed.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own_key = F.xxhash64("page_id", "url", "html").cast("string")
    keyed = keyed.withColumn("digest", F.coalesce("digest", own_key))
    return keyed.join(salted, ["digest", "salt"], "left").select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")).alias("first_id"))


def write_archives(planned: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write .warc.gz files of about ``file_bytes`` and give their manifest: path, records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        rows = (r for b in slices(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            name = f"{folder}/part-{task:06d}-{number:05d}.warc.gz"
            fs, path = file_system(name)
            told = [0, 0]

            def fill(out, told=told):
                nonlocal row
                while row is not None and told[1] < file_bytes:
                    page, url, html, first = row
                    kind = "response" if first is None else "revisit"
                    member = gzip_member(record_bytes(kind, page_urn(page), quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._"), html.encode(), page_urn(first)))
                    out.write(member)
                    told[0] += 1
                    told[1] += len(member)
                    row = next(rows, None)

            put_file(fs, path, fill)
            number += 1
            yield pa.RecordBatch.from_pylist([{"path": name, "records": told[0], "bytes": told[1]}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialise(planned.select("page_id", "url", "html", "first_id").mapInArrow(write, "path string, records long, bytes long"), f"{folder}/manifest")


RECORD_SCHEMA = "path string, offset long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, gap_start long, gap_end long, gap_reason string"


def read_archives(paths: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Every record of the archives named in ``path``, and a row with gap_start, gap_end and gap_reason for each quarantined gap.

    payload_digest is the bare hex SHA-256: of the payload read, or for a revisit the one its
    record names; payload_bytes likewise.  Gap rows have nulls in the record's columns.
    """
    empty = dict.fromkeys(("offset", "record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload", "gap_start", "gap_end", "gap_reason"))
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string())])

    def row_of(path: str, offset: int, record: Record) -> dict:
        said = record.headers.get("warc-payload-digest", "")
        if record.kind == "revisit":
            length = record.http()[0].get("content-length", "") if record.block else ""
            n, digest = (int(length) if length.isdigit() else None), said.partition(":")[2].lower() or None
        else:
            n, digest = len(record.payload), hashlib.sha256(record.payload).hexdigest()
        refers = record.headers.get("warc-refers-to")
        return empty | {"path": path, "offset": offset, "record_type": record.kind, "record_id": record.headers.get("warc-record-id", "").strip("<>"), "target_uri": record.headers.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest, "refers_to": refers and refers.strip("<>"), "payload": record.payload if with_payload else None}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                salvage, rows, held = Salvage(), [], 0
                with fs.open_input_file(name) as file:
                    for offset, record in ArchiveReader(file, salvage):
                        rows.append(row_of(path, offset, record))
                        held += len(record.block) if with_payload else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                rows += [empty | {"path": path, "gap_start": g.start, "gap_end": g.end, "gap_reason": g.reason} for g in salvage.gaps]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return paths.select("path").repartition(fan_out(paths.sparkSession), "path").mapInArrow(read, RECORD_SCHEMA)


def archive_pages(pages: DataFrame, *, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for every page, read the archives back, and give a row a page.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to.  Null html is an empty
    payload; payloads under 100 bytes are always stored.  Among equal payloads those rows with the
    smallest page_id are responses (several, if the row is repeated) and the others revisits.  A
    null page_id is archived under an empty number, stays null and is never referred to unless no
    other page has its payload.  Payloads of any length are kept whole.  An empty table gives no files
    and no rows; other columns are ignored, whatever their names.  Should a file be damaged between writing and
    reading, this is an error that names file and place, as pages would be missing; ``read_archives``
    gives what can be read, and the gaps.
    """
    folder = work_dir(pages.sparkSession, "warc")
    manifest = write_archives(plan_revisits(pages, id_col=id_col, url_col=url_col, payload_col=payload_col), folder, file_bytes=file_bytes)
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    lost = F.concat_ws(" ", F.lit("damaged archive:"), "path", F.col("gap_start").cast("string"), F.col("gap_end").cast("string"), "gap_reason")
    sound = F.when(F.col("gap_reason").isNotNull(), F.raise_error(lost).cast("boolean")).otherwise(F.lit(True))
    return read_archives(manifest, with_payload=False).filter(sound).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))
