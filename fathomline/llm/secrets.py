"""Secrets in texts: base patterns, and encoded keys and signed tokens that are decoded and parsed before they are told.

Kinds, in the order in which equal starts are listed: ``assign`` (a name like password, a separator
and a value), ``access`` (an access key id), ``hex`` (a long run of lower-case hex digits), then the
structurally confirmed ``pem`` (a private-key block), ``key`` (a base64 or hex run that decodes to a
private key) and ``jwt`` (a signed token).  A run that merely looks encoded isn't told: DER must
nest exactly, length by length, and have a private key's shape; OpenSSH keys must close length by
length; a token's header and claims must be JSON objects and the header must name an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import slices, text_of

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")

KINDS = ("assign", "access", "hex", "pem", "key", "jwt")
BASE = KINDS[:3]
#: Shortest run of base64 or hex characters that is decoded; the smallest private keys take 64.
CANDIDATE_LEAST = 40

_RUN = re.compile(r"[0-9A-Za-z+/_-]{16,}={0,2}")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
_PEM_LINE = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.-]*")
#: Line ends as JSON and env files spell them.
_ESCAPED_END = re.compile(r"(?:\\r)?\\n")
#: The ciphers of encrypted blocks and their block sizes in bytes.
CIPHERS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
_DEK = re.compile(r"DEK-Info:[ \t]*([A-Z0-9-]+)[ \t]*,[ \t]*([0-9A-Fa-f]+)[ \t]*$", re.M)
#: A long base64 line and what follows it on the next lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2})+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: A JSON object's first byte makes the first base64 character e and narrows the second.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[w-z0-9_-][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def decode_base64(run: str) -> bytes | None:
    """Standard or URL alphabet, padded or not; None where bits don't come out even."""
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_children(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER values; None unless lengths are minimal and end exactly at the data's end."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if tag & 0x1F == 0x1F:
            return None
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        found.append((tag, data[at : at + length]))
        at += length
    return found


def _inner(value: tuple[int, bytes], tag: int) -> list[tuple[int, bytes]]:
    return (der_children(value[1]) or []) if value[0] == tag else []


def der_private_key(data: bytes) -> str | None:
    """Which private key encoding this is, if one."""
    outer = der_children(data)
    if not outer or len(outer) != 1:
        return None
    fields = _inner(outer[0], _SEQUENCE)
    tags = [t for t, _ in fields]
    if len(fields) >= 9 and tags[:9] == [_INTEGER] * 9 and len(fields[1][1]) >= 32 and fields[0][1] in (b"\0", b"\1"):
        return "rsa"
    if tags == [_INTEGER] * 6 and fields[0][1] == b"\0" and len(fields[1][1]) >= 32:
        return "dsa"
    if tags[:2] == [_INTEGER, _OCTETS] and fields[0][1] == b"\1" and 16 <= len(fields[1][1]) <= 80 and all(t in (0xA0, 0xA1) and der_children(v) for t, v in fields[2:]):
        return "ec"
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and fields[0][1] in (b"\0", b"\1"):
        algorithm = _inner(fields[1], _SEQUENCE)
        return "pkcs8" if algorithm and algorithm[0][0] == _OID and (der_children(fields[2][1]) or len(fields[2][1]) >= 32) else None
    if tags == [_SEQUENCE, _OCTETS] and len(fields[1][1]) >= 32:
        algorithm = _inner(fields[0], _SEQUENCE)
        return "encrypted pkcs8" if len(algorithm) == 2 and algorithm[0][0] == _OID and algorithm[1][0] == _SEQUENCE and der_children(algorithm[1][1]) else None
    return None


def _wire_strings(data: bytes, n: int) -> tuple[list[bytes], int] | None:
    """n strings, each after its four-byte length, and where they end."""
    found, at = [], 0
    for _ in range(n):
        if at + 4 > len(data):
            return None
        length, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at + length > len(data):
            return None
        found.append(data[at : at + length])
        at += length
    return found, at


def openssh_private_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    rest = data[len(magic) :]
    if not (head := _wire_strings(rest, 3)):
        return False
    at = head[1]
    count, body = int.from_bytes(rest[at : at + 4], "big"), rest[at + 4 :]
    parts = _wire_strings(body, count + 1) if 1 <= count <= 64 else None
    return bool(parts) and parts[1] == len(body) and all(_wire_strings(p, 1) for p in parts[0][:-1])


def is_private_key(data: bytes | None) -> bool:
    return data is not None and (der_private_key(data) is not None or openssh_private_key(data))


def is_signed_token(token: str) -> bool:
    header, claims, signature = token.split(".")
    try:
        head, body = (json.loads(decode_base64(part) or b"") for part in (header, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and (decode_base64(signature) is not None) and bool(signature or head["alg"].lower() == "none")


def is_pem_key(body: str) -> bool:
    """Whether what stands between a block's lines is a private key, or one encrypted the old way: cipher, its start value and whole cipher blocks."""
    if "\\" in body:
        body = _ESCAPED_END.sub("\n", body)
    if not _PEM_BODY.fullmatch(body):
        return False
    lines = body.split("\n")
    data = decode_base64("".join("".join(x for x in lines if ":" not in x).split()))
    if is_private_key(data):
        return True
    info = _DEK.search(body)
    size = CIPHERS.get(info[1]) if info and "Proc-Type: 4,ENCRYPTED" in body else None
    return bool(size and data) and len(info[2]) == 2 * size and len(data) >= 32 and len(data) % size == 0


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of confirmed blocks: an end line and the begin line right before it, of one label; linear in the text."""
    found, last = [], None
    for m in _PEM_LINE.finditer(text):
        if m[1] == "BEGIN":
            last = m
        else:
            if last and last[2] == m[2] and is_pem_key(text[last.end() : m.start()]):
                found.append((last.start(), m.end()))
            last = None
    return found


def wrapped_keys(text: str) -> list[tuple[int, int]]:
    """Start and end of private keys in base64 over several lines: equally long ones, the last one shorter or as long."""
    found = []
    for m in _WRAPPED.finditer(text):
        lines = list(_LINE.finditer(text, m.start(), m.end()))
        width, n = len(lines[0].group()), 1
        while n < len(lines) and len(lines[n].group()) == width:
            n += 1
        n += n < len(lines) and len(lines[n].group()) < width
        if n > 1 and is_private_key(decode_base64("".join(x.group() for x in lines[:n]))):
            found.append((m.start(), lines[n - 1].end()))
    return found


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every secret, in order; code points, end exclusive."""
    found: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for run in _RUN.finditer(text):
        at, body = run.start(), run.group()
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(body)]
        if len(body) >= CANDIDATE_LEAST:
            if is_private_key(decode_base64(body)):
                found.append((at, 4, at + len(body)))
            else:
                found += [(at + m.start(), 4, at + m.end()) for m in _HEX_RUN.finditer(body) if len(m.group()) % 2 == 0 and is_private_key(bytes.fromhex(m.group()))]
    blocks = pem_blocks(text) if "-----END " in text else []
    found += [(start, 3, end) for start, end in blocks]
    if "\n" in text:
        found += [(start, 4, end) for start, end in wrapped_keys(text) if not any(a < end and start < b for a, b in blocks)]
    if "." in text:
        found += [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m.group())]
    return sorted(found)


SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of every document's secrets, whole texts, in reading order.

    Null text is empty and has none; a null or repeated doc_id and repeated rows each keep their
    row; texts of any length are searched whole, in time linear in it; an empty table gives no rows;
    other columns are ignored, whatever their names.  No shuffle.
    """

    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every span, joined where they overlap, replaced by a mark."""
    parts, at = [], 0
    for start, _, end in find(text):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts, the base spans' digest and all spans as text, from ``scan_secrets``."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
