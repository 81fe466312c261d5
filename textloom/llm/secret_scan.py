"""Secret scans: pattern candidates, and structures that decoding confirms.

Base patterns find assignments of secrets, access keys and long hex runs. The structural kinds are reported only when
what they claim to be can be parsed:

* `token`: three base64url parts, the first a JSON object with an algorithm, the second a JSON value (a signed token);
* `key`: base64 or hex that decodes to one DER structure whose nested lengths all add up and which is a private key
  (PKCS#1, PKCS#8, SEC 1) or an OpenSSH private key container, PEM armour around it or not;
* `public`: the same for public keys and certificates (DER) and SSH wire-format public keys.

Base64 may be wrapped over lines and its line breaks may be escaped as in JSON; one line may also use the URL-safe alphabet. A
run of such characters is looked at from every place at which a structure can begin, and again behind each one found: other
characters may stand before it and, since DER tells its length, after it. What decodes to PEM text or to a signed token is read once more.

Null and empty texts have no spans, repeated rows have the same, an empty table gives an empty result, and columns other than
the id and the text play no part. Spans are code points, end exclusive. Overlaps between kinds all stay; within a kind
spans are leftmost and disjoint. One narrow pass, whole texts, no state between rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import strings


class Span(NamedTuple):
    kind: str
    start: int
    end: int


#: Fixed values of the contract: the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: What every assignment has.
WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "key", "public")
#: Candidates of the structural kinds.
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----([^-]+)-----END \1-----")
BREAK = r"(?:\\r)?\\n|\r?\n[ \t]*"
BASE64 = re.compile(rf"[A-Za-z0-9+/]{{40,}}(?:(?:{BREAK})[A-Za-z0-9+/]+)*={{0,2}}")
BREAKS = re.compile(BREAK)
#: The URL-safe alphabet, on one line and with one of its own characters.
URL64 = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{40,}")
ANYHEX = re.compile(r"[0-9A-Fa-f]{48,}")
#: How base64 of a DER sequence, an OpenSSH container, an SSH wire key, PEM text and a token's header begin; and hex of the first three.
STARTS64, STARTS16 = re.compile(r"M[A-P]|b3BlbnNzaC1r|AAAA[BCE]|LS0tLS1CRUdJ|ZX[lk]"), re.compile(r"30|6f70656e7373682d|000000(?:07|0b|13)", re.I)
#: Characters that may stand before a token's header in a line, or before an SSH key in hex.
STRAY = 4
#: Object identifiers of key algorithms, DER encoded.
ALGORITHMS = {
    bytes.fromhex("2a864886f70d010101"): "rsa",
    bytes.fromhex("2a8648ce3d0201"): "ec",
    bytes.fromhex("2a8648ce380401"): "dsa",
    bytes.fromhex("2b6570"): "ed25519",
    bytes.fromhex("2b656e"): "x25519",
    bytes.fromhex("2b6571"): "ed448",
}
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # PKCS#5 and PKCS#12 schemes
#: Names of SSH keys, and the strings that each is made of.
SSH_KINDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
OPENSSH = b"openssh-key-v1\0"


class Node(NamedTuple):
    tag: int
    body: bytes
    parts: list


def der(data: bytes, depth: int = 0) -> list[Node] | None:
    """The values that make up data exactly, constructed ones parsed as well; None if a length doesn't add up."""
    out, p = [], 0
    while p < len(data):
        if p + 2 > len(data) or depth > 12:
            return None
        tag, n = data[p], data[p + 1]
        p += 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or p + wide > len(data):
                return None
            n = int.from_bytes(data[p : p + wide], "big")
            if n < 0x80 or n >> 8 * (wide - 1) == 0:  # not the shortest form
                return None
            p += wide
        if p + n > len(data):
            return None
        body, parts = data[p : p + n], []
        if tag & 0x20:
            inner = der(body, depth + 1)
            if inner is None:
                return None
            parts = inner
        elif tag == 0x02 and (not n or n > 1 and (body[0] == 0 and body[1] < 0x80 or body[0] == 0xFF and body[1] >= 0x80)):
            return None
        out.append(Node(tag, body, parts))
        p += n
    return out


def der_kind(data: bytes) -> str:
    """`key` or `public` if data is such a structure, whole."""
    if len(data) < 24 or data[0] != 0x30:
        return ""
    top = der(data)
    if not top or len(top) != 1 or top[0].tag != 0x30:
        return ""
    parts = top[0].parts
    tags = [x.tag for x in parts]
    algorithm = lambda n: bool(n.parts) and n.parts[0].tag == 0x06 and n.parts[0].body in ALGORITHMS
    if tags[:3] == [0x02, 0x30, 0x04] and parts[0].body in (b"\0", b"\1") and algorithm(parts[1]):
        return "key"  # PKCS#8
    if len(tags) in (9, 10) and set(tags[:9]) == {0x02} and parts[0].body in (b"\0", b"\1"):
        return "key"  # PKCS#1
    if tags[:2] == [0x02, 0x04] and parts[0].body == b"\1" and len(parts[1].body) in (28, 32, 48, 66) and set(tags[2:]) <= {0xA0, 0xA1}:
        return "key"  # SEC 1
    if len(tags) == 6 and set(tags) == {0x02} and parts[0].body == b"\0":
        return "key"  # DSA
    if tags == [0x30, 0x04] and parts[0].parts and parts[0].parts[0].tag == 0x06 and parts[0].parts[0].body.startswith(ENCRYPTION):
        return "key"  # PKCS#8, encrypted
    if tags == [0x30, 0x03] and algorithm(parts[0]):
        return "public"
    if tags == [0x02, 0x02] and len(parts[0].body) >= 64 and len(parts[1].body) <= 8:
        return "public"  # PKCS#1 public key
    if tags == [0x30, 0x30, 0x03] and len(parts[0].parts) >= 6:
        return "public"  # certificate
    return ""


def wire(data: bytes) -> list[bytes] | None:
    """Length-prefixed strings that make up data exactly."""
    out, p = [], 0
    while p < len(data):
        n = int.from_bytes(data[p : p + 4], "big")
        if p + 4 + n > len(data):
            return None
        out.append(data[p + 4 : p + 4 + n])
        p += 4 + n
    return out


def ssh_kind(data: bytes) -> str:
    if data.startswith(OPENSSH):
        p, fields = len(OPENSSH), []
        for _ in range(3):
            n = int.from_bytes(data[p : p + 4], "big")
            if p + 4 + n > len(data):
                return ""
            fields.append(data[p + 4 : p + 4 + n])
            p += 4 + n
        return "key" if fields[0] and int.from_bytes(data[p : p + 4], "big") and wire(data[p + 4 :]) else ""
    if data[:4] in (b"\0\0\0\7", b"\0\0\0\x0b", b"\0\0\0\x13"):
        parts = wire(data)
        return "public" if parts and parts[0] in SSH_KINDS and len(parts) >= 2 and all(parts) else ""
    return ""


def decoded(text: str) -> bytes:
    """Base64, standard alphabet, padding made good; empty if it can't be."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return b""
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def binary_kind(data: bytes) -> str:
    return der_kind(data) or ssh_kind(data)


def whole_length(data: bytes) -> int:
    """Bytes of the DER value with which data begins, 0 if it begins with none."""
    if len(data) < 2 or data[0] != 0x30:
        return 0
    n = data[1]
    if n < 0x80:
        return 2 + n
    wide = n & 0x7F
    return 2 + wide + int.from_bytes(data[2 : 2 + wide], "big") if 1 <= wide <= 4 and len(data) > 2 + wide else 0


def armoured_kind(text: str) -> tuple[str, int, int]:
    """Kind and place of the first armoured structure that is confirmed."""
    for m in PEM.finditer(text):
        if kind := binary_kind(decoded("".join(BREAKS.sub("", m[2]).split()))):
            return kind, *m.span()
    return "", 0, 0


def inner_kind(data: bytes) -> str:
    """The kind of decoded text that is itself armour or a signed token."""
    if not data.isascii():
        return ""
    text = data.decode("ascii")
    if "-----BEGIN " in text:
        return armoured_kind(text)[0]
    return "token" if TOKEN.fullmatch(text.strip()) and signed(text.strip()) else ""


def ssh_length(plain: str, shift: int) -> int:
    """Bytes of the SSH key that begins at a place of base64 text, told by its own lengths; 0 if there is none."""
    name = decoded(plain[shift : shift + 32])[4:]
    fields = next((n for k, n in SSH_KINDS.items() if name.startswith(k)), 0)
    size = 0
    for _ in range(fields):
        at = shift + size // 3 * 4
        head = decoded(plain[at : at + 8])[size % 3 : size % 3 + 4]
        n = int.from_bytes(head, "big")
        if len(head) < 4 or not 0 < n <= 1 << 14:
            return 0
        size += 4 + n
    return size


def begun(plain: str, shift: int, stops: list[int], fresh: bool, tried: set[tuple[int, int]]) -> tuple[str, int]:
    """Kind and end of the structure that begins at a place of base64 text, whose lines end at `stops`.

    A DER value and an SSH key tell their own length. The others last to the end of their line or of the text. fresh: whether a line begins
    about here, as a token's header must.
    """
    head = decoded(plain[shift : shift + 8])
    if head[:1] == b"0" or head[:3] == b"\0\0\0":
        size = whole_length(head) or ssh_length(plain, shift)
        end = shift + -(-size * 4 // 3)
        if size < 24 or end > len(plain):
            return "", 0
        kind = binary_kind(decoded(plain[shift:end])[:size])
        while kind and end < len(plain) and plain[end] == "=":
            end += 1
        return kind, end
    for stop in dict.fromkeys((next(x for x in stops if x > shift), len(plain))):
        if (shift % 4, stop) in tried:
            continue
        body = plain[shift:stop].rstrip("=")
        data = decoded(body[: len(body) - (len(body) % 4 == 1)])
        if kind := ssh_kind(data) or (inner_kind(data) if fresh or head.startswith(b"-----") else ""):
            return kind, stop
        tried.add((shift % 4, stop))
    return "", 0


def in_base64(text: str, at: int) -> list[Span]:
    """All structures in a base64 candidate that begins at a place of its document: at every beginning, one after the other."""
    breaks = list(BREAKS.finditer(text))
    places = np.concatenate([np.arange(a, b) for a, b in zip([0, *(m.end() for m in breaks)], [*(m.start() for m in breaks), len(text)], strict=True)])
    plain = BREAKS.sub("", text).replace("-", "+").replace("_", "/")
    stops = sorted({*np.searchsorted(places, [m.start() for m in breaks]).tolist(), len(plain)})
    starts = [0, *stops[:-1]]
    out: list[Span] = []
    tried: set[tuple[int, int]] = set()
    k = line = 0
    while m := STARTS64.search(plain, k):
        shift = m.start()
        while line + 1 < len(starts) and starts[line + 1] <= shift:
            line += 1
        kind, end = begun(plain, shift, stops[line:], shift - starts[line] <= STRAY, tried)
        k = end if kind else shift + 1
        if kind:
            out.append(Span(kind, at + int(places[shift]), at + int(places[end - 1]) + 1))
    return out


def in_hex(text: str, at: int) -> list[Span]:
    """All structures in a hex candidate, at every beginning."""
    out: list[Span] = []
    k = 0
    while m := STARTS16.search(text, k):
        shift, kind = m.start(), ""
        head = bytes.fromhex(text[shift : shift + 12])
        size = whole_length(head)
        if head[0] == 0x30:
            if 24 <= size and shift + 2 * size <= len(text):
                kind = der_kind(bytes.fromhex(text[shift : shift + 2 * size]))
        elif shift <= STRAY:
            size = (len(text) - shift) // 2
            kind = ssh_kind(bytes.fromhex(text[shift : shift + 2 * size]))
        if kind:
            out.append(Span(kind, at + shift, at + shift + 2 * size))
        k = shift + 2 * size if kind else shift + 1
    return out


def signed(candidate: str) -> bool:
    """A signed token: header and payload decode to JSON, and the header names an algorithm."""
    head, body, _ = candidate.split(".")
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    except (ValueError, RecursionError):
        return False
    return True


def base_spans(text: str) -> list[Span]:
    found, low = [], text.lower()
    if any(word in low for word in WORDS):
        found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def structural_spans(text: str) -> list[Span]:
    out: list[Span] = []
    armoured: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if kind := armoured_kind(m[0])[0]:
                out.append(Span(kind, *m.span()))
                armoured.append(m.span())
    inside = lambda m: any(a <= m.start() and m.end() <= b for a, b in armoured)
    if "ey" in text or "ew" in text:
        out += [Span("token", *m.span()) for m in TOKEN.finditer(text) if m[0].startswith("e") and signed(m[0])]
    for pattern, look in ((BASE64, in_base64), (URL64, in_base64), (ANYHEX, in_hex)):
        for m in pattern.finditer(text):
            if not inside(m):
                out += look(m[0], m.start())
    return out


RANK = {k: n for n, k in enumerate(KINDS)}


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, RANK[s.kind], s.end)))


def scan(text: str) -> list[Span]:
    """All spans of a text, by start, then kind."""
    return sorted({*base_spans(text), *structural_spans(text)}, key=lambda s: (s.start, RANK[s.kind], s.end))


def find_secrets(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `found`, an array of kind, start, end, for every row."""
    row = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[s._asdict() for s in scan(x)] for x in strings(batch.column(1))], row)], ["doc_id", "found"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(look, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts, the hash of base spans and all spans as text."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias("n_" + k)
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", label), ",").alias("spans"))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])

