"""Media columns: what binary values really are, by signature sniffing and structural validation.

An Aho-Corasick automaton over all known signatures finds every place in a value where a format may begin. A validator
for that format then walks its structure (chunk lengths, checksums, block sizes, end markers) and either confirms it,
with its full length, or rejects the place. The format confirmed at byte 0 is the value's type, whatever was declared;
confirmed places elsewhere, outside a format already confirmed, are embedded media and can be carved; where asked for, so are
those within containers. Validators read a value in linear time: marks that several of them look for are found once.

Null or empty values have no type (`empty`) and no media; repeated rows are looked at each, an empty table gives an empty one,
and other columns pass by whatever their names, but for those that an operator adds, which are replaced. Bytes that no validator confirms are `text` if they are UTF-8
without control characters, else `unknown`. Work is one narrow pass; a value is held by one task at a time, never a group.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.base import strings


class Media(NamedTuple):
    kind: str
    start: int
    end: int


#: Media types by format name.
TYPES = {
    "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp",
    "avi": "video/x-msvideo", "zip": "application/zip", "gzip": "application/gzip", "pdf": "application/pdf", "mp4": "video/mp4",
    "flac": "audio/flac", "ogg": "audio/ogg", "pnm": "image/x-portable-anymap",
}


def png(b: bytes, at: int) -> int:
    """Chunks with right CRCs from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or first and n != 13:
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return 0


def gif(b: bytes, at: int) -> int:
    """Screen descriptor, then extensions and images made of counted blocks, then the trailer."""

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 if images else 0
        if b[p] == 0x21 and p + 2 < len(b):
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = blocks(p + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
            images += 1
        else:
            return 0
    return 0


def jpeg(b: bytes, at: int) -> int:
    """Marker segments with lengths up to a scan, then the end marker after entropy-coded data."""
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind in (0x00, 0x01, 0xD8) or 0xD0 <= kind <= 0xD7 or kind == 0xD9:
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            if not frame:
                return 0
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] == 0xD9:
                    return p + 2
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7 or b[p + 1] == 0xFF:
                    p += 1 if b[p + 1] == 0xFF else 2
                    continue
                break
    return 0


def bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, reserved, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if reserved or header not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    row = (width * depth + 31) // 32 * 4
    if offset < 14 + header or offset + row * abs(height) > size and not struct.unpack_from("<I", b, at + 30)[0]:
        return 0
    return at + size if at + size <= len(b) else 0


def riff(b: bytes, at: int) -> tuple[str, int]:
    """The form and end of a RIFF file whose chunks add up to its length."""
    if at + 12 > len(b):
        return "", 0
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, p, seen = at + 8 + size, at + 12, set()
    if end > len(b) or size < 4:
        return "", 0
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        if kind == b"fmt " and n >= 16:
            tag, channels, rate, bytes_s, align, bits = struct.unpack_from("<HHIIHH", b, p + 8)
            if tag == 1 and (align != channels * ((bits + 7) // 8) or bytes_s != rate * align):
                return "", 0
        seen.add(kind)
        p += 8 + n + n % 2
    if p != end:
        return "", 0
    if form == b"WAVE" and {b"fmt ", b"data"} <= seen:
        return "wav", end
    if form == b"WEBP" and seen & {b"VP8 ", b"VP8L", b"VP8X"}:
        return "webp", end
    return ("avi", end) if form == b"AVI " and b"LIST" in seen else ("", 0)


@lru_cache(maxsize=4)
def places(b: bytes, mark: bytes) -> list[int]:
    """Where a mark stands in a value; found once for all validators that ask."""
    return [m.start() for m in re.finditer(re.escape(mark), b)]


@lru_cache(maxsize=2)
def archives(b: bytes) -> dict[int, int]:
    """Start and end of each zip archive whose directory counts its entries: every directory tells where its archive began."""
    out = {}
    for p in places(b, b"PK\5\6"):
        if p + 22 <= len(b):
            entries, size, offset, note = struct.unpack_from("<HIIH", b, p + 10)
            at = p - size - offset
            if at >= 0 and p + 22 + note <= len(b) and (not entries or b[at + offset : at + offset + 4] == b"PK\1\2"):
                out.setdefault(at, p + 22 + note)
    return out


def archive(b: bytes, at: int) -> int:
    """A local header whose archive ends with a directory that counts its entries."""
    return 0 if at + 30 > len(b) or struct.unpack_from("<H", b, at + 4)[0] > 63 else archives(b).get(at, 0)


def gzip(b: bytes, at: int) -> int:
    """A member that inflates, with its CRC and length."""
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    inflate = zlib.decompressobj(31)
    p = at
    try:
        while p < len(b) and not inflate.eof:
            inflate.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(inflate.unused_data) if inflate.eof else 0


def pdf(b: bytes, at: int) -> int:
    """A header, and the last end mark before the next header: each update of a file adds one. A cross reference comes before it."""
    if not re.match(rb"%PDF-[12]\.\d[\r\n]", b[at : at + 10]):
        return 0
    heads, ends, tables = places(b, b"%PDF-"), places(b, b"%%EOF"), places(b, b"startxref")
    after = bisect_right(heads, at)
    limit = heads[after] if after < len(heads) else len(b)
    last = bisect_left(ends, limit) - 1
    if last < 0 or ends[last] < at:
        return 0
    table = bisect_right(tables, at)
    return ends[last] + 5 if table < len(tables) and tables[table] < ends[last] else 0


def mp4(b: bytes, at: int) -> int:
    """Boxes with lengths, ftyp first; a length of 1 has eight more bytes, one of 0 reaches to the end. The signature is four bytes into the file."""
    p, n = at, 0
    while p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if size == 1 and p + 16 <= len(b):
            size = struct.unpack_from(">Q", b, p + 8)[0]
            size = 0 if size < 16 else size
        elif size == 0 and n:
            size = len(b) - p
        if size < 8 or not kind.isalnum() or p + size > len(b):
            break
        p, n = p + size, n + 1
    return p if n > 1 else 0


def flac(b: bytes, at: int) -> int:
    """Metadata blocks, STREAMINFO first; audio frames reach to the end of the value."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        kind, n = b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind or n != 34) or kind > 6:
            return 0
        last, p, first = b[p] & 0x80, p + 4 + n, False
        if last:
            return len(b) if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else 0
    return 0


def ogg(b: bytes, at: int) -> int:
    """Pages with their segment tables, as far as they follow each other."""
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        n = b[p + 26]
        to = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if to > len(b):
            break
        p = to
    return p if p > at else 0


def pnm(b: bytes, at: int) -> int:
    """A binary gray or colour map whose header gives its length."""
    if not (m := re.compile(rb"P([56])\s+(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s").match(b, at)):
        return 0
    kind, width, height, most = (int(x) for x in m.groups())
    n = width * height * (3 if kind == 6 else 1) * (2 if most > 255 else 1)
    return m.end() + n if 0 < most < 65536 and n and m.end() + n <= len(b) else 0


#: Signature bytes, the format's validator and how far into the file the signature stands.
SIGNATURES: dict[bytes, tuple[str, Callable[[bytes, int], int], int]] = {
    b"\x89PNG\r\n\x1a\n": ("png", png, 0),
    b"GIF87a": ("gif", gif, 0),
    b"GIF89a": ("gif", gif, 0),
    b"\xff\xd8\xff": ("jpeg", jpeg, 0),
    b"BM": ("bmp", bmp, 0),
    b"PK\x03\x04": ("zip", archive, 0),
    b"\x1f\x8b\x08": ("gzip", gzip, 0),
    b"%PDF-": ("pdf", pdf, 0),
    b"ftyp": ("mp4", mp4, 4),
    b"fLaC": ("flac", flac, 0),
    b"OggS": ("ogg", ogg, 0),
    b"P5": ("pnm", pnm, 0),
    b"P6": ("pnm", pnm, 0),
    b"RIFF": ("riff", lambda b, at: 0, 0),
}

_found: list = []


def automaton():
    """The signatures' Aho-Corasick automaton over bytes as latin-1 characters."""
    if not _found:
        import ahocorasick

        a = ahocorasick.Automaton()
        for x in SIGNATURES:
            a.add_word(x.decode("latin-1"), x)
        a.make_automaton()
        _found.append(a)
    return _found[0]


def confirm(b: bytes, signature: bytes, at: int) -> Media | None:
    kind, valid, ahead = SIGNATURES[signature]
    start = at - ahead
    if start < 0:
        return None
    if kind == "riff":
        kind, end = riff(b, start)
    else:
        end = valid(b, start)
    return Media(kind, start, end) if end > start else None


def sniff(b: bytes) -> list[Media]:
    """All confirmed media, outermost only, by start."""
    out: list[Media] = []
    covered = 0
    for last, signature in automaton().iter(b.decode("latin-1")):
        at = last - len(signature) + 1
        if at - SIGNATURES[signature][2] >= covered and (m := confirm(b, signature, at)):
            out.append(m)
            covered = m.end
    return out


#: Formats that hold other files as they are.
CONTAINERS = ("zip", "pdf", "wav", "avi", "mp4", "ogg")


def nested(b: bytes) -> list[tuple[Media, int]]:
    """All confirmed media by start with their depth: those outside any other have 0, those within a container one more than it."""
    out: list[tuple[Media, int]] = []
    around: list[Media] = []
    for last, signature in automaton().iter(b.decode("latin-1")):
        at = last - len(signature) + 1
        start = at - SIGNATURES[signature][2]
        while around and around[-1].end <= start:
            around.pop()
        if around and (around[-1].kind not in CONTAINERS or start <= around[-1].start):
            continue
        if start >= 0 and (m := confirm(b, signature, at)) and (not around or m.end <= around[-1].end):
            out.append((m, len(around)))
            around.append(m)
    return out


CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")


def kind_of(b: bytes, found: list[Media]) -> str:
    """The type that the bytes show."""
    if not b:
        return "empty"
    if found and found[0].start == 0:
        return TYPES[found[0].kind]
    if CONTROL.search(b):
        return "unknown"
    try:
        b.decode()
    except UnicodeDecodeError:
        return "unknown"
    return "text/plain"


def wav(samples: bytes, rate: int = 16000) -> bytes:
    """Samples of one byte as a mono PCM file. Samples must be an even number of bytes."""
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def wav_samples(b: bytes, m: Media) -> bytes:
    """The data chunk of a confirmed file."""
    p = m.start + 12
    while p + 8 <= m.end:
        kind, n = struct.unpack_from("<4sI", b, p)
        if kind == b"data":
            return b[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    return b""


def inspect(df: DataFrame, data: str, declared: str | None = None, prefix: str = "media_", deep: bool = False) -> DataFrame:
    """df with `<prefix>type` (what the bytes show), `<prefix>corrected` (it differs from `declared`) and `<prefix>found`
    (kind, start and end of every confirmed medium, embedded ones included). Existing columns of those names are replaced. deep: media within containers are found as well."""
    names = [prefix + x for x in ("type", "corrected", "found")]
    kept = [c for c in df.columns if c not in names]
    schema = df.select(*kept).schema.add(names[0], "string").add(names[1], "boolean").add(names[2], T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long")))
    row = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [x or b"" for x in batch.column(data).to_pylist()]
            found = [[m for m, _ in nested(b)] if deep else sniff(b) for b in values]
            kinds = [kind_of(b, f) for b, f in zip(values, found, strict=True)]
            said = batch.column(declared).to_pylist() if declared else [None] * len(values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(kinds, pa.string()), pa.array([s is not None and s != k for s, k in zip(said, kinds, strict=True)], pa.bool_()), pa.array([[m._asdict() for m in f] for f in found], row)], [*kept, *names])

    return df.select(*kept).mapInArrow(look, schema)


def carve(df: DataFrame, data: str, prefix: str = "media_") -> DataFrame:
    """One row for each medium of an inspected table, with its bytes as `<prefix>bytes`."""
    one = df.withColumn(prefix + "one", F.explode(prefix + "found"))
    at = F.col(prefix + "one")
    return one.withColumn(prefix + "kind", at["kind"]).withColumn(prefix + "bytes", F.substring(F.col(data), at["start"].cast("int") + 1, (at["end"] - at["start"]).cast("int"))).drop(prefix + "one")


def payload(text: str) -> tuple[int, bytes]:
    """UTF-8 length, and the text padded by zero bytes to a positive multiple of 64."""
    b = text.encode()
    return len(b), b + bytes(-len(b) % 64 or (0 if b else 64))


def stored(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored form of every text: doc_id, n_bytes, declared type (of raw bytes), and `media`, a PCM file of 8-bit samples."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [payload(x) for x in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array(["application/octet-stream"] * len(both)), pa.array([wav(b) for _, b in both], pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(store, f"doc_id {kind}, n_bytes long, declared string, media binary")


def features(df: DataFrame) -> DataFrame:
    """Digests of stored media, of bytes read back through their confirmed structure.

    The feature is the corrected type, then every confirmed medium outside or inside the payload as kind:start:end.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names[2:]]
            for b in batch.column("media").to_pylist():
                found = sniff(b)
                if not found or found[0].kind != "wav" or found[0].start:
                    raise ValueError("stored media did not validate as what was written")
                back = wav_samples(b, found[0])
                inner = sniff(back)
                said = [kind_of(b, found), *(f"{m.kind}:{m.start}:{m.end}" for m in found[1:]), *(f"samples/{m.kind}:{m.start}:{m.end}" for m in inner)]
                for to, x in zip(columns, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(b), hashlib.sha256(b).hexdigest(), ";".join(said)), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, pa.int64() if k in (0, 2, 3) else pa.string()) for k, x in enumerate(columns))], names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select("doc_id", "n_bytes", "media").mapInArrow(digest, schema)
