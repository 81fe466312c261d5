"""Archives as a data source: their members are rows, read by tasks from storage that all executors share.

`read_archives(spark, where)` gives archive, path, size and content of the files in all zip and tar archives of
a folder, or of one file, by any URI that pyarrow's file systems know. Tasks, one an archive, first list members from directories
of zips and headers of tars into a folder that all executors share. Planning reads paths and sizes of that listing a batch at a
time, and deals members into partitions of about `bytes` bytes (more, where there would be over PARTITIONS of them), so a large
archive is read by many tasks. Each gets places in the listing, and seeks from there to its own members: no directory is
read again. A compressed tar can't be entered in the middle: it is one partition, read as a
stream, a member at a time. Filters on path and archive leave members out before anything is read; with `content` false
contents are null. Options: folder (below which files count, and from which paths are relative), bytes, most (bytes that one
archive may unpack to), content. A listing that is given is read and not made: `list_archives` makes one for several loads.

Spark plans the filters of one scan: two filters on one table are best asked of two loads.

Links and devices are no files. A member that leads out of its archive, or too many bytes, is an error. A lone top folder is
left out, as hosts add one.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from textloom.sources.remote import ARCHIVES
from textloom.sources.shared import shared_folder

SCHEMA = "archive string, path string, size long, content string"
BYTES, MOST = 32 << 20, 1 << 30
#: Rows of a batch that a task hands on, by the bytes of their contents; bytes that are copied at once.
BATCH = 8 << 20
#: Members of a batch of a listing, and partitions of a load beyond which these grow.
LISTED, PARTITIONS = 1000, 2000
#: An entry of a zip's directory, the end of one, and its wide form.
ENTRY, END, WIDE = struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q")


class Member(NamedTuple):
    """A file in an archive: its name there, its path and size, and where it begins: its bytes in a tar, its header in a zip,
    where they have a packed size, a method and a checksum."""

    name: str
    path: str
    size: int
    at: int
    packed: int = 0
    method: int = 0
    crc: int = 0


def inside(name: str) -> str | None:
    """A member's path in an archive, None if it leads out of it or has no name."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    return None if name.startswith("/") or ".." in parts or not parts or ":" in parts[0] else "/".join(parts)


def kind_of(name: str) -> str:
    name = name.lower()
    return "zip" if name.endswith(".zip") else "tar" if name.endswith(".tar") else "stream"


def directory(source: Any) -> tuple[int, int, int]:
    """Where a zip's directory begins, its bytes, and what was put before the archive."""
    size = source.seek(0, 2)
    tail = min(size, END.size + 0xFFFF)
    source.seek(size - tail)
    data = source.read(tail)
    k = data.rfind(b"PK\5\6")
    if k < 0 or len(data) - k < END.size:
        raise zipfile.BadZipFile("no end of a zip's directory")
    *_, length, offset, _ = END.unpack_from(data, k)
    end = size - tail + k
    if end >= 20:
        source.seek(end - 20)
        mark, _, at, _ = struct.unpack("<4sIQI", source.read(20))
        if mark == b"PK\6\7":
            end = end - 20 - WIDE.size
            source.seek(end)
            sign, *_, length, offset = WIDE.unpack(source.read(WIDE.size))
            if sign != b"PK\6\6":
                raise zipfile.BadZipFile("no end of a wide zip's directory")
    if end - length - offset < 0:
        raise zipfile.BadZipFile("a zip's directory is cut off")
    return end - length, length, end - length - offset


def extras(extra: bytes) -> Iterator[tuple[int, bytes]]:
    """Kinds and bytes of the fields that an entry's extra field holds."""
    k = 0
    while k + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, k)
        yield kind, extra[k + 4 : k + 4 + n]
        k += 4 + n


def wide(extra: bytes, size: int, packed: int, at: int) -> tuple[int, int, int]:
    """An entry's sizes and place, which its extra field has where they are too large for it."""
    for kind, data in extras(extra):
        if kind == 1:
            values = iter(struct.unpack_from(f"<{len(data) // 8}Q", data))
            return tuple([next(values) if x == 0xFFFFFFFF else x for x in (size, packed, at)])
    return size, packed, at


def named(flags: int, raw: bytes, extra: bytes) -> str:
    """An entry's name, which its extra field may have in Unicode."""
    for kind, data in extras(extra):
        if kind == 0x7075 and len(data) > 5 and data[0] == 1 and struct.unpack_from("<I", data, 1)[0] == zlib.crc32(raw):
            return data[5:].decode()
    return raw.decode("utf-8" if flags & 0x800 else "cp437").split("\0")[0]


def entries(source: Any) -> Iterator[tuple[tuple, bytes, bytes, bytes]]:
    """Fields, name, extra field and comment of a zip's directory, in which it is read a piece at a time."""
    begin, left, _ = directory(source)
    source.seek(begin)
    data, k = b"", 0

    def more(n: int) -> None:
        nonlocal data, k, left
        while len(data) - k < n:
            if not (new := source.read(min(left, 1 << 20))):
                raise zipfile.BadZipFile("a zip's directory is cut off")
            left -= len(new)
            data, k = data[k:] + new, 0

    while left or k < len(data):
        more(ENTRY.size)
        fields = ENTRY.unpack_from(data, k)
        if fields[0] != b"PK\1\2":
            raise zipfile.BadZipFile("no entry of a zip's directory")
        n, e, c = fields[10:13]
        more(ENTRY.size + n + e + c)
        k += ENTRY.size
        yield fields, data[k : k + n], data[k + n : k + n + e], data[k + n + e : k + n + e + c]
        k += n + e + c


def unzipped(source: Any, m: Member) -> bytes:
    """A zip's member."""
    source.seek(m.at)
    head = source.read(30)
    if head[:4] != b"PK\3\4" or len(head) < 30:
        raise zipfile.BadZipFile(f"{m.name!r}: no header")
    if head[6] & 1:
        raise ValueError(f"{m.name!r} is encrypted")
    n, e = struct.unpack_from("<2H", head, 26)
    source.seek(m.at + 30 + n + e)
    data = source.read(m.packed)
    if m.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-15).decompress(data, m.size + 1)
    elif m.method == zipfile.ZIP_BZIP2:
        data = bz2.BZ2Decompressor().decompress(data, m.size + 1)
    elif m.method == zipfile.ZIP_LZMA:
        data = zipfile.LZMADecompressor().decompress(data)
    elif m.method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"{m.name!r}: compression {m.method}")
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise zipfile.BadZipFile(f"{m.name!r}: bytes are not those of its checksum")
    return data


def plain(source: Any) -> Any:
    """A compressed tar as a stream of its bytes, also where it is several compressed streams."""
    source.seek(0)
    mark = source.read(6)
    source.seek(0)
    opened = gzip.GzipFile(fileobj=source) if mark[:2] == b"\x1f\x8b" else bz2.BZ2File(source) if mark[:3] == b"BZh" else lzma.LZMAFile(source) if mark == b"\xfd7zXZ\0" else source
    return opened if opened is source else io.BufferedReader(opened, 1 << 20)


def walked(name: str, source: Any) -> Iterator[tuple]:
    """Files of an open archive as fields of a Member without a path, in order."""
    if kind_of(name) == "zip":
        before = directory(source)[2]
        for fields, raw, extra, _ in entries(source):
            file = named(fields[3], raw, extra)
            if not file.endswith("/") and fields[15] >> 28 != 0xA:
                size, packed, at = wide(extra, fields[9], fields[8], fields[16])
                yield file, size, at + before, packed, fields[4], fields[7]
        return
    source.seek(0)
    tar = kind_of(name) == "tar"
    with tarfile.open(fileobj=source if tar else plain(source), mode="r:" if tar else "r|", stream=True) as found:  # members aren't kept
        for m in found:
            if m.isreg():
                yield m.name, m.size, m.offset_data, 0, 0, 0


def listed(name: str, source: Any, folder: str, most: int) -> Iterator[Member]:
    """Members below a folder of an open archive, in order; of a name that is there twice the last counts.

    The archive's list is read twice, so that only a number a member is held, and names only of those that seem to be there twice.
    """
    hashes, tops, flat, total = array("q"), set(), False, 0
    for file, size, *_ in walked(name, source):
        total += size
        if total > most:
            raise ValueError(f"{name}: unpacks to more than {most} bytes")
        if (path := inside(file)) is None:
            raise ValueError(f"{name}: {file!r} leads out of the archive")
        hashes.append(hash(path))
        flat = flat or "/" not in path
        if len(tops) < 2:
            tops.add(path.split("/")[0])
    found, first, count = np.unique(np.frombuffer(hashes, np.int64), return_index=True, return_counts=True)
    twice, last = set(found[count > 1].tolist()), {}
    if twice:
        for k, (file, *_) in enumerate(walked(name, source)):
            if hashes[k] in twice:
                last[inside(file)] = k
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    for k, (file, size, *rest) in enumerate(walked(name, source)):
        path = inside(file)
        if hashes[k] in twice and last[path] != k:
            continue
        if len(tops) == 1 and not flat:
            path = path.split("/", 1)[1]
        if path.startswith(prefix):
            yield Member(file, path.removeprefix(prefix), size, *rest)


def members(name: str, source: Any, folder: str, most: int) -> list[Member]:
    """What an open archive holds."""
    return list(listed(name, source, folder, most))


def contents(name: str, source: Any, wanted: Iterator[Member] | list[Member]) -> Iterator[tuple[Member, bytes]]:
    """Bytes of the wanted members of an open archive, one at a time, in its order."""
    if kind_of(name) == "zip":
        for m in wanted:
            yield m, unzipped(source, m)
    elif kind_of(name) == "tar":
        for m in wanted:
            source.seek(m.at)
            yield m, source.read(m.size)
    else:
        wanted = iter(wanted)
        m = next(wanted, None)
        with tarfile.open(fileobj=plain(source), mode="r|", stream=True) as tar:
            for info in tar:
                if m is None:
                    return
                if info.offset_data == m.at and info.isreg():
                    yield m, tar.extractfile(info).read()
                    m = next(wanted, None)


def system_of(where: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


def list_archives(spark: SparkSession, where: str, folder: str = "", most: int = MOST) -> str:
    """A listing of all archives below a folder, or of one archive: a file of members each, written by tasks, in a new folder."""
    system, root = system_of(where)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    names = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(ARCHIVES))
    out = shared_folder(spark, "members")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = system_of(where)
        place, to = system_of(out)
        place.create_dir(to, recursive=True)
        for batch in batches:
            for k, path in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                name = path if path == root else path.removeprefix(root.rstrip("/") + "/")
                schema = LISTING.with_metadata({"archive": name, "file": path})
                with system.open_input_file(path) as source, place.open_output_stream(f"{to}/{k:08d}.arrow") as sink, pa.ipc.new_file(sink, schema) as file:
                    rows: list[Member] = []
                    for m in listed(path, source, folder, most):
                        rows.append(m)
                        if len(rows) == LISTED:
                            file.write(listing_batch(rows, schema))
                            rows = []
                    if rows:
                        file.write(listing_batch(rows, schema))
            yield batch

    if names:
        rows = spark.createDataFrame(list(enumerate(names)), "place long, path string")
        tasks = min(len(names), max(4 * spark.sparkContext.defaultParallelism, len(names) // 100))
        rows.repartitionByRange(tasks, "place").mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()
    return out


LISTING = pa.schema([("name", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("packed", pa.int64()), ("method", pa.int64()), ("crc", pa.int64())])


def listing_batch(rows: list[Member], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def passing(filters: list[Filter], archive: str, batch: pa.RecordBatch) -> np.ndarray:
    """Places in a batch of a listing that pass all filters."""
    paths = batch.column(batch.schema.get_field_index("path"))
    good = np.ones(batch.num_rows, bool)
    for f in filters:
        values = paths if f.attribute == ("path",) else pa.array([archive])
        hit = pc.equal(values, f.value) if isinstance(f, EqualTo) else pc.is_in(values, pa.array(list(f.value), pa.string())) if isinstance(f, In) else pc.starts_with(values, f.value) if isinstance(f, StringStartsWith) else pc.ends_with(values, f.value)
        good &= hit.to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(good)


class Part(InputPartition):
    """Members of one archive: those of its listing from a row to another (exclusive) that pass."""

    def __init__(self, listing: str = "", begin: int = 0, end: int = 0) -> None:
        self.listing, self.begin, self.end = listing, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.where, self.listing = options["path"], options["listing"]
        self.bytes = int(options.get("bytes", BYTES))
        self.with_content = options.get("content", "true").lower() != "false"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("path",), ("archive",)):
                self.filters.append(f)
            else:
                yield f

    def _members(self, part: Part) -> Iterator[tuple[pa.Schema, int, pa.RecordBatch, np.ndarray]]:
        """Batches of a part of a listing that have members which pass: schema, first row, batch, places in it."""
        system, _ = system_of(self.listing)
        with system.open_input_file(part.listing) as source:
            file = pa.ipc.open_file(source)
            archive = file.schema.metadata[b"archive"].decode()
            for b in range(part.begin // LISTED, min(file.num_record_batches, -(-part.end // LISTED))):
                batch = file.get_batch(b)
                places = passing(self.filters, archive, batch)
                places = places[(places >= part.begin - b * LISTED) & (places < part.end - b * LISTED)]
                if len(places):
                    yield file.schema, b * LISTED, batch, places

    def partitions(self) -> list[Part]:
        system, root = system_of(self.listing)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(x.path for x in found if x.path.endswith(".arrow"))
        whole = [Part(x, 0, 1 << 62) for x in names]
        total = sum(int(pc.sum(batch.column("size").take(pa.array(places))).as_py()) for part in whole for _, _, batch, places in self._members(part))
        most, out = max(self.bytes, total // PARTITIONS), []
        for part in whole:
            size, begin, end = 0, None, 0
            for schema, first, batch, places in self._members(part):
                stream = kind_of(schema.metadata[b"file"].decode()) == "stream"
                for k, n in zip(places.tolist(), batch.column("size").to_numpy()[places].tolist(), strict=True):
                    if begin is not None and size + n > most and not stream:
                        out.append(Part(part.listing, begin, end))
                        begin, size = None, 0
                    begin, end = first + k if begin is None else begin, first + k + 1
                    size += n
            if begin is not None:
                out.append(Part(part.listing, begin, end))
        return out or [Part()]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.listing:
            return
        system, _ = system_of(self.where)
        with system_of(self.listing)[0].open_input_file(partition.listing) as source:
            about = pa.ipc.open_file(source).schema.metadata
        name, path = about[b"archive"].decode(), about[b"file"].decode()
        wanted = (Member(*row.values()) for _, _, batch, places in self._members(partition) for row in batch.take(pa.array(places)).to_pylist())
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["archive", "path", "size", "content"])

        def found() -> Iterator[tuple[Member, bytes | None]]:
            if not self.with_content:
                yield from ((m, None) for m in wanted)
                return
            with system.open_input_file(path) as source:
                yield from contents(path, source, wanted)

        for m, data in found():
            rows.append((name, m.path, m.size, None if data is None else data.decode("utf-8", "replace")))
            size += len(data or b"")
            if size >= BATCH or len(rows) == 10 * LISTED:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, where: str, folder: str = "", *, most: int = MOST, listing: str | None = None, **options: object) -> DataFrame:
    """archive, path, size, content of the files in all archives below a folder, or of one archive."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("archives").option("listing", listing or list_archives(spark, where, folder, most))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(where)


class Packer:
    """An archive that is written to an open stream a member at a time: only the list of a zip's members is held."""

    def __init__(self, out: Any, form: str) -> None:
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if form == "zip" else None
        self.packs = form.endswith("gz")
        self.out = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) if self.packs else out

    def add(self, path: str, data: bytes) -> None:
        if self.zip:
            info = zipfile.ZipInfo(path)  # of a fixed date, so that a retried task writes the same
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o600 << 16
            self.zip.writestr(info, data)
            return
        info = tarfile.TarInfo(path)
        info.size = len(data)
        self.out.write(info.tobuf())
        self.out.write(data)
        self.out.write(bytes(-len(data) % tarfile.BLOCKSIZE))

    def close(self, end: bool = True) -> None:
        """end: with the end of a tar; without, other members can follow in another piece."""
        if self.zip:
            self.zip.close()
            return
        if end:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        if self.packs:
            self.out.close()


def packed(files: list[tuple[str, bytes]], form: str) -> bytes:
    """An archive of files, as zip, tar or tar.gz."""
    out = io.BytesIO()
    packer = Packer(out, form)
    for path, data in files:
        packer.add(path, data)
    packer.close()
    return out.getvalue()


def copied(source: Any, n: int, out: Any) -> None:
    while n > 0:
        data = source.read(min(n, BATCH))
        if not data:
            raise EOFError("a piece is cut off")
        out.write(data)
        n -= len(data)


def joined(system: fs.FileSystem, pieces: list[str], form: str, out: Any) -> None:
    """One archive of its pieces in their order; a zip's directory is written an entry at a time, none of its names is held."""
    places, at = [], 0
    for piece in pieces:
        with system.open_input_file(piece) as source:
            n = directory(source)[0] if form == "zip" else source.size()
            source.seek(0)
            copied(source, n, out)
        places.append(at)
        at += n
    if form != "zip":
        end = bytes(2 * tarfile.BLOCKSIZE)
        out.write(gzip.compress(end, mtime=0) if form.endswith("gz") else end)
        return
    count = length = 0
    for piece, place in zip(pieces, places, strict=True):
        with system.open_input_file(piece) as source:
            rows = bytearray()
            for fields, name, extra, comment in entries(source):
                rows += moved(fields, name, extra, comment, place)
                count += 1
                if len(rows) >= 1 << 20:
                    out.write(bytes(rows))
                    length += len(rows)
                    rows = bytearray()
            out.write(bytes(rows))
            length += len(rows)
    if count >= 0xFFFF or length >= 0xFFFFFFFF or at >= 0xFFFFFFFF:
        out.write(WIDE.pack(b"PK\6\6", WIDE.size - 12, 45, 45, 0, 0, count, count, length, at))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, at + length, 1))
    out.write(END.pack(b"PK\5\6", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(length, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))


def moved(fields: tuple, name: bytes, extra: bytes, comment: bytes, by: int) -> bytes:
    """A zip's entry whose file lies some bytes further on."""
    size, packed, at = wide(extra, fields[9], fields[8], fields[16])
    large = [x for x in (size, packed, at + by) if x >= 0xFFFFFFFF]
    if large:
        extra = struct.pack(f"<2H{len(large)}Q", 1, 8 * len(large), *large)  # no piece has any other
    narrow = [min(x, 0xFFFFFFFF) for x in (packed, size, at + by)]
    version = max(fields[2], 45) if large else fields[2]
    return ENTRY.pack(fields[0], fields[1], version, *fields[3:8], *narrow[:2], len(name), len(extra), *fields[12:16], narrow[2]) + name + extra + comment


def write_archives(corpus: DataFrame, folder: str, key: str, form: str | Column = "zip") -> None:
    """One archive for each value of a column, below a folder on shared storage, in order of paths; a retried task writes the
    same again. form: zip, tar or tar.gz, or a column of these; rows where it is null are left out.

    Rows are dealt by ranges of keys and paths, so that many tasks write pieces of a large archive, each as a stream; a task an
    archive then copies its pieces together. The pieces are below the folder until then.
    """
    parts = f"{folder.rstrip('/')}/_pieces-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = system_of(parts)
        task, now, packer, out, pieces = TaskContext.get().partitionId(), None, None, None, []
        for batch in batches:
            keys, forms, paths, texts = (batch.column(c) for c in range(4))
            texts = texts.cast(pa.binary())
            for k in range(batch.num_rows):
                key = (keys[k].as_py(), forms[k].as_py())
                if out is None or key != now:
                    if out is not None:
                        packer.close(False)
                        out.close()
                    now, name = key, f"{root}/{task:08d}-{len(pieces):08d}"
                    out = system.open_output_stream(name, compression=None)
                    packer = Packer(out, key[1])
                    pieces.append((*key, name))
                if (data := texts[k].as_py()) is not None:
                    packer.add(paths[k].as_py(), data)
        if out is not None:
            packer.close(False)
            out.close()
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pieces, strict=True)], ["key", "form", "piece"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain, groupby

        system, root = system_of(folder)
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
        for (key, form), pieces in groupby(rows, lambda r: r[:2]):
            name = f"{root.rstrip('/')}/{key}.{form}"
            with system.open_output_stream(name, compression=None) as out:
                joined(system, [r[2] for r in pieces], form, out)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    spark = corpus.sparkSession
    system, root = system_of(parts)
    system.create_dir(root, recursive=True)
    form = F.lit(form) if isinstance(form, str) else form
    rows = corpus.select(F.col(key).cast("string").alias("key"), form.alias("form"), "path", "content").filter("form IS NOT NULL")
    pieces, schema = f"{parts}/list", "key string, form string, piece string"
    rows.repartitionByRange("key", "form", "path").sortWithinPartitions("key", "form", "path", "content").mapInArrow(write, schema).write.parquet(pieces)
    found = spark.read.schema(schema).parquet(pieces)
    tasks = max(4 * spark.sparkContext.defaultParallelism, found.count() // 1000)  # told, or rows this few are put into one
    found = found.repartition(tasks, "key", "form").sortWithinPartitions("key", "form", "piece")
    found.mapInArrow(join, "name string").write.format("noop").mode("overwrite").save()
    system.delete_dir(root)
