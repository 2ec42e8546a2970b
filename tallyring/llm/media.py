"""Media columns: payloads as PNG images in archives, read by a Spark data source.

Storing. ``pack`` turns each text's UTF-8 bytes into a payload (bytes 32 appended up to a
positive multiple of 192), stores it as an 8-bit RGB image 64 pixels wide (a row is 192
bytes; PNG, filter 0, one IDAT) and appends the images, uncompressed, to ZIP archives below
a shared folder. A task writes its archives under names of its own attempt and returns
them; the archives of attempts that did not succeed are in no list and are never read.

Reading. The data source ``archive`` plans byte ranges over the listed archives from their
sizes. A task opens an archive's directory, takes the members whose headers start in its
range, reads neighbouring members in one request and streams them out in Arrow batches. A
member that comes short, broken or not at all (its CRC does not hold, or the store raises
OSError) is fetched again alone, by its own offset from a newly opened file, up to ``retries``
times with growing pauses, and only then fails the task. The directory is retried likewise.

Null texts are empty: one row of spaces. Equal texts give equal bytes and features. Texts of any
length are one image, held whole by one task. Rows stay separate whatever their doc_id (null
included; any type that Spark casts to text and back, of at most ``LONGEST_ID`` bytes as text; a
longer one raises). An empty table gives an empty result. Columns beyond doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyring.llm import scratch

UNIT, WIDTH = 192, 64
ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 8 << 20
LONGEST_ID = 30_000
#: Seconds before the first new try; each further one waits twice as long.
PAUSE = 0.1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _section(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, UNIT)
    filtered = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _section(b"IHDR", head) + _section(b"IDAT", zlib.compress(filtered, LEVEL)) + _section(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """Samples of an image that ``to_png`` made, row by row; anything else raises."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts, shape = 8, [], None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("a section's CRC does not hold")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not 8-bit RGB of the stored width")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(shape[1], UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Height, mean and deviation of each colour, and a perceptual hash: 64 bits telling which
    of 8 x 8 fields (rows by columns, of the samples' means) lie above their median."""
    a = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH, 3)
    total = a.sum(axis=(0, 1), dtype=np.int64)
    square = np.array([int(np.dot(c, c)) for c in (a[:, :, k].ravel().astype(np.float64) for k in range(3))])
    n = a.shape[0] * WIDTH
    mean = total / n
    deviation = np.sqrt(np.maximum(square / n - mean**2, 0))
    columns = a.reshape(len(a), 8, 24).sum(axis=2, dtype=np.int64)
    edges = [len(a) * k // 8 for k in range(9)]
    fields = np.array([columns[edges[k] : max(edges[k] + 1, edges[k + 1])].mean(axis=0) for k in range(8)])
    bits = "".join("1" if x else "0" for x in (fields > np.median(fields)).ravel())
    colours = " ".join(f"{m:.3f}/{d:.3f}" for m, d in zip(mean, deviation, strict=True))
    return f"{len(a)}x{WIDTH} {colours} {int(bits, 2):016x}"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _pack(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = _open(path)
        files.create_dir(where, recursive=True)
        context = TaskContext.get()
        mark = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        made, buffer, archive, entry = [], io.BytesIO(), None, 0

        def close() -> None:
            nonlocal buffer, archive
            if archive is not None:
                archive.close()
                name = f"{where}/{mark}-{len(made):05d}.zip"
                with files.open_output_stream(name) as out:
                    out.write(buffer.getbuffer())
                made.append((f"{path}/{name.rpartition('/')[2]}", buffer.getbuffer().nbytes))
                buffer, archive = io.BytesIO(), None

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if doc is not None and len(doc.encode()) > LONGEST_ID:
                    raise ValueError(f"doc_id of over {LONGEST_ID} bytes: {doc[:50]}...")
                if archive is None:
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                # the name holds the id after a sign that it is there, and the bytes without padding
                info = zipfile.ZipInfo(f"{context.partitionId():06d}/{entry:010d}.{len((text or '').encode())}.{'n' if doc is None else 'v' + doc.encode().hex()}.png")
                archive.writestr(info, to_png(payload(text)))
                entry += 1
                if buffer.tell() > ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "size"])

    return run


class _Range(InputPartition):
    def __init__(self, archive: str, lo: int, hi: int) -> None:
        self.archive, self.lo, self.hi = archive, lo, hi


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.list, self.range = options["list"], int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        files, where = _open(self.list)
        found = []
        with files.open_input_stream(where) as f:
            for line in f.read().decode().splitlines():
                archive, size = line.rsplit("\t", 1)
                found += [_Range(archive, lo, lo + self.range) for lo in range(0, int(size), self.range)]
        return found

    @staticmethod
    def member(info: zipfile.ZipInfo, head: bytes, lo: int) -> bytes | None:
        """A member's bytes out of ``head``, which starts at ``lo``; None if they do not hold."""
        at = info.header_offset - lo
        if len(head) < at + 30:
            return None
        name, extra = struct.unpack_from("<HH", head, at + 26)
        data = head[at + 30 + name + extra :][: info.file_size]
        return data if len(data) == info.file_size and zlib.crc32(data) == info.CRC else None

    @staticmethod
    def fetch(archive: str, lo: int, n: int) -> bytes:
        """Bytes of an archive, from a file opened for them alone."""
        files, where = _open(archive)
        with files.open_input_file(where) as f:
            f.seek(lo)
            return f.read(n)

    @staticmethod
    def directory(archive: str) -> tuple[list[zipfile.ZipInfo], int]:
        """Members in order of their offsets, and where they end."""
        files, where = _open(archive)
        with files.open_input_file(where) as f, zipfile.ZipFile(f) as z:
            return sorted(z.infolist(), key=lambda i: i.header_offset), z.start_dir

    def _tried(self, what: str, attempt):
        """The first answer of ``attempt`` that is not None, before the tries end."""
        last = "it does not hold"
        for k in range(self.retries + 1):
            if k:
                time.sleep(PAUSE * 2 ** (k - 1))
            try:
                if (found := attempt()) is not None:
                    return found
            except (OSError, zipfile.BadZipFile) as e:
                last = f"{type(e).__name__}: {e}"
        raise OSError(f"{what}: {last} after {self.retries} more tries")

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives were listed
            return
        archive = partition.archive
        members, after = self._tried(f"{archive}, its directory", lambda: self.directory(archive))
        ends = [i.header_offset for i in members[1:]] + [after]
        own = [(m, e) for m, e in zip(members, ends, strict=True) if partition.lo <= m.header_offset < partition.hi]
        while own:
            lo, k = own[0][0].header_offset, 1
            while k < len(own) and own[k][1] - lo <= 2 << 20:
                k += 1
            try:
                head = self.fetch(archive, lo, own[k - 1][1] - lo)
            except OSError:
                head = b""
            rows = []
            for info, end in own[:k]:
                data = self.member(info, head, lo)
                if data is None:
                    at = info.header_offset
                    data = self._tried(f"{archive}, {info.filename} at {at}", lambda info=info, at=at, end=end: self.member(info, self.fetch(archive, at, end - at), at))
                rows.append((archive, info.filename, info.header_offset, data))
            own = own[k:]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "member", "offset", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("archive").option("list", file)``: the file names an archive and its
    size, parted by a tab, a line."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def pack(docs: DataFrame, path: str) -> str:
    """Store the texts below ``path``; returns the list of archives (one line each, so one per
    16 MB of images)."""
    spark = docs.sparkSession
    listed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_pack(f"{path}/archives"), "archive string, size long")
    lines = listed.select(F.concat_ws("\t", "archive", F.col("size").cast("string")).alias("value")).collect()
    files, where = _open(path)
    files.create_dir(where, recursive=True)
    with files.open_output_stream(f"{where}/archives.tsv") as f:
        f.write("".join(f"{r[0]}\n" for r in sorted(lines)).encode())
    return f"{path}/archives.tsv"


def load(spark: SparkSession, listed: str) -> DataFrame:
    """One row a member: archive, member, offset, media."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("list", listed).load()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for name, media in zip(batch.column("member").to_pylist(), batch.column("media"), strict=True):
            media = media.as_py()
            data = from_png(media)
            _, size, doc, _ = name.rsplit("/", 1)[1].split(".")
            values = (bytes.fromhex(doc[1:]).decode() if doc[0] == "v" else None, int(size), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(data))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(media: DataFrame, id_type: str = "long") -> DataFrame:
    """A row a member with what was read from its image."""
    found = media.select("member", "media").mapInArrow(_describe, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))


def store_and_describe(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    listed = pack(docs, scratch.folder(spark, "media"))
    return features(load(spark, listed), docs.schema["doc_id"].dataType.simpleString())
