"""Content-addressed payloads in tar shards.

A payload is stored as a grey image (PNG, 8-bit samples, 64 to a row) that
becomes a member of a tar shard, named by the digest of the payload. Equal
payloads are stored once, by the first row that has one. A row needs digest, shard, offset and length alone;
its metadata columns come from reads of the image header, a few bytes each.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.llm.registry import extended, query, table
from papertally.session import shared_path, written

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, then length, name, 13 bytes and checksum of the first chunk.
HEADER_BYTES = 8 + 8 + 13 + 4
#: A shard is closed when it is as large as this.
SHARD_BYTES = 256 << 20


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text (null: none), filled with zeros to whole rows, one at least."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def to_image(payload: bytes) -> bytes:
    """The payload as a PNG of 8-bit grey samples, without loss."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    lines = np.pad(rows, ((0, 0), (1, 0)))  # each row begins with its filter: none
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first ``HEADER_BYTES``."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this format")
    return struct.unpack(">IIB", head[16:25])


def from_image(image: bytes) -> np.ndarray:
    """The samples of an image that ``to_image`` made."""
    width, height, _ = image_header(image)
    at, data = 8, []
    while at < len(image):
        size, name = struct.unpack(">I4s", image[at : at + 8])
        if name == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that is never written")
    return np.ascontiguousarray(lines[:, 1:])


def feature_of(samples: np.ndarray) -> str:
    """A short print of an image: its mean, and which columns are lighter than
    the one before, in hex."""
    means = samples.mean(axis=0)
    bits = "".join("1" if d > 0 else "0" for d in np.diff(means))
    return f"{samples.mean():.3f}:{int(bits, 2):016x}"


def payload_digest() -> Column:
    """SHA-256 of the payload of ``text``, as SQL."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text)
    fill = F.when(size == 0, WIDTH).otherwise((WIDTH - size % WIDTH) % WIDTH)
    return F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.repeat(F.lit("00"), fill.cast("int")))), 256)


class _Shards:
    """Tar files of one task, written aside and named when they are whole, so
    that a repeated or lost task leaves nothing half-written."""

    def __init__(self, folder: str):
        self._fs, self._base = fs.FileSystem.from_uri(folder)
        self._fs.create_dir(self._base, recursive=True)
        context = TaskContext.get()
        self._task, self._attempt = context.partitionId(), context.taskAttemptId()
        self._count, self._out, self._at = 0, None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        """Append a member; its shard and the offset of its content."""
        if self._out is None:
            self.name = f"shard-{self._task:06d}-{self._count:04d}.tar"
            self._aside = f"{self._base}/_{self._attempt}-{self.name}"
            self._out, self._at = self._fs.open_output_stream(self._aside), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        fill = -len(data) % tarfile.BLOCKSIZE
        self._out.write(head + data + bytes(fill))
        found = self.name, self._at + len(head)
        self._at += len(head) + len(data) + fill
        if self._at >= SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self._out is not None:
            self._out.write(bytes(2 * tarfile.BLOCKSIZE))
            self._out.close()
            self._fs.move(self._aside, f"{self._base}/{self.name}")
            self._out, self._count = None, self._count + 1


def _owned(docs: DataFrame, folder: str) -> None:
    """Decide which row stores each distinct payload: the first, by task and by
    position in it. Written below ``folder``, a file a task."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [batch.column("digest"), pa.array([task] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "task", "at"])
            at += n

    rows = docs.select(payload_digest().alias("digest")).mapInArrow(placed, "digest string, task int, at bigint")
    first = rows.groupBy("digest").agg(F.min(F.struct("task", "at")).alias("_f"))
    owners = first.select("digest", "_f.task", "_f.at").repartition("task").sortWithinPartitions("task", "at")
    owners.write.partitionBy("task").parquet(folder)


def write_media(docs: DataFrame, folder: str) -> DataFrame:
    """Store the payloads of all ``docs`` (``text``) below ``folder``, which all
    executors see. Returns the index, a written table with a row per distinct
    payload: ``digest``, ``shard``, ``offset``, ``length``.

    First digests alone are compared and a row is named for each payload; then
    every task stores the payloads of its own named rows, so no text or image
    travels. ``docs`` must give the same rows to the same tasks both times, as
    tables do; else an error says so. An empty table gives no shards. Other
    columns are not read.
    """
    named = f"{folder}/owners"
    _owned(docs, named)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(named)
        mine = f"{base}/task={TaskContext.get().partitionId()}"
        if files.get_file_info(mine).type == fs.FileType.NotFound:
            owned = {}
        else:
            rows = pq.read_table(mine, filesystem=files, columns=["digest", "at"])
            owned = dict(zip(rows.column("at").to_pylist(), rows.column("digest").to_pylist()))
        out, at, kinds = _Shards(folder), 0, [pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column("text").to_pylist(), at):
                name = owned.pop(i, None)
                if name is not None:
                    payload = payload_of(text)
                    if hashlib.sha256(payload).hexdigest() != name:
                        raise RuntimeError("the texts of a task changed between two readings: write them to a table first")
                    image = to_image(payload)
                    found.append((name, *out.add(f"{name}.png", image), len(image)))
            at += batch.num_rows
            columns = [pa.array([r[i] for r in found], kinds[i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "shard", "offset", "length"])
        out.close()
        if owned:
            raise RuntimeError("the texts of a task changed between two readings: write them to a table first")

    return written(docs.select("text").mapInArrow(shards, "digest string, shard string, offset bigint, length bigint"))


def _by_shard(index: DataFrame) -> DataFrame:
    """The index dealt so that reads of a shard follow each other."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(parts, "shard").sortWithinPartitions("shard", "offset")


def _ranges(batch: pa.RecordBatch, files: fs.FileSystem, base: str, least: int | None) -> Iterator[bytes]:
    """The stored bytes of each row; only the first ``least`` if given."""
    name, opened = None, None
    places = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")))
    for shard, offset, length in places:
        if shard != name:
            if opened:
                opened.close()
            name, opened = shard, files.open_input_file(f"{base}/{shard}")
        yield opened.read_at(length if least is None else least, offset)
    if opened:
        opened.close()


def header_columns(index: DataFrame, folder: str) -> DataFrame:
    """The index with ``width``, ``height`` and ``bits``, read from the first
    ``HEADER_BYTES`` of each image and nothing else."""
    rows = _by_shard(index)
    schema = extended(rows.schema, width="int", height="int", bits="int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            heads = [image_header(head) for head in _ranges(batch, files, base, HEADER_BYTES)]
            columns = [pa.array([h[i] for h in heads], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return rows.mapInArrow(read, schema)


def features(index: DataFrame, folder: str) -> DataFrame:
    """The index with what the stored bytes give: ``payload_bytes``,
    ``payload_sha256``, ``tail_crc32``, ``media_bytes``, ``media_sha256`` and
    ``feature``."""
    rows = _by_shard(index)
    schema = extended(
        rows.schema, payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint",
        media_sha256="string", feature="string",
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = []
            for image in _ranges(batch, files, base, None):
                samples = from_image(image)
                payload = samples.tobytes()
                found.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(image), hashlib.sha256(image).hexdigest(), feature_of(samples),
                ))
            columns = [pa.array([r[i] for r in found], kinds[i]) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return rows.mapInArrow(read, schema)


def media_columns(docs: DataFrame, folder: str) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; null counts as empty):
    ``doc_id``, ``n_bytes`` of the text, and its payload's place, metadata and
    features. Equal texts share all of them. Repeated rows stay."""
    index = write_media(docs, folder)
    known = header_columns(features(index, folder), folder)
    rows = docs.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), payload_digest().alias("digest")
    )
    return rows.join(known, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "feature", "shard", "offset", "length", "width", "height", "bits",
    )


@query("op6_media")
def media(spark: SparkSession, folder: str) -> DataFrame:
    return media_columns(table(spark, folder, "documents"), shared_path(spark))
