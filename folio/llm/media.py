"""Media columns: content-addressed payloads in tar shards, rows that carry digest, offset and length.

store() turns each text into its media form and appends what its task hasn't stored yet to a tar shard in a shared
folder; tasks write shards of their own, so nothing is shuffled to store, a payload that many tasks see is stored at
most once by each, and all rows point at one copy (the least place). A failed attempt leaves a shard that no row names.
inspect() fills metadata columns from range reads of the media headers alone (33 bytes each); with full=True it reads
the payloads back too.

The media form is a gray PNG of 8-bit samples, 64 to a line: the UTF-8 bytes, then 0 bytes up to a positive multiple of 64.

Defined cases: a null text counts as empty, which is one line of zeros; equal texts have equal values in all columns;
repeated rows get a row each; further columns are ignored; an empty table gives no rows; a stored form that is cut
short or isn't such a PNG raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import open_folder, task_name
from ._shared import materialise, only, scratch_path, small_batches

LINE = 64
SHARD_BYTES = 64_000_000
HEADER = 33  # signature and IHDR
_SIGN = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % LINE or (0 if data else LINE))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A gray PNG whose samples are the payload's bytes."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if len(start) < HEADER or start[:8] != _SIGN or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != int.from_bytes(start[29:33], "big"):
        raise ValueError("no PNG header")
    width, height, bits, colour = struct.unpack(">IIBB", start[16:26])
    if colour:
        raise ValueError("not gray")
    return width, height, bits


def decode(media: bytes) -> bytes:
    """The samples of encode()'s form."""
    width, height, bits = header(media[:HEADER])
    at, packed = HEADER, b""
    while True:
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is damaged")
        if kind == b"IEND":
            break
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("not 8-bit samples without a filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes, width: int, height: int) -> str:
    """Size, mean and deviation of the samples, and their histogram in 16 classes."""
    x = np.frombuffer(payload, np.uint8)
    return f"{width}x{height} mean={x.mean():.4f} sd={x.std():.4f} hist={','.join(map(str, np.bincount(x >> 4, minlength=16)))}"


class _Shards:
    """Tar files of about SHARD_BYTES under a folder, written one after another by one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = open_folder(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.out, self.at, self.count = task_name(), None, 0, 0

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.file = f"shard-{self.name}-{self.count:04d}.tar"
            self.out, self.at, self.count = self.fs.open_output_stream(f"{self.folder}/{self.file}"), 0, self.count + 1
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        place = self.at + 512
        self.at = place + len(data) + -len(data) % 512
        return self.file, place, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) of each text: where its media form is under folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = _Shards(folder), {}
        try:
            for b in small_batches(batches, "text"):
                rows = []
                for t in b.column("text").to_pylist():
                    data = (t or "").encode()
                    key = hashlib.sha256(data).digest()
                    if key not in known:
                        media = encode(padded(data))
                        digest = hashlib.sha256(media)
                        name = digest.hexdigest()
                        known[key] = (digest.digest(), *shards.add(f"{name[:2]}/{name}.png", media))
                    rows.append((len(data), *known[key]))
                n, digest, shard, at, length = zip(*rows, strict=True)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, long), pa.array(digest, pa.binary()), pa.array(shard), pa.array(at, long), pa.array(length, long)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long")


def inspect(objects: DataFrame, folder: str, full: bool = False) -> DataFrame:
    """(digest, width, height, bits) of distinct objects (digest, shard, offset, length), from header reads alone.

    full: reads the stored bytes as well, checks them against the digest (ValueError) and adds payload_bytes,
    payload_sha256 (binary), tail_crc32, media_bytes and feature. Objects are dealt by shard and read in order of place.
    """
    names = ["digest", "width", "height", "bits"] + ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"] * full
    schema = "digest binary, width int, height int, bits int" + ", payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        name, file = None, None
        for b in batches:
            rows = []
            for digest, shard, at, length in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                row = header(file.read_at(HEADER, at))
                if full:
                    media = file.read_at(length, at)
                    if hashlib.sha256(media).digest() != digest:
                        raise ValueError(f"{shard} is damaged at {at}")
                    payload = decode(media)
                    row += (len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-LINE:]), len(media), feature(payload, *row[:2]))
                rows.append((digest, *row))
            if rows:
                types = [pa.binary(), *[pa.int32()] * 3] + [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()] * full
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if file is not None:
            file.close()

    n = max(12, int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return objects.repartition(n, "shard").sortWithinPartitions("shard", "offset").select("digest", "shard", "offset", "length").mapInArrow(run, schema)


def media_table(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_bytes, digest) and distinct objects (digest, shard, offset, length), stored under folder."""
    found = materialise(store(docs, folder or scratch_path(docs.sparkSession, "media")), "media")
    objects = found.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    return found.select("doc_id", "n_bytes", "digest"), materialise(objects, "objects")


def round_trip(docs: DataFrame) -> DataFrame:
    """Store all texts, read the stored bytes back and join what they tell, and their place, to each row by digest."""
    folder = scratch_path(docs.sparkSession, "media")
    rows, objects = media_table(docs, folder)
    told = materialise(inspect(objects, folder, full=True), "told")
    sha = lambda c: F.lower(F.hex(c))
    both = rows.join(told.join(objects.select("digest", "shard", "offset"), "digest"), "digest")
    return both.select("doc_id", "n_bytes", "payload_bytes", sha("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", sha("digest").alias("media_sha256"), "feature", "width", "height", "shard", "offset")
