"""Media columns: payloads in tar shards, addressed by content.

A text's bytes become the 8-bit samples of a greyscale PNG of width 192. Each
task appends the PNGs it meets, once per digest, to a tar file in the shared
folder and starts another at ``SHARD_BYTES``; a row then carries digest, shard,
offset and length and no payload. Over all shards one place of each digest is
kept as the place of all its rows. Width, height and depth are filled in by
range reads of the 33 bytes at the payload's start; whole payloads are read
only where the samples themselves are asked for, once per digest.

A task that runs again writes shards under new names, and only rows of the
task that ended refer to shards, so a lost executor leaves unused files at
worst. Payloads never go through a shuffle.

Defined results: a null text is the empty text, whose payload is one line of
192 spaces; repeated rows and equal texts share one payload and get equal
values, and of several places of a digest the least is kept; a text of any
length is one payload, in memory for its bytes and its lines; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import map_batches
from millrace.session import ship
from millrace.storage import materialize, new_path

WIDTH = 192
SHARD_BYTES = 64 << 20
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
RANGE_BYTES = 4 << 20
PLACES = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit greyscale PNG of a payload of a multiple of ``width`` bytes."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, width)
    filtered = np.zeros((len(lines), width + 1), np.uint8)
    filtered[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and depth from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the start of a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, body = HEADER_BYTES, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and these with spaces up to a positive multiple of the width."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def tar_entry(name: str, size: int) -> bytes:
    """A ustar header block."""
    block = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        block[at : at + len(value)] = value
    block[148:156] = b"%06o\0 " % sum(block)
    return bytes(block)


def open_store(uri: str):
    """(file system, path) of a folder in the shared store, for Python on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shards:
    """Writer of tar shards for one task."""

    def __init__(self, uri: str):
        self.fs, self.root = open_store(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.known: dict[str, tuple[str, int, int]] = {}
        self.out = None

    def put(self, data: bytes) -> tuple[str, str, int, int]:
        """Digest, shard, offset and length of a payload, written if this shard doesn't hold it."""
        digest = hashlib.sha256(data).hexdigest()
        if digest not in self.known:
            if self.out is None or self.at > SHARD_BYTES:
                self.close()
                self.name, self.at, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
                self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
            self.out.write(tar_entry(f"{digest}.png", len(data)))
            self.out.write(data + bytes(-len(data) % 512))
            self.known[digest] = (self.name, self.at + 512, len(data))
            self.at += 512 + len(data) + -len(data) % 512
        return digest, *self.known[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store_texts(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's payload; rows of (doc_id, n_bytes, digest, shard, offset, length)."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in PLACES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(uri)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                n, payload = payload_of(batch.column(1)[k].as_py())
                rows.append((batch.column(0)[k].as_py(), n, *shards.put(to_png(payload))))
            cols = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
        shards.close()

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, PLACES)


def one_place(stored: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place for each digest."""
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


class Ranges:
    """Range reads from shards, with one file open at a time."""

    def __init__(self, uri: str):
        self.fs, self.root = open_store(uri)
        self.name = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)


def _by_place(places: DataFrame) -> DataFrame:
    """Neighbours in a shard together and in order, a shard over several tasks."""
    return places.repartition("shard", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("shard", "offset")


def header_columns(places: DataFrame, uri: str) -> DataFrame:
    """digest, width, height, depth: from the first bytes of each payload and nothing more."""

    def run(batch):
        store = Ranges(uri)
        digests, shards, offsets, _ = (c.to_pylist() for c in batch.columns)
        heads = [png_header(store.read(s, o, HEADER_BYTES)) for s, o in zip(shards, offsets)]
        return {"digest": digests} | {n: [h[k] for h in heads] for k, n in enumerate(("width", "height", "depth"))}

    return map_batches(_by_place(places.select("digest", "shard", "offset", "length")), run, "digest string, width int, height int, depth int")


def describe(samples: np.ndarray) -> str:
    """Features of 8-bit samples, in integers."""
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    mean = int(counts @ values) * 1000 // n
    square = int(counts @ (values * values)) * 1000 // n
    return f"mean={mean};square={square};kinds={int((counts > 0).sum())};low={int(counts[:32].sum())};high={int(counts[128:].sum())}"


def sample_columns(places: DataFrame, uri: str) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: from whole payloads, read back."""

    def run(batch):
        store = Ranges(uri)
        rows = []
        for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            data = store.read(shard, offset, length)
            own = hashlib.sha256(data).hexdigest()
            if own != digest:
                raise ValueError(f"{shard} at {offset} doesn't hold {digest}")
            payload = from_png(data)
            width, height, _ = png_header(data[:HEADER_BYTES])
            feature = f"{width}x{height};{describe(np.frombuffer(payload, np.uint8))}"
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), own, feature))
        names = ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return {n: [r[k] for r in rows] for k, n in enumerate(names)}

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(_by_place(places.select("digest", "shard", "offset", "length")), run, schema)


def media_table(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with (doc_id, n_bytes, digest), and the one place of each digest."""
    stored = materialize(store_texts(docs, uri, id_col, text_col), "media-rows")
    return stored.select("doc_id", "n_bytes", "digest"), materialize(one_place(stored), "media-places")


def op10_media(spark, sf_dir: str) -> DataFrame:
    """All documents as PNG payloads in tar shards, read back."""
    uri = new_path(spark, "media-shards")
    rows, places = media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri)
    heads = header_columns(places, uri)
    seen = sample_columns(places, uri).join(heads, "digest")
    return rows.join(seen, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth"
    )
