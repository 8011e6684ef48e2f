"""Media columns: content-addressed payloads in tar shards, read back by ranges.

A text's bytes, padded with zeros to a positive multiple of 64, become the samples of
an 8-bit grey PNG of 64 columns. Each writing task stores a payload once, whatever
the number of copies it meets. Of the copies that different tasks stored, the index
keeps one, and every row carries that one's digest, shard, offset and length. Metadata
columns come from range reads of the headers alone.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import fresh_path, join_spread, shuffle_partitions, stored, whole_text

WIDTH = 64
SHARD_BYTES = 256 << 20
# Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
IHDR = struct.Struct(">IIBBBBB")
HEADER_BYTES = len(PNG_SIGNATURE) + 8 + IHDR.size


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image of 64 columns: each sample is a byte of the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = IHDR.pack(WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def read_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first bytes of an image."""
    if start[:8] != PNG_SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    width, height, bits, *_ = IHDR.unpack(start[16 : 16 + IHDR.size])
    return width, height, bits


def decode_png(data: bytes) -> bytes:
    """The samples of an image written by encode_png."""
    width, height, _ = read_header(data)
    at, packed = len(PNG_SIGNATURE), []
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(samples: np.ndarray) -> str:
    """A histogram of 16 levels, the mean and the mean step between neighbouring samples."""
    levels = np.bincount(samples >> 4, minlength=16)
    step = np.abs(np.diff(samples.astype(np.int16))).sum()
    return f"levels={','.join(map(str, levels))};mean={samples.mean():.4f};step={step / (len(samples) - 1):.4f}"


class TarShards:
    """Members appended to tar files of bounded size; tells where each payload's bytes begin."""

    def __init__(self, folder: str):
        self.folder, self.file, self.uri, self.offset = folder, None, "", 0

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.file is None or self.offset > SHARD_BYTES:
            self.close()
            self.file, self.uri = files.create(self.folder, f"media-{TaskContext.get().partitionId():05d}.tar")
            self.offset = 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.file.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
        place = self.uri, self.offset + len(head), len(data)
        self.offset += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
        return place

    def close(self) -> None:
        if self.file is not None:
            self.file.write(bytes(2 * tarfile.BLOCKSIZE))
            self.file.close()
            self.file = None


ROWS = "doc_id string, n_bytes long, digest string, shard string, at long, length long"


def store_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write each text's payload to tar shards and return a row a document: n_bytes, digest (sha256 of the payload), shard, at, length.

    Null texts count as empty (a payload of 64 zeros). Repeated rows share a payload;
    an empty table writes nothing. Texts aren't shuffled. The rows are written to the
    shared folder once, so shards are never written again for a lost executor's sake.
    """
    folder = folder or fresh_path(docs.sparkSession, "media")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, places = TarShards(folder), {}
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if (place := places.get(digest)) is None:
                    place = places[digest] = shards.add(f"{digest.hex()}.png", encode_png(payload))
                rows.append((doc_id, len(text.encode("utf-8", "surrogatepass")), digest.hex(), *place))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])
        shards.close()

    # The identifier travels as text, so that null ids and large ones pass pandas unharmed.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    return stored(rows.mapInPandas(write, ROWS).withColumn("doc_id", F.col("doc_id").cast("long")), "media-rows")


def index_of(rows: DataFrame) -> DataFrame:
    """One place a digest."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "at", "length")).alias("place")).select("digest", "place.*")


def header_columns(index: DataFrame) -> DataFrame:
    """Add width, height and bits by reading only the header bytes of each image."""
    return _read(index, "width int, height int, bits int", lambda file, at, length: read_header(files.read_range(file, at, HEADER_BYTES)))


def _features(file, at: int, length: int) -> tuple:
    stored_form = files.read_range(file, at, length)
    payload = decode_png(stored_form)
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored_form),
        hashlib.sha256(stored_form).hexdigest(), feature_of(np.frombuffer(payload, np.uint8)),
    )


def media_features(index: DataFrame) -> DataFrame:
    """Add what the whole payload gives: digests of payload and stored form, feature."""
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _read(index, added, _features)


def _read(index: DataFrame, added: str, read_one) -> DataFrame:
    names = [c.split()[0] for c in added.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, file = None, None
        for pdf in batches:
            rows = []
            for x in pdf.itertuples():
                if x.shard != uri:
                    uri, file = x.shard, files.open_random(x.shard)
                rows.append(read_one(file, int(x.at), int(x.length)))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    # Places, not media, are shuffled; the bytes are read where they are wanted.
    part = F.floor(F.col("at") / F.lit(16 << 20))
    spread = index.repartition(shuffle_partitions(index.sparkSession), "shard", part).sortWithinPartitions("shard", "at")
    return spread.mapInPandas(read, f"{', '.join(f'{c} {t}' for c, t in index.dtypes)}, {added}")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store, index, fill the metadata from headers, read payloads back and describe every document.

    Null texts count as empty (a payload of 64 zeros), repeated rows give repeated
    results and equal texts one place, texts of any length are stored whole, an empty
    table stays empty; other columns are dropped.
    """
    rows = store_media(docs)
    features = media_features(header_columns(index_of(rows)))
    return join_spread(rows.select("doc_id", "n_bytes", "digest"), features, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "digest", "shard", F.col("at").alias("offset"), "length"
    )
