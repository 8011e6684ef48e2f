"""Sorted-string-table shards of token ids.

A shard holds blocks of entries in ascending key order, then a sparse index with one
entry a block, a Bloom filter over the keys and a footer of fixed size:

    block   zlib of entries: shared key bytes u8, own key bytes u8, value bytes u32, own key bytes, value
    index   for each block: last key 8 bytes, offset u64, length u32, tokens before it in the shard u64
    bloom   bits, 10 for each key
    footer  FOOTER: offsets and sizes of index and bloom, documents, tokens, bytes a token, magic

A key is the document id as 8 big-endian bytes with the sign bit flipped, so byte
order is number order.
"""

from __future__ import annotations

import bisect
import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import fresh_path, shuffle_partitions, stored, whole_text

MAGIC = b"SWSSTAB1"
FOOTER = struct.Struct("<QQQQQQB8s")
INDEX = struct.Struct("<8sQIQ")
ENTRY = struct.Struct("<BBI")
BLOCK_BYTES = 1 << 16
#: A shard is closed at this many bytes or documents, so writers and filters stay bounded.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 4_000_000
BLOOM_BITS_A_KEY, BLOOM_HASHES = 10, 7
NULL_KEY = -(2**63)


def key_of(doc_id: int) -> bytes:
    return (doc_id + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    return int.from_bytes(key, "big") - 2**63


def _bloom_places(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits of each key (as unsigned 64-bit numbers): double hashing with two multiplicative mixes."""
    with np.errstate(over="ignore"):
        a = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        b = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
        a, b = a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(32))
        steps = np.arange(BLOOM_HASHES, dtype=np.uint64)
        return (a[:, None] + steps[None, :] * b[:, None]) % np.uint64(n_bits)


class ShardWriter:
    """Takes (doc_id, ids) in ascending order; holds one block, the index and the keys in memory."""

    def __init__(self, folder: str, name: str, width: int):
        self.file, self.uri = files.create(folder, name)
        self.width, self.offset, self.n_docs, self.n_tokens = width, 0, 0, 0
        self.index: list[bytes] = []
        self.keys = array("Q")
        self.first = self.last = None
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.block_bytes, self.previous, self.tokens_before = [], 0, b"", self.n_tokens

    def add(self, doc_id: int, value: bytes) -> None:
        key = key_of(doc_id)
        shared = len(os.path.commonprefix([self.previous, key]))
        self.block += [ENTRY.pack(shared, 8 - shared, len(value)), key[shared:], value]
        self.block_bytes += ENTRY.size + 8 - shared + len(value)
        self.previous = key
        self.keys.append(doc_id + 2**63)
        self.first = doc_id if self.first is None else self.first
        self.last = doc_id
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()

    def full(self) -> bool:
        return self.offset >= SHARD_BYTES or self.n_docs >= SHARD_DOCS

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.index.append(INDEX.pack(self.previous, self.offset, len(data), self.tokens_before))
            self._write(data)
        self._new_block()

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.offset += len(data)

    def close(self) -> None:
        self._flush()
        index_at, index = self.offset, b"".join(self.index)
        self._write(index)
        n_bits = max(64, -(-len(self.keys) * BLOOM_BITS_A_KEY // 8) * 8)
        bits = np.zeros(n_bits, np.uint8)
        if self.keys:
            bits[_bloom_places(np.array(self.keys, np.uint64), n_bits).astype(np.int64)] = 1
        bloom_at, bloom = self.offset, np.packbits(bits).tobytes()
        self._write(bloom)
        self._write(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.n_docs, self.n_tokens, self.width, MAGIC))
        self.file.close()


class ShardReader:
    """Random access to one shard by range reads."""

    def __init__(self, uri: str):
        self.file = files.open_random(uri)
        footer = files.read_range(self.file, self.file.size() - FOOTER.size, FOOTER.size)
        index_at, index_bytes, self.bloom_at, self.bloom_bytes, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of this format")
        self.index = list(INDEX.iter_unpack(files.read_range(self.file, index_at, index_bytes)))
        self.last_keys = [x[0] for x in self.index]

    def entries(self, block: int) -> Iterator[tuple[int, bytes]]:
        _, offset, length, _ = self.index[block]
        data, at, key = zlib.decompress(files.read_range(self.file, offset, length)), 0, b""
        while at < len(data):
            shared, own, size = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + own]
            at += own
            yield id_of(key), data[at : at + size]
            at += size

    def may_hold(self, doc_id: int) -> bool:
        """Whether the Bloom filter has the identifier: one byte is read for each hash."""
        for place in _bloom_places(np.array([doc_id + 2**63], np.uint64), 8 * self.bloom_bytes)[0].tolist():
            if not files.read_range(self.file, self.bloom_at + place // 8, 1)[0] >> (7 - place % 8) & 1:
                return False
        return True

    def lookup(self, doc_id: int) -> list[bytes]:
        """The values of an identifier: Bloom filter, binary search in the block index, then its blocks."""
        out: list[bytes] = []
        if not self.index or not self.may_hold(doc_id):
            return out
        key = key_of(doc_id)
        for block in range(bisect.bisect_left(self.last_keys, key), len(self.index)):
            found = [v for k, v in self.entries(block) if k == doc_id]
            out += found
            if self.last_keys[block] > key:
                break
        return out


#: Texts on which a model's ids must be those of the words: white space of all kinds, marks, quotes, numbers, capitals, accents, letters whose lower case is longer, special strings.
PROBES = (
    "One two, three.Four!  Five?\tSix\nseven; EIGHT: it's don't we'll 'quoted' \"q\" a-b c_d e/f 1,234.5 50% x2y",
    "naïve Ünï ß İstanbul ﬁne e\u0301a ½ 日本 語 русский,текст. \u00a0nbsp\u3000wide 😀!? a\u200db",
    "<|endoftext|> <|startoftext|>x ,lead trail, ,, ... a,b;c:d!e?f.g",
)


class WordTokens:
    """Token ids of texts by the tokenizers library, word by word with a bounded cache.

    The model's normaliser and splitter never join across a space, tab or line end, so
    the ids of a text are the ids of its words one after the other. Nor do they join a
    letter and a following mark of MARKS, so "word," shares the entry of "word"; plain
    ASCII words share that of their lower case.
    """

    MARKS = ",.!?;:"
    #: Words kept from batch to batch, twice over; longer ones than MAX_CACHED are forgotten after their batch.
    LIMIT, MAX_CACHED = 400_000, 64

    def __init__(self, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_file)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        for probe in PROBES:
            if self.batch([probe])[0] != self.pack(self.tokenizer.encode(probe, add_special_tokens=False).ids):
                raise ValueError("only models are handled whose ids of a text are those of its words, one after the other")
        self.newer = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _parts(self, word: str) -> tuple[str, ...]:
        """The word as entries whose ids, one after the other, are its ids."""
        core = word.rstrip(self.MARKS)
        if not core or not core[-1].lower().isalpha():  # a letter whose lower case adds a mark joins what follows
            return (word,)
        plain = core.lower() if core.isascii() and core.isalpha() else core
        return (plain, word[len(core) :]) if len(core) < len(word) else (plain,)

    def _learn(self, words: set[str]) -> None:
        """Put the ids of these words into the newer cache."""
        newer, older = self.newer, self.older
        split = {}
        for w in words:
            if (v := older.get(w)) is not None:
                newer[w] = v
            else:
                split[w] = self._parts(w)
        new = []
        for part in {p for parts in split.values() for p in parts}.difference(newer):
            if (v := older.get(part)) is not None:
                newer[part] = v
            else:
                new.append(part)
        # Words of letters only are one piece of the splitter each: encoded in one call and cut where a word ends.
        letters = [p for p in new if p.isalpha() and p.lower().isalpha()]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, self.dtype)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
        if len(stops) == len(letters):
            raw, begin = ids.tobytes(), 0
            for part, stop in zip(letters, stops.tolist(), strict=True):
                newer[part] = raw[begin:stop]
                begin = stop
            new = [p for p in new if p not in newer]
        for part, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            newer[part] = self.pack(e.ids)
        for w, parts in split.items():
            newer[w] = b"".join([newer[p] for p in parts])

    def batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.newer) >= self.LIMIT:
            self.older, self.newer = self.newer, {}
        rows = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        unknown = set().union(*rows).difference(self.newer)
        self._learn(unknown)
        out = [b"".join(map(self.newer.__getitem__, row)) for row in rows]
        for w in unknown:
            if len(w) > self.MAX_CACHED:
                for key in {w, *self._parts(w)}:
                    self.newer.pop(key, None)
        return out


@functools.lru_cache(maxsize=2)
def tokens(model_file: str) -> WordTokens:
    return WordTokens(model_file)


def token_batches(model_file: str, texts: list[str], chars: int = 500_000) -> Iterator[bytes]:
    """Packed ids of the texts, some at a time, so that few words are held at once."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield from tokens(model_file).batch(part)
            part, size = [], 0
    if part:
        yield from tokens(model_file).batch(part)


MANIFEST = "shard long, uri string, first_id long, last_id long, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, model_file: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode each text, append ``end_id`` and write range-partitioned shards; return the manifest.

    The manifest has one row a shard, in ascending order of ids, with the number of
    tokens in all shards before it (``shard_start``). Null texts count as empty (the end
    id alone). A null doc_id is kept as the least 64-bit number. Repeated ids stay, in
    an order fixed by their texts. Texts of any length are encoded whole. An empty table
    gives an empty manifest; other columns are dropped.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "sstable")

    def finished(writer: ShardWriter, number: int) -> pd.DataFrame:
        writer.close()
        row = (number, writer.uri, writer.first, writer.last, writer.n_docs, writer.n_tokens)
        return pd.DataFrame([row], columns=[c.split()[0] for c in MANIFEST.split(", ")])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, number = None, TaskContext.get().partitionId() << 24
        for pdf in batches:
            width = np.dtype(tokens(model_file).dtype).itemsize
            end = tokens(model_file).pack([end_id])
            for doc_id, value in zip(pdf["doc_id"], token_batches(model_file, pdf["text"].tolist()), strict=True):
                if writer and writer.full():
                    yield finished(writer, number)
                    writer, number = None, number + 1
                writer = writer or ShardWriter(folder, f"shard-{number:012d}", width)
                writer.add(int(doc_id), value + end)
        if writer:
            yield finished(writer, number)

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_KEY)).cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = stored(ordered.mapInPandas(write, MANIFEST), "manifest")
    # One row a shard: this window sorts as many rows as there are output files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf.itertuples():
                reader, at = ShardReader(shard.uri), int(shard.shard_start)
                dtype = np.uint16 if reader.width == 2 else np.uint32
                for block in range(len(reader.index)):
                    rows = []
                    for doc_id, value in reader.entries(block):
                        ids = np.frombuffer(value, dtype)
                        rows.append((None if doc_id == NULL_KEY else doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                    yield out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))  # a null doesn't turn the others into doubles

    spread = manifest.select("shard", "uri", "shard_start").repartition(shuffle_partitions(manifest.sparkSession), "shard")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids): the entries of the wanted doc_ids, found by the manifest's ranges, each shard's Bloom filter and a binary search of its block index.

    Identifiers that aren't there give no row, those with several entries several; null
    and repeated ones count once. The manifest (one row a shard) is held by each task.
    """
    shards = manifest.select("uri", "first_id", "last_id", "shard").orderBy("shard").toPandas()
    uris, firsts, lasts = shards["uri"].tolist(), shards["first_id"].to_numpy(np.int64), shards["last_id"].to_numpy(np.int64)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy(np.int64)
            # An identifier with many entries may reach over several shards.
            low, high = np.searchsorted(lasts, ids, side="left"), np.searchsorted(firsts, ids, side="right")
            counts = np.maximum(high - low, 0)
            shard = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pd.DataFrame({"shard": shard, "doc_id": np.repeat(ids, counts)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, reader = None, None
        for pdf in batches:
            rows = []
            for shard, doc_id in zip(pdf["shard"], pdf["doc_id"], strict=True):
                if shard != at:
                    at, reader = shard, ShardReader(uris[shard])
                dtype = np.uint16 if reader.width == 2 else np.uint32
                rows += [(doc_id, np.frombuffer(v, dtype).astype(np.int32)) for v in reader.lookup(int(doc_id))]
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    keys = wanted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    spread = keys.mapInPandas(places, "shard long, doc_id long").repartition(shuffle_partitions(wanted.sparkSession), "shard").sortWithinPartitions("shard", "doc_id")
    return spread.mapInPandas(read, "doc_id long, ids array<int>")
