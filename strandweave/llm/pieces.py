"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut before each run of spaces; no piece of such a vocabulary crosses that
cut (checked when the model is read), so segments are encoded on their own. Within a
segment an agenda holds all adjacent pairs of symbols that form a piece, best score
first, then leftmost; the best pair is merged until none is left.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, whole_text

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Segments above this many characters aren't kept in the cache.
MAX_CACHED = 64
#: How many segments new to the cache are noted before they are held against the library.
VERIFIED_AT_ONCE = 20_000
#: The place of pairs that are no piece.
NEVER = 1 << 30


class MergeEncoder:
    """The vocabulary of one model, with the library beside it to check against."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        #: Place of a piece in the order of scores: 0 is the best, equal scores share a place.
        self.places = {lib.id_to_piece(i): order[lib.get_score(i)] for i in plain}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in self.ids):
            raise ValueError("a piece has a space behind another character: texts can't be cut before spaces")
        if lib.normalize("  A Ａ\n\t") != f"{SPACE * 3}A{SPACE}Ａ\n\t":
            raise ValueError("only models without normalisation and with a space put before texts are handled")
        self.decimals = [str(i) for i in range(n)]
        self.cache = BoundedCache(150_000)

    def merge(self, segment: str) -> list[str]:
        """The pieces (or single characters) that the agenda leaves."""
        return self._merge_short(segment) if len(segment) <= MAX_CACHED else self._merge_long(segment)

    def _merge_short(self, segment: str) -> list[str]:
        """The agenda as a list by position: for words, finding its best entry by min() beats a heap."""
        symbols, place = list(segment), self.places.get
        agenda = [place(a + b, NEVER) for a, b in zip(segment, segment[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)  # the leftmost of equal scores
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = place(symbols[i - 1] + symbols[i], NEVER)
            if i < len(agenda):
                agenda[i] = place(symbols[i] + symbols[i + 1], NEVER)
        return symbols

    def _merge_long(self, segment: str) -> list[str]:
        """The agenda as a heap of (place, left, right, piece); entries whose symbols have changed are skipped."""
        symbols: list[str | None] = list(segment)
        n, places = len(symbols), self.places
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(k, i, i + 1, p) for i in range(n - 1) if (k := places.get(p := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
            for a, b in ((before[left], left), (left, nxt)):
                if a >= 0 and b < n and (k := places.get(p := symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, (k, a, b, p))
        return [s for s in symbols if s is not None]

    def segment_ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(segment):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:  # a single character without a piece falls back to its bytes
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
        return out

    def entries(self, text: str, new: list | None = None) -> list[bytes]:
        """The ids of each segment as packed 32-bit numbers. ``new`` gets (segment, ids) of those that the cache didn't have."""
        if not text:
            return []
        cache, out = self.cache, []
        newer = cache.newer
        for segment in SEGMENT.findall(SPACE + text.replace(" ", SPACE)):
            if (entry := newer.get(segment)) is None and (entry := cache.get(segment)) is None:
                entry = array("I", self.segment_ids(segment)).tobytes()
                if len(segment) <= MAX_CACHED:
                    cache.keep(segment, entry)
                if new is not None:
                    new.append((segment, entry))
            newer = cache.newer
            out.append(entry)
        return out

    def verify_some(self, new: list[tuple[str, bytes]], least: int = 0) -> None:
        """Verify and forget the noted segments once there are more than ``least``, so a batch never holds many."""
        if len(new) > least:
            self.verify(new)
            new.clear()

    def encode(self, text: str, new: list | None = None) -> list[int]:
        return unpacked(self.entries(text, new))

    def verify(self, new: list[tuple[str, bytes]]) -> None:
        """Hold the agenda's ids of these segments, put one after the other, against the library's."""
        text = "".join([s for s, _ in new])[1:].replace(SPACE, " ")
        if new and unpacked([x for _, x in new]) != (self.library.encode(text) if text else [self.ids[SPACE]]):
            raise ValueError("the agenda and the library differ on the words of a batch")


def unpacked(entries: list[bytes]) -> list[int]:
    return np.frombuffer(b"".join(entries), np.uint32).tolist()


@functools.lru_cache(maxsize=2)
def encoder(model_file: str) -> MergeEncoder:
    return MergeEncoder(model_file)


def slices(texts: pd.Series, rows: int = 256) -> Iterator[pd.Series]:
    """A batch in parts: what is made of a part goes back to Spark before the next is begun."""
    for a in range(0, len(texts), rows):
        yield texts.iloc[a : a + rows]


def piece_ids(text: Column | str, model_file: str) -> Column:
    """array<int> of the ids of each text (null: empty)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(model_file)
        for texts in batches:
            new: list[tuple[str, bytes]] = []
            for part in slices(texts):
                rows = []
                for text in part:
                    rows.append(enc.encode(text, new))
                    enc.verify_some(new, VERIFIED_AT_ONCE)
                enc.verify_some(new)
                yield pd.Series(rows)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(whole_text(text))


def decoded(ids: Column | str, model_file: str) -> Column:
    """The text that the library's decode gives for an array of ids (null: empty)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lib = encoder(model_file).library
        for rows in batches:
            yield pd.Series([lib.decode([int(i) for i in r]) if r is not None else "" for r in rows], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(F.col(ids) if isinstance(ids, str) else ids)


DIGEST = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"


def piece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document, in one pass.

    Null texts count as empty and have no ids. Repeated rows give repeated results; an
    empty table stays empty; other columns are dropped. Very long texts are encoded
    segment by segment, so time grows with length.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(model_file)
        decimal = enc.decimals.__getitem__
        for texts in batches:
            new: list[tuple[str, bytes]] = []
            for part in slices(texts):
                rows = []
                for text in part:
                    ids = enc.encode(text, new)
                    listed = ",".join(map(decimal, ids))
                    back = enc.library.decode(ids) if ids else ""
                    enc.verify_some(new, VERIFIED_AT_ONCE)
                    rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                enc.verify_some(new)
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.select("doc_id", F.pandas_udf(run, DIGEST)(whole_text()).alias("d")).select("doc_id", "d.*")


ENCODED = "struct<ids:array<int>,n_tokens:long,decoded_sha256:string>"


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """The documents without their texts, with ``ids``, ``n_tokens`` and the digest of the decoded text.

    Null texts count as empty and have an empty array. Repeated rows give repeated
    results, an empty table stays empty, texts of any length are encoded whole. Other
    columns stay; those named like an added one give way.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(model_file)
        for texts in batches:
            new: list[tuple[str, bytes]] = []
            for part in slices(texts):
                rows = []
                for text in part:
                    packed = np.frombuffer(b"".join(enc.entries(text, new)), np.uint32)
                    back = enc.library.decode(packed.tolist()) if len(packed) else ""
                    enc.verify_some(new, VERIFIED_AT_ONCE)
                    rows.append((packed.astype(np.int32), len(packed), hashlib.sha256(back.encode()).hexdigest()))
                enc.verify_some(new)
                yield pd.DataFrame(rows, columns=["ids", "n_tokens", "decoded_sha256"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "decoded_sha256")]
    made = docs.select(F.struct(*rest).alias("row"), F.pandas_udf(run, ENCODED)(whole_text()).alias("encoded"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in rest], "encoded.*")
