"""Whole queries against twins written in plain loops."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash

from strandweave.llm import files, imatch, pii, quality, queries, sstable

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def terms(text):
    return {w.lower().strip(imatch.EDGES) for w in text.split()} - {""}


def mixed(h, k):
    m = (h ^ xxhash.xxh64_intdigest(f"subset {k}")) * 0x9E3779B97F4A7C15 % 2**64
    return (m ^ (m >> 29)) * 0xBF58476D1CE4E5B9 % 2**64


def fingerprint(text, lexicon):
    every = sorted(xxhash.xxh64_intdigest(t) for t in terms(text))
    parts = []
    for k in range(imatch.SUBSETS):
        kept = [h for h in every if h in lexicon and mixed(h, k) >> (64 - imatch.RATES[k % 8]) == 0]
        parts.append(xxhash.xxh32_hexdigest(b"".join(h.to_bytes(8, "little") for h in kept)) if kept else "-" * 8)
    if set(parts) == {"-" * 8}:
        return "=" + hashlib.blake2b(b"".join(h.to_bytes(8, "little") for h in every), digest_size=16).hexdigest()
    return "".join(parts)


def likeness(a, b):
    if a == b:
        return 1.0
    if "=" in (a[0], b[0]):
        return 0.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    some = [p for p in pairs if p != ("-" * 8, "-" * 8)]
    return sum(x == y for x, y in some) / len(some)


def test_fingerprints_of_exact_lexicon(spark, docs):
    n, counts = len(docs), Counter(t for text in docs.text for t in terms(text))
    low, high = imatch.IDF_BAND
    lexicon = {xxhash.xxh64_intdigest(t) for t, c in counts.items() if low <= math.log(n / c) <= high}
    found = np.frombuffer(imatch.lexicon(spark.read.parquet(f"{DATA}/documents.parquet")), np.uint64)
    assert set(found.tolist()) == lexicon and len(lexicon) > 50
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, DATA).collect()}
    texts = docs.text.tolist()
    made = [fingerprint(t, lexicon) for t in texts]
    for i, doc_id in enumerate(docs.doc_id):
        after = (i + 1) % n
        half = len(texts[i]) // 2
        changed = fingerprint(texts[i][: len(texts[i]) - half] + texts[after][:half], lexicon)
        r = got[doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (made[i], changed)
        assert r.near_edited == pytest.approx(likeness(made[i], changed)) and r.near_next == pytest.approx(likeness(made[i], made[after]))


def test_frequencies_are_handed_on_in_parts(spark, docs, monkeypatch):
    every = imatch.added(np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.array([1, 2], np.uint64), np.array([2, 9], np.uint64)])
    more = imatch.added(*every, [np.array([2, 3], np.uint64)])
    assert more[0].tolist() == [1, 2, 3, 9] and more[1].tolist() == [1, 3, 1, 1]
    monkeypatch.setattr(imatch, "LARGEST_LEXICON", 3)
    with pytest.raises(ValueError, match="band"):
        imatch.lexicon(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_order_of_extreme_and_hot_ids(spark):
    rows = [(i, f"text {i}") for i in (2**63 - 1, -(2**63) + 1, 0, 5, 7)] + [(3, f"hot {i}") for i in range(300)] + [(None, "no id")]
    out = imatch.edit_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], np.uint64(xxhash.xxh64_intdigest(r[1].encode(), seed=42)).astype(np.int64)))
    expected = Counter()
    for i, (doc_id, text) in enumerate(order):
        half, after = len(text) // 2, order[(i + 1) % len(order)][1]
        expected[doc_id, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == expected
    placed = imatch.with_next_bucket(spark.createDataFrame(rows, "doc_id long, text string"), 16).where("doc_id = 3 AND NOT guest")
    assert placed.select("bucket").distinct().count() >= 8


def test_media_by_the_texts(spark, docs):
    got = {r.doc_id: r for r in queries.op4_media_columns(spark, DATA).collect()}
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        data, r = text.encode(), got[doc_id]
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest()
        stored = files.read_range(files.open_random(r.shard), r.offset, r.length)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_bytes == len(stored)
        assert stored[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">IIBB", stored[16:26]) == (64, len(payload) // 64, 8, 0) and (r.width, r.height, r.bits) == (64, len(payload) // 64, 8)
        size = struct.unpack(">I", stored[33:37])[0]
        lines = zlib.decompress(stored[41 : 41 + size])
        assert b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65)) == payload
        levels = Counter(b >> 4 for b in payload)
        steps = sum(abs(a - b) for a, b in zip(payload, payload[1:], strict=False)) / (len(payload) - 1)
        assert r.feature == f"levels={','.join(str(levels[i]) for i in range(16))};mean={sum(payload) / len(payload):.4f};step={steps:.4f}"
    assert len({(r.shard, r.offset) for r in got.values()}) == docs.text.nunique()


def test_all_entries_and_lookups(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_MODEL)
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    got = {r.doc_id: r for r in queries.op8_sstable(spark, DATA).collect()}
    start = 0
    for doc_id in docs.doc_id:
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[doc_id]), zlib.crc32(np.array(ids[doc_id], "<u4").tobytes()))
        start += r.n_tokens
    manifest = sstable.write_shards(spark.read.parquet(f"{DATA}/documents.parquet"), queries.WORD_MODEL, 2)
    wanted = spark.createDataFrame([(int(d),) for d in docs.doc_id[::3]] + [(-5,), (10**12,), (None,), (int(docs.doc_id[0]),)], "doc_id long")
    found = {r.doc_id: list(r.ids) for r in sstable.lookup(manifest, wanted).collect()}
    assert found == {int(d): ids[d] for d in docs.doc_id[::3]}


def test_shards_of_bounded_size(spark, tmp_path):
    writer = sstable.ShardWriter(f"file://{tmp_path}/s", "x", 2)
    for i in range(5):
        writer.add(7, bytes([i, 0]) * 3)
    assert not writer.full()
    writer.n_docs = sstable.SHARD_DOCS
    assert writer.full()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="models"):
        sstable.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.standard_normal((n, 48)))
    model = quality.QualityModel(np.zeros(1), np.zeros((1, 48)), np.repeat(unit(400), 2, axis=0), (np.arange(800) % 3 > 0).astype(float), 0.6)
    vectors = unit(512)
    block = model.vote(vectors)
    assert all(model.vote(vectors[i : i + 1])[0] == block[i] for i in range(512))


def test_nearest_breaks_ties_by_place():
    rng = np.random.default_rng(2)
    c = rng.integers(0, 6, (200, 40)) / 6
    near = quality.nearest(c, 15)
    for row, got in zip(c, near, strict=True):
        assert got.tolist() == sorted(sorted(range(40), key=lambda j: (-row[j], j))[:15])


def shingles(text):
    w = text.lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def copies_of(rows):
    """How often each document is to appear, by the Poisson distribution summed directly."""
    counts = Counter("null" if s is None else s for s in rows.source)
    shares = {s: n**0.5 for s, n in counts.items()}
    out = {}
    for r in rows.itertuples():
        rate = shares[r.source] * len(rows) / (sum(shares.values()) * counts[r.source])
        u, k, p = (int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, 0, math.exp(-rate)
        total = p
        while total < u:
            k += 1
            p *= rate / k
            total += p
        out[r.doc_id] = k
    return out


def test_pipeline_by_loops(spark, docs):
    """From the classifier's decisions on, every stage by its definition."""
    predicted = {r.doc_id for r in queries.op10_quality(spark, DATA).collect() if r.predicted}
    rows = docs[docs.doc_id.isin(predicted)].reset_index(drop=True)
    sets, root = [shingles(t) for t in rows.text], list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and Fraction(both, len(sets[i] | sets[j])) >= Fraction(4, 5)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = rows[[find(i) == i for i in range(len(rows))]].reset_index(drop=True)
    rows["text"] = [pii.masked(t, pii.scored(t, pii.spans_of(t))) for t in rows.text]
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in rows.text)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    times = copies_of(rows)
    expected = Counter()
    for doc_id, text in zip(rows.doc_id, rows.text, strict=True):
        ids = library.encode(text)
        expected[doc_id, tuple(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += times[doc_id]
    got = Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == +expected


def test_pipeline_of_odd_rows(spark, odd, labels, none, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names through all stages, and an empty table."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, none):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = corpus_pipeline.stored(stage(spark, now, str(tmp_path)), "odd")
            if k < 4:
                assert now.columns == table.columns
            if table is none:
                assert now.count() == 0
