"""Defined results for nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import public_tokenizers
import pytest

from strandweave.llm import chat, imatch, importance, jaccard, media, minhash, mixing, pieces, pii, quality, sstable, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SAMPLE = {
    "toxicity": lambda d, y: toxicity.toxicity_scores(d, y),
    "imatch": lambda d, y: imatch.edit_digests(d),
    "media": lambda d, y: media.media_digests(d),
    "jaccard": lambda d, y: jaccard.near_duplicates(d),
    "pieces": lambda d, y: pieces.piece_digests(d, PIECES),
    "pii": lambda d, y: pii.pii_digests(d),
    "sstable": lambda d, y: sstable.read_shards(sstable.write_shards(d, WORDS, 2)),
    "mixing": lambda d, y: mixing.mix(d),
    "importance": lambda d, y: importance.importance_digests(d, d.limit(2)),
    "minhash": lambda d, y: minhash.near_copies(d),
    "quality": lambda d, y: quality.quality_scores(d, y),
}


@pytest.mark.parametrize("name", SAMPLE)
def test_empty_table(none, labels, name):
    assert SAMPLE[name](none, labels).collect() == []


@pytest.mark.parametrize("name", [n for n in SAMPLE if n != "mixing"])
def test_a_row_for_each_row(odd, labels, name):
    out = SAMPLE[name](odd, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())


def test_no_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(odd, empty).collect()} == {0.5}
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(odd, empty).collect())


def test_scores_lie_in_range(odd, labels):
    for rows in (quality.quality_scores(odd, labels), toxicity.toxicity_scores(odd, labels)):
        for r in rows.collect():
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_filters_keep_columns(odd, labels):
    for out in (quality.keep_good(odd, labels), jaccard.one_of_each(odd), pii.mask_pii(odd)):
        assert out.columns == odd.columns
        assert {(r.uid, r.rep, r.row, r.bucket, r.mix_row, r.encoded) for r in out.collect()} == {("u", "r", "w", 1, 3, "e")}


def test_one_of_each(odd):
    kept = sorted(r.doc_id or 0 for r in jaccard.one_of_each(odd).collect())
    # 1 stands for its repeated row and for 6 (case), 2 for the texts without words.
    assert kept == [-5, 0, 1, 2, 5, 7, 8, 9]


def test_links(odd):
    found = {r.doc_id: r for r in jaccard.near_duplicates(odd).collect()}
    assert found[6].class_id == 1 and found[6].n_links == 2 and found[1].n_links == 2
    assert found[3].class_id == found[4].class_id == found[2].class_id == 2
    assert found[9].n_links == 0 and found[9].keep


def test_media_payloads(odd):
    by = {r.doc_id: r for r in media.media_digests(odd).collect()}
    assert by[2].payload_bytes == by[3].payload_bytes == 64 and by[2].n_bytes == 0
    assert by[2].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and by[2].tail_crc32 == zlib.crc32(bytes(64))
    assert by[5].n_bytes == len([r for r in odd.collect() if r.doc_id == 5][0].text)


def test_mixing_keeps_values(odd):
    out = mixing.mix(odd, power=1.0, total=60).collect()
    assert set(out[0].asDict()) == {*odd.columns, "mix_copy", "mix_key"}
    assert {(r.uid, r.mix_row) for r in out} == {("u", 3)}
    assert len({r.mix_copy for r in out if r.doc_id == 5}) == max(r.mix_copy for r in out if r.doc_id == 5)
    parts = [r.mix_key for r in out]
    assert parts == sorted(parts)


def test_mixing_weights(odd):
    out = mixing.mix(odd, weights={"src1": 1.0}, total=40).collect()
    assert {r.source for r in out} == {"src1"}


def test_chat_of_odd_turns(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", "<\\s> [INST] <s>"), (1, 2, "assistant", "<\\s> [INST] <s>"), (None, 5, None, "[SEP]"), (2, None, "assistant", "")],
        "conv_id long, turn long, role string, text string",
    ).selectExpr("*", "'x' AS formatted", "1 AS part", "2 AS turns")
    out = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(turns)).collect()}
    text = "<\\s> [INST] <s>"
    listed = "user\na\nuser\n\n" + f"assistant\n{text}\n" * 2
    assert out[1].n_turns == 4 and out[1].turns_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert out[1].loss_sha256 == hashlib.sha256((text * 2).encode()).hexdigest() and out[1].loss_chars == 2 * len(text)
    assert out[None].turns_sha256 == hashlib.sha256(b"\n[SEP]\n").hexdigest()
    assert out[2].loss_chars == 0 and out[2].n_turns == 1
    none = chat.chat_digests(chat.format_chats(turns.where("false"))).collect()
    assert none == []
