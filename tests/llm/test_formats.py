"""Archives, images and tokens: exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from devquarry.llm import gif, sentencepiece_bpe, warc


def test_warc(spark, tmp_path):
    long = "<p>" + "long page " * 40
    rows = [(3, "http://a/1", long), (1, None, long), (2, "http://a/ü\r\n", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (1, None, long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(pages, archive_bytes=700)
    found = warc.read_archives(archives).select(warc.page_number(warc.F.col("record_id")).alias("page"), "record_type", warc.page_number(warc.F.col("refers_to")).alias("ref"), "payload_bytes", "payload").collect()
    got = sorted((r.page or 0, r.record_type, r.ref, r.payload_bytes) for r in found)
    n = len(long)
    assert got == sorted([(0, "revisit", 1, n), (1, "response", None, n), (1, "response", None, n), (2, "revisit", 1, n), (3, "revisit", 1, n), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (7, "response", None, 0)])
    for i, r in enumerate(archives.collect()):
        (tmp_path / f"{i}.warc.zst").write_bytes(r.archive)
    assert warc.read_archives(warc.binary_files(spark, str(tmp_path))).count() == len(rows)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_dictionary_and_damage():
    rng = random.Random(1)
    word = [f"word{i}" for i in range(300)]
    records = [warc.format_record(f"<urn:x-page:{i}>", "u", p := " ".join(rng.choice(word) for _ in range(900)).encode(), __import__("hashlib").sha256(p).hexdigest(), None) for i in range(60)]
    data = warc.join_archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.split_archive(data)) == records
    for bad in (data[:-3], data[: len(data) // 2], data[:6], data + b"junk"):
        with pytest.raises(warc.BadArchive):
            list(warc.split_archive(bad))
    good = records[0]
    for bad in (good[:-4], good + b"x", good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"word1", b"worx1", 1), b"", good.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)
    assert list(warc.split_archive(zstandard.compress(good))) == [good]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([2, 3, 8]))
def test_code_streams(data, bits):
    data = bytes(b & (1 << bits) - 1 for b in data)
    for stream in (gif.compress(data, bits), gif.literal(data, bits)):
        assert gif.expand(stream, bits, len(data)) == data


def test_gif_rules():
    red, blue = np.array([[255, 0, 0], [0, 0, 255], [0, 255, 0], [9, 9, 9]], np.uint8), np.array([[0, 0, 255]] * 4, np.uint8)
    one, two = np.zeros((9, 8), np.uint8), np.array([[0, 1], [1, 0]], np.uint8)
    frames = [gif.Frame(one, delay=5), gif.Frame(two, 1, 1, blue, 7, 3, transparent=1), gif.Frame(two, 0, 0, None, 1, 2, interlaced=True), gif.Frame(two, 6, 7, transparent=0)]
    shown = list(gif.decode(gif.encode(8, 9, frames, red)))
    assert [(a, b) for a, b, _ in shown] == [(0, 5), (5, 7), (12, 1), (13, 10)]
    assert shown[1][2][1, 1].tolist() == [0, 0, 255, 255] and shown[1][2][1, 2].tolist() == [255, 0, 0, 255]
    assert shown[2][2][1, 1].tolist() == [255, 0, 0, 255] and shown[2][2][0, 1].tolist() == [0, 0, 255, 255]
    assert shown[3][2][0, 0, 3] == 0 and shown[3][2][7, 7].tolist() == [0, 0, 255, 255] and shown[3][2][7, 6].tolist() == [255, 0, 0, 255]
    assert gif.histogram(shown[0][2])[48] == 72
    for bad in (b"", b"GIF89a", gif.encode(8, 9, frames, red)[:60]):
        with pytest.raises(gif.BadGif):
            list(gif.decode(bad))


def test_gif_payloads(spark, docs, texts):
    found = {r.doc_id: r for r in gif.digests(gif.stored(docs)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (found[i].n_bytes, found[i].payload_bytes, found[i].payload_sha256) == (len(raw), len(padded), __import__("hashlib").sha256(padded).hexdigest())
    big = bytes(range(256)) * 2500
    assert gif.load(gif.store(big))[0] == big and len(gif.load(gif.store(big))[1]) == 3


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.Tokenizer(sentencepiece_bpe.model_bytes(path)), sentencepiece.SentencePieceProcessor(model_file=path)


ALPHABET = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "ß", "一", "\U0001f600", "the", "ing", " of", "aaaa", "    ", "\0", "ộ", "⁇", "1", "...", "==", "—", "ا", "x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join) | st.text(max_size=40))
def test_tokens(both, text):
    own, library = both
    assert own.encode(text) == library.encode(text)
    assert own.decode(own.encode(text)) == library.decode(library.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 31999) | st.integers(1, 258), max_size=12))
def test_any_ids(both, ids):
    own, library = both
    assert own.decode(ids) == library.decode(ids)


def test_token_columns(spark, docs, texts, both):
    model = sentencepiece_bpe.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    ids = sentencepiece_bpe.encoded(docs, model)
    found = {r.doc_id: r.ids for r in ids.collect()}
    assert found == {i: [*both[1].encode(t or ""), 2] for i, t in texts}
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decoded(ids, model).collect()}
    assert back == {i: both[1].decode(found[i]) for i, _ in texts}


def test_stored_files_are_full_lzw():
    text = b"one line and the same line " * 20000
    media = gif.store(text)
    assert len(media) < len(text) / 4
    assert gif.load(media)[0][: len(text)] == text


def test_no_texts_and_null_ids(spark, docs, nothing):
    from devquarry.llm import toxicity

    model = sentencepiece_bpe.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    assert sentencepiece_bpe.digests(nothing, model).count() == 0
    assert gif.digests(gif.stored(nothing)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    unnamed = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b")], "doc_id long, text string")
    rows = sentencepiece_bpe.digests(unnamed, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "None", "None"] and len({r.ids_sha256 for r in rows}) == 2
