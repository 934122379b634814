"""The registered queries that SQL can't express, over whole tables, against plain versions of their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline
from devquarry.llm import gif, kneser_ney, registry, sentencepiece_bpe, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def remainder(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def run(spark, name):
    return [r.asDict() for r in registry.queries()[name](spark, SF).collect()]


def test_op4(spark):
    tokens = {r["doc_id"]: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")), None] for r in table("documents")}
    counts = Counter(w for i, own in tokens.items() if remainder(i, 5) != 1 for w in own)
    n, v = sum(counts.values()), len(counts)
    found = run(spark, "op4_kneser_ney")
    assert len(found) == len(tokens)
    for r in found:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(r["doc_id"], 5) == 1, len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op6(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table("documents")}
    found = run(spark, "op6_gif")
    assert len(found) == len(texts)
    for r in found:
        raw = texts[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = gif.store(raw)
        lines = [payload[i : i + 64 * gif.FRAME_ROWS] for i in range(0, len(payload), 64 * gif.FRAME_ROWS)]
        grey = [sum(b >> 6 == k for b in payload) for k in range(4)]
        wanted = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(lines)};ms={100 * len(lines)};grey={','.join(map(str, grey))}")
        assert tuple(r[k] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == wanted


def test_op6_frames(spark):
    raw = b"payload" * 50
    files = spark.createDataFrame([(1, bytearray(gif.store(raw))), (2, None)], "key long, media binary")
    found = gif.frames(files).collect()
    assert [(r.key, r.frame, r.start_cs, r.width) for r in found] == [(1, 0, 0, 64)]
    assert bytes(found[0].rgba)[::4][: len(raw)] == raw and sum(found[0].histogram) == found[0].width * found[0].height


def test_op8(spark):
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in table("documents")}
    found = run(spark, "op8_packing")
    assert {r["doc_id"]: r["n_tokens"] for r in found} == sizes and len({(r["bucket"], r["batch_id"], r["slot"]) for r in found}) == len(sizes)
    # no other choice of 16 upper ends pads less: dynamic programming over all distinct lengths
    lengths = sorted(Counter(sizes.values()).items())
    rows = [0]
    for _, k in lengths:
        rows.append(rows[-1] + k)
    best = [u * rows[i + 1] for i, (u, _) in enumerate(lengths)]
    for _ in range(15):
        best = [min([best[i], *(best[j] + u * (rows[i + 1] - rows[j + 1]) for j in range(i))]) for i, (u, _) in enumerate(lengths)]
    assert sum(r["boundary"] for r in found) == best[-1]


def test_op9(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table("labels")}
    found = run(spark, "op9_toxicity")
    assert len(found) == len(table("documents"))
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.trained(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in table("documents")}
    for r in found[::7]:
        z = model.bias + math.fsum(model.weights.get(f, 0.0) for w in toxicity.words_of(text[r["doc_id"]]) for f in toxicity.features_of(w))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-12)
    assert any(labels.values())


def test_held_out_toxicity(spark):
    """On rows that were never learnt from, most toxic ones are found and clean ones are left alone."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [r for r in registry.queries()["op9_toxicity"](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = [r for r in held if labels[r.doc_id]], [r for r in held if not labels[r.doc_id]]
    better = sum(a.score > b.score for a in toxic for b in clean) / max(len(toxic) * len(clean), 1)
    assert better > 0.93 and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_op10(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = run(spark, "op10_sentencepiece")
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_digests_of_nulls(spark):
    model = sentencepiece_bpe.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    rows = spark.createDataFrame([(None, "a"), (1, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in sentencepiece_bpe.digests(rows, model).collect())[1] == (1, 1)
    nothing = rows.limit(0)
    assert sentencepiece_bpe.digests(nothing, model).count() == gif.digests(gif.stored(nothing)).count() == toxicity.score(nothing, toxicity.Model()).count() == 0


def test_maps_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MAPS", 5)
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i % 7} x") for i in range(300)], "doc_id long, text string")
    model = kneser_ney.train(docs, 2, shard_bytes=64)
    arrays = kneser_ney.Arrays(model)
    import numpy as np

    words = kneser_ney.tokens(__import__("pyarrow").record_batch([[f"w{i}" for i in range(300)]], ["text"]))[0]
    counts = arrays.find("words", 0, words, "counts")
    assert len(arrays.maps) <= 6 and model.shards > 50 and (counts[:-1:2] > 0).all() and counts.dtype == np.int64


def test_pipeline_by_stages(spark):
    """The whole pipeline is its stages one after the other: toxicity by the model, deduplication by plain code, every row packed once."""
    docs = corpus_pipeline.documents(spark, SF)
    model = toxicity.trained(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in table("documents") if model.score(r["text"], {}) < 0.7}
    last = {t or "": max(i for i, u in rows.items() if (u or "") == (t or "")) for t in set(rows.values())}
    rows = {i: rows[i] for i in last.values()}
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    own = {i: i for i in rows}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for a in sorted(rows):
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                own[y] = x
    rows = {i: t for i, t in rows.items() if root(i) == i}
    first, sizes = {}, {}
    for i in sorted(rows):
        w = WORD.findall(rows[i] or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows.items():
        w = WORD.findall(t or "")
        gone = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        sizes[i] = len(w) - len(gone)
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in found} == sizes and len(found) == len(sizes)
