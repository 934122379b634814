"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Words are ASCII-lower-cased runs between the six ASCII separators; each text ends with an end token and
is preceded by ``order`` - 1 start tokens. The n-grams of a map task are summed and dealt by the n-gram's
own hash, so that no frequent word or context gathers in one task. A shard sums its n-grams, writes them as
sorted arrays of 64-bit hashes and counts below the shared folder, and passes on sums by context and by
suffix, from which the next lower order is made in the same way.

Null and empty texts are one end token. Without training texts every probability is uniform over one
unseen token. Repeated rows count as often as they occur. Different n-grams of equal 64-bit hash share
a count; among 10**9 n-grams a lookup errs with a probability under 10**-10. An empty table gives an
empty result, and rows with a null id are scored like others. A very long text
is scored at once by its task. Only the id and the text are read, so further columns can't clash.

The shared folder must be a path that workers can map (a ``file:`` folder or a mounted one).
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_A, STEP, Bytes, cut, delete, documents, fold_remainder, mix, release, shared_dir, slices, small_batches

START, END = np.uint64(0x51A27), np.uint64(0xE4D0)
#: Bytes of training text for each shard of the tables, and tokens that a map task sums at a time.
SHARD_BYTES, AT_ONCE = 8 << 20, 3_000_000
#: Files that a worker maps at a time; systems allow a process some 65,000.
MAPS = 8192
PART = "level int, table string, shard int, body binary"


# -- blocks of n-grams -------------------------------------------------------------------------------------


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams whose i-th words are ``words[i]``; a single word's is its own."""
    h = words[0]
    for w in words[1:]:
        h = mix(h * MIX_A + w * STEP + np.uint64(1))
    return h


def pack(words: list[np.ndarray], sums: list[np.ndarray]) -> bytes:
    """Columns as byte planes, the first as differences, which leaves runs of zeros to the compressor."""
    order = np.argsort(words[0])
    columns = [w[order] for w in words]
    columns[0] = np.diff(columns[0], prepend=np.uint64(0))
    columns += [s[order].astype(np.uint64) for s in sums]
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(body: bytes, n_columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(n_columns, 8, -1)
    columns = [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in raw]
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


def summed(words: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Hashes in order, and words and sums of each distinct n-gram."""
    h = gram_hash(words)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], [w[order[first]] for w in words], [np.add.reduceat(s[order], first) if len(first) else s for s in sums]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash, in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def dealt(level: int, table: str, words: list[np.ndarray], sums: list[np.ndarray], shards: int) -> list[tuple]:
    """Rows of PART: the distinct n-grams with their sums, by shard."""
    h, words, sums = summed(words, sums)
    at = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
    return [(level, table, i, pack([w[a:b] for w in words], [s[a:b] for s in sums])) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]


def rows(parts: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*parts)) or [[], [], [], []]
    return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["level", "table", "shard", "body"])


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, ends included, and the index of each text's first."""
    texts = Bytes(batch.column("text"), lower=True)
    texts.words()
    hashes = texts.word_hashes()
    counts = np.diff(texts.first) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(int(first[-1]), END)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = hashes
    return out, first


def history(stream: np.ndarray, first: np.ndarray, back: int) -> np.ndarray:
    """The token ``back`` places before each, a start token before a text's first."""
    out = np.full(len(stream), START)
    out[back:] = stream[: len(stream) - back]
    for i in range(back):
        at = first[:-1] + i
        out[at[at < first[1:]]] = START
    return out


# -- counting ----------------------------------------------------------------------------------------------


def grams(order: int, shards: int):
    """Rows of PART for words (level 0) and n-grams of the highest order."""

    def count(batches):
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        n = 0

        def flush():
            streams = [np.concatenate(x) for x in zip(*(columns for _, columns in held))]
            ones = np.ones(len(streams[-1]), np.int64)
            return rows(dealt(0, "words", [streams[-1]], [ones], shards) + dealt(order, "grams", streams, [ones], shards))

        for batch in batches:
            for part in slices(batch, most=1 << 22):
                stream, first = tokens(part)
                held.append((stream, [history(stream, first, b) for b in range(order - 1, 0, -1)] + [stream]))
                n += len(stream)
                if n >= AT_ONCE:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return count


def save(folder: str, table: str, level: int, shard: int, **arrays: np.ndarray) -> None:
    """Arrays as files; a repeated task replaces them whole."""
    for name, values in arrays.items():
        path = f"{folder}/{table}-{level}-{shard}-{name}.npy"
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, values)
        os.replace(own, path)


def smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32 if not len(values) or values.max() < 2**32 else np.uint64)


def merge(folder: str, shards: int):
    """Sums a shard: writes its arrays, gives a row of totals (table 'totals') and the parts of the next lower order."""

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        level, kind, shard = (k.as_py() for k in key)
        n_words = 1 if level == 0 else level - 1 if kind == "contexts" else level
        n_sums = 4 if kind == "contexts" else 1
        blocks = [unpack(x.as_py(), n_words + n_sums) for x in table.column("body")]
        columns = [np.concatenate(c) for c in zip(*blocks)]
        h, words, sums = summed(columns[:n_words], [c.astype(np.int64) for c in columns[n_words:]])
        if kind == "contexts":
            save(folder, kind, level, shard, keys=h, sums=np.stack(sums, 1))
            return pa.Table.from_batches([rows([])])
        c = sums[0]
        save(folder, kind, level, shard, keys=h, counts=smallest(c))
        totals = np.array([len(h), c.sum(), *(np.count_nonzero(c == k) for k in (1, 2, 3, 4)), np.count_nonzero(c > 2)], np.int64)
        parts = [(level, f"totals-{kind}", shard, totals.tobytes())]
        if level > 1:
            parts += dealt(level, "contexts", words[:-1], [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)], shards)
            parts += dealt(level - 1, "grams", words[1:], [np.ones(len(c), np.int64)], shards)
        return pa.Table.from_batches([rows(parts)])

    return merged


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times; k / 2 where these say nothing."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k) for d, k in zip(raw, (1.0, 2.0, 3.0)))


@dataclass
class Model:
    """Where the arrays are, and what is one number for all of a level."""

    folder: str
    order: int
    shards: int
    n_tokens: int  # N
    n_types: int  # V
    level: dict[int, tuple[tuple[float, float, float], int, float]]  # discounts, sum of counts, weight of the uniform share (level 1)


def local_path(uri: str) -> str:
    path = uri.removeprefix("file:") if uri.startswith("file:") else uri
    if ":" in path.split("/")[0]:
        raise ValueError(f"{uri}: the arrays are memory-mapped, so the shared folder must be mounted as a path")
    return "/" + path.lstrip("/")


def train(docs: DataFrame, order: int = 2, shard_bytes: int = SHARD_BYTES) -> Model:
    """A model of all texts of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_dir(spark)
    folder = local_path(f"{shared}/model")
    Path(folder).mkdir(parents=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    parts = docs.select("text").mapInArrow(grams(order, shards), PART)
    totals: dict[tuple[int, str], np.ndarray] = {}
    for level in range(order, 0, -1):
        done = parts.groupBy("level", "table", "shard").applyInArrow(merge(folder, shards), PART)
        done = cut(done, shared, f"level{level}")
        if level < order:
            delete(spark, f"{shared}/level{level + 1}")
        for lv, kind, body in add_totals(done.filter("table like 'totals-%'")):
            totals[lv, kind] = np.frombuffer(body, np.int64)
        parts = done.filter("table not like 'totals-%'")
        release(spark)
    finish = parts.filter("table = 'contexts'").groupBy("level", "table", "shard").applyInArrow(merge(folder, shards), PART)
    finish.write.format("noop").mode("overwrite").save()  # contexts of the lowest level above one, if any are left
    delete(spark, f"{shared}/level1")
    nothing = np.zeros(7, np.int64)
    words = totals.get((0, "totals-words"), nothing)
    found = {}
    for lv in range(1, order + 1):
        t = totals.get((lv, "totals-grams"), nothing)
        d = discounts(t[2:6])
        weight = (d[0] * t[2] + d[1] * t[3] + d[2] * t[6]) / t[1] if t[1] else 1.0
        found[lv] = (d, int(t[1]), float(weight))
    return Model(folder, order, shards, int(words[1]), int(words[0]), found)


def add_totals(df: DataFrame) -> list[tuple[int, str, bytes]]:
    """The totals' sums over shards, added by Spark: a few rows."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("body"))
        return pa.Table.from_batches([rows([(key[0].as_py(), key[1].as_py(), 0, sums.tobytes())])])

    return [(r["level"], r["table"], r["body"]) for r in df.groupBy("level", "table").applyInArrow(add, PART).collect()]


# -- scoring -----------------------------------------------------------------------------------------------


class Arrays:
    """The model's tables, each shard mapped when asked for; the MAPS that were used last stay mapped."""

    def __init__(self, model: Model):
        self.model, self.maps = model, OrderedDict()

    def shard(self, table: str, level: int, shard: int, name: str):
        key = (table, level, shard, name)
        if key not in self.maps:
            path = f"{self.model.folder}/{table}-{level}-{shard}-{name}.npy"
            self.maps[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
            if len(self.maps) > MAPS:
                self.maps.popitem(last=False)
        self.maps.move_to_end(key)
        return self.maps[key]

    def find(self, table: str, level: int, keys: np.ndarray, name: str, width: int = 0) -> np.ndarray:
        """The values of the keys, zeros for unknown ones. Keys are looked up in order, so reads of a map go forward."""
        asked, back = np.unique(keys, return_inverse=True)
        out = np.zeros((len(asked), width) if width else len(asked), np.int64)
        at = np.searchsorted(shard_of(asked, self.model.shards), np.arange(self.model.shards + 1))
        for i in np.flatnonzero(np.diff(at)).tolist():
            known = self.shard(table, level, i, "keys")
            if known is None or not len(known):
                continue
            own = asked[at[i] : at[i + 1]]
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[place] == own
            out[at[i] : at[i + 1]][hit] = self.shard(table, level, i, name)[place[hit]]
        return out[back]

    def discounted(self, level: int, count: np.ndarray) -> np.ndarray:
        d1, d2, d3 = self.model.level[level][0]
        return count - np.where(count > 2, d3, np.where(count == 2, d2, np.where(count == 1, d1, 0.0)))

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the last column's words after the others."""
        m = self.model
        _, total, weight = m.level[1]
        count = self.find("grams", 1, columns[-1], "counts")
        p = self.discounted(1, count) / max(total, 1) + weight / (m.n_types + 1)
        for level in range(2, m.order + 1):
            own = columns[-level:]
            sums = self.find("contexts", level, gram_hash(own[:-1]), "sums", 4)
            d1, d2, d3 = m.level[level][0]
            total = np.maximum(sums[:, 0], 1)
            share = (d1 * sums[:, 1] + d2 * sums[:, 2] + d3 * sums[:, 3]) / total
            count = self.find("grams", level, gram_hash(own), "counts")
            p = np.where(sums[:, 0] > 0, self.discounted(level, count) / total + share * p, p)
        return p


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of SCORES for every row; perplexity is 10 ** (-score / n_tokens)."""

    def scored(batches):
        arrays = Arrays(model)
        base = model.n_tokens + 0.5 * (model.n_types + 1)
        for batch in batches:
            for part in slices(batch, most=1 << 22):
                stream, first = tokens(part)
                columns = [history(stream, first, b) for b in range(model.order - 1, 0, -1)] + [stream]
                count = arrays.find("words", 0, stream, "counts")
                logs = np.log10(arrays.probabilities(columns))
                add = lambda x: pa.array(np.add.reduceat(x, first[:-1]))  # noqa: B023, E731
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(first)), add((count > 0).astype(np.int64)), add(np.log10((count + 0.5) / base)), add(logs)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, SCORES)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    model = train(docs.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
