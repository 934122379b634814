"""Repeated byte strings by suffix arrays over shards of the corpus.

1. Every ``span``-byte string has a synchronising place: where the hash of the next ``gram`` bytes is the least
   within it. Equal strings have it at equal offsets, so only texts around equal grams need comparing.
   Consecutive strings with one place are a row: the gram and a hash of all bytes that the strings cover.
   Rows that several places share whole are repeats. A gram with rows of several kinds is open.
2. Open rows' bytes are dealt to shards, by the least gram of their neighbourhood, so that alike stretches
   meet whole, and by parts of it where it has more rows than a shard holds. Each shard sorts the suffixes
   of its bytes (Larsson-Sadakane refinement), takes common prefixes (Kasai) and so finds all strings that
   repeat within it.
3. Grams in several shards: each shard gives its distinct strings as a sorted array of 128-bit values, dealt
   by value; arrays meet pairwise by binary search.

Bytes are those of UTF-8; null texts are empty. Texts shorter than ``span`` keep everything. Each row is a
document, told apart by its id and a 64-bit hash of its text: rows of one id and different texts keep their own
spans, and rows that repeat an id and its text repeat each other's strings, so both lose them. Rows without id
keep everything and cause no removal. A very long text is read by one task; its open stretches go to shards like
others'. Only the id and the text are read, so further columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_A, STEP, Bytes, as_long, cut, delete, documents, mix, powers, shared_dir, slices, small_batches, told_by_key, version
from .recompression import BACK, few

#: Bytes of a shard, rows of one route that go to one shard, and how many neighbours a route looks at on either side.
SHARD, ROWS, REACH = 1 << 20, 1 << 11, 4
#: Tasks that shards are dealt to, at most: a shard's cost is not its bytes, so tasks are not merged by bytes.
TASKS = 1 << 14


# -- suffix arrays -----------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, as far as their first ``depth`` values tell, and each place's rank.

    Larsson-Sadakane: what is sorted by h values is refined to 2h by the rank of the suffix h further on, and
    groups of one are never touched again. Suffixes that agree in ``depth`` values share a rank.
    """
    n = len(data)
    # the first eight values at once, in one number
    wide = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    bits = max(int(data.max()) + 1 if n else 1, 1).bit_length()
    h = max(min(64 // bits, 8), 1)
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = key << np.uint64(bits) | wide[i : i + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    fresh = np.ones(n + 1, bool)
    fresh[1:-1] = key[1:] != key[:-1]
    heads = np.flatnonzero(fresh).astype(np.int32)
    rank = np.full(n + h, -1, np.int32)  # past the end comes first
    rank[order] = np.repeat(heads[:-1], np.diff(heads))  # a group's rank is the place of its first
    while h < depth:
        sizes = np.diff(heads)
        open_groups = sizes > 1
        if not open_groups.any():
            break
        heads, sizes = heads[:-1][open_groups], sizes[open_groups]
        if len(rank) < n + h:
            rank = np.concatenate([rank[:n], np.full(h, -1, np.int32)])
        # pairs are compared and swapped, larger groups are sorted
        first = heads[sizes == 2]
        left, right = order[first], order[first + 1]
        low, high = rank[left + h], rank[right + h]
        turn = np.flatnonzero(low > high)
        order[first[turn]], order[first[turn] + 1] = right[turn], left[turn]
        told = first[low != high]
        heads, sizes = heads[sizes > 2], sizes[sizes > 2]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum(), dtype=np.int32) + np.repeat((heads - begin).astype(np.int32), sizes)
        own = order[at]
        after = rank[own + h]
        refined = np.argsort(np.repeat(heads.astype(np.int64) << 32, sizes) + after)
        own, after = own[refined], after[refined]
        order[at] = own
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = after[1:] != after[:-1]
        new[begin] = True
        # ranks change once all groups have been compared
        rank[order[told + 1]] = told + 1
        starts = np.flatnonzero(new)
        rank[own] = np.repeat(at[starts[:-1]], np.diff(starts))
        fresh[told + 1] = True
        fresh[at[starts[:-1]]] = True
        heads = np.flatnonzero(fresh).astype(np.int32)
        h *= 2
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """lcp[i] of the suffixes order[i - 1] and order[i], which must be in full order; ``most`` at most.

    Kasai's bound, that a suffix shares at most one value less than the suffix before it in the text, lets all
    places be tested in strides: a place whose predecessor shares ``most`` + k needs no comparison.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    wide = np.zeros(n + 1, np.uint64)  # four values at once
    for i in range(4):
        wide[:n] |= padded[i : i + n] << np.uint64(16 * i)
    anchors = np.arange(0, n, 16)
    for begin in (anchors, np.setdiff1d(np.arange(n), anchors, assume_unique=True)):
        # a lower bound from the anchor before: its common prefix less the distance
        floor = np.maximum(shared[begin // 16 * 16] - begin % 16, 0)
        left = before[begin]
        live = np.flatnonzero(left >= 0)
        at, other, length = begin[live], left[live], floor[live]
        while len(at):
            ok = length + 4 <= most
            ok[ok] = wide[np.minimum(at[ok] + length[ok], n)] == wide[np.minimum(other[ok] + length[ok], n)]
            a, b, have = at[~ok], other[~ok], length[~ok]
            for _ in range(4):  # the last values one by one
                more = (have < most) & (a + have < n) & (b + have < n)
                more[more] = padded[a[more] + have[more]] == padded[b[more] + have[more]]
                have = have + more
            shared[a] = np.minimum(have, most)
            at, other, length = at[ok], other[ok], length[ok] + 4
    return shared[order]


def repeated_starts(pieces: list[bytes], where: np.ndarray, span: int) -> list[np.ndarray]:
    """For each piece, which of its ``span``-byte strings start at several places: ``where`` is each piece's own place.

    Strings of overlapping pieces at one place are one string.
    """
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\0".join(pieces), np.uint8).astype(np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ends = (starts + sizes)[:-1]
    data[ends] = 0
    order, _ = suffix_array(data, len(data))  # in full: Kasai's bound needs suffixes in order beyond span
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)[: len(data)]
    offset = np.arange(len(data)) - starts[piece]
    fits = offset + span <= sizes[piece]
    place = where[piece] + offset
    # runs of suffixes with a common prefix of span bytes; a string that fits holds no separator
    lcp = common_prefixes(data, order, span)
    run = np.cumsum(~((lcp >= span) & fits[order]))
    inside = fits[order]
    run, own = run[inside], order[inside]
    out = np.zeros(len(data), bool)
    if len(run):
        run = np.unique(run, return_inverse=True)[1]
        low = np.full(run.max() + 1, np.iinfo(np.int64).max)
        high = np.full(run.max() + 1, -1)
        np.minimum.at(low, run, place[own])
        np.maximum.at(high, run, place[own])
        out[own] = (low < high)[run]
    return [out[a : a + max(n - span + 1, 0)] for a, n in zip(starts.tolist(), sizes.tolist())]


# -- rows of strings with one synchronising place ----------------------------------------------------------


class Strings:
    """Hashes of byte strings of a slice, by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(STEP, len(data)), out=self.sums[1:])
        self.back = powers(BACK, len(data) + 1)

    def of(self, begin, end) -> np.ndarray:
        length = np.asarray(np.asarray(end) - np.asarray(begin)).astype(np.uint64)
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + length * MIX_A)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
LOW = np.uint64((1 << 24) - 1)
ROW = "doc_id long, ver long, gram long, content long, place int, n int"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: of what is left of its block and what is right."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, ~np.uint64(0))
    blocks[:n] = values
    square = blocks.reshape(-1, width)
    right = np.minimum.accumulate(square, axis=1).ravel()
    left = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def string_rows(data: np.ndarray, at: np.ndarray, span: int, gram: int):
    """text, gram, content, place and number of strings of each row."""
    n = len(data)
    empty = (np.empty(0, np.int64),) * 5
    if n < span:
        return empty
    strings = Strings(data)
    begin = np.arange(n - gram + 1)
    hashes = mix((strings.sums[gram:] - strings.sums[:-gram]) * strings.back[: n - gram + 1])
    best = sliding_least(hashes & ~LOW | begin.astype(np.uint64) & LOW, span - gram + 1)[: n - span + 1]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(best)]
    real = np.arange(len(best)) + span <= at[text + 1]
    change = np.ones(len(best), bool)
    change[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(change & real)
    if not len(heads):
        return empty
    breaks = np.append(np.flatnonzero(change | ~real), len(best))
    tails = breaks[np.searchsorted(breaks, heads, "right")]
    spot = heads + (((best[heads] & LOW).astype(np.int64) - heads) & int(LOW))
    return text[heads], hashes[spot], strings.of(heads, tails - 1 + span), heads - at[text[heads]], tails - heads


def sketch(span: int, gram: int):
    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                texts = Bytes(part.column("text"))
                text, grams, content, place, n = string_rows(texts.data, texts.at, span, gram)
                if len(text):
                    own = pa.array(text)
                    yield pa.record_batch([part.column("doc_id").take(own), part.column("ver").take(own), as_long(grams), as_long(content), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "ver", "gram", "content", "place", "n"])

    return rows


ROUTED = "doc_id long, ver long, gram long, place int, n int, route long"


def routes(batches):
    """The open rows of each text with a route: the least gram of the row and its neighbours, so that alike stretches of texts go together."""
    for batch in batches:
        out = []
        for doc, ver, own in zip(batch.column("doc_id").to_pylist(), batch.column("ver").to_pylist(), batch.column("rows").to_pylist()):
            own.sort(key=lambda r: r["place"])
            gram = np.array([r["gram"] for r in own])
            place, n = (np.array([r[k] for r in own]) for k in ("place", "n"))
            stretch = np.cumsum(np.append(True, place[1:] != place[:-1] + n[:-1]))
            value = mix(gram.view(np.uint64))
            least = value.copy()
            for by in range(1, min(REACH, len(own) - 1) + 1):
                same = stretch[by:] == stretch[:-by]
                least[by:] = np.where(same, np.minimum(least[by:], value[:-by]), least[by:])
                least[:-by] = np.where(same, np.minimum(least[:-by], value[by:]), least[:-by])
            out.append((np.full(len(own), doc), np.full(len(own), ver), gram, place, n, least.view(np.int64)))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*out), (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64))], ["doc_id", "ver", "gram", "place", "n", "route"])


PIECE = "doc_id long, ver long, shard int, place int, spread binary, piece binary"


def pieces(span: int):
    """The bytes of the rows that a text has to show: adjacent rows of a shard are one piece. ``spread``: pairs (offset, n) of rows whose gram is in several shards."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                texts = Bytes(part.column("text"))
                data, out = texts.data.tobytes(), []
                for i, (doc, ver, own) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "ver", "rows")))):
                    own.sort(key=lambda r: r["place"])
                    base, held = int(texts.at[i]), []
                    for r in [*own, None]:
                        if held and (r is None or r["shard"] != held[-1]["shard"] or r["place"] != held[-1]["place"] + held[-1]["n"]):
                            a, b = held[0]["place"], held[-1]["place"] + held[-1]["n"] - 1 + span
                            spread = np.array([(h["place"] - a, h["n"]) for h in held if h["spread"]], np.int32)
                            out.append((doc, ver, held[0]["shard"], a, spread.tobytes(), data[base + a : base + b]))
                            held = []
                        held.append(r)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["doc_id", "ver", "shard", "place", "spread", "piece"])

    return rows


FOUND = "doc_id long, ver long, place int, n int, bucket int, strings binary"


def found_rows(doc, ver, place, n, bucket=(), strings=()) -> pa.Table:
    k, m = len(doc), len(bucket)
    return pa.table([
        pa.array(np.concatenate([np.asarray(doc, np.int64), np.zeros(m, np.int64)])), pa.array(np.concatenate([np.asarray(ver, np.int64), np.zeros(m, np.int64)])), pa.array(np.concatenate([np.asarray(place, np.int32), np.zeros(m, np.int32)])),
        pa.array(np.concatenate([np.asarray(n, np.int32), np.zeros(m, np.int32)])), pa.array(np.concatenate([np.full(k, -1, np.int32), np.asarray(bucket, np.int32)])), pa.array([None] * k + list(strings), pa.binary()),
    ], ["doc_id", "ver", "place", "n", "bucket", "strings"])


def runs_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of True begin, and their lengths."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def shard(span: int, buckets: int):
    """A shard's repeats; and for grams in several shards their strings, sorted and each once, for each bucket of values (bucket >= 0)."""

    def repeats(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        docs, vers = table.column("doc_id").to_numpy(), table.column("ver").to_numpy()
        places = table.column("place").to_numpy().astype(np.int64)
        spread = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in table.column("spread").to_pylist()]
        texts = table.column("piece").to_pylist()
        where = (np.unique(np.stack([docs, vers], 1), axis=0, return_inverse=True)[1].ravel() << 32) + places
        doc, ver, place, n = [], [], [], []
        first, second, source, other, spot = [], [], [], [], []
        for i, marks in enumerate(repeated_starts(texts, where, span)):
            begin, length = runs_of(marks)
            doc += [docs[i]] * len(begin)
            ver += [vers[i]] * len(begin)
            place += (places[i] + begin).tolist()
            n += length.tolist()
            if len(spread[i]):  # those that repeat here too, as what other shards may have once
                once = np.concatenate([np.arange(a, a + k) for a, k in spread[i].tolist()])
                bytes_ = np.frombuffer(texts[i], np.uint8)
                first.append(Strings(bytes_).of(once, once + span))
                second.append(Strings(bytes_ ^ 0x5A).of(once, once + span))
                source.append(np.full(len(once), docs[i]))
                other.append(np.full(len(once), vers[i]))
                spot.append(places[i] + once)
        if not first:
            return found_rows(doc, ver, place, n)
        columns = [np.concatenate(c) for c in (first, second, source, other, spot)]
        order = np.unique(columns[0], return_index=True)[1]
        columns = [c[order].astype(np.uint64) for c in columns]
        ends = np.searchsorted((columns[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        filled = np.flatnonzero(np.diff(ends))
        return found_rows(doc, ver, place, n, filled, [np.stack([c[ends[b] : ends[b + 1]] for c in columns]).tobytes() for b in filled])

    return repeats


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted arrays (value, check, id, version, place, mark) as one; equal strings of different places are marked. By binary search."""

    def mark(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.searchsorted(x[0], y[0], "left")
        hit = at < len(x[0])
        there, here = x[:5, at[hit]], y[:5, hit]
        hit[hit] = (there[:2] == here[:2]).all(0) & (there[2:] != here[2:]).any(0)
        y[5][hit] = 1
        return at

    at = mark(a, b)
    mark(b, a)
    return np.insert(a, at, b, axis=1)


def across(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The strings of a bucket that several shards have."""
    arrays = []
    for x in table.column("strings").to_pylist():
        a = np.frombuffer(x, np.uint64).reshape(5, -1)
        arrays.append(np.concatenate([a, np.zeros((1, a.shape[1]), np.uint64)]))
    while len(arrays) > 1:  # pairwise, so that each string is merged as often as the number of shards has bits
        arrays = [meet(arrays[i], arrays[i + 1]) if i + 1 < len(arrays) else arrays[i] for i in range(0, len(arrays), 2)]
    own = arrays[0][:, arrays[0][5] > 0]
    return found_rows(own[2].view(np.int64), own[3].view(np.int64), own[4], np.ones(own.shape[1]))


def usual_gram(span: int) -> int:
    """Bytes of a gram: enough that texts with one gram nearly always share more than a phrase; 96 of 400."""
    return max(span * 6 // 25, 1)


def repeated_spans(docs: DataFrame, folder: str, span: int = 400, gram: int | None = None, rows_each: int = ROWS, shard_bytes: int = SHARD) -> DataFrame:
    """doc_id, ver, place and n: strings ``place`` to ``place`` + n - 1 of the row also start elsewhere."""
    own = docs.filter("doc_id is not null").select("doc_id", "ver", "text")
    gram = gram or usual_gram(span)
    table = cut(own.mapInArrow(sketch(span, gram), ROW), folder, "rows")
    total = table.count()
    again = table.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1")
    table = few(table, "gram", again, "gram")
    whole = table.groupBy("gram", "content").agg(F.min("doc_id").alias("first"), F.count("*").alias("k"))
    kinds = whole.groupBy("gram").agg(F.count("*").alias("kinds"))
    known = told_by_key(whole, kinds, "gram", "kinds", total).filter("k > 1 or kinds > 1")
    told = cut(table.join(known, ["gram", "content"]), folder, "told")
    spans = told.filter("k > 1").select("doc_id", "ver", "place", "n")
    open_rows = told.filter("kinds > 1 and (k = 1 or doc_id = first)")
    lists = open_rows.groupBy("doc_id", "ver").agg(F.collect_set(F.struct("gram", "place", "n")).alias("rows"))
    routed = cut(lists.mapInArrow(routes, ROUTED), folder, "routed")
    size = routed.agg(F.sum(F.col("n") * 2 + 1)).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    held = routed.count()
    sizes = routed.groupBy("route").agg(F.count("*").alias("own_rows"), F.ceil(F.count("*") / rows_each).cast("int").alias("parts"))
    sharded = told_by_key(routed, sizes, "route", "own_rows", held).withColumn("shard", F.pmod(F.xxhash64("route", F.pmod(F.xxhash64("doc_id", "ver"), F.col("parts"))), F.lit(shards)).cast("int"))
    spread = sharded.groupBy("gram").agg(F.count("*").alias("gram_rows"), (F.min("shard") < F.max("shard")).alias("spread"))
    shown = told_by_key(sharded, spread, "gram", "gram_rows", held).groupBy("doc_id", "ver").agg(F.collect_list(F.struct("place", "n", "shard", "spread")).alias("rows"))
    dealt = few(own, "doc_id", shown, "doc_id").join(shown, ["doc_id", "ver"]).mapInArrow(pieces(span), PIECE).repartition(min(shards, TASKS), "shard")
    found = cut(dealt.groupBy("shard").applyInArrow(shard(span, min(shards, 1 << 16)), FOUND), folder, "found")
    met = found.filter("bucket >= 0").groupBy("bucket").applyInArrow(across, FOUND)
    return spans.unionByName(found.filter("bucket < 0").select(*spans.columns)).unionByName(met.select(*spans.columns))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without(span: int):
    """Each text less the bytes of its strings."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                texts = Bytes(part.column("text"))
                removed, runs, kept = [], [], []
                for i, own in enumerate(part.column("spans").to_pylist()):
                    data = texts.data[texts.at[i] : texts.at[i + 1]]
                    keep = np.ones(len(data), bool)
                    if own:
                        edge = np.zeros(len(data) + 1, np.int64)
                        begin = np.array([s["place"] for s in own])
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, np.minimum(begin + np.array([s["n"] for s in own]) - 1 + span, len(data)), -1)
                        keep = np.cumsum(edge)[:-1] == 0
                    removed.append(int(len(data) - keep.sum()))
                    runs.append(len(runs_of(~keep)[0]))
                    kept.append(data[keep].tobytes())
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(texts.at)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows


def remove_repeats(docs: DataFrame, span: int = 400, gram: int | None = None, rows_each: int = ROWS, shard_bytes: int = SHARD) -> DataFrame:
    """The columns of KEPT for every row: the bytes that no repeated string covers."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version(F.col("text")).alias("ver"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(own, folder, span, gram, rows_each, shard_bytes)
    spans = cut(spans.groupBy("doc_id", "ver").agg(F.collect_set(F.struct("place", "n")).alias("spans")), folder, "spans")
    for name in ("rows", "told", "routed", "found"):
        delete(spark, f"{folder}/{name}")
    return own.join(spans, ["doc_id", "ver"], "left").mapInArrow(without(span), KEPT)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, s, md5(substring(x, 2 * s + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS s FROM d WHERE length(x) >= 800)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
edge AS (SELECT doc_id, s, CASE WHEN s <= max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM edge) GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
part AS (SELECT c.doc_id, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS t, max(b) AS last, sum(b - a) AS gone, count(*) AS n FROM cut c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(concat(coalesce(t, ''), substring(x, 2 * coalesce(last, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN part ON d.doc_id = part.doc_id
"""
