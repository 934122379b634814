"""Long repeats of words by recompression.

Each round names runs of a symbol and then adjacent pairs whose left half drew one side of a coin and whose
right half the other. A name is a hash of its parts, so it is the same all over the corpus without a
dictionary being shuffled, and equal word sequences get equal symbols except near their ends. How near, each
symbol knows: it keeps the range of words on which its place in the parse depends. A window of ``span`` words
is represented by the highest symbol whose range it contains, the smallest name first, which is a function
of the window's words alone: every window has one (a word's range is itself).

Consecutive windows with one representative are a row: the symbol, and a hash of all words that the windows
cover. Rows of equal symbol and hash show repeats as a whole. Where rows share the symbol alone, at the ends
of repeats, their windows are compared one by one.

Null, empty and shorter texts have no windows and keep all words. Documents without id keep all words and
cause no removal. Rows that repeat an id are documents of their own, none of which precedes another: each
loses what starts in a smaller id, whether their texts are equal or not. Columns that are carried along are
one struct, so their names can't clash. A very long text is one task's words. An empty table gives an empty result. A window's identity is 128 bits, and a row's its id and a 64-bit hash of its text.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX_A, MIX_B, STEP, Bytes, as_long, cut, delete, documents, joined, mix, powers, shared_dir, slices, small_batches, told_by_key, version

#: More rounds give longer symbols, but fewer whole ones in a window of 50 words; at four they cover about three words.
ROUNDS = 4
BITMAP_BITS = 1 << 24
PLACE = np.uint64((1 << 24) - 1)
#: The inverse of STEP modulo 2 ** 64.
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


class Symbols:
    """A level of the parse: names, first words, and the ranges of words on which each symbol depends."""

    def __init__(self, name, start, low, high, text):
        self.name, self.start, self.low, self.high, self.text = name, start, low, high, text

    def grouped(self, heads: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        return Symbols(name, self.start[heads], low, high, self.text[heads])


def neighbours(x: Symbols, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether each symbol has a left and a right neighbour in its text, and how far these reach; a missing one reaches out of the text."""
    n = len(x.name)
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:] = x.text[1:] == x.text[:-1]
    right[:-1] = left[1:]
    low, high = np.roll(x.low, 1), np.roll(x.high, -1)
    low = np.where(left, low, first[x.text] - 1)
    high = np.where(right, high, first[x.text + 1] + 1)
    return left, right, low, high


def name_runs(x: Symbols, first: np.ndarray) -> Symbols:
    """Runs of equal symbols as one; a symbol depends on its neighbours, which end its run."""
    left, right, low, high = neighbours(x, first)
    again = np.zeros(len(x.name), bool)
    again[1:] = left[1:] & (x.name[1:] == x.name[:-1])
    if not again.any():
        return Symbols(x.name, x.start, np.minimum(x.low, low), np.maximum(x.high, high), x.text)
    heads = np.flatnonzero(~again)
    tails = np.append(heads[1:], len(x.name)) - 1
    k = (tails - heads + 1).astype(np.uint64)
    name = x.name[heads]
    name = np.where(k > 1, mix(name * MIX_B + k), name)
    return x.grouped(heads, name, np.minimum(x.low[heads], low[heads]), np.maximum(x.high[tails], high[tails]))


def name_pairs(x: Symbols, first: np.ndarray, number: int) -> Symbols:
    """Pairs of a left and a right symbol as one. A left symbol without partner depends on the next, a right one on the last."""
    left, right, low, high = neighbours(x, first)
    side = (mix(x.name ^ np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)).astype(bool)  # True: a right half
    pair = np.zeros(len(x.name), bool)
    pair[:-1] = right[:-1] & ~side[:-1] & side[1:]
    second = np.zeros(len(x.name), bool)
    second[1:] = pair[:-1]
    heads = np.flatnonzero(~second)
    paired = pair[heads]
    after = np.minimum(heads + 1, len(x.name) - 1)
    name = np.where(paired, mix(x.name[heads] * MIX_A + x.name[after] * STEP), x.name[heads])
    own_low = np.where(side, np.minimum(x.low, low), x.low)
    own_high = np.where(side, x.high, np.maximum(x.high, high))
    new_low = np.where(paired, np.minimum(x.low[heads], x.low[after]), own_low[heads])
    new_high = np.where(paired, np.maximum(x.high[heads], x.high[after]), own_high[heads])
    return x.grouped(heads, name, new_low, new_high)


def levels(words: np.ndarray, first: np.ndarray, rounds: int, span: int) -> list[Symbols]:
    """The words, and the symbols after each round."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n)
    out = [Symbols(words, at, at, at + 1, text)]
    for i in range(rounds):
        new = name_pairs(name_runs(out[-1], first), first, i)
        out.append(new)
    return out


def context(span: int) -> int:
    return span // 4


def representatives(found: list[Symbols], first: np.ndarray, n: int, span: int) -> np.ndarray:
    """For each window's first word the level, name bits and first word of its representative, in one number."""
    best = np.full(n + 1, ~np.uint64(0))
    last = np.repeat(first[1:] - span, np.diff(first))  # the last window of each word's text
    real = np.arange(n) <= last
    for level in range(len(found) - 1, -1, -1):
        x = found[level]
        todo = real & (best[:n] == ~np.uint64(0))
        if not todo.any():
            break
        # a symbol stands for itself and the words after it, so that frequent phrases are told apart
        high = x.high if level == 0 else np.maximum(x.high, x.start + context(span))
        begin = np.maximum(high - span, first[x.text])
        end = np.minimum(x.low, first[x.text + 1] - span)
        keep = np.flatnonzero((begin <= end) & (high - x.low <= span))
        if level == 0:  # words alone: only where nothing higher is in reach
            have = np.concatenate([[0], np.cumsum(todo)])
            keep = keep[have[end[keep] + 1] > have[begin[keep]]]
        value = np.uint64(15 - level) << np.uint64(60) | x.name[keep] >> np.uint64(28) << np.uint64(24) | x.start[keep].astype(np.uint64) & PLACE
        begin, end = begin[keep], end[keep]
        # minima over ranges: each goes to two overlapping stretches of a power of two, which are then halved
        power = np.floor(np.log2(end - begin + 1)).astype(np.int64)
        above = None
        for k in range(int(power.max()) if len(power) else 0, -1, -1):
            here = np.full(n + 1, ~np.uint64(0))
            own = power == k
            np.minimum.at(here, begin[own], value[own])
            np.minimum.at(here, end[own] - (1 << k) + 1, value[own])
            if above is not None:
                half = 1 << k
                np.minimum(here, above, out=here)
                np.minimum(here[half:], above[: n + 1 - half], out=here[half:])
            above = here
        if above is not None:
            best[:n][todo] = above[:n][todo]
    return best[:n]


class Windows:
    """Hashes of word sequences of a slice, by prefix sums."""

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ MIX_B) * powers(STEP, len(words)), dtype=np.uint64)])
        self.back = powers(BACK, len(words) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64) * MIX_A)


ROW = "doc_id long, ver long, anchor long, content long, place int, n int"


def window_rows(words: np.ndarray, first: np.ndarray, span: int, rounds: int):
    """text, anchor, content, first window's place in its text and number of windows, of each row."""
    n = len(words)
    found = levels(words, first, rounds, span)
    best = representatives(found, first, n, span)
    real = best != ~np.uint64(0)
    change = np.ones(n, bool)
    change[1:] = best[1:] != best[:-1]
    change[first[(first > 0) & (first < n)]] = True
    heads = np.flatnonzero(change & real)
    breaks = np.flatnonzero(change | ~real)
    tails = np.append(breaks, n)[np.searchsorted(breaks, heads, "right")]
    level = 15 - (best[heads] >> np.uint64(60)).astype(np.int64)
    # the place modulo 2 ** 24 is made whole by nearness: the symbol is inside the window
    spot = heads + (((best[heads] & PLACE).astype(np.int64) - heads) & int(PLACE))
    anchor = np.zeros(len(heads), np.uint64)
    windows = Windows(words)
    for k in np.unique(level).tolist():
        own = level == k
        name = found[k].name[np.searchsorted(found[k].start, spot[own])]
        anchor[own] = mix(name + np.uint64(k)) if k == 0 else mix(name ^ windows.of(spot[own], spot[own] + context(span)))
    text = found[0].text[heads]
    return text, anchor, windows.of(heads, tails - 1 + span), heads - first[text], tails - heads


def sketch(span: int, rounds: int):
    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                texts = Bytes(part.column("text"))
                texts.words()
                if not len(texts.starts):
                    continue
                text, anchor, content, place, n = window_rows(texts.word_hashes(), texts.first, span, rounds)
                own = pa.array(text)
                yield pa.record_batch([part.column("doc_id").take(own), part.column("ver").take(own), as_long(anchor), as_long(content), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "ver", "anchor", "content", "place", "n"])

    return rows


def single_windows(span: int):
    """The windows of the rows that a text must show one by one."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                texts = Bytes(part.column("text"))
                texts.words()
                windows = Windows(texts.word_hashes())
                lists = part.column("rows")
                begin, flat = [], lists.flatten()
                counts = np.diff(np.asarray(lists.offsets)[: len(lists) + 1])
                place, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("place", "n"))
                anchor = flat.field("anchor").to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(part.num_rows), counts)
                begin = np.repeat(place + texts.first[text], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text = np.repeat(text, n)
                own = pa.array(text)
                yield pa.record_batch([part.column("doc_id").take(own), part.column("ver").take(own), pa.array(np.repeat(anchor, n)), as_long(windows.of(begin, begin + span)), pa.array((begin - texts.first[text]).astype(np.int32))], ["doc_id", "ver", "anchor", "window", "place"])

    return rows


def few(df: DataFrame, key: str, of: DataFrame, of_key: str, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose key may be among ``of``'s, or with ``inside`` false the others, which surely are not.

    By a bitmap of BITMAP_BITS bits at most, so the broadcast has 2 MB however large ``of`` is.
    """
    bits = of.select(F.expr(f"xxhash64({of_key}) & {BITMAP_BITS - 1}L").alias("p")).groupBy(F.expr("p >> 6").alias("word")).agg(F.bit_or(F.expr("1L << cast(p & 63 as int)")).alias("bits"))
    marked = df.withColumn("p", F.expr(f"xxhash64({key}) & {BITMAP_BITS - 1}L")).withColumn("word", F.expr("p >> 6"))
    hit = F.expr("coalesce((bits >> cast(p & 63 as int)) & 1L, 0L) = 1L")
    return marked.join(F.broadcast(bits), "word", "inner" if inside else "left").filter(hit if inside else ~hit).select(*df.columns)


def repeated_spans(docs: DataFrame, folder: str, span: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, ver, place and n: windows ``place`` to ``place`` + n - 1 of the row also start in one of smaller id."""
    own = docs.filter("doc_id is not null").select("doc_id", "ver", "text")
    table = cut(own.mapInArrow(sketch(span, rounds), ROW), folder, "rows")
    total = table.count()
    again = table.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1")
    table = few(table, "anchor", again, "anchor")
    whole = table.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"))
    symbol = whole.groupBy("anchor").agg(F.count("*").alias("kinds"))
    known = told_by_key(whole, symbol, "anchor", "kinds", total)
    told = cut(table.join(known, ["anchor", "content"]).filter("doc_id > first or kinds > 1"), folder, "told")
    later = told.filter("doc_id > first").select("doc_id", "ver", "place", "n")
    open_rows = told.filter("doc_id = first").groupBy("doc_id", "ver").agg(F.collect_set(F.struct("anchor", "place", "n")).alias("rows"))
    texts = few(own, "doc_id", open_rows, "doc_id").join(open_rows, ["doc_id", "ver"])
    single = cut(texts.mapInArrow(single_windows(span), "doc_id long, ver long, anchor long, window long, place int"), folder, "windows")
    firsts = single.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    more = single.join(firsts, ["anchor", "window"]).filter("doc_id > first").select("doc_id", "ver", "place", F.lit(1).alias("n"))
    return later.unionByName(more)


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without(span: int, names: list[str]):
    """Each text less the words of its spans, with the columns ``names``."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                texts = Bytes(part.column("text"))
                texts.words()
                raw = texts.data.tobytes()
                removed, kept = [], []
                spans = part.column("spans").to_pylist()
                for i, own in enumerate(spans):
                    a, b = int(texts.first[i]), int(texts.first[i + 1])
                    keep = np.ones(b - a, bool)
                    if own:
                        edge = np.zeros(b - a + 1, np.int64)
                        begin = np.array([s["place"] for s in own])
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, np.minimum(begin + np.array([s["n"] for s in own]) - 1 + span, b - a), -1)
                        keep = np.cumsum(edge)[:-1] == 0
                    removed.append(int(b - a - keep.sum()))
                    kept.append(joined(raw, texts.starts[a:b][keep], texts.ends[a:b][keep]))
                made = {"n_words": pa.array(np.diff(texts.first)), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
                yield pa.record_batch([made[c] if c in made else part.column(c) for c in names], names)

    return rows


def remove_repeats(docs: DataFrame, span: int = 50, rounds: int = ROUNDS, carry: list[str] | None = None) -> DataFrame:
    """The columns of KEPT for every row: the words no window of which starts in a document of smaller id.

    With ``carry`` also the text as it was, and a struct ``carried`` of those columns, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), version(F.col("text")).alias("ver"), F.col("text").cast("string").alias("text")]
    if carry:
        columns.append(F.struct(*carry).alias("carried"))
    own = docs.select(*columns)
    # sets, as rows of equal id and text show each other's spans
    spans = cut(repeated_spans(own, folder, span, rounds).groupBy("doc_id", "ver").agg(F.collect_set(F.struct("place", "n")).alias("spans")), folder, "spans")
    for name in ("rows", "told", "windows"):
        delete(spark, f"{folder}/{name}")
    names = [c.split()[0] for c in KEPT.split(", ")]
    schema = T.StructType([T.StructField(c.split()[0], T.StringType() if c.endswith("string") else T.LongType()) for c in KEPT.split(", ")])
    if carry is not None:
        for c in own.columns[2:]:
            schema, names = schema.add(own.schema[c]), [*names, c]
    return own.join(spans, ["doc_id", "ver"], "left").mapInArrow(without(span, names), schema)


def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir), span=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hit),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
