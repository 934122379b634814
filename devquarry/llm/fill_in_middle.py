"""Fill-in-middle forms of texts, cut at seeded code points found in an index of distinct texts.

1. Rows whose text's fingerprint no other row has, as a bitmap of at most ``BITMAP_BITS`` bits shows, hold a
   distinct text of their own; their texts never move.
2. The other rows are grouped by the text itself, so equality is verified and not left to a hash. Each distinct
   text gets the byte places of its code points, once, as an Elias-Fano list; texts and lists are written to the
   shared folder.
3. Documents meet their text's row by fingerprint, or by fingerprint and text where different texts share one.
   A group of more than a thousandth of the rows is split: its text is repeated for each part, its documents
   are dealt over the parts. Each document then selects the two boundaries that its own seed asks for.

Null texts count as empty, and empty texts are plain. A null id is seeded as an empty one. Repeated rows come
back as often as they came, each alike. A very long text is one cell and one list of about a quarter of its
size. An empty table gives an empty result. Columns other than the id and the text are not read, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, cut, documents, shared_dir, small_batches
from .exact_dedup import BITMAP_BITS, repeated_bitmap

#: Sentinels of the prefix, the suffix and the middle, and the shares in hundredths of plain texts and of suffix-first forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM = 10, 20
#: Bytes of the upper bit vector for which one rank is kept.
BLOCK = 64

LIST = "n long, low_bits int, low binary, high binary, ranks binary"


def boundary_list(raw: bytes) -> tuple[int, int, bytes, bytes, bytes]:
    """The number of code points, and the byte places of all of them and of the end as an Elias-Fano list.

    Each place is split into its ``low_bits`` lower bits, stored side by side, and the rest, stored in unary: bit
    ``rest + k`` of ``high`` is set for place k. ``ranks`` holds the set bits before each block of ``high``.
    """
    data = np.frombuffer(raw, np.uint8)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    low_bits = max((len(data) + 1) // len(places), 1).bit_length() - 1
    bits = np.zeros((len(data) >> low_bits) + len(places) + 1, np.uint8)
    bits[(places >> low_bits) + np.arange(len(places))] = 1
    high = np.packbits(bits, bitorder="little")
    high = np.append(high, np.zeros(-len(high) % BLOCK, np.uint8))
    ones = np.bitwise_count(high).reshape(-1, BLOCK).sum(1, dtype=np.int64)
    low = np.packbits((places[:, None] >> np.arange(low_bits)) & 1, bitorder="little")
    return len(places) - 1, low_bits, low.tobytes(), high.tobytes(), (np.cumsum(ones) - ones).tobytes()


def boundary(k: int, low_bits: int, low: bytes, high: bytes, ranks: bytes) -> int:
    """The byte place of code point ``k``: one search among the ranks, then the bits of one block."""
    before = np.frombuffer(ranks, np.int64)
    block = int(np.searchsorted(before, k, "right")) - 1
    bits = np.unpackbits(np.frombuffer(high, np.uint8, BLOCK, block * BLOCK), bitorder="little")
    rest = block * BLOCK * 8 + int(np.flatnonzero(bits)[k - before[block]]) - k
    first = k * low_bits
    part = int.from_bytes(low[first >> 3 : (first + low_bits + 7) >> 3], "little") >> (first & 7)
    return rest << low_bits | part & ((1 << low_bits) - 1)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds its text's boundary list to each row."""
    for batch in batches:
        lists = [boundary_list(raw) for raw in batch.column("text").to_pylist()]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        added = [pa.array([x[i] for x in lists], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "n", "low_bits", "low", "high", "ranks"])


def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each row's text at the boundaries that its seeds select."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in ("text", "form", "h1", "h2", "n", "low_bits", "low", "high", "ranks")}
        sizes, middles, outputs = [], [], []
        for raw, form, h1, h2, n, *own in zip(*rows.values()):
            if form == "plain":
                sizes.append(None), middles.append(None), outputs.append(raw)
                continue
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            at, to = boundary(a, *own), boundary(b, *own)
            sizes.append(a), middles.append(b - a)
            if form == "psm":
                outputs.append(b"".join((p, raw[:at], s, raw[to:], m, raw[at:to])))
            else:
                outputs.append(b"".join((s, raw[to:], p, raw[:at], m, raw[at:to])))
        text = pc.cast(pa.array(outputs, pa.binary()), pa.string(), safe=False)
        columns = [batch.column("doc_id"), batch.column("n"), batch.column("form"), pa.array(sizes, pa.int64()), pa.array(middles, pa.int64()), text]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def seeds(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of the id's seeded SHA-256, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, h3: Column, h4: Column) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= 100 - PLAIN)
    return F.when(plain, "plain").when(h4 % 100 < SPM, "spm").otherwise("psm")


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output, the formed text, of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("fp", fingerprint(F.col("text"))).withColumn("place", F.expr(f"fp & {BITMAP_BITS - 1}L"))
    base = base.withColumn("word", F.expr("place >> 6"))
    bitmap = F.broadcast(repeated_bitmap(base.select("fp", "place")))  # 1 MB at most
    told = base.join(bitmap, "word", "left").withColumn("shared", F.expr("coalesce((bits >> cast(place & 63 as int)) & 1L, 0L) = 1L"))

    def seeded(rows: DataFrame, text: str = "text") -> DataFrame:
        for i, h in enumerate(seeds(F.col("doc_id"), seed), 1):
            rows = rows.withColumn(f"h{i}", h)
        return rows.withColumn("form", form_of(F.col(text), F.col("h3"), F.col("h4"))).drop("h3", "h4")

    def as_bytes(rows: DataFrame) -> DataFrame:
        return rows.withColumn("text", F.col("text").cast("binary"))

    kind = base.schema["doc_id"].dataType.simpleString()
    alone = as_bytes(seeded(told.filter("not shared").select("doc_id", "text")))
    alone = alone.mapInArrow(listed, f"doc_id {kind}, text binary, h1 long, h2 long, form string, {LIST}")

    suspects = told.filter("shared").select("doc_id", "fp", "text")
    distinct = suspects.groupBy("fp", "text").agg(F.count("*").alias("size"))
    index = as_bytes(distinct).mapInArrow(listed, f"fp long, text binary, size long, {LIST}")
    index = cut(index, shared_dir(spark), "texts")
    share = max((index.agg(F.sum("size")).first()[0] or 0) // HEAVY, 1)
    clashing = index.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    clash = not clashing.isEmpty()
    by_hash = index.join(clashing, "fp", "left_anti") if clash else index

    # the parts of groups of more than a thousandth of the rows, which are fewer than HEAVY
    parts = F.ceil(F.col("size") / share).cast("int")
    heavy = F.broadcast(by_hash.filter(F.col("size") > share).select("fp", parts.alias("parts")))
    ids = suspects.join(clashing, "fp", "left_anti") if clash else suspects
    ids = seeded(ids).drop("text").join(heavy, "fp", "left")
    ids = ids.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = by_hash.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("size") > share, parts - 1).otherwise(0))))
    fields = ["doc_id", "text", "h1", "h2", "form", "n", "low_bits", "low", "high", "ranks"]
    met = ids.join(copies, ["fp", "part"]).select(*fields)
    if clash:
        rest = as_bytes(seeded(suspects.join(clashing, "fp", "left_semi")))
        met = met.unionByName(rest.join(index, ["fp", "text"]).select(*fields))
    return alone.select(*fields).unionByName(met).mapInArrow(formed, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was formed from; sentinels stand in no text that is cut, so each is found once."""
    def after(mark: str) -> Column:
        return F.split_part(output, F.lit(mark), F.lit(2))

    def head(mark: str) -> Column:
        return F.substring(F.split_part(output, F.lit(mark), F.lit(1)), 1 + len(PREFIX), 2**31 - 1)

    def side(rest: Column, i: int) -> Column:
        return F.split_part(rest, F.lit(MIDDLE), F.lit(i))

    psm = F.concat(head(SUFFIX), side(after(SUFFIX), 2), side(after(SUFFIX), 1))
    spm = F.concat(side(after(PREFIX), 1), side(after(PREFIX), 2), head(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM e),
g AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM g
"""
