"""Near-duplicate classes: MinHash bands find candidates, odd sketches filter them, whole shingle sets confirm them.

1. Each text's set of ``width``-word shingles (ASCII lower case) gives MinHash values, which are banded, and
   an odd sketch: a bitmap in which each (position, value) sample flips one bit. Two sketches' XOR has about
   as many ones as the samples differ, which for alike sets is more precise than banding.
2. Rows with equal sets are one representative with members. Buckets of a band are never listed: each row
   is compared with hubs of its buckets, first the smallest id, then the largest.
3. What shares a bucket but is not yet in one component is compared pair by pair, sketch first, so no link
   is lost; nothing is compared within a component.
4. Rows with candidates also get an odd sketch of their whole set. The ones of two such sketches' XOR are no
   more than the sets' difference, so this filter loses nothing and for sets of up to some thousand
   shingles leaves little but links. Candidates that both sketches allow are confirmed on the whole sets; links join components.

A text with fewer words than ``width`` is one shingle; without words (or null) its set is empty, and it is
linked with nothing. Each row is a document: rows that repeat an id with another text have the component of
their own text, so a component always has a kept row, and rows that repeat id and text are alike. Rows without
id keep no class and stay. A very long text is one task's set of shingles. Only the id and the text are read, so
further columns can't clash. An empty table gives an empty result. Bands have as many values as leave a pair at
the threshold unseen with probability 4 in a million at most: five at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, MIX_A, STEP, Bytes, as_long, cut, delete, documents, mix, release, shared_dir, slices, small_batches, version
from .components import connected_components
from .recompression import few

SAMPLES, MISS = 160, 4e-6
#: Words, of 64 bits, of the odd sketch of the samples and of that of the whole set.
SKETCH, WHOLE = 8, 16
SHINGLES = f"doc_id long, id long, ver long, n_shingles long, fp1 long, fp2 long, {', '.join(f's{i} long' for i in range(SKETCH))}, bands array<long>"


def shingle_hashes(texts: Bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the index of each text's first."""
    texts.words()
    words, first = texts.word_hashes(), texts.first
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(at[-1]), np.uint64)
    long = np.repeat(counts >= width, n)
    starts = (np.arange(len(out)) - np.repeat(at[:-1], n)) + np.repeat(first[:-1], n)
    h = np.full(int(long.sum()), width, np.uint64)
    for i in range(width):
        h = mix(h * MIX_A + words[starts[long] + i])
    out[long] = h
    for k in np.flatnonzero((counts > 0) & (counts < width)).tolist():  # a short text is one shingle
        v = np.full(1, counts[k], np.uint64)
        for w in words[first[k] : first[k + 1]]:
            v = mix(v * MIX_A + w)
        out[at[k]] = v[0]
    return out, at


def sets_of(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    h, at = shingle_hashes(Bytes(part.column("text"), lower=True), width)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def band_rows(threshold: float) -> int:
    """Values of a band: the most that miss a pair at the threshold with probability MISS at most."""
    return max(r for r in range(1, SAMPLES + 1) if SAMPLES % r == 0 and (r == 1 or (1 - threshold**r) ** (SAMPLES // r) <= MISS))


def signatures(width: int, band: int):
    """The columns of SHINGLES; bands have ``band`` values each."""
    keys = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * STEP)
    odd = (keys << np.uint64(1)) | np.uint64(1)

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                sets = sets_of(part, width)
                sizes = np.array([len(x) for x in sets])
                full = np.flatnonzero(sizes)
                flat = np.concatenate([sets[i] for i in full] or [np.empty(0, np.uint64)])
                at = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                values = np.empty((len(full), SAMPLES), np.uint64)
                for lo in range(0, len(full), 64):  # stretches that stay in the processor's cache
                    begin, end = int(at[lo]), int(at[lo + 64]) if lo + 64 < len(full) else len(flat)
                    own, places = flat[begin:end], at[lo : lo + 64] - begin
                    for k in range(SAMPLES):
                        values[lo : lo + 64, k] = np.minimum.reduceat((own ^ keys[k]) * odd[k], places)
                bands = np.zeros((len(sets), SAMPLES // band), np.uint64)
                sketch = np.zeros((len(sets), SKETCH), np.uint64)
                fp = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    h = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), (len(full), bands.shape[1]))
                    for r in range(band):
                        h = mix(h * MIX_A + values[:, r::band])
                    bands[full] = h
                    bit = mix(values + keys) % np.uint64(64 * SKETCH)
                    cells = np.bincount((np.arange(len(full))[:, None] * 64 * SKETCH + bit.astype(np.int64)).ravel(), minlength=len(full) * 64 * SKETCH) & 1
                    sketch[full] = np.packbits(cells.astype(np.uint8).reshape(len(full), -1), axis=1, bitorder="little").view(np.uint64)
                    fp[full, 0] = np.add.reduceat(mix(flat), at)
                    fp[full, 1] = np.add.reduceat(mix(flat ^ STEP), at)
                yield pa.record_batch(
                    [*(part.column(c) for c in ("doc_id", "id", "ver")), pa.array(sizes.astype(np.int64)), as_long(fp[:, 0].copy()), as_long(fp[:, 1].copy()), *(as_long(sketch[:, i].copy()) for i in range(SKETCH)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))],
                    ["doc_id", "id", "ver", "n_shingles", "fp1", "fp2", *(f"s{i}" for i in range(SKETCH)), "bands"],
                )

    return rows


def shingle_sets(width: int):
    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                sets = sets_of(part, width)
                whole = np.stack([np.packbits((np.bincount((mix(x ^ MIX_A) % np.uint64(64 * WHOLE)).astype(np.int64), minlength=64 * WHOLE) & 1).astype(np.uint8), bitorder="little") for x in sets]).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), *(pa.array(whole[:, i].copy()) for i in range(WHOLE))], ["doc_id", "shingles", *(f"w{i}" for i in range(WHOLE))])

    return rows


def allowed(threshold: float):
    """SQL: whether two sketches (s0.. and t0..) allow a similarity of ``threshold``, six deviations given away.

    n samples of which a share d differs flip 2nd bits at most, of which m(1 - exp(-4nd / m)) / 2 stay apart.
    """
    m, n = 64 * SKETCH, SAMPLES
    d = 1 - threshold + 6 * (threshold * (1 - threshold) / n) ** 0.5
    ones = m / 2 * (1 - np.exp(-4 * n * d / m)) + 2 * m**0.5 / 2
    return " + ".join(f"bit_count(s{i} ^ t{i})" for i in range(SKETCH)) + f" <= {int(ones)}"


def numbered(docs: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """The rows (id, ver, text) with doc_id, a number of their own, and whether that is another than the id: only rows of a repeated id get a new one."""
    again = docs.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    again = cut(again.select("id"), folder, "repeated")
    if again.isEmpty():
        return docs.withColumn("doc_id", F.col("id")), False
    suspects = few(docs, "id", again, "id")
    clear = few(docs, "id", again, "id", inside=False).withColumn("doc_id", F.col("id"))
    top = docs.agg(F.max("id")).first()[0]
    texts = suspects.join(again, "id", "left_semi").select("id", "ver").distinct()
    texts = cut(texts.withColumn("new", F.monotonically_increasing_id() + F.lit(top) + 1), folder, "numbers")
    told = suspects.join(texts, ["id", "ver"], "left").withColumn("doc_id", F.coalesce("new", "id")).select(*clear.columns)
    return clear.unionByName(told), True


def classes_of(keyed: DataFrame, folder: str) -> DataFrame:
    """doc_id and rep, the least of the rows with an equal set. Only rows that share their set may move, and those of very frequent sets don't either."""
    key = ["fp1", "fp2", "n_shingles"]
    counted = cut(keyed.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).filter("k > 1"), folder, "classes")
    least = keyed.count() // HEAVY
    own = keyed.select("doc_id", *key)
    suspects = few(own, "fp1", counted, "fp1")
    heavy = F.broadcast(counted.filter(F.col("k") > least).select(*key, "rep"))  # fewer than HEAVY rows
    light = counted.filter(F.col("k") <= least).select(*key, "rep")
    out = few(own, "fp1", counted, "fp1", inside=False).select("doc_id", F.col("doc_id").alias("rep"))
    out = out.unionByName(suspects.join(heavy, key).select("doc_id", "rep"))
    out = out.unionByName(suspects.join(heavy, key, "left_anti").join(light, key, "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))
    return cut(out, folder, "members")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, ver, n_shingles, component_id and kept of every row; links have 100 * |A & B| >= percent * |A | B|. ``ver`` tells apart texts of one id."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), version(F.col("text")).alias("ver"), F.col("text").cast("string").alias("text"))
    own, renumbered = numbered(own, folder)
    table = cut(own.mapInArrow(signatures(width, band_rows(percent / 100)), SHINGLES), folder, "signatures")
    keyed = table.filter("doc_id is not null and n_shingles > 0")
    # one row for each set; equal sets are linked without being compared
    members = classes_of(keyed.dropDuplicates(["doc_id"]) if renumbered else keyed, folder)
    reps = keyed.join(members.filter("doc_id = rep").select("doc_id"), "doc_id").dropDuplicates(["doc_id"])

    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    again = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    banded = few(banded, "band", again, "band")
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last")
    bucketed = cut(banded.join(hubs, "band"), folder, "buckets")
    grouped = bucketed.select("doc_id").distinct()
    candidates = few(own.filter("doc_id is not null"), "doc_id", grouped, "doc_id").join(grouped, "doc_id", "left_semi")
    sets = cut(candidates.mapInArrow(shingle_sets(width), f"doc_id long, shingles array<long>, {', '.join(f'w{i} long' for i in range(WHOLE))}").dropDuplicates(["doc_id"]), folder, "sets")
    own_sketch, whole_sketch = [f"s{i}" for i in range(SKETCH)], [f"w{i}" for i in range(WHOLE)]
    sketches = cut(reps.select("doc_id", "n_shingles", *own_sketch).join(sets.select("doc_id", *whole_sketch), "doc_id"), folder, "sketches")
    sets = sets.select("doc_id", "shingles")
    theirs_too = [F.col("n_shingles").alias("m_shingles"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH)), *(F.col(f"w{i}").alias(f"x{i}") for i in range(WHOLE))]
    other = sketches.select(F.col("doc_id").alias("other"), *theirs_too)
    # a set can't be alike one of which it is less than percent
    plausible = f"100 * least(n_shingles, m_shingles) >= {percent} * greatest(n_shingles, m_shingles) and {allowed(percent / 100)}"
    # of sets with a sum s of sizes and a difference d, (s - d) / (s + d) are shared
    plausible += f" and {100 + percent} * ({' + '.join(f'bit_count(w{i} ^ x{i})' for i in range(WHOLE))}) <= {100 - percent} * (n_shingles + m_shingles)"

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (doc_id, other), those whose whole sets are alike."""
        with_own = pairs.join(sets, "doc_id").select("doc_id", "other", "shingles")
        with_both = with_own.join(sets.select(F.col("doc_id").alias("other"), F.col("shingles").alias("theirs")), "other")
        both = F.size(F.array_intersect("shingles", "theirs"))
        alike = with_both.withColumn("both", both).filter(100 * F.col("both") >= percent * (F.size("shingles") + F.size("theirs") - F.col("both")))
        return cut(alike.select(F.col("doc_id").alias("u"), F.col("other").alias("v")), folder, name)

    def sketched(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().join(sketches, "doc_id").join(other, "other").filter(plausible).select("doc_id", "other")

    def placed(links: DataFrame, name: str) -> DataFrame:
        found = connected_components(links, folder, f"{name}-round")
        release(spark)  # each round leaves plans behind, which the driver's heap would grow by
        return cut(sketches.select("doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), folder, name)

    links = confirmed(sketched(bucketed.filter("doc_id <> hub").select("doc_id", F.col("hub").alias("other"))), "links-1")
    component = placed(links, "components-1")
    drawn = bucketed.filter("doc_id <> last").select("doc_id", F.col("last").alias("other")).distinct()
    theirs = component.select(F.col("doc_id").alias("other"), F.col("component").alias("their"))
    drawn = drawn.join(component, "doc_id").join(theirs, "other").filter("component <> their").select(F.least("doc_id", "other").alias("doc_id"), F.greatest("doc_id", "other").alias("other"))
    links = cut(links.unionByName(confirmed(sketched(drawn), "links-2")), folder, "links-12")
    component = placed(links, "components-2")

    # what is left: rows outside their bucket's largest component, against all others of the bucket
    labelled = bucketed.select("doc_id", "band").join(component, "doc_id")
    sizes = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max("n").alias("most"), F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = sizes.join(mixed, "band").filter("n = most").groupBy("band").agg(F.min("component").alias("main"))
    labelled = cut(labelled.join(mixed, "band").join(sketches, "doc_id"), folder, "mixed")
    minor = labelled.filter("component <> main")
    sides = labelled.select("band", F.col("doc_id").alias("other"), F.col("component").alias("their"), *theirs_too)
    left = minor.join(sides, "band").filter(f"component <> their and {plausible}").select(F.least("doc_id", "other").alias("doc_id"), F.greatest("doc_id", "other").alias("other")).distinct()
    links = cut(links.unionByName(confirmed(left, "links-3")), folder, "links")
    component = placed(links, "components-3")

    classed = members.join(component.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    for name in ("buckets", "sets", "mixed", "components-1", "components-2", "links-1", "links-2", "links-12", "links-3", "sketches", "classes"):
        delete(spark, f"{folder}/{name}")
    result = table.select("doc_id", "id", "ver", "n_shingles").join(classed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    if renumbered:  # a component's name is its least id, not its least number
        result = cut(result, folder, "result")
        least = result.groupBy("component_id").agg(F.min("id").alias("least"))
        result = result.join(least, "component_id", "left").withColumn("component_id", F.col("least"))
    return result.select(F.col("id").alias("doc_id"), "ver", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2, percent=80).drop("ver")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) ELSE ws END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS k FROM s), e AS (SELECT doc_id, unnest(sh) AS t FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.k + y.k - shared)),
pair AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT doc_id, v FROM reach JOIN pair ON other = u)
SELECT n.doc_id, CAST(k AS BIGINT) AS n_shingles, m AS component_id, n.doc_id = m AS kept FROM n JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) r ON r.doc_id = n.doc_id
"""
