"""Optimal length buckets and token-budget batches.

The lengths of all rows are counted one by one, dynamic programming chooses the bucket boundaries of least
padding, and rows of a bucket fill batches of at most ``budget`` padded tokens. The words of a text are counted
once. The histogram goes to the driver: d distinct lengths take d * d / 2 words at least, so a corpus of w words
has sqrt(2 * w) of them at most, 100,000 at 30 GB and 6 million (100 MB) at 100 TB.

Tokens are words; null and empty texts have none and go to the first bucket. A text longer than the
budget has a batch of its own. Rows are dealt by their number, which is written with the lengths, so no id
gathers; repeated rows have a slot each, and rows without id are dealt like others. Only the id and the text
are read, so further columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, documents, shared_dir

#: Parts of a bucket that are numbered on their own: so many, or as many as leave ROWS rows to a part.
PARTS, ROWS = 512, 1 << 17


def n_words(text: Column) -> Column:
    """The number of words, runs of characters other than the six ASCII separators."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(units: np.ndarray, counts: np.ndarray, most: int) -> list[int]:
    """Upper ends of at most ``most`` buckets that minimise the sum of (upper end - length) over all rows.

    Divide and conquer over the last cut: the cost has the quadrangle inequality, so the best cut moves
    one way, and a layer takes n log n steps.
    """
    n = len(units)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = units * rows[1:]  # padded tokens of the first i + 1 bins in one bucket
    cuts = []
    for _ in range(1, min(most, n)):
        new, cut = best.copy(), np.zeros(n, np.int32)
        low, high, first, last = (np.array([x]) for x in (1, n - 1, 0, n - 2))
        while len(low):  # all stretches of a depth at once: together they look at each bin about once
            mid = (low + high) // 2
            size = np.minimum(last, mid - 1) - first + 1
            begin = np.cumsum(size) - size
            own = np.repeat(np.arange(len(mid)), size)
            j = np.arange(len(own)) - begin[own] + first[own]
            cost = best[j] + units[mid[own]] * (rows[mid[own] + 1] - rows[j + 1])
            least = np.minimum.reduceat(cost, begin)
            hits = np.flatnonzero(cost == least[own])
            at = j[hits[np.searchsorted(hits, begin)]]  # the first of equals
            new[mid], cut[mid] = least, at
            halves = [np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, at), (at, last))]
            order = np.argsort(halves[0])
            low, high, first, last = (x[order][(halves[0] <= halves[1])[order]] for x in halves)
        cuts.append(cut)
        best = new
    ends, i = [], n - 1
    for cut in reversed(cuts):
        ends.append(int(units[i]))
        if i == 0:
            break
        i = int(cut[i])
    else:
        ends.append(int(units[i]))
    return sorted(set(ends))


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch_id, slot and padding of every row."""
    sized = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    sized = cut(sized, shared_dir(docs.sparkSession), "lengths")
    bins = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toPandas()
    ends = boundaries(bins["n_tokens"].to_numpy(np.int64), bins["n"].to_numpy(np.int64), buckets) or [0]
    n_parts = max(PARTS, int(bins["n"].sum()) // ROWS)

    literal = F.array(*[F.lit(e).cast("long") for e in ends])
    bucket = F.size(F.filter(literal, lambda e: e < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket).withColumn("boundary", F.get(literal, F.col("bucket")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(n_parts)).cast("int"))
    # numbers that go through a bucket: those of a part follow all of the parts before it
    parts = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens", "row"))
    numbered = placed.withColumn("own", own).join(before, ["bucket", "part"])
    number = F.col("before") + F.col("own") - 1
    capacity = F.greatest(F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1))), F.lit(1)).cast("long")
    return numbered.select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "boundary",
        F.floor(number / capacity).cast("long").alias("batch_id"), (number % capacity).cast("long").alias("slot"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
