"""Penalised change points of daily series: memoised depth-first branch-and-bound from a series' end.

Spark sums the values of each key and day (map-side first, so a key with a third of the rows moves a row a day
and task), then gathers a key's days, one row each; the rows of a key never meet. A series is as long as the
calendar between its first and its last day, whatever the rows; segments are found in Arrow batches of series.

A subproblem is a prefix of the series. It chooses the start of its last segment:

* The cost of a segment of n days with the sum of squared errors E is n * floor(1000 ln(1 + floor(E / n))), which
  is n * p(E / n) at least, for the concave and rising ``floor_rate``. E is monotone: parts of a segment have no
  more together than the whole. So a segment costs what its parts in any windows cost by p, and windows of
  ``least`` days, which hold one cut at most, bound a prefix from below.
* Two looks ahead over all starts tighten these bounds: the exact cost of the last segment plus the bound of
  what is before.
* Starts are tried in the order of cost plus bound. What is strictly above the incumbent is cut off; equals are
  searched, as ties are decided by the fewest segments, then by the earliest start from the last one backwards.
* A solved prefix keeps the key (cost, segments, start), and its exact cost is its bound from then on.

Rows without a day or a value are left out; other nulls are not, so rows without a key are a series of their own.
Repeated rows count each. An empty table gives an empty result. Values are exact: beyond 62 bits Python's integers
take over; a spread or total beyond 64 bits is an error. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Looks ahead that tighten the bounds, and cells of the cost table that are held at once.
LOOKS, CELLS = 2, 1 << 18
NEVER = np.int64(1 << 62)


def floor_rate(x: np.ndarray) -> np.ndarray:
    """A concave, rising function that is nowhere above floor(1000 ln(1 + floor(x)))."""
    return np.where(x >= 1, 1000 * np.log(np.maximum(x, 1)), 1000 * (x - 1)) - 1


class Series:
    """The optimal segments of one series."""

    def __init__(self, values: list[int], least: int, penalty: int):
        self.n, self.least, self.penalty = len(values), least, penalty
        top = max(map(abs, values))
        kind = np.int64 if top * top * self.n * self.n < 1 << 62 else object
        own = np.array(values, kind)
        self.sums, self.squares = (np.concatenate([np.zeros(1, kind), np.cumsum(x, dtype=kind)]) for x in (own, own * own))
        self.block = max(CELLS // (self.n + 1), 1)
        self.tables: dict[int, np.ndarray] = {}

    def spread(self, a, b) -> np.ndarray:
        """1 + floor((n * Q - S * S) / (n * n)) of the days a to b, the latter excluded."""
        n, s = b - a, self.sums[b] - self.sums[a]
        return 1 + (n * (self.squares[b] - self.squares[a]) - s * s) // (n * n)

    def cost(self, a, b) -> np.ndarray:
        return (b - a) * np.floor(1000 * np.log(np.asarray(self.spread(a, b), np.float64))).astype(np.int64)

    def table(self, k: int) -> np.ndarray:
        """For each end of block ``k`` a row: by start, the cost of the segment and of the cut before it; NEVER where there is no such segment."""
        if k not in self.tables:
            if len(self.tables) * self.block * self.n >= 4 * CELLS:
                self.tables.clear()
            ends = np.arange(k * self.block, min((k + 1) * self.block, self.n + 1))
            starts = np.arange(max(int(ends[-1]) - self.least + 1, 1))
            table = np.full((len(ends), len(starts)), NEVER)
            i, j = np.nonzero((ends[:, None] - starts >= self.least) & ((starts == 0) | (starts >= self.least)))
            table[i, j] = self.cost(starts[j], ends[i]) + np.where(starts[j] > 0, self.penalty, 0)
            self.tables[k] = table
        return self.tables[k]

    def rate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the days a to b cost at least, as a part of any segment."""
        n, s = b - a, self.sums[b] - self.sums[a]
        return n * floor_rate(np.asarray(n * (self.squares[b] - self.squares[a]) - s * s, np.float64) / (n * n))

    def lower_bounds(self) -> np.ndarray:
        """What any segments of each prefix cost at least: windows of ``least`` days back from its end, then the looks ahead."""
        w, n = self.least, self.n
        places = np.arange(n + 1)
        low = np.zeros(n + 1)
        low[1 : w + 1] = self.rate(np.zeros(min(w, n), np.int64), places[1 : w + 1])
        if n > w:
            a = np.arange(n - w + 1)
            window = self.rate(a, a + w)
            for c in range(1, w):
                window = np.minimum(window, self.rate(a, a + c) + self.rate(a + c, a + w) + self.penalty)
            padded = np.zeros(-(-(n + 1) // w) * w)
            padded[:w] = low[:w]
            padded[w : n + 1] = window[: n + 1 - w]
            low = padded.reshape(-1, w).cumsum(0).reshape(-1)[: n + 1]
        bound = np.maximum(np.floor(low).astype(np.int64) - 1, 0)
        bound[0] = 0
        for _ in range(LOOKS):
            ahead = bound.copy()
            for k in range(n // self.block + 1):
                table = self.table(k)
                ends = slice(k * self.block, k * self.block + len(table))
                best = (table + bound[: table.shape[1]]).min(1)
                ahead[ends] = np.where(best < NEVER, np.maximum(bound[ends], best), bound[ends])
            bound = ahead
        return bound

    def solve(self) -> list[int]:
        """The starts of the optimal segments, in order."""
        bound, solved = self.lower_bounds(), np.zeros(self.n + 1, bool)
        count, start = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
        solved[0] = True
        stack = [self.n]
        while stack:
            e = stack[-1]
            own = self.table(e // self.block)[e % self.block, : e - self.least + 1]
            low, known = own + bound[: len(own)], solved[: len(own)]
            incumbent = low[known].min()
            open_ = np.flatnonzero((low <= incumbent) & ~known)
            if len(open_):
                stack.append(int(open_[low[open_].argmin()]))
                continue
            equal = np.flatnonzero(known & (low == incumbent))
            s = int(equal[count[equal].argmin()])  # the first of the fewest
            bound[e], solved[e], start[e], count[e] = incumbent, True, s, count[s] + 1
            stack.pop()
        starts, e = [], self.n
        while e:
            e = int(start[e])
            starts.append(e)
        return starts[::-1]


def segments(days: list[int], totals: list[int], least: int, penalty: int) -> list[tuple]:
    """(segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost) of each segment; days without a total count 0."""
    values = [0] * (days[-1] - days[0] + 1)
    for day, total in zip(days, totals):
        values[day - days[0]] = total
    if len(values) < 2 * least:
        series, starts = Series(values, min(least, len(values)), penalty), [0]
    else:
        series = Series(values, least, penalty)
        starts = series.solve()
    ends = [*starts[1:], len(values)]
    costs = [int(series.cost(np.array([a]), np.array([b]))[0]) for a, b in zip(starts, ends)]
    best = sum(costs) + penalty * (len(starts) - 1)
    return [
        (i + 1, days[0] + a, b - a, int(series.sums[b] - series.sums[a]), int(series.spread(np.array([a]), np.array([b]))[0]), cost, len(starts), best)
        for i, (a, b, cost) in enumerate(zip(starts, ends, costs))
    ]


def change_points(rows: DataFrame, key: str, day: str, value: str, least: int = 7, penalty: int = 20000) -> DataFrame:
    """The segments of each key's series; ``day`` is a date or timestamp, ``value`` an integer."""
    small_batches(rows.sparkSession)
    kept = rows.select(F.col(key).alias("key"), F.unix_date(F.col(day).cast("date")).alias("day"), F.col(value).cast("long").alias("value"))
    daily = kept.filter("day is not null and value is not null").groupBy("key", "day").agg(F.sum("value").alias("total"))
    series = daily.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", "total"))).alias("days"))
    names = ["segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]
    kinds = [pa.int32(), *[pa.int64()] * 7]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, own in enumerate(zip(batch.column("days").to_pylist(), batch.column("totals").to_pylist())):
                told = segments(*own, least, penalty)
                out += told
                at += [i] * len(told)
            columns = [pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), *columns], names=["key", *names])

    kind = kept.schema["key"].dataType.simpleString()
    arrays = series.select("key", F.col("days.day").alias("days"), F.col("days.total").alias("totals"))
    fields = ", ".join(f"{n} {'int' if n == 'segment_no' else 'long'}" for n in names)
    return arrays.mapInArrow(found, f"key {kind}, {fields}").withColumnRenamed("key", key)


def op13_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").filter("flag = 'kept'")
    return change_points(lines, "vendor_id", "shipped_at", "quantity")


#: All prefixes in order, each with the least of (cost, segments, start) over all starts.
OP13_SQL = """
WITH RECURSIVE taken AS (SELECT vendor_id, date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, CAST(sum(quantity) AS HUGEINT) AS t
    FROM sale_lines WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2),
days AS (SELECT vendor_id, min(day) AS a, unnest(range(min(day), max(day) + 1)) AS day FROM taken GROUP BY vendor_id),
filled AS (SELECT d.vendor_id, a, d.day, coalesce(t, 0) AS t FROM days d LEFT JOIN taken u ON u.vendor_id IS NOT DISTINCT FROM d.vendor_id AND u.day = d.day),
sums AS (SELECT vendor_id, a, day, CAST(sum(t) OVER w AS HUGEINT) AS s, CAST(sum(t * t) OVER w AS HUGEINT) AS q FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY day)),
series AS (SELECT vendor_id, a, count(*) AS n, list_prepend(CAST(0 AS HUGEINT), list(s ORDER BY day)) AS s, list_prepend(CAST(0 AS HUGEINT), list(q ORDER BY day)) AS q FROM sums GROUP BY vendor_id, a),
solved AS (
    SELECT vendor_id, a, n, s, q, CAST(0 AS BIGINT) AS e, [{'c': CAST(0 AS BIGINT), 'k': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT)}] AS best FROM series
    UNION ALL
    SELECT vendor_id, a, n, s, q, e + 1, list_append(best, CASE WHEN e + 1 >= 7 OR e + 1 = n THEN list_min(list_transform(list_filter(range(0, greatest(e - 5, 1)), lambda x: x = 0 OR x >= 7), lambda x: {
        'c': best[x + 1].c + CASE WHEN x > 0 THEN 20000 ELSE 0 END + (e + 1 - x) * CAST(floor(1000 * ln(CAST(1 + ((e + 1 - x) * (q[e + 2] - q[x + 1]) - (s[e + 2] - s[x + 1]) * (s[e + 2] - s[x + 1])) // ((e + 1 - x) * (e + 1 - x)) AS DOUBLE))) AS BIGINT),
        'k': best[x + 1].k + 1, 's': x})) END)
    FROM solved WHERE e < n),
parts AS (
    SELECT vendor_id, a, s, q, best, best[n + 1] AS whole, best[n + 1].s AS x, n AS e FROM solved WHERE e = n
    UNION ALL
    SELECT vendor_id, a, s, q, best, whole, best[x + 1].s, x FROM parts WHERE x > 0),
told AS (SELECT vendor_id, a + x AS first_day, e - x AS n_days, s[e + 1] - s[x + 1] AS total, q[e + 1] - q[x + 1] AS squares, whole, x FROM parts)
SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY x) AS INTEGER) AS segment_no, first_day, n_days, CAST(total AS BIGINT) AS total,
    CAST(1 + (n_days * squares - total * total) // (n_days * n_days) AS BIGINT) AS spread, n_days * CAST(floor(1000 * ln(CAST(1 + (n_days * squares - total * total) // (n_days * n_days) AS DOUBLE))) AS BIGINT) AS cost,
    whole.k AS n_segments, whole.c AS best_cost
FROM told
"""
