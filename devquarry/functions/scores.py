"""Scores, decays and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def valid_vector(a: Column) -> Column:
    return ~F.exists(a, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))) & (dot(a, a) >= 1e-12)


def age_days(then: Column, now: Column) -> Column:
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(then), F.lit(0)) / 86400.0


def effective_importance(base: Column, age: Column, boost: Column) -> Column:
    """Halves in 90 days; access adds 0.3 at most; between 0.05 and 1."""
    return F.least(F.greatest(base * F.pow(F.lit(2.0), -age / 90) + F.least(boost, F.lit(0.3)), F.lit(0.05)), F.lit(1.0))


def access_boost(count: Column) -> Column:
    return F.least(count * 0.05, F.lit(0.3))


def temporal_decay(days: Column, rate: float = 0.01) -> Column:
    return F.exp(-days * rate)


def effort(lines: Column, files: Column, test_lines: Column) -> Column:
    return F.log2(lines + 1) + 1.5 * F.log2(files + 1) + (1 - 0.3 * F.least(test_lines / F.greatest(lines, F.lit(1)), F.lit(1.0)))


def effort_size(score: Column) -> Column:
    return F.when(score <= 6, "XS").when(score <= 10, "S").when(score <= 14, "M").when(score <= 18, "L").otherwise("XL")


def tshirt(size: Column) -> Column:
    out = F.lit(0)
    for i, s in enumerate(("XS", "S", "M", "L", "XL"), 1):
        out = F.when(size == s, i).otherwise(out)
    return out


def quality(commits: Column, reverts: Column, bugfixes: Column, ticketed: Column) -> Column:
    """0.75 without commits."""
    return F.when(commits == 0, 0.75).otherwise(0.35 * (1 - reverts / commits) + 0.40 * (1 - bugfixes / commits) + 0.25 * (ticketed / commits))


def quality_band(score: Column) -> Column:
    return F.when(score <= 0.2, 1).when(score <= 0.4, 2).when(score <= 0.6, 3).when(score <= 0.8, 4).otherwise(5)


def percentile_band(score: Column, thresholds: list[float]) -> Column:
    """1 below the first threshold, one more from each on."""
    return F.lit(1) + sum((score >= t).cast("int") for t in thresholds)


def trend(slope: Column) -> Column:
    return F.when(slope > 0.1, "improving").when(slope < -0.1, "declining").otherwise("stable")
