"""k-shingles over ordered feature arrays, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DetectorConfig
from .util import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shingles(features, k, empty_token: bool = False) -> Column:
    """Consecutive k-windows joined by one space.

    Fewer than k features give one shingle of all of them. No features give
    ``['empty']`` (hasher convention) when ``empty_token`` else ``[]`` (store
    convention). ``k`` may be an int or a Column.
    """
    kk = F.lit(k) if isinstance(k, int) else k
    empty = F.array(F.lit("empty")) if empty_token else F.array().cast("array<string>")

    def of(f: Column) -> Column:
        n = F.size(f)
        windows = F.transform(
            F.sequence(F.lit(0), n - kk),
            lambda i: F.array_join(F.slice(f, i + 1, kk), " "))
        return (F.when(n == 0, empty)
                 .when(n < kk, F.array(F.array_join(f, " ")))
                 .otherwise(windows))

    # every window reads the list, which the optimizer may have replaced by all that makes it
    return let(_col(features), of)


def adaptive_k(features, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """Shingle size chosen from the feature count."""
    n = F.size(_col(features))
    small, medium, large = cfg.shingle_sizes
    t_small, t_large = cfg.shingle_thresholds
    return (F.when(n <= t_small, F.lit(small))
             .when(n <= t_large, F.lit(medium))
             .otherwise(F.lit(large)))


def adaptive_shingles(features, cfg: DetectorConfig = DetectorConfig()) -> Column:
    return shingles(features, adaptive_k(features, cfg), empty_token=False)


def pattern_set(patterns) -> Column:
    """Distinct 2-shingles of a control-flow list, sorted (``[]`` when empty)."""
    def of(f: Column) -> Column:
        n = F.size(f)
        # neighbours side by side: no list is made for a window
        pairs = F.zip_with(F.slice(f, 1, n - 1), F.slice(f, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))
        return (F.when(n == 0, F.array().cast("array<string>"))
                 .when(n < 2, F.array(F.array_join(f, " ")))
                 .otherwise(pairs))

    # no null among them; array_sort would call an interpreted comparison for every two
    return F.sort_array(F.array_distinct(let(_col(patterns), of)))
