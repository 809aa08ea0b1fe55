"""Similarity scalars: Jaccard with the empty rules, verdicts, badges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BADGE_HIGH, BADGE_MEDIUM, BEST_HIGH, BEST_MEDIUM, DetectorConfig


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jaccard_counts(set_a, set_b) -> tuple[Column, Column]:
    """Intersection and union sizes of two distinct-element arrays."""
    a, b = _col(set_a), _col(set_b)
    inter = F.size(F.array_intersect(a, b)).cast("bigint")
    return inter, F.size(a) + F.size(b) - inter


def structural_similarity(pat_a, pat_b, inter, union) -> Column:
    """Pairwise rule: both pattern lists empty -> 1.0, exactly one -> 0.0, else i/u."""
    ea, eb = F.size(_col(pat_a)) == 0, F.size(_col(pat_b)) == 0
    return (F.when(ea & eb, F.lit(1.0))
             .when(ea | eb, F.lit(0.0))
             .otherwise(_col(inter).cast("double") / _col(union).cast("double")))


def store_jaccard(inter, union) -> Column:
    """Store rule: i/u, 0.0 when the union is empty."""
    return F.when(_col(union) == 0, F.lit(0.0)).otherwise(
        _col(inter).cast("double") / _col(union).cast("double"))


def match_ratio(pat_a, pat_b, inter, union) -> Column:
    ea, eb = F.size(_col(pat_a)) == 0, F.size(_col(pat_b)) == 0
    return F.when(ea | eb, F.lit("0/0")).otherwise(
        F.concat(_col(inter).cast("string"), F.lit("/"), _col(union).cast("string")))


def matching_patterns(pat_a, pat_b, set_a, set_b) -> Column:
    ea, eb = F.size(_col(pat_a)) == 0, F.size(_col(pat_b)) == 0
    return F.when(ea | eb, F.array().cast("array<string>")).otherwise(
        F.sort_array(F.array_intersect(_col(set_a), _col(set_b))))


def best_similarity(syn, struct) -> Column:
    return F.greatest(_col(syn), _col(struct))


def method_used(syn, struct) -> Column:
    return F.when(_col(syn) >= _col(struct), F.lit("syntactic")).otherwise(F.lit("structural"))


def confidence(struct, best, cfg: DetectorConfig = DetectorConfig()) -> Column:
    s, b = _col(struct), _col(best)
    return (F.when((s >= cfg.high_confidence_threshold) | (b >= BEST_HIGH), F.lit("high"))
             .when((s >= cfg.medium_confidence_threshold) | (b >= BEST_MEDIUM), F.lit("medium"))
             .otherwise(F.lit("low")))


def plagiarism_flag(struct, best, cfg: DetectorConfig = DetectorConfig()) -> Column:
    t = cfg.plagiarism_threshold
    return (_col(best) > t) | (_col(struct) > t)


def badge(sim) -> Column:
    s = _col(sim)
    return (F.when(s >= BADGE_HIGH, F.lit("HIGH"))
             .when(s >= BADGE_MEDIUM, F.lit("MEDIUM"))
             .otherwise(F.lit("LOW")))


def percent_text(x) -> Column:
    """``{:.1%}`` style text (half-up rounding; compare numbers, not text)."""
    return F.concat(F.format_number(_col(x) * 100.0, 1), F.lit("%"))
