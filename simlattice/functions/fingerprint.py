"""Salted SHA-256 structure fingerprints and bit-level distances.

Byte i of the fingerprint is the first byte of SHA-256("salt<i>" || s1 || s2 ...)
over the shingles in order, no separators. The canonical form is lowercase hex
(2 chars per byte); ``hash_words`` exposes it as signed 64-bit words so that
Hamming distance is ``sum(bit_count(a ^ b))`` inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DetectorConfig
from .util import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fingerprint_hex(shingle_array, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """Hex fingerprint of a shingle list; no shingles give all zero bits."""
    sh = _col(shingle_array)
    nbytes = cfg.hash_bytes

    def salted(joined: Column) -> Column:
        per_byte = F.transform(
            F.sequence(F.lit(0), F.lit(nbytes - 1)),
            lambda i: F.substring(F.sha2(F.concat(F.lit("salt"), i.cast("string"), joined), 256), 1, 2))
        return F.array_join(per_byte, "")

    zeros = F.lit("00" * nbytes)
    return F.when(F.size(sh) == 0, zeros).otherwise(let(F.array_join(sh, ""), salted))


def hash_word(hex_col, j: int) -> Column:
    """64-bit word j (0-based) of a hex fingerprint as a signed bigint; a short last word is padded with zeros."""
    h = _col(hex_col)
    return F.conv(F.rpad(F.substring(h, 16 * j + 1, 16), 16, "0"), 16, -10).cast("bigint")


def hash_words(hex_col, cfg: DetectorConfig = DetectorConfig()) -> list[Column]:
    return [hash_word(hex_col, j) for j in range(cfg.hash_words)]


def hamming(a_words: list, b_words: list) -> Column:
    """Bit difference of two word lists of equal length."""
    if len(a_words) != len(b_words):
        raise ValueError("the two hashes differ in length")
    terms = [F.bit_count(_col(a).bitwiseXOR(_col(b))) for a, b in zip(a_words, b_words)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("int")


def hamming_hex(a_hex, b_hex, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """Hamming distance of two hex fingerprints; unequal lengths raise."""
    a, b = _col(a_hex), _col(b_hex)
    dist = hamming(hash_words(a, cfg), hash_words(b, cfg))
    return F.when(F.length(a) != F.length(b),
                  F.raise_error(F.lit("the two hashes differ in length")).cast("int")).otherwise(dist)


def syntactic_similarity(dist, cfg: DetectorConfig = DetectorConfig()) -> Column:
    return F.lit(1.0) - _col(dist).cast("double") / F.lit(float(cfg.hash_bits))


def hash_bytes_array(hex_col, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """Array of (band, byte-hex) structs for pigeonhole banding joins."""
    h = _col(hex_col)
    return F.transform(F.sequence(F.lit(0), F.lit(cfg.hash_bytes - 1)),
                       lambda i: F.struct(i.alias("band"), F.substring(h, i * 2 + 1, 2).alias("val")))


def bits_text(hex_col, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """Storage codec: the 256 bits as a comma list of 0/1 digits."""
    h = _col(hex_col)
    per_byte = F.transform(
        F.sequence(F.lit(0), F.lit(cfg.hash_bytes - 1)),
        lambda i: F.lpad(F.conv(F.substring(h, i * 2 + 1, 2), 16, 2), 8, "0"))
    bits = F.array_join(per_byte, "")
    return F.regexp_replace(F.regexp_replace(bits, "(.)", "$1,"), ",$", "")


def hex_from_bits_text(text_col) -> Column:
    """Inverse of :func:`bits_text`."""
    t = F.regexp_replace(_col(text_col), ",", "")
    nbytes = F.length(t) / 8
    return F.array_join(
        F.transform(F.sequence(F.lit(0), (nbytes - 1).cast("int")),
                    lambda i: F.lower(F.lpad(F.conv(F.substring(t, i * 8 + 1, 8), 2, 16), 2, "0"))),
        "")
