"""Similar pairs at scale: exact candidate generation, verification, grouped output.

Work happens between *signatures* (items with identical inputs to the
verdict): ``(language, hash, pattern set)``. Members of one signature are
identical for every measure, so they are reported as one ``within`` row with
their pair count instead of emitting all pairs of the group. Between
signatures, candidates come from two exact branches:

* hash branch: Hamming distance <= d via the generalised pigeonhole on
  hex-aligned bands (see ``band_layout``): equi-join on (band, value), one
  side also listing 1-bit neighbour values when the layout needs radius 1;
* set branch: Jaccard >= t with the prefix filter (each set keeps its
  ``|A| - ceil(t|A|) + 1`` rarest tokens in one global order; two sets with
  Jaccard >= t share a prefix token) plus the size filter
  ``t|A| <= |B| <= |A|/t``.

Items with the same pattern set compare at structural 1.0 to each other (two
empty lists included), so a pattern-set class is reported as one
``same_patterns`` row with its pair count (their hashes differ, so Hamming is
left NULL there), never expanded; candidate generation runs between distinct
classes.

No cartesian product is used anywhere; thresholds whose Hamming bound exceeds
31 bits cannot be answered exactly without one and are refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MATRIX_MAX_FILES, DetectorConfig
from ..functions import similarity as sim
from ..functions.fingerprint import hamming, syntactic_similarity
from ..session import freed_shuffles, kept_table
from .compare import compare_pairs

EPS = 1e-9
#: Counters of the sketch that orders tokens by rarity (8 bytes each; a power of two).
SKETCH = 1 << 20
#: Bits of the sketch of band cells (8 MB; a power of two).
CELL_BITS = 1 << 26
#: Sets whose prefixes are found at once.
PREFIX_ROWS = 256
#: Keys that are broadcast (about 30 MB); more are dealt.
BROADCAST_KEYS = 1_000_000


def hamming_bound(t: float, cfg: DetectorConfig = DetectorConfig()) -> int:
    """Largest distance d with 1 - d/bits >= t."""
    return int(math.floor(cfg.hash_bits * (1.0 - t) + EPS))


def check_hash_threshold(t: float, cfg: DetectorConfig = DetectorConfig()) -> int:
    d = hamming_bound(t, cfg)
    if d + 1 > cfg.hash_bytes:
        lowest = 1.0 - (cfg.hash_bytes - 1) / cfg.hash_bits
        raise ValueError(
            f"syntactic threshold {t} allows {d} differing bits; exact candidate generation needs "
            f"d <= {cfg.hash_bytes - 1} (threshold >= {lowest:.4f}). Lower thresholds are a full "
            "cartesian comparison and are not planned.")
    return d


def band_layout(d: int, nhex: int = 64) -> tuple[list[tuple[int, int]], int]:
    """Hex-aligned bands and a radius r with r = floor(d / #bands) <= 1.

    Generalised pigeonhole: if two hashes differ in at most d bits and are cut
    into m bands, some band differs in at most floor(d/m) bits. d <= 15 uses
    d+1 bands of >= 16 bits matched exactly; 16 <= d <= 31 uses d//2+1 bands of
    up to 28 bits matched within one bit (each side lists its 1-bit neighbours).
    Wider bands mean far fewer chance collisions between unrelated hashes.
    """
    if d < 0:
        raise ValueError("negative distance")
    if d <= 15:
        m, r = d + 1, 0
    elif d <= 31:
        m, r = d // 2 + 1, 1
    else:
        raise ValueError("d > 31 is not bandable exactly")
    base, extra = divmod(nhex, m)
    out, start = [], 0
    for i in range(m):
        w = base + (1 if i < extra else 0)
        out.append((start, w))
        start += w
    return out, r


def _tag_band(i: int):
    return lambda x: F.struct(F.lit(i).alias("band"), x.cast("string").alias("val"))


def band_rows(df: DataFrame, key: str, hex_col: str, d: int, cfg: DetectorConfig = DetectorConfig(),
              neighbours: bool = False) -> DataFrame:
    """(k, band, val) rows; with radius 1 and ``neighbours`` also every 1-bit neighbour value."""
    bands, r = band_layout(d, cfg.hash_bytes * 2)
    h = F.col(hex_col)
    if r == 0:
        arr = F.array(*[F.struct(F.lit(i).alias("band"), F.substring(h, s + 1, w).alias("val"))
                        for i, (s, w) in enumerate(bands)])
        return df.select(F.col(key).alias("k"), F.explode(arr).alias("b")).select("k", "b.band", "b.val")
    cells = []
    for i, (s, w) in enumerate(bands):
        v = F.conv(F.substring(h, s + 1, w), 16, 10).cast("long")
        if neighbours:
            vals = F.concat(F.array(v), F.transform(F.sequence(F.lit(0), F.lit(4 * w - 1)),
                                                    lambda j: F.pow(F.lit(2.0), j).cast("long").bitwiseXOR(v)))
        else:
            vals = F.array(v)
        cells.append(F.transform(vals, _tag_band(i)))
    arr = F.flatten(F.array(*cells))
    return df.select(F.col(key).alias("k"), F.explode(arr).alias("b")).select("k", "b.band", "b.val")


def hash_candidates(left: DataFrame, key: str, hex_col: str, d: int, right: DataFrame | None = None,
                    cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Key pairs (k_l, k_r) that may be within d bits; self-join gives k_l < k_r.

    Left rows carry exact band values, right rows also their 1-bit neighbours
    (radius-1 layouts), so a pair whose closest band differs in one bit meets
    in either orientation.
    """
    # hundreds of rows an item are dealt, so band and value travel as one number; callers check the distance
    cell = ["k", F.xxhash64("band", "val").alias("cell")]
    lb = band_rows(left, key, hex_col, d, cfg).select(*cell).alias("l")
    rb = band_rows(right if right is not None else left, key, hex_col, d, cfg, neighbours=True).select(*cell)
    if band_layout(d, cfg.hash_bytes * 2)[1]:
        # nearly all neighbours meet nothing: those whose cell no exact row has are left out before they are dealt
        held = left.sparkSession.sparkContext.broadcast(_cell_sketch(lb))
        rb = rb.mapInArrow(_held_cells(held), f"k {dict(rb.dtypes)['k']}, cell long")
    rb = rb.alias("r")
    cond = [F.col("l.cell") == F.col("r.cell")]
    if right is None:
        cond.append(F.col("l.k") < F.col("r.k"))
    return lb.join(rb, cond).select(F.col("l.k").alias("k_l"), F.col("r.k").alias("k_r")).distinct()


def _cell_sketch(rows: DataFrame) -> np.ndarray:
    """A bit for each cell that occurs, by the low bits of its hash; its size does not grow with the rows."""
    slot = F.col("cell").bitwiseAND(CELL_BITS - 1)
    words = rows.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")).alias("bits"))
    with freed_shuffles(rows.sparkSession):
        found = words.toArrow()
    sketch = np.zeros(CELL_BITS >> 6, np.int64)
    sketch[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return sketch


def _held_cells(sketch):
    last = CELL_BITS - 1

    def run(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            word = sketch.value[(cell & last) >> 6]
            yield batch.filter(pa.array(((word >> (cell & 63)) & 1).astype(bool)))
    return run


def _ranked_prefix(sets: DataFrame, freq: DataFrame, t: float) -> DataFrame:
    """(k, n, tok, r) for the prefix tokens of each set in the global rare-first order; r is the token's place."""
    tok = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("tok"))
    ranked = tok.join(freq, "tok")
    w = Window.partitionBy("k").orderBy("df", "tok")
    p = F.col("n") - F.ceil(F.col("n") * F.lit(t) - F.lit(EPS)) + 1
    return ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= p).select("k", "n", "tok", "r")


def _may_reach(l: str, r: str, t: float) -> Column:
    """Whether sets that meet first at places ``l.r`` and ``r.r`` may have Jaccard >= t (size and positional bounds).

    The first shared token of two sets leaves at most 1 + min(n - r) shared tokens, and the overlap must reach
    t / (1 + t) of both sizes.
    """
    nl, nr = F.col(f"{l}.n"), F.col(f"{r}.n")
    left = F.least(nl - F.col(f"{l}.r"), nr - F.col(f"{r}.r")) + 1
    return ((nr >= nl * F.lit(t) - F.lit(EPS)) & (nr * F.lit(t) - F.lit(EPS) <= nl)
            & (left >= (nl + nr) * F.lit(t / (1 + t)) - F.lit(EPS)))


def _token_hashes(df: DataFrame, key: str, set_col: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.transform(set_col, lambda x: F.xxhash64(x)).alias("s")).filter(F.size("s") > 0)


def _token_counts(sets: DataFrame) -> np.ndarray:
    """How often tokens occur, in ``SKETCH`` counters by their hash; its size does not grow with the sets."""
    slots = sets.select(F.explode("s").alias("h")).groupBy(F.col("h").bitwiseAND(SKETCH - 1).alias("slot"))
    with freed_shuffles(sets.sparkSession):
        found = slots.agg(F.count(F.lit(1)).alias("df")).toArrow()
    counts = np.zeros(SKETCH, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("df").to_numpy()
    return counts


def _prefix_rows(counts, t: float, other=None):
    def run(batches):
        for whole in batches:
            schema = pa.schema([whole.schema.field("k"), ("n", pa.int32()), ("tok", pa.int64()), ("r", pa.int32())])
            # few rows at a time: the arrays stay small beside long sets
            for at in range(0, whole.num_rows, PREFIX_ROWS):
                batch = whole.slice(at, PREFIX_ROWS)
                size = pa.compute.list_value_length(batch.column("s")).to_numpy(zero_copy_only=False).astype(np.int64)
                tok = batch.column("s").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((tok, counts.value[tok & (SKETCH - 1)], row))
                tok, first = tok[order], np.cumsum(size) - size
                r = np.arange(len(tok)) - first[row] + 1
                keep = r <= (size - np.ceil(size * t - EPS).astype(np.int64) + 1)[row]
                if other is not None:
                    keep &= other.value[tok & (SKETCH - 1)]
                row = row[keep]
                yield pa.RecordBatch.from_arrays([
                    batch.column("k").take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(tok[keep]),
                    pa.array(r[keep].astype(np.int32))], schema=schema)
    return run


def _prefixes(sets: DataFrame, counts, t: float, other=None) -> DataFrame:
    """As :func:`_ranked_prefix`, found inside each row: only the prefixes are ever dealt.

    Tokens are 64-bit hashes, in the order of their slot's count and their hash: one order for all sets, which is all the
    prefix filter needs. Tokens of one hash meet as one, so no pair is lost; callers check the sets themselves.
    ``other``: whether the other side of a join has tokens of a slot; those it cannot have are left out.
    """
    return sets.mapInArrow(_prefix_rows(counts, t, other), f"k {dict(sets.dtypes)['k']}, n int, tok long, r int")


def set_candidates(left: DataFrame, key: str, set_col: str, t: float, right: DataFrame | None = None) -> DataFrame:
    """Key pairs whose distinct-token sets may have Jaccard >= t (t > 0)."""
    if not t > 0:
        raise ValueError("set candidates need a positive threshold")
    ls = _token_hashes(left, key, set_col)
    rs = ls if right is None else _token_hashes(right, key, set_col)
    share = left.sparkSession.sparkContext.broadcast
    if right is None:
        lp = _prefixes(ls, share(_token_counts(ls)), t)
        lp, rp = lp.alias("l"), lp.alias("r")
    else:
        of_l, of_r = _token_counts(ls), _token_counts(rs)
        counts = share(of_l + of_r)
        lp = _prefixes(ls, counts, t, share(of_r > 0)).alias("l")
        rp = _prefixes(rs, counts, t, share(of_l > 0)).alias("r")
    cond = [F.col("l.tok") == F.col("r.tok"), _may_reach("l", "r", t)]
    if right is None:
        cond.append(F.col("l.k") < F.col("r.k"))
    return lp.join(rp, cond).select(F.col("l.k").alias("k_l"), F.col("r.k").alias("k_r")).distinct()


def cross_language_pairs(fp: DataFrame, t: float = 0.6) -> DataFrame:
    """Pairs of items in different languages with structural similarity >= t, without any key that links them.

    Items of one language with one pattern set are one class; a row is a pair of classes (lang1 < lang2):
    ``lang1, lang2, item_a, item_b`` (smallest ids), ``n_a, n_b, n_pairs``, ``structural_similarity`` and
    ``matching_patterns``. Items without patterns take no part. A prefix token is listed once for every other language
    that has sets, so only blocks of two different languages meet; sets of one language never do. AQE splits the blocks
    of a hot token, the keys have no other gathering.
    """
    if not t > 0:
        raise ValueError("cross-language pairs need a positive threshold")
    # read six times below, so the fingerprints behind it are computed once
    # a condition on the sets themselves would be moved below the grouping and compute every set a second time
    grouped = fp.groupBy("language", "pset").agg(
        F.min("item_id").alias("k"), F.count(F.lit(1)).alias("members"), F.max(F.size("pset")).alias("size"))
    classes = kept_table(grouped.filter(F.col("size") > 0).drop("size"), "classes")
    sets = classes.select("k", F.col("pset").alias("s"))
    freq = sets.select(F.explode("s").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    # the languages there are: one row, bounded by the profiles
    known = classes.agg(F.array_sort(F.collect_set("language"))).scalar()
    prefix = _ranked_prefix(sets, freq, t).join(classes.select("k", "language"), "k")
    prefix = prefix.withColumn("known", known).withColumn(
        "other", F.explode(F.filter("known", lambda x: x != F.col("language"))))
    low = prefix.filter(F.col("language") < F.col("other")).alias("l")
    high = prefix.filter(F.col("language") > F.col("other")).alias("r")
    met = low.join(high, [F.col("l.tok") == F.col("r.tok"), F.col("l.language") == F.col("r.other"),
                          F.col("l.other") == F.col("r.language"), _may_reach("l", "r", t)])
    met = met.select(F.col("l.k").alias("k_l"), F.col("r.k").alias("k_r")).distinct()
    a = classes.select(F.col("k").alias("k_l"), F.col("language").alias("lang1"), F.col("pset").alias("a_pset"),
                       F.col("members").alias("n_a"))
    b = classes.select(F.col("k").alias("k_r"), F.col("language").alias("lang2"), F.col("pset").alias("b_pset"),
                       F.col("members").alias("n_b"))
    inter, union = sim.jaccard_counts("a_pset", "b_pset")
    return met.join(a.hint("merge"), "k_l").join(b.hint("merge"), "k_r").select(
        "lang1", "lang2", F.col("k_l").alias("item_a"), F.col("k_r").alias("item_b"), "n_a", "n_b",
        (F.col("n_a") * F.col("n_b")).alias("n_pairs"), sim.store_jaccard(inter, union).alias("structural_similarity"),
        F.sort_array(F.array_intersect("a_pset", "b_pset")).alias("matching_patterns")).filter(
        F.col("structural_similarity") >= F.lit(t))


def signatures(fp: DataFrame, by: list[str], cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """One row per distinct value of ``by``: rep (smallest item id), member count, payload."""
    payload = [c for c in ["language", "pset", "hash_hex"] + [f"h{j}" for j in range(cfg.hash_words)]
               if c not in by]
    agg = [F.min("item_id").alias("rep"), F.count(F.lit(1)).alias("n")]
    agg += [F.first(c).alias(c) for c in payload]
    # only the emptiness of the pattern list matters between signatures; keep one element, not the list
    agg.append(F.first(F.slice("patterns", 1, 1)).alias("patterns"))
    return fp.groupBy(*by).agg(*agg)


def _within_rows(sigs: DataFrame) -> DataFrame:
    return sigs.filter(F.col("n") >= 2).select(
        F.lit("within").alias("kind"), F.col("rep").alias("item_a"), F.col("rep").alias("item_b"),
        F.col("n").alias("n_a"), F.col("n").alias("n_b"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs"), "*")


def _pair_side(sigs: DataFrame, p: str) -> DataFrame:
    """A prefixed copy of the signature table for the payload joins.

    Its size grows with the data (pattern sets ride along) and has no proven
    bound, so the join is pinned to a shuffle sort-merge join instead of
    trusting a size estimate for a broadcast.
    """
    return sigs.select(*[F.col(c).alias(p + c) for c in sigs.columns]).hint("merge")


def _set_key(col: str = "pset"):
    return F.sha2(F.array_join(F.col(col), "\u0001"), 256)


def all_pairs(fp: DataFrame, t: float = 0.6, cfg: DetectorConfig = DetectorConfig(), syn_t: float = 0.97) -> DataFrame:
    """Every pair with structural similarity >= t or syntactic similarity >= syn_t, grouped (see module doc).

    kind='within': members of one signature (same language, hash and pattern
    set), all scores exact. kind='same_patterns': members of one pattern-set
    class that sit in different signatures -- structural 1.0, so similarity 1.0
    for every such pair; their Hamming distances differ per pair and are left
    NULL (``lang1``/``lang2`` are the class's smallest and largest language).
    kind='pair': two signatures of different classes, full verdict.
    """
    d = check_hash_threshold(syn_t, cfg)
    # tables, not caches: they are compressed, and the shuffles of whole sets behind them are freed and never run again
    sigs = kept_table(signatures(fp, ["language", "hash_hex", "pset"], cfg).withColumn("_empty", F.size("pset") == 0)
                      .withColumn("_pk", _set_key()), "signatures")
    classes = sigs.groupBy("_pk").agg(
        F.min("rep").alias("crep"), F.sum("n").alias("tot"), F.sum(F.col("n") * F.col("n")).alias("sq"),
        F.count(F.lit(1)).alias("nsig"), F.min("language").alias("l1"), F.max("language").alias("l2"),
        F.first("pset").alias("pset"))
    classes = kept_table(classes, "classes")
    member = sigs.select("rep", "_pk").join(classes.select("_pk", "crep"), "_pk").select("rep", "crep")
    # hash branch: signature pairs within d bits, minus pairs inside one class
    hc = verified_hash_pairs(sigs, d, cfg)
    ca = member.select(F.col("rep").alias("k_l"), F.col("crep").alias("c_l"))
    cb = member.select(F.col("rep").alias("k_r"), F.col("crep").alias("c_r"))
    hc = hc.join(ca, "k_l").join(cb, "k_r").filter(F.col("c_l") != F.col("c_r")).select("k_l", "k_r")
    # set branch between distinct classes, expanded to their signatures
    cc = set_candidates(classes.filter(F.size("pset") > 0), "crep", "pset", t)
    ea = member.select(F.col("crep").alias("k_l"), F.col("rep").alias("s_l"))
    eb = member.select(F.col("crep").alias("k_r"), F.col("rep").alias("s_r"))
    sc = cc.join(ea, "k_l").join(eb, "k_r").select(
        F.least("s_l", "s_r").alias("k_l"), F.greatest("s_l", "s_r").alias("k_r"))
    cand = kept_table(hc.unionByName(sc).distinct(), "candidates")
    # signatures without a candidate stay where they are: their sets make up most of the bytes
    asked = cand.select(F.explode(F.array("k_l", "k_r")).alias("rep")).distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    met = sigs.join(asked, "rep", "left_semi")
    a, b = _pair_side(met, "a_"), _pair_side(met, "b_")
    j = cand.join(a, F.col("k_l") == F.col("a_rep")).join(b, F.col("k_r") == F.col("b_rep"))
    from .compare import measured, verdict_columns
    v = measured(j, "a_", "b_", cfg).select(F.lit("pair").alias("kind"), F.col("a_rep").alias("item_a"), F.col("b_rep").alias("item_b"),
                 F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"),
                 (F.col("a_n") * F.col("b_n")).cast("bigint").alias("n_pairs"),
                 *verdict_columns("a_", "b_", cfg))
    v = v.filter((F.col("structural_similarity") >= F.lit(t)) | (F.col("syntactic_similarity") >= F.lit(syn_t)))
    within = _within_rows(sigs)
    w = within.select("kind", "item_a", "item_b", "n_a", "n_b", "n_pairs",
                      F.lit(1.0).alias("similarity"), F.lit(True).alias("plagiarism_detected"),
                      F.lit("high").alias("confidence"), F.lit(1.0).alias("syntactic_similarity"),
                      F.lit(0).alias("hamming_distance"), F.lit(1.0).alias("structural_similarity"),
                      F.col("pset").alias("matching_patterns"), _self_ratio("pset").alias("pattern_match_ratio"),
                      F.col("language").alias("lang1"), F.col("language").alias("lang2"),
                      F.lit("syntactic").alias("method_used"))
    sp = classes.filter(F.col("nsig") >= 2).select(
        F.lit("same_patterns").alias("kind"), F.col("crep").alias("item_a"), F.col("crep").alias("item_b"),
        F.col("tot").alias("n_a"), F.col("tot").alias("n_b"),
        ((F.col("tot") * F.col("tot") - F.col("sq")) / 2).cast("bigint").alias("n_pairs"),
        F.lit(1.0).alias("similarity"), F.lit(True).alias("plagiarism_detected"),
        F.lit("high").alias("confidence"), F.lit(None).cast("double").alias("syntactic_similarity"),
        F.lit(None).cast("int").alias("hamming_distance"), F.lit(1.0).alias("structural_similarity"),
        F.col("pset").alias("matching_patterns"), _self_ratio("pset").alias("pattern_match_ratio"),
        F.col("l1").alias("lang1"), F.col("l2").alias("lang2"), F.lit("structural").alias("method_used"))
    return v.unionByName(w).unionByName(sp)


def _self_ratio(col: str):
    n = F.size(col).cast("string")
    return F.when(F.size(col) == 0, F.lit("0/0")).otherwise(F.concat(n, F.lit("/"), n))


def verified_hash_pairs(sigs: DataFrame, d: int, cfg: DetectorConfig = DetectorConfig(), key: str = "rep") -> DataFrame:
    """Band candidates checked on the 64-bit words alone (narrow rows), before any wide payload is joined.

    One-byte bands collide by chance about once per 256 pairs; those coincidences
    are dropped here, so only true Hamming matches reach the payload joins.
    """
    words = [f"h{j}" for j in range(cfg.hash_words)]
    narrow = sigs.select(F.col(key).alias("k"), "hash_hex", *words)
    cand = hash_candidates(narrow, "k", "hash_hex", d, cfg=cfg)
    l = narrow.select(F.col("k").alias("k_l"), *[F.col(w).alias("l_" + w) for w in words])
    r = narrow.select(F.col("k").alias("k_r"), *[F.col(w).alias("r_" + w) for w in words])
    j = cand.join(l, "k_l").join(r, "k_r")
    dist = hamming([F.col("l_" + w) for w in words], [F.col("r_" + w) for w in words])
    return j.filter(dist <= d).select("k_l", "k_r")


def hamming_pairs(fp: DataFrame, t: float = 0.9, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Pairs with syntactic similarity >= t, grouped by hash."""
    d = check_hash_threshold(t, cfg)
    sigs = signatures(fp, ["hash_hex"], cfg).persist()
    cand = hash_candidates(sigs, "rep", "hash_hex", d, cfg=cfg)
    a, b = _pair_side(sigs, "a_"), _pair_side(sigs, "b_")
    j = cand.join(a, F.col("k_l") == F.col("a_rep")).join(b, F.col("k_r") == F.col("b_rep"))
    dist = hamming([F.col(f"a_h{i}") for i in range(cfg.hash_words)], [F.col(f"b_h{i}") for i in range(cfg.hash_words)])
    pairs = j.select(F.lit("pair").alias("kind"), F.col("a_rep").alias("item_a"), F.col("b_rep").alias("item_b"),
                     F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"),
                     (F.col("a_n") * F.col("b_n")).cast("bigint").alias("n_pairs"),
                     dist.alias("hamming_distance")).filter(F.col("hamming_distance") <= d)
    within = _within_rows(sigs).select("kind", "item_a", "item_b", "n_a", "n_b", "n_pairs",
                                       F.lit(0).alias("hamming_distance"))
    out = pairs.unionByName(within)
    return out.withColumn("syntactic_similarity", syntactic_similarity("hamming_distance", cfg))


def jaccard_pairs(fp: DataFrame, t: float = 0.6) -> DataFrame:
    """Pairs with structural similarity >= t (pairwise empty rules), grouped by pattern set."""
    sigs = signatures(fp, ["pset"]).withColumn("_empty", F.size("pset") == 0).persist()
    cand = set_candidates(sigs.filter(~F.col("_empty")), "rep", "pset", t)
    a, b = _pair_side(sigs, "a_"), _pair_side(sigs, "b_")
    j = cand.join(a, F.col("k_l") == F.col("a_rep")).join(b, F.col("k_r") == F.col("b_rep"))
    inter, union = sim.jaccard_counts("a_pset", "b_pset")
    j = j.select("*", inter.alias("_i"), union.alias("_u"))
    struct = sim.structural_similarity("a_patterns", "b_patterns", "_i", "_u")
    pairs = j.select(F.lit("pair").alias("kind"), F.col("a_rep").alias("item_a"), F.col("b_rep").alias("item_b"),
                     F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"),
                     (F.col("a_n") * F.col("b_n")).cast("bigint").alias("n_pairs"),
                     struct.alias("structural_similarity"),
                     sim.matching_patterns("a_patterns", "b_patterns", "a_pset", "b_pset").alias("matching_patterns"),
                     sim.match_ratio("a_patterns", "b_patterns", "_i", "_u").alias("pattern_match_ratio"))
    pairs = pairs.filter(F.col("structural_similarity") >= F.lit(t))
    within = _within_rows(sigs).select(
        "kind", "item_a", "item_b", "n_a", "n_b", "n_pairs", F.lit(1.0).alias("structural_similarity"),
        F.col("pset").alias("matching_patterns"),
        F.when(F.col("_empty"), F.lit("0/0")).otherwise(
            F.concat(F.size("pset").cast("string"), F.lit("/"), F.size("pset").cast("string"))).alias("pattern_match_ratio"))
    return pairs.unionByName(within)


def expand_pairs(grouped: DataFrame, fp: DataFrame) -> DataFrame:
    """Item-level (item_a, item_b, kind) pairs from an :func:`all_pairs` result.

    The output is quadratic in group sizes by nature; use it only when the
    caller needs every pair listed (tests, small batches).
    """
    sig = signatures(fp, ["language", "hash_hex", "pset"]).select("language", "hash_hex", "pset", F.col("rep").alias("srep"))
    cls = sig.groupBy("pset").agg(F.min("srep").alias("crep"))
    m = (fp.select("item_id", "language", "hash_hex", "pset").join(sig, ["language", "hash_hex", "pset"])
           .join(cls, "pset").select("item_id", "srep", "crep"))
    ma = m.select(F.col("item_id").alias("a_id"), F.col("srep").alias("a_s"), F.col("crep").alias("a_c"))
    mb = m.select(F.col("item_id").alias("b_id"), F.col("srep").alias("b_s"), F.col("crep").alias("b_c"))
    g = grouped.select("kind", "item_a", "item_b")
    pr = g.filter(F.col("kind") == "pair").join(ma, F.col("item_a") == F.col("a_s")).join(mb, F.col("item_b") == F.col("b_s"))
    wi = (g.filter(F.col("kind") == "within").join(ma, F.col("item_a") == F.col("a_s"))
            .join(mb, (F.col("item_a") == F.col("b_s")) & (F.col("a_id") < F.col("b_id"))))
    sp = (g.filter(F.col("kind") == "same_patterns").join(ma, F.col("item_a") == F.col("a_c"))
            .join(mb, (F.col("item_a") == F.col("b_c")) & (F.col("a_id") < F.col("b_id")) & (F.col("a_s") != F.col("b_s"))))
    out = pr.unionByName(wi).unionByName(sp)
    return out.select("kind", F.least("a_id", "b_id").alias("item_a"), F.greatest("a_id", "b_id").alias("item_b"))


def item_matrix(fp: DataFrame, chosen: DataFrame, cfg: DetectorConfig = DetectorConfig(),
                most: int = MATRIX_MAX_FILES) -> DataFrame:
    """The full symmetric matrix of the ``chosen(item_id)``, one row a cell: ``item_a, item_b, name_a, name_b, similarity``.

    A matrix is for looking at, so more than ``most`` distinct items raise. The two triangles come from one verdict a pair,
    the diagonal is 1.0. Items that ``fp`` (with a column ``name``) does not hold, and null ids, have no cells.
    """
    small = chosen.filter("item_id IS NOT NULL").distinct().limit(most + 1)
    names = fp.select("item_id", "name").join(F.broadcast(small), "item_id")
    packed = names.agg(F.array_sort(F.collect_set(F.struct("item_id", "name"))).alias("m"))
    packed = packed.select(F.when(F.size("m") <= most, F.col("m")).otherwise(
        F.raise_error(F.lit(f"a matrix holds {most} items at most"))).alias("m"))
    pairs = packed.select(F.explode(F.flatten(F.transform("m", lambda a: F.transform(
        F.filter("m", lambda b: a.item_id <= b.item_id), lambda b: F.struct(
            a.item_id.alias("item_a"), b.item_id.alias("item_b"), a["name"].alias("name_a"), b["name"].alias("name_b"))))))
        .alias("p")).select("p.*")
    seen = compare_pairs(pairs, fp.join(F.broadcast(small), "item_id"), cfg=cfg)
    score = F.when(F.col("item_a") == F.col("item_b"), 1.0).otherwise(F.col("similarity"))
    cell = lambda a, b: F.struct(F.col(f"item_{a}").alias("item_a"), F.col(f"item_{b}").alias("item_b"),
                                 F.col(f"name_{a}").alias("name_a"), F.col(f"name_{b}").alias("name_b"),
                                 score.alias("similarity"))
    return seen.select(F.explode(F.when(F.col("item_a") == F.col("item_b"), F.array(cell("a", "b"))).otherwise(
        F.array(cell("a", "b"), cell("b", "a")))).alias("c")).select("c.*")


def pair_budget(items: DataFrame) -> DataFrame:
    """Item count and the number of pairs a full batch comparison would make."""
    return items.agg(F.count(F.lit(1)).alias("n_items")).select(
        "n_items", (F.col("n_items") * (F.col("n_items") - 1) / 2).cast("bigint").alias("n_pairs"))


def fingerprint_groups(fp: DataFrame) -> DataFrame:
    """Exact structural duplicates: hashes shared by more than one item."""
    return (fp.groupBy("hash_hex")
              .agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"),
                   F.max("item_id").alias("last_item"))
              .filter(F.col("n_items") > 1))
