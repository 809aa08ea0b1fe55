"""Phrase collocations by weighted acyclic automata.

Each slice of texts becomes a count transducer: its windows of ``LONGEST`` words (shorter at the end of a piece) are
sorted, and states are built level by level from the sorted list; an arc carries a word and the number of times the words
on the way to it occur, so every n-gram's count is a weight. States with equal arcs are one state, as in a minimal
automaton. A slice's transducer is cut into prefix ranges. The union of a range walks the transducers of all slices at
once, sums the weights of equal words and leaves an arc below ``LEAST`` together with all that follows it, which cannot be
more frequent. The surviving counts are transducers again, a composition of them with the candidates' parts looks the
parts' counts up.

A first reading counts words, pairs and triples by hash in one sketch of bounded size, which never counts too little. No
window goes on over one that the sketch shows to be rare, so rare text is neither sorted nor sent. A full
sketch would leave all windows as they are: it saves work and changes no count.

Ranges are hashes of the shortest prefix that is not hot; a prefix is hot if it holds more than one range's share of all
distinct windows. Hot prefixes are found from all slices (a prefix with the share s has s / 2 in slices where it has that
share, and only such slices report it), so there are at most 2 x 4 x ranges of them. Only a hot prefix's own count is
spread over several ranges; such counts are summed at the end.

Defined results: a null text is empty, a null ``lang`` is ``und``; an empty table or a corpus without frequent phrases
gives no rows. Repeated rows count as often as they stand there. Identifiers and other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, rows, tasks_for, text_bytes
from .words import LOWER, mix

LONGEST = 5
#: A candidate's least count, and the phrases returned of each language.
LEAST, TOP = 100, 2000
#: Counters of the sketch: one for so many bytes of text, so many at least and at most (16 MB of bits), and those of a row.
CELL_BYTES, FEWEST_BITS, MOST_BITS, _BLOCK = 64, 12, 27, 1 << 18
#: Words of the longest n-grams that the sketch counts.
SKETCHED = 3
NO_LANGUAGE = "und"
#: Text of a slice and of a range of the union; counted phrases and looked up parts of a range of the composition.
SLICE_BYTES, RANGE_BYTES, RANGE_ROWS = 6 << 20, 24 << 20, 400_000
# fixed values of the contract: what ends a piece, what separates words in it
_BREAK, _GAP = b".,;:!?\n\x0b\x0c\r", b" \t"
_IS_BREAK, _IS_SEPARATOR = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[list(_BREAK)] = True
_IS_SEPARATOR[list(_BREAK + _GAP)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _compressed(data: bytes) -> bytes:
    return pa.Codec("zstd", 3).compress(data, asbytes=True)


def _plain(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)



def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; 0 is the end of a window."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _onward(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix with one more word."""
    return mix(prefix * _STEP + word + np.uint64(1))


_SKETCH = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("value", pa.binary())])


class Vocabulary:
    """Distinct byte strings in byte order; labels are their places from 1 (0 is the end)."""

    def __init__(self, words: pa.Array):
        coded = pc.dictionary_encode(words)
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        self.words = coded.dictionary.take(pa.array(order))
        self.labels = rank[coded.indices.to_numpy()] if len(rank) else np.zeros(0, np.int32)

    def hashes(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), _hashes(self.words.to_pylist())])


class Tokens:
    """The words of a slice: ``code`` into ``words``, the piece and the language (label) of each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        separator = _IS_SEPARATOR[data]
        edge = np.flatnonzero(separator[1:] != separator[:-1]) + 1
        if not separator[0]:
            edge = np.concatenate([[0], edge])
        start, size = edge[0::2], edge[1::2] - edge[0::2]
        self.piece = np.cumsum(_IS_BREAK[data], dtype=np.int32)[start]
        doc = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), start, "right")
        offsets = np.concatenate([[0], np.cumsum(size)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [
            None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(LOWER[data[~separator]].tobytes())])
        del data, separator, edge, start, size, offsets
        coded = pc.dictionary_encode(words)
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()
        self.langs = Vocabulary(pa.array([x.encode() for x in langs], pa.large_binary()))
        self.lang = self.langs.labels[doc]
        #: words of each language, by its label
        self.totals = np.bincount(self.lang, minlength=len(self.langs.words) + 1)

    def cells(self, bits: int) -> list[np.ndarray]:
        """The sketch's cells of each word alone, with its successor and with two successors (-1 beyond the piece)."""
        word = _hashes(self.words.to_pylist())[self.code]
        prefix, out, n = self.langs.hashes()[self.lang], [], len(self.code)
        for j in range(SKETCHED):
            # prefixes at the end of the slice, whose words are missing, are cut off
            prefix = _onward(prefix[:n - j], word[j:])
            cell = np.full(n, -1, np.int64)
            near = self.piece[j:] == self.piece[:n - j]
            cell[:n - j][near] = (prefix[near] >> np.uint64(64 - bits)).astype(np.int64)
            out.append(cell)
        return out


class Windows:
    """Distinct windows of a slice in order: ``rows`` (language, words; 0 after the end) and ``weight``.

    A window ends before a word, pair or triple whose cell is not set in ``frequent`` (bits in bytes): no phrase with
    it can be frequent.
    """

    def __init__(self, tokens: Tokens, frequent: np.ndarray, bits: int):
        self.langs = tokens.langs
        known = [(cell >= 0) & _is_set(frequent, np.maximum(cell, 0)) for cell in tokens.cells(bits)]
        good, n = known[0], len(known[0])
        used, code = np.unique(tokens.code[good], return_inverse=True)
        self.vocabulary = Vocabulary(tokens.words.take(pa.array(used)))
        label = np.zeros(n + LONGEST, np.int32)
        label[:n][good] = self.vocabulary.labels[code]
        start = np.flatnonzero(good)
        window = np.zeros((len(start), 1 + LONGEST), np.int32)
        window[:, 0] = tokens.lang[start]
        on = np.ones(len(start), bool)
        for j in range(LONGEST):
            # the word, and the pair and the triple that end with it
            for k in range(min(j + 1, SKETCHED)):
                on &= (start + j < n) & known[k][np.minimum(start + j - k, n - 1)]
            window[:, 1 + j] = np.where(on, label[start + j], 0)
        window = window[_order(window)]
        new = np.ones(len(window), bool)
        new[1:] = (window[1:] != window[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.rows, self.weight = window[first], np.diff(np.concatenate([first, [len(window)]])).astype(np.int64)

    def prefixes(self) -> Iterator[np.ndarray]:
        """For each prefix length from 1 the prefix's hash of every window."""
        word = self.vocabulary.hashes()
        now = self.langs.hashes()[self.rows[:, 0]]
        for j in range(1, 1 + LONGEST):
            now = _onward(now, word[self.rows[:, j]])
            yield now


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _order(window: np.ndarray) -> np.ndarray:
    """Places of the rows in lexicographic order, by as few keys as fit into 64 bits."""
    keys, now, used = [], np.zeros(len(window), np.uint64), 0
    for j in range(window.shape[1]):
        bits = int(window[:, j].max(initial=0)).bit_length()
        if used + bits > 64:
            keys.append(now)
            now, used = np.zeros(len(window), np.uint64), 0
        now, used = (now << np.uint64(bits)) | window[:, j].astype(np.uint64), used + bits
    return np.lexsort([*keys, now][::-1])


class Level:
    """Arcs between two neighbouring depths: state s has the arcs first[s] to first[s + 1], in label order."""

    __slots__ = ("first", "label", "weight", "target")

    def __init__(self, first, label, weight, target):
        self.first, self.label, self.weight, self.target = first, label, weight, target


def build(rows_: np.ndarray, weight: np.ndarray, apart: np.ndarray) -> list[Level]:
    """Count transducer of sorted windows; states of rows that differ in ``apart`` (sorted first) are never shared.

    The first level has one state for each value of ``apart``.
    """
    n, depth = rows_.shape
    changed = np.zeros(n, bool)
    changed[:1] = True
    changed[1:] = apart[1:] != apart[:-1]
    parent_row = np.cumsum(changed) - 1  # the arc (here: the state) that each row belongs to
    states, levels, where = int(changed.sum()), [], []
    for j in range(depth):
        changed[1:] |= rows_[1:, j] != rows_[:-1, j]
        groups = np.flatnonzero(changed)
        sums = np.add.reduceat(weight, groups) if n else weight[:0]
        real = rows_[groups, j] > 0
        arcs = groups[real]
        first = np.searchsorted(parent_row[arcs], np.arange(states + 1))
        levels.append(Level(first, rows_[arcs, j], sums[real], np.zeros(len(arcs), np.int64)))
        where.append(apart[arcs])
        started = np.zeros(n, np.int64)
        started[arcs] = 1
        parent_row, states = np.cumsum(started) - 1, len(arcs)
    # states with equal arcs become one, from the last level up
    shared = np.zeros(states, np.int64)
    for j in range(depth - 1, -1, -1):
        level = levels[j]
        level.target = shared if j < depth - 1 else np.zeros(len(level.label), np.int64)
        if j == 0:
            break
        size, owner = np.diff(level.first), where[j - 1]
        arc = mix(level.label.astype(np.uint64) * _STEP + mix(level.weight.astype(np.uint64))
                  + mix(level.target.astype(np.uint64) + _STEP))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arc)])
        name = mix(total[level.first[1:]] - total[level.first[:-1]] + mix(owner.astype(np.uint64) * _STEP))
        _, chosen, of = np.unique(name, return_index=True, return_inverse=True)
        like = chosen[of]
        # a state stays itself unless all its arcs equal those of the chosen one
        same = (size == size[like]) & (owner == owner[like])
        from_arc = np.repeat(level.first[:-1], size)
        to_arc = np.repeat(level.first[like], size) + np.arange(len(level.label)) - from_arc
        to_arc = np.minimum(to_arc, max(len(level.label) - 1, 0))
        equal = (level.label == level.label[to_arc]) & (level.weight == level.weight[to_arc]) \
            & (level.target == level.target[to_arc])
        wrong = np.concatenate([[0], np.cumsum(~equal)])
        same &= wrong[level.first[1:]] == wrong[level.first[:-1]]
        like = np.where(same, like, np.arange(len(size)))
        kept = np.unique(like)
        shared = np.searchsorted(kept, like)
        take = np.repeat(level.first[kept], size[kept])
        inner = np.arange(len(take)) - np.repeat(np.cumsum(size[kept]) - size[kept], size[kept])
        take = take + inner
        levels[j] = Level(np.concatenate([[0], np.cumsum(size[kept])]), level.label[take], level.weight[take],
                          level.target[take])
        where[j - 1] = owner  # of all states; the kept ones' owners are owner[kept]
        levels[j].first = levels[j].first.astype(np.int64)
    return levels


def _packed(words: pa.Array) -> bytes:
    body = words.to_pylist()
    return struct.pack("<q", len(body)) + np.fromiter(map(len, body), np.int32, len(body)).tobytes() + b"".join(body)


def _unpacked(data: bytes, at: int) -> tuple[pa.Array, int]:
    n, = struct.unpack_from("<q", data, at)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int32, n, at + 8), dtype=np.int64)])
    at += 8 + 4 * n
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [
        None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at:at + int(offsets[-1])])])
    return words, at + int(offsets[-1])


def pack(levels: list[Level], langs: pa.Array, words: pa.Array) -> bytes:
    """A transducer with the words on its arcs as one compressed value."""
    used = np.unique(np.concatenate([level.label for level in levels[1:]]))
    wide = max(int(level.weight.max(initial=0)) for level in levels) >> 31 > 0
    out = [b"\x01" if wide else b"\0", _packed(langs), _packed(words.take(pa.array(used - 1)))]
    for k, level in enumerate(levels):
        label = level.label if k == 0 else np.searchsorted(used, level.label) + 1
        out.append(struct.pack("<qq", len(level.first) - 1, len(label)))
        # labels and targets mostly rise: their differences compress well
        out += [np.diff(level.first).astype(np.int32).tobytes(), np.diff(label, prepend=0).astype(np.int32).tobytes(),
                level.weight.astype(np.int64 if wide else np.int32).tobytes(),
                np.diff(level.target, prepend=0).astype(np.int32).tobytes()]
    body = b"".join(out)
    return struct.pack("<q", len(body)) + _compressed(body)


def unpack(value: bytes) -> tuple[list[Level], pa.Array, pa.Array]:
    data = _plain(value[8:], struct.unpack_from("<q", value)[0])
    kind = np.int64 if data[0] else np.int32
    langs, at = _unpacked(data, 1)
    words, at = _unpacked(data, at)
    levels = []
    for _ in range(1 + LONGEST):
        states, arcs = struct.unpack_from("<qq", data, at)
        at += 16
        size = np.frombuffer(data, np.int32, states, at)
        at += 4 * states
        label = np.cumsum(np.frombuffer(data, np.int32, arcs, at), dtype=np.int32)
        weight = np.frombuffer(data, kind, arcs, at + 4 * arcs).astype(np.int64)
        at += 4 * arcs + kind().itemsize * arcs
        target = np.cumsum(np.frombuffer(data, np.int32, arcs, at), dtype=np.int32)
        at += 4 * arcs
        levels.append(Level(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), label, weight, target))
    return levels, langs, words


def ranges(windows: Windows, hot: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """The slice's transducer, cut: (range, value) for each range that has windows."""
    place = np.full(len(windows.rows), -1, np.int64)
    for j, prefix in enumerate(windows.prefixes(), 1):
        at = np.minimum(np.searchsorted(hot, prefix), max(len(hot) - 1, 0))
        cold = (hot[at] != prefix) if len(hot) and j < LONGEST else np.ones(len(prefix), bool)
        now = cold & (place < 0)
        place[now] = (prefix[now] % np.uint64(parts)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place = place[order]
    levels = build(windows.rows[order], windows.weight[order], place)
    ids = np.unique(place)
    # states and arcs of a range stand together at every level
    state = np.arange(len(ids) + 1)
    cuts = []
    for k, level in enumerate(levels):
        arcs = level.first[state]
        cuts.append((state, arcs))
        if k < LONGEST:
            # sharing keeps states in the order of their first row, so a range's states stay together
            state = np.array([0 if a == b else int(level.target[a:b].max()) + 1 for a, b in zip(arcs[:-1], arcs[1:])])
            state = np.concatenate([[0], np.maximum.accumulate(state)])
    out = []
    for r, place_ in enumerate(ids.tolist()):
        mine = []
        for k, level in enumerate(levels):
            (s0, s1), (a0, a1) = cuts[k][0][r:r + 2], cuts[k][1][r:r + 2]
            base = cuts[k + 1][0][r] if k < LONGEST else 0
            mine.append(Level(level.first[s0:s1 + 1] - level.first[s0], level.label[a0:a1], level.weight[a0:a1],
                              level.target[a0:a1] - base))
        out.append((place_, pack(mine, windows.langs.words, windows.vocabulary.words)))
    return out


def union(values: list[bytes], hot: np.ndarray, least: int) -> Iterator[tuple[str, str, int, int, bool]]:
    """``lang, phrase, words, count, partial`` of all n-grams of one range that are frequent (or hot, so partial)."""
    shards = [unpack(v) for v in values]
    langs = Vocabulary(pa.concat_arrays([s[1] for s in shards]))
    words = Vocabulary(pa.concat_arrays([s[2] for s in shards]))
    levels, base = [], [np.concatenate([[0], np.cumsum([len(s[i]) for s in shards])]) for i in (1, 2)]
    for k in range(1 + LONGEST):
        names, at = (langs, base[0]) if k == 0 else (words, base[1])
        arcs = np.concatenate([[0], np.cumsum([len(s[0][k].label) for s in shards])])
        states = np.concatenate([[0], np.cumsum([len(s[0][k + 1].first) - 1 for s in shards])]) if k < LONGEST else arcs * 0
        levels.append(Level(
            np.concatenate([[0], *[s[0][k].first[1:] + arcs[i] for i, s in enumerate(shards)]]),
            np.concatenate([names.labels[s[0][k].label - 1 + at[i]] for i, s in enumerate(shards)]),
            np.concatenate([s[0][k].weight for s in shards]),
            np.concatenate([s[0][k].target.astype(np.int64) + states[i] for i, s in enumerate(shards)])))
    del shards
    word_hash, lang_hash = words.hashes(), langs.hashes()
    word_list, lang_list = [w.decode() for w in words.words.to_pylist()], [x.decode() for x in langs.words.to_pylist()]
    state, merged = np.arange(len(levels[0].first) - 1), np.zeros(len(levels[0].first) - 1, np.int64)
    prefix, text = None, [None]
    for k, level in enumerate(levels):
        size = level.first[state + 1] - level.first[state]
        arc = np.repeat(level.first[state], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        parent, label = np.repeat(merged, size), level.label[arc]
        order = np.lexsort((label, parent))
        arc, parent, label = arc[order], parent[order], label[order]
        new = np.ones(len(arc), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return
        count = np.add.reduceat(level.weight[arc], first)
        if k == 0:
            here, partial = lang_hash[label[first]], np.ones(len(first), bool)
        else:
            here = _onward(prefix[parent[first]], word_hash[label[first]])
            partial = np.isin(here, hot) if k < LONGEST else np.zeros(len(first), bool)
        keep = partial | (count >= least)
        texts = []
        for p, x, c, part in zip(parent[first][keep].tolist(), label[first][keep].tolist(), count[keep].tolist(),
                                 partial[keep].tolist()):
            if k == 0:
                texts.append((lang_list[x - 1], ""))
            else:
                lang, before = text[p]
                texts.append((lang, f"{before} {word_list[x - 1]}" if k > 1 else word_list[x - 1]))
                yield *texts[-1], k, c, part
        group = np.cumsum(new) - 1
        stays = keep[group]
        state, merged = level.target[arc[stays]], (np.cumsum(keep) - 1)[group[stays]]
        prefix, text = here[keep], texts


def _slices(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[Tokens]:
    for other, texts in rows(batches, max_bytes):
        found = Tokens(texts, other["lang"])
        if len(found.code):
            yield found


def _sketch(bits: int, max_bytes: int):
    """Counts of words, pairs and triples by cell (at most 255), in blocks; and the words of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, totals = np.zeros(1 << bits, np.uint8), {}
        for t in _slices(batches, max_bytes):
            for found in t.cells(bits):
                at, count = np.unique(found[found >= 0], return_counts=True)
                cells[at] = np.minimum(cells[at] + count, 255)
            for name, n in zip(t.langs.words.to_pylist(), t.totals[1:].tolist()):
                totals[name.decode()] = totals.get(name.decode(), 0) + n
        size = min(_BLOCK, len(cells))
        for k in range(0, len(cells), size):
            if (block := cells[k:k + size]).any():
                yield pa.RecordBatch.from_pylist([{"lang": None, "block": k // size, "n": 0, "value": _compressed(block.tobytes())}], _SKETCH)
        if totals:
            yield pa.RecordBatch.from_pylist([{"lang": x, "block": None, "n": n, "value": None}
                                              for x, n in totals.items()], _SKETCH)
    return run


def _frequent(least: int, size: int):
    """Bits of the cells that reach ``least`` in the sum of a block's rows, which follow one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array(
                [np.packbits(total >= min(least, 255)).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for at, value in zip(batch.column("block").to_pylist(), batch.column("value").to_pylist()):
                if at != block:
                    if total is not None:
                        yield result()
                    block, total = at, np.zeros(size, np.uint16)
                total = np.minimum(total + np.frombuffer(_plain(value, size), np.uint8), 255)
        if total is not None:
            yield result()
    return run


def _report(frequent, bits: int, parts: int, max_bytes: int):
    """The number of windows (prefix 0) and of those of every prefix that may be hot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _slices(batches, max_bytes):
            w = Windows(t, frequent.value, bits)
            least = max(2, len(w.rows) // (2 * parts))
            keys, sizes = [np.zeros(1, np.uint64)], [np.array([len(w.rows)])]
            for j, prefix in enumerate(w.prefixes(), 1):
                if j < LONGEST and len(prefix):
                    new = np.ones(len(prefix), bool)
                    new[1:] = prefix[1:] != prefix[:-1]
                    first = np.flatnonzero(new)
                    size = np.diff(np.concatenate([first, [len(prefix)]]))
                    keys.append(prefix[first][size >= least])
                    sizes.append(size[size >= least])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sizes).astype(np.int64))],
                ["prefix", "size"])
    return run


def _transducers(frequent, bits: int, hot: np.ndarray, parts: int, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _slices(batches, max_bytes):
            w = Windows(t, frequent.value, bits)
            del t
            if len(w.rows):
                cut = ranges(w, hot, parts)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in cut], pa.int64()),
                                                  pa.array([v for _, v in cut], pa.binary())], ["part", "value"])
    return run


_COUNTS = "lang string, phrase string, words int, count long, partial boolean"


def _union(hot: np.ndarray, least: int):
    def run(table: pa.Table) -> pa.Table:
        found = list(union(table.column("value").to_pylist(), hot, least))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_())
        return pa.table([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)],
                        ["lang", "phrase", "words", "count", "partial"])
    return run


def _composition(counted: pa.Table, asked: pa.Table) -> pa.Table:
    """Counts of the asked parts: the transducer of the range's counts composed with that of the parts."""
    empty = pa.table({"lang": pa.array([], pa.string()), "part": pa.array([], pa.string()),
                      "candidate": pa.array([], pa.string()), "cut": pa.array([], pa.int32()),
                      "head": pa.array([], pa.bool_()), "a": pa.array([], pa.int64()), "count": pa.array([], pa.int64())})
    if not asked.num_rows or not counted.num_rows:
        return empty
    phrases = pa.concat_arrays([*counted.column("phrase").chunks, *asked.column("part").chunks])
    langs = pa.concat_arrays([*counted.column("lang").chunks, *asked.column("tongue").chunks])
    lists = pc.split_pattern(phrases.cast(pa.large_string()), " ")
    words = Vocabulary(lists.flatten().cast(pa.large_binary()))
    sizes = pc.list_value_length(lists).to_numpy()
    path = np.zeros((len(phrases), 1 + LONGEST), np.int64)
    path[:, 0] = Vocabulary(langs.cast(pa.large_binary())).labels
    row = np.repeat(np.arange(len(sizes)), sizes)
    path[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = words.labels
    n, width = counted.num_rows, len(words.words) + len(phrases) + 1
    # the states of the counts' trie: an arc is (state, label); its rank is the state it leads to
    state, ask = np.zeros(n, np.int64), np.zeros(len(phrases) - n, np.int64)
    alive = np.ones(len(ask), bool)
    weight = counted.column("count").to_numpy()
    found = np.zeros(len(ask), np.int64)
    for j in range(1 + LONGEST):
        going, to = path[:n, j] > 0, path[n:, j]
        arcs = np.unique(state[going] * width + path[:n, j][going])
        if not len(arcs):
            break
        at = np.minimum(np.searchsorted(arcs, ask * width + to), len(arcs) - 1)
        alive &= (to == 0) | (arcs[at] == ask * width + to)
        ask = np.where(to > 0, at, ask)
        state = np.where(going, np.searchsorted(arcs, state * width + path[:n, j]), state)
        last = going & (path[:n, j + 1] == 0 if j < LONGEST else True)
        total = np.zeros(len(arcs), np.int64)
        total[state[last]] = weight[last]
        ends = (to > 0) & (path[n:, j + 1] == 0 if j < LONGEST else True) & alive
        found[ends] = total[ask[ends]]
    return pa.table({"lang": asked.column("tongue"), "part": asked.column("part"), "candidate": asked.column("candidate"),
                     "cut": asked.column("cut"), "head": asked.column("head"), "a": asked.column("a"),
                     "count": pa.array(found)}).cast(empty.schema)


def _range_of(phrase: Column, parts: int) -> Column:
    """Range of a phrase in the composition: by language and first two words."""
    return F.pmod(F.xxhash64("lang", F.substring_index(phrase, " ", 2)), F.lit(parts))


def count_phrases(documents: DataFrame, scratch: Scratch, least: int = LEAST, lang_col: str = "lang",
                  text_col: str = "text", slice_bytes: int = SLICE_BYTES,
                  range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to 5 words that occur ``least`` times in a language, and the words of each language."""
    docs = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                            text_bytes(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = tasks_for(size, range_bytes)
    bits = min(MOST_BITS, max(FEWEST_BITS, (size // CELL_BYTES).bit_length()))
    spark, block = documents.sparkSession, min(_BLOCK, 1 << bits)
    sketch = scratch.keep(docs.mapInArrow(_sketch(bits, slice_bytes), "lang string, block long, n long, value binary"),
                          "sketch")
    totals = scratch.keep(sketch.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for r in (sketch.filter("block IS NOT NULL").select("block", "value").repartition("block")
              .sortWithinPartitions("block").mapInArrow(_frequent(least, block), "block long, bits binary").collect()):
        bitmap[r.block * block // 8:(r.block + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    scratch.drop("sketch")
    frequent = spark.sparkContext.broadcast(bitmap)
    prefixes = (docs.mapInArrow(_report(frequent, bits, parts, slice_bytes), "prefix long, size long")
                .groupBy("prefix").agg(F.sum("size").alias("size")))
    if parts > 1:
        prefixes = scratch.keep(prefixes, "prefixes")
        windows = prefixes.filter("prefix = 0").agg(F.max("size")).first()[0] or 0
        # at most 2 x 4 x parts prefixes, eight bytes each
        hot = np.array([r.prefix for r in prefixes.filter(
            (F.col("prefix") != 0) & (F.col("size") > windows / (2 * parts))).select("prefix").collect()], np.int64)
    else:
        hot = np.zeros(0, np.int64)
    hot = np.sort(hot.view(np.uint64))
    cut = docs.mapInArrow(_transducers(frequent, bits, hot, parts, slice_bytes), "part long, value binary")
    counts = scratch.keep(cut.groupBy("part").applyInArrow(_union(hot, least), _COUNTS), "partial")
    summed = (counts.filter("partial").groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count"))
              .filter(F.col("count") >= least))
    return scratch.keep(counts.filter("NOT partial").drop("partial").unionByName(summed), "counts"), totals


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text",
                 slice_bytes: int = SLICE_BYTES, range_bytes: int = RANGE_BYTES,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(documents.sparkSession, "collocations")
    counts, totals = count_phrases(documents, scratch, least, lang_col, text_col, slice_bytes, range_bytes)
    candidates = counts.filter("words > 1").select("lang", F.col("phrase").alias("candidate"), "words",
                                                   F.col("count").alias("a"))

    def words_of(phrase: str, count: Column) -> Column:
        return F.call_function("substring_index", F.col(phrase), F.lit(" "), count)

    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array(
        F.struct(k.alias("cut"), F.lit(True).alias("head"), words_of("candidate", k).alias("part")),
        F.struct(k.alias("cut"), F.lit(False).alias("head"), words_of("candidate", k - F.col("words")).alias("part")))))
    parts = tasks_for(counts.count() * 8, range_rows)
    asked = (candidates.withColumn("c", F.explode(cuts))
             .select("lang", "candidate", "a", "c.*").withColumn("range", _range_of(F.col("part"), parts)))
    # a range that is asked often is read by several tasks
    copies = asked.groupBy(F.col("range").alias("of")).agg(F.ceil(F.count("*") / range_rows).cast("int").alias("copies"))
    asked = (asked.join(copies, F.col("range") == F.col("of"))
             .withColumn("copy", F.pmod(F.xxhash64("candidate", "cut"), F.col("copies")).cast("int"))
             .select(F.col("lang").alias("tongue"), "part", "candidate", "cut", "head", "a", "range", "copy"))
    counted = (counts.withColumn("range", _range_of(F.col("phrase"), parts)).join(copies, F.col("range") == F.col("of"))
               .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
               .select("lang", "phrase", "count", "range", "copy"))
    found = scratch.keep(counted.groupBy("range", "copy").cogroup(asked.groupBy("range", "copy")).applyInArrow(
        _composition, "lang string, part string, candidate string, cut int, head boolean, a long, count long"), "found")
    # a part as frequent as a candidate one word longer is dropped; counts never rise with length, so this covers longer ones
    inside = found.filter("count = a AND instr(part, ' ') > 0 AND "
                          "size(split(candidate, ' ')) = size(split(part, ' ')) + 1").select(
        F.col("lang").alias("in_lang"), "part").distinct()
    by_cut = found.groupBy("lang", "candidate", "a").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("head"), F.struct("cut", "count")))).alias("l"),
        F.map_from_entries(F.collect_list(F.when(~F.col("head"), F.struct("cut", "count")))).alias("r"))

    def exact(c: Column) -> Column:
        return c.cast("decimal(18,0)")

    by_cut = by_cut.join(inside, (F.col("lang") == F.col("in_lang")) & (F.col("candidate") == F.col("part")), "left_anti")
    by_cut = by_cut.join(totals, "lang")
    # 1000 a n and l r stay below 10^38
    scored = F.transform(F.map_keys("l"), lambda k: F.struct(
        F.call_function("div", (exact(F.lit(1000)) * exact(F.col("n"))).cast("decimal(20,0)") * exact(F.col("a")),
                        exact(F.col("l")[k]) * exact(F.col("r")[k])).alias("score"),
        k.alias("cut"), F.col("l")[k].alias("l"), F.col("r")[k].alias("r")))
    ranked = by_cut.select("lang", F.col("candidate").alias("phrase"), "a", "n", F.array_min(scored).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    return (ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n",
                    F.col("best.score").cast("long").alias("score")))
