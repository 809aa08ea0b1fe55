"""SentencePiece encoding and decoding with the N best segmentations.

Every span of a text that is a piece is an edge of a lattice, scored as the model scores the piece; a character that no
piece holds is an edge of its byte pieces. A forward Viterbi pass gives the best score up to each position, and that
score is an exact heuristic for an A* search from the end backwards: paths leave the queue best first, so the first N
complete ones are the N best. No piece of the model holds a space mark after another character or a line end, so the lattice of a
text is a chain of the lattices of its words. A word's forward pass (all distinct words of a slice at once) keeps its two best scores; the N best paths of a
text change only words among the N - 1 with the least loss, and only those are searched backwards.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, text_bytes
from .words import mix, powers

MARK = "▁"
SLICE_BYTES = 2 << 20
BLOCK_WORDS = 8192
LONG_WORD = 48
#: Words whose N best paths are remembered between slices.
SEARCHED_WORDS = 20_000
_OUT = ("doc_id long, ids array<int>, n_pieces long, scores array<double>, "
        "changes array<array<struct<at:int,n:int,ids:array<int>>>>, text_crc32 long, round_trip boolean")


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPREAD = 0xD6E8FEB86659FD93
_BYTES = np.arange(1, 257, dtype=np.uint64)
_MARK_BYTES = MARK.encode()


def _gather(layers: list[np.ndarray], layer: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    out = np.empty(len(layer), np.int32)
    for k in np.unique(layer).tolist():
        here = layer == k
        out[here] = layers[k - 1][row[here], col[here]]
    return out


def _valid(text: bytes) -> bytes:
    """The text, with U+FFFD for bytes that are no UTF-8."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


def as_marked(word: np.ndarray) -> str:
    return word.tobytes().decode().replace(" ", MARK)


class PieceModel:
    """Pieces, scores and the decoder of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = [b""] * sp.get_piece_size()
        self.byte_id = {}
        pieces = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[piece] = (sp.get_score(i), i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece spans a word or line end; words can't be segmented one by one")
        self.id_of = {p: i for p, (_, i) in pieces.items()}
        # every prefix of a piece leads on; only pieces have a score
        self.score: dict[str, float | None] = {p[:k]: None for p in pieces for k in range(1, len(p))}
        self.score.update({p: s for p, (s, _) in pieces.items()})
        self.unknown = min(s for s, _ in pieces.values() if s > -1e8) - 10.0
        self._table = None

    def edges(self, word: str, i: int) -> Iterator[tuple[int, float]]:
        """(end, score) of the edges that start at ``i``."""
        single = False
        for j in range(i + 1, len(word) + 1):
            score = self.score.get(word[i:j], 0)
            if score == 0 and word[i:j] not in self.score:
                break
            if score is not None:
                single |= j == i + 1
                yield j, score
        if not single:
            yield i + 1, self.unknown

    def ids(self, word: str, i: int, j: int) -> list[int]:
        found = self.id_of.get(word[i:j])
        return [found] if found is not None else [self.byte_id[b] for b in word[i:j].encode()]

    def best(self, word: str) -> tuple[bytes, float, float]:
        """Ids of the best path (as 32-bit integers), its score, and the loss of the second best (inf, if none)."""
        n = len(word)
        table, unknown = self.score, self.unknown
        first, second, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1), [0] * (n + 1)
        first[0] = 0.0
        for i in range(n):
            a, b = first[i], second[i]
            j, single = i + 1, False
            while j <= n:
                span = word[i:j]
                if span not in table:
                    break
                s = table[span]
                if s is not None:
                    single = single or j == i + 1
                    v = a + s
                    if v > first[j]:
                        second[j] = first[j] if first[j] > b + s else b + s
                        first[j], back[j] = v, i
                    elif v > second[j]:
                        second[j] = v
                j += 1
            if not single:
                v, j = a + unknown, i + 1
                if v > first[j]:
                    second[j] = max(first[j], b + unknown)
                    first[j], back[j] = v, i
                elif v > second[j]:
                    second[j] = v
        spans, j = [], n
        while j:
            spans.append((back[j], j))
            j = back[j]
        ids = [x for i, j in reversed(spans) for x in self.ids(word, i, j)]
        return np.array(ids, np.int32).tobytes(), first[n], first[n] - second[n]

    def _prefix_table(self):
        """Sorted hashes of all piece prefixes (as UTF-8, a space for the mark), with score (nan: no piece) and id;
        and where the hashes with the same top bits begin."""
        if self._table is None:
            scores = {p.replace(MARK, " ").encode(): (s, self.id_of[p]) for p, s in self.score.items() if s is not None}
            keys = sorted({p[:k] for p in scores for k in range(1, len(p) + 1)})
            hashes = np.zeros(len(keys), np.uint64)
            for k, p in enumerate(keys):
                h = 0
                for c in p:
                    h = (h * _BASE + c + 1) & _MASK
                hashes[k] = h * _SPREAD & _MASK
            order = np.argsort(hashes)
            found = [scores.get(p, (np.nan, -1)) for p in keys]
            score, ids = np.array([f[0] for f in found]), np.array([f[1] for f in found], np.int32)
            hashes = np.append(hashes[order], np.uint64(_MASK))
            first = np.searchsorted(hashes[:-1] >> np.uint64(44), np.arange((1 << 20) + 1).astype(np.uint64))
            deepest = int(np.diff(first).max(initial=0))
            self._table = (hashes, np.append(score[order], np.nan), np.append(ids[order], np.int32(-1)),
                           first[:-1].astype(np.int32), deepest)
        return self._table

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """Place of each hash in the prefix table, -1 where it is none."""
        hashes, _, _, first, deepest = self._prefix_table()
        hashed = hashed * np.uint64(_SPREAD)
        at = first[(hashed >> np.uint64(44)).astype(np.int64)]
        out = np.where(hashes[at] == hashed, at, -1)
        for k in range(1, deepest):
            next_ = np.minimum(at + k, len(hashes) - 2)
            out = np.where((out < 0) & (hashes[next_] == hashed), next_, out)
        return out

    def best_of_many(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """``best`` of the words at ``start`` of length ``size`` in ``data`` (UTF-8, spaces for marks): ids end to end,
        ids of each word, scores, losses of the second best.

        The forward pass runs over blocks of words of like length, all words of a block at once. Words with a
        character that is no piece, and very long ones, take the plain pass.
        """
        score, gap = np.zeros(len(size)), np.zeros(len(size))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, place, id
        order = np.argsort(size, kind="stable")
        plain = order[size[order] > LONG_WORD].tolist()
        order = order[size[order] <= LONG_WORD]
        for at in range(0, len(order), BLOCK_WORDS):
            chosen = order[at:at + BLOCK_WORDS]
            plain += self._block(data, start[chosen], size[chosen], chosen, score, gap, parts)
        for w in plain:
            ids, score[w], gap[w] = self.best(as_marked(data[start[w]:start[w] + size[w]]))
            ids = np.frombuffer(ids, np.int32)
            parts.append((np.full(len(ids), w), np.arange(len(ids)), ids))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), score, gap
        word, place, ids = (np.concatenate(x) for x in zip(*parts))
        back = np.lexsort((place, word))
        return ids[back], np.bincount(word, minlength=len(size)), score, gap

    def _block(self, data, begin, size, chosen, score, gap, parts) -> list[int]:
        _, scores, piece, _, _ = self._prefix_table()
        n, longest = len(chosen), int(size[-1])
        column = np.repeat(np.arange(n), size)
        place = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)
        code = data[np.repeat(begin, size) + place]
        text = np.zeros((longest, n), np.uint8)  # one column a word
        text[place, column] = code
        edge, ids = [], []
        live = (code & 0xC0) != 0x80  # edges start at characters
        row, col = place[live], column[live]
        width = np.where(code < 0x80, 1, np.where(code < 0xE0, 2, np.where(code < 0xF0, 3, 4)))[live]
        alone = np.zeros(len(row), bool)  # has an edge of its own
        which = np.arange(len(row))
        hashed = np.zeros(len(row), np.uint64)
        with np.errstate(over="ignore"):
            for length in range(1, longest + 1):
                live = row + length <= size[col]
                row, col, hashed, which = row[live], col[live], hashed[live], which[live]
                hashed = hashed * np.uint64(_BASE) + text[row + length - 1, col] + np.uint64(1)
                found = self._find(hashed)
                live = found >= 0
                row, col, hashed, which, found = row[live], col[live], hashed[live], which[live], found[live]
                if not len(row):
                    break
                value = scores[found]
                is_piece = ~np.isnan(value)
                r, c = row[is_piece], col[is_piece]
                alone[which[is_piece & (width[which] == length)]] = True
                s = np.full((longest, n), -np.inf)
                s[r, c] = value[is_piece]
                k = np.zeros((longest, n), np.int32)
                k[r, c] = piece[found[is_piece]]
                edge.append(s)
                ids.append(k)
        first, second = np.full((longest + 1, n), -np.inf), np.full((longest + 1, n), -np.inf)
        step = np.zeros((longest + 1, n), np.int32)
        first[0] = 0.0
        for end in range(1, longest + 1):
            a, b, back = first[end], second[end], step[end]
            for length in range(min(len(edge), end), 0, -1):  # of equal paths, the longer last piece
                s = edge[length - 1][end - length]
                new = first[end - length] + s
                np.maximum(b, np.minimum(a, new), out=b)
                np.maximum(b, second[end - length] + s, out=b)
                back[new > a] = length
                np.maximum(a, new, out=a)
        # a character without an edge of its own has an unknown edge: those words take the plain pass
        odd = np.zeros(n, bool)
        odd[column[(code & 0xC0) != 0x80][~alone]] = True
        score[chosen] = first[size, np.arange(n)]
        with np.errstate(invalid="ignore"):
            gap[chosen] = score[chosen] - second[size, np.arange(n)]
        at, col = size[~odd].copy(), np.flatnonzero(~odd)
        while len(col):
            length = step[at, col]
            start = at - length
            parts.append((chosen[col], start, _gather(ids, length, start, col)))
            at, col = start[start > 0], col[start > 0]
        return chosen[odd].tolist()

    def n_best(self, word: str, count: int) -> list[tuple[float, list[int]]]:
        """Backward A* over the lattice of ``word``: the ``count`` best paths, best first."""
        n = len(word)
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            for j, s in self.edges(word, i):
                into[j].append((i, s))
                forward[j] = max(forward[j], forward[i] + s)
        queue, found, made = [(-forward[n], 0, n, 0.0, None)], [], 0
        while queue and len(found) < count:
            minus, _, at, done, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path:
                    ids += self.ids(word, path[0], path[1])
                    path = path[2]
                found.append((-minus, ids))
                continue
            for i, s in into[at]:
                made += 1
                heapq.heappush(queue, (-(done + s + forward[i]), made, i, done + s, (i, at, path)))
        return found

    def decode(self, ids) -> bytes:
        """Bytes of the text; the space that encoding puts in front is removed."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


class Encoder:
    """N best segmentations of texts, a list of texts at a time: each distinct word is segmented once a list."""

    def __init__(self, model: PieceModel, count: int):
        self.model, self.count = model, count
        self.searched: dict[str, list] = {}

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[float], list[list[tuple[int, int, list[int]]]]]]:
        """For each text the ids of the best segmentation, the scores of the N best, and for each further one its
        changes to the best: (position, number of ids replaced, new ids)."""
        raw = [b" " + t.replace(_MARK_BYTES, b" ") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        bound = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        # a unit begins at a text's start, at a run of spaces, at a line end, and after one
        begins = np.zeros(len(data) + 1, bool)
        begins[bound] = True
        space, line = data == 0x20, data == 0x0A
        begins[:-1] |= line
        begins[1:] |= line
        if len(data):
            begins[1:-1] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(begins[:-1])
        size = np.diff(np.append(start, len(data)))
        which, one = self._distinct(data, start, size)
        ids, long, score, gap = self.model.best_of_many(data, start[one], size[one])
        begin = np.cumsum(long) - long
        cut = np.searchsorted(start, bound)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if a == b:
                yield np.zeros(0, np.int32), [], []
                continue
            mine = which[a:b]
            n = long[mine]
            to = np.cumsum(n) - n
            flat = ids[np.arange(int(n.sum())) + np.repeat(begin[mine] - to, n)]
            word = lambda k: as_marked(data[start[a + k]:start[a + k] + size[a + k]])  # noqa: B023, E731
            yield flat, *self._others(word, float(score[mine].sum()), gap[mine], to, n)

    @staticmethod
    def _distinct(data, start, size) -> tuple[np.ndarray, np.ndarray]:
        """Number of each unit among the distinct ones, and one place of each (by 64-bit hash and length)."""
        power, inverse = powers(len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(_BYTES)[data] * power[:len(data)])])
        name = mix((total[start + size] - total[start]) * inverse[start] + size.astype(np.uint64))
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        return which, one

    def _others(self, word, best, gap, start, long):
        at = [k for k in self._least(gap) if math.isfinite(gap[k])]
        scores, changes = [best], []
        if at:
            found = [self._search(word(k)) for k in at]
            losses = sorted(f[0][0] - x for f in found for x, _ in f[1:])
            most = losses[:self.count - 1][-1]  # one change each already gives this many segmentations
            options = [[(f[0][0] - x, y) for x, y in f if f[0][0] - x <= most] for f in found]
            ranked = sorted((sum([o[c][0] for o, c in zip(options, pick)]), pick)
                            for pick in product(*(range(len(o)) for o in options)))
            for loss, pick in ranked[1:self.count]:
                scores.append(best - loss)
                changes.append(sorted((int(start[k]), int(long[k]), o[c][1])
                                      for k, o, c in zip(at, options, pick) if c))
        return scores, changes

    def _least(self, gap: np.ndarray) -> list[int]:
        """Places of the ``count - 1`` smallest losses, ties by place."""
        want = self.count - 1
        if want <= 0:
            return []
        at = np.arange(len(gap))
        if len(gap) > want:
            at = np.flatnonzero(gap <= np.partition(gap, want - 1)[want - 1])
        return at[np.lexsort((at, gap[at]))][:want].tolist()

    def _search(self, word: str) -> list:
        found = self.searched.get(word)
        if found is None:
            if len(self.searched) >= SEARCHED_WORDS:
                self.searched.clear()
            found = self.searched[word] = self.model.n_best(word, self.count)
        return found


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model, read once a Python process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _encode(path: str, count: int):
    change = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()),
                        ("scores", pa.list_(pa.float64())), ("changes", pa.list_(pa.list_(change))),
                        ("text_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        encoder = Encoder(model, count)
        for other, texts in rows(batches, SLICE_BYTES):
            parts, scores, changes, crc, same = [], [], [], [], []
            for raw, (ids, s, c) in zip(texts, encoder.encode([_valid(t) for t in texts])):
                parts.append(ids)
                scores.append(s)
                changes.append([[{"at": a, "n": n, "ids": x} for a, n, x in alt] for alt in c])
                text = model.decode(ids.tolist())
                crc.append(zlib.crc32(text))
                same.append(text == raw)
            size = np.array([len(p) for p in parts], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()),
                                           pa.array(np.concatenate(parts), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(other["doc_id"], pa.int64()), ids, pa.array(size), pa.array(scores, schema.field("scores").type),
                 pa.array(changes, schema.field("changes").type), pa.array(crc, pa.int64()), pa.array(same)],
                schema=schema)
    return run


def encode_n_best(docs: DataFrame, model_path: str, count: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: the best segmentation's ``ids``, ``scores`` of the ``count`` best (fewer, where the text
    has fewer), ``changes`` that turn the best ids into each further segmentation, and the crc32 of the decoded ids.

    Decoding gives the text back byte for byte (``round_trip``), but for a text that holds U+2581 itself, which reads
    as a space. Null and empty texts give no ids, no scores and ``round_trip`` true. Equal scores keep the order in
    which the search finds them, so results are the same on every run. Texts are never cut. Other columns are
    ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(_encode(model_path, count), _OUT)
