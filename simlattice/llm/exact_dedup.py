"""Exact duplicates by Patricia tries.

Texts are dealt out by length and content hash. A task holds a radix trie with compressed edges whose keys are the
hash followed by all bytes of the text; a terminal keeps the owner (the smallest or largest identifier) and the
number of copies. Each input task first folds its own copies the same way, so a text with any number of copies sends
one row per input task. Rows reach a trie in hash order: when it holds more than its budget, every subtree left of the
current key is complete (no later row can fall into it) and is spilled to the task's output and freed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_bytes, whole_row

#: Bytes of edge labels a trie may hold before finished subtrees are spilled.
TRIE_BYTES = 16 << 20
_FIELDS = "n_bytes long, content_hash long, body binary, owner long, copies long, owner_rows long"


class _Node:
    __slots__ = ("label", "children", "owner", "copies", "owner_rows")

    def __init__(self, label: bytes, owner=None, copies: int = 0, owner_rows: int = 0):
        self.label, self.owner, self.copies, self.owner_rows, self.children = label, owner, copies, owner_rows, {}


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low:low + 1] != b[low:low + 1] else low + 1


class PatriciaTrie:
    """Radix trie of byte strings; ``pick`` chooses the owner of two identifiers (nulls lose)."""

    def __init__(self, pick=min):
        self.root, self.pick, self.held = _Node(b""), pick, 0

    def _own(self, node: _Node, owner, copies: int, owner_rows: int) -> None:
        if not node.copies or (node.owner is None and owner is not None):
            node.owner, node.owner_rows = owner, owner_rows
        elif owner == node.owner:
            node.owner_rows += owner_rows
        elif owner is not None and self.pick(node.owner, owner) == owner:
            node.owner, node.owner_rows = owner, owner_rows
        node.copies += copies

    def insert(self, key: bytes, owner, copies: int = 1, owner_rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], owner, copies, owner_rows)
                self.held += len(key) - at
                return
            label = child.label
            rest = key[at:at + len(label)]
            same = len(label) if rest == label else _common(label, rest)
            if same < len(label):
                upper = _Node(label[:same])
                child.label = label[same:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                child = upper
            node, at = child, at + same
        self._own(node, owner, copies, owner_rows)

    def take(self, below: bytes | None = None) -> Iterator[tuple[bytes, object, int, int]]:
        """Remove and return the terminals with keys less than ``below`` (all, if it is not given)."""
        stack = [(self.root, b"", below)]
        while stack:
            node, prefix, limit = stack.pop()
            if node.copies and (limit is None or limit != b""):
                yield prefix, node.owner, node.copies, node.owner_rows
                node.copies, node.owner = 0, None
            for first in sorted(node.children):
                child = node.children[first]
                if limit is None or child.label < limit[:len(child.label)]:
                    stack.append((child, prefix + child.label, None))
                    del node.children[first]
                    self.held -= len(child.label)
                elif child.label == limit[:len(child.label)]:
                    stack.append((child, prefix + child.label, limit[len(child.label):]))


def _key(content_hash: int, body: bytes) -> bytes:
    return ((content_hash + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big") + body


def _fold(pick_name: str, named: bool, budget: int):
    """Batches of (n_bytes, content_hash, body, owner, copies), folded by tries.

    ``named`` False is the fold inside an input task (rows in any order; the whole trie is spilled at its budget, the
    terminals stay mergeable); True is the final fold over rows sorted by (n_bytes, content_hash), one trie per length.
    """
    pick = {"min": min, "max": max}[pick_name]

    def out(found: list) -> pa.RecordBatch:
        keys, owners, copies, owner_rows = zip(*found)
        if named:
            third = ("text_sha256", pa.array([hashlib.sha256(memoryview(k)[8:]).hexdigest() for k in keys], pa.string()))
        else:
            third = ("body", pa.array([k[8:] for k in keys], pa.binary()))
        return pa.RecordBatch.from_pydict({
            "n_bytes": pa.array([len(k) - 8 for k in keys], pa.int64()),
            "content_hash": pa.array([int.from_bytes(k[:8], "big") - (1 << 63) for k in keys], pa.int64()),
            third[0]: third[1], "owner": pa.array(owners, pa.int64()), "copies": pa.array(copies, pa.int64()),
            "owner_rows": pa.array(owner_rows, pa.int64())})

    def packed(found: Iterator) -> Iterator[pa.RecordBatch]:
        part, held = [], 0
        for x in found:
            part.append(x)
            held += len(x[0])
            if held > 8 << 20:
                yield out(part)
                part, held = [], 0
        if part:
            yield out(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, length = PatriciaTrie(pick), None
        for batch in batches:
            names = ("n_bytes", "content_hash", "body", "owner", "copies", "owner_rows")
            for n, h, body, owner, copies, owner_rows in zip(*(batch.column(c).to_pylist() for c in names)):
                key = _key(h, body or b"")
                if named and n != length:
                    yield from packed(trie.take())
                    trie, length = PatriciaTrie(pick), n
                if trie.held > budget:
                    yield from packed(trie.take(key if named else None))
                trie.insert(key, owner, copies, owner_rows)
        yield from packed(trie.take())
    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: ``n_bytes, content_hash, text_sha256, owner, copies, owner_rows``."""
    rows = docs.select(F.col(id_col).cast("long").alias("owner"), text_bytes(text_col).alias("body"))
    rows = rows.select(F.octet_length("body").cast("long").alias("n_bytes"), F.xxhash64("body").alias("content_hash"),
                       "body", "owner", F.lit(1).cast("long").alias("copies"),
                       F.lit(1).cast("long").alias("owner_rows"))
    local = rows.mapInArrow(_fold(keep, False, trie_bytes), _FIELDS)
    dealt = local.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return dealt.mapInArrow(_fold(keep, True, trie_bytes),
                            "n_bytes long, content_hash long, text_sha256 string, owner long, copies long, owner_rows long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; a null text counts as empty, an empty text is a text like any other. Of equal
    texts the row with the smallest (``keep='min'``) or largest (``'max'``) identifier stays; null identifiers lose and
    stay only when the whole group has none. Rows repeated with the same identifier are each reported and share
    ``kept``. Other columns of the input are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    groups = scratch.keep(exact_groups(docs, id_col, text_col, keep, trie_bytes), "groups")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.sha2(text_bytes(text_col), 256).alias("text_sha256"))
    # the hash names the terminal: one row per terminal, so a hot text only splits on the documents' side
    joined = named.join(groups.select("text_sha256", "owner", "copies"), "text_sha256")
    return joined.select("doc_id", F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"),
                         F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` (all its columns) whose identifier owns their text; one row per text stays.

    Where the owner's identifier itself is repeated with the same text, the row that is smallest as JSON stays, so reruns
    agree. A null text counts as empty, the empty text is a text like any other; null identifiers own only where a whole
    group has none; columns may have any name; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    own = scratch.keep(exact_groups(docs, id_col, text_col, keep).select(
        "owner", F.col("text_sha256").alias("owned"), "owner_rows"), "own")
    marked = docs.select(whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("id"),
                         F.sha2(text_bytes(text_col), 256).alias("sha"))
    kept = marked.join(own, F.col("id").eqNullSafe(F.col("owner")) & (F.col("sha") == F.col("owned")))
    if not own.filter("owner_rows > 1").isEmpty():
        # only the few repeated identifiers are grouped; texts owned by one row pass through
        one = kept.filter("owner_rows > 1").groupBy("sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.filter("owner_rows = 1").select("row").unionAll(one.select("row"))
    return kept.select("row.*")
