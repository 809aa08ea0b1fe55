"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned by identifier; each task encodes its documents in ascending order and writes one shard:
raw little-endian ids end to end, then the keys, a minimal perfect hash over them (levels of bit arrays, as in BBHash:
a key whose position is its own in a level is placed there, the others go on to the next), and one slot a key with a
fingerprint, the offset and the number of its ids. A lookup is a constant number of array reads; the fingerprint turns
away keys that are not in the shard. Shards are written to a name of the attempt and renamed when whole, so a lost
executor leaves nothing half-written.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, rows, tasks_for, text_bytes
from .words import mix, powers

MAGIC = b"SLTOK001"
#: Text bytes a shard holds, about.
SHARD_BYTES = 72 << 20
SLICE_BYTES = 8 << 20
UNITS_AT_ONCE = 8192
#: Bytes of units encoded end to end, and how many such texts at once.
JOINED_BYTES, JOINED_AT_ONCE = 16 << 10, 32
KNOWN_UNITS = 1_500_000
HASH_BYTES = 1 << 19
GAMMA = 2.0
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(90001))
#: Bytes after a space that surely begin a word: ASCII signs, and lead bytes of no Unicode space.
_BEGINS = np.zeros(256, bool)
_BEGINS[0x21:0x7F] = True
_BEGINS[0xC3:] = True
_BEGINS[0xE1:0xE4] = False


# ---- encoding ------------------------------------------------------------------------------------------------------

class UnitEncoder:
    """Encodes texts by their distinct units. The tokenizer's pattern starts a new token at a space before a
    non-space, so ids of a text are the ids of its units end to end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.n_ids = 1 + max(self.tokenizer.get_vocab().values(), default=-1)
        #: bytes of each id's piece, one for each character of a byte-level piece
        self.bytes = np.zeros(self.n_ids, np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(piece)
        self.known = self._none()

    def encode(self, texts: list[bytes], end: int) -> Iterator[np.ndarray]:
        """Ids of each text with ``end`` after them."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        bound = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        begins = np.zeros(len(data) + 1, bool)
        begins[bound] = True
        if len(data):
            begins[:-2] |= (data[:-1] == 0x20) & _BEGINS[data[1:]]
        start = np.flatnonzero(begins[:-1])
        size = np.diff(np.append(start, len(data)))
        name, one, which = np.unique(self._names(data, start, size), return_index=True, return_inverse=True)
        at, begin, length, flat = self._ids(data, start[one], size[one], name)
        n, begin = length[at][which], begin[at][which]
        cut = np.searchsorted(start, bound)
        text = np.repeat(np.arange(len(texts)), np.diff(cut))
        before = np.concatenate([[0], np.cumsum(n)])
        # ids of unit u stand after those of the units and ends before it
        out = np.full(int(before[-1]) + len(texts), end, np.uint32)
        place = np.arange(int(before[-1]))
        out[place + np.repeat(text, n)] = flat[place + np.repeat(begin - before[:-1], n)]
        at = before[cut] + np.arange(len(texts) + 1)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield out[a:b]

    @staticmethod
    def _names(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit names of the units, about a megabyte of text at a time."""
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(start, start[at] + HASH_BYTES)))
            low, high = int(start[at]), int(start[stop - 1] + size[stop - 1])
            power, inverse = powers(high - low + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_VALUES[data[low:high]] * power[:high - low], out=total[1:])
            a, n = start[at:stop] - low, size[at:stop]
            out[at:stop] = mix((total[a + n] - total[a]) * inverse[a] + n.astype(np.uint64))
            at = stop
        return out

    def _ids(self, data, start, size, name) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of each unit (in order of name) among the known ones, where their ids begin, how many, and all ids. Units
        met before in this task are not encoded again; the table of known units is emptied when it holds ``KNOWN_UNITS``."""
        known, begin, length, flat = self.known
        place = np.searchsorted(known, name)
        new = np.flatnonzero(known[np.minimum(place, max(len(known) - 1, 0))] != name) if len(known) else np.arange(len(name))
        if len(known) + len(new) > KNOWN_UNITS:
            known, begin, length, flat = self._none()
            new = np.arange(len(name))
        if len(new):
            order, more, found = self._encoded(data, start[new], size[new])
            # ids are only added; names, begins and lengths of the new units go between the known ones
            first, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            first[order], n[order] = len(flat) + np.cumsum(more) - more, more
            flat = np.concatenate([flat, *found])
            at = np.searchsorted(known, name[new])
            known, begin, length = np.insert(known, at, name[new]), np.insert(begin, at, first), np.insert(length, at, n)
            self.known = known, begin, length, flat
            place = np.searchsorted(known, name)
        return place, begin, length, flat

    def _encoded(self, data, start, size) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Units in the order they are encoded in, their numbers of ids, and these ids.

        Units that begin with a space and a word are encoded end to end and told apart by the bytes of each id; where
        the bounds of units and ids do not meet, and for all other units, each is encoded for itself.
        """
        begins = (size > 1) & (data[start] == 0x20) & _BEGINS[data[np.minimum(start + 1, len(data) - 1)]]
        joined, alone = np.flatnonzero(begins), [np.flatnonzero(~begins)]
        joined = joined[np.argsort(start[joined])]
        order, many, found = [], [], []
        total = np.cumsum(size[joined])
        cut = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, JOINED_BYTES)), len(joined)))
        for k in range(0, len(cut) - 1, JOINED_AT_ONCE):
            runs = [joined[a:b] for a, b in zip(cut[k:k + JOINED_AT_ONCE].tolist(), cut[k + 1:k + 1 + JOINED_AT_ONCE].tolist())]
            texts = []
            for run in runs:
                n = size[run]
                texts.append(data[np.arange(int(n.sum())) + np.repeat(start[run] - (np.cumsum(n) - n), n)].tobytes().decode(
                    "utf-8", "replace"))
            for run, e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                end, want = np.cumsum(self.bytes[ids]), np.cumsum(size[run])
                at = np.searchsorted(end, want)
                if len(ids) and end[-1] == want[-1] and (end[at] == want).all():
                    order.append(run)
                    many.append(np.diff(at + 1, prepend=0))
                    found.append(ids)
                else:
                    alone.append(run)
        rest = np.concatenate(alone)
        for k in range(0, len(rest), UNITS_AT_ONCE):
            part = rest[k:k + UNITS_AT_ONCE]
            texts = [data[a:a + n].tobytes().decode("utf-8", "replace") for a, n in zip(start[part].tolist(), size[part].tolist())]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            order.append(part)
            many.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            found.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(many[-1].sum())))
        return np.concatenate(order), np.concatenate(many), found

    @staticmethod
    def _none() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)


# ---- minimal perfect hash ------------------------------------------------------------------------------------------

def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x632BE59BD9B4E019 * (level + 1) & ((1 << 64) - 1))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1; other keys to -1 or to any number."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> "PerfectHash":
        sizes, bits, left, level = [], [], keys, 0
        while len(left):
            size = max(64, int(-(-len(left) * gamma // 64)) * 64)
            at = _position(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
            level += 1
        packed = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little")
        return cls(sizes, packed.view("<u8"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = _position(keys[open_], level, size) + self.base[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out


def document_keys(doc_id: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit keys of (identifier, how many rows with it come before)."""
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


# ---- shards --------------------------------------------------------------------------------------------------------

def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def _write(path: str, root: str, end: int):
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        files, folder = file_system(root)
        files.create_dir(folder, recursive=True)
        whole, part = f"{folder}/shard-{shard:06d}.bin", f"{folder}/.shard-{shard:06d}-{context.taskAttemptId()}.part"
        encoder = UnitEncoder(path)
        dtype = "<u2" if max(encoder.n_ids - 1, end) < 1 << 16 else "<u4"
        doc_id, missing, counts = [], [], []
        with files.open_output_stream(part) as out:
            out.write(MAGIC)
            for other, texts in rows(batches, SLICE_BYTES):
                for ids in encoder.encode(texts, end):
                    out.write(ids.astype(dtype).tobytes())
                    counts.append(len(ids))
                doc_id += [d or 0 for d in other["doc_id"]]
                missing += [d is None for d in other["doc_id"]]
            doc_id, missing = np.array(doc_id, np.int64), np.array(missing, bool)
            counts = np.array(counts, np.int64)
            n = len(counts)
            same = np.zeros(n, bool)
            same[1:] = (doc_id[1:] == doc_id[:-1]) & (missing[1:] == missing[:-1])
            run_start = np.maximum.accumulate(np.where(same, 0, np.arange(n))) if n else np.zeros(0, np.int64)
            nth = (np.arange(n) - run_start) * 2 + missing
            keys = document_keys(doc_id, nth)
            index = PerfectHash.build(keys)
            slot = index.find(keys)
            table = np.zeros(n, [("print", "<u4"), ("offset", "<u8"), ("n", "<u8")])
            table["print"][slot], table["n"][slot] = fingerprints(keys), counts
            table["offset"][slot] = np.cumsum(counts) - counts
            sections = {"doc_id": doc_id.astype("<i8"), "nth": nth.astype("<i8"), "bits": index.words, "slots": table}
            at, places = len(MAGIC) + int(counts.sum()) * np.dtype(dtype).itemsize, {}
            for name, section in sections.items():
                places[name] = (at, section.nbytes)
                out.write(section.tobytes())
                at += section.nbytes
            footer = json.dumps({"dtype": dtype, "n_docs": n, "n_ids": int(counts.sum()), "levels": index.sizes,
                                 "sections": places}).encode()
            out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        if files.get_file_info(whole).type != fs.FileType.NotFound:
            files.delete_file(whole)
        files.move(part, whole)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [os.path.basename(whole)], "n_docs": [n],
                                          "n_ids": [int(counts.sum())]}, schema=schema)
    return run


class Shard:
    """A shard file: keyed access to the ids of its documents."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no whole shard")
        length = struct.unpack("<q", tail[:8])[0]
        self.meta = json.loads(self.file.read_at(length, size - 16 - length))
        self.dtype = np.dtype(self.meta["dtype"])
        read = lambda name, kind: np.frombuffer(
            self.file.read_at(self.meta["sections"][name][1], self.meta["sections"][name][0]), kind)
        self.doc_id, self.nth = read("doc_id", "<i8"), read("nth", "<i8")
        self.index = PerfectHash(self.meta["levels"], read("bits", "<u8"))
        self.slots = read("slots", [("print", "<u4"), ("offset", "<u8"), ("n", "<u8")])

    def find(self, doc_id, nth=None) -> np.ndarray:
        """Slots of documents, -1 for those that are not here."""
        doc_id = np.asarray(doc_id, np.int64)
        keys = document_keys(doc_id, np.zeros(len(doc_id), np.int64) if nth is None else nth)
        if not len(self.slots):
            return np.full(len(keys), -1)
        slot = self.index.find(keys)
        known = (slot >= 0) & (self.slots["print"][slot] == fingerprints(keys))
        return np.where(known, slot, -1)

    def read(self, offset: int, n: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(n * width, len(MAGIC) + offset * width), self.dtype).astype("<u4")

    def get(self, doc_id: int) -> np.ndarray | None:
        slot = int(self.find([doc_id])[0])
        return None if slot < 0 else self.read(int(self.slots["offset"][slot]), int(self.slots["n"][slot]))


READ_IDS = 1 << 20


def _read(root: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(root)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                shard = Shard(files, f"{folder}/{name}")
                slot = shard.find(shard.doc_id, shard.nth)
                if len(slot) and slot.min() < 0:
                    raise ValueError(f"{name}: a key is not found in its own index")
                offset, n = shard.slots["offset"][slot].astype(np.int64), shard.slots["n"][slot].astype(np.int64)
                crc, at = [], 0
                while at < len(n):  # documents in a row, read together
                    stop = max(at + 1, int(np.searchsorted(offset, offset[at] + READ_IDS)))
                    ids = shard.read(int(offset[at]), int(offset[stop - 1] + n[stop - 1] - offset[at]))
                    crc += [zlib.crc32(ids[o:o + k].tobytes())
                            for o, k in zip((offset[at:stop] - offset[at]).tolist(), n[at:stop].tolist())]
                    at = stop
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_id, mask=(shard.nth & 1) == 1), pa.array(offset + before), pa.array(n),
                     pa.array(crc, pa.int64())], schema=schema)
    return run


def write_store(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards under ``root`` and return the manifest ``shard, file, n_docs, n_ids``, in shard order.

    ``root`` must be a folder all executors share. Null texts count as empty; null identifiers come first. Rows
    repeated with one identifier are all written, ordered by text; keyed access by identifier finds the first.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = tasks_for(total, shard_bytes, 1)
    dealt = source.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(_write(tokenizer, root, end_id), "shard int, file string, n_docs long, n_ids long")


def read_store(manifest: DataFrame, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the shards through their indexes."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    n = max(1, manifest.count())
    return placed.repartition(n, "shard").mapInArrow(
        _read(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents to a new store in the shared folder and read it back: one row per input row with
    ``doc_id, start`` (ids of all documents before it)``, n_tokens`` (with the end id)`` , ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers).

    See :func:`write_store` for nulls, ties and repeated rows. Other columns are ignored; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession, "token-store")
    root = f"{scratch.root}/shards"
    manifest = scratch.keep(write_store(docs, root, tokenizer, end_id, id_col, text_col, shard_bytes), "manifest")
    return read_store(manifest, root)
