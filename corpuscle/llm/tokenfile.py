"""Token-id files with keyed access by a minimal perfect hash index.

A dataset is a folder of raw id files with an index file beside each, and a Parquet manifest
of one small row a shard, in ascending key order. A shard's id file holds the ids of a run of
documents, back to back (16 bits each when the vocabulary allows, else 32) and nothing else.
Its index file holds a minimal perfect hash over the shard's distinct keys, a 32-bit
fingerprint and a row number for every slot, the offset of each row's ids and the rows' keys,
all in arrays of fixed width. So a look-up computes where to read: a word a level of the hash
(1.9 levels on average), a rank, a fingerprint, a row number, two offsets, the key, and then
the document's own bytes of the id file. It reads no more, whatever the size of the shard; a
key that isn't there fails on the fingerprint (one in 2**32 foreign keys passes, and the
stored key decides).

Rows travel once, to their key range. Keys that a large part of all rows share are split over
ranges by a content key, so no range depends on how often a key repeats. Tasks write files
under names of their own and the manifest lists those of the tasks that Spark committed, so
what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import OTHER_SPACE, byte_alphabet, default_path
from .common import raw_text, shared_dir, slices, tie

#: A shard is closed at so many ids or rows; the document that reaches a bound stays whole.
SHARD_IDS, SHARD_ROWS = 1 << 26, 1 << 20
END_ID = 2
#: Different fragments that a worker remembers at most; then it begins anew.
REMEMBERED = 400_000
#: Fragments whose ids are put together at once.
_AT_ONCE = 1 << 18
_MANIFEST = "part int, seq int, before long, first long, last long, nulls long, n_rows long, n_keys long, n_ids long, width int, levels array<long>, file string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over uint64 keys."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash: at each level, keys alone in their bit stay, the others go on.

    The slot of a key is the rank of its bit; ranks are stored for every 64 bits.
    """

    GAMMA = 1.6

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        bits = [np.bitwise_count(w).astype(np.uint32) for w in levels]
        flat = np.concatenate([[0], *bits]).astype(np.uint32).cumsum(dtype=np.uint32)
        self.ranks, at = [], 0
        for w in levels:
            self.ranks.append(flat[at : at + len(w)])
            at += len(w)
        self.n = int(flat[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """`keys`: distinct uint64."""
        levels, left = [], keys
        while len(left):
            size = max(64, int(len(left) * cls.GAMMA) + 63 & ~63)
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of foreign keys some slot or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (w, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mix(keys[left], level) % np.uint64(len(w) * 64)).astype(np.int64)
            word, bit = w[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (rank[at >> 6] + below)[hit]
            left = left[~hit]
        return out

    def arrays(self) -> list[np.ndarray]:
        """What is stored: the words of all levels, then the rank of each word."""
        return [np.concatenate([*self.levels, np.zeros(0, "<u8")]).astype("<u8"), np.concatenate([*self.ranks, np.zeros(0, "<u4")]).astype("<u4")]


def build_index(keys: np.ndarray, first_row: int = 0) -> tuple[PerfectHash, list[np.ndarray]]:
    """Index of a shard's ascending int64 keys, repeats allowed: the hash, and its arrays with fingerprints and first rows by slot."""
    own, rows = np.unique(keys, return_index=True)
    own = own.view(np.uint64)
    hashed = PerfectHash.build(own)
    slot = hashed.slots(own)
    prints, firsts = np.empty(len(own), "<u4"), np.empty(len(own), "<u4")
    prints[slot] = mix(own, -1) >> np.uint64(32)
    firsts[slot] = rows + first_row
    return hashed, [*hashed.arrays(), prints, firsts]


class Shard:
    """A shard's files. `row`: its manifest row; `read(name, at, size)`: bytes of one of its files."""

    def __init__(self, row: dict, read: Callable[[str, int, int], bytes]):
        self.read, self.row = read, row
        self.nulls, self.n_rows, self.width = row["nulls"], row["n_rows"], row["width"]
        self.levels = row["levels"]
        n, words = row["n_keys"], sum(self.levels)
        sizes = (8 * words, 4 * words, 4 * n, 4 * n, 8 * (self.n_rows + 1), 8 * (self.n_rows - self.nulls))
        self.at = np.concatenate([[0], np.cumsum(sizes)]).tolist()

    def _numbers(self, section: int, first: int, n: int = 1) -> np.ndarray:
        kind = ("<u8", "<u4", "<u4", "<u4", "<u8", "<i8")[section]
        width = int(kind[2])
        return np.frombuffer(self.read(f"{self.row['file']}.idx", self.at[section] + first * width, n * width), kind)

    def slot(self, key: int) -> int:
        """The slot of a key, by one word a level; -1 if no level has it."""
        own, before = np.array([key], np.int64).view(np.uint64), 0
        for level, words in enumerate(self.levels):
            bit = int(mix(own, level)[0] % np.uint64(words * 64))
            word = int(self._numbers(0, before + (bit >> 6))[0])
            if word >> (bit & 63) & 1:
                return int(self._numbers(1, before + (bit >> 6))[0]) + (word & ((1 << (bit & 63)) - 1)).bit_count()
            before += words
        return -1

    def find(self, key: int) -> int:
        """The first row of a key, -1 where the shard hasn't it."""
        slot = self.slot(key)
        if slot < 0 or int(self._numbers(2, slot)[0]) != int(mix(np.array([key], np.int64).view(np.uint64), -1)[0] >> np.uint64(32)):
            return -1
        row = int(self._numbers(3, slot)[0])
        return row if int(self.keys(row, 1)[0]) == key else -1

    def keys(self, row: int, n: int) -> np.ndarray:
        """Keys of n rows from a row on that has one."""
        return self._numbers(5, row - self.nulls, n)

    def starts(self, row: int, n: int) -> np.ndarray:
        """Offsets, in ids, of n rows and of the next."""
        return self._numbers(4, row, n + 1)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids from an offset to another."""
        return np.frombuffer(self.read(f"{self.row['file']}.ids", first * self.width, (end - first) * self.width), f"<u{self.width}")

    def get(self, key: int) -> Iterator[np.ndarray]:
        """The ids of each row of a key."""
        row = self.find(key)
        while 0 <= row < self.n_rows and int(self.keys(row, 1)[0]) == key:
            first, end = self.starts(row, 1).tolist()
            yield self.ids(first, end)
            row += 1

    def check(self) -> np.ndarray:
        """All keys, if the stored index leads to the first row of each."""
        keys = self.keys(self.nulls, self.n_rows - self.nulls)
        words, ranks = (self._numbers(k, 0, sum(self.levels)) for k in (0, 1))
        ends = np.cumsum(self.levels, dtype=np.int64)
        stored = PerfectHash([words[e - n : e] for e, n in zip(ends, self.levels, strict=True)])
        own, first = np.unique(keys, return_index=True)
        own = own.view(np.uint64)
        slots = stored.slots(own)
        n = self.row["n_keys"]
        right = stored.n == n == len(own) and (np.concatenate([*stored.ranks, np.zeros(0, "<u4")]) == ranks).all()
        if not right or (self._numbers(2, 0, n)[slots] != mix(own, -1) >> np.uint64(32)).any() or (self._numbers(3, 0, n)[slots] != first + self.nulls).any():
            raise ValueError(f"the index of {self.row['file']} doesn't lead to its keys")
        return keys


class Reader:
    """Reads ranges of a dataset's files, wherever it is called; counts files opened and bytes read."""

    def __init__(self, path: str):
        self.fs, self.folder = FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        self.open, self.files, self.bytes = {}, 0, 0

    def __call__(self, name: str, at: int, size: int) -> bytes:
        if not size:
            return b""
        if name not in self.open:
            if len(self.open) >= 64:
                self.close()
            self.open[name] = self.fs.open_input_file(f"{self.folder}/{name}")
            self.files += 1
        self.bytes += size
        data = self.open[name].read_at(size, at)
        if len(data) != size:
            raise EOFError(f"{name} ends before {at + size}")
        return data

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()


#: Words that the byte-level pattern always takes as one piece: Latin letters after one space at most.
_LATIN = re.compile(f" ?[A-Za-z{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0xFF)}]+").fullmatch
#: One space at most, then no white space, so that a line feed before it is a token of its own.
_PLAIN = re.compile(r" ?[^\s]+").fullmatch
#: Kinds of bytes: 1 white space, 2 signs, 4 ASCII letters, 8 what other white space may begin with.
_SIGNS = ",.;:!?"
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[ord(c) for c in _SIGNS]] = 2
_KIND[[b for b in range(128) if chr(b).isalpha()]] = 4
_KIND[[*range(0x1C, 0x20), *(c.encode()[0] for c in map(chr, (0x85, 0x1680, 0x2000, 0x3000, 0xFEFF)))]] = 8


class LibraryEncoder:
    """The tokenizers library, called once for each fragment it hasn't met.

    Only for byte-level files without normalizer or prefix space. There a token never spans a
    place where white space follows something else, nor one before the last of several white
    spaces if something else comes next, nor one where a sign follows a letter. Texts are cut at
    all such places and the fragments looked up by number; ids are put together as arrays.
    Other files, and texts with white space outside ASCII, encode whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        self.split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        self.split = self.split and not any(t.get("lstrip") or t.get("rstrip") or set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in added)
        self.signs = not any(re.search(f"[A-Za-z][{_SIGNS}]", t["content"]) or t.get("single_word") for t in added)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self._kind = np.dtype(f"<u{self.width}")
        self._forget()
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if self.split and len(feed) == 1 else None
        model, self.merges = spec["model"], None
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        if self.feed is not None and model.get("type", "BPE") == "BPE" and not any(odd):
            # The file's model without its pre-tokenizer: words come in the alphabet that stands for bytes.
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merges = Tokenizer(BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
            self.merges.pre_tokenizer = WhitespaceSplit()
            self.shown = {b: c for c, b in byte_alphabet().items()}
            self.shown[10] = f" {self.shown[10]} "

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, self._kind)  # of all known fragments, back to back
        self._starts = np.zeros(1 << 12, np.int64)

    def _remember(self, fragments: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        n, held = len(self._known), int(self._starts[len(self._known)])
        while len(self._ids) < held + len(ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while len(self._starts) < n + len(fragments) + 1:
            self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
        self._ids[held : held + len(ids)] = ids
        self._starts[n + 1 : n + 1 + len(fragments)] = held + ends
        self._known |= zip(fragments, range(n, n + len(fragments)), strict=True)

    def _joined(self, library, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends of n fragments that stand in one text with line feeds between, which no token spans."""
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != n - 1:
            raise RuntimeError("the tokenizer joins fragments over line feeds")
        return np.delete(ids, feeds), np.append(feeds, len(ids)) - np.arange(n)

    def _learn(self, fragments: list[bytes]) -> None:
        """Encode new fragments. Latin words skip the pre-tokenizer, of which each is one piece; other
        plain ones go as one text too; what is left goes one by one."""
        by: list[tuple[list[bytes], list[str]]] = [([], []), ([], []), ([], [])]
        for f in fragments:
            t = f.decode("utf-8", "replace")
            own, texts = by[0 if self.merges and _LATIN(t) else 1 if self.feed is not None and _PLAIN(t) else 2]
            own.append(f)
            texts.append(t)
        if by[0][0]:
            shown = "\n".join(by[0][1]).encode().decode("latin-1").translate(self.shown)
            self._remember(by[0][0], *self._joined(self.merges, shown, len(by[0][0])))
        if by[1][0]:
            self._remember(by[1][0], *self._joined(self.library, "\n".join(by[1][1]), len(by[1][0])))
        if by[2][0]:
            found = [x.ids for x in self.library.encode_batch_fast(by[2][1], add_special_tokens=False)]
            self._remember(by[2][0], np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([len(x) for x in found], dtype=np.int64))

    def _cuts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where fragments begin; `starts`, `ends`: of the texts, none empty."""
        kind = _KIND[data]
        if not self.split:
            return starts
        space = kind == 1
        before = np.concatenate([[False], space[:-1]])
        before[starts] = False
        after = np.concatenate([space[1:], [True]])
        after[ends - 1] = True
        cut = space & ~(before & after)
        if self.signs:
            cut[1:] |= (kind[1:] == 2) & (kind[:-1] == 4)
        cut[starts] = True
        odd = np.flatnonzero(kind == 8)
        if len(odd):  # texts that may have other white space
            for t in np.unique(np.searchsorted(starts, odd, "right") - 1).tolist():
                if OTHER_SPACE.search(data[starts[t] : ends[t]].tobytes().decode("utf-8", "replace")):
                    cut[starts[t] + 1 : ends[t]] = False
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of UTF-8 texts (a binary array) the ids, back to back with `end` after each, and the texts' lengths in ids."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        full = offsets[1:] > offsets[:-1]
        at = np.append(self._cuts(data, offsets[:-1][full], offsets[1:][full]), len(data)) if len(data) else np.zeros(1, np.int64)
        first_of = np.searchsorted(at, offsets)  # fragments before each text, and before the end
        lengths, out = np.zeros(len(texts), np.int64), []
        for s in range(0, len(at) - 1, _AT_ONCE):
            e = min(s + _AT_ONCE, len(at) - 1)
            own = self._numbers(data[at[s] : at[e]], at[s : e + 1] - at[s])
            first = self._starts[own]
            n = self._starts[own + 1] - first
            total = np.concatenate([[0], np.cumsum(n)])
            out.append(self._ids[np.arange(total[-1]) + np.repeat(first - total[:-1], n)])
            lengths += np.diff(total[np.clip(first_of - s, 0, e - s)])
        ids = np.concatenate([*out, np.zeros(0, self._kind)])
        if end is not None:
            ids, lengths = np.insert(ids, np.cumsum(lengths), end), lengths + 1
        return ids, lengths

    def _numbers(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of each fragment; new ones are encoded."""
        if len(at) < 2:
            return np.zeros(0, np.int64)
        if len(self._known) >= REMEMBERED:
            self._forget()
        flat = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())])
        different = flat.dictionary_encode()
        own = different.dictionary.to_pylist()
        get = self._known.get
        if new := [f for f in own if get(f) is None]:
            self._learn(new)
        return np.array(list(map(get, own)), np.int64)[different.indices.to_numpy()]


@cache
def encoder(path: str) -> LibraryEncoder:
    """One encoder a worker process and file."""
    return LibraryEncoder(path)


class _Writer:
    """The shards of one task, written as ids come."""

    def __init__(self, folder: str, part: int, width: int):
        self.fs, self.folder = FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        self.part, self.width, self.own, self.seq, self.written, self.stream = part, width, uuid.uuid4().hex, 0, 0, None
        self._begin()

    def _begin(self) -> None:
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.held = 0

    def add(self, keys: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Rows that end here, and ids of them and perhaps of the row that goes on."""
        if self.stream is None:
            self.file = f"{self.part:06d}-{self.seq:06d}-{self.own}"
            self.stream = self.fs.open_output_stream(f"{self.folder}/{self.file}.ids")
        self.stream.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys += keys
        self.lengths += lengths.tolist()
        self.held += len(ids)

    def close(self) -> pa.RecordBatch | None:
        """Finish the shard: its index file, and its manifest row."""
        if self.stream is None:
            return None
        self.stream.close()
        own = np.array([k for k in self.keys if k is not None], "<i8")
        nulls, starts = len(self.keys) - len(own), np.concatenate([[0], np.cumsum(self.lengths)]).astype("<u8")
        hashed, arrays = build_index(own, nulls)
        with self.fs.open_output_stream(f"{self.folder}/{self.file}.idx") as f:
            for a in (*arrays, starts, own):
                f.write(a.tobytes())
        row = {
            "part": self.part, "seq": self.seq, "before": self.written, "first": int(own[0]) if len(own) else None, "last": int(own[-1]) if len(own) else None,
            "nulls": nulls, "n_rows": len(self.keys), "n_keys": hashed.n, "n_ids": int(starts[-1]), "width": self.width, "levels": [len(x) for x in hashed.levels], "file": self.file,
        }
        self.stream, self.seq, self.written = None, self.seq + 1, self.written + row["n_ids"]
        self._begin()
        return pa.RecordBatch.from_arrays([pa.array([row[n]], _TYPES[t]) for n, t in (c.split() for c in _MANIFEST.split(", "))], names=list(row))


def _shards(path: str | None, end_id: int | None, folder: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or default_path())
        out = _Writer(folder, TaskContext.get().partitionId(), e.width)
        gc.disable()  # nothing here is cyclic, and the collector would walk the fragments again and again
        try:
            for batch in slices(batches, "text"):
                keys = batch.column("key").to_pylist()
                ids, lengths = e.encode(batch.column("text"), end_id)
                ends, at = np.concatenate([[0], np.cumsum(lengths)]), 0
                while at < len(keys):  # a full shard closes at the end of a row
                    full = int(np.searchsorted(ends, ends[at] + shard_ids - out.held))
                    until = min(max(at + 1, full), at + SHARD_ROWS - len(out.keys), len(keys))
                    out.add(keys[at:until], ids[ends[at] : ends[until]], lengths[at:until])
                    at = until
                    if out.held >= shard_ids or len(out.keys) >= SHARD_ROWS:
                        yield out.close()
            if (last := out.close()) is not None:
                yield last
        finally:
            gc.enable()

    return run


def write(docs: DataFrame, to: str, path: str | None = None, end_id: int | None = END_ID, key: str = "doc_id", shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts (null: empty) with the tokenizers library and write them to the shared folder `to`.

    Ids follow in ascending key order, null keys first; rows that share a key in the order of
    their text's content key. Each document ends with `end_id` unless that is None. Keys are
    integers. An empty table makes a dataset without shards. Extra columns are not read. A very
    long text needs memory in proportion to it; no text is cut short.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), tie("text").alias("tie"), raw_text().alias("text"))
    shards = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").drop("tie")
    fs, folder = FileSystem.from_uri(to.replace("s3a://", "s3://", 1))
    fs.create_dir(folder)
    shards.mapInArrow(_shards(path, end_id, to, shard_ids), _MANIFEST).write.parquet(f"{to}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard of a dataset."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, with `base`: the ids of all shards before; a shard's rows are one task's work.

    A shard knows the ids before it in its task; one total a task reaches the driver and goes
    out again, so payloads don't move.
    """
    shards = manifest(spark, path)
    totals = sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids"), F.count("*")).collect()))
    starts, at = [(-1, 0)], 0
    for part, n, _ in totals:
        starts.append((part, at))
        at += n
    starts = F.broadcast(spark.createDataFrame(starts, "part int, parts_before long"))
    based = shards.join(starts, "part").withColumn("base", F.col("parts_before") + F.col("before")).drop("parts_before")
    return based.repartition(max(1, sum(n for _, _, n in totals)))


def _read(path: str, crc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Reader(path)
        for row in (r for batch in batches for r in batch.to_pylist()):
            s = Shard(row, files)
            keys = s.check()
            starts = s.starts(0, s.n_rows).astype(np.int64)
            at = 0
            while at < s.n_rows:  # rows of bounded ids at once
                until = min(max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20)))), s.n_rows)
                held = s.ids(int(starts[at]), int(starts[until])).astype("<u4").tobytes()
                cuts = (4 * (starts[at : until + 1] - starts[at])).tolist()
                ids = [held[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = {
                    "doc_id": pa.array([None] * max(0, min(until, s.nulls) - at) + keys[max(0, at - s.nulls) : max(0, until - s.nulls)].tolist(), pa.int64()),
                    "start": pa.array(row["base"] + starts[at:until]),
                    "n_tokens": pa.array(np.diff(starts[at : until + 1])),
                }
                columns |= {"ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())} if crc else {"ids": pa.array(ids, pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)
                at = until
            files.close()

    return run


def read(spark: SparkSession, path: str, crc: bool = False) -> DataFrame:
    """Every document of a dataset: doc_id, start, n_tokens and ids (packed 32-bit), or their crc32.

    Each shard's index is checked against its keys on the way.
    """
    own = "ids_crc32 long" if crc else "ids binary"
    return open_shards(spark, path).mapInArrow(_read(path, crc), f"doc_id long, start long, n_tokens long, {own}")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the rows that have the given keys, ids packed in 32 bits.

    The manifest says which shards may have a key; of each only the key's slot and the ids of
    its documents are read (:meth:`Shard.get`).
    """
    want = sorted({int(k) for k in keys})
    shards = manifest(spark, path)
    if not want:
        return spark.createDataFrame([], "doc_id long, ids binary")
    shards = shards.filter((F.col("first") <= want[-1]) & (F.col("last") >= want[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Reader(path)
        for row in (r for batch in batches for r in batch.to_pylist()):
            shard = Shard(row, files)
            for k in want[bisect_left(want, row["first"]) : bisect_right(want, row["last"])]:
                found = [x.astype("<u4").tobytes() for x in shard.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return shards.mapInArrow(run, "doc_id long, ids binary")


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), to)
    return read(spark, to, crc=True)
