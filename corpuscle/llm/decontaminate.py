"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are compared as letters and digits in lower case with single spaces between. The patterns
of an item are its `pattern` consecutive characters from every place (short items are one pattern);
a pattern occurs in a document if some stretch of it is within k edits, k a tenth of the pattern's length.

A pattern of m characters and a stretch within k edits share at least ``m + 1 - q * (k + 1)``
q-grams, whose diagonals (place in the document less place in the pattern) span at most k.
Patterns that start at neighbouring places are counted together, as a group of up to 127
characters, by group and diagonal band; bands are ``2 * (k + 1)`` diagonals wide and overlap by
half, so some band holds all of a pattern's q-grams. Where a pattern's own part of a band meets
the bound, an alignment restricted to its diagonals decides.

The index of a block of items is broadcast; a block has at most `block_chars` characters of
items, and a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, raw_text, slices, tidy


#: Characters of a group of patterns; their places take seven bits.
GROUP = 127
#: Characters of a long text that are compared at once.
RUN = 1 << 20


@dataclass(frozen=True)
class Params:
    q: int = 8
    pattern: int = 96  # characters; up to 127
    budget: float = 0.1  # edits for each character of a pattern
    block_chars: int = 8 << 20
    segment: int = 1 << 17  # characters of documents whose q-grams are looked up at once
    hits: int = 1 << 21  # shared q-grams that are held at once; denser segments go in parts

    def edits(self, m: int) -> int:
        """k, lowered where the lemma's bound would fall under one."""
        return min(int(self.budget * m), m // self.q - 1)

    def bound(self, m: int) -> int:
        return m + 1 - self.q * (self.edits(m) + 1)


@cache
def _folded() -> np.ndarray:
    """Lower case of each letter or digit of the first planes, a space for all else."""
    out = np.arange(0x30000, dtype=np.uint32)
    for c in range(len(out)):
        s = chr(c)
        low = s.lower() if s.isalnum() else " "
        out[c] = ord(low[0]) if not 0xD800 <= c < 0xE000 else 0x20
    return out


def _kept(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points as compared but for their number, and which of them stay."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    table = _folded()
    if len(a) and a.max() >= len(table):
        a = np.where(a < len(table), table[np.minimum(a, len(table) - 1)], np.uint32(0x20))
    else:
        a = table[a]
    space = a == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]  # of spaces in a row the first stays, except at the start
    if len(a) and (ends := len(a) - int(np.argmax(~space[::-1]))) < len(a):
        keep[ends if not space.all() else 0 :] = False
    return a, keep


def fold(text: str) -> np.ndarray:
    """Code points as compared."""
    a, keep = _kept(text)
    return a[keep]


def places(text: str) -> np.ndarray:
    """The place in the text of each code point of :func:`fold`."""
    return np.flatnonzero(_kept(text)[1])


def grams(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place."""
    base = np.uint64(0x9E3779B97F4A7C15)
    out, width = a.astype(np.uint64) + np.uint64(0x100), 1
    with np.errstate(over="ignore"):
        power = base
        whole, done = None, 0
        n, rest = len(a) - q + 1, q
        if n <= 0:
            return np.zeros(0, np.uint64)
        while rest:  # by doubling: q = 8 takes three steps
            if rest & 1:
                whole = out[:n] if whole is None else whole * power + out[done : done + n]
                done += width
            rest >>= 1
            if rest:
                out = out[:-width] * power + out[width:]
                power, width = power * power, width * 2
        return whole * np.uint64(0xD6E8FEB86659FD93)


def _merge(cells: dict, cell: tuple[int, int], own: dict[int, int]) -> None:
    old = cells.setdefault(cell, own)
    if old is not own:
        old |= {s: max(n, old.get(s, 0)) for s, n in own.items()}


class Index:
    """The patterns of some items, in groups, and the places of the groups' q-grams."""

    def __init__(self, items: list[tuple], p: Params):
        """items: (item_id, text)."""
        self.p = p
        self.groups: list[np.ndarray] = []
        self.items: list[list] = []  # that have each group: passages that items share are one group
        known: dict[bytes, int] = {}
        step = GROUP + 1 - p.pattern
        for item, text in items:
            a = fold(text or "")
            if len(a) < p.q:
                continue  # too short to tell from other text
            for s in range(0, max(1, len(a) - p.pattern + 1), step):
                group = a[s : s + GROUP]
                g = known.setdefault(group.tobytes(), len(self.groups))
                if g == len(self.groups):
                    self.groups.append(group)
                    self.items.append([])
                if item not in self.items[g][-1:]:
                    self.items[g].append(item)
        sizes = [min(len(x), p.pattern) for x in self.groups]
        self.own_edits = np.array([p.edits(m) for m in sizes], np.int16)
        self.bounds = np.array([p.bound(m) for m in sizes], np.int16)
        own = [grams(x, p.q) for x in self.groups]
        flat = np.concatenate([*own, np.zeros(0, np.uint64)])
        which = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
        place = np.concatenate([*(np.arange(len(x), dtype=np.uint8) for x in own), np.zeros(0, np.uint8)])
        order = np.argsort(flat, kind="stable")
        self.hashes, first = np.unique(flat[order], return_index=True)
        self.first = np.concatenate([first, [len(flat)]]).astype(np.int64)
        self.which, self.place = which[order], place[order]
        #: Hash and group of each entry, as one ascending number.
        self.entry = (np.repeat(np.arange(len(self.hashes), dtype=np.int64), np.diff(self.first)) << 32) + self.which
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of `h` that are q-grams of some pattern, and their positions in `hashes`."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
        if not len(self.hashes):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[found] == h[at]
        return at[same], found[same]

    def candidates(self, h: np.ndarray, shift: int) -> dict[tuple[int, int], dict[int, int]]:
        """By (group, band) the patterns that meet the bound among these q-grams, by their place in the group, with
        their counts; `shift`: the q-grams' place in the stream."""
        places, found = self.hits(h)
        return self._within(places + shift, found, 0, len(self.groups))

    def _within(self, places: np.ndarray, found: np.ndarray, low: int, high: int) -> dict[tuple[int, int], dict[int, int]]:
        """What the groups from low to high have. Where hits are too many to hold, the groups are halved, so no band's count is split."""
        if high - low == len(self.groups):
            first, end = self.first[found], self.first[found + 1]
        else:  # entries of a hash are in the groups' order
            first, end = (np.searchsorted(self.entry, (found.astype(np.int64) << 32) + g) for g in (low, high))
            some = end > first
            places, found, first, end = places[some], found[some], first[some], end[some]
        times = end - first
        if times.sum() <= self.p.hits:
            return self._count(places, first, times)
        if high - low > 1:
            middle = (low + high) // 2
            return self._within(places, found, low, middle) | self._within(places, found, middle, high)
        # One group: parts by place, each far longer than the places that a band may span and that go into the next part too.
        ends, out, i, room = np.cumsum(times), {}, 0, max(self.p.hits, 8 * self.p.pattern * GROUP)
        while i < len(places):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + room, "right")))
            for cell, own in self._count(places[i:j], first[i:j], times[i:j]).items():
                _merge(out, cell, own)
            if j >= len(places):
                break
            i = int(np.searchsorted(places, places[j] - 4 * self.p.pattern))
        return out

    def _count(self, places: np.ndarray, first: np.ndarray, times: np.ndarray) -> dict[tuple[int, int], dict[int, int]]:
        if not len(places):
            return {}
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        row = np.repeat(first, times) + inside
        which, place = self.which[row].astype(np.int64), self.place[row].astype(np.int64)
        width = self.own_edits[which].astype(np.int64) + 1
        band = (np.repeat(places, times) - place + 128) // width  # from 0: places in a group are under 128
        keys = []
        for b in (band, band - 1):
            ok = b >= 0
            keys.append(((which[ok] << 34) + b[ok] << 7) + place[ok])
        # A q-gram of the pattern counts once in a band, however often the document repeats it.
        own = np.concatenate(keys)
        own.sort()
        own = own[np.append(True, own[1:] != own[:-1])]
        cells = own >> 7
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        cell, n = cells[first], np.diff(np.append(first, len(own)))
        good = n >= self.bounds[cell >> 34]
        out = {}
        for c, f, k in zip(cell[good].tolist(), first[good].tolist(), n[good].tolist(), strict=True):
            g = c >> 34
            m = min(len(self.groups[g]), self.p.pattern)
            before = np.zeros(GROUP + 1, np.int64)
            before[(own[f : f + k] & 127) + 1] = 1
            before = before.cumsum()
            starts = np.arange(len(self.groups[g]) - m + 1)
            counts = before[starts + m - self.p.q + 1] - before[starts]
            if len(met := np.flatnonzero(counts >= self.bounds[g])):
                out[g, c & ((1 << 34) - 1)] = dict(zip(met.tolist(), counts[met].tolist(), strict=True))
        return out

    def align(self, text: np.ndarray, cells: dict[tuple[int, int], dict[int, int]]) -> list[tuple[int, int, int, int]]:
        """(group, start, end, edits) of patterns of the cells whose band has an alignment within the budget.

        First the outermost patterns of a cell and the one of most q-grams. Where all of these occur, those
        between add nothing to what they span; elsewhere every pattern that meets the bound is aligned.
        """
        first = [(g, b, s) for (g, b), own in cells.items() for s in sorted({min(own), max(own), max(own, key=own.get)})]
        done = self._aligned(text, first)
        lost = {(g, b) for (g, b, s), x in zip(first, done, strict=True) if x is None}
        tried = set(first)
        rest = [(g, b, s) for g, b in sorted(lost) for s in sorted(cells[g, b]) if (g, b, s) not in tried]
        return [x for x in done + self._aligned(text, rest) if x is not None]

    def _aligned(self, text: np.ndarray, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int] | None]:
        by: dict[tuple[int, int], list[int]] = {}
        for at, (g, _, _) in enumerate(own):
            by.setdefault((min(len(self.groups[g]), self.p.pattern), int(self.own_edits[g])), []).append(at)
        out: list = [None] * len(own)
        for (m, k), rows in by.items():
            for s in range(0, len(rows), 2048):
                part = rows[s : s + 2048]
                for r, x in self._align(text, [own[r] for r in part], m, k):
                    out[part[r]] = x
        return out

    def _align(self, text: np.ndarray, own: list[tuple[int, int, int]], m: int, k: int) -> list[tuple[int, tuple]]:
        low = np.array([band * (k + 1) - 128 - k + s for _, band, s in own])  # the first diagonal
        wide = 2 * (k + 1) + 2 * k
        pattern = np.array([self.groups[g][s : s + m] for g, _, s in own])
        steps = np.arange(wide)
        cost = np.zeros((len(own), wide), np.int32)  # a stretch may start at any diagonal
        begin = low[:, None] + steps  # where the alignment in each cell starts
        for i in range(m):
            at = low[:, None] + steps + i
            inside = (at >= 0) & (at < len(text))
            char = np.where(inside, text[np.clip(at, 0, len(text) - 1)], 0)
            straight = cost + (char != pattern[:, i : i + 1])
            skip = np.concatenate([cost[:, 1:], np.full((len(own), 1), 1 << 20)], axis=1) + 1
            best = np.minimum(straight, skip)
            start = np.where(straight <= skip, begin, np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1))
            # Characters of the document that the pattern lacks: one more edit a diagonal.
            level = best - steps
            lowest = np.minimum.accumulate(level, axis=1)
            source = np.maximum.accumulate(np.where(level == lowest, steps, 0), axis=1)
            cost = (lowest + steps).astype(np.int32)
            begin = np.take_along_axis(start, source, axis=1)
        end = cost.argmin(1)
        edits = cost[np.arange(len(own)), end]
        good = edits <= k
        rows = np.flatnonzero(good)
        return [(int(r), (own[r][0], int(begin[r, end[r]]), int(low[r] + end[r] + m), int(edits[r]))) for r in rows]

    def search(self, texts: list[str]) -> list[list[tuple]]:
        """For each text its (item_id, groups found, least edits, begin, end); offsets in the text. Huge texts go in runs."""
        by: dict[tuple[int, object], tuple[set[int], int, int, int]] = {}
        held, size = [], 0

        def flush() -> None:
            for doc, item, group, edits, begin, end in self._found(held):
                groups, least, first, last = by.get((doc, item), (set(), edits, begin, end))
                by[doc, item] = groups | {group}, min(least, edits), min(first, begin), max(last, end)
            held.clear()

        for doc, text in enumerate(texts):
            for run in self._runs(text):
                held.append((doc, *run))
                size += len(run[1])
                if size >= 2 * RUN:
                    flush()
                    size = 0
        flush()
        out: list[list[tuple]] = [[] for _ in texts]
        for (doc, item), (groups, *rest) in sorted(by.items(), key=lambda x: (x[0][0], str(x[0][1]))):
            out[doc].append((item, len(groups), *rest))
        return out

    def _runs(self, text: str) -> Iterator[tuple[int, str]]:
        """The text in parts, with the place of each; the next one begins so far back that any pattern is whole in one."""
        start, back, wide = 0, 4 * self.p.pattern, RUN
        while start + wide < len(text):
            part = text[start : start + wide]
            if len(at := places(part)) <= 2 * back:
                wide *= 2  # hardly a letter: take more
                continue
            yield start, part
            start, wide = start + int(at[-back]), RUN
        yield start, text[start:]

    def _found(self, parts: list[tuple[int, int, str]]) -> Iterator[tuple]:
        """(doc, item, group, edits, begin, end) in the parts (doc, place, text)."""
        folded = [fold(t) for _, _, t in parts]
        gap = int(self.own_edits.max(initial=0)) + 1
        sizes = np.array([len(a) + gap for a in folded], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        stream = np.zeros(int(starts[-1]), np.uint32)  # more foreign characters between texts than a pattern may have edits
        for a, s in zip(folded, starts, strict=False):
            stream[s : s + len(a)] = a
        if not self.groups or not len(stream):
            return
        cells: dict[tuple[int, int], dict[int, int]] = {}
        size, over = self.p.segment, 4 * self.p.pattern
        for s in range(0, len(stream), size):
            for cell, own in self.candidates(grams(stream[s : s + size + over], self.p.q), s).items():
                _merge(cells, cell, own)
        now, at = -1, None
        for group, begin, end, edits in sorted(self.align(stream, cells), key=lambda x: x[1]):
            k = int(np.searchsorted(starts, (begin + end) // 2, "right")) - 1  # the ends may be edits
            doc, place, text = parts[k]
            if k != now:
                now, at = k, places(text)
            first, last = max(0, begin - int(starts[k])), min(end - int(starts[k]), len(at))
            for item in self.items[group]:
                yield doc, item, group, edits, place + int(at[first]), place + int(at[last - 1]) + 1


def blocks(benchmark: DataFrame, p: Params) -> Iterator[Index]:
    """Indexes of the items, each of a bounded number of characters."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / (p.block_chars / 2))  # half, since a hash deals unevenly
    for b in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Index(sorted(map(tuple, own.collect()), key=str), p)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches, "text", 2 << 20):
            found = index.search([t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            rows = [(d, *r) for d, own in zip(batch.column("doc_id").to_pylist(), found, strict=True) for r in own]
            kinds = (batch.schema.field("doc_id").type, None, pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = ["doc_id", "item_id", "patterns", "edits", "begin", "end"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k or pa.int64()) for c, k in enumerate(kinds)], names=names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """(doc_id, item_id, patterns, edits, begin, end): each item that occurs in each document.

    patterns: in how many groups of the item's patterns one was found; edits: the fewest of those aligned;
    begin and end: offsets in the text that span all its places. Null and empty texts and items, and items
    with fewer than q letters, digits and spaces, match nothing. Rows that repeat each return
    their own matches. item_id is an integer. Extra columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, patterns int, edits int, begin long, end long"
    rows = docs.select("doc_id", raw_text().alias("text"))
    out = spark.createDataFrame([], schema)
    for index in blocks(benchmark, p):
        out = out.union(rows.mapInArrow(tidy(_find(spark.sparkContext.broadcast(index))), schema))
    return out


def _keep(shared, column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches, column, 2 << 20):
            texts = pc.fill_null(batch.column(column).cast(pa.binary()), b"")
            found = index.search([t.decode("utf-8", "replace") for t in texts.to_pylist()])
            yield batch.filter(pa.array([not x for x in found])).select(names)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """The documents, with all their columns, in which no item occurs. Rows don't move.

    Null and empty texts stay, and so does everything if the benchmark has no item of q characters
    or more. Rows alike all stay or all go. Very long texts are compared whole, in runs. An empty
    table returns no rows. Extra columns stay, whatever their names.
    """
    for index in blocks(benchmark, p):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        plain = docs.schema["text"].dataType.simpleString() == "string"  # then the text goes to Python once
        rows = docs if plain else docs.withColumn(f"{OWN}text", raw_text())
        docs = rows.mapInArrow(tidy(_keep(shared, "text" if plain else f"{OWN}text", docs.columns)), docs.schema)
    return docs


def op7(spark, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages: doc_id, item_id, patterns, edits, begin, end."""
    return matches(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
