"""Near-duplicate documents by SimHash fingerprints and anchor-point covering.

Two fingerprints link if they differ in at most two bits. A covering code supplies the
anchors: every fingerprint lies near one, its home. Each fingerprint is replicated to every
anchor that could be the home of a fingerprint within the threshold, so linked pairs meet at
a home anchor and nowhere has all rows. The code is a product of perfect binary codes over blocks
of the fingerprint's bits: Golay [23, 12], covering radius 3, over one or two blocks, and for
many fingerprints Hamming [15, 11], radius 1, over a third. In its product metric an anchor is in
reach when the distances beyond the radius in the blocks sum to 2 or less. Two blocks give 2**24
anchors and 61 replicas a fingerprint on average, three give 2**35 and 155; the number of distinct
fingerprints decides, so that comparisons a fingerprint stay bounded as they grow.

Copies collapse first: one row per distinct fingerprint takes part, and a fingerprint has at
most 2,080 others within two bits, so links stay proportional to distinct fingerprints.

Where a similarity is asked for, texts whose shingle sets have that Jaccard link as well: MinHash
bands find candidates, the shingle sets decide. Members of a bucket are first held to a few common
partners. Buckets that then still hold different groups are dealt into cells of bounded bytes, and a
cell counts the shingles that its sets have in common as arrays: pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, discard, materialize, raw_text, shuffled, slices, tidy, tie, word_runs
from .components import components

#: Generator polynomial, length and covering radius of each block's code (fixed values).
CODES = ((0xC75, 23, 3), (0xC75, 23, 3), (0x13, 15, 1))
#: Distinct fingerprints from which the third block takes part.
MANY = 1 << 24
THRESHOLD = 2
SHINGLE = 3
SEED = 42
#: MinHash bands and rows: at a Jaccard of 0.8 a pair shares a bucket with chance 0.9996.
BANDS, ROWS = 20, 5
#: Of 100 one-bit sketches so many may differ; at a Jaccard of 0.8 ten do, with a deviation of three.
SKETCH = 24
#: Rounds in which the members of a bucket are held to common partners, at most.
STARS = 2
#: Bytes of shingle sets, and sets, of one part of a bucket.
PART_BYTES, PART = 4 << 20, 1024
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def syndrome(y: np.ndarray, block: int = 0) -> np.ndarray:
    """Remainder by the generator: the bits that name the coset of each value of a block."""
    poly, length, _ = CODES[block]
    degree, y = poly.bit_length() - 1, np.array(y, dtype=np.int64)
    for bit in range(length - 1, degree - 1, -1):
        y ^= ((y >> bit) & 1) * (poly << (bit - degree))
    return y


@cache
def cosets(block: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """By extra flips: (patterns of weight up to the radius, one and two more, sorted by coset; where each coset begins).

    A pattern of a value's coset leads from the value to a codeword. Perfect: up to the radius there is one.
    """
    poly, length, radius = CODES[block]
    out = []
    for weights in (range(radius + 1), (radius + 1,), (radius + 2,)):
        patterns = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(length), w)])
        key = syndrome(patterns, block)
        order = np.argsort(key, kind="stable")
        out.append((patterns[order], np.searchsorted(key[order], np.arange((1 << poly.bit_length() - 1) + 1))))
    return out


def _shift(block: int) -> int:
    return sum(length for _, length, _ in CODES[:block])


def _block(prints: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The b-th block of each fingerprint, and its coset."""
    y = ((prints >> np.uint64(_shift(b))) & np.uint64((1 << CODES[b][1]) - 1)).astype(np.int64)
    return y, syndrome(y, b)


def homes(prints: np.ndarray, blocks: int) -> np.ndarray:
    """The anchor nearest to each unsigned fingerprint."""
    out = np.zeros(len(prints), np.int64)
    for b in range(blocks):
        (leader, begin), (y, coset) = cosets(b)[0], _block(prints, b)
        out |= (y ^ leader[begin[coset]]) << _shift(b)
    return out


def replicas(prints: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor that may be the home of a fingerprint within the threshold of a row's."""
    own = [_block(prints, b) for b in range(blocks)]
    rows, found = [], []

    def grow(b: int, left: int, row: np.ndarray, anchor: np.ndarray) -> None:
        """Anchors of blocks from b on, with at most `left` flips beyond the radius."""
        if b == blocks:
            rows.append(row)
            found.append(anchor)
            return
        y, coset = own[b]
        for flips in range(left + 1):
            patterns, begin = cosets(b)[flips]
            n = (begin[coset + 1] - begin[coset])[row]
            r, k = np.repeat(row, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            grow(b + 1, left - flips, r, np.repeat(anchor, n) | (y[r] ^ patterns[begin[coset[r]] + k]) << _shift(b))

    grow(0, THRESHOLD, np.arange(len(prints)), np.zeros(len(prints), np.int64))
    return np.concatenate(rows), np.concatenate(found)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit. Long inputs add eight byte lanes at a time."""
    if len(hashes) < 1024:
        return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    lanes = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
    lanes[: len(hashes)] = hashes
    lanes = lanes.reshape(-1, 255)
    out = np.empty((8, 8), dtype=np.int64)
    for k in range(8):
        sums = ((lanes >> np.uint64(k)) & np.uint64(0x0101010101010101)).sum(1, dtype=np.uint64)
        out[:, k] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out.ravel()


def hashed(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, by runs; fewer words than a shingle: of all of them."""
    some, held = False, []
    digest = xxhash.xxh64_intdigest
    for run in word_runs(text):
        held += run
        if len(held) >= shingle:
            grams = zip(*(held[i:] for i in range(shingle)), strict=False)
            yield np.array([digest(b" ".join(g), SEED) for g in grams], dtype=np.uint64)
            some, held = True, held[1 - shingle :]
    if held and not some:
        yield np.array([digest(b" ".join(held), SEED)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles' XXH64; no words: zero; fewer words than a shingle: all of them."""
    return _print(hashed(text, shingle))


def _print(parts: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in parts:
        counts, n = counts + bit_counts(h), n + len(h)
    return int(sum(1 << int(b) for b in np.flatnonzero(counts * 2 > n)))


def minima(parts: Iterable[np.ndarray]) -> np.ndarray | None:
    """The least value of all hashes under each of 100 permutations; None if there are no hashes."""
    least = None
    for h in parts:
        for start in range(0, len(h), 2048):
            own = (h[start : start + 2048, None] * _FACTORS).min(0)
            least = own if least is None else np.minimum(least, own)
    return least


def _buckets(least: np.ndarray) -> tuple[list[int], int, int]:
    """The bucket of each band, and the sketch in two parts."""
    rows = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(rows)]
    bits = np.zeros(128, np.uint8)
    bits[: len(least)] = (least >> np.uint64(20)) & np.uint64(1)  # of least values the first bits are all zero
    one, two = np.packbits(bits, bitorder="little").view(np.int64).tolist()
    return keys, one, two


def distinct(text: bytes, shingle: int) -> np.ndarray:
    """The text's shingle set, as sorted hashes."""
    return np.unique(np.concatenate([*hashed(text, shingle), np.zeros(0, np.uint64)]))


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """Of two shingle sets; of empty ones 0."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / max(1, len(one) + len(two) - both)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            prints = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(prints.view(np.int64))],
                names=["doc_id", "tie", "fp"],
            )

    return run


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            prints, found = [], []
            for t in batch.column("text").to_pylist():
                parts = list(hashed(t, shingle))
                prints.append(_print(parts))
                found.append((None, 0, 0) if (least := minima(parts)) is None else _buckets(least))
            kept, one, two = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("tie"), pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array(kept, pa.list_(pa.int64())), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                ],
                names=["doc_id", "tie", "fp", "buckets", "one", "two"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = [distinct(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(found, pa.binary())], names=["t", "set"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x"), batch.column("y"), strict=True)
            good = [jaccard(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy)) >= least for xy in pairs]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return run


def _common(cell: pa.Table, least: float) -> set[tuple[int, int]]:
    """(component, other) of the sets of a cell that have the similarity, in different components."""
    side, low, high, group = (cell.column(c).to_numpy() for c in ("side", "low", "high", "component"))
    if (group == group[0]).all():
        return set()
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for chunk in cell.column("set").chunks for v in chunk]
    size = np.array([len(x) for x in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(place, np.cumsum(size)[:-1])
    to = np.flatnonzero(side == high[0])
    flat, starts = np.concatenate([own[k] for k in to]), np.concatenate([[0], np.cumsum(size[to])[:-1]])
    mark, found = np.zeros(int(place.max()) + 1, np.int32), set()
    for x in np.flatnonzero(side == low[0]).tolist():
        if (others := group[to] != group[x]).any():
            mark[own[x]] = 1
            both = np.add.reduceat(mark[flat], starts)
            near = others & (both >= least * (size[x] + size[to] - both))
            found.update((int(group[x]), c) for c in np.unique(group[to][near]).tolist())
            mark[own[x]] = 0
    return found


_CELL = ("bucket", "low", "high")


def _linked(least: float):
    """Rows come sorted by cell; a cell is compared when its last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> pa.RecordBatch:
            found = sorted(_common(pa.Table.from_batches(held), least))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["ca", "cb"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _CELL], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and tuple(keys[a]) != now:
                        yield out()
                        held = []
                    now = tuple(keys[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return run


def _anchored(blocks: int, home: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for start in range(0, len(prints), 4096):
                part = prints[start : start + 4096]
                unsigned = part.view(np.uint64)
                row, anchor = (np.arange(len(part)), homes(unsigned, blocks)) if home else replicas(unsigned, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], names=["anchor", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, sketches: bool = False) -> DataFrame:
    """(doc_id, tie, fp) for every row; tie tells rows of one doc_id apart by their text.

    With sketches also the MinHash buckets (null without words) and the sketch's parts.
    """
    rows = docs.select("doc_id", tie("text").alias("tie"), raw_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if sketches:
        return rows.mapInArrow(tidy(_sketches(shingle)), f"doc_id {kind}, tie long, fp long, buckets array<long>, one long, two long")
    return rows.mapInArrow(tidy(_fingerprints(shingle)), f"doc_id {kind}, tie long, fp long")


def links(prints: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, b) of all linked distinct fingerprints, a < b, each once. `prints`: one column fp, distinct."""
    blocks = blocks or (2 if prints.count() < MANY else 3)
    home = prints.mapInArrow(tidy(_anchored(blocks, home=True)), "anchor long, fp long")
    near = prints.mapInArrow(tidy(_anchored(blocks, home=False)), "anchor long, fp long").withColumnRenamed("fp", "fp2")
    return home.join(
        shuffled(near), (home.anchor == near.anchor) & (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= THRESHOLD)
    ).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def _relabel(rows: DataFrame, old: DataFrame) -> DataFrame:
    """`rows` with the new name of each component that has one in `old` (old, new)."""
    out = rows.join(shuffled(old), rows.component == old.old, "left")
    return out.withColumn("component", F.coalesce("new", "component")).drop("old", "new")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs of ties (a, b), distinct, whose shingle sets have at least the similarity."""
    x = sets.select(F.col("t").alias("tx"), F.col("set").alias("x"))
    y = sets.select(F.col("t").alias("ty"), F.col("set").alias("y"))
    rows = pairs.join(shuffled(y), pairs.b == y.ty).join(shuffled(x), F.col("a") == x.tx).select("a", "b", "x", "y")
    conf, name = pairs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    conf.set(name, str(8 << 20))  # two sets a row
    try:
        return materialize(rows.mapInArrow(tidy(_similar(least)), "a long, b long"))
    finally:
        conf.set(name, before)


def _joined(docs: DataFrame, found: DataFrame, label: DataFrame, shingle: int, least: float) -> DataFrame:
    """(component, joined) where texts of the least similarity put components of `label` (fp, component) together."""
    rows = found.filter("buckets is not null").dropDuplicates(["tie"]).join(shuffled(label.select("fp", "component")), "fp")
    rows = rows.select(F.col("tie").alias("node"), "component", "one", "two", F.explode("buckets").alias("bucket"))
    apart = F.bit_count(F.col("one").bitwiseXOR(F.col("p1"))) + F.bit_count(F.col("two").bitwiseXOR(F.col("p2"))) <= SKETCH
    joined, sets = None, None

    def still_open(rows: DataFrame) -> DataFrame:
        """The buckets that hold more than one component."""
        mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return materialize(rows.join(shuffled(mixed.filter("low <> high").select("bucket")), "bucket"))

    def merge(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
        """links: (ca, cb), components that belong together."""
        nonlocal joined
        links = materialize(links.filter("ca <> cb").distinct())
        if n := links.count():
            old = materialize(components(links).select(F.col("node").alias("old"), F.col("component").alias("new")))
            rows = _relabel(rows, old)
            if joined is None:
                joined = materialize(old)
            else:
                moved = joined.join(shuffled(old.select(F.col("old").alias("k"), F.col("new").alias("v"))), F.col("new") == F.col("k"), "left")
                moved = moved.select("old", F.coalesce("v", "new").alias("new"))
                joined = materialize(moved.union(old.join(shuffled(moved.select("old")), "old", "left_anti")))
        return rows, n

    rows = still_open(rows)
    # The shingle sets of all that may meet somebody, once; a small table is broadcast, and then the texts stay.
    nodes = materialize(rows.select(F.col("node").alias("n")).distinct())
    texts = docs.select(tie("text").alias("t"), raw_text().alias("text"))
    texts = texts.join(nodes, texts.t == nodes.n, "left_semi").dropDuplicates(["t"])
    sets = materialize(texts.mapInArrow(tidy(_sets(shingle)), "t long, set binary"))
    for k in range(STARS):
        order = F.xxhash64("node", F.lit(k))
        key = F.struct(order.alias("o"), "node", "component", "one", "two")
        star = rows.groupBy("bucket").agg(F.min(key).alias("p"))
        star = star.select("bucket", F.col("p.node").alias("partner"), F.col("p.component").alias("pc"), F.col("p.one").alias("p1"), F.col("p.two").alias("p2"))
        pairs = rows.join(shuffled(star), "bucket").filter((F.col("component") != F.col("pc")) & apart)
        both = materialize(pairs.select(F.least("partner", "node").alias("a"), F.greatest("partner", "node").alias("b")).distinct())
        names = rows.select("node", "component").distinct()
        at = names.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        to = names.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        rows, n = merge(rows, _verified(both, sets, least).join(shuffled(at), "a").join(shuffled(to), "b").select("ca", "cb"))
        discard(both)
        rows = still_open(rows)
        if not n:
            break
    held = rows.select("bucket", "node", "component").join(shuffled(sets), F.col("node") == sets.t).select("bucket", "node", "component", "set")
    size = held.groupBy("bucket").agg(F.greatest(F.sum(F.length("set")) / PART_BYTES, F.count("*") / PART).alias("parts"))
    held = held.join(shuffled(size.select("bucket", F.ceil("parts").cast("int").alias("parts"))), "bucket")
    side = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = held.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "component", "set")
    cells = dealt.repartition(*_CELL).sortWithinPartitions(*_CELL)
    merge(rows, cells.mapInArrow(tidy(_linked(least)), "ca long, cb long"))
    discard(sets)
    return joined


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, blocks: int | None = None, similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, tie, fp, component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a
    doc_id each return. A null doc_id is no smallest id; a group of only such has a null component.
    An empty table returns no rows. Extra columns are not read. With a similarity (0.8 is what
    the bands are made for) texts whose shingle sets have that Jaccard or more link as well.
    """
    found = materialize(fingerprints(docs, shingle, similarity is not None))
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(distinct.select("fp"), blocks))
    label = distinct.join(shuffled(groups), distinct.fp == groups.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    if similarity is not None:
        label = materialize(label)
        if (joined := _joined(docs, found, label, shingle, similarity)) is not None:
            label = label.join(shuffled(joined), label.component == joined.old, "left").select(
                "fp", "least", F.coalesce("new", "component").alias("component")
            )
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named = label.join(shuffled(least), "component").select("fp", "component_id")
    return found.join(shuffled(named), "fp").select("doc_id", "tie", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, blocks: int | None = None, similarity: float | None = None) -> DataFrame:
    """The documents, with all their columns, of which each group's first stays: the least doc_id, then the least content key.

    Of rows with that id and text alike the one with the least hash of all columns stays. Null and
    empty texts form groups like any other; a null doc_id comes first. Extra columns stay, whatever
    their names. Very long texts are read whole, in runs. An empty table returns no rows.
    """
    found = materialize(near_duplicates(docs, shingle, blocks, similarity).drop("fp"))
    each = found.groupBy("doc_id", "tie").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    first = each.groupBy("component_id").agg(F.min(F.struct("doc_id", "tie", "n")).alias("k"))
    first = first.select(F.col("k.doc_id").alias(f"{OWN}id"), F.col("k.tie").alias(f"{OWN}tie"), F.col("k.n").alias(f"{OWN}n"))
    rows = docs.withColumn(f"{OWN}t", tie("text"))
    kept = rows.join(shuffled(first), rows["doc_id"].eqNullSafe(first[f"{OWN}id"]) & (rows[f"{OWN}t"] == first[f"{OWN}tie"]))
    once = kept.filter(F.col(f"{OWN}n") == 1).select(*docs.columns)
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    more = kept.filter(F.col(f"{OWN}n") > 1).groupBy("doc_id", f"{OWN}t")
    row = more.agg(F.min_by(F.struct(*(docs[c] for c in docs.columns)), F.xxhash64(*(docs[c] for c in hashable))).alias(f"{OWN}row"))
    return once.union(row.select(*(F.col(f"{OWN}row").getField(c) for c in docs.columns)))


def op6(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
