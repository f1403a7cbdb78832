"""Repeated runs of lines, by a suffix array over line ids built with distributed prefix doubling.

Every line with a word becomes an id (a 128-bit digest of the stripped line); a document is a
sequence of ids and the corpus their concatenation, broken between documents. Suffixes are
ranked by their first line, then by their first 2, 4, 8, ... lines: a round ranks the pairs
(rank, rank 2**k lines on) by a distributed sort. A suffix whose rank nobody shares can't start
a repeat and leaves, so later rounds hold repeated runs only.

A run of n lines with 2**k <= n < 2**(k+1) is named by its length and the ranks of its first
and last 2**k lines: suffixes of one name are an interval of the suffix array whose longest
common prefix is n or more. In each interval the first occurrence (document id, then place)
stays and the later ones are deleted.

A repeat counts from `min_words` words on. It is enough to look up, for each line, the shortest
run from it and the shortest run up to it that have so many words: every maximal repeated run
is the union of such runs, and each of them is repeated itself. They have at most `min_words`
lines, which bounds the rounds by log2(min_words) whatever the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, discard, materialize, raw_text, slices, tidy, tie

MIN_WORDS = 50


def line_spans(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line the lengths of the runs from it that are the shortest, from their first line
    or up to their last one, with `least` words. Two runs a line at most, on average."""
    ends = np.cumsum(words)
    before = ends - words
    n, at = len(words), np.arange(len(words))
    last = np.searchsorted(ends, before + least)  # the first line at which enough words have come
    first = np.searchsorted(before, ends - least, "right") - 1
    out: list[list[int]] = [[int(b) - a + 1] if b < n else [] for a, b in zip(at.tolist(), last, strict=True)]
    for b, a in enumerate(first.tolist()):
        if a >= 0 and b - a + 1 not in out[a]:
            out[a].append(b - a + 1)
    return out


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, "text", 2 << 20):
            counts, ids, spans = [], [], []
            for text in batch.column("text").to_pylist():
                own = [s for line in text.split(b"\n") if (s := line.strip())]
                counts.append(len(own))
                if own:
                    ids += map(digest, own)
                    spans += line_spans(np.array([len(s.split()) for s in own]), least)
            each = np.repeat(np.arange(batch.num_rows), counts)
            take = pa.array(each)
            place = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("tie").take(take), pa.array(place, pa.int32()), pa.array(ids, pa.binary()), pa.array(spans, pa.list_(pa.int32()))],
                names=["doc_id", "tie", "pos", "line", "spans"],
            )

    return run


def _cumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = at + np.cumsum(n)
        columns = {c: batch.column(c) for c in batch.schema.names} | {"part": pa.array(np.full(len(n), part, np.int32)), "inside": pa.array(ends - n)}
        at = int(ends[-1]) if len(ends) else at
        yield pa.RecordBatch.from_pydict(columns)


def ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Add rank: how many rows the groups with smaller keys stand for (column n), over all partitions.

    The groups are range-partitioned and sorted; one total a partition reaches the driver.
    """
    spark = groups.sparkSession
    placed = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields)
    placed = materialize(placed.mapInArrow(tidy(_cumulate), f"{kinds}, part int, inside long"))
    totals = sorted(map(tuple, placed.groupBy("part").agg(F.sum("n")).collect()))
    base, at = [(-1, 0)], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    # From Arrow: of a list Spark makes Python tasks of the RDD kind, whose workers would stay beside the others.
    parts, bases = zip(*base, strict=True)
    starts = spark.createDataFrame(pa.table({"part": pa.array(parts, pa.int32()), "base": pa.array(bases, pa.int64())}))
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("base") + F.col("inside")).drop("part", "base", "inside")


def _runs(level: int):
    """From each document's ranks: the pairs of the next round (n 0) and this round's runs (n lines)."""
    step = 1 << level

    def out(found: list) -> pa.RecordBatch:
        doc, tie_, pos, n, r1, r2 = ([x for part in found for x in part[k]] for k in range(6))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = ["doc_id", "tie", "pos", "n", "r1", "r2"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((doc, tie_, pos, n, r1, r2), kinds, strict=True)], names=names)

    def of(key: tuple, rows: list[tuple]) -> tuple | None:
        rank = {pos: r for pos, r, _ in rows}  # a row that repeats whole has the same places
        new: list[tuple[int, int, int, int]] = []
        for pos, r, spans in rows:
            if (r2 := rank.get(pos + step)) is not None:
                new.append((pos, 0, r, r2))
            for lines in spans:
                if step <= lines < 2 * step and (r2 := rank.get(pos + lines - step)) is not None:
                    new.append((pos, lines, r, r2))
        if not new:
            return None
        new = list(dict.fromkeys(new))
        pos, n, r1, r2 = zip(*new, strict=True)
        return [key[0]] * len(new), [key[1]] * len(new), pos, n, r1, r2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "tie", "pos", "rank", "spans")]
            for doc, tie_, *row in zip(*columns, strict=True):
                if (doc, tie_) != now:
                    if rows and (x := of(now, rows)):
                        found.append(x)
                    now, rows = (doc, tie_), []
                rows.append(tuple(row))
            if found:
                yield out(found)
                found = []
        if rows and (x := of(now, rows)):
            yield out([x])

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tie, pos, n): every run of n lines from line pos (lines with words, from 0) that came before."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie("text").alias("tie"), raw_text().alias("text"))
    lines = materialize(rows.mapInArrow(tidy(_lines(min_words)), "doc_id long, tie long, pos int, line binary, spans array<int>"))
    shared = lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1")
    first = materialize(ranked(shared, ["line"]).select("line", "rank"))
    ranks = materialize(lines.join(first, "line").select("doc_id", "tie", "pos", "rank", "spans"))
    discard(lines)
    gone = []
    for level in range(max(1, min_words.bit_length())):
        ordered = ranks.repartition("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "pos")
        runs = materialize(ordered.mapInArrow(tidy(_runs(level)), "doc_id long, tie long, pos int, n int, r1 long, r2 long"))
        named = runs.filter("n > 0")
        place = F.struct("doc_id", "tie", "pos")
        intervals = named.groupBy("n", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
        intervals = materialize(intervals.drop("times"))
        gone.append(materialize(named.join(intervals, ["n", "r1", "r2"]).filter(place > F.col("first")).select("doc_id", "tie", "pos", "n")))
        pairs = runs.filter("n = 0").groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1")
        deeper = materialize(ranked(pairs, ["r1", "r2"]).select("r1", "r2", "rank"))
        kept = runs.filter("n = 0").drop("n").join(deeper, ["r1", "r2"]).select("doc_id", "tie", "pos", "rank")
        spans = ranks.select("doc_id", "tie", "pos", "spans").dropDuplicates(["doc_id", "tie", "pos"])
        same = [kept["doc_id"].eqNullSafe(spans["doc_id"]), kept["tie"] == spans["tie"], kept["pos"] == spans["pos"]]
        before, ranks = ranks, materialize(kept.join(spans, same).select(kept["doc_id"], kept["tie"], kept["pos"], "rank", "spans"))
        discard(before)
        discard(runs)
    return reduce(DataFrame.union, gone)


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the runs' lines from the text; texts without runs pass as they are, null included."""
    for batch in slices(batches, "text", 2 << 20):
        texts, runs = batch.column("text").to_pylist(), batch.column(f"{OWN}runs").to_pylist()
        out, lines, deleted = [], [], []
        for text, own in zip(texts, runs, strict=True):
            parts = (text or "").split("\n")
            worded = [k for k, line in enumerate(parts) if line.encode().strip()]
            drop = {worded[p] for r in own or () for p in range(r["pos"], r["pos"] + r["n"])}
            out.append("\n".join([x for k, x in enumerate(parts) if k not in drop]) if drop else text)
            lines.append(len(worded))
            deleted.append(len(drop))
        columns = {c: batch.column(c) for c in batch.schema.names if c != f"{OWN}runs"}
        columns |= {"text": pa.array(out, pa.string()), f"{OWN}lines": pa.array(lines, pa.int64()), f"{OWN}deleted": pa.array(deleted, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)


def delete_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, text without later copies of repeated runs, plus two counts of lines.

    The counts (``__cc_lines``, ``__cc_deleted``) are of lines with words. Order is by doc_id
    (an integer; null first), then text digest. Null and empty texts stay as they are. Rows that
    repeat whole (id and text) are one document, and each returns with the same deletions; ids
    that repeat with other texts are documents of their own. An empty table returns no rows.
    """
    runs = repeats(docs, min_words).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("pos", "n")).alias(f"{OWN}runs"))
    runs = runs.select(F.col("doc_id").alias(f"{OWN}id"), F.col("tie").alias(f"{OWN}of"), f"{OWN}runs")
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumn(f"{OWN}tie", tie("text"))
    same = rows["doc_id"].eqNullSafe(runs[f"{OWN}id"]) & (rows[f"{OWN}tie"] == runs[f"{OWN}of"])
    joined = rows.join(runs, same, "left").select(*docs.columns, f"{OWN}runs")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop(f"{OWN}runs").schema.fields)
    return joined.mapInArrow(tidy(_delete), f"{kinds}, {OWN}lines long, {OWN}deleted long")


def keep_remaining(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with all their columns, with their repeated runs deleted; those of which no line is left go.

    Null and empty texts have no lines and stay as they are. Rows alike in id and text get the same
    deletions; ties go by :func:`delete_repeats`. Very long texts are compared whole. An empty table
    returns no rows. Extra columns stay, whatever their names.
    """
    found = delete_repeats(docs, min_words)
    left = (F.col(f"{OWN}deleted") == 0) | (F.col(f"{OWN}deleted") < F.col(f"{OWN}lines"))
    return found.filter(left).select(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text without later copies, n_lines, n_deleted (lines with words)."""
    found = delete_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col(f"{OWN}lines").alias("n_lines"), F.col(f"{OWN}deleted").alias("n_deleted"))
