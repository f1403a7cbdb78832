"""A prefix trie of conversations by partition refinement.

All conversations start in one class. In round d each active class is split by its members' d-th turn; what comes
out are the trie's nodes of depth d. A class that holds one sequence of turns only (copies count as one
sequence) is retired, and the rest of that sequence becomes a chain of nodes with one child each. So rounds end
where different sequences part, not where the longest one ends. Then the levels are folded back from the
deepest to the root, each adding its totals to its parents.

Turns are compared by SHA-256 of role and text; the texts themselves never move. A class is named by its smallest
conversation, which with the depth names the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import forget, written
from ..operators.scan import running

#: Ids a row of the list that is hashed.
_RUN = 1 << 16
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ender")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, bytes, upto): each turn in its place; upto: bytes of all texts so far.

    Order is by turn, null first, then by role and digest, so ties and repeated rows have one order. Null roles and texts are
    empty; rows without conv_id belong to no conversation. One conversation may hold any share of the rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = running(rows, ["conv_id"], ["turn", "role", "digest"], {"pos": F.lit(1), "upto": F.col("bytes")})
    return placed.select("conv_id", "pos", "digest", "bytes", "upto")


def refilled(own: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: the tables (turns, conversations) of :func:`prefix_trie`.

    `base` and `heads` are expressions of conv_id: conversation c gets the first `heads` turns of `base` (all if it
    has fewer, none if it isn't there), then its own after its first `heads`. `most` bounds `heads`.
    """
    own = written(own)
    ids = own.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("upto").alias("total"), F.coalesce(F.max(F.when(F.col("pos") <= heads, F.col("upto"))), F.lit(0)).alias("cut")
    ).select("*", base.alias("base"), heads.alias("h"))
    head = own.filter(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes", "upto")
    lent = ids.select("conv_id", "base", "h").join(head, "base").filter("pos <= h").select("conv_id", "pos", "digest", "bytes", "upto")
    got = lent.groupBy("conv_id").agg(F.max("pos").alias("m"), F.max("upto").alias("lent"))
    facts = written(ids.join(got, "conv_id", "left").select("conv_id", "n", "h", "total", "cut", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("m", "lent"))))
    rest = own.join(facts, "conv_id").filter("pos > h").select("conv_id", F.expr("pos - h + m").alias("pos"), "digest", "bytes", F.expr("upto - cut + lent").alias("upto"))
    long = F.col("n") > F.col("h")
    convs = facts.select("conv_id", (F.col("m") + F.when(long, F.col("n") - F.col("h")).otherwise(0)).alias("length"), (F.col("lent") + F.when(long, F.col("total") - F.col("cut")).otherwise(0)).alias("total"))
    return lent.unionByName(rest), convs


def whole(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: the tables (turns, conversations) of :func:`prefix_trie`."""
    return own, own.groupBy("conv_id").agg(F.max("pos").alias("length"), F.max("upto").alias("total"))


def _sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Per conversation s: the smallest one with the same turns, copies: how many there are, length, total.

    Sequences are compared by their length and two 64-bit sums of hashes of place and digest, so that a long one needs no list.
    """
    sums = [F.sum(F.xxhash64(*c).cast("decimal(38,0)")) for c in (("pos", "digest"), (F.lit(7), "digest", "pos"))]
    marks = rows.groupBy("conv_id").agg(*(s.alias(n) for s, n in zip(sums, ("s1", "s2"), strict=True)))
    zero = F.lit(0).cast("decimal(38,0)")
    marked = written(convs.join(marks, "conv_id", "left").select("conv_id", "length", "total", *(F.coalesce(F.col(c).cast("decimal(38,0)"), zero).alias(c) for c in ("s1", "s2"))))
    same = ["length", "s1", "s2"]
    copies = marked.groupBy(*same).agg(F.min("conv_id").alias("s"), F.count("*").alias("copies"))
    return marked.join(copies, same).select("conv_id", "s", "copies", "length", "total")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by s and conv_id to joined lists of at most `_RUN` ids."""
    for batch in batches:
        s, ids = batch.column("s").to_pylist(), batch.column("conv_id").to_pylist()
        out, start = [], 0
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i] != s[start] or i - start == _RUN:
                out.append((s[start], ids[start], ",".join(map(str, ids[start:i])).encode()))
                start = i
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())], names=["s", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lists of each s, which come in order; only the hash's state is held."""
    now, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["s", "sha"])

    for batch in batches:
        for s, ids in zip(batch.column("s").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if s != now:
                if state:
                    yield out()
                now, state = s, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if state:
        yield out()


def ends(members: DataFrame) -> DataFrame:
    """(s, sha): SHA-256 of the ascending, comma-joined ids of the conversations with the sequence of s.

    A large group of copies is sorted and joined by many tasks; only its bytes, not its rows, pass through the one that hashes.
    """
    alone = members.filter("copies = 1").select("s", F.sha2(F.col("s").cast("string"), 256).alias("sha"))
    lists = members.filter("copies > 1").select("s", "conv_id").repartitionByRange("s", "conv_id").sortWithinPartitions("s", "conv_id").mapInArrow(_runs, "s long, first long, ids binary")
    return alone.unionByName(lists.repartition("s").sortWithinPartitions("s", "first").mapInArrow(_hashed, "s long, sha string"))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes over turns (conv_id, pos, digest, bytes, upto) and conversations (conv_id, length, total).

    One row a node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (bytes that the members but one need not repeat, over the subtree), digest (of the last turn; null for the root),
    ends_sha256 (of the members that end here). A conversation without turns ends at the root. No conversations: no nodes.
    Very long conversations and copies cost no rounds; rounds are as many as the turns that two different sequences share, and one.
    """
    rows = written(rows)
    members = written(_sequences(rows, convs))
    seqs = members.filter("conv_id = s").select("s", "copies", "length", "total")
    own = rows.join(seqs.select(F.col("s").alias("conv_id")), "conv_id").select(F.col("conv_id").alias("s"), "pos", "digest", "bytes", "upto")
    own = written(own.repartitionByRange("pos", "s").sortWithinPartitions("pos", "s"))  # a round reads the row groups of its turn
    forget(rows)
    facts = [F.min("s").alias("conv_id"), F.sum("copies").alias("n_convs"), F.count("*").alias("sequences"), F.max("length").alias("length"), F.max("total").alias("total")]
    root = seqs.agg(*facts, F.max(F.when(F.col("length") == 0, F.col("s"))).alias("ender")).filter("sequences > 0")
    own_turn = {"parent_conv_id": "long", "digest": "binary"}
    root = written(root.select("*", *(F.lit(None).cast(t).alias(n) for n, t in own_turn.items()), *(F.lit(0).cast("long").alias(n) for n in ("bytes", "upto")), F.lit(0).alias("depth")))
    levels, done = [root], []
    active = seqs.crossJoin(F.broadcast(root.filter("sequences > 1").select(F.col("conv_id").alias("class"))))  # one row
    while levels[-1].filter("sequences > 1").limit(1).count():
        depth = len(levels)
        turn = own.filter(F.col("pos") == depth).drop("pos")
        step = written(active.filter(F.col("length") >= depth).join(turn, "s"))
        nodes = written(
            step.groupBy("class", "digest").agg(*facts, F.max(F.when(F.col("length") == depth, F.col("s"))).alias("ender"), F.max("upto").alias("upto"), F.max("bytes").alias("bytes"))
            .withColumnRenamed("class", "parent_conv_id").withColumn("depth", F.lit(depth)).select(*root.columns)
        )
        split = nodes.filter("sequences > 1").select(F.col("parent_conv_id").alias("class"), "digest", F.col("conv_id").alias("next"))
        active = step.join(split, ["class", "digest"]).select("s", "copies", "length", "total", F.col("next").alias("class"))
        levels.append(nodes)
        done.append(step)
    single = F.col("sequences") == 1
    spared = (F.col("n_convs") - 1) * F.when(single, F.col("total") - F.col("upto") + F.col("bytes")).otherwise(F.col("bytes"))
    found, kids = [], None
    for nodes in reversed(levels):
        tail = [F.when(single & (F.col("length") > F.col("depth")), 1).otherwise(0), F.when(single, 1).otherwise(0), spared]
        more = [F.lit(0)] * 3
        if kids is not None:
            nodes = nodes.join(kids, nodes["conv_id"] == kids["of"], "left")
            more = [F.coalesce(c, F.lit(0)) for c in ("kids", "kids_leaves", "kids_saved")]
        totals = [(a + b).cast("long").alias(n) for a, b, n in zip(tail, more, _NODE[4:7], strict=True)]
        folded = written(nodes.select(*_NODE[:4], *totals, "ender", "digest"))
        kids = folded.groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("kids_leaves"), F.sum("saved_tokens").alias("kids_saved"))
        found.append(folded)
    retired = reduce(DataFrame.union, (x.filter("sequences = 1").select(F.col("conv_id").alias("s"), F.col("depth").alias("from"), "n_convs", "length", "total") for x in levels))
    chains = own.join(retired, "s").filter("pos > from").select(
        F.col("s").alias("conv_id"), F.col("pos").cast("int").alias("depth"), F.col("s").alias("parent_conv_id"), "n_convs",
        F.when(F.col("pos") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (F.col("total") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
        F.when(F.col("pos") == F.col("length"), F.col("s")).alias("ender"), "digest",
    )
    for x in found:
        chains = chains.unionByName(x)
    forget(*done)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    named = ends(members).select(F.col("s").alias("ender"), "sha")
    return chains.join(named, "ender", "left").select(*_NODE[:7], "digest", F.coalesce("sha", none).alias("ends_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations: c's first h turns are those of c - c % 5; h: crc32 of c modulo 9."""
    own = turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    c = F.col("conv_id")
    rows, convs = refilled(own, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8)
    nodes = prefix_trie(rows, convs)
    return nodes.select("conv_id", *(F.col(n).cast("long").alias(n) for n in _NODE[1:7]), "ends_sha256")
