import hashlib
import random
import zlib

from corpuscle.llm import trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, pos string, digest array<int>"


def ordered(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    dig = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}:{r[3]}".encode()).digest()
    return {c: [(r[2], r[3]) for r in sorted(x, key=lambda r: (r[0], r[1], r[2].encode(), dig(r)))] for c, x in own.items()}


def rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
    return out


def brute(convs):
    """node path -> row, by dictionaries over all prefixes."""
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    totals, out = {}, set()
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        below = [totals[k] for k in kids.get(path, [])]
        totals[path] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
        done = sorted(c for c in members[path] if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(members[path]), len(path), parent, len(members[path]), len(kids.get(path, [])), *totals[path], hashlib.sha256(",".join(map(str, done)).encode()).hexdigest()))
    assert len(out) == len(members)
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = trie.op12(spark, sf)
    assert all(t == "bigint" for c, t in df.dtypes if c != "ends_sha256")
    assert found(df) == brute(rebuilt(ordered(rows)))


def test_shared_prefixes_copies_and_edges(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(40), -7, -5, -10]:
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["u", "a"]), r.choice(["x", "é" * 3, "", None])))
    rows += [(c, t, "u", f"copy {t}") for c in range(100, 130) for t in range(5)]
    rows += [(200, t, "u", "long " * (t % 3)) for t in range(3000)]
    rows += [(300, None, "u", "z"), (300, None, None, "y"), (300, 4, "u", "p"), (300, 4, "u", "p"), (300, 4, "a", "q"), (None, 1, "u", "nobody"), (303, 1, "u", "w")]
    rows += [(301, 0, "a:1", "b"), (302, 0, "a", "1:b")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "p", [1]) for x in rows], SCHEMA)
    own = ordered(rows)
    assert found(trie.prefix_trie(*trie.whole(trie.turns(df)))) == brute(own)
    c = F.col("conv_id")
    again = trie.refilled(trie.turns(df), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8)
    assert found(trie.prefix_trie(*again)) == brute(rebuilt(own))
    assert trie.prefix_trie(*trie.whole(trie.turns(df.limit(0)))).count() == 0


def test_many_copies_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "_RUN", 7)
    df = spark.range(500).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "'same' AS text")
    want = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    rows = trie.prefix_trie(*trie.whole(trie.turns(df))).collect()
    assert sorted((x.depth, x.n_convs, x.ends_sha256 == want) for x in rows) == [(0, 500, False), (1, 500, True)]
