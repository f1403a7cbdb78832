import struct
import zlib

import numpy as np
import pyarrow as pa
from corpuscle.llm import bpe, tokenfile
from tokenizers import Tokenizer


def test_perfect_hash_is_minimal_and_total():
    for n in (0, 1, 2, 63, 64, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**63), 2**63, n)).view(np.uint64)
        assert sorted(tokenfile.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_keyed_access_reads_one_slot_and_one_range(tmp_path):
    for n in (100, 400_000):
        keys = np.arange(0, 2 * n, 2, dtype=np.int64)
        out = tokenfile._Writer(str(tmp_path), 0, 2)
        out.add(keys.tolist(), np.repeat(np.arange(n) & 0xFFFF, 3), np.full(n, 3))
        (row,) = out.close().to_pylist()
        files = tokenfile.Reader(str(tmp_path))
        shard = tokenfile.Shard(row, files)
        for k in (0, n, 2 * n - 2):
            k -= k % 2
            before = files.bytes
            assert [x.tolist() for x in shard.get(k)] == [[k // 2 & 0xFFFF] * 3]
            # Words, rank, fingerprint, row number, two offsets, this and the next key, three ids.
            assert files.bytes - before <= 8 * len(row["levels"]) + 4 + 4 + 4 + 16 + 24 + 6 and files.files == 2
        before = files.bytes
        assert not [x for k in range(1, 401, 2) for x in shard.get(k)]
        assert files.bytes - before <= 200 * (8 * len(row["levels"]) + 8)
        assert (shard.check() == keys).all()


def expected(docs):
    library = Tokenizer.from_file(bpe.default_path())
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, tokenfile.op2(spark, sf).collect())) == expected(docs)


def test_fragments_encode_as_the_library_does():
    e, library = tokenfile.encoder(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    rows = ["", " ", "  ", "a  ", "a   b", "a\n\n\nb", " \n x", "don't, it's. x", "x<|endoftext|> y", "a\u00a0  b", "a\u2003 b \u201cq\u201d  z", "\x1c  a", "\u00e9, \u00e0.  b"]
    rows += ["3.14, 5!  ?", "a\t\tb \r\n c\r\n\r\n", "|<|endoftext|>", "\u65e5\u672c \u8a9e\u3002 x", "\n", "end \n ", "a b " * 300_000]
    random = np.random.default_rng(0)
    rows += ["".join(random.choice(list("ab1.,' \n\t\u00e9\u00a0"), 30)) for _ in range(3000)]
    ids, lengths = e.encode(pa.array([t.encode() for t in rows], pa.binary()), 2)
    starts = np.cumsum(lengths) - lengths
    for t, at, n in zip(rows, starts.tolist(), lengths.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t[:40]


def test_edge_rows_and_lookup(spark, tmp_path):
    rows = [(9, "nine"), (1, None), (1, ""), (4, "many words " * 30_000), (-3, "minus <|endoftext|>\n\nx"), (9, "nine"), (None, "no key")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, key int")
    to = str(tmp_path / "t")
    tokenfile.write(df, to, shard_ids=8)
    got = sorted(tokenfile.read(spark, to).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -3, 1, 1, 4, 9, 9]
    texts = [r[1] or "" for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    want = expected([(r.doc_id, t) for r, t in zip(got, texts, strict=True)])
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got] == want
    found = tokenfile.lookup(spark, to, [9, 4, 5, 77]).collect()
    assert sorted(r.doc_id for r in found) == [4, 9, 9] and {bytes(r.ids) for r in found} == {bytes(r.ids) for r in got if r.doc_id in (4, 9)}
    tokenfile.write(df.limit(0), str(tmp_path / "e"))
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0
