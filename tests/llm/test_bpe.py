import hashlib
import json
import random
import struct

import pytest
from corpuscle.llm import bpe
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PIECES = [" ", "  ", "\t", "\n", "\n\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", chr(0x2003), chr(0x3000), chr(0x180E), chr(0x200B), "'s", "'ll", "’", "the", " the", "é", "à ", "ß", "漢字", "😀", "e" + chr(0x301), "0", "²½Ⅷ", "12345", ".", "!?", "-_", "\x00", "<|endoftext|>", "<|endof"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def same(library, text):
    codec = bpe.codec(bpe.default_path())
    ids = library.encode(text, add_special_tokens=False).ids
    packed = codec.encode(text)
    assert packed == struct.pack(f"<{len(ids)}I", *ids), text
    assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_mixed_pieces(library):
    r = random.Random(4)
    for _ in range(4000):
        same(library, "".join(r.choice(PIECES) for _ in range(r.randint(0, 12))))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    same(library, text)


def test_runs_without_breaks(library):
    for text in ("a" * 5000, "ab" * 3000, "!" * 3000, " " * 3000, "\n" * 999 + "x", "é" * 2000):
        same(library, text)


def test_every_forced_cut_is_a_token_boundary(library):
    codec = bpe.codec(bpe.default_path())
    for text in ("HTTPSconnection", "naïve漢字test", "x9!!é", "über-straße"):
        piece = text.encode()
        ends, at = set(), 0
        for i in memoryview(codec.encode(text)).cast("I"):
            at += len(codec.tokens[i])
            ends.add(at)
        at = 0
        for part in codec.forced(piece):
            at += len(part)
            assert at in ends


def test_frame(spark, library):
    texts = [None, "", "One two  three\n", "<|endoftext|> x", "long word " * 50_000, "One two  three\n"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.encode_decode(df).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(rows[i].ids) == packed and rows[i].n_tokens == len(ids) and rows[i].decoded == (t or "")
        assert rows[i].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_query_against_the_library(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op5(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_parts_join_to_the_whole():
    r = random.Random(8)
    text = "".join(r.choice(["a", "bc", " ", "\n", "  ", "."]) for _ in range(3000))
    for size in (1, 7, 100, 10_000):
        found = list(bpe.parts(text, size))
        assert "".join(found) == text
        assert bpe.codec(bpe.default_path()).encode(text) == b"".join(bpe.codec(bpe.default_path()).encode(p) for p in found)


def test_other_files_are_refused(tmp_path):
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    wrong = {"type": "BPE", "vocab": byte | {"bc": 256, "ab": 257, "abc": 258}, "merges": ["b c", "a b", "ab c"]}
    right = {"type": "BPE", "vocab": byte | {"ab": 256, "bc": 257, "abc": 258}, "merges": ["a b", "b c", "ab c"]}
    added = {"id": 300, "content": "<x>", "lstrip": True, "rstrip": False, "single_word": False}
    for change, fine in (({}, True), ({"model": right}, True), ({"model": wrong}, False), ({"normalizer": {"type": "NFC"}}, False), ({"added_tokens": [added]}, False), ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, False)):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(spec | change))
        if fine:
            bpe.Codec(str(path))
        else:
            with pytest.raises(ValueError, match="can't be cut"):
                bpe.Codec(str(path))


def test_a_waiting_worker_remembers_no_fragments():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array([b"some words that are remembered"])})
    assert [b.num_rows for b in bpe._run(None, True, False)(iter([batch]))] == [1]
    memory = bpe.codec(bpe.default_path())._memory
    assert not memory.young and not memory.old
