import hashlib
import struct

import corpus_pipeline as pipe
import pyarrow as pa
import __spark_entry__ as entry
from corpuscle.llm import bpe, simhash
from tokenizers import Tokenizer

from .test_linededup import brute as brute_lines
from .test_simhash import classes


def near_groups(text, least=0.8):
    """Groups by two bits of the fingerprint or by the Jaccard of five-word shingle sets, every pair compared."""
    words = {i: (t or "").encode().lower().split() for i, t in text.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    prints = {i: simhash.fingerprint((t or "").encode(), 5) for i, t in text.items()}
    ids = sorted(text)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    near = [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 2 or sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return classes(ids, near)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, frames[-1], sf)
        assert out.columns == docs.columns, name
        frames.append(pipe.materialize(out))
    text = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(text[0]) - set(text[1])
    assert gone and sum(not labels.get(i, 1) for i in gone) <= 2
    lines = brute_lines(list(text[1].items()), 50)
    assert text[2] == {i: t for i, t in lines.items() if t == text[1][i] or t.strip()}
    assert text[3] == {i: text[2][i] for i, g in near_groups(text[2]).items() if g == i}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, t in text[3].items() if any(x in t for x in items)}
    assert leaks and not leaks & set(text[4])
    library = Tokenizer.from_file(bpe.default_path())
    rows = pipe.STAGES[-1][1](spark, frames[-1], sf).collect()
    assert {r.doc_id for r in rows} == set(text[4])
    for r in rows:
        own = library.encode(text[4][r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()


def test_run_is_registered_and_equals_its_stages(spark, sf):
    assert entry.queries()["pipeline"].__wrapped__ is pipe.run and pipe.ORACLE_SQL is None
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipe.STAGES:
        df = pipe.materialize(stage(spark, df, sf))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, pipe.run(spark, sf).collect()))


def test_edge_tables(spark, sf, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = [(1, None, "a", [1]), (2, "", "a", [1]), (3, "some text here", "b", None), (3, "some text here", "b", None), (None, "more", "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, tie array<int>")
    for frame, want in ((df, [None, 1, 3]), (df.limit(0), [])):
        for _, stage in pipe.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == df.columns
        got = pipe.encode(spark, frame, str(tmp_path)).collect()
        assert sorted((r.doc_id for r in got), key=lambda x: x or 0) == want


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_near_copies_go_by_similarity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    groups, by_bits = near_groups(text), near_groups(text, 2.0)
    kept = {r.doc_id: r.text for r in pipe.drop_near_duplicates(spark, docs, sf).collect()}
    assert kept == {i: text[i] for i, g in groups.items() if g == i} and len(kept) < len(set(by_bits.values()))


def test_batches_for_python_are_bounded_in_bytes(spark, sf):
    own = spark.newSession()
    pipe.STAGES[-1][1](own, own.read.parquet(f"{sf}/documents.parquet"), sf)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches)
    texts = own.range(0, 9_000, 1, 1).selectExpr("repeat('x', 2000) AS text")
    got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 18_000_000 and max(got) < 5_000_000
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    pipe.STAGES[-1][1](own, own.read.parquet(f"{sf}/documents.parquet"), sf)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_no_stage_sends_decoded_texts(spark, sf):
    plan = pipe.encode(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)._jdf.queryExecution().analyzed().toString()
    assert "decoded_sha256" in plan and "decoded#" not in plan
