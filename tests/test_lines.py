import json
import random

from corpuscle.sources.lines import LineReader, firsts, json_records, ordered_lines


def want(path, name):
    data = (path / name).read_bytes()
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    return [(name, i, (x[:-1] if x.endswith(b"\r") else x).decode("utf-8", "replace")) for i, x in enumerate(lines)]


def by_hand(path, size):
    """Both passes of the reader, without Spark."""
    options = {"path": path, "range": str(size)}
    counter = LineReader(options | {"counting": "true"})
    counts = [b.to_pylist()[0] for p in counter.partitions() for b in counter.read(p)]
    reader = LineReader(options | {"firsts": json.dumps(firsts((c["file"], c["start"], c["lines"]) for c in counts))})
    return sorted(tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())


def test_numbers_hold_whatever_the_ranges(spark, tmp_path):
    r = random.Random(1)
    (tmp_path / "sub").mkdir()
    for name in ("a.txt", "b.txt", "sub/c.txt"):
        body = b"".join(r.choice([b"", b"x" * r.randint(0, 40), "é€ü".encode(), b"\r"]) + r.choice([b"\n", b"\n", b"\r\n", b" "]) for _ in range(300))
        (tmp_path / name).write_bytes(body)
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "one.txt").write_bytes(b"no end")
    (tmp_path / "ends.txt").write_bytes(b"\n\n\n")
    (tmp_path / "bad.txt").write_bytes(b"ok\n\xff\xfe\nlong " + b"y" * 5000)
    (tmp_path / "_SUCCESS").write_bytes(b"no data\n")
    names = ["a.txt", "b.txt", "sub/c.txt", "empty.txt", "one.txt", "ends.txt", "bad.txt"]
    expected = sorted(x for n in names for x in want(tmp_path, n))
    for size in (1, 2, 7, 64, 1 << 20):
        assert by_hand(str(tmp_path), size) == expected, size
    got = ordered_lines(spark, str(tmp_path), size=2000)
    assert got.rdd.getNumPartitions() > 7 and sorted(map(tuple, got.collect())) == expected


def test_no_text_is_shuffled(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "x"}\n\n{"k": 2}\nbroken\n')
    rows = json_records(ordered_lines(spark, str(tmp_path), "*.jsonl"), "k int, t string")
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [("a.jsonl", 0, 1, "x", None), ("a.jsonl", 2, 2, None, None), ("a.jsonl", 3, None, None, "broken")]
