import glob
import shutil

from pyspark.sql import functions as F

from corpuscle.streaming import state


def test_shuffled_stream_equals_the_batch_also_after_a_restart(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    src = tmp_path / "all"
    events.repartition(4, "event_id").write.parquet(str(src))
    parts = sorted(glob.glob(f"{src}/*.parquet"))
    assert len(parts) == 4
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for first in (True, False):
        to, ckpt = str(tmp_path / f"to{first}"), str(tmp_path / f"c{first}")
        box = inbox / str(first)
        box.mkdir()
        for k in range(2):  # half the files, a restart, the other half
            for p in parts[2 * k : 2 * k + 2]:
                shutil.copy(p, box)
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(box))
            state.upsert(state.winners(stream, "user_id", "ts", ["event_id"], ["event_type", "value"], first, "60 days"), to, ckpt)
        pick = F.min_by if first else F.max_by
        want = events.groupBy("user_id").agg((F.min if first else F.max)("event_id").alias("event_id"), *(pick(c, "event_id").alias(c) for c in ("event_type", "value")))
        got = state.current(spark, to, "user_id").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_timers_drop_what_the_watermark_has_passed(spark, tmp_path):
    def put(name, rows):
        df = spark.createDataFrame(rows, "k int, ts string, n long").select("k", F.col("ts").cast("timestamp").alias("ts"), "n")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        return df.schema

    to, ckpt = str(tmp_path / "to"), str(tmp_path / "c")

    def run(schema):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        state.upsert(state.winners(stream, "k", "ts", ["n"], [], True, "10 minutes"), to, ckpt)
        return sorted(map(tuple, state.current(spark, to, "k").collect()))

    schema = put("a", [(1, "2024-01-01 00:00:00", 5), (2, "2024-01-01 00:00:00", 7)])
    assert run(schema) == [(1, 5), (2, 7)]
    put("b", [(1, "2024-01-01 00:05:00", 3), (3, "2024-01-01 02:00:00", 1)])  # late but within the lateness; the watermark moves on
    assert run(schema) == [(1, 3), (2, 7), (3, 1)]
    put("c", [(2, "2024-01-01 00:01:00", 1)])  # beyond it: left out
    assert run(schema) == [(1, 3), (2, 7), (3, 1)]
    put("d", [(2, "2024-01-01 03:00:00", 9)])  # the state of key 2 is gone, so it begins anew
    assert run(schema) == [(1, 3), (2, 9), (3, 1)]
