import glob
import os

from pyspark.sql import functions as F

from corpuscle.operators import accounting
from corpuscle.sources import listing, sinks

TITLES = {"a": [["a1", "a2"], ["a3"], ["a4"]], "b": [["b1"], ["b2"]], "c": [[]]}


def fetcher(flag):
    """Page n of b fails as long as the file `flag` is there."""

    def fetch(prefix, token):
        n = int(token or 0)
        if prefix == "b" and n == 1 and os.path.exists(flag):
            raise OSError("timeout")
        return [(t, n) for t in TITLES[prefix][n]], str(n + 1) if n + 1 < len(TITLES[prefix]) else None

    return fetch


def test_a_failed_page_is_an_error_row_and_the_rest_is_read(spark, tmp_path):
    flag = tmp_path / "down"
    flag.write_text("x")
    listing.register(spark, "titles", "title string, page int", fetcher(str(flag)), ["a", "b", "c"], tries=2)
    df = spark.read.format("titles").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect()), key=str) == [("a", "a1", 0, None), ("a", "a2", 0, None), ("a", "a3", 1, None), ("a", "a4", 2, None), ("b", "b1", 0, None), ("b", None, None, "OSError: timeout")]


def test_a_stream_goes_on_from_its_tokens(spark, tmp_path):
    flag = tmp_path / "down2"
    flag.write_text("x")
    listing.register(spark, "titles2", "title string, page int", fetcher(str(flag)), ["a", "b", "c"], tries=1)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run(seconds):
        q = spark.readStream.format("titles2").load().writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(processingTime="300 milliseconds").start(out)
        q.awaitTermination(seconds)
        q.stop()
        return spark.read.parquet(out)

    first = run(12)
    assert first.filter("error IS NOT NULL").count() > 0 and {r.title for r in first.collect()} >= {"a1", "a2", "b1"}
    flag.unlink()
    rows = run(12).filter("error IS NULL")
    assert sorted(r.title for r in rows.collect()) == ["a1", "a2", "a3", "a4", "b1", "b2"]


def test_counters_come_with_the_write(spark):
    rows, seen = accounting.written_with(spark.range(100), n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert seen == {"n": 100, "odd": 50} and rows.count() == 100
    assert accounting.written_with(spark.range(0), n=F.count(F.lit(1)))[1] == {"n": 0}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    to = str(tmp_path / "t")
    spark.range(30).selectExpr("id AS k", "'old' AS v", "id DIV 10 AS part").write.partitionBy("part").parquet(to)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{to}/part=*/*.parquet")}
    second = spark.range(15, 45).filter("id < 18 OR id > 40").selectExpr("id AS k", "'new' AS v", "id DIV 10 AS part")
    assert sinks.merged_folder(to, second, "k", "part") == [1, 4]
    got = {r.k: r.v for r in spark.read.parquet(to).collect()}
    assert got == {k: "new" if k in (15, 16, 17) or k > 40 else "old" for k in [*range(30), 41, 42, 43, 44]}
    after = glob.glob(f"{to}/part=*/*.parquet")
    assert all((f in after) == ("part=1/" not in f) for f in before)
    assert sinks.merged_folder(to, second.selectExpr("k", "'late' AS v", "part"), "k", "part", overwrite=False) == [1, 4] and spark.read.parquet(to).filter("v = 'late'").count() == 0
    assert sinks.merged_folder(to, second.limit(0), "k", "part") == []
