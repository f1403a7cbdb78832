import os

import pytest
from pyspark.sql import functions as F

from corpuscle.sources import collection as C
from corpuscle.streaming import embedding


def test_failed_task_leaves_the_old_collection_whole(spark, tmp_path):
    to = str(tmp_path / "store")
    rows = spark.range(100).select(F.col("id"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("collection"))
    assert C.put(rows, to, key="id", batch=10) == {"c0": 34, "c1": 33, "c2": 33}
    broken = rows.withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id") + 1000)).repartition(3)
    with pytest.raises(Exception, match="broken"):
        C.put(broken, to)
    assert C.counts(to) == {"c0": 34, "c1": 33, "c2": 33} and C.opened(spark, to).agg(F.max("id")).first()[0] == 99
    assert len(os.listdir(f"{to}/data")) == 1  # what the failed job wrote is gone
    assert C.put(rows.filter("collection = 'c1'").withColumn("id", F.col("id") + 500), to, append=True)["c1"] == 66
    assert C.opened(spark, to, "c1").count() == 66 and len(C.opened(spark, to, "c2").inputFiles()) < len(C.opened(spark, to).inputFiles())
    assert C.put(rows.filter("id < 3"), to) == {"c0": 1, "c1": 1, "c2": 1} and C.opened(spark, to).count() == 3
    with pytest.raises(ValueError, match="repeats"):
        C.put(rows.union(rows), to, key="id")
    with pytest.raises(FileNotFoundError):
        C.opened(spark, to, "none")


def test_embedding_that_breaks_off_embeds_each_row_once(spark, tmp_path):
    src, to = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(40).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("text "), "id")).alias("text")).repartition(4, "id").write.parquet(src)

    def broken(number):
        if number == 1:
            raise RuntimeError("power cut")

    options = {"schema": "id long, text string", "key": "id", "text": "text", "to": to, "files": 1}
    with pytest.raises(Exception, match="power cut"):
        embedding.run(spark, src, after_write=broken, **options)
    first = embedding.progress(spark, to).collect()
    assert len(first) == 1 and embedding.vectors(spark, to).count() == first[0].n_rows  # the broken batch's vectors don't count
    embedding.run(spark, src, **options)
    embedding.run(spark, src, **options)  # nothing new: nothing happens
    done = embedding.progress(spark, to)
    assert done.count() == 4 and done.select("file").distinct().count() == 4 and done.agg(F.sum("n_vectors")).first()[0] == 40
    assert sorted(r.id for r in embedding.vectors(spark, to).collect()) == list(range(40))


def test_documents_are_dealt_by_size_into_files(spark, sf, monkeypatch):
    from corpuscle.plans import stores

    seen = []
    monkeypatch.setattr(stores.embedding, "run", lambda spark, source, *a, f=stores.embedding.run, **k: seen.append(spark.read.parquet(source)) or f(spark, source, *a, **k))
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(least)
    spark.conf.set(least, "4k")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert stores.embed_stream(spark, sf).first().complete
    finally:
        spark.conf.set(least, before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen[0].inputFiles()) > 4
