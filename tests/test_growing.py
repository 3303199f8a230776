"""The unbounded source and the epoch hook across stops, failures and restarts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.sources import growing
from tessera.streaming import epochs


def test_each_row_once_across_stops_and_failures(spark, tmp_path):
    feed, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "name string, id long"
    batches, fail = Counter(), {2}
    every = spark.range(0, 1000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), "id")

    def keep(df, number):
        batches[number] += 1
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number in fail:
            fail.remove(number)
            raise RuntimeError("lost after the write")

    def run():
        q = growing.read_growing(spark, feed, "id", schema, str(tmp_path / "at"), 150).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    every.filter("id < 620").repartitionByRange(3, "id").write.option("parquet.block.size", 1 << 10).parquet(feed)
    with pytest.raises(Exception, match="lost after the write"):
        run()
    run()
    every.filter("id >= 620").coalesce(1).write.mode("append").parquet(feed)
    run()
    run()  # nothing is new
    got = Counter((r["name"], r["id"]) for r in spark.read.parquet(out).collect())
    assert got == Counter((f"n{i}", i) for i in range(1000))
    assert batches[2] == 2 and len(batches) > 4 and (spark.read.parquet(out).filter("batch = 0").count()) == 150


def test_reader_plans_ranges(tmp_path):
    import pyarrow as pa
    from pyarrow import parquet
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("id", LongType())])
    parquet.write_table(pa.table({"id": pa.array(range(100))}), tmp_path / "a.parquet", row_group_size=25)
    parquet.write_table(pa.table({"id": pa.array(range(100, 140))}), tmp_path / "b.parquet", write_statistics=False)
    r = growing.GrowingReader(str(tmp_path), "id", 0, schema)
    assert r.latestOffset() == {"next": 140}
    pieces = r.partitions({"next": 30}, {"next": 110})
    assert [(p.file[-9:], p.group) for p in pieces] == [("a.parquet", 1), ("a.parquet", 2), ("a.parquet", 3), ("b.parquet", 0)]
    assert [x for p in pieces for b in r.read(p) for x in b.column(0).to_pylist()] == list(range(30, 110))
    empty = growing.GrowingReader(str(tmp_path / "none"), "id", 10, schema)
    assert empty.initialOffset() == empty.latestOffset() and empty.partitions({"next": 0}, {"next": 0}) == []
    with pytest.raises(ValueError, match="schema"):
        growing.GrowingTable({}).schema()


def test_bounded_batches_need_a_checkpoint(spark, tmp_path):
    with pytest.raises(ValueError, match="checkpoint"):
        growing.read_growing(spark, str(tmp_path), "id", "id long", keys_a_batch=5)


def test_epochs_go_on_after_a_restart(spark, tmp_path):
    feed, out = str(tmp_path / "in"), str(tmp_path / "out")
    source = F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 2 == 0, F.col("id") % 5)  # a hot source, and null ones
    every = spark.range(0, 600).select("id", source.cast("long").alias("source"))
    with epochs.rocks(spark):
        for low, high in ((0, 90), (90, 95), (95, 600)):
            every.filter(F.col("id").between(low, high - 1)).write.mode("append").parquet(feed)
            picked = epochs.every_nth(growing.read_growing(spark, feed, "id", "id long, source long", str(tmp_path / "at"), 200), "source", "id", 4)
            q = picked.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).start()
            q.processAllAvailable()
            q.stop()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != epochs.ROCKS
    want, seen = set(), Counter()
    for r in sorted(every.dropna().collect()):
        if seen[r["source"]] % 4 == 0:
            want.add((r["source"], r["id"], seen[r["source"]]))
        seen[r["source"]] += 1
    got = spark.read.parquet(out).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    with pytest.raises(ZeroDivisionError):
        epochs.every_nth(every, "source", "id", 0)
