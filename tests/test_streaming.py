"""Streams, one micro-batch at a time."""

from pyspark.sql import functions as F

from loomgraph.sources.extract import extract, fragments
from loomgraph.streaming import incremental


def test_watch_rebuilds_changed_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    pass\n")
    (src / "b.py").write_text("def two():\n    pass\n")

    def run():
        q = incremental.watch(spark, str(src)).writeStream.foreachBatch(incremental.rebuild(f"{tmp_path}/t")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    assert {"one()", "two()"} <= {r["label"] for r in spark.read.parquet(f"{tmp_path}/t/v0/nodes").collect()}
    (src / "c.py").write_text("def three():\n    pass\n")
    run()
    assert {"one()", "two()", "three()"} <= {r["label"] for r in spark.read.parquet(f"{tmp_path}/t/v1/nodes").collect()}


def test_a_batch_twice_is_a_batch_once(spark, tmp_path):
    files = spark.createDataFrame([("x/a.py", "def one():\n    pass\n")], "path string, text string")
    for _ in range(2):
        incremental.rebuild(f"{tmp_path}/t")(files, 0)
    assert spark.read.parquet(f"{tmp_path}/t/v0/nodes").count() == fragments(extract(files))[0].count()


def test_routing(spark):
    code, other = incremental.route(spark.createDataFrame([("a.py", ""), ("b.md", ""), ("c", "")], "path string, text string"))
    assert code.count() == 1 and other.count() == 2


def test_event_stream_equals_the_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(sf)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "in").mkdir()
    batch.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = incremental.event_windows(stream).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    every = {(r["start"], r["event_type"]): r["n"] for r in incremental.event_windows(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert closed and all(every[k] == n for k, n in closed.items())


def labels(spark, tables):
    return {r["label"] for r in incremental.tables_of(spark, tables)[0].collect()}


def test_changed_and_deleted_files_are_seen(spark, tmp_path):
    src, tables = tmp_path / "src", f"{tmp_path}/t"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    pass\n")
    (src / "b.py").write_text("def two():\n    pass\n")
    (src / "c.md").write_text("# Some text\n")
    look = lambda: incremental.refresh(spark, str(src), tables, quiet=0)
    first = look()
    assert first.version == 0 and len(first.stale) == 1 and {"one()", "two()"} <= labels(spark, tables)
    assert look() == incremental.Refreshed()
    (src / "a.py").write_text("def other_name():\n    pass\n")
    second = look()
    assert second.version == 1 and len(second.changed) == 1 and "other_name()" in labels(spark, tables) and "one()" not in labels(spark, tables)
    (src / "b.py").unlink()
    assert look().version == 2 and "two()" not in labels(spark, tables)
    (src / "a.py").write_text("def other_name():\n    return 1\n")
    assert look().version is None and incremental.versions(spark, tables)[-1] == 2


def test_a_burst_of_changes_is_waited_for(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def one():\n    pass\n")
    written = (tmp_path / "src" / "a.py").stat().st_mtime
    look = lambda at: incremental.refresh(spark, f"{tmp_path}/src", f"{tmp_path}/t", 3.0, lambda: at)
    assert look(written + 1).waiting and look(written + 4).version == 0


def test_a_new_checkpoint_keeps_the_graph(spark, tmp_path):
    one, two = (spark.createDataFrame([(f"x/{n}.py", f"def {n}():\n    pass\n")], "path string, text string") for n in ("one", "two"))
    incremental.rebuild(f"{tmp_path}/t")(one, 0)
    incremental.rebuild(f"{tmp_path}/t")(two, 0)
    assert {"one()", "two()"} <= labels(spark, f"{tmp_path}/t")


def test_pending_paths_and_hot_reload(spark, tmp_path):
    tables = f"{tmp_path}/t"
    incremental.queue(spark, tables, ["b", "a", "b"])
    incremental.queue(spark, tables, ["c", "a"])
    assert incremental.drain(spark, tables) == ["b", "a", "c"] and incremental.drain(spark, tables) == []
    files = lambda n: spark.createDataFrame([(f"x/{n}.py", f"def {n}():\n    pass\n")], "path string, text string")
    incremental.rebuild(tables)(files("one"), 0)
    latest = incremental.Latest(spark, tables)
    held = latest()
    assert latest() is held
    incremental.rebuild(tables)(files("two"), 1)
    assert latest() is not held and latest()[0].where("label = 'two()'").count() == 1
    for n in ("three", "four", "five"):
        incremental.rebuild(tables)(files(n), 2)
    assert len(incremental.versions(spark, tables)) == incremental.KEEP
