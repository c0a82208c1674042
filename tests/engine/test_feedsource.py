"""Feeds as a data source: batch equals the reader of tables, a stream that starts again reads nothing twice and loses nothing."""

import json
import os

from siftwell.sources import readers
from siftwell.sources.feedsource import FeedSource, FeedStreamReader, Files

ITEM = "<item><title>T{0}</title><link>https://f.org/{0}</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>"


def feed(*numbers):
    return "<rss><channel>" + "".join(ITEM.format(n) for n in numbers) + "</channel></rss>"


def drop(folder, name, *lines, at=None):
    path = folder / name
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps({"feed_url": x[0], "xml": x[1]}) for x in lines), "utf-8")
    if at is not None:
        os.utime(path, ns=(at, at))


def test_batch_equals_table(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    drop(tmp_path, "a.json", ("u1", feed(1, 2)), "{broken", "[1]", ("u2", "<no"), ("u3", None))
    drop(tmp_path, "b.json", (None, feed(*range(50_000))), ("u4", feed()))  # a line over several blocks
    drop(tmp_path, "_c.json", ("u5", feed(9)))
    drop(tmp_path, "d.json")
    got = spark.read.format("feeds").option("filesPerPartition", 1).load(str(tmp_path))
    table = spark.createDataFrame([("u1", feed(1, 2)), (None, feed(*range(50_000)))], "feed_url string, xml string")
    want = readers.read_feeds(table)
    assert got.schema == want.schema and got.rdd.getNumPartitions() == 3
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == 50_002
    assert spark.read.format("feeds").load(f"file://{tmp_path}").count() == 50_002
    assert spark.read.format("feeds").load(str(tmp_path / "none")).count() == 0


def poll(spark, folder, state, files=1000):
    stream = spark.readStream.format("feeds").option("settle", 0).option("filesPerBatch", files).load(str(folder))
    q = stream.writeStream.format("parquet").option("path", str(state / "out")).option("checkpointLocation", str(state / "log")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(r.title for r in spark.read.schema(readers.FEED).parquet(str(state / "out")).collect())


def test_restart_reads_nothing_twice(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    folder = tmp_path / "feeds"
    folder.mkdir()
    drop(folder, "b.json", ("u", feed(1, 2)))
    drop(folder, "a.json", ("u", feed(3)))
    assert poll(spark, folder, tmp_path, files=1) == ["T1", "T2", "T3"]
    assert poll(spark, folder, tmp_path) == ["T1", "T2", "T3"]
    drop(folder, "0.json", ("u", feed(4)))  # later, though first by name
    assert poll(spark, folder, tmp_path, files=1) == ["T1", "T2", "T3", "T4"]


def test_offsets(tmp_path):
    drop(tmp_path, "b", ("u", feed(1)), at=5)
    drop(tmp_path, "a", ("u", feed(2)), at=5)
    drop(tmp_path, "c", ("u", feed(3)), at=3)
    new = lambda: FeedStreamReader({"path": str(tmp_path), "filesPerBatch": "2", "settle": "0"})
    r = new()
    first = r.latestOffset()
    second = r.latestOffset()
    names = lambda parts: [os.path.basename(p) for f in parts for p in f.paths]
    assert names(r.partitions(r.initialOffset(), first)) == ["c", "a"] and names(r.partitions(first, second)) == ["b"]
    assert r.latestOffset() == second and names(r.partitions(second, second)) == []
    again = new()  # a query that repeats its last batch and goes on
    assert names(again.partitions(first, second)) == ["b"] and again.latestOffset() == second
    assert [x[2] for x in r.read(Files((str(tmp_path / "c"),)))] == ["T3"]
    slow = FeedStreamReader({"path": str(tmp_path), "settle": "3600"})
    os.utime(tmp_path / "b")
    assert os.path.basename(slow.latestOffset()["path"]) == "a"
