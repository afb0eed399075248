import time

from sheaf.streaming import pages as P


def test_token_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:10' ts, 'one two' text union all select timestamp'2024-01-01 00:06:00', 'three'").write.parquet(src)
    s = spark.readStream.schema("ts timestamp, text string").parquet(src)
    q = P.token_windows(s).writeStream.outputMode("complete").format("memory").queryName("token_windows").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r["texts"], r["tokens"]) for r in spark.table("token_windows").collect()) == [(1, 1), (1, 2)]


def test_split_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select cast(id as long) doc, cast(p as int) page_no, p = 1 or p = 3 begins from range(1, 3) lateral view explode(sequence(1, 4)) t as p").write.parquet(src)
    s = spark.readStream.schema("doc long, page_no int, begins boolean").parquet(src)
    q = P.split_stream(s, "doc", "begins").writeStream.outputMode("append").format("memory").queryName("split_stream").trigger(processingTime="1 second").start()
    # with a timeout in processing time there is always another batch, so the query never counts as done
    until = time.time() + 60
    while time.time() < until and spark.table("split_stream").count() < 2:
        time.sleep(0.5)
    q.stop()
    assert sorted((r["doc"], r["group_no"], r["pages"]) for r in spark.table("split_stream").collect()) == [(1, 1, [1, 2]), (2, 1, [1, 2])]
